"""Queries of recordings and channels: checks, pairs, clocks, grids, variants, levels and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import ordering, recordings
from strandline.plans.base import DAY, EVENTS, HOUR, events, table


def ingest_checks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as sources: their nation as camera, their account's whole hundreds as content."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("camera"), F.floor(F.col("s_acctbal").cast("double") / 100).alias("digest"))
    return recordings.ingest_violations(s, "camera", "digest")


def path_pairs(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("data/form"), F.col("k").cast("string"), F.lit("/"), F.col("event_type"), F.lit("/"), F.when(F.col("user_id") % 7 == 0, "notes").when(F.col("user_id") % 2 == 0, "video").otherwise("points"), F.lit("/"), F.col("event_id").cast("string"))
    files = events(spark, d).filter(F.col("value") > 120).select(path.alias("path"))
    return recordings.paired_files(files, "path", r"^data/(form\d+)/(\w+)/(\w+)/\d+$", ["video", "points"])


def time_mapping(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    times = e.filter("event_type = 'purchase'").select("event_id", "user_id", "us")
    frames = e.filter("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("frame"))
    return recordings.time_mapping(times, frames, ["user_id"], "us", "frame", 2 * DAY).select("event_id", "before", "after", "nearest", "in_gap")


def resampled_grid(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter("event_type = 'click'").select("user_id", "us", "value")
    return recordings.resampled(e, ["user_id"], "us", "value", DAY).withColumn("value", F.round("value", 6))


def media_variant(spark: SparkSession, d: str) -> DataFrame:
    """Ten days of each user's frames, every fifth dropped, slowed by half."""
    low = 1_704_500_000_000_000
    e = ordering.ranked(events(spark, d).filter(F.col("us").between(low, low + 10 * DAY)), ["user_id"], F.asc("us"))
    dropped = e.select("ordinal").distinct().filter("ordinal % 5 = 4")
    return recordings.re_timed(e, "us", F.lit(low), 1.5, dropped, "ordinal").select("user_id", "ordinal", "event_id", "us", "source_time")


def chunk_rms(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"chunk": F.floor(F.col("us") / (6 * HOUR)), "x": F.col("value") - 30})
    return recordings.chunk_levels(e, ["event_type", "chunk"], "x", 60.0).select("event_type", "chunk", F.round("rms", 6).alias("rms"), F.round("clipped", 6).alias("clipped"))


def top_decile_energy(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("day", F.floor(F.col("us") / DAY))
    return recordings.top_decile(e, ["event_type", "day"], "value", "event_id").withColumn("energy", F.round("energy", 6))


def quality_of_events(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"day": F.floor(F.col("us") / DAY), "sigma": F.col("k") / 100})
    out = recordings.event_quality(e, ["user_id", "day"], "sigma", "value", "event_type")
    return out.withColumn("sources", F.array_join("sources", ","))


def offset_revisions(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("expected", F.col("k") % 4)
    return recordings.accepted_revisions(e, ["user_id"], "us", "expected")


def channel_at_both_ends(spark: SparkSession, d: str) -> DataFrame:
    """Errors as raw points, usable where the user's channel has a usable event in the hour before and in the hour after."""
    e = events(spark, d).withColumn("slot", F.floor(F.col("us") / (12 * HOUR)))
    usable = e.filter((F.col("event_type") == "view") & (F.col("value") > 10)).select("user_id", "slot").distinct()
    raw = e.filter("event_type = 'error'")
    for shift in (1, -1):
        raw = raw.join(usable.withColumn("slot", F.col("slot") + shift), ["user_id", "slot"], "left_semi")
    return raw.select("event_id", "user_id", "slot")


def entity_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders as entities, parts of their lines as samples, large parts as observations; keys without one listed."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("sample")).distinct()
    found = table(spark, d, "part").filter("p_size > 12").select(F.col("p_partkey").alias("sample"), F.lit(True).alias("seen"))
    rows = lines.join(found, "sample", "left").groupBy("entity")
    unresolved = F.array_join(F.array_sort(F.collect_list(F.when(F.col("seen").isNull(), F.col("sample")))), ",")
    return rows.agg(F.count("*").alias("n"), F.count("seen").alias("n_observed"), unresolved.alias("unresolved"))


def landmark_parts(spark: SparkSession, d: str) -> DataFrame:
    """The part of the body that a name belongs to, and its canonical name; names without one go."""
    name = F.concat(F.when(F.col("user_id") % 2 == 0, "left_").otherwise("right_"), F.element_at(F.array(*map(F.lit, ("knee", "index_tip", "heel", "ear", "tail"))), (F.col("k") % 5 + 1).cast("int")))
    part = F.when(name.rlike("^(left|right)_(thumb|index|middle|ring|pinky)_"), F.concat(F.split_part(name, F.lit("_"), F.lit(1)), F.lit("_hand"))).when(name.rlike("_(heel|forefoot|toe)$"), "foot").when(name.rlike("_(ear|eye)$"), "head").otherwise("body")
    canonical = spark.createDataFrame([("knee", "knee_joint"), ("index_tip", "index_end"), ("heel", "heel"), ("ear", "ear")], "tail string, canonical string")
    e = events(spark, d).select("event_id", name.alias("name"), part.alias("part"), F.regexp_replace(name, "^(left|right)_", "").alias("tail"))
    return e.join(F.broadcast(canonical), "tail").select("event_id", "name", "part", F.concat(F.split_part("name", F.lit("_"), F.lit(1)), F.lit("_"), "canonical").alias("canonical"))  # four rows


def named_points(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks of a user's day as columns in a stated order, with a mask of those missing."""
    names = ["view", "click", "signup"]
    wide = events(spark, d).groupBy("user_id", F.floor(F.col("us") / DAY).alias("day")).pivot("event_type", names).agg(F.min("value"))
    return wide.withColumn("missing", F.array_join(F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in names))), ","))


def current_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whether each event was made under its user's latest (kind, number), nulls being equal."""
    e = events(spark, d)
    head = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", (F.col("k") % 3).alias("k")), "us").alias("head"))
    return e.join(head, "user_id").select("event_id", F.struct("event_type", (F.col("k") % 3).alias("k")).eqNullSafe(F.col("head")).alias("current"))


def dense_links(spark: SparkSession, d: str) -> DataFrame:
    """Per order whether its line numbers are dense, and its lines as a map merged with defaults."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("long"))).alias("numbers"))
    dense = F.col("numbers") == F.sequence(F.col("numbers")[0], F.element_at("numbers", -1))
    defaults = F.create_map(F.lit("first"), F.lit(-1).cast("long"), F.lit("count"), F.lit(0).cast("long"))
    merged = F.map_from_entries(F.map_entries(F.map_zip_with(defaults, F.create_map(F.lit("count"), F.size("numbers").cast("long")), lambda _, a, b: F.coalesce(b, a))))
    return lines.select("l_orderkey", dense.alias("dense"), F.coalesce(F.element_at(merged, "first"), F.lit(0)).alias("first"), F.element_at(merged, "count").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (ingest_checks, path_pairs, time_mapping, resampled_grid, media_variant, chunk_rms, top_decile_energy, quality_of_events, offset_revisions)
    + (channel_at_both_ends, entity_evidence, landmark_parts, named_points, current_rows, dense_links)
}

W = "(PARTITION BY user_id ORDER BY us)"
ORACLES = {
    "ingest_checks": """WITH s AS (SELECT s_nationkey::VARCHAR AS camera, floor(s_acctbal::DOUBLE / 100)::BIGINT::VARCHAR AS digest FROM supplier)
        SELECT 'repeated_camera' AS "check", camera AS value, count(*) AS n FROM s GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'repeated_digest', digest, count(*) FROM s GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'too_few_sources', NULL, count(*) FROM s HAVING count(*) < 2""",
    "path_pairs": f"""WITH {EVENTS}, f AS (SELECT 'form' || k AS form, event_type AS "view", CASE WHEN user_id % 7 = 0 THEN 'notes' WHEN user_id % 2 = 0 THEN 'video' ELSE 'points' END AS kind, event_id FROM e WHERE value > 120),
        p AS (SELECT *, 'data/' || form || '/' || "view" || '/' || kind || '/' || event_id AS path FROM f)
        SELECT form, "view", min(path) FILTER (kind = 'video') AS video, min(path) FILTER (kind = 'points') AS points, CASE WHEN count(*) FILTER (kind = 'video') > 1 OR count(*) FILTER (kind = 'points') > 1 THEN 'repeated' WHEN count(DISTINCT kind) < 2 THEN 'incomplete' ELSE 'paired' END AS state FROM p WHERE kind <> 'notes' GROUP BY 1, 2
        UNION ALL SELECT NULL, NULL, path, NULL, 'unknown_layout' FROM p WHERE kind = 'notes'""",
    "time_mapping": f"""WITH {EVENTS}, v AS (SELECT user_id, us, event_id AS frame FROM e WHERE event_type = 'view'), q AS (SELECT e.event_id, e.us, (SELECT arg_max(frame, v.us) FROM v WHERE v.user_id = e.user_id AND v.us <= e.us) AS before, (SELECT arg_min(frame, v.us) FROM v WHERE v.user_id = e.user_id AND v.us >= e.us) AS after FROM e WHERE event_type = 'purchase')
        SELECT q.event_id, before, after, CASE WHEN a.us IS NULL OR q.us - b.us <= a.us - q.us THEN before ELSE after END AS nearest, coalesce(a.us - b.us > {2 * DAY}, true) AS in_gap FROM q LEFT JOIN e b ON b.event_id = before LEFT JOIN e a ON a.event_id = after""",
    "resampled_grid": f"""WITH {EVENTS}, s AS (SELECT user_id, us, value FROM e WHERE event_type = 'click'), g AS (SELECT user_id, unnest(range(min(us) // {DAY}, (max(us) + {DAY - 1}) // {DAY} + 1)) * {DAY} AS us FROM s GROUP BY 1),
        b AS (SELECT user_id, us, (SELECT max(s.us) FROM s WHERE s.user_id = g.user_id AND s.us <= g.us) AS t0, (SELECT min(s.us) FROM s WHERE s.user_id = g.user_id AND s.us >= g.us) AS t1 FROM g)
        SELECT b.user_id, b.us, round(CASE WHEN t0 IS NULL THEN y.value WHEN t1 IS NULL OR t1 = t0 THEN x.value ELSE x.value + (y.value - x.value) * ((b.us - t0)::DOUBLE / (t1 - t0)) END, 6) AS value FROM b LEFT JOIN s x ON x.user_id = b.user_id AND x.us = t0 LEFT JOIN s y ON y.user_id = b.user_id AND y.us = t1""",
    "media_variant": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER {W} - 1 AS ordinal FROM e WHERE us BETWEEN 1704500000000000 AND {1704500000000000 + 10 * DAY})
        SELECT user_id, ordinal, event_id, ((us - 1704500000000000) * 3 + 1) // 2 AS us, us AS source_time FROM r WHERE ordinal % 5 <> 4""",
    "chunk_rms": f"""WITH {EVENTS} SELECT event_type, us // {6 * HOUR} AS chunk, round(sqrt(avg((value - 30) * (value - 30))), 6) AS rms, round(avg((abs(value - 30) >= 60)::INT), 6) AS clipped FROM e GROUP BY 1, 2""",
    "top_decile_energy": f"""WITH {EVENTS}, r AS (SELECT event_type, us // {DAY} AS day, value, row_number() OVER (PARTITION BY event_type, us // {DAY} ORDER BY value DESC, event_id) AS i, count(*) OVER (PARTITION BY event_type, us // {DAY}) AS n FROM e)
        SELECT event_type, day, round(avg(value), 6) AS energy, count(*) AS n FROM r WHERE i <= (n + 9) // 10 GROUP BY 1, 2""",
    "quality_of_events": f"""WITH {EVENTS} SELECT user_id, us // {DAY} AS day, max(k / 100.0::DOUBLE) AS sigma, min(value) AS score, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS sources FROM e GROUP BY 1, 2""",
    "offset_revisions": f"""WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, us, k % 4 AS expected, row_number() OVER {W} AS i FROM e),
        f AS (SELECT user_id, us, i, (expected = 0)::BIGINT AS count, expected = 0 AS ok FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.us, s.i, f.count + (s.expected = f.count)::BIGINT, s.expected = f.count FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
        SELECT user_id, us, CASE WHEN ok THEN count END AS revision FROM f""",
    "channel_at_both_ends": f"""WITH {EVENTS}, s AS (SELECT *, us // {12 * HOUR} AS slot FROM e), u AS (SELECT DISTINCT user_id, slot FROM s WHERE event_type = 'view' AND value > 10)
        SELECT event_id, user_id, slot FROM s WHERE event_type = 'error' AND EXISTS (SELECT 1 FROM u WHERE u.user_id = s.user_id AND u.slot = s.slot - 1) AND EXISTS (SELECT 1 FROM u WHERE u.user_id = s.user_id AND u.slot = s.slot + 1)""",
    "entity_evidence": """WITH l AS (SELECT DISTINCT l_orderkey AS entity, l_partkey AS sample FROM lineitem), o AS (SELECT entity, sample, p_partkey IS NOT NULL AS seen FROM l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 12) ON p_partkey = sample)
        SELECT entity, count(*) AS n, count(*) FILTER (seen) AS n_observed, coalesce(string_agg(sample::VARCHAR, ',' ORDER BY sample) FILTER (NOT seen), '') AS unresolved FROM o GROUP BY 1""",
    "landmark_parts": f"""WITH {EVENTS}, n AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, k % 5 AS t FROM e WHERE k % 5 < 4)
        SELECT event_id, side || '_' || ['knee', 'index_tip', 'heel', 'ear'][t + 1] AS name, CASE t WHEN 0 THEN 'body' WHEN 1 THEN side || '_hand' WHEN 2 THEN 'foot' ELSE 'head' END AS part, side || '_' || ['knee_joint', 'index_end', 'heel', 'ear'][t + 1] AS canonical FROM n""",
    "named_points": f"""WITH {EVENTS}, w AS (SELECT user_id, us // {DAY} AS day, min(value) FILTER (event_type = 'view') AS "view", min(value) FILTER (event_type = 'click') AS click, min(value) FILTER (event_type = 'signup') AS signup FROM e GROUP BY 1, 2)
        SELECT *, concat_ws(',', CASE WHEN "view" IS NULL THEN 'view' END, CASE WHEN click IS NULL THEN 'click' END, CASE WHEN signup IS NULL THEN 'signup' END) AS missing FROM w""",
    "current_rows": f"""WITH {EVENTS}, h AS (SELECT user_id, arg_max(event_type, us) AS t, arg_max(k % 3, us) AS n FROM e GROUP BY 1) SELECT event_id, event_type IS NOT DISTINCT FROM t AND k % 3 IS NOT DISTINCT FROM n AS current FROM e JOIN h ON e.user_id = h.user_id""",
    "dense_links": """SELECT l_orderkey, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AND count(DISTINCT l_linenumber) = count(*) AS dense, -1::BIGINT AS first, count(*) AS n FROM lineitem GROUP BY 1""",
}
