"""Catalogue queries on joins: as-of, bracket, interval, band, matching, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import asof, editlog, graphs, intervals, matching
from strandline.plans.base import DAY, EVENTS, HOUR, ORDERS, events, orders, table


def _kind(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(F.col("event_type") == kind)


def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = asof.asof(_kind(e, "purchase"), _kind(e, "view"), ["user_id"], "us", ["event_id", "value"])
    return out.select("event_id", "user_id", F.col("match.event_id").alias("match_id"), F.col("match.value").alias("match_value"))


def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = asof.asof(_kind(e, "purchase"), _kind(e, "view"), ["user_id"], "us", ["event_id", "value"], "forward")
    return out.select("event_id", "user_id", F.col("match.event_id").alias("match_id"), F.col("match.value").alias("match_value"))


def asof_nearest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = asof.nearest(_kind(e, "purchase"), _kind(e, "click"), ["user_id"], "us", ["event_id"], tolerance=12 * HOUR)
    return out.select("event_id", F.col("match.event_id").alias("match_id"), (F.col("match.us") - F.col("us")).alias("offset_us"))


def bracket_lerp(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    out = asof.bracket(_kind(e, "purchase"), _kind(e, "view"), ["user_id"], "us", ["value"])
    return out.select("event_id", F.round(asof.lerp("us", "value"), 6).alias("value_at"), F.round(asof.weight("us"), 6).alias("weight"))


def asof_gap_policy(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    views = _kind(e, "view")
    extent = views.groupBy("user_id").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    out = asof.bracket(_kind(e, "error").join(extent, "user_id", "left"), views, ["user_id"], "us", ["event_id"])
    out = out.withColumns({"match": F.col("before"), "next_time": F.col("after.us")})
    outside = F.col("low").isNull()
    return out.select("event_id", F.when(outside, "outside_execution").otherwise(asof.snapshot_state("us", "low", "high", 2 * DAY)).alias("snapshot"))


def interval_overlap_open(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    pairs = intervals.overlap_join(o, o, ["o_custkey"], 30 * DAY).filter("a_o_orderkey < b_o_orderkey")
    return pairs.select("o_custkey", F.col("a_o_orderkey").alias("a"), F.col("b_o_orderkey").alias("b"), (F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).alias("overlap_us"))


def interval_overlap_closed(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    pairs = intervals.overlap_join(o, o, ["o_custkey"], 30 * DAY, closed=True).filter("a_o_orderkey < b_o_orderkey")
    return pairs.groupBy("o_custkey").agg(F.count("*").alias("n_pairs"))


def point_in_interval_owner(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    spans = _kind(e, "signup").select("user_id", F.col("event_id").alias("id"), F.col("us").alias("start"), (F.col("us") + 5 * DAY).alias("end"))
    return intervals.owner_join(_kind(e, "click"), spans, ["user_id"], 5 * DAY).select("event_id", F.col("span_id").alias("owner_id"))


def tolerance_band(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    band = (F.col("k") + 1) * HOUR
    pairs = intervals.band_join(_kind(e, "error"), _kind(e, "click"), ["user_id"], band, band, DAY)
    return pairs.select(F.col("a_event_id").alias("error_id"), F.col("b_event_id").alias("click_id"))


def adjacent_within_gap(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    ends = o.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("end").alias("us"))
    starts = o.select("o_custkey", F.col("o_orderkey").alias("id"), F.col("start").alias("us"))
    return intervals.band_join(ends, starts, ["o_custkey"], F.lit(0), F.lit(20 * DAY), 20 * DAY).select(F.col("a_id").alias("before_id"), F.col("b_id").alias("after_id"), ((F.col("b_us") - F.col("a_us")) / DAY).cast("long").alias("gap_days"))


def all_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    same = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, same).select(F.col("a.n_name").alias("first"), F.col("b.n_name").alias("second"))


def mutual_knn_ratio(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").filter("vec_id is not null and embedding is not null and label is not null")
    middle = F.lit(v.agg(F.median("label")).first()[0])
    v = v.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return matching.mutual_matches(v.filter(F.col("label") < middle), v.filter(F.col("label") >= middle), 0.98).select("a_id", "b_id", F.round("d", 5).alias("d"))


def shifted_range(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    base = e.groupBy("event_type").agg(F.min("us").alias("first"))
    offsets = base.withColumn("shift_us", F.length("event_type") * F.lit(HOUR)).drop("first")
    low, high = e.agg(F.min("us").alias("low")).select(F.col("low") + 10 * DAY, F.col("low") + 12 * DAY).first()
    shifted = e.join(F.broadcast(offsets), "event_type")  # a row for each of the event types
    return shifted.filter(F.col("us").between(F.lit(low) - F.col("shift_us"), F.lit(high) - F.col("shift_us"))).select("event_id", "event_type")


def full_outer_exact(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n_customers"))
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n_suppliers"))
    return customers.join(suppliers, "nation", "full_outer").select("nation", "n_customers", "n_suppliers", F.when(F.col("n_suppliers").isNull(), "left").when(F.col("n_customers").isNull(), "right").otherwise("both").alias("side"))


def semi_support(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    supported = e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).filter("n >= 4")
    return _kind(e, "purchase").join(supported, "user_id", "left_semi").select("event_id", "user_id")


def anti_unresolved(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n_unlabelled"))


def lineage_recursive(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("turn is not null and conv_id is not null")
    node = F.col("conv_id") * 100_000 + F.col("turn")
    edges = c.select(node.alias("child"), (node - 1).alias("parent"), "turn").filter("turn > 0").join(c.select(node.alias("parent")).distinct(), "parent", "left_semi").distinct()
    return graphs.ancestors(edges, "child", "parent", 8).groupBy("node").agg(F.max("distance").alias("depth"), F.min("ancestor").alias("root"))


def overlap_closure(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer that hang together by overlapping, directly or through others, named by the smallest order."""
    o = orders(spark, d)
    spans = intervals.closures(o, ["o_custkey"], "span").groupBy("o_custkey", "span")
    return spans.agg(F.min("o_orderkey").alias("group_id"), F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")).drop("o_custkey", "span")


def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    checks = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey")]
    counts = [editlog.orphans(table(spark, d, c), table(spark, d, p), ck, pk).agg(F.lit(f"{c}.{ck}").alias("reference"), F.count("*").alias("n_violations")) for c, ck, p, pk in checks]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


QUERIES = {f.__name__: f for f in (asof_backward, asof_forward, asof_nearest_tolerance, bracket_lerp, asof_gap_policy, interval_overlap_open, interval_overlap_closed, point_in_interval_owner, tolerance_band, adjacent_within_gap, all_pairs, mutual_knn_ratio, shifted_range, full_outer_exact, semi_support, anti_unresolved, lineage_recursive, overlap_closure, fk_violations)}

ORACLES = {
    "asof_backward": f"""WITH {EVENTS}
        SELECT l.event_id, l.user_id, r.event_id AS match_id, r.value AS match_value
        FROM (SELECT * FROM e WHERE event_type = 'purchase') l
        ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.us >= r.us""",
    "asof_forward": f"""WITH {EVENTS}
        SELECT l.event_id, l.user_id, r.event_id AS match_id, r.value AS match_value
        FROM (SELECT * FROM e WHERE event_type = 'purchase') l
        ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.us <= r.us""",
    "asof_nearest_tolerance": f"""WITH {EVENTS}, c AS (SELECT * FROM e WHERE event_type = 'click'), p AS (SELECT * FROM e WHERE event_type = 'purchase'),
        b AS (SELECT p.event_id, p.us, c.event_id AS id, c.us AS t FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.us),
        f AS (SELECT p.event_id, c.event_id AS id, c.us AS t FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us <= c.us),
        m AS (SELECT b.event_id, b.us, CASE WHEN f.t IS NULL OR b.us - b.t <= f.t - b.us THEN b.id ELSE f.id END AS id,
                     CASE WHEN f.t IS NULL OR b.us - b.t <= f.t - b.us THEN b.t ELSE f.t END AS t FROM b JOIN f USING (event_id))
        SELECT event_id, CASE WHEN abs(t - us) <= {12 * HOUR} THEN id END AS match_id, CASE WHEN abs(t - us) <= {12 * HOUR} THEN t - us END AS offset_us FROM m""",
    "bracket_lerp": f"""WITH {EVENTS}, c AS (SELECT * FROM e WHERE event_type = 'view'), p AS (SELECT * FROM e WHERE event_type = 'purchase'),
        b AS (SELECT p.event_id, p.us, c.value AS v, c.us AS t FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us >= c.us),
        f AS (SELECT p.event_id, c.value AS v, c.us AS t FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.us <= c.us),
        w AS (SELECT b.event_id, b.v AS a, f.v AS z, CASE WHEN f.t = b.t THEN 0.0 ELSE (b.us - b.t) / (f.t - b.t)::DOUBLE END AS w FROM b JOIN f USING (event_id))
        SELECT event_id, round(a * (1 - w) + z * w, 6) AS value_at, round(w, 6) AS weight FROM w""",
    "asof_gap_policy": f"""WITH {EVENTS}, v AS (SELECT * FROM e WHERE event_type = 'view'), p AS (SELECT * FROM e WHERE event_type = 'error'),
        x AS (SELECT user_id, min(us) AS low, max(us) AS high FROM v GROUP BY 1),
        b AS (SELECT p.event_id, p.user_id, p.us, v.us AS t FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.us >= v.us),
        f AS (SELECT p.event_id, v.us AS t FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.us <= v.us)
        SELECT b.event_id, CASE WHEN b.t IS NULL OR low IS NULL OR b.us < low OR b.us > high THEN 'outside_execution' WHEN b.t = b.us THEN 'native'
            WHEN f.t IS NULL OR f.t - b.t > {2 * DAY} THEN 'native_time_gap' ELSE 'native_snapshot' END AS snapshot
        FROM b JOIN f USING (event_id) LEFT JOIN x USING (user_id)""",
    "interval_overlap_open": f"""WITH {ORDERS}
        SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, least(a."end", b."end") - greatest(a.start, b.start) AS overlap_us
        FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.start < b."end" AND b.start < a."end" """,
    "interval_overlap_closed": f"""WITH {ORDERS}
        SELECT a.o_custkey, count(*) AS n_pairs
        FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.start <= b."end" AND b.start <= a."end" GROUP BY 1""",
    "point_in_interval_owner": f"""WITH {EVENTS}, s AS (SELECT user_id, event_id AS id, us AS start, us + {5 * DAY} AS stop FROM e WHERE event_type = 'signup')
        SELECT p.event_id, arg_max(s.id, s.start) AS owner_id
        FROM (SELECT * FROM e WHERE event_type = 'click') p LEFT JOIN s ON p.user_id = s.user_id AND s.start <= p.us AND p.us < s.stop GROUP BY 1""",
    "tolerance_band": f"""WITH {EVENTS}
        SELECT a.event_id AS error_id, b.event_id AS click_id FROM e a JOIN e b
        ON a.event_type = 'error' AND b.event_type = 'click' AND a.user_id = b.user_id AND abs(a.us - b.us) <= (a.k + 1) * {HOUR}""",
    "adjacent_within_gap": f"""WITH {ORDERS}
        SELECT a.o_orderkey AS before_id, b.o_orderkey AS after_id, CAST(floor((b.start - a."end") / {DAY}) AS BIGINT) AS gap_days
        FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.start - a."end" BETWEEN 0 AND {20 * DAY}""",
    "all_pairs": """SELECT a.n_name AS first, b.n_name AS second FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "mutual_knn_ratio": """WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL),
        m AS (SELECT median(label) AS middle FROM v),
        a AS (SELECT * FROM v, m WHERE label < middle), b AS (SELECT * FROM v, m WHERE label >= middle),
        p AS (SELECT a.id AS a_id, b.id AS b_id, list_distance(a.v, b.v) AS d FROM a, b),
        x AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d, b_id) AS ra, row_number() OVER (PARTITION BY b_id ORDER BY d, a_id) AS rb,
                     lead(d) OVER (PARTITION BY a_id ORDER BY d, b_id) AS na, lead(d) OVER (PARTITION BY b_id ORDER BY d, a_id) AS nb FROM p)
        SELECT a_id, b_id, round(d, 5) AS d FROM x WHERE ra = 1 AND rb = 1 AND (na IS NULL OR d < 0.98 * na) AND (nb IS NULL OR d < 0.98 * nb)""",
    "shifted_range": f"""WITH {EVENTS}, m AS (SELECT min(us) AS low FROM e)
        SELECT event_id, event_type FROM e, m WHERE us BETWEEN low + {10 * DAY} - length(event_type) * {HOUR} AND low + {12 * DAY} - length(event_type) * {HOUR}""",
    "full_outer_exact": """SELECT coalesce(c.n, s.n) AS nation, n_customers, n_suppliers, CASE WHEN s.n IS NULL THEN 'left' WHEN c.n IS NULL THEN 'right' ELSE 'both' END AS side
        FROM (SELECT c_nationkey AS n, count(*) AS n_customers FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS n, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON c.n = s.n""",
    "semi_support": f"""WITH {EVENTS} SELECT event_id, user_id FROM e WHERE event_type = 'purchase' AND user_id IN (SELECT user_id FROM e GROUP BY 1 HAVING count(DISTINCT event_type) >= 4)""",
    "anti_unresolved": """SELECT source, count(*) AS n_unlabelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY 1""",
    "lineage_recursive": """WITH RECURSIVE c AS (SELECT DISTINCT conv_id * 100000 + turn AS node, turn FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
        x AS (SELECT node AS c, node - 1 AS p FROM c WHERE turn > 0 AND node - 1 IN (SELECT node FROM c)),
        up(node, ancestor, distance) AS (SELECT c, p, 1 FROM x UNION ALL SELECT u.node, x.p, u.distance + 1 FROM up u JOIN x ON x.c = u.ancestor WHERE u.distance < 8)
        SELECT node, max(distance) AS depth, min(ancestor) AS root FROM up GROUP BY 1""",
    "overlap_closure": f"""WITH {ORDERS}, n AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY o_custkey ORDER BY start, "end", o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM o),
        g AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY start, "end", o_orderkey ROWS UNBOUNDED PRECEDING) AS span FROM n)
        SELECT min(o_orderkey) AS group_id, count(*) AS n, min(start) AS start, max("end") AS "end" FROM g GROUP BY o_custkey, span""",
    "fk_violations": " UNION ALL ".join(
        f"SELECT '{c}.{ck}' AS reference, count(*) AS n_violations FROM {c} t WHERE {ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} u WHERE u.{pk} = t.{ck})"
        for c, ck, p, pk in [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey")]
    ),
}
