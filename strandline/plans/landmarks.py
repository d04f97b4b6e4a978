"""Queries of gates, statistics, orders and geometry: users stand for recordings, event types for landmarks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import evidence, gates, geometry
from strandline.operators import graphs, ordering, statistics
from strandline.plans.base import DAY, EVENTS, HOUR, ORDERS, events, orders, table


def state():
    """The evidence state that an event type stands for."""
    return F.when(F.col("event_type") == "error", "unknown").when(F.col("event_type") == "signup", "interpolated").otherwise("observed")


def landmark_gate(spark: SparkSession, d: str) -> DataFrame:
    selected = F.when(F.col("k") % 7 > 0, F.col("user_id") % 3 > 0)
    usable = gates.landmark_usable(selected, F.col("value"), F.col("k"), state(), F.when(F.col("k") % 3 > 0, F.col("k") - 5), F.when(F.col("k") % 4 > 0, F.col("value") > 1))
    return events(spark, d).select("event_id", usable.alias("usable"))


def support_gate(spark: SparkSession, d: str) -> DataFrame:
    points = events(spark, d).groupBy("user_id", F.floor(F.col("us") / DAY).alias("day")).agg(F.collect_list("value").alias("points"))
    return points.select("user_id", "day", gates.supported(F.col("points"), lambda p: p < 60).alias("supported"))


def view_admission(spark: SparkSession, d: str) -> DataFrame:
    """Reasons against each event as a view of a landmark, its user's calibration and clock, and the noise of those admitted."""
    known = F.lit("observed")
    score = F.when(F.col("k") % 5 > 0, F.col("value") / 100)
    point = evidence.quality(state(), score, F.lit(0.0), F.array())
    clock = evidence.quality(F.when(F.col("user_id") % 11 > 0, known).otherwise("unknown"), F.col("k") / 100.0, F.lit(0.0), F.array())
    camera = F.when(F.col("user_id") % 7 > 0, evidence.quality(known, F.when(F.col("user_id") % 2 > 0, F.lit(0.04)), F.lit(0.0), F.array()))
    bracket = F.when(F.col("event_id") % 2 == 0, F.lit(0.1))
    e = events(spark, d).withColumns({"point": point, "clock": clock, "camera": camera})
    reasons = gates.view_reasons(F.col("k") != 13, F.col("value"), F.col("value"), F.col("point"), F.col("k") - 2, F.col("clock"), F.col("camera"), 0.05)
    sigma = gates.view_sigma(2.0, F.col("point.score"), F.lit(1.5), F.col("camera.score"), F.lit(0.02), F.col("clock.score"), 30.0, bracket)
    e = e.withColumn("reasons", reasons)
    return e.select("event_id", F.array_join("reasons", ",").alias("reasons"), F.round(F.when(F.size("reasons") == 0, sigma), 6).alias("sigma"))


def effective_frame(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    manual, auto = F.when(F.col("k") < 10, F.col("k") * 0.5), F.when(F.col("k") > 30, F.col("value") / 10)
    offset = gates.effective_offset(manual, auto, F.when(F.col("k") % 2 == 0, F.lit(0.25)), F.col("event_type") == "view", F.col("user_id") % 5 > 0)
    at = F.col("us") / 1e6 + F.col("offset")
    rows = e.withColumn("offset", offset).withColumn("seconds", at)
    return rows.select("event_id", F.round("offset", 6).alias("offset"), F.round("seconds", 3).alias("seconds"), gates.clock_consistent(F.col("us") / 1e6, F.col("offset"), F.col("seconds")).alias("consistent"))


def rational_pts(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", F.round(gates.rational_seconds(F.col("event_id"), F.lit(1001), F.col("k") * 1000), 9).alias("seconds"))


def movement_state(spark: SparkSession, d: str) -> DataFrame:
    """Whether each event moves, by its value as a linear and its k as an angular rate."""
    linear = evidence.quality(state(), F.lit(None).cast("double"), F.col("k") / 10.0, F.array("event_type"))
    angular = evidence.quality(F.lit("inferred"), F.lit(None).cast("double"), F.when(F.col("user_id") % 3 > 0, F.lit(1.0)), F.array("event_type"))
    found = gates.movement([(F.col("value"), linear, 40.0, 30.0), (F.col("k").cast("double"), angular, 80.0, 60.0)], 2.0)
    return events(spark, d).select("event_id", found.alias("state"))


def point_relations(spark: SparkSession, d: str) -> DataFrame:
    """Events as points beside the origin of a frame turned about its up axis."""
    e = events(spark, d).withColumns({"c": F.cos(F.col("user_id") / 7.0), "s": F.sin(F.col("user_id") / 7.0)})
    zero, one = F.lit(0.0), F.lit(1.0)
    axes = [[F.col("c"), F.col("s"), zero], [-F.col("s"), F.col("c"), zero], [zero, zero, one]]
    point = [F.col("value") - 20, F.when(F.col("k") > 4, F.col("k") - 50.0), F.col("value") - F.col("k")]
    found = gates.relations(point, [zero, zero, zero], axes, F.lit(1.0), F.when(F.col("event_type") != "error", F.lit(0.05)))
    named = F.array(*(F.struct(F.lit(axis).alias("axis"), value.alias("relation")) for axis, value in zip(gates.RELATIONS, found, strict=True)))
    return e.select("event_id", F.inline(named))


def detections_top_n(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("hour", F.floor(F.col("us") / HOUR))
    return ordering.top_n(rows, ["hour"], "value", "event_id", 3, (F.col("event_type") != "error") & (F.col("value") >= 5)).select("hour", "rank", "event_id")


def consensus_ranking(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("support"), F.round(F.avg("value"), 9).alias("cost"))
    return ordering.ranked(e, ["user_id"], F.desc("support"), F.asc("cost"), F.asc("event_type")).select("user_id", "event_type", "ordinal")


def canonical_order(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("day", F.floor(F.col("us") / DAY))
    return ordering.ranked(e, ["day"], F.asc("us"), F.asc("user_id"), F.asc("event_type"), F.asc("event_id")).select("event_id", "day", "ordinal")


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("hour", F.floor(F.col("us") / HOUR))
    return ordering.repeated_keys(e, ["user_id", "event_type", "hour"])


def first_seen_values(spark: SparkSession, d: str) -> DataFrame:
    return ordering.first_seen(events(spark, d), ["user_id"], "event_type", "us").select("user_id", "event_type", "place")


def truncated_evidence(spark: SparkSession, d: str) -> DataFrame:
    out = ordering.truncated(events(spark, d), ["event_type"], "k", 25)
    return out.select("event_type", F.array_join("values", ",").alias("values"), "truncated")


def frame_page(spark: SparkSession, d: str) -> DataFrame:
    e = ordering.ranked(events(spark, d), ["event_type"], F.asc("us"), F.asc("event_id"))
    return ordering.offset_page(e, "ordinal", 5, 12).select("event_type", "ordinal", "event_id")


def fresh_evidence(spark: SparkSession, d: str) -> DataFrame:
    return ordering.fresh_evidence(events(spark, d), ["user_id"], "us", "k").select("event_id", "fresh")


def evidence_speed(spark: SparkSession, d: str) -> DataFrame:
    out = ordering.speed_of_new_evidence(events(spark, d), ["user_id"], "us", "value", "event_type")
    return out.select("event_id", F.round(F.col("speed") * 3600, 6).alias("speed"))


def clock_gaps(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("until", F.col("us") + F.col("k") * 1_000_000)
    return ordering.clock_gaps(e, ["user_id"], "us", "until", F.col("k").cast("long") * 600_000_000, 2 * HOUR).select("user_id", "gap_start", "gap_end")


def sides_before(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).filter(F.col("event_type").isin("click", "view"))
    return ordering.neighbours_by_side(e, ["user_id"], "us", "event_type", ("click", "view"), "event_id").select("event_id", "same_side", "other_side")


def window_scan(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("start", F.when(F.col("o_custkey") % 5 > 0, F.col("start")))
    low = F.lit(820_454_400_000_000)
    return ordering.in_window(o, "start", "end", low, low + 30 * DAY).select("o_orderkey", "start", "end")


def shared_landmarks_near(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).groupBy("user_id", "event_type", (F.floor(F.col("us") / DAY) % 2).alias("half")).agg(F.avg("value").alias("x"), F.avg("k").alias("y")).withColumn("sigma", F.lit(2.5))
    return ordering.all_shared_near(e.filter("half = 0"), e.filter("half = 1"), ["user_id"], "event_type", ["x", "y"], "sigma", 12.0)


def channel_join(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("hour", F.floor(F.col("us") / HOUR))
    usable = e.filter((F.col("event_type") == "view") & (F.col("value") > 10))
    return ordering.channel_join(e.filter("event_type <> 'view'"), usable, ["user_id", "hour"]).select("event_id", "user_id", "hour")


def exact_clock_join(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("clock", F.floor(F.col("us") / (60 * 1_000_000)))
    motion = e.filter("event_type = 'click'").groupBy("clock").agg(F.count("*").alias("n_motion"))
    return e.filter("event_type = 'view'").join(motion, "clock", "left").select("event_id", "n_motion")


def landmark_cameras(spark: SparkSession, d: str) -> DataFrame:
    cameras = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("camera"), F.sha2(F.col("n_name").cast("binary"), 256).alias("calibration"))
    e = events(spark, d).withColumn("camera", F.col("k") % 30)
    return e.join(F.broadcast(cameras), "camera", "left").select("event_id", "camera", F.substring("calibration", 1, 8).alias("calibration"))  # at most as many rows as cameras


def set_relations(spark: SparkSession, d: str) -> DataFrame:
    kinds = events(spark, d).withColumn("day", F.floor(F.col("us") / (3 * DAY))).groupBy("user_id", "day").agg(F.collect_set("event_type").alias("now"))
    both = kinds.join(kinds.select("user_id", (F.col("day") + 1).alias("day"), F.col("now").alias("before")), ["user_id", "day"])
    return both.select("user_id", "day", ordering.set_relation(F.col("before"), F.col("now")).alias("relation"))


def emitted_events(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    evidence = e.select((F.col("event_id") - F.col("event_id") % 3).alias("event_id"), state().alias("state"))
    return ordering.emitted(e.filter("event_id % 3 = 0"), evidence, "event_id", "state").select("event_id", "user_id")


def scene_bounds(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    both = e.select("event_type", F.col("value").alias("x"), F.col("k").cast("double").alias("y")).unionByName(e.select("event_type", (F.col("k") - 3.0).alias("x"), F.col("value").alias("y")))
    return statistics.bounds(both, ["event_type"], ["x", "y"])


def recording_facts(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.recording_facts(events(spark, d), ["user_id"], "us", 0.5)
    return out.select("user_id", "n_frames", F.round(F.col("fps") * 1e6, 3).alias("fps"), "n_mismatch", F.array_join("examples", ",").alias("examples"))


def residual_quantiles(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.residual_quantiles(events(spark, d).withColumn("depth", F.col("k") - 10), ["user_id"], "value", "depth")
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in ("median", "p90", "worst", "positive_depth")))


def grid_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return statistics.occupancy(events(spark, d), ["user_id"], F.col("value") / 50, F.col("k") / 80.0)


def common_interval(spark: SparkSession, d: str) -> DataFrame:
    spans = events(spark, d).groupBy("user_id", "event_type").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    return statistics.common_interval(spans, ["user_id"], "low", "high")


def contributing_sources(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("day", F.floor(F.col("us") / DAY))
    out = statistics.contributing_sources(e, ["user_id", "day"], "event_type", (F.col("event_type") != "error") & (F.col("value") > 10))
    return out.select("user_id", "day", F.array_join("sources", ",").alias("sources"), "n_available")


def peak_first_wins(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("level", F.round("value", 0))
    return statistics.peak(e, ["user_id"], "us", "level").select("user_id", "us", "level")


def best_subset(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).groupBy("event_type", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.array_sort(F.collect_set("k")).alias("members"), F.round(F.avg("value"), 6).alias("score"))
    out = statistics.best_subset(e, ["event_type"], "members", "score")
    return out.select("event_type", F.array_join("members", ",").alias("members"), "score")


def time_bounds(spark: SparkSession, d: str) -> DataFrame:
    e = ordering.ranked(events(spark, d), ["event_type"], F.asc("us"), F.asc("event_id"))
    inside = F.when(F.col("k").between(20, 60), F.col("ordinal"))
    return e.groupBy("event_type").agg(F.min("us").alias("start"), F.max("us").alias("end"), F.min(inside).alias("low"), F.max(inside).alias("high"), F.count(inside).alias("n"))


def view_counts(spark: SparkSession, d: str) -> DataFrame:
    usable = (F.col("event_type") != "error") & (F.col("value") > 10)
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(usable).alias("n_usable"), F.array_join(F.array_sort(F.collect_set(F.when(~usable, F.col("event_type")))), ",").alias("reasons"))


def overlap_graph(spark: SparkSession, d: str) -> DataFrame:
    seen = events(spark, d).filter("event_type = 'purchase'").select("user_id", F.floor(F.col("us") / (HOUR // 4)).alias("slot")).distinct()
    first = seen.groupBy("slot").agg(F.min("user_id").alias("a"))
    edges = seen.join(first, "slot").filter(F.col("a") != F.col("user_id")).select("a", F.col("user_id").alias("b")).distinct()
    label = graphs.component_labels(edges)
    return statistics.reachable(edges, seen.select(F.col("user_id").alias("node")).distinct(), label)


def quaternion_matrix(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("value") / 20, F.col("k") / 15.0, F.col("event_id") / 7.0
    axis = [F.sin(b) * F.cos(c), F.sin(b) * F.sin(c), F.cos(b)]
    q = [F.cos(a / 2), *(F.sin(a / 2) * x for x in axis)]
    names = ("w", "x", "y", "z")
    rows = events(spark, d).select("event_id", *(x.alias(n) for x, n in zip(q, names, strict=True)))
    sign = F.when(F.col("w") < 0, -1.0).otherwise(1.0)
    m = geometry.quaternion_to_matrix(*(F.col(n) for n in names))
    rows = rows.select("event_id", *((F.col(n) * sign).alias(n) for n in names), *(x.alias(f"m{k}") for k, x in enumerate(m)))
    back = geometry.matrix_to_quaternion([F.col(f"m{k}") for k in range(9)])
    apart = sum((F.abs(F.col(n) - x) for n, x in zip(names, back, strict=True)), F.lit(0.0))
    return rows.select("event_id", F.round("m0", 6).alias("m0"), F.round("m5", 6).alias("m5"), F.round("m7", 6).alias("m7"), (apart < 1e-6).alias("same"))


def box_match(spark: SparkSession, d: str) -> DataFrame:
    """A box for each event, some of them empty, beside another one, with two torso points."""
    one = [F.lit(0.0), F.lit(0.0), F.col("value") + 1, F.col("k") + 1.0]
    other = [F.col("k") / 2.0, F.lit(1.0), F.col("k") + 5.0, F.col("value") - 3]
    torso = F.array(F.struct((F.col("k") / 100.0).alias("score"), F.col("value").alias("distance")), F.struct(F.lit(0.5).alias("score"), F.col("k").cast("double").alias("distance")))
    cost = geometry.match_cost(one, other, F.when(F.col("event_type") != "error", torso))
    return events(spark, d).select("event_id", F.round(geometry.box_area(*one), 6).alias("area"), F.round(cost, 6).alias("cost"))


def crop_maps(spark: SparkSession, d: str) -> DataFrame:
    crop = (F.lit(7.0), F.lit(3.0), F.lit(64.0), F.lit(48.0), (F.col("k") % 4) * 90, F.col("event_id") % 2 == 0, F.lit(1.5))
    e = events(spark, d)
    x, y = geometry.to_crop(F.col("value"), F.col("k").cast("double"), *crop)
    rows = e.withColumns({"x": x, "y": y})
    u, v = geometry.from_crop(F.col("x"), F.col("y"), *crop)
    return rows.select("event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), ((F.abs(u - F.col("value")) < 1e-9) & (F.abs(v - F.col("k")) < 1e-9)).alias("back"))


def midpoint_span(spark: SparkSession, d: str) -> DataFrame:
    middle, span = geometry.midpoint_span([F.col("value"), F.col("k").cast("double")], [F.lit(3.0), F.col("value") / 2])
    return events(spark, d).select("event_id", F.round(middle[0], 6).alias("x"), F.round(middle[1], 6).alias("y"), F.round(span, 6).alias("span"))


def view_hull(spark: SparkSession, d: str) -> DataFrame:
    """How much of its frame each user's events cover, as pixels of a frame of 128 by 128."""
    hulls = statistics.hull_area(events(spark, d), ["user_id"], F.col("k"), F.floor("value"))
    return hulls.select("user_id", "n_corners", F.round(F.col("area") / (128 * 128), 9).alias("hull_fraction"))


def pixel_rays(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as points, projected by a distorting camera and seen again."""
    v = table(spark, d, "embeddings").filter("embedding is not null and size(embedding) >= 3").withColumn("e", F.col("embedding").cast("array<double>"))
    c, s = math.cos(0.3), math.sin(0.3)
    pose = [c, -s, 0.0, 0.1, s, c, 0.0, -0.2, 0.0, 0.0, 1.0, 2.5, 0.0, 0.0, 0.0, 1.0]
    x, y, z = (sum((pose[4 * row + j] * F.col("e")[j] for j in range(3)), F.lit(pose[4 * row + 3])) for row in range(3))
    lens = F.array(*map(F.lit, (0.1, -0.05, 0.001, -0.002, 0.01)))
    pixel = geometry.projected(geometry.vector(x, y, z), F.lit(800.0), F.lit(820.0), F.lit(320.0), F.lit(240.0), lens)
    rows = v.withColumn("pixel", pixel).withColumn("bad", F.col("vec_id") % 10 == 0)
    wild = F.when(F.col("bad"), F.array(*map(F.lit, (-3.0, 0.0, 0.0, 0.0, 0.0)))).otherwise(lens)
    ray = geometry.pixel_ray(F.when(F.col("bad"), 5000.0).otherwise(F.col("pixel.x")), F.col("pixel.y"), F.lit(800.0), F.lit(820.0), F.lit(320.0), F.lit(240.0), wild, F.array(*map(F.lit, pose)))
    rows = rows.withColumn("ray", ray)
    return rows.select("vec_id", *(F.round(F.col(f"ray.{part}.{axis}"), 8).alias(f"{part}_{axis}") for part in ("centre", "direction") for axis in "xyz"))


QUERIES = {
    f.__name__: f
    for f in (landmark_gate, support_gate, view_admission, effective_frame, rational_pts, movement_state, point_relations, detections_top_n, consensus_ranking, canonical_order, duplicate_keys)
    + (first_seen_values, truncated_evidence, frame_page, fresh_evidence, evidence_speed, clock_gaps, sides_before, window_scan, shared_landmarks_near, channel_join, exact_clock_join, landmark_cameras)
    + (set_relations, emitted_events, scene_bounds, recording_facts, residual_quantiles, grid_occupancy, common_interval, contributing_sources, peak_first_wins, best_subset, time_bounds, view_counts)
    + (overlap_graph, quaternion_matrix, box_match, crop_maps, midpoint_span, view_hull, pixel_rays)
}

W = "(PARTITION BY user_id ORDER BY us)"
ORACLES = {
    "landmark_gate": f"""WITH {EVENTS} SELECT event_id, value IS NOT NULL AND k IS NOT NULL AND event_type NOT IN ('error', 'signup') AND NOT (k % 7 > 0 AND user_id % 3 = 0)
        AND NOT (k % 3 > 0 AND k <= 5) AND NOT (k % 4 > 0 AND value <= 1) AS usable FROM e""",
    "support_gate": f"WITH {EVENTS} SELECT user_id, us // {DAY} AS day, max(value) < 60 AS supported FROM e GROUP BY 1, 2",
    "view_admission": f"""WITH {EVENTS}, p AS (SELECT *, CASE WHEN k % 5 > 0 AND event_type <> 'error' THEN value / 100 END AS score, CASE WHEN user_id % 2 > 0 THEN 0.04::DOUBLE END AS cs FROM e),
        r AS (SELECT *, concat_ws(',', CASE WHEN k = 13 THEN 'unknown_time_join' END, CASE WHEN event_type = 'error' THEN 'unsupported_source_landmark' END,
            CASE WHEN event_type = 'error' OR score < 0.05 OR k <= 2 THEN 'insufficient_source_quality' END, CASE WHEN user_id % 11 = 0 OR k / 100.0::DOUBLE < 0.05 THEN 'insufficient_synchronization_quality' END,
            CASE WHEN user_id % 7 = 0 THEN 'missing_or_mismatched_calibration' WHEN cs < 0.05 THEN 'insufficient_calibration_quality' END) AS reasons FROM p)
        SELECT event_id, reasons, round(CASE WHEN reasons = '' THEN sqrt(4 / greatest(coalesce(score, 0.5), 0.05) + 2.25 / 0.5 + 0.36 / greatest(k / 100.0::DOUBLE, 0.05) + CASE WHEN event_id % 2 = 0 THEN 2.25 ELSE 0 END) END, 6) AS sigma FROM r""",
    "effective_frame": f"""WITH {EVENTS}, o AS (SELECT *, CASE WHEN k < 10 THEN k * 0.5::DOUBLE WHEN user_id % 5 = 0 THEN NULL WHEN k > 30 THEN value / 10 + CASE WHEN k % 2 = 0 THEN 0.25 ELSE 0 END WHEN event_type = 'view' THEN 0 END AS o FROM e)
        SELECT event_id, round(o, 6) AS "offset", round(us / 1e6 + o, 3) AS seconds, o IS NOT NULL AS consistent FROM o""",
    "rational_pts": f"WITH {EVENTS} SELECT event_id, round(CASE WHEN k <> 0 THEN event_id::DOUBLE * 1001 / (k * 1000) END, 9) AS seconds FROM e",
    "movement_state": f"""WITH {EVENTS}, q AS (SELECT *, event_type NOT IN ('error', 'signup') AND k <= 150 AND value IS NOT NULL AS a, user_id % 3 > 0 AS b FROM e)
        SELECT event_id, CASE WHEN a AND value >= 40 + k / 5.0::DOUBLE OR b AND k >= 82 THEN 'moving' WHEN a AND b AND value <= 30 - k / 5.0::DOUBLE AND k <= 58 THEN 'quiet' ELSE 'unknown' END AS state FROM q""",
    "point_relations": f"""WITH {EVENTS}, x AS (SELECT event_id, event_type, value - 20 AS a, CASE WHEN k > 4 THEN k - 50.0::DOUBLE END AS b, value - k AS u, user_id / 7.0::DOUBLE AS t FROM e),
        m AS (SELECT *, CASE WHEN event_type <> 'error' THEN 2 + 0.1::DOUBLE * sqrt(a * a + b * b + u * u) + 1e-6 END AS m FROM x),
        v AS (SELECT event_id, 'right' AS axis, a * cos(t) + b * sin(t) AS v, m, 'right_of' AS high, 'left_of' AS low FROM m UNION ALL SELECT event_id, 'front', b * cos(t) - a * sin(t), m, 'in_front_of', 'behind' FROM m
            UNION ALL SELECT event_id, 'up', u, m, 'above', 'below' FROM m)
        SELECT event_id, axis, CASE WHEN v > m THEN high WHEN v < -m THEN low ELSE 'unknown' END AS relation FROM v""",
    "detections_top_n": f"""WITH {EVENTS} SELECT us // {HOUR} AS hour, row_number() OVER (PARTITION BY us // {HOUR} ORDER BY value DESC, event_id)::INTEGER AS rank, event_id FROM e WHERE event_type <> 'error' AND value >= 5 QUALIFY rank <= 3""",
    "consensus_ranking": f"""WITH {EVENTS}, g AS (SELECT user_id, event_type, count(*) AS n, round(avg(value), 9) AS cost FROM e GROUP BY 1, 2)
        SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, cost, event_type) - 1 AS ordinal FROM g""",
    "canonical_order": f"WITH {EVENTS} SELECT event_id, us // {DAY} AS day, row_number() OVER (PARTITION BY us // {DAY} ORDER BY us, user_id, event_type, event_id) - 1 AS ordinal FROM e",
    "duplicate_keys": f"WITH {EVENTS} SELECT user_id, event_type, us // {HOUR} AS hour, count(*) AS n FROM e GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "first_seen_values": f"WITH {EVENTS}, f AS (SELECT user_id, event_type, min(us) AS t FROM e GROUP BY 1, 2) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY t, event_type)::INTEGER AS place FROM f",
    "truncated_evidence": f"""WITH {EVENTS}, x AS (SELECT DISTINCT event_type, k FROM e WHERE k IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY k) AS p FROM x)
        SELECT event_type, string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (p <= 25) AS "values", max(p) > 25 AS truncated FROM r GROUP BY 1""",
    "frame_page": f"""WITH {EVENTS}, r AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS ordinal, event_id FROM e) SELECT * FROM r WHERE ordinal BETWEEN 5 AND 16""",
    "fresh_evidence": f"WITH {EVENTS} SELECT event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY us) = 1 AS fresh FROM e",
    "evidence_speed": f"""WITH {EVENTS}, l AS (SELECT *, lag(us) OVER {W} AS t, lag(value) OVER {W} AS v, lag(event_type) OVER {W} AS s FROM e)
        SELECT event_id, round(CASE WHEN event_type <> s AND us > t THEN abs(value - v) / ((us - t) * 1e-6) * 3600 END, 6) AS speed FROM l""",
    "clock_gaps": f"""WITH {EVENTS}, l AS (SELECT *, lag(us + k * 1000000) OVER {W} AS t FROM e) SELECT user_id, t AS gap_start, us AS gap_end FROM l WHERE us - t > greatest(1500000000.0 * k, {2 * HOUR})""",
    "sides_before": f"""WITH {EVENTS}, s AS (SELECT *, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER p AS c, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER p AS v FROM e WHERE event_type IN ('click', 'view')
            WINDOW p AS (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT event_id, CASE event_type WHEN 'click' THEN c ELSE v END AS same_side, CASE event_type WHEN 'click' THEN v ELSE c END AS other_side FROM s""",
    "window_scan": f"""WITH {ORDERS}, n AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 THEN start END AS start, "end" FROM o)
        SELECT * FROM n WHERE start IS NULL OR start <= 820454400000000 + {30 * DAY} AND "end" >= 820454400000000""",
    "shared_landmarks_near": f"""WITH {EVENTS}, g AS (SELECT user_id, event_type, us // {DAY} % 2 AS half, avg(value) AS x, avg(k) AS y FROM e GROUP BY 1, 2, 3)
        SELECT a.user_id, count(*) AS n_shared, bool_and(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 17) AS near FROM g a JOIN g b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.half = 0 AND b.half = 1 GROUP BY 1""",
    "channel_join": f"""WITH {EVENTS} SELECT event_id, user_id, us // {HOUR} AS hour FROM e WHERE event_type <> 'view' AND (user_id, us // {HOUR}) IN (SELECT (user_id, us // {HOUR}) FROM e WHERE event_type = 'view' AND value > 10)""",
    "exact_clock_join": f"""WITH {EVENTS}, m AS (SELECT us // 60000000 AS clock, count(*) AS n_motion FROM e WHERE event_type = 'click' GROUP BY 1) SELECT event_id, n_motion FROM e LEFT JOIN m ON us // 60000000 = clock WHERE event_type = 'view'""",
    "landmark_cameras": f"""WITH {EVENTS} SELECT event_id, k % 30 AS camera, substr(sha256(n_name), 1, 8) AS calibration FROM e LEFT JOIN nation ON k % 30 = n_nationkey""",
    "set_relations": f"""WITH {EVENTS}, s AS (SELECT user_id, us // {3 * DAY} AS day, list_sort(list(DISTINCT event_type)) AS x FROM e GROUP BY 1, 2)
        SELECT n.user_id, n.day, CASE WHEN b.x = n.x THEN 'equal' WHEN list_has_all(n.x, b.x) THEN 'subset' WHEN list_has_all(b.x, n.x) THEN 'superset' WHEN list_has_any(n.x, b.x) THEN 'overlapping' ELSE 'disjoint' END AS relation
        FROM s n JOIN s b ON n.user_id = b.user_id AND n.day = b.day + 1""",
    "emitted_events": f"""WITH {EVENTS}, b AS (SELECT event_id - event_id % 3 AS event_id, bool_and(event_type NOT IN ('error', 'signup')) AS ok FROM e GROUP BY 1) SELECT event_id, user_id FROM e JOIN b USING (event_id) WHERE ok""",
    "scene_bounds": f"""WITH {EVENTS}, u AS (SELECT event_type, value AS x, k::DOUBLE AS y FROM e UNION ALL SELECT event_type, k - 3.0::DOUBLE, value FROM e) SELECT event_type, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM u GROUP BY 1""",
    "recording_facts": f"""WITH {EVENTS}, s AS (SELECT user_id, us, us - lag(us) OVER {W} AS step FROM e), m AS (SELECT user_id, count(*) AS n_frames, median(step) AS m FROM s GROUP BY 1),
        o AS (SELECT user_id, us, row_number() OVER {W} AS p FROM s JOIN m USING (user_id) WHERE abs(step - m) > 0.5 * m), c AS (SELECT user_id, count(*) AS n, string_agg(us::VARCHAR, ',' ORDER BY us) FILTER (p <= 5) AS x FROM o GROUP BY 1)
        SELECT user_id, n_frames, round(CASE WHEN m > 0 THEN 1e6 / m END * 1e6, 3) AS fps, coalesce(n, 0) AS n_mismatch, coalesce(x, '') AS examples FROM m LEFT JOIN c USING (user_id)""",
    "residual_quantiles": f"""WITH {EVENTS} SELECT user_id, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS worst, round(avg((k > 10)::INT), 6) AS positive_depth FROM e GROUP BY 1""",
    "grid_occupancy": f"""WITH {EVENTS} SELECT user_id, count(DISTINCT least(3, greatest(0, floor(value / 50 * 4))) * 4 + least(3, greatest(0, floor(k / 80.0::DOUBLE * 4)))) AS n_cells FROM e GROUP BY 1""",
    "common_interval": f"""WITH {EVENTS}, s AS (SELECT user_id, event_type, min(us) AS a, max(us) AS b FROM e GROUP BY 1, 2), c AS (SELECT user_id, max(a) AS a, min(b) AS b FROM s GROUP BY 1)
        SELECT user_id, CASE WHEN a <= b THEN a END AS start, CASE WHEN a <= b THEN b END AS "end" FROM c""",
    "contributing_sources": f"""WITH {EVENTS} SELECT user_id, us // {DAY} AS day, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (event_type <> 'error' AND value > 10), '') AS sources, count(DISTINCT event_type) AS n_available FROM e GROUP BY 1, 2""",
    "peak_first_wins": f"""WITH {EVENTS}, r AS (SELECT user_id, us, round(value, 0) AS level FROM e) SELECT user_id, us, level FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY level DESC, us) = 1""",
    "best_subset": f"""WITH {EVENTS}, s AS (SELECT event_type, us // {HOUR} AS hour, list_sort(list(DISTINCT k)) AS m, round(avg(value), 6) AS score FROM e GROUP BY 1, 2),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY len(m) DESC, score DESC, m) = 1) SELECT event_type, array_to_string(m, ',') AS members, score FROM b""",
    "time_bounds": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1 AS o FROM e)
        SELECT event_type, min(us) AS start, max(us) AS "end", min(o) FILTER (k BETWEEN 20 AND 60) AS low, max(o) FILTER (k BETWEEN 20 AND 60) AS high, count(*) FILTER (k BETWEEN 20 AND 60) AS n FROM r GROUP BY 1""",
    "view_counts": f"""WITH {EVENTS}, u AS (SELECT *, event_type <> 'error' AND value > 10 AS ok FROM e) SELECT user_id, count(*) AS n, count(*) FILTER (ok) AS n_usable, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (NOT ok), '') AS reasons FROM u GROUP BY 1""",
    "overlap_graph": f"""WITH RECURSIVE {EVENTS}, s AS (SELECT DISTINCT user_id, us // {HOUR // 4} AS slot FROM e WHERE event_type = 'purchase'), f AS (SELECT slot, min(user_id) AS a FROM s GROUP BY 1),
        g AS (SELECT DISTINCT a, user_id AS b FROM s JOIN f USING (slot) WHERE a <> user_id), h AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
        c(node, seen) AS (SELECT DISTINCT user_id, user_id FROM s UNION SELECT h.b, c.seen FROM c JOIN h ON c.node = h.a), m AS (SELECT node, min(seen) AS low FROM c GROUP BY 1)
        SELECT count(DISTINCT low) AS n_components, count(DISTINCT low) <= 1 AS connected FROM m""",
    "quaternion_matrix": f"""WITH {EVENTS}, a AS (SELECT event_id, value / 20 AS a, k / 15.0::DOUBLE AS b, event_id / 7.0::DOUBLE AS c FROM e), u AS (SELECT event_id, a, sin(b) * cos(c) AS x, sin(b) * sin(c) AS y, cos(b) AS z FROM a)
        SELECT event_id, round(cos(a) + x * x * (1 - cos(a)), 6) AS m0, round(y * z * (1 - cos(a)) - x * sin(a), 6) AS m5, round(y * z * (1 - cos(a)) + x * sin(a), 6) AS m7, true AS same FROM u""",
    "box_match": f"""WITH {EVENTS}, b AS (SELECT *, (value + 1) * (k + 1) AS old, greatest(k / 2.0::DOUBLE + 5, 0) * greatest(value - 4, 0) AS new FROM e),
        c AS (SELECT *, greatest(sqrt(old), 1) AS scale, sqrt(((value + 1) / 2 - (1.5 * k + 5) / 2) ** 2 + ((k + 1) / 2.0::DOUBLE - (value - 2) / 2) ** 2) / greatest(sqrt(old), 1) AS centre FROM b)
        SELECT event_id, round(old, 6) AS area, round(0.45 * centre + 0.35 * CASE WHEN event_type = 'error' THEN centre WHEN k >= 20 THEN (value + k) / 2 / scale ELSE k / scale END + 0.2 * abs(ln(greatest(new, 1) / greatest(old, 1))), 6) AS cost FROM c""",
    "crop_maps": f"""WITH {EVENTS}, u AS (SELECT event_id, value - 7 AS u, k - 3.0::DOUBLE AS v, k % 4 AS t FROM e),
        a AS (SELECT event_id, CASE t WHEN 1 THEN 48 - v WHEN 2 THEN 64 - u WHEN 3 THEN v ELSE u END AS x, CASE t WHEN 1 THEN u WHEN 2 THEN 48 - v WHEN 3 THEN 64 - u ELSE v END AS y, CASE WHEN t IN (1, 3) THEN 48 ELSE 64 END AS w FROM u)
        SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN w - x ELSE x END * 1.5, 6) AS x, round(y * 1.5, 6) AS y, true AS back FROM a""",
    "midpoint_span": f"WITH {EVENTS} SELECT event_id, round((value + 3) / 2, 6) AS x, round((k + value / 2) / 2, 6) AS y, round(sqrt((value - 3) ** 2 + (k - value / 2) ** 2), 6) AS span FROM e",
    "view_hull": f"""WITH {EVENTS}, p AS (SELECT DISTINCT user_id, k::DOUBLE AS x, floor(value) AS y FROM e WHERE k IS NOT NULL AND value IS NOT NULL),
        s AS (SELECT a.user_id, a.x, a.y, b.x AS u, b.y AS v,
                bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0) AS edge
              FROM p a JOIN p b ON a.user_id = b.user_id AND (a.x <> b.x OR a.y <> b.y) JOIN p c ON c.user_id = a.user_id GROUP BY ALL),
        h AS (SELECT user_id, count(*) AS n, sum(x * v - y * u) / 2 AS area FROM s WHERE edge GROUP BY 1)
        SELECT user_id, coalesce(n, 1) AS n_corners, round(coalesce(area, 0) / (128 * 128), 9) AS hull_fraction FROM (SELECT DISTINCT user_id FROM p) LEFT JOIN h USING (user_id)""",
    "pixel_rays": """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, cos(0.3) AS c, sin(0.3) AS s FROM embeddings WHERE len(embedding) >= 3),
        o AS (SELECT *, -(c * 0.1 - s * 0.2) AS a, s * 0.1 + c * 0.2 AS b, -2.5::DOUBLE AS d, vec_id % 10 <> 0 AS ok FROM p),
        r AS (SELECT *, sqrt((x - a) ** 2 + (y - b) ** 2 + (z - d) ** 2) AS n FROM o)
        SELECT vec_id, round(CASE WHEN ok THEN a END, 8) AS centre_x, round(CASE WHEN ok THEN b END, 8) AS centre_y, round(CASE WHEN ok THEN d END, 8) AS centre_z,
            round(CASE WHEN ok THEN (x - a) / n END, 8) + 0.0 AS direction_x, round(CASE WHEN ok THEN (y - b) / n END, 8) + 0.0 AS direction_y, round(CASE WHEN ok THEN (z - d) / n END, 8) + 0.0 AS direction_z FROM r""",
}
