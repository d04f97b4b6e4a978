"""Body geometry and segments on small cases whose results are known."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandline.functions import body
from strandline.operators import recordings, segmentation


def at(x, y, z, sigma=0.0, usable=True):
    return body.point(*map(F.lit, (float(x), float(y), float(z), sigma, usable)))


def told(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_body_axes_are_right_front_up(spark):
    f = told(spark, body.body_axes(at(-1, 0, 0), at(1, 0, 0), at(-1, 0, 3), at(1, 0, 3)))
    assert [tuple(f[k]) for k in "xyz"] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def test_geometry_is_null_without_evidence(spark):
    assert told(spark, body.axis(at(0, 0, 0), at(0, 0, 0))) is None
    assert told(spark, body.axis(at(0, 0, 0, 0.2), at(1, 0, 0, 0.1))) is None
    assert told(spark, body.bend(at(0, 0, 0, usable=False), at(1, 0, 0), at(2, 0, 0))) is None
    assert told(spark, body.axes(body.vector(*map(F.lit, (1.0, 0.0, 0.0))), body.vector(*map(F.lit, (2.0, 0.1, 0.0))), F.lit(0.0))) is None


def test_bend_of_a_right_angle(spark):
    assert math.isclose(told(spark, body.bend(at(0, 0, 0), at(1, 0, 0), at(1, 1, 0)))["angle"], math.pi / 2)


def test_crossed_forearms_tell_which_is_in_front(spark):
    frame = body.body_axes(at(-1, 0, 0), at(1, 0, 0), at(-1, 0, 3), at(1, 0, 3))
    crossed = told(spark, body.crossing(frame, at(-1, 1, 1), at(1, 1, 2), at(1, 0.5, 1), at(-1, 0.5, 2)))
    apart = told(spark, body.crossing(frame, at(-1, 1, 1), at(-1, 1, 2), at(1, 0.5, 1), at(1.5, 0.5, 2)))
    unknown = told(spark, body.crossing(frame, at(-1, 1, 1, usable=False), at(1, 1, 2), at(1, 0.5, 1), at(-1, 0.5, 2)))
    assert tuple(crossed) == ("crossed", "left_forearm")
    assert tuple(apart) == ("not_crossed", None)
    assert tuple(unknown) == ("unknown", None)


def test_spans_end_at_gaps_unknown_states_and_long_rests(spark):
    rows = [(0, 1), (1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (7, 0), (8, 1), (9, 1), (10, None), (11, 1), (12, 1), (30, 1), (32, 1)]
    df = spark.createDataFrame([("a", t, s) for t, s in rows], "k string, t long, s int")
    found = segmentation.activity_spans(df, ["k"], "t", "s", 5, 3, 1).orderBy("start").collect()
    assert [(r["start"], r["end"], r["n"]) for r in found] == [(0, 3, 3), (8, 9, 2), (11, 12, 2), (30, 32, 2)]
    assert segmentation.activity_spans(df.limit(0), ["k"], "t", "s", 5, 3, 1).count() == 0


def executed(spark, rows):
    schema = "k string, t long, busy boolean, quiet boolean, covered boolean, track string, open boolean"
    df = spark.createDataFrame([("a", *r) for r in rows], schema)
    limits = {"gap": 2, "least": 2, "tracks": 2, "hold": 3, "edge": 2, "step_quiet": 3, "coverage": 0.8, "unknown": 3}
    return [tuple(r)[1:5] for r in segmentation.executions(df, ["k"], "t", "busy", "quiet", "covered", "track", ["open"], **limits).orderBy("step").collect()]


def test_an_execution_is_cut_at_coordinated_rests(spark):
    busy = {4, 5, 6, 11, 12, 13}
    rows = [(t, t in busy, t not in busy, True, "arm" if t % 2 else "leg", None) for t in range(20)]
    assert executed(spark, rows) == [("segmented", 0, 4, 11), ("segmented", 1, 11, 16)]
    lifted = [(*r[:5], True if r[0] == 6 else None) for r in rows]
    assert executed(spark, lifted) == [("segmented", 0, 4, 16)]
    assert executed(spark, [r for r in rows if r[0] < 15]) == [("terminal_hold_or_post_roll_not_observed", None, None, None)]
    assert executed(spark, [r for r in rows if r[0] > 3]) == [("pre_roll_not_observed", None, None, None)]
    assert executed(spark, [(r[0], False, True, True, "arm", None) for r in rows]) == [("no_sustained_activity", None, None, None)]
    assert executed(spark, [r for r in rows if r[0] not in (8, 9)]) == [("native_sampling_gap", None, None, None)]


def test_increase_needs_known_rows(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 0.1), ("a", 1, 5.0, 0.1), ("b", 0, 1.0, 0.1), ("b", 1, None, 0.1), ("b", 2, 9.0, 0.1)], "k string, t long, v double, s double")
    assert dict(segmentation.proven_increase(df, ["k"], "t", "v", "s", 2.0, 3.0).collect()) == {"a": 1, "b": None}


def test_optimistic_revisions(spark):
    df = spark.createDataFrame([("a", t, e) for t, e in enumerate((0, 0, 1, 3, 2))], "k string, t long, e int")
    found = recordings.accepted_revisions(df, ["k"], "t", "e").orderBy("t").collect()
    assert [r["revision"] for r in found] == [1, None, 2, None, 3]


def test_a_single_source_is_too_few(spark):
    one = spark.createDataFrame([("cam", "x")], "camera string, digest string")
    assert [tuple(r) for r in recordings.ingest_violations(one, "camera", "digest").collect()] == [("too_few_sources", None, 1)]
