"""Machines with carried state: the same results however keys are cut, and planted contacts, turns, bouts and placements."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import evidence, gates, geometry
from strandline.operators import carried, feet

MS = 1000
PARTS = {p: (f"{p}_h", f"{p}_s", f"{p}_from") for p in feet.PARTS}
SAMPLES = "foot string, t long, id long, " + ", ".join(f"{p}_h double, {p}_s double, {p}_from array<string>" for p in feet.PARTS)


def samples(heights, step=20 * MS, sigma=0.0001, sources=lambda i, part: [f"s{i}"]):
    """A sample for each (heel, forefoot, outer), or for one height of all three."""
    rows = []
    for i, h in enumerate(heights):
        of_part = h if isinstance(h, tuple) else (h, h, h)
        rows.append(("left", i * step, i, *(x for part, y in zip(feet.PARTS, of_part, strict=True) for x in (y, sigma, sources(i, part)))))
    return rows


def told(spark, rows, span=10_000 * MS, config=None):
    out = feet.contacts(spark.createDataFrame(rows, SAMPLES), ["foot"], "t", "id", PARTS, config, span)
    return out.orderBy("id").collect()


def test_contact_needs_its_dwell_and_brackets_the_change(spark):
    rows = samples([0.01] * 8 + [0.2] * 5)
    found = told(spark, rows)
    assert [r.state for r in found] == ["unknown"] * 5 + ["contact"] * 3 + ["unknown"] * 2 + ["no_contact"] * 3
    assert found[0].reasons == ["insufficient_or_ambiguous_foot_evidence", "motion_unavailable"]
    assert found[4].reasons[-1] == "temporal_confirmation_pending" and found[5].region == "flat"
    assert (found[5].bracket_from, found[5].bracket_to, found[5].times) == (0, 20 * MS, [k * 20 * MS for k in range(1, 6)])
    assert found[5].source_ids == sorted(f"s{i}" for i in range(6)) and found[10].bracket_from == 7 * 20 * MS


def test_thresholds_widen_while_a_state_holds_and_regions_are_told(spark):
    heights = [0.01] * 7 + [0.04] * 3 + [(0.01, 0.2, 0.2)] * 5
    found = told(spark, samples(heights, step=40 * MS))
    assert [r.state for r in found[3:7]] == ["contact"] * 4
    assert [r.state for r in found[7:10]] == ["unknown", "unknown", "unknown"]  # the rise itself is too fast, and 0.04 is above enter then
    assert found[14].region == "heel"
    slow = told(spark, samples([0.01] * 7 + [0.015, 0.02, 0.025, 0.03, 0.035, 0.04, 0.045], step=40 * MS))
    assert {r.state for r in slow[3:]} == {"contact"}


def test_repeated_evidence_gaps_and_missing_points_prove_nothing(spark):
    stale = told(spark, samples([0.01] * 12, sources=lambda i, part: ["one"]))
    assert {r.state for r in stale} == {"unknown"} and "no_new_native_evidence" in stale[3].reasons
    rows = samples([0.01] * 8 + [(None, None, 0.01)] + [0.01] * 8)
    found = told(spark, rows)
    assert [r.state for r in found[5:10]] == ["contact", "contact", "contact", "unknown", "unknown"]
    late = [(f, t + (500 * MS if i > 7 else 0), i, *rest) for f, t, i, *rest in samples([0.01] * 16)]
    found = told(spark, late)
    assert "temporal_gap" in found[8].reasons and found[8].state == "unknown" and found[13].state == "contact"
    uncertain = told(spark, samples([0.01] * 12, sigma=0.02))
    assert {r.state for r in uncertain} == {"unknown"}


def test_results_do_not_depend_on_the_buckets(spark):
    heights = [0.01 + 0.04 * math.sin(i / 5) ** 2 for i in range(300)]
    rows = samples(heights)
    assert told(spark, rows, 60 * MS) == told(spark, rows)


def test_a_machine_that_never_forgets_is_walked_in_turn(spark):
    def step(state, emit, time, value):
        state["sum"] += value
        emit((time, state["sum"]))

    df = spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1, 5), (0, None, 9)], "k long, t long, v int"))
    for rounds in (0, 1, 1000):
        out = carried.carried(df, ["k"], "t", 10, ["v"], {"sum": 0}, step, "t long, total long", lambda state, emit: emit((-1, state["sum"])), rounds)
        found = {(r.k, r.t): r.total for r in out.collect()}
        assert len(found) == 204 and found[None, -1] == 5 and found[0, -1] == found[1, -1] == 100 and found[1, 199] == 100 and found[0, 100] == 51
    assert carried.carried(df.limit(0), ["k"], "t", 10, ["v"], {"sum": 0}, step, "t long, total long").collect() == []


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(3000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        out = carried.carried(df, ["k"], "t", 100, ["v"], {}, lambda state, emit, time, v: emit((time,)), "t long")
        assert out.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1 and out.count() == 3000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_configs_refuse_thresholds_out_of_order():
    for build in (lambda: feet.ContactConfig(enter_height=0.1), lambda: feet.PivotConfig(enter_speed=0.05), lambda: feet.PlacementConfig(leave_angle=0.01), lambda: feet.BoutConfig(1.0, 2.0, 1, 1.0, 1)):
        with pytest.raises(ValueError):
            build()


def test_turns_are_unwrapped_and_end_with_their_last_motion(spark):
    yaw = [3.0] * 5 + [3.0 + 0.1 * k for k in range(1, 11)] + [4.0] * 8
    rows = [("left", i * 20 * MS, math.atan2(math.sin(y), math.cos(y)), 0.001, True, [[f"h{i}"], [f"f{i}"]]) for i, y in enumerate(yaw)]
    schema = "foot string, t long, yaw double, sigma double, held boolean, sources array<array<string>>"

    def turns(rows):
        return feet.pivots(spark.createDataFrame(rows, schema), ["foot"], "t", "yaw", "sigma", "held", "sources", span=100 * MS).collect()

    (turn,) = turns(rows)
    assert (turn.start, turn.end, turn.n) == (4 * 20 * MS, 14 * 20 * MS, 11) and turn.turned == pytest.approx(1.0)
    assert turns([(*r[:4], False, r[5]) for r in rows]) == [] and turns([(*r[:5], [["h"], ["f"]]) for r in rows]) == []
    assert turns([(*r[:3], 0.3, *r[4:]) for r in rows]) == []  # uncertain beyond the excursion
    half = [("left", i * 20 * MS, y, 0.001, True, [[f"h{i}"], [f"f{i}"]]) for i, y in enumerate([0.0, math.pi - 0.01, 0.0])]
    assert turns(half) == []


def test_bouts_lie_between_quiet_times(spark):
    place = [0.0] * 10 + [0.02 * k for k in range(1, 11)] + [0.2] * 10
    rows = [("left", i * 20 * MS, [x, 0.0], 0.001, abs(x - place[max(0, i - 1)]) / 0.02, 0.01) for i, x in enumerate(place)]
    df = spark.createDataFrame(rows, "k string, t long, p array<double>, s double, v double, vs double")
    config = feet.BoutConfig(0.5, 0.2, 60 * MS, 0.05, 100 * MS)
    (bout,) = feet.motion_bouts(df, ["k"], "t", "p", "s", "v", "vs", config, span=80 * MS).collect()
    assert (bout.start, bout.end) == (9 * 20 * MS, 23 * 20 * MS) and bout.excursion == pytest.approx(0.2)
    assert feet.motion_bouts(df.filter("t < 300000"), ["k"], "t", "p", "s", "v", "vs", config).collect() == []  # no quiet time after it


def test_placements_are_stable_or_moving(spark):
    place = [0.0] * 10 + [0.05 * k for k in range(1, 6)] + [0.25] * 10

    def found(sigma=0.0005, fresh=True):
        rows = [("left", i * 20 * MS, True, [("heel", x, 0.0, sigma), ("forefoot", x + 0.2, 0.0, sigma)], 0.0, 0.001, [[f"h{i if fresh else 0}"], [f"f{i}"]]) for i, x in enumerate(place)]
        df = spark.createDataFrame(rows, "k string, t long, c boolean, p array<struct<name: string, x: double, y: double, sigma: double>>, yaw double, ys double, src array<array<string>>")
        return feet.foot_placements(df, ["k"], "t", "c", "p", "yaw", "ys", "src", span=70 * MS).orderBy("start").collect()

    stable, moving, again = found()
    assert [(r.kind, r.start, r.end) for r in (stable, moving, again)] == [("stable", 0, 180 * MS), ("moving", 200 * MS, 260 * MS), ("stable", 280 * MS, 480 * MS)]
    assert stable.confirmed == 120 * MS and stable.spread == pytest.approx(0.0005) and moving.yaw is None
    assert [r.kind for r in found(sigma=0.01)] == ["moving"] and found(fresh=False) == []


def quality(state="inferred", sigma=0.0, score=None):
    return evidence.quality(F.lit(state), F.lit(score).cast("double"), F.lit(sigma).cast("double"), F.array(F.lit("s")))


def test_gates_take_what_the_contract_takes(spark):
    """Expected values worked out by hand."""
    one = spark.range(1)
    null = F.lit(None)

    def value(column):
        return one.select(column.alias("x")).first().x

    assert value(gates.landmark_usable(null.cast("boolean"), F.lit(1.0), F.lit(1.0), F.lit("observed"), null.cast("double"), null.cast("boolean"))) is True
    assert value(gates.landmark_usable(F.lit(False), F.lit(1.0), F.lit(1.0), F.lit("observed"), F.lit(1.0), F.lit(True))) is False
    assert value(gates.landmark_usable(F.lit(True), F.lit(1.0), null, F.lit("observed"), F.lit(1.0), F.lit(True))) is False
    offset = lambda *x: value(gates.effective_offset(*(F.lit(v) for v in x)))
    assert offset(None, None, 0.25, True, True) == 0.0 and offset(None, 1.0, 0.25, True, True) == 1.25
    assert offset(None, 1.0, None, False, False) is None and offset(3.0, 1.0, 0.5, False, False) == 3.0 and offset(None, None, None, False, True) is None
    moves = lambda v, s: value(gates.movement([(F.lit(v), quality(sigma=s), 2.0, 1.0)], 2.0))
    assert [moves(2.0, 0.0), moves(1.5, 0.0), moves(1.0, 0.0), moves(2.0, 0.1), moves(0.9, 0.1), moves(0.1, 0.6)] == ["moving", "unknown", "quiet", "unknown", "unknown", "unknown"]
    assert value(gates.movement([(F.lit(9.0), quality("interpolated"), 2.0, 1.0)], 2.0)) == "unknown"
    axes = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    beside = lambda x, s=0.0, f=0.0: [value(c) for c in gates.relations([F.lit(x), F.lit(0.0), F.lit(-1.0)], [F.lit(0.0)] * 3, axes, F.lit(s), F.lit(f))]
    assert beside(1.0) == ["right_of", "unknown", "below"] and beside(-1.0, 0.5) == ["unknown"] * 3 and beside(1.0, 0.0, 0.2) == ["right_of", "unknown", "below"]
    box = lambda *x: [F.lit(float(v)) for v in x]
    no_torso = F.array().cast("array<struct<score: double, distance: double>>")
    assert value(geometry.match_cost(box(0, 0, 4, 4), box(2, 0, 6, 4), no_torso)) == pytest.approx(0.8 * 0.5)
    torso = F.array(F.struct(F.lit(0.9).alias("score"), F.lit(4.0).alias("distance")), F.struct(F.lit(0.1).alias("score"), F.lit(99.0).alias("distance")))
    assert value(geometry.match_cost(box(0, 0, 4, 4), box(0, 0, 4, 4), torso)) == pytest.approx(0.35)
    assert value(geometry.match_cost(box(0, 0, 2, 2), box(5, 5, 1, 1), no_torso)) == pytest.approx(0.8 * math.hypot(2, 2) / 2 + 0.2 * math.log(4))
    views = gates.view_reasons(F.lit(True), F.lit(1.0), F.lit(1.0), quality("observed"), null.cast("double"), quality(), null.cast("struct<state: string, score: double>"), 0.2)
    assert value(views) == ["missing_or_mismatched_calibration"]
    assert value(gates.view_reasons(F.lit(None), null, F.lit(1.0), quality("observed", score=0.1), F.lit(0.0), quality("unknown"), quality(score=0.1), 0.2)) == ["unknown_time_join", "unsupported_source_landmark", "insufficient_source_quality", "insufficient_synchronization_quality", "insufficient_calibration_quality"]
