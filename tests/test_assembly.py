"""Extents over connected actions, tiles and owners, edits that hold whole or not at all, series rules, peaks and reversals."""

from __future__ import annotations

import random
import time

import numpy as np

from strandline.operators import assembly, constraints, machines

SPANS = "k string, id long, before long, start long, end long"


def test_an_execution_grows_over_overlaps_and_links_until_it_stands_still(spark):
    executions = spark.createDataFrame([("a", 10, 20), ("b", 10, 20), ("c", 5, 6)], "k string, start long, end long")
    actions = [("a", 1, None, 18, 25), ("a", 2, 1, 40, 45), ("a", 3, None, 44, 60), ("a", 4, None, 60, 70), ("a", 5, 99, 80, 90), ("b", 1, None, 20, 30), ("b", 2, 3, 12, 13), ("b", 3, None, 0, 1)]
    found, chosen = assembly.extended(executions, spark.createDataFrame(actions, SPANS), ["k"], "id", "before")
    assert sorted(map(tuple, found.collect())) == [("a", 10, 60, True), ("b", 0, 20, True), ("c", 5, 6, False)]
    assert sorted(map(tuple, chosen.collect())) == [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 3)]


def test_steps_tile_what_an_execution_reaches_and_own_what_starts_in_them(spark):
    steps = spark.createDataFrame([("a", 1, 10, 15), ("a", 2, 15, 20)], "k string, step long, start long, end long")
    tiled = assembly.retiled(steps, spark.createDataFrame([("a", 4, 60)], "k string, start long, end long"), ["k"])
    assert sorted(map(tuple, tiled.collect())) == [("a", 1, 4, 15), ("a", 2, 15, 60)]
    actions = spark.createDataFrame([("a", 1, None, 14, 16), ("a", 2, None, 15, 15), ("a", 3, None, 60, 61)], SPANS)
    pairs = assembly.step_actions(tiled, actions, ["k"], "step", "id")
    assert sorted(map(tuple, pairs.collect())) == [("a", 1, 1, True), ("a", 2, 1, False), ("a", 2, 2, True)]


def edits(spark, *batches):
    views = spark.createDataFrame([("a", "x", 0, 40, 0, 30, [("s", 0, 10), ("t", 10, 30)], [("f", 5)])], "k string, id string, clock_from long, clock_to long, start long, end long, steps array<struct<name: string, start: long, end: long>>, frames array<struct<name: string, at: long>>")
    log = spark.createDataFrame([("a", n, b) for n, b in enumerate(batches, 1)], "k string, revision long, operations array<struct<kind: string, target: string, start: long, end: long>>")
    told, view = assembly.edited(views, log, ["k"], 3)
    return [r.reason for r in told.orderBy("revision").collect()], {(r.kind, r["name"]): (r.start, r.end) for r in view.collect()}


def test_batches_of_edits_hold_whole_or_not_at_all(spark):
    both = [("boundary", "s", 0, 12), ("boundary", "t", 12, 30)]
    reasons, view = edits(spark, both, [("boundary", "s", 0, 15)], [("boundary", "t", 12, 28)], [("boundary", "x", 0, 35), ("boundary", "t", 12, 35)], [("boundary", "u", 0, 1)], [("boundary", "s", 5, 5)])
    assert reasons == [None, assembly.NOT_TILED, assembly.NOT_COVERED, None, assembly.UNKNOWN_STEP, assembly.EMPTY]
    assert view == {("execution", "x"): (0, 35), ("step", "s"): (0, 12), ("step", "t"): (12, 35), ("frame", "f"): (5, 5)}


def test_keyframes_are_added_moved_and_removed(spark):
    reasons, view = edits(
        spark, [("add", "g", 8, None)], [("add", "g", 9, None)], [("move", "f", 6, None)], [("move", "h", 6, None)], [("remove", "g", None, None), ("move", "f", 50, None)], [("remove", "g", None, None)], [("move", "g", 1, None)], [("add", "", 1, None)]
    )
    assert reasons == [None, assembly.REPEATED_FRAME, None, assembly.UNKNOWN_FRAME, assembly.OFF_CLOCK, None, assembly.UNKNOWN_FRAME, assembly.REPEATED_FRAME]
    assert view["frame", "f"] == (6, 6) and ("frame", "g") not in view


def test_each_rule_finds_its_planted_violation_and_nothing_else(spark):
    executions = spark.createDataFrame([("a", 0, 30)], "k string, start long, end long")
    clean = [("a", 1, 0, 10), ("a", 2, 10, 30)]
    children = [("a", 7, 1, 2, 4), ("a", 8, 2, 10, 30)]

    def found(steps=clean, children=children, index=(1, 2, 3), times=(1, 2, 3), other=(1, 2, 3), executions=executions):
        steps = spark.createDataFrame(steps, "k string, step long, start long, end long")
        children = spark.createDataFrame(children, "k string, id long, step long, start long, end long")
        series = lambda name, values: spark.createDataFrame([("a", v) for v in values], f"k string, {name} long")
        rules = [constraints.tiling(steps, executions, ["k"], "step"), constraints.hierarchy(children, steps, ["k"], "id", "step"), constraints.dense(series("i", index), ["k"], "i")]
        rules += [constraints.increasing(series("t", times), ["k"], "t"), constraints.aligned(series("t", times), series("t", other), ["k"], "t")]
        return sorted((r.rule, r.row) for r in constraints.all_of(rules).collect())

    assert found() == []
    assert found(steps=[("a", 1, 0, 10), ("a", 2, 11, 30)]) == [(constraints.OUTSIDE, "8"), (constraints.GAP, "2")]
    assert found(steps=[("a", 1, 1, 10), ("a", 2, 10, 30)]) == [(constraints.FIRST_EDGE, "1")] and found(steps=[("a", 1, 0, 10), ("a", 2, 10, 31)]) == [(constraints.LAST_EDGE, "2")]
    assert found(children=[("a", 7, 9, 2, 4), ("a", 8, 1, 2, 14)]) == [(constraints.OUTSIDE, "8"), (constraints.ORPHAN, "7")]
    assert found(index=(1, 2, 4, 4)) == [(constraints.NOT_DENSE, "2")] and found(times=(1, 2, 2), other=(1, 2)) == [(constraints.UNORDERED, "2")]
    assert found(other=(1, 2, 4)) == [(constraints.NOT_ALIGNED, "3"), (constraints.NOT_ALIGNED, "4")]
    assert (constraints.NO_STEP, "1") in found(executions=spark.createDataFrame([("a", 0, 30), ("b", 1, 2)], "k string, start long, end long"))


def plain_peaks(values, prominence):
    out = []
    for k in range(1, len(values) - 1):
        end = k
        while end < len(values) - 1 and values[end + 1] == values[k]:
            end += 1
        if not values[k - 1] < values[k] or end == len(values) - 1 or not values[end + 1] < values[k]:
            continue
        middle, bases = (k + end) // 2, []
        for side in (range(middle - 1, -1, -1), range(middle + 1, len(values))):
            base = middle
            for j in side:
                if values[j] > values[middle]:
                    break
                if values[j] < values[base]:
                    base = j
            bases.append(base)
        rise = values[k] - max(values[b] for b in bases)
        if rise >= prominence:
            out.append((middle, *bases, rise))
    return out


def test_peaks_equal_a_plain_search_and_take_linear_time():
    rng = random.Random(8)
    for _ in range(300):
        values = [rng.randrange(6) for _ in range(rng.randrange(30))]
        assert machines.peaks_of(values, 1) == plain_peaks(values, 1)
    began = time.time()
    assert len(machines.peaks_of(np.linspace(0, 1, 1_000_000).tolist()[::-1] + [2.0, 0.0], 0.5)) == 1
    assert time.time() - began < 60


def test_a_path_turns_back_where_it_opposes_itself(spark):
    there_and_back = [0, 1, 2, 3, 4, 3, 2, 1, 0]
    rows = [("a", t * 10, float(x), 0.0, 0.1) for t, x in enumerate(there_and_back)] + [("b", t * 10, float(x), 3.0 * t, 0.1) for t, x in enumerate(there_and_back)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double, s double")
    found = machines.reversals(df, ["k"], "t", ["x", "y"], "s", 100, 1.0, 50).collect()
    assert [tuple(r) for r in found] == [("a", 40, 0, 80, "x", 1)]  # b goes on sideways
    assert machines.reversals(df, ["k"], "t", ["x", "y"], "s", 100, 1.0, 90).collect() == []
