"""Edge cases of the time-series operators on small hand-made series."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import evidence, geometry
from strandline.operators import asof, editlog, graphs, intervals, machines, paging, robust, runs, smoothing, solvers
from strandline.sources import tables


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_asof_crosses_buckets_and_keeps_unmatched(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1000), ("b", 7), (None, 3)], "k string, t long")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 5, 2.0), ("b", 8, 3.0)], "k string, t long, v double")
    back = asof.asof(left, right, ["k"], "t", ["v"], bucket=10)
    assert sorted(values(back, "k", "t", "match.v"), key=str) == sorted([("a", 5, 2.0), ("a", 1000, 2.0), ("b", 7, None), (None, 3, None)], key=str)
    ahead = asof.asof(left, right, ["k"], "t", ["v"], "forward", bucket=10)
    assert sorted(values(ahead, "k", "t", "match.v"), key=str) == sorted([("a", 5, 2.0), ("a", 1000, None), ("b", 7, 3.0), (None, 3, None)], key=str)


def test_nearest_takes_the_earlier_of_two_and_the_tolerance(spark):
    left = spark.createDataFrame([(1, 10), (1, 100)], "k int, t long")
    right = spark.createDataFrame([(1, 8), (1, 12)], "k int, t long")
    assert sorted(values(asof.nearest(left, right, ["k"], "t", [], 5), "t", "match.t")) == [(10, 8), (100, None)]


def test_overlap_join_matches_a_plain_theta_join(spark):
    spans = [(i % 3, i, (i * 37) % 50, (i * 37) % 50 + (i * 11) % 30) for i in range(60)]
    df = spark.createDataFrame(spans, "k int, id int, start long, end long")
    for closed in (False, True):
        found = sorted(values(intervals.overlap_join(df, df, ["k"], 7, closed), "a_id", "b_id"))
        meets = (lambda a, b: a[2] <= b[3] and b[2] <= a[3]) if closed else (lambda a, b: a[2] < b[3] and b[2] < a[3])
        assert found == sorted((a[1], b[1]) for a in spans for b in spans if a[0] == b[0] and meets(a, b))


def test_spans_merge_and_complement(spark):
    spans = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 3, 4), ("a", 9, 10)], "k string, start long, end long")
    assert sorted(values(intervals.merge_spans(spans, ["k"]), "start", "end", "n_spans")) == [(0, 7, 3), (9, 10, 1)]
    extent = spark.createDataFrame([("a", -2, 12), ("b", 0, 3)], "k string, low long, high long")
    assert sorted(values(intervals.complement_spans(spans, extent, ["k"]), "k", "start", "end")) == [("a", -2, 0), ("a", 7, 9), ("a", 10, 12), ("b", 0, 3)]


def test_islands_and_fill(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in [(0, 1.0), (10, None), (20, 3.0), (100, None), (300, 4.0)]], "k string, t long, v double")
    assert [r[0] for r in values(runs.islands(df, ["k"], "t", 10).orderBy("t"), "island")] == [1, 1, 1, 2, 3]
    assert values(runs.filled(df, ["k"], "t", "v", 50).orderBy("t"), "state", "v") == [("observed", 1.0), ("interpolated", 2.0), ("observed", 3.0), ("unknown", None), ("observed", 4.0)]


def test_unwrap_is_continuous(spark):
    df = spark.createDataFrame([(1, t, math.atan2(math.sin(t * 0.9), math.cos(t * 0.9))) for t in range(20)], "k int, t long, a double")
    for t, u in values(runs.unwrapped(df, ["k"], "t", "a"), "t", "unwrapped"):
        assert abs(u - 0.9 * t) < 1e-9


def test_local_quadratic_is_exact_on_a_parabola(spark):
    df = spark.createDataFrame([(1, i * 20_000 + (i % 3) * 1000, 0.0) for i in range(40)], "k int, t long, v double")
    s = F.col("t") * 1e-6
    out = smoothing.local_quadratic(df.withColumn("v", 2 + 3 * s + 4 * s * s), ["k"], "t", "v", 100_000)
    for t, v, smooth, velocity, acceleration in values(out, "t", "v", "smooth", "velocity", "acceleration"):
        assert abs(smooth - v) < 1e-6 and abs(velocity - (3 + 8 * t * 1e-6)) < 1e-4 and abs(acceleration - 8) < 1e-2


def test_latch_needs_dwell_and_forgets_over_a_pause(spark):
    heights = [0.0, 0.0, 0.0, 9.0, 9.0, 9.0, None, 0.0, 0.0]
    df = spark.createDataFrame([("a", i * 10, h, i) for i, h in enumerate(heights)] + [("a", 5000, 0.0, 99)], "k string, t long, h double, id long")
    out = machines.latched(df, ["k"], "t", "h", 1.0, 2.0, 20, 10, 100, "id")
    assert [s for _, s in sorted(values(out, "t", "state"))] == ["unknown", "unknown", "contact", "contact", "flight", "flight", "unknown", "unknown", "unknown", "unknown"]


def test_partners_are_used_once(spark):
    rows = [("k", 0, "left", 1), ("k", 5, "right", 2), ("k", 6, "left", 3), ("k", 8, "right", 4), ("k", 9, "left", 5), ("k", 100, "right", 6)]
    df = spark.createDataFrame(rows, "k string, t long, side string, id long")
    assert sorted(values(machines.partners(df, ["k"], "t", "side", "id", 10), "left_id", "right_id")) == [(1, 2), (3, 4)]


def test_tracker_follows_the_nearest_and_says_when_it_can_not(spark):
    rows = [(0, 0.0, 5.0, 1), (0, 9.0, 1.0, 2), (1, 0.5, 1.0, 3), (1, 8.0, 9.0, 4), (2, 1.0, 1.0, 5), (2, 0.1, 1.0, 6), (3, 50.0, 1.0, 7), (4, 1.0, 1.0, 8)]
    df = spark.createDataFrame([("c", *r) for r in rows], "k string, t long, x double, s double, id long")
    out = machines.tracked(df, ["k"], "t", ["x"], "s", "id", 5.0, 1.0, 10).orderBy("t")
    assert values(out, "id", "state") == [(1, "selected"), (3, "selected"), (None, "ambiguous"), (None, "lost"), (8, "selected")]


def test_machines_on_empty_tables(spark):
    df = spark.createDataFrame([], "k string, t long, v double, id long")
    assert machines.thinned(df, ["k"], "t", 5, "id").count() == 0
    assert machines.bouts(df, ["k"], "t", "v", 1.0, 0.5, 1, 5).count() == 0


def test_robust_estimate_drops_the_outlier(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 1000)], "k int, v double")
    assert values(robust.robust_estimate(df, ["k"], "v"), "n", "center", "n_kept", "estimate") == [(5, 3.0, 4, 2.5)]


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = dict(values(graphs.component_labels(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_ancestors_stop_at_the_depth(spark):
    found = graphs.ancestors(spark.createDataFrame([(i, i - 1) for i in range(1, 20)], "c long, p long"), "c", "p", 4)
    assert found.filter("node = 19").agg(F.max("distance"), F.min("ancestor")).first() == (4, 15)


def test_undo_of_nothing_does_not_count(spark):
    log = [("s", i, k) for i, k in enumerate(["undo", "edit", "edit", "undo", "edit", "reset", "edit", "undo", "undo", "edit"])]
    assert values(editlog.effective(spark.createDataFrame(log, "s string, r long, kind string"), ["s"], "r", "kind"), "r") == [(9,)]


def test_even_sample_has_both_ends(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "k string, i long")
    found = sorted(r[0] for r in values(paging.even_sample(df, ["k"], "i", 5), "i"))
    assert found == [0, 25, 50, 74, 99]


def test_slerp_half_way_and_frames(spark):
    one = spark.range(1).select(F.lit(1.0).alias("one"))
    q = [geometry.quaternion(F.lit(math.cos(a / 2)), F.lit(0.0), F.lit(0.0), F.lit(math.sin(a / 2))) for a in (0.0, 1.0)]
    r = one.select(geometry.rotation_angle(geometry.slerp(q[0], q[1], F.lit(0.25))).alias("a")).first().a
    assert abs(r - 0.25) < 1e-9
    right, up = geometry.vector(F.lit(2.0), F.lit(0.0), F.lit(0.0)), geometry.vector(F.lit(0.0), F.lit(0.5), F.lit(3.0))
    f = one.select(geometry.frame(right, up, 0.1).alias("f"), geometry.frame(right, right, 0.1).alias("g")).first()
    assert f.g is None and abs(f.f.front.x) < 1e-12 and abs(f.f.right.x - 1) < 1e-12


def test_combined_evidence(spark):
    df = spark.createDataFrame([("a", "observed", ["x"]), ("a", "interpolated", ["y", "x"]), ("b", "unknown", ["z"]), ("c", "observed", ["x"])], "k string, state string, source_ids array<string>")
    out = df.groupBy("k").agg(evidence.combined(F.struct("state", "source_ids"), F.lit(0.1)).alias("q")).orderBy("k")
    assert [(r.q.state, r.q.source_ids) for r in out.collect()] == [("interpolated", ["x", "y"]), ("unknown", ["z"]), ("inferred", ["x"])]


def test_offsets_leave_out_the_inconsistent_pair(spark):
    pairs = [("w", "a", "b", 1.0, 1.0), ("w", "b", "c", 1.0, 1.0), ("w", "a", "c", 9.0, 1.0), ("w", "c", "d", 1.0, 1.0), ("w", "b", "d", 2.0, 1.0), ("w", "a", "d", 3.0, 1.0)]
    out = solvers.solve_offsets(spark.createDataFrame(pairs, "w string, a string, b string, offset double, weight double"), ["w"], 0.1)
    assert {s: round(o, 6) for s, o in values(out, "source", "offset")} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_wide_csv_is_strict(spark, tmp_path):
    columns = tables.wide_columns()
    rows = [["0", "0.0", *(["1", "2", "0.5"] * 12)], ["1", "40.0", *(["nan", "nan", "nan"] * 11), "1", "NaN", "2"]]
    (tmp_path / "ok.csv").write_text("\n".join(",".join(r) for r in [columns, *rows]))
    long = tables.wide_to_long(tables.read_wide_csv(spark, str(tmp_path / "ok.csv")))
    assert long.count() == 24 and long.filter("problem = 'missing_in_part'").count() == 1 and long.filter("x is null").count() == 11
    (tmp_path / "bad.csv").write_text("\n".join(",".join(r) for r in [columns[::-1], rows[0]]))
    with pytest.raises(Exception):  # noqa: B017
        tables.read_wide_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_artifacts_are_computed_once(spark, tmp_path):
    made = []

    def produce():
        made.append(1)
        return spark.range(5)

    for _ in range(2):
        assert tables.published(spark, str(tmp_path), "raw", {"b": 1, "a": [1, 2]}, produce).count() == 5
    assert made == [1]


def test_receipts(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bin").write_bytes(b"other")
    receipt = spark.createDataFrame([("sub/a.bin", 3, "x"), ("a.bin", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("b.bin", 1, "x")], "path string, size long, sha256 string")
    assert sorted(values(tables.verified_files(spark, str(tmp_path), receipt), "path", "problem")) == [("b.bin", "missing"), ("sub/a.bin", "wrong_size")]


def test_wide_csv_has_the_contract_order():
    assert tables.wide_columns()[2:9] == ["L_shoulder_x", "L_shoulder_y", "L_shoulder_score", "R_shoulder_x", "R_shoulder_y", "R_shoulder_score", "L_elbow_x"]


def test_asof_matches_no_null_key(spark):
    left = spark.createDataFrame([(None, 10), ("a", 10), ("a", None)], "k string, t long")
    right = spark.createDataFrame([(None, 5, 1), ("a", 5, 2), ("a", None, 3)], "k string, t long, v long")
    found = {(r.k, r.t): r.match and r.match.v for r in asof.asof(left, right, ["k"], "t", ["v"]).collect()}
    assert found == {(None, 10): None, ("a", 10): 2, ("a", None): None}


def test_local_fit_of_a_line_for_an_hour(spark):
    line = spark.range(0, 3600 * 50, 7).select((F.col("id") * 20_000).alias("t"), (F.col("id") * 0.02 * 3.0 + 1.0).alias("y"), F.lit(0.5).alias("s"), F.lit(1).alias("k"))
    fit = smoothing.local_quadratic(line, ["k"], "t", "y", 600_000, sigma="s")
    row = fit.agg(F.count("smooth"), F.min("velocity"), F.max("velocity"), F.max(F.abs("acceleration")), F.max(F.abs(F.col("smooth") - F.col("y"))), F.max("smooth_sigma")).first()
    assert row[0] > 25_000 and abs(row[1] - 3) < 1e-6 and abs(row[2] - 3) < 1e-6 and row[3] < 1e-5 and row[4] < 1e-6 and 0 < row[5] < 0.6


def test_pages_keep_their_cap(spark):
    rows = spark.createDataFrame([("a", i, "x" * 9000) for i in range(6)], "k string, i long, body string")
    assert [(r.i, r.next_cursor) for r in paging.byte_page(rows, ["k"], "i", "body", 10_000).collect()] == [(0, 0)]
    assert [(r.i, r.next_cursor) for r in paging.byte_page(rows, ["k"], "i", "body", 18_000, F.lit(3)).collect()] == [(4, None), (5, None)]
    with pytest.raises(Exception, match="exceeds"):
        paging.byte_page(rows, ["k"], "i", "body", 5_000).collect()
