"""Cases on which queries failed or differed from their SQL on larger tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import jaccard, packs
from strandline.operators import carried, intervals, machines, matching, solvers
from strandline.plans import catalog, joins
from strandline.sources import tables


def held_against_sql(spark, folder, name, events):
    """The rows of a query on a table of events (user, hour, type, value, k), which must be those of its SQL."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=hour), user, kind, value, f'{{"k": {k}}}') for i, (user, hour, kind, value, k) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    expected = db.execute(catalog.ORACLES[name])
    names = [c[0] for c in expected.description]
    found = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*names).collect())
    assert found == sorted(expected.fetchall())
    return found


def test_a_plane_through_many_points_holds_no_square_of_them(spark, monkeypatch):
    """an SVD of all points allocated n x n numbers; a group was held by one task."""
    monkeypatch.setattr(solvers, "BLOCK", 4_000)
    rows = spark.range(60_000).selectExpr("'a' AS kind", "id % 307 * 1D AS x", "id % 211 * 1D AS y", "IF(id % 20 = 0, 9D, 0.5D * (id % 307) + 100) AS z")
    few = spark.createDataFrame([("b", 1.0, 2.0, 3.0), ("b", 2.0, 4.0, 6.0), ("c", 1.0, None, 0.0), (None, 0.0, 0.0, 2.0), (None, 1.0, 0.0, 2.0), (None, 0.0, 1.0, 2.0)], "kind string, x double, y double, z double")
    found = {r["kind"]: r for r in solvers.ground_plane(rows.unionByName(few), ["kind"], 0.01).collect()}
    a = found["a"]
    assert (a["n"], a["inliers"]) == (60_000, 57_000)
    assert [a["nx"], a["ny"], a["nz"], a["offset"]] == pytest.approx([-0.5 / math.sqrt(1.25), 0.0, 1 / math.sqrt(1.25), 100 / math.sqrt(1.25)], abs=1e-9)
    assert [(found[k]["n"], found[k]["inliers"], found[k]["nz"]) for k in ("b", "c")] == [(2, 0, None), (1, 0, None)]
    assert (found[None]["inliers"], found[None]["nz"], found[None]["offset"]) == (3, 1.0, 2.0)
    assert solvers.ground_plane(few.limit(0), ["kind"], 0.01).collect() == []


def test_a_plateau_is_no_turn(spark, tmp_path):
    """of a plateau the middle counted as a change of direction; in SQL a peak is higher than both neighbours."""
    there_and_back = [10.0, 40.0, 70.0, 100.0, 100.0, 70.0, 40.0, 10.0]
    rows = [(user, 6 * t, "view", x - user * (t == 4), 1) for user in (1, 2) for t, x in enumerate(there_and_back)]
    found = held_against_sql(spark, tmp_path, "direction_changes", rows)
    assert {r[0] for r in found if r[4] == "x"} == {1, 2}
    rows = [(3, 6 * t, "view", x, 1) for t, x in enumerate(there_and_back)]
    assert held_against_sql(spark, tmp_path / "flat", "direction_changes", rows) == []


def test_a_plateau_is_no_prominent_peak(spark, tmp_path):
    """as F3."""
    values = [10.0, 60.0, 60.0, 5.0, 50.0, 0.0]
    rows = [(1, hour, "view", value, 1) for hour, value in enumerate(values)]
    assert held_against_sql(spark, tmp_path, "peaks_prominent", rows) == [(4, 45.0)]


def test_a_bend_on_the_limit(spark, tmp_path):
    """3 * (k / 2000) and 3 * k / 2000 round differently, and (11.98 + 2) / 60 + 3 * 78 / 2000 is the limit."""
    rows = [(1, hour, "view", value, k) for hour, (value, k) in enumerate([(11.98, 78), (1.0, 1), (80.0, 10), (11.97, 78)])]
    found = held_against_sql(spark, tmp_path, "hand_states", rows)
    assert found[0] == (0, "extended,extended,indeterminate,indeterminate,indeterminate", "indeterminate")


def test_every_labelled_text_is_learned_from(spark):
    """about 2,000 texts of label 1 and 4,000 of label 0 were drawn, and 12,000,000 characters of them."""
    toxicity = pytest.importorskip("strandline.llm.toxicity")
    docs = spark.range(9_000).selectExpr("id AS doc_id", "concat('plain word w', id, IF(id % 9 = 0, ' bad', '')) AS text", "'en' AS lang")
    labels = spark.range(9_000).selectExpr("id AS doc_id", "int(id % 9 = 0) AS toxic")
    model = toxicity.fit(docs, labels, shard=60_000)
    words, _ = toxicity.word_buckets(pa.array([f"w{i}" for i in range(9_000)]))
    assert (model.languages[np.unique(words[0]), 0][1:] > model.languages[:, 0].min() + 1).all()
    scores = model.score(pa.array(["plain word w3", "plain word w7 bad", "another word", "bad news"]))
    assert (scores >= toxicity.THRESHOLD).tolist() == [False, True, False, True]


def test_overlaps_close_without_rounds_over_pairs(spark, monkeypatch):
    """orders that hang together were components of a graph of all overlapping pairs, found in rounds."""
    rows = [("a", i, s, e) for i, (s, e) in enumerate([(0, 50), (10, 12), (50, 60), (61, 62), (5, 7)])] + [("b", 9, 0, 5), (None, 10, 1, 2), (None, 11, 2, 4)]
    spans = intervals.closures(spark.createDataFrame(rows, "k string, id long, start long, end long"), ["k"], "c")
    groups = {}
    for r in spans.collect():
        groups.setdefault((r["k"], r["c"]), set()).add(r["id"])
    assert groups == {("a", 1): {0, 1, 2, 4}, ("a", 2): {3}, ("b", 1): {9}, (None, 1): {10, 11}}
    monkeypatch.setattr(joins.graphs, "component_labels", None)
    assert catalog.QUERIES["overlap_closure"](spark, "/root/testdata/sf0.001").count() > 0


def test_runs_are_read_one_after_another(spark):
    """each key and pack of runs was a group of its own in pandas."""
    rows = [(u, t * 10 + u, u * 1000 + t) for u in (None, 1, 2, 3) for t in range(40) if (t * (u or 5)) % 7 for u in [u or 0]] + [(None, 5, 7), (None, 12, 8), (None, 40, 9)]
    df = spark.createDataFrame(rows, "u long, t long, id long").repartition(3)
    expected, last = [], {}
    for u, t, i in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if u not in last or t >= last[u] + 25:
            last[u] = t
            expected.append((u, i))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("3", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found = machines.refractory(df, ["u"], "t", 25, "id")
            assert sorted(((r["u"], r["id"]) for r in found.collect()), key=str) == sorted(expected, key=str)
            assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_a_tracker_holds_two_candidates_of_an_instant(spark):
    """a task held all candidates of all instants between two pauses."""
    frames = {0: [(9.0, 0.0), (5.0, 3.0)], 10: [(1.0, 30.0), (1.0, 3.5), (2.0, 90.0), (7.0, 9.0)], 20: [(1.0, 3.0), (1.0, 4.0)], 30: [(1.0, 99.0)], 90: [(1.0, 1.0), (3.0, 50.0)]}
    rows = [(c, t, s, x, 100 * t + i) for c in ("a", None) for t, found in frames.items() for i, (s, x) in enumerate(found)]
    df = spark.createDataFrame(rows, "c string, t long, s double, x double, id long").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        out = machines.tracked(df, ["c"], "t", ["x"], "s", "id", 20.0, 2.0, 30)
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        for c in ("a", None):
            assert sorted((r["t"], r["id"], r["state"]) for r in out.collect() if r["c"] == c) == [(0, 0, "selected"), (10, 1001, "selected"), (20, None, "ambiguous"), (30, None, "lost"), (90, 9001, "selected")]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_complements_take_no_join(spark):
    """spans, their keys and extents were joined, and a task of the joins held several sorted copies."""
    spans = spark.createDataFrame([("a", -5, 1), ("a", 3, 4), ("a", 4, 6), ("a", 8, 30), ("a", 40, 50), ("b", 20, 30), ("c", 1, 2), (None, 2, 3)], "k string, start long, end long")
    extent = spark.createDataFrame([(k, 0, 10) for k in ("a", "b", "d", None)], "k string, low long, high long")
    found = intervals.complement_spans(spans, extent, ["k"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", 1, 3), ("a", 6, 8), ("b", 0, 10), ("d", 0, 10), (None, 0, 2), (None, 3, 10)], key=str)
    assert "Join" not in found._jdf.queryExecution().toString()


def test_missing_tokens_of_wide_rows(spark):
    """each cell was trimmed, lowered and looked up before it was parsed; a tab before nan made it a number."""
    cells = ["", "nan", " NaN ", "\tnan", "NA", "null", "x", None, "-1.5", " 2 ", "Infinity"]
    names = tables.wide_columns()
    wide = spark.createDataFrame([("1", "2.5", *([c] * (len(names) - 2))) for c in cells], ", ".join(f"{n} string" for n in names))
    found = tables.wide_to_long(wide)
    assert found.filter("landmark = 'L_hip' AND x IS NOT NULL").orderBy("x").select("x").collect() == [(-1.5,), (2.0,), (float("inf"),)]
    assert "lower" not in found._jdf.queryExecution().toString()


def test_short_keys_are_walked_without_buckets(spark, monkeypatch):
    """F11, F14 to F16: all buckets of all keys were stored, ran alone, and ran again in rounds from what the last one left."""

    def step(state, emit, time, value):
        state["seen"] += value or []
        emit((time, "".join(state["seen"])))

    rows = [(k, float(k or 0) % 2 or None, t, [f"{t % 7}"] if t % 3 else None) for k in [None, *range(1, 40)] for t in range(k or 3)] + [(5, 1.0, None, ["x"])]
    df = spark.createDataFrame(rows, "k long, half double, t long, v array<string>").repartition(3)
    expected = {}
    for k, half, t, v in sorted((r for r in rows if r[2] is not None), key=lambda r: r[2]):
        expected.setdefault((k, half), []).append((t, (expected.get((k, half)) or [(0, "")])[-1][1] + "".join(v or [])))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n, long in (("3", 1 << 18), (size, 1 << 18), (size, 30), (size, 0)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            monkeypatch.setattr(carried, "LONG", long)
            with monkeypatch.context() as m:
                if long == 1 << 18:
                    m.setattr(carried, "stored", None)
                found = {}
                out = carried.carried(df, ["k", "half"], "t", 4, ["v"], {"seen": []}, step, "t long, seen string", lambda state, emit: emit((99, "".join(state["seen"]))))
                for r in out.collect():
                    found.setdefault((r["k"], r["half"]), []).append((r["t"], r["seen"]))
            assert {k: sorted(v) for k, v in found.items()} == {k: [*v, (99, v[-1][1])] for k, v in expected.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_nearest_rows_are_found_in_few_parts(spark, monkeypatch):
    """F8: each row went to every block of 1,024 of the other side, twice, so that what was shuffled grew with the square."""
    rng = np.random.default_rng(8)
    p, q = rng.normal(size=(90, 5)).round(1), rng.normal(size=(70, 5)).round(1)
    p[40:50], q[:6], q[60:] = p[:10], p[20:26], q[10:20]
    p[80] = p[20]  # a twin of what q[0] has too
    a, b = (spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x, 1000 * k)], "id long, v array<double>").repartition(3) for k, x in enumerate((p, q)))
    d = np.sqrt(((p[:, None, :] - q[None, :, :]) ** 2).sum(2))
    for part in (1 << 17, 9):
        monkeypatch.setattr(matching, "PART", part)
        monkeypatch.setattr(matching, "PARTS", 2)
        found = {r["id"]: tuple(r)[1:] for r in matching.two_nearest(a, b, 4).collect()}
        order = np.argsort(d, axis=1, kind="stable")
        assert found == {i: (1000 + int(order[i, 0]), d[i, order[i, 0]], d[i, order[i, 1]]) for i in range(90)}
        assert matching.two_nearest(a, b.filter("id = 1003"), 4).filter("id = 7").collect() == [(7, 1003, d[7, 3], None)]
        assert matching.two_nearest(a, b.limit(0), 4).collect() == []
    best, back = d.argmin(1), d.argmin(0)
    near, far = np.sort(d, axis=1), np.sort(d, axis=0)
    pairs = [(i, 1000 + int(j)) for i, j in enumerate(best) if back[j] == i and near[i, 0] < 0.9 * near[i, 1] and far[0, j] < 0.9 * far[1, j]]
    assert sorted((r["a_id"], r["b_id"]) for r in matching.mutual_matches(a, b, 0.9).collect()) == pairs and pairs
    copies = []
    monkeypatch.setattr(matching, "BLOCK", 4)
    monkeypatch.setattr(matching, "_tiles", lambda block: copies.append(block) or (lambda batches: iter(())))
    assert matching.mutual_matches(a, b, 0.9).collect() == [] and copies == [4]  # both ways at once


def test_a_passage_of_all_documents_makes_no_candidates(spark):
    """op9: shingles of several documents were ordered by hash alone, so that a passage of all documents hung them together and each pair of blocks was compared."""
    passage = " ".join(f"common{i}" for i in range(30))
    rows = []
    for pair in range(40):
        words = [f"w{pair}x{i}" for i in range(60)]
        rows += [(2 * pair, " ".join([passage, *words])), (2 * pair + 1, " ".join([passage, *words[:-1], "changed"]))]
    docs = spark.createDataFrame([*rows, (80, passage), (81, None)], "doc_id long, text string").repartition(3)
    of_token: dict[int, set[int]] = {}
    for row in jaccard.described(docs).filter("doc_id < 80").collect():
        assert row["prefix"]
        for token in row["prefix"]:
            of_token.setdefault(token, set()).add(row["doc_id"] // 2)
    assert {len(pairs) for pairs in of_token.values()} == {1}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()} == {d: d // 2 * 2 for d in range(80)} | {80: 80, 81: 81}


def test_levels_of_keys_tell_how_often_they_occur():
    """op9: as above; a count that a byte can't hold stays high."""
    keys, counts = packs.counts_of(np.repeat(np.array([1, 2, 3, 4], np.uint64) << np.uint64(40), [1, 2, 3, 1_000]))
    assert (counts.tolist(), len(keys)) == ([1, 2, 3, 255], 4)
    assert packs._levels(np.array([1, 2, 3, 4, 5, 255, 256, 257, 1 << 20])).tolist() == [0, 1, 2, 2, 3, 8, 8, 9, 20]
    assert [len(x) for x in packs.counts_of(np.empty(0, np.uint64))] == [0, 0]


def test_links_of_a_block_come_as_stars():
    """op9: links came as the chain in which they were found, and components took a round for each halving of it."""
    ids = np.arange(10, 60, dtype=np.int64)
    near = np.abs(np.subtract.outer(range(50), range(50)))
    overlap = np.where(near == 0, 100, np.where(near == 1, 95, 0)).astype(np.uint8)  # each links with the next one alone
    table = pa.table({"ids": [ids.tobytes()], "sizes": [np.full(50, 100, np.int64).tobytes()], "n_left": pa.array([50], pa.int32()), "counts": pa.array([packs.squeezed(overlap.tobytes())], pa.binary())})
    found = jaccard._summed(85)(table).to_pydict()
    assert sorted(zip(found["a"], found["b"], strict=True)) == [(a, 10) for a in range(11, 60)]
