"""Centroids, exact copies and conversation prefixes against brute force, with nulls, ties, repeats, hot keys and empty tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import centroids, grace, queries, trie

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_centroids", "op12_exact_dedup", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    expected = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    found = queries.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(tuple(r) for r in found.select(*columns).collect()) == Counter(expected.fetchall())


VECTORS = "vec_id long, embedding array<double>, cluster int, id string, v string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 9, "x", "y") for i, e in rows], VECTORS)


def lloyd(rows, size, k, rounds):
    kept = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    middles = [v for _, v in first[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), c) for c, m in enumerate(middles))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for c, own in members.items():
            middles[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    told = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in told:
        inertia[c] += d
    held = lambda x: x if x < 1 << 63 else None
    return Counter((i, c, held(d), held(inertia[c]), held(sum(inertia.values())), sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for i, d, c in told)


def cases():
    rng = random.Random(4)
    plain = [(i, [round(rng.gauss(0, 1), 2) for _ in range(3)]) for i in range(200)]
    odd = [(7, [0.1, 0.2, 0.3])] * 300 + [(None, [1.0, 2.0, 3.0])] * 2 + [(5, None), (6, [1.0, 2.0]), (8, [1.0, None, 2.0]), (9, [math.nan, 1.0, 1.0]), (10, [math.inf, 1.0, 1.0])]
    return {
        "copies": plain + odd,
        "ties": [(i, [float(i % 3), float(i % 2), 0.0]) for i in range(200)],
        "few": plain[:3] + odd[-5:],
        "huge": [(i, [x * 10.0 ** rng.randrange(15) for x in v]) for i, v in plain],
    }


@pytest.mark.parametrize("name", ["copies", "ties", "few", "huge"])
def test_centroids(spark, name):
    rows = cases()[name]
    found = centroids.clusters(vectors(spark, rows), k=12, rounds=3, dimensions=3)
    assert Counter(tuple(r) for r in found.collect()) == lloyd(rows, 3, 12, 3)


def test_no_vectors(spark):
    assert centroids.clusters(vectors(spark, [(1, None), (2, [1.0])])).collect() == []
    assert centroids.clusters(vectors(spark, [])).collect() == []


def test_trees_cover_their_points_and_prune():
    rng = np.random.default_rng(5)
    points = rng.integers(-50, 50, (700, 2)).astype(float)
    tree = centroids.cover_tree(points, 8)
    assert sorted(tree.order) == list(range(700))
    for k in range(len(tree.begin)):
        own = points[tree.order[tree.begin[k] : tree.end[k]]]
        assert np.sqrt(((own - points[tree.centre[k]]) ** 2).sum(axis=1)).max() <= tree.radius[k]
        below = range(tree.kid[k], tree.kid[k] + tree.kids[k])
        assert not tree.kids[k] or [tree.begin[k], *(tree.end[c] for c in below)] == [*(tree.begin[c] for c in below), tree.end[k]]
    middles = points[:40]
    over = centroids._single(centroids.cover_tree(middles, 1))
    node, _, leaf, _ = centroids.walk(points, tree, middles, over)
    pairs = (tree.end[leaf] - tree.begin[leaf]).sum()
    assert pairs < 0.3 * 700 * 40  # the rest is pruned


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in texts], "doc_id long, text string, row int, hash string, items string")


def copies():
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(6))) for _ in range(300)]
    texts += [texts[9].replace(" ", "\t\n"), " " + texts[9], texts[9] + "  ", "A b", "a b", " ", "é", "é", None, "", " ", "\x0b\x0c", "x" * 300_000, "x" * 300_000 + "y"]
    texts += ["the hot one"] * 400
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, rows[3], rows[3], (None, texts[9]), (None, "only nameless"), (None, "only nameless"), (0, "another text")]


@pytest.mark.parametrize("memory", [grace.MEMORY, 5_000, 400])
def test_exact_copies(spark, memory):
    rows = copies()
    found = Counter(tuple(r) for r in grace.classes(documents(spark, rows).repartition(3), memory=memory).collect())
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    expected = Counter()
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        expected.update((i, ids[0], len(ids), k == 0, sha256(text.encode()).hexdigest()) for k, i in enumerate(ids))
    assert found == expected


def test_equal_hashes_are_told_apart():
    batch = pa.record_batch({"hash": pa.array([5] * 6, pa.int64()), "content": pa.array([b"a", b"b", b"a", b"", b"b", b"c"]), "slot": pa.array(range(6), pa.int64())})
    for memory in (grace.MEMORY, 10):
        (rows, number, contents), *others = grace.grace(iter([batch.slice(0, 3), batch.slice(3)]), memory)
        assert not others and [contents.contents[k] for k in number[np.argsort(rows.column("slot").to_numpy())]] == [b"a", b"b", b"a", b"", b"b", b"c"]


def test_rows_that_stay(spark):
    rows = copies()
    docs = documents(spark, rows)
    kept = grace.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(re.sub(r"\s+", " ", r.text or "") for r in kept.select("text").collect() if r.text != " ") == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows} - {" "})
    exact = grace.deduplicated(docs, normalised=False)
    assert exact.count() == len({t or "" for _, t in rows})
    assert grace.classes(docs.limit(0)).collect() == [] and grace.deduplicated(docs.limit(0)).collect() == []


CONVERSATIONS = "conv_id long, turn long, role string, text string, hash string, depth int"


def turns_of(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}


def tree_of(conversations):
    members = defaultdict(list)
    for c, turns in conversations.items():
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, own in members.items():
        value = (len(own) - 1) * len(k[-1][1].split()) if k else 0
        for depth in range(len(k) + 1):
            saved[k[:depth]] += value
            leaves[k[:depth]] += children[k] == 0
    ends = {k: sha256(",".join(str(c) for c in sorted(own) if len(conversations[c]) == len(k)).encode()).hexdigest() for k, own in members.items()}
    return Counter((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), children[k], leaves[k], saved[k], ends[k]) for k, own in members.items())


def conversations():
    rng = random.Random(7)
    texts = ["a b", "c", None, "d e f", "", "hello  x\ty"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(-30, 60) for t in [None] * rng.randrange(2) + list(range(rng.randrange(6)))]
    rows += [(c, t, "user", "a") for c, n in ((100, 400), (120, 300)) for t in range(n)]
    return rows + rows[:7] + [(None, 1, "x", "y"), (7, None, "u", "u"), (8, 0, "u", "z " * 50_000)]


@pytest.mark.parametrize("weak", [{}, {"hashes": 3}, {"primes": (11, 13)}, {"primes": (5, 7), "hashes": 4}])
def test_prefix_trie(spark, monkeypatch, weak):
    """With weak hashes every kind of collision comes up, and is split."""
    monkeypatch.setattr(trie, "DEPTHS", 32)
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], CONVERSATIONS)
    primes = weak.get("primes", trie.PRIMES)
    base, shared = F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string")) % 4
    found = trie.trie(trie.rebuilt(trie.prefixes(df, **weak), base, shared, primes))
    own = turns_of(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    assert Counter(tuple(r) for r in found.collect()) == tree_of(rebuilt)


def test_prefix_trie_of_conversations_as_they_are(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], CONVERSATIONS)
    found = trie.trie(trie.as_they_are(trie.prefixes(df)))
    assert Counter(tuple(r) for r in found.collect()) == tree_of({c: tuple(t) for c, t in turns_of(rows).items()})


def test_no_conversations(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    base, shared = F.col("conv_id"), F.lit(1)
    assert trie.trie(trie.rebuilt(trie.prefixes(df), base, shared)).collect() == []
    assert trie.trie(trie.as_they_are(trie.prefixes(df))).collect() == []
