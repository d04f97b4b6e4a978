"""A trie of conversation prefixes: polynomial prefix fingerprints, verified turn by turn, then rolled up to parents.

A prefix of turns t1 .. td has the fingerprint t1 B^(d-1) + ... + td modulo two
primes. numpy scans sorted ranges of turns; what a range begins with is carried
over from the ranges before it, so that a conversation of any length may lie
across many ranges. As such a fingerprint is linear, that of a conversation
whose first turns are another one's follows from both without a second scan.

Fingerprints only group candidates. A turn is told by a hash and, where several
contents share it, by its rank among them, so that turns are equal exactly if
both are. In each group the turn of every member is held against that of the
representative, the smallest conversation; a member whose turn differs is split
off, and so is what follows it. By induction over the depth a node's members
agree in all turns.

Totals over subtrees need no walk by levels: each node is given to its smallest
member, whose own path holds it; the sums along each path from its end are
added up node by node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.tables import stored

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1300021)
#: Turns at most that a conversation may take over from another one.
SHARED = 3
#: Depths in a block of a path's sums, and ids in a block of a node's ends.
DEPTHS, IDS = 4096, 64
NODE = ["depth", "r1", "r2", "split"]
SCAN = "conv_id long, hash long, rank int, words long, part int, i long, f1 long, f2 long, w1 long, w2 long, head boolean, tail boolean"


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo prime."""
    out = np.ones(1, np.int64)
    while len(out) <= n:
        out = np.concatenate([out, out * (pow(base, len(out), prime)) % prime])
    return out[: n + 1]


def _scan(primes: tuple[int, int]):
    """Rows in order of conversation and turn, with the place, the fingerprint and the power of the base within this range."""
    bases = [b % p for b, p in zip(BASES, primes, strict=True)]
    inverse = [pow(b, -1, p) for b, p in zip(bases, primes, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, count, state, waiting = None, 0, [(0, 1), (0, 1)], None
        for batch in batches:
            if not batch.num_rows:
                continue
            convs, n = batch.column("conv_id").to_numpy(), batch.num_rows
            goes_on = convs[0] == conv
            starts = np.concatenate([[0], np.flatnonzero(convs[1:] != convs[:-1]) + 1])
            lengths = np.diff(np.append(starts, n))
            at = np.arange(n) - np.repeat(starts, lengths)
            first = np.arange(n) < (lengths[0] if goes_on else 0)
            columns = []
            for k, (base, back, p) in enumerate(zip(bases, inverse, primes, strict=True)):
                up = _powers(base, p, int(lengths.max()))
                term = np.mod(batch.column("hash").to_numpy(), p) * _powers(back, p, int(lengths.max()))[at] % p
                total = np.cumsum(term)
                f = (total - np.repeat(total[starts] - term[starts], lengths)) % p * up[at] % p
                f0, w0 = state[k]
                f = np.where(first, (f0 * up[at + 1] + f) % p, f)
                w = np.where(first, w0 * up[at + 1] % p, up[at + 1])
                columns += [f, w]
                state[k] = int(f[-1]), int(w[-1])
            at = at + np.where(first, count, 0)
            fresh = np.zeros(n, bool)
            fresh[0] = waiting is None
            if waiting is not None:
                yield waiting
            extra = [at, columns[0], columns[2], columns[1], columns[3], fresh, np.zeros(n, bool)]
            waiting = pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, extra)], [*batch.schema.names, "i", "f1", "f2", "w1", "w2", "head", "tail"])
            conv, count = convs[-1], int(at[-1]) + 1
        if waiting is not None:
            last = np.zeros(waiting.num_rows, bool)
            last[-1] = True
            yield waiting.set_column(waiting.num_columns - 1, "tail", pa.array(last))

    return run


def _carried(edges: list, primes: tuple[int, int]) -> list[tuple]:
    """part, conv_id, i, f1, f2, w1, w2: what ranges begin with, from the first and last row of each range."""
    out, state = [], None
    ends = {part: {} for part in sorted({x.part for x in edges})}
    for x in edges:
        ends[x.part] |= {name: x for name in ("head", "tail") if x[name]}
    for part, own in ends.items():
        head, tail = own["head"], own["tail"]
        before = state if state and state[0] == head.conv_id else None
        if before:
            out.append((part, *before))
        i, fs, ws = tail.i + 1, (tail.f1, tail.f2), (tail.w1, tail.w2)
        if before and tail.conv_id == head.conv_id:
            fs = tuple((g * w + f) % p for g, w, f, p in zip(before[2:4], ws, fs, primes, strict=True))
            ws = tuple(v * w % p for v, w, p in zip(before[4:], ws, primes, strict=True))
            i += before[1]
        state = (tail.conv_id, i, *fs, *ws)
    return out


def prefixes(conversations: DataFrame, primes: tuple[int, int] = PRIMES, hashes: int | None = None) -> DataFrame:
    """conv_id, i (from 0), hash, rank, words, f1, f2, w1, w2 of each turn, in order of turn, null first.

    Turns of one number are ordered by role, then text; a null role or text counts as empty, and rows without a conv_id
    are left out. f1 and f2 are the fingerprint of the turns up to this one, w1 and w2 the power of the base that shifts it
    aside. Rows of one conversation, turn and first 64 characters of the role are in one range. hashes cuts the hash of a
    turn down, for tests.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    code = F.xxhash64("role", "text")
    turns = turns.withColumns({"hash": code if hashes is None else F.pmod(code, F.lit(hashes)), "words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})
    contents = turns.select("hash", "role", "text").distinct()
    shared = stored(contents.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))
    if shared.isEmpty():
        turns = turns.withColumn("rank", F.lit(0))
    else:
        number = (F.row_number().over(Window.partitionBy("hash").orderBy("role", "text")) - 1).alias("rank")
        ranks = contents.join(shared.hint("merge"), "hash").select("hash", "role", "text", number)
        turns = turns.join(ranks.hint("merge"), ["hash", "role", "text"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first()]
    ranges = turns.repartitionByRange(*order, F.substring("role", 1, 64)).sortWithinPartitions(*order, "role", "text")
    rows = stored(ranges.select("conv_id", "hash", "rank", "words", F.spark_partition_id().alias("part")).mapInArrow(_scan(primes), SCAN))
    carried = _carried(rows.filter("head or tail").collect(), primes)  # two rows for each range
    if carried:
        known = spark.createDataFrame(carried, "part int, conv_id long, n long, g1 long, g2 long, v1 long, v2 long")
        rows = rows.join(F.broadcast(known), ["part", "conv_id"], "left").na.fill({"n": 0, "g1": 0, "g2": 0, "v1": 1, "v2": 1})
        rows = rows.withColumn("i", F.col("i") + F.col("n"))
        for k, p in enumerate(primes, 1):
            rows = rows.withColumns({f"f{k}": (F.col(f"g{k}") * F.col(f"w{k}") + F.col(f"f{k}")) % p, f"w{k}": F.col(f"v{k}") * F.col(f"w{k}") % p})
    return rows.select("conv_id", "i", "hash", "rank", "words", "f1", "f2", "w1", "w2")


def _back(k: int, primes: tuple[int, int]) -> int:
    return pow(BASES[k - 1], -1, primes[k - 1])


def _path(rows: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """conv_id, depth, r1, r2, ends, hash, rank and words, with the fingerprint q1, q2 of the parent."""
    parent = {f"q{k}": F.pmod(F.col(f"r{k}") - F.pmod("hash", F.lit(p)), F.lit(p)) * _back(k, primes) % p for k, p in enumerate(primes, 1)}
    return rows.withColumns({q: F.when(F.col("depth") > 0, x) for q, x in parent.items()})


def as_they_are(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The paths of the conversations of prefixes()."""
    lengths = turns.groupBy("conv_id").agg((F.max("i") + 1).alias("n"))
    own = turns.join(lengths.hint("merge"), "conv_id").select("conv_id", (F.col("i") + 1).alias("depth"), F.col("f1").alias("r1"), F.col("f2").alias("r2"), "hash", "rank", "words", (F.col("i") + 1 == F.col("n")).alias("ends"))
    return _path(own.unionByName(_roots(lengths.withColumn("ends", F.lit(False)))), primes)


def _roots(convs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return convs.select("conv_id", zero.alias("depth"), zero.alias("r1"), zero.alias("r2"), zero.alias("hash"), F.lit(0).alias("rank"), zero.alias("words"), "ends")


def rebuilt(turns: DataFrame, base: Column, shared: Column, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The paths of conversations whose first ``shared`` turns are those of conversation ``base``, and then their own after their first ``shared``.

    base and shared are functions of conv_id; shared is 0 to SHARED. A base that has fewer turns, or isn't there, gives
    what it has. A conversation may end up without turns.
    """
    first = [F.max(F.when(F.col("i") == j - 1, F.col(f"f{k}"))).alias(f"f{k}_{j}") for k in (1, 2) for j in range(1, SHARED + 1)]
    convs = stored(turns.groupBy("conv_id").agg((F.max("i") + 1).alias("n"), *first))

    def after(k: int, count: Column, side: str) -> Column:
        """Fingerprint of the first count turns of a conversation that has so many."""
        return F.coalesce(*(F.when(count == j, F.col(f"{side}.f{k}_{j}")) for j in range(1, SHARED + 1)), F.lit(0))

    asked = convs.select("*", base.alias("base"), shared.cast("long").alias("h")).alias("own")
    both = asked.join(convs.alias("other").hint("merge"), F.col("base") == F.col("other.conv_id"), "left")
    taken = F.least(F.col("h"), F.coalesce("other.n", F.lit(0)))
    deltas = [F.pmod(after(k, F.col("taken"), "other") - after(k, F.col("h"), "own"), F.lit(p)).alias(f"delta{k}") for k, p in enumerate(primes, 1)]
    size = F.col("taken") + F.greatest(F.col("own.n") - F.col("h"), F.lit(0))
    recipes = stored(both.withColumn("taken", taken).select(F.col("own.conv_id").alias("conv_id"), "base", "h", "taken", size.alias("size"), *deltas))
    columns = ["conv_id", "depth", "r1", "r2", "hash", "rank", "words", (F.col("depth") == F.col("size")).alias("ends")]
    own = turns.join(recipes.hint("merge"), "conv_id").filter(F.col("i") >= F.col("h")).withColumn("depth", F.col("taken") + F.col("i") + 1 - F.col("h"))
    for k, p in enumerate(primes, 1):
        shift = F.col(f"w{k}") * F.coalesce(*(F.when(F.col("h") == j, pow(_back(k, primes), j, p)) for j in range(1, SHARED + 1)), F.lit(1)) % p
        own = own.withColumn(f"r{k}", (F.col(f"delta{k}") * shift + F.col(f"f{k}")) % p)
    few = turns.filter(F.col("i") < SHARED).withColumnRenamed("conv_id", "base")
    lent = recipes.filter("taken > 0").join(few.hint("merge"), "base").filter(F.col("i") < F.col("taken"))
    lent = lent.withColumns({"depth": F.col("i") + 1, "r1": F.col("f1"), "r2": F.col("f2")})
    roots = _roots(recipes.withColumn("ends", F.col("size") == 0))
    return _path(own.select(*columns).unionByName(lent.select(*columns)).unionByName(roots), primes)


def verified(paths: DataFrame) -> DataFrame:
    """paths (stored), with split and psplit: what tells a node and its parent from others of their fingerprint, empty mostly.

    split lists the depths at which a conversation's turn differs from the representative's of its group, with the rank of
    that turn among those that do, in order of the smallest conversation.
    """
    group = ["depth", "r1", "r2"]
    mixed = paths.groupBy(*group).agg(F.min("hash").alias("a"), F.max("hash").alias("b"), F.min("rank").alias("c"), F.max("rank").alias("d"))
    mixed = stored(mixed.filter((F.col("a") < F.col("b")) | (F.col("c") < F.col("d"))).select(*group))
    if mixed.isEmpty():
        return paths.withColumns({"split": F.lit(""), "psplit": F.lit("")})
    turn = [*group, "hash", "rank"]
    kinds = paths.join(mixed.hint("merge"), group).groupBy(*turn).agg(F.min("conv_id").alias("first"))
    other = (F.row_number().over(Window.partitionBy(*group).orderBy("first")) - 1).alias("other")
    odd = paths.join(kinds.select(*turn, other).filter("other > 0").hint("merge"), turn)
    odds = odd.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "other"))).alias("odds"))  # only collisions of hashes

    def until(bound: Column) -> Column:
        said = F.transform(F.filter("odds", lambda x: x["depth"] <= bound), lambda x: F.concat_ws(":", x["depth"].cast("string"), x["other"].cast("string")))
        return F.coalesce(F.concat_ws(",", said), F.lit(""))

    joined = paths.join(odds.hint("merge"), "conv_id", "left")
    return stored(joined.withColumns({"split": until(F.col("depth")), "psplit": until(F.col("depth") - 1)}).drop("odds"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's chunks, which come in order."""
    key, digest = None, None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in (*NODE, "chunk")), strict=True):
            if row[:-1] != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = row[:-1], hashlib.sha256(row[-1].encode())
            else:
                digest.update(b"," + row[-1].encode())
        yield _table(out)
    if key is not None:
        yield _table([(*key, digest.hexdigest())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [*NODE, "ends_sha256"])


def trie(paths: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each distinct prefix.

    A node is known by its smallest member and its depth. The root has depth 0, no parent, and every conversation as a
    member; without conversations there is no node. saved_tokens is what a cache of prefixes saves: over the subtree, the
    words of a node's last turn for each member but the first. Repeated conversations are members of the same nodes. Only
    one hash is made in order in one task, by blocks of ids: that of the ids that end in a node, as it is defined so.
    """
    paths = verified(stored(paths))
    parent = ["q1", "q2", "psplit"]
    nodes = paths.groupBy(*NODE, "words", *parent).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count(F.when(F.col("ends"), 1)).alias("n_ends"))
    nodes = stored(nodes)
    as_parent = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("r1"), F.col("q2").alias("r2"), F.col("psplit").alias("split")]
    below = nodes.filter("depth > 0")
    children = below.groupBy(*as_parent).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children.hint("merge"), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))

    own = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    steps = paths.select("conv_id", *NODE, F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"), F.lit(True).alias("step"))
    steps = steps.unionByName(own.withColumns({"r1": F.lit(None).cast("long"), "r2": F.lit(None).cast("long"), "split": F.lit(""), "step": F.lit(False)}))
    steps = steps.withColumn("block", F.floor(F.col("depth") / DEPTHS))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("conv_id", F.floor(F.col("depth") / DEPTHS).alias("block")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    every = blocks.unionByName(steps.filter("step").select("conv_id", "block", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves")))
    every = every.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    after = every.select("conv_id", "block", F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("saved_after"), F.coalesce(F.sum("leaves").over(later), F.lit(0)).alias("leaves_after"))
    down = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.withColumns({"saved": F.sum("saved").over(down), "leaves": F.sum("leaves").over(down)}).filter("step").join(after.hint("merge"), ["conv_id", "block"])
    totals = sums.groupBy(*NODE).agg(F.sum(F.col("saved") + F.col("saved_after")).alias("saved_tokens"), F.sum(F.col("leaves") + F.col("leaves_after")).alias("n_leaves"))

    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string"))
    chunks = paths.filter("ends").groupBy(*NODE, F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.concat_ws(",", ids).alias("chunk"))
    ends = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "chunk").mapInArrow(_hashed, "depth long, r1 long, r2 long, split string, ends_sha256 string")

    parents = nodes.select(*(F.col(c).alias(f"p_{c}") for c in NODE), F.col("conv_id").alias("parent_conv_id"))
    keyed = nodes.withColumn("above", F.col("depth") - 1)
    up = [F.col("above") == F.col("p_depth"), F.col("q1") == F.col("p_r1"), F.col("q2") == F.col("p_r2"), F.col("psplit") == F.col("p_split")]
    out = keyed.join(parents.hint("merge"), up, "left").drop("p_depth", "p_r1", "p_r2", "p_split")
    out = out.join(totals.hint("merge"), NODE).join(ends.hint("merge"), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
