"""State machines whose state is carried from row to row, and from one bucket of time to the next.

Keys are dealt out to tasks, which read them one after another in order of time
and hold an Arrow batch and one state. Only keys that would keep one task busy
for long ("long keys", see ``LONG`` and ``SHARE``) are cut into buckets.

What a machine does with a row depends on all rows of the key before it, but
most machines soon forget what they began with. So every bucket is run at once
from the start state; buckets whose predecessor ends in another state than they
began with are run again from that one, until none is left. Only the states
travel between rounds, one short text for each bucket. At last each bucket
emits its rows from its known state. A long key thus keeps as many tasks busy as
it has buckets.

A machine that doesn't forget would pass a state on by one bucket a round;
keys that aren't settled after ``ROUNDS`` are read once in order instead, each
in a stream that holds one bucket at a time. Results are the same either way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandline.operators.machines import begins
from strandline.operators.storage import free_names, stored

ROUNDS = 6
#: A key is long if it has more rows than this, or more than this part of all rows.
LONG, SHARE = 1 << 18, 1 / 16
#: step(state, emit, time, *values): changes the state, a dict that JSON can hold, and emits tuples.
Step = Callable[..., None]
STATES = "id long, came string, left string"


def _plain(array: pa.Array) -> list:
    """to_pylist(), which makes a scalar of each nested value, by columns of what lists and structs hold."""
    if isinstance(array, pa.ListArray):
        at = array.offsets.to_pylist()
        values = _plain(array.values.slice(at[0], at[-1] - at[0]))
        out = [values[a - at[0] : b - at[0]] for a, b in pairwise(at)]
    elif isinstance(array, pa.StructArray) and array.type.num_fields:
        names = [f.name for f in array.type]
        out = [dict(zip(names, x, strict=True)) for x in zip(*map(_plain, array.flatten()), strict=True)]
    else:
        return array.to_pylist()
    if array.null_count:
        out = [x if known else None for x, known in zip(out, array.is_valid().to_pylist(), strict=True)]
    return out


def _rows(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
    rows = batch.column("rows")[k].values
    return zip(*map(_plain, rows.flatten()), strict=True)


def _walked(step: Step, batch: pa.RecordBatch, k: int, came: str, emit: Callable[[tuple], None]) -> dict:
    state = json.loads(came)
    for row in _rows(batch, k):
        step(state, emit, *row)
    return state


def _text(state: dict) -> str:
    return json.dumps(state, sort_keys=True)


def _states(ids: list, came: list, left: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(came, pa.string()), pa.array(left, pa.string())], ["id", "came", "left"])


def _alone(step: Step):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            came = batch.column("came").to_pylist()
            left = [_text(_walked(step, batch, k, c, lambda row: None)) for k, c in enumerate(came)]
            yield _states(batch.column("id").to_pylist(), came, left)

    return run


def _in_turn(step: Step, fresh: str):
    """Buckets in order of their key, each from the state that the last one of its key has left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, fresh
        for batch in batches:
            came, left = [], []
            for k, own in enumerate(batch.column("chain").to_pylist()):
                state = fresh if own != key else state
                key = own
                came.append(state)
                state = _text(_walked(step, batch, k, state, lambda row: None))
                left.append(state)
            yield _states(batch.column("id").to_pylist(), came, left)

    return run


def _in_order(step: Step, fresh: str, finish: Callable | None, keys: list[str], told: pa.Schema):
    """Rows in order of their keys and of time: a batch and one state are all that stays."""

    def out(own: pa.Table, places: list[int], found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            values = [pa.array(list(x), field.type) for x, field in zip(zip(*found, strict=True), list(told)[len(keys) :], strict=True)]
            yield from pa.Table.from_arrays([*own.take(pa.array(places)).columns, *values], names=told.names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = None, []  # before: the key of the last row
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([*before, batch.select(keys)])
            new = {*(begins(own, keys) - len(before)).tolist(), *([] if before else [0])}
            places, found = [], []
            for k, row in enumerate(zip(*(_plain(batch.column(c)) for c in batch.schema.names[len(keys) :]), strict=True), len(before)):
                if k - len(before) in new:
                    if finish and state is not None:
                        finish(state, found.append)
                        places += [k - 1] * (len(found) - len(places))
                    state = json.loads(fresh)
                step(state, found.append, *row)
                places += [k] * (len(found) - len(places))
            before = [batch.select(keys).slice(batch.num_rows - 1)]
            yield from out(own, places, found)
        if finish and state is not None:
            found = []
            finish(state, found.append)
            yield from out(pa.Table.from_batches(before), [0] * len(found), found)

    return run


def carried(df: DataFrame, by: list[str], time: str, span: int, columns: list[str], start: dict, step: Step, schema: str, finish: Callable[[dict, Callable[[tuple], None]], None] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """by and the columns of schema: what step emits for the rows of each key in order of time, then of the columns as listed.

    Long keys are cut into buckets ``span`` of time long, which a task holds whole. finish(state, emit) is called after a
    key's last row. Rows without a time are dropped; null keys are a key. An empty table gives no rows.
    """
    if not by:
        return _bucketed(df, by, time, span, columns, start, step, schema, finish, rounds)
    keys = [f"k{i}" for i in range(len(by))]
    timed = df.filter(F.col(time).cast("long").isNotNull())
    rows = timed.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(time).cast("long").alias("f0"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(columns, 1)))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    most_short = min(LONG, (total or 0) * SHARE)
    long = None
    if (most or 0) > most_short:
        names = free_names(keys, df.columns)
        long = stored(sizes.filter(F.col("n") > most_short).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True))))
        rows = rows.join(long.select(*(F.col(n).alias(f"_{k}") for n, k in zip(names, keys, strict=True))), _same(keys, [f"_{k}" for k in keys]), "left_anti")
    of_keys = ", ".join(f"`{c}` {rows.schema[k].dataType.simpleString()}" for c, k in zip(by, keys, strict=True))
    told = f"{of_keys}, {schema}"
    sorted_ = rows.repartition(*keys).sortWithinPartitions(*keys, *(f"f{i}" for i in range(len(columns) + 1)))
    short = sorted_.mapInArrow(_in_order(step, _text(start), finish, keys, to_arrow_schema(StructType.fromDDL(told))), told)
    if long is None:
        return short
    return short.unionByName(_bucketed(timed.join(long, _same(by, names), "left_semi"), by, time, span, columns, start, step, schema, finish, rounds))


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, (F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)))


def _bucketed(df: DataFrame, by: list[str], time: str, span: int, columns: list[str], start: dict, step: Step, schema: str, finish: Callable | None, rounds: int) -> DataFrame:
    """As carried(), for long keys: all buckets at once, then those again that began with another state than was due."""
    keys = [f"k{i}" for i in range(len(by))]
    t = F.col(time).cast("long")
    rows = F.struct(t.alias("f0"), *(F.col(c).alias(f"f{i}") for i, c in enumerate(columns, 1)))
    packed = df.filter(t.isNotNull()).select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), (t - F.pmod(t, F.lit(span))).alias("bucket"), rows.alias("row"))
    packed = packed.groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    packed = stored(packed.withColumn("id", F.monotonically_increasing_id()))
    chain = F.xxhash64(*keys) if keys else F.lit(0)  # only to keep a key together; the order below tells keys apart
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("bucket")
    links = stored(packed.select("id", chain.alias("part"), F.first("id").over(order).alias("chain"), F.lag("id").over(order).alias("prev"), F.lead("id").over(order).isNull().alias("last"), "bucket"))
    fresh = _text(start)
    states = stored(packed.select("id", F.lit(fresh).alias("came"), "rows").mapInArrow(_alone(step), STATES))
    for turn in range(rounds + 1):
        gives = states.select(F.col("id").alias("prev"), F.col("left").alias("gives"))
        due = links.join(gives, "prev", "left").select("id", "chain", F.coalesce("gives", F.lit(fresh)).alias("due"))
        wrong = stored(due.join(states, "id").filter(F.col("due") != F.col("came")).select("id", "chain", F.col("due").alias("came")))
        if wrong.isEmpty():
            break
        if turn < rounds:
            again = packed.select("id", "rows").join(wrong.select("id", "came"), "id").mapInArrow(_alone(step), STATES)
            done = wrong.select("id")
        else:
            own = links.join(wrong.select("chain").distinct(), "chain", "left_semi")
            turns = packed.select("id", "rows").join(own, "id").repartition("part").sortWithinPartitions("part", "chain", "bucket")
            again = turns.select("id", "chain", "rows").mapInArrow(_in_turn(step, fresh), STATES)
            done = own.select("id")
        states = stored(states.join(done, "id", "left_anti").unionByName(again))
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    of_keys = ", ".join(f"`{c}` {packed.schema[k].dataType.simpleString()}" for c, k in zip(by, keys, strict=True))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, came = batch.column("last").to_pylist(), batch.column("came").to_pylist()
            for k in range(batch.num_rows):
                found: list[tuple] = []
                state = _walked(step, batch, k, came[k], found.append)
                if finish and last[k]:
                    finish(state, found.append)
                if found:
                    own = [batch.column(name).take(pa.array([k] * len(found))) for name in keys]
                    values = [pa.array(list(x), field.type) for x, field in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own, *values], [*by, *kinds.names])

    known = packed.join(states.select("id", "came"), "id").join(links.select("id", "last"), "id")
    return known.mapInArrow(told, f"{of_keys}, {schema}" if by else schema)
