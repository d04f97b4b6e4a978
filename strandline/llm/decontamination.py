"""Benchmark decontamination with DataFrame functions alone.

Benchmark texts become normalised word windows. A bitmap of fixed size, made of
their hashes and sent to every task as one scalar, tells which windows of a
training text may be hits; those few windows are then verified word by word in
a join with the benchmark's windows, broadcast only if their measured size is
within ``BROADCAST_BYTES`` and shuffled otherwise.

Edge cases: null or wordless texts have no words and no hits; an empty
benchmark hits nothing; a null item_id still marks words but is not listed;
item rows that repeat count once; each row of ``docs`` gives one result, also
if a doc_id repeats. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BITMAP_BITS = 24
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and every other character as it is."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: n_words, win (the words joined by a space), items (sorted ids of the items that have it)."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(window))
    wins = F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.concat_ws(" ", F.slice("words", i, n)))
    return (
        words.select("item_id", n.alias("n_words"), F.explode(F.array_distinct(wins)).alias("win"))
        .groupBy("n_words", "win")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )


def _slot(win: Column) -> Column:
    """The number of a window's bit in the bitmap."""
    return F.xxhash64(win).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def _probe(words: Column, start: Column, n: Column) -> Column:
    """The number of a second bit, from a window's first, middle and last word: it leaves few windows to hash as a whole."""
    word = [F.get(words, (start - 1 + offset).cast("int")) for offset in (F.lit(0), F.floor(n / 2), n - 1)]
    return F.xxhash64(*word).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))


def _bitmap(windows: DataFrame) -> DataFrame:
    """One row: bits, an array of 2**BITMAP_BITS / 64 longs."""
    words = F.split("win", " ")
    windows = windows.select(F.explode(F.array(_slot(words), _probe(words, F.lit(1), F.col("n_words")))).alias("slot"))
    slot = F.col("slot")
    cells = windows.select(F.shiftright(slot, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    every = windows.sparkSession.range(1 << (BITMAP_BITS - 6)).withColumnRenamed("id", "cell")
    filled = every.join(cells, "cell", "left").select("cell", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return filled.agg(F.sort_array(F.collect_list(F.struct("cell", "bits"))).alias("all")).select(F.col("all.bits").alias("bits"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of docs: doc_id, text, n_words, hits (array of struct<pos, len>: word positions from 1, sorted) and items (sorted ids).

    text is dropped by the optimiser where it isn't used further.
    """
    windows = benchmark_windows(benchmark, window)
    known = {r.n_words: (r.n, r.size) for r in windows.groupBy("n_words").agg(F.count("*").alias("n"), F.sum(F.octet_length("win") + 8 * F.size("items") + 64).alias("size")).collect()}  # a row for each length up to window
    small = sum(size for _, size in known.values()) <= BROADCAST_BYTES
    bits = F.col("bits")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", words_of(F.col("text")).alias("words"))
    if known:
        texts = texts.select("*", _bitmap(windows).scalar().alias("bits"))

    def may_hit(n: int) -> Column:
        def set_in(slot: Column) -> Column:
            return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

        def test(i: Column) -> Column:
            return set_in(_probe(F.col("words"), i, F.lit(n))) & set_in(_slot(F.slice("words", i, n)))

        at = F.when(F.size("words") >= n, F.sequence(F.lit(1), F.size("words") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(at, test), lambda i: F.struct(i.alias("pos"), F.lit(n).alias("len"), F.concat_ws(" ", F.slice("words", i, n)).alias("win")))

    nothing = F.array().cast("array<struct<pos:int,len:int,win:string>>")
    found = F.concat(nothing, *(may_hit(n) for n in sorted(known)))
    rows = texts.select("row", "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.explode_outer(found).alias("at")).select("row", "doc_id", "text", "n_words", "at.*")
    windows = windows.select(F.col("n_words").alias("len"), "win", "items")
    rows = rows.join(F.broadcast(windows) if small else windows, ["len", "win"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("pos", "len"))
    return rows.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text").alias("text"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(hit)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    ).drop("row")


def covered(hits: Column) -> Column:
    """How many words lie in the union of sorted hits."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(so_far: Column, hit: Column) -> Column:
        end = hit["pos"].cast("long") + hit["len"]
        new = F.greatest(F.lit(0).cast("long"), end - F.greatest(so_far["end"], hit["pos"].cast("long")))
        return F.struct((so_far["n"] + new).alias("n"), F.greatest(so_far["end"], end).alias("end"))

    return F.aggregate(hits, start, add)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row for each row of docs."""
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    n_hit = covered(F.col("hits"))
    return find_hits(docs, benchmark, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents (all columns kept), or with remove='spans' doc_id and text with the hit words taken out.

    A document is named by doc_id and text, so rows that repeat share their fate.
    """
    if remove == "spans":
        runs = F.regexp_extract_all(F.col("text"), F.lit(r"([0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1))
        lead = F.when(F.col("text").rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 1).otherwise(0)
        kept = F.filter("runs", lambda run, i: (F.pmod(i + F.col("lead"), F.lit(2)) == 1) | ~F.exists("hits", lambda h: ((i - F.col("lead")) / 2 + 1 >= h["pos"]) & ((i - F.col("lead")) / 2 + 1 < h["pos"] + h["len"])))
        return find_hits(docs, benchmark, window).withColumns({"runs": runs, "lead": lead}).select("doc_id", F.when(F.size("hits") == 0, F.col("text")).otherwise(F.array_join(kept, "")).alias("text"))
    bad = find_hits(docs, benchmark, window).filter(F.size("hits") > 0).select("doc_id", F.xxhash64("text").alias("text_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_hash"]), "left_anti")
