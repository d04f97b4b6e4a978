"""The numbered queries of the training-data operators, each over its whole table, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import centroids, decontamination, fm_index, grace, jaccard, language, mixing, ngram_lm, pii, substrings, topk, toxicity, trie
from strandline.llm.tables import read


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(read(spark, sf_dir, "documents"), kept_bytes=False)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(read(spark, sf_dir, "documents")).drop("source")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_languages(read(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.held_out_scores(read(spark, sf_dir, "documents"))


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.removed(read(spark, sf_dir, "documents")).drop("kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(read(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace.classes(read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.prefixes(read(spark, sf_dir, "conversations"))
    conv_id = F.col("conv_id")
    return trie.trie(trie.rebuilt(turns, conv_id - conv_id % 20, F.crc32(conv_id.cast("string")) % 4))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array": op1_suffix_array,
        "op2_personal_data": op2_personal_data,
        "op3_mixing": op3_mixing,
        "op4_language": op4_language,
        "op5_language_model": op5_language_model,
        "op6_fm_index": op6_fm_index,
        "op7_toxicity": op7_toxicity,
        "op8_benchmark_decontamination": op8_benchmark_decontamination,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_top_k": op10_top_k,
        "op11_centroids": op11_centroids,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_prefix_trie": op13_prefix_trie,
    }


def _lloyd_rounds(rounds: int) -> str:
    """a0, c1, a1 ... as SQL: nearest centroids of c0, centroids moved to them, and so on."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
            SELECT r, any_value(vec_id) AS vec_id, min(c) FILTER (d = least) AS c, any_value(least) AS distance
            FROM (SELECT *, min(d) OVER (PARTITION BY r) AS least FROM (
                SELECT r, vec_id, c, (list_dot_product(v, v) + list_dot_product(m, m) - 2 * list_dot_product(v, m))::BIGINT AS d
                FROM v CROSS JOIN c{k}))
            GROUP BY r)""")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
            SELECT c, coalesce(moved, m) AS m FROM c{k} LEFT JOIN (
                SELECT c, list(x ORDER BY j) AS moved FROM (
                    SELECT c, j, CAST(sum(x) // count(*) - (sum(x) % count(*) < 0)::INTEGER AS BIGINT) AS x
                    FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM v JOIN a{k} USING (r)) GROUP BY c, j)
                GROUP BY c) USING (c))""")
    return ",\n        ".join(steps)


ORACLES = {
    "op1_suffix_array": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (
            SELECT r, doc_id, unnest([substr(h, 2 * k - 1, 100) FOR k IN range(1, len(h) // 2 + 1)]) AS s,
                unnest(range(1, len(h) // 2 + 1)) AS k
            FROM d),
        f AS (SELECT s, min(doc_id) AS first FROM b WHERE len(s) = 100 GROUP BY s),
        t AS (SELECT b.r, b.k, b.s[1:2] AS x, coalesce(f.first < b.doc_id, false) AS hit FROM b LEFT JOIN f ON b.s = f.s),
        c AS (SELECT r, k, x, bool_or(hit) OVER (PARTITION BY r ORDER BY k ROWS 49 PRECEDING) AS gone FROM t),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY k), false) AS begins FROM c),
        g AS (
            SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
                string_agg(x, '' ORDER BY k) FILTER (NOT gone) AS kept
            FROM e GROUP BY r)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
            coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN g USING (r)""",
    "op6_fm_index": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        p AS (
            SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s
            FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        gone AS (
            SELECT DISTINCT r, unnest(range(i, i + 35)) AS k
            FROM p WHERE s IN (SELECT s FROM p GROUP BY s HAVING count(*) > 1)),
        words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY k) AS t FROM words ANTI JOIN gone USING (r, k) GROUP BY r),
        n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        sh AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
            FROM sh AS a JOIN sh AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (
            SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id
            WHERE 100 * o >= 85 * (x.n + y.n - o)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        c(node, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, c.seen FROM c JOIN e ON c.node = e.a),
        m AS (SELECT node, min(seen) AS low FROM c GROUP BY node)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON node = d.doc_id""",
    "op8_benchmark_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents),
        b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, w[i:i + least(len(w), 10) - 1] AS win
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
        dw AS (
            SELECT r, i, n, w[i:i + n - 1] AS win
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
        hit AS (SELECT r, i, bw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
        words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
        items AS (
            SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)""",
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_centroids": f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
            FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m
            FROM v QUALIFY c < 40),
        {_lloyd_rounds(5)},
        t AS (SELECT a5.*, m FROM a5 JOIN c5 USING (c))
        SELECT vec_id, c::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
            (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
        FROM t""",
    "op12_exact_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST, r)""",
    "op13_prefix_trie": r"""
        WITH o AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
                list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
                    lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 4 AS h
            FROM (SELECT DISTINCT conv_id FROM o)),
        r AS (
            SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN o ON o.conv_id = base AND i < h
            UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND i >= h),
        s AS (
            SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, i) FILTER (part IS NOT NULL), []) AS turns
            FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
        p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM s),
        n AS (
            SELECT depth, turns[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
                string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = len(turns)) AS ids
            FROM p GROUP BY ALL),
        m AS (
            SELECT n.*, up.conv_id AS parent_conv_id, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) *
                len(list_filter(regexp_split_to_array(n.prefix[n.depth].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS own
            FROM n LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.prefix = n.prefix[1:n.depth - 1]),
        k AS (
            SELECT *, (SELECT count(*) FROM m AS x WHERE x.depth = m.depth + 1 AND x.prefix[1:m.depth] = m.prefix) AS n_children
            FROM m),
        b AS (SELECT k.*, unnest(range(0, depth + 1)) AS level FROM k),
        t AS (SELECT level, prefix[1:level] AS top, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM b GROUP BY ALL)
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens,
            sha256(coalesce(ids, '')) AS ends_sha256
        FROM k JOIN t ON level = depth AND top = prefix""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
