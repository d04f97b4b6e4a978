"""Catalogue queries on paging, ranking, sets, edit logs, sources and time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import editlog, paging
from strandline.plans.base import DAY, EVENTS, HOUR, events, table
from strandline.sources import tables


def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    cursor = e.agg(F.floor(F.avg("event_id")).alias("c")).first().c
    return paging.keyset_page(e, "event_id", cursor, 257).select("event_id", "user_id", "event_type")


def byte_capped_page(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("octet_length(text) <= 20000")
    page = paging.byte_page(docs, ["source"], "doc_id", "text", 20_000, F.lit(20))
    return page.select("source", "doc_id", F.octet_length("text").alias("n_bytes"), "next_cursor")


def top1_margin(spark: SparkSession, d: str) -> DataFrame:
    out = paging.top_with_margin(events(spark, d), ["user_id"], "value", "event_id")
    return out.select("user_id", "event_id", F.round("value", 6).alias("value"), F.round("margin", 6).alias("margin"))


def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return paging.even_sample(events(spark, d), ["user_id"], "us", 9).select("user_id", "event_id")


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    buyers, viewers = (e.filter(F.col("event_type") == k).select("user_id", F.floor(F.col("us") / DAY).alias("day")) for k in ("purchase", "view"))
    parts = {"both": buyers.intersect(viewers), "bought_only": buyers.exceptAll(viewers).distinct(), "either": buyers.union(viewers).distinct(), "repeated": buyers.exceptAll(buyers.distinct())}
    out = None
    for name, part in parts.items():
        row = part.agg(F.lit(name).alias("operation"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def op_log_replay(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "error", "clear").otherwise("add")
    out = editlog.replayed(events(spark, d), ["user_id"], ["us", "event_id"], kind, F.col("k"))
    return out.select("user_id", "n_applied", "state")


def undo_chain(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    kind = F.when(F.col("event_type") == "error", "undo").when((F.col("event_type") == "signup") & (F.col("k") < 3), "reset").otherwise("edit")
    return editlog.effective(e.withColumn("edit", kind), ["user_id"], "us", "edit").select("user_id", "event_id")


def head_upsert(spark: SparkSession, d: str) -> DataFrame:
    return editlog.heads(events(spark, d), ["user_id", "event_type"], ["us"], ["event_id", "k"])


def anti_relabel(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return editlog.conflicting(p, ["p_brand", "p_size"], ["p_type"]).select("p_brand", "p_size", "n_contents")


def csv_wide_to_long(spark: SparkSession, d: str) -> DataFrame:
    """Line items as wide detector rows, whose measurements repeat for all joints."""
    i = table(spark, d, "lineitem")
    wide = {"frame_index": F.col("l_orderkey").cast("string"), "time_ms": F.col("l_linenumber").cast("string")}
    for column in tables.wide_columns()[2:]:
        side, joint, part = column.split("_")
        value = {"x": F.col("l_quantity"), "y": F.col("l_extendedprice"), "score": F.col("l_discount")}[part].cast("string")
        wide[column] = F.when(F.lit(joint == "hip"), "NaN").when(F.lit(joint == "knee" and part == "y"), "null").otherwise(value)
    long = tables.wide_to_long(i.select(*(c.alias(n) for n, c in wide.items())))
    return long.groupBy("landmark").agg(F.count("*").alias("n"), F.count("x").alias("n_x"), F.count("y").alias("n_y"), F.count("problem").alias("n_problems"), F.round(F.sum("x"), 2).alias("sum_x"))


def _daily_users(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("at", F.timestamp_micros("us"))


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    w = F.session_window("at", "12 hours")
    out = _daily_users(spark, d).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start"), F.unix_micros("w.end").alias("end"), "n")


def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    out = _daily_users(spark, d).groupBy("event_type", F.window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return out.select("event_type", F.unix_micros("w.start").alias("start"), "n", "mean")


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    out = _daily_users(spark, d).groupBy("event_type", F.window("at", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("event_type", F.unix_micros("w.start").alias("start"), "n")


def cube_events(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("day", F.floor(F.col("us") / DAY))
    return e.cube("event_type", "day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def interval_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Rules on rows, as counts of rows that break them; the clock must rise within each order."""
    i = table(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate")
    i = i.withColumn("_before", F.lag("l_shipdate").over(order))
    rules = {"clock_not_rising": F.col("l_shipdate") <= F.col("_before"), "discount_out_of_range": ~F.col("l_discount").between(0, 1), "quantity_not_positive": F.col("l_quantity") <= 0}
    counts = i.agg(*(F.count_if(broken).alias(name) for name, broken in rules.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))))


def lineitem_pricing(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return i.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))


QUERIES = {f.__name__: f for f in (keyset_page, byte_capped_page, top1_margin, even_sample, set_ops, op_log_replay, undo_chain, head_upsert, anti_relabel, csv_wide_to_long, session_windows, tumbling_windows, sliding_windows, cube_events, interval_constraints, lineitem_pricing)}

ORACLES = {
    "keyset_page": f"WITH {EVENTS} SELECT event_id, user_id, event_type FROM e WHERE event_id > (SELECT floor(avg(event_id)) FROM e) ORDER BY event_id LIMIT 257",
    "byte_capped_page": """WITH p AS (SELECT source, doc_id, strlen(text) AS b, sum(strlen(text)) OVER w AS upto, lead(strlen(text)) OVER w AS following FROM documents WHERE strlen(text) <= 20000 AND doc_id > 20 WINDOW w AS (PARTITION BY source ORDER BY doc_id))
        SELECT source, doc_id, b::INTEGER AS n_bytes, max(CASE WHEN upto + following > 20000 THEN doc_id END) OVER (PARTITION BY source) AS next_cursor FROM p WHERE upto <= 20000""",
    "top1_margin": f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER w AS rank, lead(value) OVER w AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id))
        SELECT user_id, event_id, round(value, 6) AS value, round(value - next, 6) AS margin FROM r WHERE rank = 1""",
    "even_sample": f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us) - 1 AS place, count(*) OVER (PARTITION BY user_id) AS n FROM e)
        SELECT user_id, event_id FROM r WHERE n <= 9 OR place IN (SELECT floor(k * (r.n - 1) / 8.0 + 0.5) FROM range(9) t(k))""",
    "set_ops": f"""WITH {EVENTS}, b AS (SELECT user_id, us // {DAY} AS day FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, us // {DAY} AS day FROM e WHERE event_type = 'view')
        SELECT 'both' AS operation, count(*) AS n FROM (SELECT * FROM b INTERSECT SELECT * FROM v) UNION ALL SELECT 'bought_only', count(*) FROM (SELECT DISTINCT * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM v))
        UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM b UNION SELECT * FROM v) UNION ALL SELECT 'repeated', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT DISTINCT * FROM b)""",
    "op_log_replay": f"""WITH {EVENTS}, o AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'clear' ELSE 'add' END AS kind FROM e),
        l AS (SELECT user_id, max(us) FILTER (kind IN ('set', 'clear')) AS last, count(*) AS n FROM o GROUP BY 1)
        SELECT user_id, any_value(n) AS n_applied, (sum(k) FILTER (kind <> 'clear' AND (last IS NULL OR us >= last)))::BIGINT AS state FROM o JOIN l USING (user_id) GROUP BY 1""",
    "undo_chain": f"""WITH RECURSIVE {EVENTS}, s AS (SELECT *, CASE WHEN event_type = 'error' THEN 'undo' WHEN event_type = 'signup' AND k < 3 THEN 'reset' ELSE 'edit' END AS edit, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM e),
        f(user_id, i, stack) AS (SELECT user_id, 0::BIGINT, []::BIGINT[] FROM s WHERE i = 1
            UNION ALL SELECT s.user_id, s.i, CASE s.edit WHEN 'reset' THEN [] WHEN 'undo' THEN f.stack[1:len(f.stack) - 1] ELSE list_append(f.stack, s.event_id) END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1),
        z AS (SELECT user_id, arg_max(stack, i) AS stack FROM f GROUP BY 1)
        SELECT user_id, unnest(stack) AS event_id FROM z""",
    "head_upsert": f"WITH {EVENTS} SELECT user_id, event_type, arg_max(event_id, us) AS event_id, arg_max(k, us) AS k FROM e GROUP BY 1, 2",
    "anti_relabel": "SELECT p_brand, p_size, count(DISTINCT p_type) AS n_contents FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) > 1",
    "csv_wide_to_long": """WITH n AS (SELECT s || '_' || j AS landmark, j FROM (SELECT unnest(['L', 'R']) AS s), (SELECT unnest(['shoulder', 'elbow', 'wrist', 'hip', 'knee', 'ankle']) AS j)),
        w AS (SELECT landmark, CASE WHEN j <> 'hip' THEN l_quantity END AS x, CASE WHEN j NOT IN ('hip', 'knee') THEN l_extendedprice END AS y, CASE WHEN j <> 'hip' THEN l_discount END AS score FROM lineitem, n)
        SELECT landmark, count(*) AS n, count(x) AS n_x, count(y) AS n_y, count(*) FILTER ((x IS NULL) <> (y IS NULL) OR score NOT BETWEEN 0 AND 1) AS n_problems, round(sum(x), 2) AS sum_x FROM w GROUP BY 1""",
    "session_windows": f"""WITH {EVENTS}, n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {12 * HOUR} THEN 0 ELSE 1 END AS new FROM e),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM n) SELECT user_id, min(us) AS start, max(us) + {12 * HOUR} AS "end", count(*) AS n FROM g GROUP BY user_id, s""",
    "tumbling_windows": f"WITH {EVENTS} SELECT event_type, us // {6 * HOUR} * {6 * HOUR} AS start, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY 1, 2",
    "sliding_windows": f"WITH {EVENTS} SELECT event_type, (us // {6 * HOUR} - b) * {6 * HOUR} AS start, count(*) AS n FROM e, (SELECT unnest([0, 1]) AS b) GROUP BY 1, 2",
    "cube_events": f"WITH {EVENTS} SELECT event_type, us // {DAY} AS day, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY CUBE (event_type, us // {DAY})",
    "interval_constraints": """WITH i AS (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate) AS b FROM lineitem)
        SELECT 'clock_not_rising' AS rule, count(*) FILTER (l_shipdate <= b) AS n FROM i UNION ALL SELECT 'discount_out_of_range', count(*) FILTER (l_discount NOT BETWEEN 0 AND 1) FROM i UNION ALL SELECT 'quantity_not_positive', count(*) FILTER (l_quantity <= 0) FROM i""",
    "lineitem_pricing": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc FROM lineitem GROUP BY 1, 2",
}
