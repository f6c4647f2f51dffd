"""Index life cycle, pipeline, streaming and relational queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ricepaper.functions import text as X
from ricepaper.plans import pipelines
from ricepaper.plans.tables import chunk_rows, sql_chunk_rows, table
from ricepaper.session import new_table_path
from ricepaper.sources import writers
from ricepaper.streaming import queries as streams


def upsert_latest(spark, d):
    """The latest row of each chunk id, as an upsert by id keeps it."""
    rows = table(spark, d, "chunks").where("id is not null")
    return rows.groupBy("id").agg(F.max("indexed_at").alias("indexed_at"), F.count("*").alias("n_rows")).select("id", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"), "n_rows")


def dedupe_ordered(spark, d):
    """Ordered distinct course ids of a chunk."""
    return chunk_rows(spark, d).where("course_ids is not null").select("chunk_id", F.array_join(F.array_distinct("course_ids"), ",").alias("course_ids"))


def index_build(spark, d):
    """Chunk, index and embed all documents; the counts of the tables."""
    return writers.build_index(spark, table(spark, d, "documents").select("doc_id", "text"), new_table_path(spark, "index"))


def pipeline_answers(spark, d):
    """The whole pipeline over every fiftieth question, with the offline generator."""
    q = table(spark, d, "answers").where("answer_id % 50 = 0 and query is not null").groupBy(F.col("answer_id").alias("query_id")).agg(F.min("query").alias("query"))
    return pipelines.answer(q, chunk_rows(spark, d, "text", "source"), table(spark, d, "aliases")).select("query_id", "clean_text", "intent", "route", "answer", "error")


def batch_answers(spark, d):
    """Answers as the batch runner writes them: one JSON object a question."""
    rows = table(spark, d, "answers").select("answer_id", "query", "answer", "error").distinct()
    return rows.select("answer_id", F.to_json(F.struct("query", "answer", "error")).alias("line"))


def html_visible(spark, d):
    """Visible text of pages made from documents: the source and the whole text with its own markup, tags and entities removed."""
    page = F.concat(F.lit("<p>"), F.coalesce("source", F.lit("")), F.lit("</p>"), F.coalesce("text", F.lit("")), F.lit("<b>a&amp;b</b>"))
    return table(spark, d, "documents").select("doc_id", X.visible_html(page).alias("text"))


def prompt_parts(spark, d):
    prompt = F.concat(F.lit("SYSTEM: be brief\nEVIDENCE: none\nQUESTION: "), "query")
    s = X.split_prompt(prompt)
    rows = table(spark, d, "answers").where("query is not null").select("answer_id", "query").distinct()
    return rows.select("answer_id", s["system"].alias("system"), s["user"].alias("user"), X.between(prompt, "EVIDENCE:", "QUESTION:").alias("evidence"), X.cut(F.col("query"), 20, "…").alias("preview"))


def stream_event_windows(spark, d):
    s = streams.run_to_table(streams.windowed_counts(streams.read_table_stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour"), "complete")
    return s.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_routes(spark, d):
    q = streams.read_table_stream(spark, f"{d}/answers.parquet").where("query is not null").select(F.col("answer_id").alias("query_id"), "query")
    return streams.run_to_table(streams.routed(q)).groupBy("intent").agg(F.count("*").alias("n"))


def event_sessions(spark, d):
    s = streams.sessions(table(spark, d, "events"))
    return s.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def revenue_rollup(spark, d):
    rows = table(spark, d, "lineitem")
    r = rows.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return r


def customer_order_gaps(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders")
    return rows.select("o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).alias("days"), F.ntile(4).over(w).alias("quarter"))


QUERIES = {f.__name__: f for f in (upsert_latest, dedupe_ordered, index_build, pipeline_answers, batch_answers, html_visible, prompt_parts, stream_event_windows, stream_routes, event_sessions, revenue_rollup, customer_order_gaps)}

SQL = {
    "upsert_latest": "SELECT id, strftime(max(indexed_at), '%Y-%m-%d %H:%M:%S') AS indexed_at, count(*) AS n_rows FROM chunks WHERE id IS NOT NULL GROUP BY id",
    "dedupe_ordered": f"SELECT chunk_id, array_to_string(list_filter(course_ids, lambda x, i: list_position(course_ids, x) = i), ',') AS course_ids FROM ({sql_chunk_rows()}) WHERE course_ids IS NOT NULL",
    "html_visible": r"""
        WITH page AS (SELECT doc_id, '<p>' || coalesce(source, '') || '</p>' || coalesce(text, '') || '<b>a&amp;b</b>' AS p FROM documents),
        bare AS (SELECT doc_id, regexp_replace(regexp_replace(p, '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g') AS t FROM page)
        SELECT doc_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS text FROM bare""",
    "prompt_parts": f"""
        SELECT DISTINCT answer_id, 'be brief' AS system, regexp_replace('EVIDENCE: none' || chr(10) || 'QUESTION: ' || query, '[{X.WS}]+$', '') AS user, 'none' AS evidence,
            CASE WHEN length(query) > 20 THEN substr(query, 1, 20) || '…' ELSE query END AS preview FROM answers WHERE query IS NOT NULL""",
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "revenue_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "customer_order_gaps": """
        SELECT o_orderkey, CAST(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS INTEGER) AS days, CAST(ntile(4) OVER w AS INTEGER) AS quarter
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
}
