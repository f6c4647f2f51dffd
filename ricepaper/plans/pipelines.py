"""End-to-end pipelines over a table of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ricepaper.functions import text as X
from ricepaper.functions import vectors as V
from ricepaper.operators import alias, dense, fusion, generation, guard, rendering, routing, sparse
from ricepaper.session import materialize

PROMPT = "SYSTEM: Answer from the evidence only.\nEVIDENCE:\n{}\nQUESTION: {}"


def answer(questions: DataFrame, chunks: DataFrame, aliases: DataFrame, generator: Callable[[list[str]], list[str]] = generation.echo, top_k: int = 3, size: int = 64) -> DataFrame:
    """``(query_id, clean_text, intent, route, canonical, n_blocks, answer, error)`` of ``questions(query_id, query)``.

    Guard, resolve, retrieve by both indexes, route, pack, generate. Every question gives one row.
    """
    g = guard.check_input(F.col("query"))
    asked = materialize(questions.withColumn("g", g).select("query_id", F.col("g.clean_text").alias("query")), "asked")
    resolved = alias.resolve(asked, "query_id", "query", aliases).select("query_id", "canonical")
    index = sparse.build(chunks, "chunk_id", "text")
    s = materialize(sparse.top_k(index, asked, "query_id", "query", 12), "sparse")
    # the index holds the chunks' words
    rows = V.hash_embedded(index.words, "doc", "ws", size)
    words = asked.select(F.col("query_id").alias("query"), X.tokens(F.col("query")).alias("ws"))
    qv = materialize(V.hash_embedded(words, "query", "ws", size).withColumnRenamed("v", "qv"), "asked")
    d = materialize(dense.exact_top_k(rows, qv, "doc", "v", "query", "qv", 20).withColumnRenamed("key", "doc"), "dense")
    found = materialize(fusion.retrieve(s, d, rows, qv, top_k=top_k), "found")
    texts = found.join(chunks.select(F.col("chunk_id").alias("doc"), "source", "text"), "doc")
    packed = rendering.pack_evidence(texts, "query", "rank").select(F.col("query").alias("query_id"), "n_blocks", "evidence")
    best = found.groupBy("query").agg(F.collect_list("score").alias("scores")).withColumnRenamed("query", "query_id")
    q = F.col("query")
    joined = asked.join(resolved, "query_id", "left").join(packed, "query_id", "left").join(best, "query_id", "left").withColumn("intent", routing.intent(q, F.size(X.codes(q))))
    none = F.array().cast("array<string>")
    joined = joined.withColumn("route", routing.decide(F.col("intent"), X.codes(q), none, none, F.coalesce("scores", F.array().cast("array<double>")))["route"])
    prompt = F.concat(F.lit(PROMPT.split("{}")[0]), F.coalesce("evidence", F.lit("")), F.lit(PROMPT.split("{}")[1]), F.coalesce(q, F.lit("")))
    made = generation.generate(joined.withColumn("prompt", prompt), "prompt", generator)
    return made.select("query_id", F.col("query").alias("clean_text"), "intent", "route", "canonical", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "answer", "error")
