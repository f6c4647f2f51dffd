"""Sinks and the life of an index: chunks, sparse index, points, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricepaper.functions import text as X
from ricepaper.operators import alias, chunking, dense, keywords, sparse
from ricepaper.session import drop_table, new_table_path, path_exists


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what is there; null fields are left out."""
    df.write.mode("overwrite").json(path)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str) -> None:
    """Rows of ``new`` replace those of the table at ``path`` with the same key; doing it twice changes nothing.

    The table is written beside the old one first, so a lost executor leaves the old one whole.
    """
    new = new.dropDuplicates([key])
    merged = new
    if path_exists(spark, path):
        merged = spark.read.parquet(path).join(new.select(key), key, "left_anti").unionByName(new)
    beside = new_table_path(spark, "upsert")
    merged.write.parquet(beside)
    spark.read.parquet(beside).write.mode("overwrite").parquet(path)
    drop_table(spark, beside)


def build_index(spark: SparkSession, documents: DataFrame, path: str, aliases: DataFrame | None = None, size: int = 512, overlap: int = 50, questions: int = 0, rebuild: bool = True) -> DataFrame:
    """Chunk, index and embed ``documents(doc_id, text, …)`` into tables under ``path``; returns one row of counts."""
    if rebuild and path_exists(spark, path):
        drop_table(spark, path)
    chunks = chunking.document_chunks(documents, size, overlap).select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "chunk_index", "text")
    if aliases is not None:
        table = alias.alias_table(aliases)
        codes = table.where("alias_pos < 0").select(F.regexp_extract("canonical", f"^{X.CODE_PREFIX}", 0).alias("token"), "canonical").where("token <> ''")
        chunks = chunking.with_course_ids(chunks, codes.groupBy("token").agg(F.min("canonical").alias("canonical")))
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    sparse.build(chunks, "chunk_id", "text").save(f"{path}/bm25")
    asked = None
    rows = chunks.select("chunk_id", "text")
    if questions:
        tops = keywords.top_keywords(rows, "chunk_id", "text", 6)
        rows = rows.join(tops, "chunk_id", "left")
        asked = X.questions_for(X.guess_title(F.col("text")), F.coalesce("keywords", F.array().cast("array<string>")), questions)
    upsert(spark, f"{path}/points", dense.point_rows(rows, asked), "id")
    return index_status(spark, path)


def index_status(spark: SparkSession, path: str) -> DataFrame:
    """One row: counts of the tables, and whether they have to be built again."""
    n = lambda name: spark.read.parquet(f"{path}/{name}").count() if path_exists(spark, f"{path}/{name}") else 0
    sparse_ok = all(path_exists(spark, f"{path}/bm25/{t}") for t in ("docs", "postings", "terms", "stats"))
    points = n("points")
    return spark.createDataFrame([(n("chunks"), points, sparse_ok, points <= 0 or not sparse_ok)], "n_chunks long, n_points long, sparse_ok boolean, needs_reindex boolean")
