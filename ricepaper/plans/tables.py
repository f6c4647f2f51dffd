"""Input tables in the form the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricepaper.session import among, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_rows(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """``(chunk_id, text, doc_id, chunk_index, source, course_ids)``, or only the ``fields`` of these that are
    named, which then are all that is shuffled; repeated rows once."""
    m = F.col("metadata")
    rows = table(spark, sf_dir, "chunks").where("id is not null")
    have = {"text": F.col("text"), **{x: m[x].alias(x) for x in ("doc_id", "chunk_index", "source", "course_ids")}}
    return rows.groupBy(F.col("id").alias("chunk_id")).agg(F.min_by(F.struct(*(have[x] for x in fields or have)), F.col("indexed_at")).alias("r")).select("chunk_id", "r.*")


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_rows(spark, sf_dir, "text")``, but only the texts of ids that may stand in several rows are shuffled."""
    rows = table(spark, sf_dir, "chunks").where("id is not null").select(F.col("id").alias("chunk_id"), "text", "indexed_at")
    counts = rows.groupBy(F.xxhash64("chunk_id").alias("h")).agg(F.count("*").alias("n"))
    repeated = among(rows, "chunk_id", materialize(counts.where("n > 1").select("h"), "repeated"))
    if repeated is None:
        return chunk_rows(spark, sf_dir, "text")
    inside, outside = repeated
    first = inside.groupBy("chunk_id").agg(F.min_by(F.struct("text"), F.col("indexed_at")).alias("r")).select("chunk_id", "r.text")
    # min_by passes over rows without a time
    return outside.select("chunk_id", F.when(F.col("indexed_at").isNotNull(), F.col("text")).alias("text")).unionByName(first)


def sql_chunk_rows() -> str:
    return """SELECT chunk_id, r.text AS text, r.doc_id AS doc_id, r.chunk_index AS chunk_index, r.source AS source, r.course_ids AS course_ids FROM (
        SELECT id AS chunk_id, arg_min({'text': text, 'doc_id': metadata.doc_id, 'chunk_index': metadata.chunk_index, 'source': metadata.source, 'course_ids': metadata.course_ids}, indexed_at) AS r
        FROM chunks WHERE id IS NOT NULL GROUP BY id)"""
