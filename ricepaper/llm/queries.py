"""Queries over the llm operators and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricepaper.llm import encoding, lookalike, neighbours, noise, packing, pairs, reading


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.noise_cases(_table(spark, sf_dir, "chunks"))


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's text as continuous paragraphs."""
    return noise.repaired_texts(_table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_look_pairs(_table(spark, sf_dir, "knowledge_graph"), _table(spark, sf_dir, "aliases"))


def p2_canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lookalike.course_names(_table(spark, sf_dir, "knowledge_graph"))
    return lookalike.with_canonical(names, "name")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defects(_table(spark, sf_dir, "answers"))


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label that passes its cutoff, several of a pair included."""
    return pairs.defect_labels(_table(spark, sf_dir, "answers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_pairs(_table(spark, sf_dir, "points"))


def p5_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar of every point whose id, as a number, is divisible by 50."""
    asked = F.conv(F.substring("id", -8, 8), 16, 10).cast("long") % 50 == 0
    return neighbours.nearest(neighbours.chunk_points(_table(spark, sf_dir, "points")), 5, queries=asked)


def p5_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar of every point, by the setting of p5_found."""
    return neighbours.nearest(neighbours.chunk_points(_table(spark, sf_dir, "points")), 5)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that comes back from the ids of each text; null comes back as an empty one."""
    coded = encoding.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = encoding.decode(coded)
    return back.select("doc_id", "decoded")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = encoding.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(sized.select("doc_id", "n_tokens"), _table(spark, sf_dir, "prompt_windows"))


def p7_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(packing.materialize(_packed(spark, sf_dir), "packed"), _table(spark, sf_dir, "prompt_windows"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "reading_labels"))


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and level."""
    levels = p8_found(spark, sf_dir)
    return levels.join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p2_found": p2_found,
    "p2_canonical_names": p2_canonical_names,
    "p3_found": p3_found,
    "p3_labels": p3_labels,
    "p5_found": p5_found,
    "p5_top5": p5_top5,
    "p5_every": p5_every,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
    "p7_prompts": p7_prompts,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_profile": p8_profile,
}

SQL: dict[str, str] = {
    "p5_found": """
        WITH v AS (
            SELECT DISTINCT id, vector::DOUBLE[] AS v FROM points
            WHERE payload.synthetic_question IS NULL AND id IS NOT NULL AND len(vector) = 64
              AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(vector, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim
            FROM v a JOIN v b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.9
        ), r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS place FROM s)
        SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM r WHERE place <= 5""",
    "p6_roundtrip": "SELECT doc_id, coalesce(text, '') AS decoded FROM documents",
}
