"""Chunking as table-generating operators; windows come from closed-form positions, not loops.

A text without words gives no chunks; null texts give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ricepaper.functions import text as X


def _windows(parts: Column, size: int, overlap: int) -> Column:
    """Joined windows of ``size`` parts, each starting ``size - overlap`` after the last, ending with the last part."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size(parts) - size) / F.lit(float(step)))).cast("int")
    made = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(parts, k * step + 1, size), " "))
    return F.when(F.size(parts) > 0, made).otherwise(F.array().cast("array<string>"))


def _explode(df: DataFrame, windows: Column, name: str = "chunk", index: str = "chunk_index") -> DataFrame:
    return df.select(*df.columns, F.posexplode(windows).alias(index, name)).withColumn(index, F.col(index).cast("int"))


def by_words(df: DataFrame, text: str = "text", size: int = 512, overlap: int = 50) -> DataFrame:
    return _explode(df.where(F.col(text).isNotNull()).withColumn("__parts", X.tokens(F.col(text), lower=False)), _windows(F.col("__parts"), size, overlap)).drop("__parts")


def sentences(c: Column) -> Column:
    """Sentences end with a mark followed by blanks and a capital, an accented letter or a digit."""
    parts = F.split(X.collapse(c), r"(?<=[.!?\x{2026}])[ ]+(?=[A-Z\x{c0}-\x{1ef4}0-9])")
    return F.filter(F.transform(parts, X.strip), lambda s: s != "")


def by_sentences(df: DataFrame, text: str = "text", size: int = 3, overlap: int = 1) -> DataFrame:
    return _explode(df.where(F.col(text).isNotNull()).withColumn("__parts", sentences(F.col(text))), _windows(F.col("__parts"), size, overlap)).drop("__parts")


def by_headings(df: DataFrame, text: str = "text", patterns: list[str] | None = None) -> DataFrame:
    """One row per section; each starts at a line that begins with a pattern. No patterns, one section."""
    rows = df.where(F.col(text).isNotNull())
    c = F.col(text)
    parts = F.split(c, f"(?m)(?=^(?:{'|'.join(patterns)}))") if patterns else F.array(c)
    return _explode(rows, F.filter(F.transform(parts, X.strip), lambda s: s != ""), "section", "section_index")


def make_chunks(df: DataFrame, text: str = "text", method: str = "words", size: int = 512, overlap: int = 50) -> DataFrame:
    return (by_sentences if method == "sentence" else by_words)(df, text, size, overlap)


def document_chunks(documents: DataFrame, size: int = 512, overlap: int = 50, method: str = "words") -> DataFrame:
    """Cleaned chunks with ids ``<doc>#chunk_<n>`` and their document's fields."""
    clean = documents.withColumn("text", X.normalize_text(F.col("text")))
    made = make_chunks(clean, "text", method, size, overlap).where(X.strip(F.col("chunk")) != "")
    return made.withColumn("text", F.col("chunk")).drop("chunk").withColumn("chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("#chunk_"), "chunk_index"))


def with_course_ids(chunks: DataFrame, normalized: DataFrame) -> DataFrame:
    """Chunks with the canonical ids of the code prefixes they mention; ``normalized(token, canonical)``.

    A token that names no course is dropped, not stored as a message.
    """
    mentions = chunks.select("chunk_id", F.explode(X.code_prefixes(F.col("text"))).alias("token"))
    ids = mentions.join(normalized, "token").groupBy("chunk_id").agg(F.array_sort(F.collect_set("canonical")).alias("course_ids"))
    return chunks.drop("course_ids").join(ids, "chunk_id", "left")
