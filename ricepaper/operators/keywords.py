"""Keywords of a chunk by frequency, ties by first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ricepaper.functions import text as X

# Words that are no keywords.
STOP_WORDS = tuple("and or for the a an of in on at with from by as into to than then that this those these which what when where how why whose while who whom is are was were be been being have has had do does did can could should would may might must shall will".split())


def top_keywords(df: DataFrame, key: str, text: str, k: int = 6, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """``(key, keywords)``: of the 2k most frequent words the first k that have a letter.

    Words have more than two characters and are no stop words. Rows without keywords are left out.
    """
    words = df.select(key, F.posexplode(X.keyword_tokens(F.col(text))).alias("pos", "w")).where(F.length("w") > 2).where(~F.col("w").isin(*stop_words))
    counts = words.groupBy(key, "w").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    tops = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * k).where(F.col("w").rlike(r"\p{L}"))
    kept = F.array_sort(F.collect_list(F.struct("r", "w")))
    return tops.groupBy(key).agg(F.slice(kept, 1, k).alias("ws")).select(key, F.transform("ws", lambda x: x["w"]).alias("keywords"))
