"""Streaming forms of the batch operators; an extension, as the reference has no streams.

State is bounded by watermarks; sinks are tables in a shared folder, written once per batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ricepaper.functions import text as X
from ricepaper.operators import guard, routing
from ricepaper.session import new_table_path


def routed(questions: DataFrame) -> DataFrame:
    """Guard and intent of a stream (or table) of ``(query_id, query)``; stateless."""
    g = guard.check_input(F.col("query"))["clean_text"]
    return questions.select("query_id", g.alias("clean_text"), routing.intent(g, F.size(X.codes(g))).alias("intent"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per tumbling window and type, late rows up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote.

    ``complete`` replaces the table with each batch; batches carry their id, so a batch done again
    after a failure replaces itself.
    """
    spark = SparkSession.getActiveSession()
    path, state = new_table_path(spark, "stream"), new_table_path(spark, "streamstate")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = spark.read.schema(stream.schema).parquet(path)
    return out


def read_table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if not _is_file(spark, path) else f"{folder}/{name[:-8]}*.parquet")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
