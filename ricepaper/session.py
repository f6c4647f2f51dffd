"""Session factory and the shared work folder used to cut long lineages."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashes of keys broadcast at most (:func:`among`).
HASHES = 500_000


def get_spark(app: str = "ricepaper", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; explicit ``conf`` wins."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="ricepaper-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(folder, "ricepaper.zip")
    with zipfile.ZipFile(target, "w") as out:
        for place, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    out.write(full, os.path.join("ricepaper", os.path.relpath(full, package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder of its own.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ricepaper-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage is cut, the write survives the loss of executors and, unlike a reliable RDD
    checkpoint, the plan runs once and later reads can prune columns.
    """
    path = new_table_path(df.sparkSession, label)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._table_path = path
    return made


def release(df: DataFrame) -> None:
    """Drop the table behind ``df``, made by :func:`materialize`, which nothing reads any more."""
    if path := getattr(df, "_table_path", None):
        drop_table(df.sparkSession, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table made by :func:`materialize` once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few_tasks(df: DataFrame) -> DataFrame:
    """At most two tasks a core: for steps whose output is bounded for each task, not by its rows."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def among(rows: DataFrame, key: str, hashes: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The rows whose ``xxhash64`` of ``key`` is in ``hashes(h)``, a materialized table without repeats, and the others.

    Keys may share a hash, so the first have all rows that a join on ``key`` can find, and perhaps more:
    they are what it needs to shuffle. None if there are more than ``HASHES`` hashes to broadcast.
    """
    if hashes.count() > HASHES:
        return None
    on, known = F.xxhash64(key) == F.col("h"), F.broadcast(hashes)
    return rows.join(known, on, "left_semi"), rows.join(known, on, "left_anti")
