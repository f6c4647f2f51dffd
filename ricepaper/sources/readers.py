"""Sources: files of documents, chunk and question lines, graphs, aliases.

Every reader is a scan that runs on the executors; nothing is listed or parsed on the driver but
what Spark itself does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ricepaper.functions import text as X

DOCUMENT = "doc_id string, text string, source string, path string, page int, pages int"
CHUNK = "id string, text string, metadata struct<source:string,path:string,pages:int,doc_id:string,chunk_index:int,course_ids:array<string>,questions:array<string>>"
NODE = "id string, name map<string,string>, credits struct<total:int,theory:int,lab:int>, area array<string>, language string, semester string, compulsory string, source string, version string, eligibility struct<min_credits:int,note:string>"
EDGE = "`from` string, `to` string, type string, source string, version string"
#: Suffixes the newer generation keeps; the older keeps every file.
KEPT = (".pdf", ".txt", ".md")


def scan_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """``(path, source, suffix, content)`` of the files below ``folder``; hidden files are left out.

    ``source`` is the path below the folder. Other suffixes than ``suffixes`` are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    root = folder.rstrip("/").split(":", 1)[-1]
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.where(~name.startswith(".")).withColumn("source", F.substring_index(F.col("path"), root + "/", -1)).withColumn("suffix", F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))
    return rows.where(F.col("suffix").isin(*suffixes)) if suffixes else rows


@F.pandas_udf(T.StringType())
def as_text(content: pd.Series) -> pd.Series:
    """UTF-8 text; bytes that are none are dropped."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


class _Nodes(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        self.found.append(data)


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """All text nodes, joined by line ends."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        parser = _Nodes()
        parser.feed(page)
        parser.close()
        return "\n".join(parser.found)

    return pages.map(one, na_action="ignore")


def csv_blocks(df: DataFrame) -> Column:
    """A row as ``key: value`` lines, missing cells as ``None``."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(source, text)``, one block per row."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return df.select(csv_blocks(df).alias("text")).withColumn("source", F.element_at(F.split(F.lit(path), "/"), -1)).select("source", "text")


def read_pages(files: DataFrame, pages_of: Callable[[bytes], list[str]] | None) -> DataFrame:
    """``(source, page, text)`` of PDF files through a reader ``bytes -> pages``; none installed, no rows.

    A file the reader fails on is skipped.
    """
    if pages_of is None:
        return files.select("source", F.lit(1).alias("page"), F.lit("").alias("text")).where("false")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, content in zip(pdf["source"], pdf["content"]):
                try:
                    out += [(source, k + 1, t or "") for k, t in enumerate(pages_of(bytes(content)))]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(out, columns=["source", "page", "text"])

    return files.select("source", "content").mapInPandas(run, "source string, page int, text string")


def load_documents(spark: SparkSession, folder: str, pages_of: Callable[[bytes], list[str]] | None = None, suffixes: tuple[str, ...] | None = None, join_pages: bool = False) -> DataFrame:
    """``(source, page, text)`` of a folder: PDF by page, HTML and Markdown as visible text, the rest as text.

    ``join_pages`` gives one row per PDF with its pages joined. Blank documents are left out.
    """
    files = scan_files(spark, folder, suffixes)
    pdf = read_pages(files.where("suffix = '.pdf'"), pages_of)
    if join_pages:
        pages = F.array_sort(F.collect_list(F.struct("page", "text")))
        pdf = pdf.groupBy("source").agg(F.max("page").alias("page"), F.array_join(F.transform(pages, lambda p: p["text"]), "\n").alias("text")).select("source", "page", "text")
    plain = files.where("suffix <> '.pdf'").withColumn("raw", as_text("content"))
    suffix = F.col("suffix")
    text = F.when(suffix.isin(".html", ".htm"), html_text("raw")).when(suffix.isin(".md", ".markdown"), X.visible_markdown(F.col("raw"))).otherwise(F.col("raw"))
    rows = pdf.unionByName(plain.select("source", F.lit(None).cast("int").alias("page"), text.alias("text")))
    return rows.where(F.col("text").rlike(f"[^{X.WS}]"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; broken lines come out as nulls."""
    return spark.read.schema(CHUNK).json(path)


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``(line, query)`` of question lines, without blank ones; ``limit`` counts raw lines, blank ones included.

    Lines are numbered within one file, which is how such a list is written.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value"))
    if limit is not None:
        lines = lines.where(F.col("line") < limit)
    query = X.strip(F.get_json_object("value", "$.query"))
    return lines.where(F.col("value").rlike(f"[^{X.WS}]")).select("line", query.alias("query")).where("query <> ''")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a graph document: ``[...]``, ``{"nodes": [...]}`` or ``{"data": {...}}``.

    A semester that is a list comes out as its JSON text.
    """
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    nodes = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.nodes", "$.data.nodes")])
    edges = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$.edges", "$.data.edges")])
    item = lambda c, schema: F.from_json(F.to_json(c), schema)
    n = doc.select(F.explode(nodes).alias("x")).where(F.schema_of_variant("x").startswith("OBJECT")).select(item("x", NODE).alias("n")).select("n.*")
    e = doc.select(F.explode(edges).alias("x")).where(F.schema_of_variant("x").startswith("OBJECT")).select(item("x", EDGE).alias("e")).select("e.*")
    return n, e


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``(canon_pos, canonical, aliases)`` of an alias map, in the order of the file."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return doc.select(F.posexplode(F.map_entries("m")).alias("canon_pos", "e")).select("canon_pos", F.col("e.key").alias("canonical"), F.col("e.value").alias("aliases"))
