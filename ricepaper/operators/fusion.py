"""Merging, normalising and diversifying search results.

Results are long tables ``(query, doc, score)``. Diversity works on at most a few dozen candidates
of a query, which one row holds, in Arrow batches; no job per step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidates(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Full outer merge of ``(query, doc, score)`` results; a score a side lacks is null.

    ``place`` is the order in which candidates came: sparse ones by rank, then dense ones.
    """
    s = sparse.select("query", "doc", F.col("score").alias("sparse"), F.col("rank").alias("r1"))
    d = dense.select("query", "doc", F.col("score").alias("dense"), F.col("rank").alias("r2"))
    both = s.join(d, ["query", "doc"], "full_outer")
    order = Window.partitionBy("query").orderBy(F.col("r1").asc_nulls_last(), F.col("r2").asc_nulls_last())
    return both.withColumn("place", F.row_number().over(order)).select("query", "doc", "sparse", "dense", "place")


def min_max(score: Column, query: str = "query") -> Column:
    """A missing score counts as 0 before scaling; equal scores all become 0."""
    w = Window.partitionBy(query)
    s = F.coalesce(score, F.lit(0.0))
    low, high = F.min(s).over(w), F.max(s).over(w)
    return F.when(high > low, (s - low) / (high - low)).otherwise(F.lit(0.0))


def blend(merged: DataFrame, alpha: float = 0.6, mode: str = "hybrid") -> DataFrame:
    """Adds ``sparse_norm``, ``dense_norm`` and ``score``; modes: hybrid, dense-only, sparse-only."""
    out = merged.withColumn("sparse_norm", min_max(F.col("sparse"))).withColumn("dense_norm", min_max(F.col("dense")))
    score = {"dense-only": F.col("dense_norm"), "sparse-only": F.col("sparse_norm")}.get(mode, alpha * F.col("dense_norm") + (1 - alpha) * F.col("sparse_norm"))
    return out.withColumn("score", F.round(score, 6))


def mmr(cands: DataFrame, query: str, doc: str, vector: str, query_vector: str, k: int, lam: float, order: str, shrinking: bool = False) -> DataFrame:
    """Maximal marginal relevance: ``(query, pick, doc)``.

    Each pick has the greatest ``lam * sim(query) - (1 - lam) * max sim(picked)``, the first of equals
    by ``order``. With ``shrinking`` a query of no more than ``k`` candidates gives one pick less (at
    least one), the older generation's behaviour.
    """
    rows = cands.select(F.col(query).alias("query"), F.col(query_vector).alias("qv"), F.struct(F.col(order).alias("o"), F.col(doc).alias("doc"), F.col(vector).cast("array<double>").alias("v")).alias("c"))
    lists = rows.groupBy("query").agg(F.first("qv").cast("array<double>").alias("qv"), F.array_sort(F.collect_list("c")).alias("cs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            begin = np.asarray(lists.offsets)
            own = lists.flatten()
            begin = begin - begin[0]
            vectors, asked = own.field("v").to_pylist(), b.column(1).to_pylist()
            row, pick, at = [], [], []
            for i, q in enumerate(asked):
                picked = _picks(vectors[begin[i] : begin[i + 1]], q, k, lam, shrinking)
                row += [i] * len(picked)
                pick += range(1, len(picked) + 1)
                at += [begin[i] + p for p in picked]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(pick, pa.int32()), own.field("doc").take(pa.array(at, pa.int64()))], names=["query", "pick", "doc"])

    kinds = dict(cands.dtypes)
    return lists.select("query", "qv", "cs").mapInArrow(run, f"query {kinds[query]}, pick int, doc {kinds[doc]}")


def _round(x: np.ndarray) -> np.ndarray:
    """To nine decimals, halves away from zero, as SQL does."""
    return np.sign(x) * np.floor(np.abs(x) * 1e9 + 0.5) / 1e9


def _picks(vectors: list[list[float] | None], asked: list[float], k: int, lam: float, shrinking: bool) -> list[int]:
    """Places of the candidates picked, in order; those without a vector come last."""
    n = len(vectors)
    there = np.array([v is not None for v in vectors])
    x = np.array([v if v is not None else [0.0] * len(asked) for v in vectors], dtype=float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None] + 1e-10
    q = np.array(asked, dtype=float)
    q /= np.sqrt(q @ q) + 1e-10
    sim = np.where(there, _round(x @ q), -1e9)
    near, picked = np.full(n, -np.inf), []
    for _ in range(max(1, n - 1) if shrinking and n <= k else min(k, n)):
        value = _round(lam * sim - (1 - lam) * np.where(np.isinf(near), 0.0, near))
        value[picked] = -np.inf
        picked.append(int(np.argmax(value)))
        near = np.maximum(near, _round(x @ x[picked[-1]]))
    return picked


def retrieve(sparse: DataFrame, dense: DataFrame, vectors: DataFrame, query_vectors: DataFrame, top_k: int = 6, mmr_k: int = 12, alpha: float = 0.6, lam: float = 0.5, mode: str = "hybrid") -> DataFrame:
    """Merge, blend, diversify to ``mmr_k``, order by blended score and keep ``top_k``.

    ``vectors(doc, v)`` and ``query_vectors(query, qv)``. Returns ``(query, rank, doc, score)``.
    """
    fused = blend(candidates(sparse, dense), alpha, mode)
    rows = fused.join(vectors, "doc").join(query_vectors, "query")
    picked = mmr(rows, "query", "doc", "v", "qv", mmr_k, lam, "place")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "pick")
    best = picked.join(fused.select("query", "doc", "score"), ["query", "doc"])
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("query", "rank", "doc", "score")


def citations(found: DataFrame, chunks: DataFrame, most: int = 4) -> DataFrame:
    """``(query, rank, source, chunk_id)`` of the first results."""
    return found.where(F.col("rank") <= most).join(chunks.select(F.col("chunk_id").alias("doc"), "source"), "doc", "left").select("query", "rank", "source", F.col("doc").alias("chunk_id"))
