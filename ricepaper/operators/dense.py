"""Dense search over array columns: exact top-k of a stated query set against all rows, in blocks.

Queries go to the tasks in blocks of at most ``BLOCK`` rows (a bound on what is broadcast);
each task keeps its own best ``k`` per query over all its batches, so the shuffle holds ``k`` rows per
query and task, not one per pair or batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ricepaper.functions import vectors as V
from ricepaper.operators.best import Best, first, ranks
from ricepaper.session import few_tasks, materialize

#: Query vectors broadcast at a time (20,000 x 64 doubles: 10 MB).
BLOCK = 20_000
#: How far a cosine in single precision may be off, rounding to six decimals included.
MARGIN = 2e-5


def _matrix(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of usable vectors of the commonest length, and their positions."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    offsets = np.asarray(lists.offsets)
    sizes = np.diff(offsets)
    valid = np.asarray(lists.is_valid())
    if not valid.any():
        return np.zeros((0, 0)), np.zeros(0, dtype=np.int64)
    dim = int(np.bincount(sizes[valid]).argmax())
    good = np.flatnonzero(valid & (sizes == dim))
    flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    rows = flat[offsets[good][:, None] + np.arange(dim)]
    ok = np.isfinite(rows).all(axis=1) & (np.abs(rows).sum(axis=1) > 0)
    return rows[ok], good[ok]


def exact_top_k(rows: DataFrame, queries: DataFrame, key: str, vector: str, query: str, query_vector: str, k: int, metric: str = "cosine", exclude_same: bool = False) -> DataFrame:
    """``(query, rank, key, score)`` by cosine, inner product ('ip') or ``1 / (1 + ip)`` ('inverse_ip').

    Unusable vectors are left out on both sides. Scores are rounded to six decimals before ranking;
    ties go to the smaller key. ``inverse_ip`` ranks the larger product lower, as the older index
    generation did.
    """
    spark = rows.sparkSession
    asked = materialize(queries.select(F.col(query).alias("q"), F.col(query_vector).alias("v")), "asked")
    numbered = asked.count()
    blocks = max(1, -(-numbered // BLOCK))
    made: DataFrame | None = None
    key_type, query_type = dict(rows.dtypes)[key], dict(queries.dtypes)[query]
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        got = part.toArrow()
        q, at = _matrix(got.column(1).combine_chunks()) if got.num_rows else (np.zeros((0, 0)), np.zeros(0, dtype=np.int64))
        names = got.column(0).take(pa.array(at)).combine_chunks()
        shared = spark.sparkContext.broadcast((q, names))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, names = shared.value
            if not len(q):
                return
            unit = q / np.linalg.norm(q, axis=1)[:, None] if metric == "cosine" else q
            # a product in single precision leaves out what cannot be among the best
            rough, margin = (unit.astype(np.float32), MARGIN) if metric == "cosine" else (unit, 1e-6)
            best = Best(len(q), k)

            def exact(ip: np.ndarray) -> np.ndarray:
                with np.errstate(divide="ignore"):
                    score = np.round(1.0 / (1.0 + ip) if metric == "inverse_ip" else ip, 6)
                return np.where(np.isfinite(score), score, -np.inf)

            for b in batches:
                x, good = _matrix(b.column(1))
                if not len(x) or x.shape[1] != q.shape[1]:
                    continue
                if metric == "cosine":
                    x = x / np.linalg.norm(x, axis=1)[:, None]
                keys = b.column(0).take(pa.array(good))
                at, most = ranks(keys)
                # in the order of keys, the first of equals is the one to keep
                order = np.argsort(at, kind="stable")
                x, keys = x[order], keys.take(pa.array(order))
                wanted = (k + exclude_same) * most
                rough_x = np.ascontiguousarray(x.astype(rough.dtype).T)
                for s in range(0, len(q), 256):
                    sims = rough[s : s + 256] @ rough_x
                    if metric == "inverse_ip":
                        sims = exact(sims)
                    need = best.least[s : s + 256] - margin
                    new = np.flatnonzero(np.isneginf(need))
                    if len(new) and wanted < sims.shape[1]:
                        need[new] = np.partition(sims[new], -wanted, axis=1)[:, -wanted] - 2 * margin
                    row, col = np.nonzero(sims >= need.astype(sims.dtype)[:, None])
                    # a query with very many equals has its own, exact cut
                    many = np.flatnonzero(np.bincount(row, minlength=len(sims)) > 50 + 4 * wanted)
                    if len(many):
                        keep = ~np.isin(row, many)
                        row, col = row[keep], col[keep]
                        cuts = [first(exact(x @ unit[s + r]), wanted) for r in many]
                        row = np.concatenate([row, np.repeat(many, [len(c) for c in cuts])])
                        col = np.concatenate([col, *cuts])
                    score = exact(np.einsum("ij,ij->i", unit[s + row], x[col]))
                    keep = (score >= best.least[s + row]) & np.isfinite(score)
                    row, col, score = row[keep] + s, col[keep], score[keep]
                    if exclude_same and len(row):
                        keep = np.array([n != v for n, v in zip(names.take(pa.array(row)).to_pylist(), keys.take(pa.array(col)).to_pylist())])
                        row, col, score = row[keep], col[keep], score[keep]
                    best.add(row, score, keys.take(pa.array(col)))
            if kept := best.rows():
                yield pa.RecordBatch.from_arrays([names.take(pa.array(kept[0])), kept[2], pa.array(kept[1])], names=["query", "key", "score"])

        found = few_tasks(rows.select(F.col(key).alias("key"), F.col(vector).alias("v"))).mapInArrow(run, f"query {query_type}, key {key_type}, score double")
        made = found if made is None else made.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    # repeated rows of a key count once; one shuffle serves both steps
    best = made.repartition("query").groupBy("query", "key").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def semantic_best(tokens: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """For each ``group`` of ``tokens(group, token_pos, v)`` the best of ``candidates(cand_pos, name, w)``.

    The flat argmax of all products: greatest score, then first token, then first candidate.
    """
    pairs = exact_top_k(candidates.withColumn("k", F.struct("cand_pos", "name")), tokens.withColumn("q", F.struct(group, "token_pos")), "k", "w", "q", "v", 1)
    best = F.min_by(F.struct(F.col("key.name").alias("name"), "score"), F.struct(-F.col("score"), F.col("query.token_pos"), F.col("key.cand_pos")))
    return pairs.groupBy(F.col(f"query.{group}").alias(group)).agg(best.alias("b")).select(group, "b.name", "b.score")


def point_rows(chunks: DataFrame, questions: Column | None = None, size: int = 64) -> DataFrame:
    """Points of chunks ``(chunk_id, text)`` and of their questions, embedded by hash.

    Ids are digests of their parts, so building twice gives the same points.
    """
    from ricepaper.functions import text as X
    from ricepaper.operators.ids import stable_id

    own = chunks.select("chunk_id", F.col("text").alias("body"), F.lit(None).cast("string").alias("synthetic_question"), F.lit(None).cast("int").alias("question_index"))
    if questions is not None:
        asked = chunks.select("chunk_id", F.posexplode(questions).alias("question_index", "synthetic_question"))
        own = own.unionByName(asked.select("chunk_id", F.col("synthetic_question").alias("body"), "synthetic_question", "question_index"))
    kind = F.when(F.col("question_index").isNull(), F.lit("chunk")).otherwise(F.concat(F.lit("question-"), "question_index"))
    return own.select(
        stable_id("chunk_id", kind).alias("id"),
        V.hash_embedding(X.tokens(F.coalesce("body", F.lit(""))), size).alias("vector"),
        "chunk_id", "synthetic_question", "question_index",
    )
