"""Most similar vectors for every vector, by cosine.

Method. Balanced posting lists. A two-level k-means over a bounded sample gives centroids; the
second level gets centroids in proportion to the vectors, so lists come out of like length.
Centroids are searched through an in-memory neighbour graph (best-first with a bounded beam),
never one by one. A vector near a boundary is replicated to several lists: those whose centroid is
not farther than ``(1 + ratio)`` times the nearest. Inside a list vectors are compared in blocks of
matrix products and each keeps its best ``k``; results of its lists are merged. The first index is
fitted on a bounded sample, so over very many vectors its lists grow; a list of more than
``SUB_ROWS`` rows gets an index of its own in its task, fitted on its own rows, and is searched
through that, so the work for a vector stays bounded while lists grow.

Vectors travel as 16-bit codes of their direction, which keeps similarities to about 1e-5; pairs
that lie closer than that to a floor are measured again on the original numbers.

Scale. Two narrow maps and one shuffle of codes by list. Exact copies of a vector are one
representative (found by a hash with map-side counts) and are put back at the end, so a vector
held by a third of all rows makes no long list. Lists expected to exceed ``LIST_ROWS`` are split
into blocks whose pairs go to different tasks. The index (at most ``MAX_LISTS`` centroids, some
MB) is all that is broadcast.

Defined results. Unusable vectors (null, of another length, not finite, all zero) neither ask nor
answer; repeated rows count once; ties are ordered by id; no input, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ricepaper.session import materialize

#: Vectors in the sample that the index is fitted on.
FIT_ROWS = 65_536
#: Vectors to a list, before replication.
LIST_TARGET = 220
MAX_LISTS = FIT_ROWS // 8
#: Rows of a list handled in one task; longer lists are split.
LIST_ROWS = 100_000
#: Rows of a list in a task that are compared with each other; a longer one is indexed again.
SUB_ROWS = 8_192
#: Neighbours of a centroid in the graph, and entries kept during a search.
DEGREE, BEAM, HOPS = 24, 24, 5
STEP = 32767.0


def id_key(column: Column) -> Column:
    """A short binary form of an id that sorts like it; 32 hex digits take 17 bytes."""
    return F.when(column.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(b"\x01"), F.unhex(column))).otherwise(F.concat(F.lit(b"\x00"), F.encode(column, "UTF-8")))


def key_id(column: Column) -> Column:
    rest = F.expr(f"substring({column._jc.toString()}, 2)")
    return F.when(F.substring(column, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def chunk_points(points: DataFrame) -> DataFrame:
    """``(id, vector)`` of the points that stand for chunks, not for questions."""
    return points.where(F.col("payload.synthetic_question").isNull() & F.col("id").isNotNull()).select("id", "vector")


def direction_codes(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """``(key, code)`` of the usable rows of ``vectors(id, vector)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            offsets = np.asarray(lists.offsets)
            flat = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype=np.float64)
            good = np.flatnonzero((np.diff(offsets) == dim) & np.asarray(lists.is_valid()))
            if not len(good):
                continue
            rows = flat[offsets[good][:, None] + np.arange(dim)]
            top = np.abs(rows).max(axis=1)
            ok = np.isfinite(rows).all(axis=1) & (top > 0)
            rows, good = rows[ok] / top[ok][:, None], good[ok]
            rows /= np.linalg.norm(rows, axis=1)[:, None]
            codes = np.ascontiguousarray(np.rint(rows * STEP).astype("<i2"))
            data = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer((np.arange(len(codes) + 1, dtype=np.int32) * 2 * dim).tobytes()), pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), data], names=["key", "code"])

    return vectors.select(id_key(F.col("id")).alias("key"), "vector").mapInArrow(run, "key binary, code binary")


def _codes_to_unit(column: pa.Array, dim: int) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), dtype="<i2").reshape(-1, dim).astype(np.float32)
    return data / np.maximum(np.linalg.norm(data, axis=1), 1e-9)[:, None]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids and the vectors' assignment."""
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    at = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        for s in range(0, len(x), 8192):
            at[s : s + 8192] = np.argmax(x[s : s + 8192] @ c.T, axis=1)
        order = np.argsort(at, kind="stable")
        filled, starts = np.unique(at[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        norm = np.linalg.norm(sums, axis=1)
        c[filled] = np.where(norm[:, None] > 1e-9, sums / np.maximum(norm, 1e-9)[:, None], x[order[starts]])
        empty = np.setdiff1d(np.arange(k), filled)
        if len(empty):
            c[empty] = x[rng.choice(len(x), len(empty))]
    return c, at


class ListIndex:
    """Centroids of the posting lists and the graph that searches them."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        lists = int(min(max(1, rows // LIST_TARGET), MAX_LISTS, max(1, len(sample) // 8)))
        top, at = _kmeans(sample, math.ceil(math.sqrt(lists)), rng)
        parts = []
        for k in range(len(top)):
            own = sample[at == k]
            if len(own):
                parts.append(_kmeans(own, max(1, round(lists * len(own) / len(sample))), rng)[0])
        self.centroids = np.unique(np.concatenate(parts), axis=0)
        k = len(self.centroids)
        degree = min(DEGREE, k - 1)
        near = np.empty((k, degree), dtype=np.int32)
        for s in range(0, k, 2048):
            sims = self.centroids[s : s + 2048] @ self.centroids.T
            sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
            near[s : s + 2048] = np.argsort(-sims, axis=1)[:, :degree]
        self.graph = near
        # entries: the centroids nearest to each first-level centroid
        self.tops = top
        self.entries = np.argsort(-(top @ self.centroids.T), axis=1)[:, : min(BEAM, k)].astype(np.int32)
        counts = np.zeros(k)
        for s in range(0, len(sample), 4096):
            found, _ = self.search(sample[s : s + 4096], 1)
            counts += np.bincount(found[:, 0], minlength=k)
        self.expected = counts * rows / max(1, len(sample))

    def search(self, x: np.ndarray, many: int, beam: int = BEAM, hops: int = HOPS) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``x`` about the ``many`` nearest centroids and their cosines, best first."""
        n, k = len(x), len(self.centroids)
        many, beam = min(many, k), min(max(beam, many), k)
        first = np.argmax(x @ self.tops.T, axis=1)
        ids = self.entries[first].astype(np.int64)
        sims = np.einsum("bij,bj->bi", self.centroids[ids], x)
        open_ = np.ones(ids.shape, dtype=bool)
        rows = np.arange(n)[:, None]
        for _ in range(hops if self.graph.shape[1] else 0):
            pick = np.argsort(np.where(open_, -sims, 9.0), axis=1)[:, :2]
            open_[rows, pick] = False
            new = self.graph[ids[rows, pick]].reshape(n, -1).astype(np.int64)
            new_sims = np.einsum("bij,bj->bi", self.centroids[new], x)
            ids = np.concatenate([ids, new], axis=1)
            sims = np.concatenate([sims, new_sims], axis=1)
            open_ = np.concatenate([open_, np.ones(new.shape, dtype=bool)], axis=1)
            # a centroid met twice stays once, as already expanded if it was
            order = np.argsort(ids * 2 + open_, axis=1, kind="stable")
            ids, sims, open_ = (np.take_along_axis(a, order, axis=1) for a in (ids, sims, open_))
            twice = np.zeros(ids.shape, dtype=bool)
            twice[:, 1:] = ids[:, 1:] == ids[:, :-1]
            sims = np.where(twice, -3.0, sims)
            best = np.argsort(-sims, axis=1)[:, :beam]
            ids, sims, open_ = (np.take_along_axis(a, best, axis=1) for a in (ids, sims, open_))
            open_ &= sims > -3
        best = np.argsort(-sims, axis=1)[:, :many]
        return np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)


def fit_index(codes: DataFrame, rows: int, dim: int = 64) -> ListIndex:
    """An index fitted on at most about ``FIT_ROWS`` of ``codes``, chosen by the hash of the key."""
    sample = codes
    if rows > FIT_ROWS:
        sample = codes.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / rows))
    table = sample.select("code").limit(FIT_ROWS * 2).toArrow()
    return ListIndex(_codes_to_unit(table.column(0), dim), rows)


def post(codes: DataFrame, index, copies: int, ratio: float, dim: int = 64, beam: int = BEAM, hops: int = HOPS, role: str = "both", members: int | None = None) -> DataFrame:
    """``(list, part, key, code)``: each vector in up to ``copies`` lists within ``1 + ratio`` of its nearest.

    ``part`` is 0 but in lists that are split. There a row that both asks and answers stands, for its
    block i, in every part that compares block i with another; a row that only answers stands in its
    block's part, and one that only asks in all parts. ``members`` is the number of copies of the rows
    that answer, which the number of blocks goes by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: ListIndex = index.value
        blocks = np.maximum(1, np.ceil(made.expected * (members or copies) / LIST_ROWS)).astype(np.int64)
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                batch = whole.slice(s, 2048)
                x = _codes_to_unit(batch.column(1), dim)
                ids, sims = made.search(x, copies, beam, hops)
                far = np.sqrt(np.maximum(0, 2 - 2 * sims))
                keep = far <= (1 + ratio) * far[:, :1] + 1e-6
                row, slot = np.nonzero(keep)
                lists = ids[row, slot]
                parts = np.zeros(len(row), dtype=np.int64)
                split = blocks[lists] > 1
                if split.any():
                    salt = np.frombuffer(x.tobytes(), dtype=np.uint32).reshape(len(x), -1).sum(axis=1, dtype=np.uint64)
                    more_rows, more_lists, more_parts = [row[~split]], [lists[~split]], [parts[~split]]
                    for r, one in zip(row[split], lists[split]):
                        b = int(blocks[one])
                        i = int(salt[r] % b)
                        pairs = {"both": [min(i, j) * b + max(i, j) for j in range(b)], "answers": [i], "asks": list(range(b))}[role]
                        more_rows.append(np.full(len(pairs), r))
                        more_lists.append(np.full(len(pairs), one))
                        more_parts.append(np.array(pairs))
                    row, lists, parts = map(np.concatenate, (more_rows, more_lists, more_parts))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(parts.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], names=["list", "part", "key", "code"])

    return codes.select("key", "code").mapInArrow(run, "list int, part int, key binary, code binary")


def _sublists(x: np.ndarray, q: np.ndarray, m: np.ndarray, copies: int = 6, ratio: float = 0.25) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows that ask, rows that answer)`` to compare: all with all, or list by list of an index over ``m``."""
    if len(m) <= SUB_ROWS:
        yield q, m
        return
    step = max(1, len(m) // SUB_ROWS)
    index = ListIndex(x[m[::step]], len(m))
    asked, held = [], []
    for rows, out in ((q, asked), (m, held)):
        for s in range(0, len(rows), 2048):
            own = rows[s : s + 2048]
            ids, sims = index.search(x[own], copies)
            far = np.sqrt(np.maximum(0, 2 - 2 * sims))
            row, slot = np.nonzero(far <= (1 + ratio) * far[:, :1] + 1e-6)
            out.append((ids[row, slot], own[row]))
    lists, rows = (np.concatenate(c) for c in zip(*asked))
    at, members = (np.concatenate(c) for c in zip(*held))
    # rows stay in their order, which is that of the keys, inside each list
    order, back = np.argsort(lists, kind="stable"), np.argsort(at, kind="stable")
    bounds = np.arange(len(index.centroids) + 1)
    lo, hi = np.searchsorted(lists[order], bounds), np.searchsorted(at[back], bounds)
    for k in range(len(index.centroids)):
        if lo[k] < lo[k + 1] and hi[k] < hi[k + 1]:
            yield rows[order[lo[k] : lo[k + 1]]], members[back[hi[k] : hi[k + 1]]]


def _best_in_lists(k: int, floor: float, dim: int, roles: bool):
    """Compare the rows of each list; rows arrive sorted by list, part and key."""

    def compare(keys: list, codes: list, asks: np.ndarray | None) -> pa.RecordBatch | None:
        x = _codes_to_unit(pa.array(codes, pa.binary()), dim)
        # the same vector may arrive twice in a part
        first = np.concatenate([[True], np.array([a != b for a, b in zip(keys[1:], keys[:-1])], dtype=bool)]) if not roles else np.ones(len(keys), dtype=bool)
        if roles:
            q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        else:
            q = m = np.flatnonzero(first)
        if not len(q) or not len(m):
            return None
        names = np.array(keys, dtype=object)
        found = [p for own_q, own_m in _sublists(x, q, m) for p in pairs(x, names, own_q, own_m)]
        if not found:
            return None
        a, b, sim = (np.concatenate(p) for p in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(names[a], pa.binary()), pa.array(names[b], pa.binary()), pa.array(sim)], names=["a", "b", "sim"])

    def pairs(x: np.ndarray, names: np.ndarray, q: np.ndarray, m: np.ndarray) -> Iterator[tuple]:
        """``(asking rows, answering rows, cosines)``: of each row of ``q`` the best ``k`` in ``m``."""
        xm = x[m]
        for s in range(0, len(q), 512):
            rows = q[s : s + 512]
            sims = xm @ x[rows].T
            sims = np.round(sims.T.astype(np.float64), 6)
            sims[names[m][None, :] == names[rows][:, None]] = -2
            hit = sims >= floor
            many = hit.sum(axis=1)
            few = (many > 0) & (many <= k)
            i, j = np.nonzero(hit & few[:, None])
            if len(i):
                yield rows[i], m[j], sims[i, j]
            for r in np.flatnonzero(many > k):
                own = np.flatnonzero(hit[r])
                if len(own) > 4 * k:
                    least = np.partition(sims[r, own], len(own) - k)[len(own) - k]
                    own = own[sims[r, own] >= least]
                # members are in key order, so the stable sort settles ties
                own = own[np.argsort(-sims[r, own], kind="stable")[:k]]
                yield np.full(len(own), rows[r]), m[own], sims[r, own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, codes, asks = None, [], [], []
        for batch in batches:
            lists, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            names, data = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            role = batch.column(4).to_numpy(zero_copy_only=False) if roles else None
            cuts = np.flatnonzero((np.diff(lists) != 0) | (np.diff(parts) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(lists)]):
                if now != (here := (lists[lo], parts[lo])):
                    if keys and (made := compare(keys, codes, np.array(asks, dtype=bool) if roles else None)):
                        yield made
                    now, keys, codes, asks = here, [], [], []
                keys += names[lo:hi]
                codes += data[lo:hi]
                if roles:
                    asks += list(role[lo:hi])
        if keys and (made := compare(keys, codes, np.array(asks, dtype=bool) if roles else None)):
            yield made

    return run


class Copies:
    """Representatives of exact copies, and the way back for the best ``k`` of each."""

    def __init__(self, codes: DataFrame, k: int):
        self.k = k
        hashed = codes.withColumn("h", F.xxhash64("code"))
        again = materialize(hashed.groupBy("h").agg(F.count("*").alias("many")).where("many > 1").select("h"), "again")
        twice = hashed.join(again, "h", "left_semi").groupBy("code", "key").agg(F.lit(1).alias("one"))
        groups = twice.groupBy("code").agg(F.min("key").alias("rep"), F.count("*").alias("size"))
        self.groups = materialize(groups, "copies")
        self.reps = hashed.join(again, "h", "left_anti").select("key", "code").unionByName(self.groups.select(F.col("rep").alias("key"), "code"))
        order = Window.partitionBy("code").orderBy("key")
        shared = twice.join(self.groups.where("size > 1"), "code")
        #: every copy of a vector that several ids hold, and the first of each in order
        self.members = materialize(shared.select("rep", F.col("key").alias("member")), "members")
        self.first = materialize(
            shared.select("code", "rep", "key").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).select("rep", F.col("key").alias("member"), "place"), "firsts"
        )

    def expand(self, found: DataFrame) -> DataFrame:
        """``(a, b, sim)`` over ids from ``found`` over representatives: each id's best ``k``.

        Of more than ``k`` copies each has its best among the others, so only smaller groups ask elsewhere.
        """
        first = self.first.where(F.col("place") <= self.k).select("rep", "member")
        here, there = first.select(F.col("rep").alias("a"), F.col("member").alias("am")), first.select(F.col("rep").alias("b"), F.col("member").alias("bm"))
        others = found.join(here, "a", "left").join(there, "b", "left").select(F.coalesce("am", "a").alias("a"), F.coalesce("bm", "b").alias("b"), "sim")
        # among copies, each looks at the first others
        own = self.members.join(self.first, "rep").select(self.members["member"].alias("a"), self.first["member"].alias("b"), F.lit(1.0).alias("sim")).where("a <> b")
        order = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        return others.unionByName(own).withColumn("place", F.row_number().over(order)).where(F.col("place") <= self.k).drop("place")


def nearest(points: DataFrame, k: int = 5, floor: float = -1.0, queries: Column | None = None, copies: int = 4, ratio: float = 0.12, probes: int = 12, probe_ratio: float = 0.3, dim: int = 64) -> DataFrame:
    """``(id, neighbour, similarity)``: the ``k`` most similar other vectors with cosine >= ``floor``.

    Without ``queries`` every vector asks, in the lists it stands in itself. With ``queries`` (a
    condition on ``id``) only those ask, in up to ``probes`` lists within ``1 + probe_ratio`` of
    their nearest centroid, of all vectors.
    """
    spark = points.sparkSession
    codes = materialize(direction_codes(points.select("id", "vector"), dim), "codes")
    kept = Copies(codes, k)
    rows = codes.count()
    if rows == 0:
        return spark.createDataFrame([], "id string, neighbour string, similarity double")
    index = spark.sparkContext.broadcast(fit_index(codes, rows, dim))
    slack = floor - 1e-4
    if queries is None:
        posted = post(kept.reps, index, copies, ratio, dim).repartition("list", "part").sortWithinPartitions("list", "part", "key")
        run = _best_in_lists(k, slack, dim, roles=False)
    else:
        asks = kept.reps.withColumn("id", key_id(F.col("key"))).where(queries).drop("id")
        copied = kept.members.withColumn("id", key_id(F.col("member"))).where(queries).select(F.col("rep").alias("key")).distinct()
        asks = asks.unionByName(kept.reps.join(copied, "key", "left_semi")).dropDuplicates(["key"])
        members = post(kept.reps, index, 2, ratio, dim, role="answers").withColumn("asks", F.lit(False))
        asked = post(asks, index, probes, probe_ratio, dim, beam=2 * probes, hops=max(HOPS, probes // 2), role="asks", members=2).withColumn("asks", F.lit(True))
        posted = members.unionByName(asked).repartition("list", "part").sortWithinPartitions("list", "part", "key")
        run = _best_in_lists(k, slack, dim, roles=True)
    found = posted.mapInArrow(run, "a binary, b binary, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))
    found = materialize(found, "found")
    named = kept.expand(found).select(key_id(F.col("a")).alias("id"), key_id(F.col("b")).alias("neighbour"), F.col("sim").alias("similarity"))
    if queries is not None:
        named = named.where(queries)
    if floor <= -1.0:
        return named
    return _recheck(named, points, floor)


def _recheck(named: DataFrame, points: DataFrame, floor: float) -> DataFrame:
    """Measure pairs near the floor on the original vectors."""
    named = materialize(named, "named")
    sure, near = named.where(F.col("similarity") >= floor + 1e-4), materialize(named.where(F.col("similarity") < floor + 1e-4), "near")
    if near.isEmpty():
        return sure
    asked = near.select("id").union(near.select("neighbour")).distinct()
    own = points.select("id", "vector").where("vector is not null").join(asked, "id", "left_semi").dropDuplicates(["id"])
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    exact = (
        near.join(own.select("id", F.col("vector").alias("va")), "id").join(own.select(F.col("id").alias("neighbour"), F.col("vector").alias("vb")), "neighbour")
        .withColumn("similarity", dot(F.col("va"), F.col("vb")) / F.sqrt(dot(F.col("va"), F.col("va")) * dot(F.col("vb"), F.col("vb"))))
    )
    return sure.unionByName(exact.where(F.col("similarity") >= floor).select("id", "neighbour", "similarity"))


def near_pairs(points: DataFrame, k: int = 5, floor: float = 0.9) -> DataFrame:
    """``(point_a, point_b)``, the smaller id first: pairs with cosine >= ``floor`` of which one is among the other's best ``k``."""
    found = nearest(chunk_points(points), k, floor)
    return found.select(F.least("id", "neighbour").alias("point_a"), F.greatest("id", "neighbour").alias("point_b")).distinct()
