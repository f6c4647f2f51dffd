"""Vector functions on array columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null unless both are given."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, least: float = 1e-10) -> Column:
    """The vector over its length plus ``least``."""
    return F.zip_with(F.transform(a, lambda x: x.cast("double")), F.array_repeat(norm(a) + least, F.size(a)), lambda x, n: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def usable(a: Column, size: int | None = None) -> Column:
    """Whether a vector is there, of the given size, finite and not all zero."""
    good = a.isNotNull() & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(a, lambda x: x != 0)
    return F.coalesce(good & (F.size(a) == size) if size else good, F.lit(False))


def hash_embedding(tokens: Column, size: int = 64) -> Column:
    """Feature-hash embedding of a token list: bucket by MD5, term frequency, unit length.

    The deterministic stand-in for a sentence encoder; all zero for no tokens.
    """
    bucket = F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % size).cast("int"))
    zeros = F.array_repeat(F.lit(0.0), size)
    counts = F.aggregate(bucket, zeros, lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)))
    # the length goes in as the second input of a zip, so that it is computed once
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    made = F.zip_with(counts, F.array_repeat(length, size), lambda v, n: F.when(n > 0, v / n).otherwise(F.lit(0.0)))
    return made


@lru_cache(maxsize=1 << 18)
def _hashed(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:4], "big")


def hash_embedded(rows: DataFrame, key: str, tokens: str, size: int = 64) -> DataFrame:
    """``(key, v)``: :func:`hash_embedding` of a whole table, in Arrow batches; each word of a batch is hashed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(np.asarray(lists.offsets))
            coded = lists.flatten().dictionary_encode()
            bucket = np.array([_hashed(t) % size for t in coded.dictionary.to_pylist()], dtype=np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            counts = np.bincount(row * size + bucket[np.asarray(coded.indices)], minlength=len(sizes) * size).reshape(len(sizes), size).astype(float)
            length = np.sqrt((counts * counts).sum(axis=1))
            unit = counts / np.where(length > 0, length, 1.0)[:, None]
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * size, pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), v], names=[key, "v"])

    return rows.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("ws")).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, v array<double>")
