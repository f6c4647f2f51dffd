"""Stable ids from parts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\x1f"


def _joined(*parts) -> Column:
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("<none>")) for p in parts]
    return F.concat(*[x for c in cols for x in (c, F.lit(SEPARATOR))])


def stable_id(*parts) -> Column:
    """128 bits of SHA-256 over the parts, each ended by a separator; a null part counts as ``<none>``."""
    return F.substring(F.sha2(_joined(*parts), 256), 1, 32)


def blake_id(*parts) -> Column:
    """The same contract with BLAKE2b of 16 bytes, in Arrow batches."""

    @F.pandas_udf(T.StringType())
    def digest(joined: pd.Series) -> pd.Series:
        return joined.map(lambda s: hashlib.blake2b(s.encode("utf-8"), digest_size=16).hexdigest())

    return digest(_joined(*parts))
