"""Text and JSON generation: a pluggable slot, robust JSON extraction, contracts, retries.

Every slot has a deterministic offline default, so queries run without a network.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ricepaper.functions import text as X

ROUTER = T.StructType([T.StructField("route", T.StringType()), T.StructField("intent", T.StringType()), T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("signals", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())])


def json_text(c: Column) -> Column:
    """The JSON in a text: all of it, else from the first ``{`` to the last ``}``, else the brackets; null if none parses.

    If there are braces and what they hold does not parse, brackets are not tried.
    """
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    obj = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    arr = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    return F.coalesce(ok(F.nullif(X.strip(c), F.lit(""))), F.when(obj != "", ok(obj)).when(arr != "", ok(arr)))


def router_reply(c: Column) -> Column:
    """``(route, intent, entities, signals, confidence, valid)`` of a reply; lists default to empty."""
    r = F.from_json(json_text(X.strip_think(c)), ROUTER)
    none = F.array().cast("array<string>")
    valid = F.coalesce(r["route"].isin("FAST", "SLOW") & r["confidence"].between(0, 1), F.lit(False))
    return F.struct(r["route"].alias("route"), r["intent"].alias("intent"), F.coalesce(r["entities"], none).alias("entities"), F.coalesce(r["signals"], none).alias("signals"), r["confidence"].alias("confidence"), valid.alias("valid"))


def echo(prompts: list[str]) -> list[str]:
    """The offline generator: the last line of the prompt that has content."""
    return [next((line.strip() for line in reversed((p or "").split("\n")) if line.strip()), "") for p in prompts]


# Messages of errors worth another try.
RETRYABLE = ("429", "quota", "rate limit", "temporarily", "timeout", "unavailable")


class Limiter:
    """At most ``per_minute`` calls of one task; ``clock`` and ``sleep`` can be replaced."""

    def __init__(self, per_minute: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.next = (60.0 / per_minute if per_minute else 0.0), clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(self.next + self.gap, now)


def backoff(attempt: int, initial: float = 2.0, most: float = 60.0, jitter: bool = True) -> float:
    """Seconds before another try: doubling, capped, by up to half more or less."""
    wait = min(most, initial * 2 ** (attempt - 1))
    return wait * random.uniform(0.5, 1.5) if jitter else wait


def call(generate: Callable[[list[str]], list[str]], prompt: str, tries: int = 5, initial: float = 2.0, most: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """``(answer, error)``; there is always one of them, also when every try was put off."""
    error = None
    for attempt in range(1, tries + 1):
        try:
            return generate([prompt])[0], None
        except Exception as e:  # noqa: BLE001
            error = str(e) or type(e).__name__
            if not any(w in error.lower() for w in RETRYABLE):
                break
            if attempt < tries:
                sleep(backoff(attempt, initial, most))
    return None, error


def generate(df: DataFrame, prompt: str, generator: Callable[[list[str]], list[str]] = echo, per_minute: float | None = None, tries: int = 5) -> DataFrame:
    """``df`` with ``answer`` and ``error`` from a generator, in Arrow batches; one row out for each row in."""
    out = T.StructType([T.StructField("answer", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(out)
    def run(prompts: pd.Series) -> pd.DataFrame:
        limiter = Limiter(per_minute)
        rows = []
        for p in prompts:
            limiter.wait()
            rows.append(call(generator, p, tries))
        return pd.DataFrame(rows, columns=["answer", "error"])

    return df.withColumn("__g", run(prompt)).select(*df.columns, "__g.answer", "__g.error")
