"""Filling containers of fixed capacity with items of varying length.

Method. Optimal length buckets: over the global histogram of item lengths, dynamic programming
chooses the bucket boundaries that minimise the padding of all items up to their bucket's bound
(a convex-hull search makes a layer linear in the capacity). Token-budget batches then form from
the buckets: each container starts with the largest bucket that still has items and is filled up to
its budget. A batch of one bucket only would leave up to an item's length unused, so the budget
that is left is topped up from smaller buckets by an exact subset sum over bucket bounds; the same
composition is repeated as often as the counts allow.

Planning works on the histogram (at most ``capacity`` numbers) and the bucket counts, so its cost
and the data sent to the driver are bounded by the capacity, not by the number of items. Items
take their places by their rank inside their bucket; ranks come from counts per salt, so a bucket
with a third of all items is spread over tasks.

Defined results. An item longer than the capacity is split into full pieces and a rest; no other
item is split. Items of null or zero length are returned without a container. Ties inside a bucket
are ordered by hash and key. A null or non-positive capacity gets no containers.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ricepaper.session import materialize

BUCKETS = 256
#: Items ranked in one task, about.
RANK_ROWS = 100_000
#: Containers' kinds (rows of prompt_windows) in one call, at most.
MAX_WINDOWS = 1000


def bucket_bounds(counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over lengths 1..n with least total padding.

    ``counts[k]`` is the number of items of length k; bounds are lengths that occur.
    """
    lengths = np.flatnonzero(counts)
    lengths = lengths[lengths > 0]
    if len(lengths) <= buckets:
        return [int(x) for x in lengths]
    n = len(lengths)
    items = np.concatenate([[0.0], np.cumsum(counts[lengths], dtype=float)])
    mass = np.concatenate([[0.0], np.cumsum(counts[lengths] * lengths, dtype=float)])
    # cost of one bucket over lengths i..j-1: bound_j * (items_j - items_i) - (mass_j - mass_i)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    came: list[np.ndarray] = []
    for _ in range(buckets):
        new, frm = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        new[0] = 0.0
        hull: list[int] = []  # lines y = c_i - items_i * x, x = bound, rising
        at = 0
        for j in range(1, n + 1):
            i = j - 1
            if np.isfinite(best[i]):
                c = best[i] + mass[i]
                while len(hull) - at >= 2:
                    a, b = hull[-2], hull[-1]
                    ca, cb = best[a] + mass[a], best[b] + mass[b]
                    if (c - ca) * (items[b] - items[a]) <= (cb - ca) * (items[i] - items[a]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            x = lengths[j - 1]
            while at + 1 < len(hull):
                a, b = hull[at], hull[at + 1]
                if best[b] + mass[b] - items[b] * x <= best[a] + mass[a] - items[a] * x:
                    at += 1
                else:
                    break
            i = hull[at]
            new[j], frm[j] = best[i] + mass[i] - items[i] * x + x * items[j] - mass[j], i
        came.append(frm)
        best = new
    bounds, j = [], n
    for frm in reversed(came):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(frm[j])
    return bounds[::-1]


def plan_batches(bounds: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``(repeats, {bucket: items in each})``: compositions whose bounds fit the capacity.

    The largest open bucket anchors a container; the rest of the budget is filled as far as
    possible by a subset sum over the counts that are left, larger buckets first.
    """
    left = list(counts)
    plan: list[tuple[int, dict[int, int]]] = []
    top = len(bounds) - 1
    while True:
        while top >= 0 and left[top] == 0:
            top -= 1
        if top < 0:
            return plan
        budget = capacity - bounds[top]
        # sums[k]: bit s set if buckets 0..k-1 can fill s
        mask = (1 << (budget + 1)) - 1
        sums, reach = [1], 1
        usable = [k for k in range(top + 1) if left[k] - (k == top) > 0 and bounds[k] <= budget]
        for k in usable:
            many = min(left[k] - (k == top), budget // bounds[k])
            step = 1
            while many > 0:
                step = min(step, many)
                reach |= (reach << (bounds[k] * step)) & mask
                many -= step
                step *= 2
            sums.append(reach)
        goal = reach.bit_length() - 1
        parts: dict[int, int] = defaultdict(int)
        parts[top] = 1
        for at in range(len(usable) - 1, -1, -1):
            k = usable[at]
            used, most = 0, min(left[k] - (k == top), goal // bounds[k])
            # as many of the larger bucket as still leave a reachable rest
            used = next(u for u in range(most, -1, -1) if sums[at] >> (goal - u * bounds[k]) & 1)
            if used:
                parts[k] += used
                goal -= used * bounds[k]
        repeats = min(left[k] // q for k, q in parts.items())
        for k, q in parts.items():
            left[k] -= q * repeats
        plan.append((repeats, dict(parts)))


def _plan_rows(window: int, capacity: int, histogram: dict[int, int], buckets: int) -> tuple[list[tuple], list[tuple]]:
    """Rows of the length map ``(window, length, bucket)`` and of the plan ``(window, bucket, low, high, each, first)``."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, many in histogram.items():
        counts[length] = many
    bounds = bucket_bounds(counts, buckets)
    of = np.searchsorted(bounds, np.arange(capacity + 1))
    lengths = [(window, int(k), int(of[k])) for k in np.flatnonzero(counts)]
    per = [0] * len(bounds)
    for _, length, bucket in lengths:
        per[bucket] += int(counts[length])
    rows, taken, first = [], [0] * len(bounds), 0
    for repeats, parts in plan_batches(bounds, per, capacity):
        for bucket, each in sorted(parts.items()):
            rows.append((window, bucket, taken[bucket], taken[bucket] + each * repeats, each, first))
            taken[bucket] += each * repeats
        first += repeats
    return lengths, rows


def pack(items: DataFrame, windows: DataFrame, key: str = "doc_id", size: str = "n_tokens", buckets: int = BUCKETS) -> DataFrame:
    """Containers for ``items(key, size)`` for every row of ``windows(window_id, capacity_tokens)``.

    Returns ``(window_id, prompt_id, key, piece, token_start, n_tokens)``, one row per piece;
    ``prompt_id`` is null for items without tokens. Keys must be unique.
    """
    spark: SparkSession = items.sparkSession
    kinds = [r for r in windows.select("window_id", "capacity_tokens").distinct().limit(MAX_WINDOWS + 1).collect() if r.capacity_tokens and r.capacity_tokens > 0]
    if len(kinds) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} kinds of containers")
    sizes = materialize(items.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("int").alias("n")), "sizes")
    out_schema = T.StructType([T.StructField("window_id", T.IntegerType()), T.StructField("prompt_id", T.StringType()), sizes.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("token_start", T.IntegerType()), T.StructField("n_tokens", T.IntegerType())])
    if not kinds:
        return spark.createDataFrame([], out_schema)
    kind = F.explode(F.array(*[F.struct(F.lit(r.window_id).cast("int").alias("window_id"), F.lit(r.capacity_tokens).cast("int").alias("cap")) for r in kinds]))
    wide = sizes.select(key, "n", kind.alias("w")).select(key, "n", "w.window_id", "w.cap")
    rest = wide.withColumn("full", F.floor(F.col("n") / F.col("cap")).cast("int")).withColumn("length", F.col("n") % F.col("cap"))
    placed = rest.where("length > 0")

    # bounded by the capacities
    histogram: dict[int, dict[int, int]] = defaultdict(dict)
    for r in placed.groupBy("window_id", "length").count().collect():
        histogram[r.window_id][r.length] = r["count"]
    lengths, plan, salts = [], [], {}
    for r in kinds:
        a, b = _plan_rows(int(r.window_id), int(r.capacity_tokens), histogram[r.window_id], buckets)
        lengths += a
        plan += b
        salts[int(r.window_id)] = 1 + max([sum(histogram[r.window_id].values())]) // RANK_ROWS
    most = max(salts.values())
    length_map = spark.createDataFrame(lengths, "window_id int, length int, bucket int")
    plan_map = spark.createDataFrame(plan, "window_id int, bucket int, low long, high long, each int, first long")

    ranked = (
        placed.join(F.broadcast(length_map), ["window_id", "length"])
        .select("window_id", "bucket", key, "full", "cap", "length", F.pmod(F.xxhash64(key), F.lit(most)).cast("int").alias("salt"))
    )
    ranked = materialize(ranked, "bucketed")
    per_salt = ranked.groupBy("window_id", "bucket", "salt").agg(F.count("*").alias("many"))
    from pyspark.sql import Window

    before = Window.partitionBy("window_id", "bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_salt.select("window_id", "bucket", "salt", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("window_id", "bucket", "salt").orderBy(F.xxhash64(key, F.lit(7)), key)
    ranked = ranked.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["window_id", "bucket", "salt"]).withColumn("rank", F.col("rank") + F.col("offset"))
    last = ranked.join(F.broadcast(plan_map), ["window_id", "bucket"]).where("rank >= low and rank < high").select(
        "window_id",
        F.concat(F.lit("w"), "window_id", F.lit("-"), (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("string")).alias("prompt_id"),
        key, F.col("full").alias("piece"), (F.col("full") * F.col("cap")).alias("token_start"), F.col("length").alias("n_tokens"),
    )
    piece = F.explode(F.sequence(F.lit(0), F.col("full") - 1))
    whole = rest.where("full > 0").select("window_id", key, "cap", piece.alias("piece")).select(
        "window_id", F.concat(F.lit("w"), "window_id", F.lit("-full-"), F.col(key).cast("string"), F.lit("-"), "piece").alias("prompt_id"),
        key, "piece", (F.col("piece") * F.col("cap")).alias("token_start"), F.col("cap").alias("n_tokens"),
    )
    none = rest.where("n = 0").select("window_id", F.lit(None).cast("string").alias("prompt_id"), key, F.lit(0).alias("piece"), F.lit(0).alias("token_start"), F.lit(0).alias("n_tokens"))
    return last.unionByName(whole).unionByName(none)


def fill_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per kind of container: ``window_id, prompts, tokens, least_prompts, used`` (share of the space used)."""
    full = packed.where("prompt_id is not null").groupBy("window_id").agg(F.countDistinct("prompt_id").alias("prompts"), F.sum("n_tokens").alias("tokens"))
    caps = windows.select("window_id", "capacity_tokens").distinct()
    return full.join(caps, "window_id").select(
        "window_id", "prompts", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_prompts"),
        F.round(F.col("tokens") / (F.col("prompts") * F.col("capacity_tokens")), 4).alias("used"),
    )
