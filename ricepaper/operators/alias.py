"""Entity resolution as a cascade of joins: exact, alias, fuzzy, not found, semantic.

Every stage works on distinct mention keys and only on what the stages before left over. The fuzzy
stage compares a stated set of mentions, in blocks, with all alias keys; a length and letter-count
bound, which drops no match, comes before the exact similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ricepaper.functions import text as X
from ricepaper.functions import vectors as V
from ricepaper.operators import dense
from ricepaper.session import materialize

#: Mention keys broadcast at a time.
BLOCK = 20_000
FUZZY, SEMANTIC = 85.0, 0.45
CODE_SHAPE = r"^[A-Z]{2,4}\d{2,3}[A-Z]{0,3}$"


def alias_table(aliases: DataFrame) -> DataFrame:
    """Distinct ``(canonical, alias_pos, alias, key)`` of ``aliases(canonical, aliases)``; the canonical itself has position -1."""
    rows = aliases.where("canonical is not null")
    own = rows.select("canonical", F.lit(-1).alias("alias_pos"), F.col("canonical").alias("alias"))
    other = rows.select("canonical", F.posexplode("aliases").alias("alias_pos", "alias"))
    both = own.unionByName(other).where("alias is not null").distinct()
    return both.withColumn("key", X.name_key_ascii(F.col("alias"))).where("key <> ''")


def aliases_of_graph(graph: DataFrame) -> DataFrame:
    """``(canonical, aliases)`` built from courses: id, names, spaced code; ordered, each once.

    Of repeated rows the least version counts, none being less than any; then the first name, absent ones last.
    """
    name = F.col("name")
    vi, en = name["vi"], name["en"]
    order = F.struct(F.coalesce("version", F.lit("")), vi.isNull(), vi, en.isNull(), en)
    made = F.array_distinct(F.filter(F.array("id", name["vi"], name["en"], X.spaced_code(F.col("id"))), lambda x: x.isNotNull() & (x != "")))
    rows = graph.where("id is not null").groupBy("id").agg(F.min_by("name", order).alias("name"))
    return rows.select(F.col("id").alias("canonical"), made.alias("aliases"))


def merge_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two alias maps per canonical, sorted."""
    both = old.select("canonical", F.explode("aliases").alias("a")).unionByName(new.select("canonical", F.explode("aliases").alias("a")))
    return both.where("a is not null").groupBy("canonical").agg(F.array_sort(F.collect_set("a")).alias("aliases"))


def mentions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, token_pos, token)`` of code-like mentions, in order."""
    return rows.select(key, F.posexplode(X.mention_tokens_ascii(X.name_key_ascii(F.col(text)))).alias("token_pos", "token"))


def exact(keys: DataFrame, table: DataFrame) -> DataFrame:
    """``(token, canonical, matched, method, confidence)`` of keys equal to a canonical (1.0) or an alias (0.98)."""
    kind = F.when(F.col("alias_pos") < 0, F.struct(F.lit(0).alias("k"), F.lit("exact").alias("method"), F.lit(1.0).alias("confidence"))).otherwise(F.struct(F.lit(1).alias("k"), F.lit("exact-alias").alias("method"), F.lit(0.98).alias("confidence")))
    best = F.min_by(F.struct("canonical", F.col("alias").alias("matched"), kind.alias("kind")), F.struct(kind["k"], F.col("canonical"), F.col("alias_pos")))
    # one row per key before the join, so a popular key does not multiply
    one = table.groupBy(F.col("key").alias("token")).agg(best.alias("b"))
    return keys.join(one, "token").select("token", "b.canonical", "b.matched", "b.kind.method", "b.kind.confidence")


def _lcs(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over the summed lengths; 100 for two empty texts."""
    return 100.0 * 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(s.split()))


def fuzzy(keys: DataFrame, table: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """``(token, canonical, matched, method, confidence)``: the best token-sort ratio of at least ``threshold``.

    Ties go to canonicals before aliases, then to the first canonical and position.
    """
    spark = keys.sparkSession
    asked = materialize(keys.select("token").distinct(), "fuzzykeys")
    blocks = max(1, -(-asked.count() // BLOCK))
    one = table.groupBy("key").agg(F.min(F.struct((F.col("alias_pos") >= 0).alias("is_alias"), "canonical", "alias_pos", "alias")).alias("b"))
    found = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == block)
        tokens = [r.token for r in part.collect()]
        shared = spark.sparkContext.broadcast([(t, sorted_tokens(t), Counter(t)) for t in tokens])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for key in b.column(0).to_pylist():
                    own, letters = sorted_tokens(key), Counter(key)
                    for t, s, have in shared.value:
                        both = len(t) + len(key)
                        # the common subsequence is no longer than the common letters
                        if 200.0 * min(len(t), len(key)) < threshold * both or 200.0 * sum((have & letters).values()) < threshold * both:
                            continue
                        r = indel_ratio(s, own)
                        if r >= threshold:
                            out.append((t, key, r))
                cols = list(zip(*out)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["token", "key", "ratio"])

        got = one.select("key").mapInArrow(run, "token string, key string, ratio double")
        found = got if found is None else found.unionByName(got)
    best = F.min_by(F.struct("b", "ratio"), F.struct(-F.col("ratio"), F.col("b")))
    picked = found.join(one, "key").groupBy("token").agg(best.alias("x"))
    return picked.select("token", "x.b.canonical", F.col("x.b.alias").alias("matched"), F.lit("fuzzy").alias("method"), F.round(F.least(F.lit(0.9), F.col("x.ratio") / 100), 6).alias("confidence"))


def not_found(keys: DataFrame, table: DataFrame) -> DataFrame:
    """Keys in the shape of a code that are no canonical: no canonical, confidence 0."""
    compact = F.upper(F.replace("token", F.lit(" "), F.lit("")))
    left = keys.where(compact.rlike(CODE_SHAPE)).withColumn("code", compact)
    left = left.join(table.where("alias_pos < 0").select(F.upper("canonical").alias("code")), "code", "left_anti")
    return left.select("token", F.lit(None).cast("string").alias("canonical"), F.col("code").alias("matched"), F.lit("not-found").alias("method"), F.lit(0.0).alias("confidence"))


def semantic(keys: DataFrame, table: DataFrame, threshold: float = SEMANTIC, size: int = 64) -> DataFrame:
    """The nearest alias key by embedding; below ``threshold`` it is not found, with that confidence."""
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 1)), lambda i: F.substring(c, i, 2))
    one = table.groupBy("key").agg(F.min(F.struct((F.col("alias_pos") >= 0).alias("is_alias"), "canonical", "alias_pos", "alias")).alias("b"))
    rows = materialize(one.withColumn("v", V.hash_embedding(grams(F.col("key")), size)), "aliasvectors")
    asked = keys.select("token").distinct().withColumn("qv", V.hash_embedding(grams(F.col("token")), size))
    best = dense.exact_top_k(rows, asked, "key", "v", "token", "qv", 1)
    named = best.join(rows.select("key", "b"), "key")
    good = F.col("score") >= threshold
    return named.select(
        F.col("query").alias("token"), F.when(good, F.col("b.canonical")).alias("canonical"), F.when(good, F.col("b.alias")).alias("matched"),
        F.when(good, "semantic").otherwise("not-found").alias("method"), F.col("score").alias("confidence"),
    )


def resolve_keys(keys: DataFrame, table: DataFrame) -> DataFrame:
    """The cascade over distinct ``keys(token)``."""
    keys = materialize(keys.select("token").distinct(), "keys")
    table = materialize(table, "aliastable")
    first = materialize(exact(keys, table), "exact")
    rest = materialize(keys.join(first, "token", "left_anti"), "rest")
    second = materialize(fuzzy(rest, table), "fuzzy")
    rest = materialize(rest.join(second, "token", "left_anti"), "rest")
    third = materialize(not_found(rest, table), "notfound")
    last = semantic(rest.join(third, "token", "left_anti"), table)
    return first.unionByName(second).unionByName(third).unionByName(last)


def resolve(rows: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """``(key, canonical, matched, method, confidence)``: one row per text; method 'none' without a mention.

    The earliest stage wins, then the first mention.
    """
    found = materialize(mentions(rows, key, text), "mentions")
    resolved = resolve_keys(found.select("token"), alias_table(aliases))
    stage = F.when(F.col("method").isin("exact", "exact-alias"), 0).when(F.col("method") == "fuzzy", 1).when(F.col("method") == "not-found", 2).otherwise(3)
    best = F.min_by(F.struct("canonical", "matched", "method", "confidence"), F.struct(stage, F.col("token_pos")))
    picked = found.join(resolved, "token").groupBy(key).agg(best.alias("r"))
    return rows.select(key).distinct().join(picked, key, "left").select(key, "r.canonical", "r.matched", F.coalesce("r.method", F.lit("none")).alias("method"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"))


def normalized(resolved: DataFrame, text: str) -> DataFrame:
    """Adds ``normalized``: the canonical, else the text itself; a not-found message is never used as a name."""
    return resolved.withColumn("normalized", F.coalesce("canonical", text))


def expand_queries(resolved: DataFrame, key: str, text: str, least: float = 0.8) -> DataFrame:
    """Phrasings of each question: itself, and the canonical name if it is sure enough and new."""
    own = resolved.select(key, F.lit(0).alias("v"), F.col(text).alias("phrase"))
    sure = (F.col("confidence") >= least) & F.col("canonical").isNotNull() & (F.col("canonical") != F.col(text))
    return own.unionByName(resolved.where(sure).select(key, F.lit(1).alias("v"), F.col("canonical").alias("phrase")))


def contained(rows: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """Mentions by substring: rows whose text holds an alias, found through the alias's first word.

    Returns ``(key, canonical, matched)``: the first canonical and alias position. Words of the text are
    joined with the aliases' first words, so no alias is compared with a text that lacks it.
    """
    low = table.where("alias_pos >= 0").withColumn("low", F.lower("alias")).withColumn("word", X.tokens(F.col("low"))[0]).where("word is not null")
    words = rows.select(key, text, F.explode(F.array_distinct(X.tokens(F.regexp_replace(F.col(text), "[?,.;:!\"()]", " ")))).alias("word"))
    hit = words.join(low, "word").where(F.lower(F.col(text)).contains(F.col("low")))
    best = F.min_by(F.struct("canonical", F.col("alias").alias("matched")), F.struct("canonical", "alias_pos"))
    return hit.groupBy(key).agg(best.alias("b")).select(key, "b.canonical", "b.matched")
