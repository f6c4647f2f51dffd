"""Planning constraints from question texts, and their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ricepaper.functions import text as X

# How credits, remaining, current and completed terms are written.
CREDITS = r"(?iu)(\d{1,9})\s*(?:tín|tin|credits?)"
REMAINING = r"(?iu)(?:còn|con|remaining|next|trong)\s*(\d{1,9})\s*(?:kỳ|ki|hoc\s*ky|học\s*kỳ|semesters?|terms?)"
CURRENT = r"(?iu)(?:đang\s*học|current)\s*(?:kỳ|kì|hoc\s*ky|học\s*kỳ|semester)\s*(\d{1,9})"
COMPLETED = r"(?iu)(?:đã\s*(?:học\s*)?xong|da\s*(?:hoc\s*)?xong|đã\s*hoàn\s*thành|da\s*hoan\s*thanh|hoàn\s*tất|hoan\s*tat|xong)\s*(?:hk|học\s*kỳ|hoc\s*ky|học\s*kì|hoc\s*ki|semester)\s*(\d{1,9})"


def _ints(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def parse(c: Column) -> Column:
    """Struct of min and max credits, remaining terms, current term, completed terms and courses; null where not said."""
    credits, terms = _ints(c, CREDITS), _ints(c, REMAINING)
    done = F.array_distinct(_ints(c, COMPLETED))
    current = F.nullif(F.regexp_extract(c, CURRENT, 1), F.lit("")).cast("int")
    return F.struct(
        F.array_min(credits).alias("min_credits"), F.array_max(credits).alias("max_credits"), F.array_max(terms).alias("terms_remaining"),
        F.coalesce(current, F.array_max(done) + 1).alias("current_term"), done.alias("completed_terms"), X.codes(c).alias("completed_courses"),
    )


def merge(own: Column, refined: Column) -> Column:
    """A refinement's numbers overwrite, its lists are added, in order, each once."""
    pick = lambda f: F.coalesce(refined[f], own[f]).alias(f)
    both = lambda f: F.array_union(own[f], F.coalesce(refined[f], F.slice(own[f], 1, 0))).alias(f)
    return F.struct(pick("min_credits"), pick("max_credits"), pick("terms_remaining"), pick("current_term"), both("completed_terms"), both("completed_courses"))


def offered_terms(semester: Column, horizon: int = 8) -> Column:
    """'all' or "[1, 2]" as an array of terms; empty for anything else."""
    return F.when(semester == "all", F.sequence(F.lit(1), F.lit(horizon))).otherwise(F.coalesce(F.from_json(semester, "array<int>"), F.array().cast("array<int>")))


def infer_current_term(rows: DataFrame, key: str, completed: str, graph: DataFrame, years: int = 4, per_year: int = 2) -> DataFrame:
    """``(key, inferred_term)``: one after the latest earliest offering of the completed courses, within 1..min(8, terms)."""
    first = graph.select(F.col("id").alias("code"), F.when(F.col("semester") == "all", F.lit(1)).otherwise(F.array_min(F.from_json("semester", "array<int>"))).alias("first"))
    done = rows.select(key, F.explode(completed).alias("code")).join(first, "code").groupBy(key).agg(F.max("first").alias("last"))
    most = min(8, years * per_year)
    return rows.select(key).distinct().join(done, key, "left").select(key, F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(F.col("last") + 1, F.lit(1)))).alias("inferred_term"))


def with_defaults(c: Column, low: int = 14, high: int = 24) -> Column:
    """Credit limits for the planner; a missing or zero limit takes its default."""
    return F.struct(F.coalesce(F.nullif(c["min_credits"], F.lit(0)), F.lit(low)).alias("min_credits"), F.coalesce(F.nullif(c["max_credits"], F.lit(0)), F.lit(high)).alias("max_credits"))
