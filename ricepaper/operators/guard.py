"""Guards on questions and answers. They report and clean; they never block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ricepaper.functions import text as X

# Phrases that try to override instructions.
INJECTIONS = (
    r"\bignore\s+previous\s+instructions\b",
    r"\bdisregard\s+all\s+rules\b",
    r"\bpretend\s+to\s+be\b",
    r"\bchange\s+the\s+system\s+prompt\b",
    r"\boverride\b",
)
# Words that mark a question about the domain.
DOMAIN_WORDS = ("course", "curriculum", "subject", "prerequisite", "semester", "plan", "schedule", "đồ án", "luận văn", "học phần", "tín chỉ", "tiên quyết", "lộ trình")


def strip_injections(c: Column, patterns: tuple[str, ...] = INJECTIONS) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, f"(?i){p}", "")
    return X.strip(c)


def in_domain(c: Column, words: tuple[str, ...] = DOMAIN_WORDS) -> Column:
    low = F.lower(c)
    found = low.contains(words[0])
    for w in words[1:]:
        found = found | low.contains(w)
    return found


def check_input(c: Column) -> Column:
    """Struct ``(ok, clean_text, issues)``; ``ok`` is always true."""
    bare = strip_injections(c)
    clean = X.redact(bare)
    issues = F.array(
        F.when(bare != X.strip(c), F.lit("injection")),
        F.when(clean != bare, F.lit("pii")),
        F.when(~in_domain(clean), F.lit("out_of_domain")),
    )
    return F.struct(F.lit(True).alias("ok"), clean.alias("clean_text"), F.array_compact(issues).alias("issues"))


def has_citations(c: Column) -> Column:
    """Whether some line starts with ``citations:``; false for null."""
    return F.coalesce(c.rlike(rf"(?i)(^|\n)[{X.WS}]*citations:"), F.lit(False))


def check_output(c: Column, require_citations: bool = False) -> Column:
    ok = has_citations(c) if require_citations else F.lit(True)
    return F.struct(ok.alias("ok"), F.when(~ok, F.array(F.lit("citations_missing"))).otherwise(F.array().cast("array<string>")).alias("issues"))
