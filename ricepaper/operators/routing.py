"""Intent classification and routing; all word lists are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of each intent, in lower case.
PLANNING = ("study plan", "plan my", "lập kế hoạch", "gợi ý kế hoạch", "kế hoạch học", "suggest an order", "theo thứ tự nào", "curriculum plan")
PREREQUISITE = ("prerequisite", "before", "without", "tiên quyết", "trước", "chưa qua", "tien quyet")
LOOKUP = ("credit", "semester", "elective", "compulsory", "offered", "tín chỉ", "tin chi", "học kỳ", "tự chọn", "bắt buộc", "mở")
# The template of each intent.
TEMPLATES = {"course_planning": "plan", "prerequisite_reasoning": "prerequisites", "course_lookup": "lookup", "generic": "general"}


def _any(c: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w)
    return found


def intent(text: Column, n_entities: Column, planning=PLANNING, prerequisite=PREREQUISITE, lookup=LOOKUP) -> Column:
    """course_planning, prerequisite_reasoning, course_lookup (only with an entity) or generic, tested in this order."""
    return (
        F.when(_any(text, planning), "course_planning").when(_any(text, prerequisite), "prerequisite_reasoning")
        .when((n_entities > 0) & _any(text, lookup), "course_lookup").otherwise("generic")
    )


def heuristic(scores: Column, of_intent: Column, threshold: float = 0.7) -> Column:
    """``(route, confidence, signals)`` from retrieval scores; planning is always SLOW."""
    top = F.array_max(scores)
    good = F.coalesce(top >= threshold, F.lit(False))
    planning = of_intent == "course_planning"
    signals = F.array_compact(F.array(
        F.when(top.isNull(), F.lit("no_scores")), F.when(top.isNotNull() & ~good, F.lit("low_score")), F.when(good, F.lit("high_score")), F.when(planning, F.lit("planning")),
    ))
    return F.struct(
        F.when(planning | ~good, "SLOW").otherwise("FAST").alias("route"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(top, F.lit(0.0)))).alias("confidence"), signals.alias("signals"),
    )


def decide(of_intent: Column, found: Column, named: Column, ops: Column, scores: Column) -> Column:
    """``(route, intent, entities, confidence)``: entities sorted and each once; only planning goes SLOW.

    An operation raises a generic intent: ``plan_curriculum`` to planning, ``prereq_chain`` to
    prerequisites, ``course_detail`` to lookup.
    """
    raised = (
        F.when(F.array_contains(ops, "plan_curriculum"), "course_planning").when(of_intent != "generic", of_intent)
        .when(F.array_contains(ops, "prereq_chain"), "prerequisite_reasoning").when(F.array_contains(ops, "course_detail"), "course_lookup").otherwise("generic")
    )
    return F.struct(
        F.when(raised == "course_planning", "SLOW").otherwise("FAST").alias("route"), raised.alias("intent"),
        F.array_sort(F.array_distinct(F.array_union(found, named))).alias("entities"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.array_max(scores), F.lit(0.0)))).alias("confidence"),
    )


def template(of_intent: Column) -> Column:
    out = F.lit(TEMPLATES["generic"])
    for name, value in TEMPLATES.items():
        out = F.when(of_intent == name, value).otherwise(out)
    return out


def decompose(text: Column, entities: Column) -> Column:
    """The deterministic stand-in for question decomposition: the question itself, and one lookup per entity."""
    return F.struct(entities.alias("entities"), F.array(text).alias("sub_questions"), F.transform(entities, lambda e: F.struct(F.lit("course_detail").alias("op"), e.alias("course"))).alias("kg_queries"))
