"""Deterministic rendering: evidence under a budget, orderings, answers and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ricepaper.functions import text as X


def pack_evidence(rows: DataFrame, query: str, rank: str, budget: int = 9000, most: int = 1200) -> DataFrame:
    """``(query, n_blocks, n_chars, evidence)`` of ``rows(query, rank, source, text)``.

    Blocks are numbered without the blank ones, texts cut to ``most`` characters, and packing stops
    at the first block that would exceed the budget: a running sum. A query whose first block is too
    long has no row.
    """
    order = Window.partitionBy(query).orderBy(rank)
    kept = rows.where(F.col("text").rlike(f"[^{X.WS}]")).withColumn("i", F.row_number().over(order))
    block = F.concat(F.lit("["), "i", F.lit("] SOURCE: "), F.coalesce("source", F.lit("unknown")), F.lit("\nTEXT: "), F.substring("text", 1, most))
    total = F.sum(F.length("block")).over(Window.partitionBy(query).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    fits = kept.withColumn("block", block).withColumn("total", total).where(F.col("total") <= budget)
    blocks = F.array_sort(F.collect_list(F.struct("i", "block")))
    return fits.groupBy(query).agg(F.count("*").alias("n_blocks"), F.max("total").alias("n_chars"), F.array_join(F.transform(blocks, lambda b: b["block"]), "\n").alias("evidence"))


def list_evidence(rows: DataFrame, query: str, rank: str) -> DataFrame:
    """``(query, evidence)``: ``[rank] (score=0.000) source`` and the text, blocks apart by a blank line."""
    block = F.concat(F.lit("["), rank, F.lit("] (score="), F.format_string("%.3f", "score"), F.lit(") "), F.coalesce("source", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    blocks = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))
    return rows.groupBy(query).agg(F.array_join(F.transform(blocks, lambda b: b["b"]), "\n\n").alias("evidence"))


def ordering_line(levels: DataFrame, target: str) -> DataFrame:
    """``(target, line)`` of ``levels(target, level, node)``: ids of a level by comma, levels by arrow, the target last.

    A target without other nodes has an empty line.
    """
    others = levels.where(F.col("node") != F.col(target)).groupBy(target, "level").agg(F.array_join(F.array_sort(F.collect_set(F.upper("node"))), ", ").alias("ids"))
    joined = others.groupBy(target).agg(F.array_sort(F.collect_list(F.struct("level", "ids"))).alias("ls"))
    made = joined.select(target, F.concat(F.array_join(F.transform("ls", lambda x: x["ids"]), " → "), F.lit(" → "), F.upper(target)).alias("line"))
    return levels.select(target).distinct().join(made, target, "left").select(target, F.coalesce("line", F.lit("")).alias("line"))


def prerequisite_answer(courses: DataFrame) -> Column:
    """Four paragraphs about a course's prerequisites, from columns ``shown, direct, line, n_all``."""
    has = F.size("direct") > 0
    return F.concat_ws(
        "\n\n",
        F.when(has, F.concat("shown", F.lit(" has prerequisites."))).otherwise(F.concat("shown", F.lit(" has no prerequisites."))),
        F.when(has, F.concat(F.lit("Directly required: "), F.array_join("direct", ", "), F.lit("."))).otherwise(F.lit("You can register without passing another course first.")),
        F.when(has, F.concat(F.lit("Study order: "), "line", F.lit("."))).otherwise(F.lit("There is no order to keep.")),
        F.when(has, F.concat(F.lit("In all "), F.col("n_all").cast("string"), F.lit(" courses come before it."))).otherwise(F.lit("Check the offered semesters before you plan it.")),
    )


def semester_text(semester: Column) -> Column:
    """'all' or a list such as "[1, 2]" in words; null for anything else."""
    terms = F.from_json(F.when(semester != "all", semester), "array<int>")
    return (
        F.when(semester == "all", F.lit("every semester"))
        .when(F.size(terms) == 1, F.concat(F.lit("semester "), terms[0].cast("string")))
        .when(F.size(terms) > 1, F.concat(F.lit("semesters "), F.array_join(F.transform(terms, lambda x: x.cast("string")), ", ")))
    )


def lookup_answer(shown: Column, credits: Column, semester: Column, compulsory: Column) -> Column:
    """A course's facts in one sentence; unknown parts are left out."""
    return F.concat(
        shown, F.lit(": "),
        F.concat_ws("; ", F.when(credits.isNotNull(), F.concat(credits.cast("string"), F.lit(" credits"))), F.concat(F.lit("offered in "), semester_text(semester)), F.lower(compulsory)),
        F.lit("."),
    )


def render_plan(plan: DataFrame, scenario: str) -> DataFrame:
    """``(scenario, text)`` of ``plan(scenario, status, term, course_id, credits)``.

    A scenario without courses says why: infeasible, error, or nothing left to plan.
    """
    line = F.array_join(F.array_sort(F.collect_set("course_id")), ", ")
    terms = plan.where("course_id is not null").groupBy(scenario, "term").agg(F.concat(F.lit("Term "), "term", F.lit(": "), line, F.lit(" ("), F.sum("credits").cast("string"), F.lit(" credits)")).alias("t"))
    texts = terms.groupBy(scenario).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "t"))), lambda x: x["t"]), "\n").alias("body"))
    status = plan.groupBy(scenario).agg(F.max("status").alias("status"))
    reason = F.when(F.col("status") == "INFEASIBLE", "No plan meets all conditions.").when(F.col("status") == "TIMEOUT", "No plan was found in time.").when(F.col("status") == "ERROR", "The request can't be planned.").otherwise("Nothing is left to plan.")
    return status.join(texts, scenario, "left").select(scenario, F.coalesce("body", reason).alias("text"))


def capped(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each group, for a panel."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def without_chains(findings: Column) -> Column:
    """Findings without their enumerated chains."""
    return findings.dropFields("prereq_chains")
