"""Constraint-optimal multi-term planning: relational grid and checks, and a solver per scenario.

The decision grid, availability, prerequisite and load checks are joins and aggregations. The
search itself is one Arrow group per scenario, so scenarios run side by side; a scenario's size is
bounded by its graph, not by the number of scenarios.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ricepaper.operators.constraints import offered_terms

HORIZON = 8
ELECTIVE_MINIMUM = 15


def planning_graph(graph: DataFrame, links: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Courses and links without the ``dropped(id)`` ones (avoided or completed), in any case."""
    out = dropped.select(F.upper("id").alias("code")).distinct()
    nodes = graph.withColumn("code", F.upper("id")).join(out, "code", "left_anti").drop("code")
    kept = links.join(out.withColumnRenamed("code", "parent"), "parent", "left_anti").join(out.withColumnRenamed("code", "child"), "child", "left_anti")
    return nodes, kept


def horizon(start: Column, remaining: Column, years: int = 4, per_year: int = 2) -> Column:
    """``(start, end, status)``; a start outside 1..8 or no terms left is an ERROR."""
    terms = F.coalesce(remaining, F.lit(years * per_year))
    ok = start.between(1, HORIZON) & (terms >= 1)
    return F.struct(start.alias("start"), F.least(F.lit(HORIZON), start + terms - 1).alias("end"), F.when(F.coalesce(ok, F.lit(False)), "OK").otherwise("ERROR").alias("status"))


def grid(graph: DataFrame, start: int = 1, end: int = HORIZON) -> DataFrame:
    """``(id, term, credits)``: every term in which a course can be taken."""
    term = F.explode(F.array_distinct(offered_terms(F.col("semester"), HORIZON)))
    return graph.select("id", term.alias("term"), F.col("credits.total").alias("credits")).where(F.col("term").between(start, end))


def term_load(plan: DataFrame, scenario: str) -> DataFrame:
    return plan.groupBy(scenario, "term").agg(F.count("*").alias("n_courses"), F.sum("credits").alias("credits"))


def plan_violations(plan: DataFrame, scenario: str, links: DataFrame, graph: DataFrame, low: int, high: int) -> DataFrame:
    """``(scenario, rule, detail)`` of ``plan(scenario, course_id, term, credits)``: offering, order, repetition, load."""
    offered = grid(graph).select(F.col("id").alias("course_id"), "term")
    not_offered = plan.join(offered, ["course_id", "term"], "left_anti").select(scenario, F.lit("offered").alias("rule"), "course_id")
    twice = plan.groupBy(scenario, "course_id").count().where("count > 1").select(scenario, F.lit("once").alias("rule"), "course_id")
    own = plan.select(scenario, F.col("course_id").alias("child"), F.col("term").alias("t"))
    first = plan.select(scenario, F.col("course_id").alias("parent"), F.col("term").alias("pt"))
    order = own.join(links, "child").join(first, [scenario, "parent"], "left").where("pt is null or pt >= t").select(scenario, F.lit("order").alias("rule"), F.col("child").alias("course_id"))
    load = term_load(plan, scenario).withColumn("last", F.max("term").over(Window.partitionBy(scenario)))
    heavy = load.where((F.col("credits") > high) | ((F.col("term") < F.col("last")) & (F.col("credits") < low))).select(scenario, F.lit("load").alias("rule"), F.col("term").cast("string").alias("course_id"))
    return not_offered.unionByName(twice).unionByName(order).unionByName(heavy).withColumnRenamed("course_id", "detail")


@dataclass
class Problem:
    """One scenario: courses with credits and terms, links, limits and the track."""

    credits: dict[str, int]
    terms: dict[str, set[int]]
    before: dict[str, set[str]]
    required: set[str]
    start: int = 1
    end: int = HORIZON
    low: int = 14
    high: int = 24
    electives: set[str] = field(default_factory=set)
    elective_credits: int = ELECTIVE_MINIMUM
    thesis: str | None = None
    seconds: float = 20.0


def solve(p: Problem) -> tuple[str, dict[str, int], int]:
    """``(status, {course: term}, objective)``: least ``1000 * last term + courses beside the thesis``.

    Iterates over the last term; for each, a depth-first search fills terms in order. Bounds: the
    credits that still have to be placed against the load left, and for every course the latest term
    that its longest chain of dependants allows. Courses that are not required, electives and what
    they need, are taken or left by the search itself until the electives reach their credits. Each last term has ``seconds``; TIMEOUT means that no plan was found and
    not every last term was searched to its end. After a time-out a plan may not be the least.
    """
    late = False
    required = set(p.required)
    # what a required course needs is required too
    todo = list(required)
    while todo:
        for b in p.before.get(todo.pop(), ()):
            if b not in required:
                required.add(b)
                todo.append(b)
    if any(c not in p.credits for c in required):
        return "ERROR", {}, 0
    chosen = set(required)
    have = sum(p.credits[c] for c in chosen & p.electives)
    wanted = p.elective_credits if p.electives and p.elective_credits > 0 else 0
    # the other electives and what they need, prerequisites first; the search may take or leave each
    spare: list[str] = []

    def add(c: str, on: frozenset) -> bool:
        if c in chosen or c in spare:
            return True
        if c in on or c not in p.credits or not p.terms.get(c) or not all(add(b, on | {c}) for b in sorted(p.before.get(c, ()))):
            return False
        spare.append(c)
        return True

    if wanted or p.low > 0:
        for c in sorted(p.electives - chosen, key=lambda c: (len(p.before.get(c, ())), -len(p.terms.get(c, ())), -p.credits[c], c)):
            add(c, frozenset())
    # elective credits that the rest of the list can still give
    to_come = [0] * (len(spare) + 1)
    for k in range(len(spare) - 1, -1, -1):
        to_come[k] = to_come[k + 1] + (p.credits[spare[k]] if spare[k] in p.electives else 0)
    if have + to_come[0] < wanted:
        return "INFEASIBLE", {}, 0
    after: dict[str, set[str]] = {c: set() for c in chosen}
    for c in chosen:
        for b in p.before.get(c, ()):
            if b in after:
                after[b].add(c)
    total = sum(p.credits[c] for c in chosen)
    if not chosen and not wanted:
        return "OK", {}, 0
    tail: dict[str, int] = {}

    def depth(c: str, on: frozenset) -> int:
        if c in on:
            return 99
        if c not in tail:
            tail[c] = 1 + max((depth(x, on | {c}) for x in after[c]), default=-1)
        return tail[c]

    for c in chosen:
        if depth(c, frozenset()) >= 99:
            return "INFEASIBLE", {}, 0
    # every last term has its own time; one that ran out of it proves nothing, so later ones follow
    for last in range(p.start, p.end + 1):
        if total > p.high * (last - p.start + 1):
            continue
        latest = {c: last - tail[c] for c in chosen}
        options = {c: sorted(t for t in p.terms.get(c, ()) if p.start <= t <= latest[c]) for c in chosen}
        if p.thesis in chosen:
            options[p.thesis] = [t for t in options[p.thesis] if t == last]
        if any(not o for o in options.values()):
            continue
        placed: dict[str, int] = {}
        load = dict.fromkeys(range(p.start, last + 1), 0)
        best: tuple[int, dict[str, int]] | None = None
        clock = time.monotonic() + p.seconds
        over = False
        order = sorted(chosen, key=lambda c: (-tail[c], len(options[c]), c))

        def search(at: int, got: int) -> bool:
            nonlocal best, over
            if time.monotonic() > clock:
                over = True
                return True
            if at >= len(order) and got + to_come[at - len(order)] < wanted:
                return False
            if at == len(order) + len(spare):
                if max(placed.values(), default=p.start) != last or any(0 < load[t] < p.low for t in range(p.start, last)):
                    return False
                beside = sum(1 for c, t in placed.items() if p.thesis in placed and t == placed[p.thesis] and c != p.thesis)
                if best is None or beside < best[0]:
                    best = (beside, dict(placed))
                return beside == 0 or p.thesis not in placed
            free = at >= len(order)
            if free and got >= wanted and search(at + 1, got):
                return True
            c = spare[at - len(order)] if free else order[at]
            more = p.credits[c] if free and c in p.electives else 0
            if free and any(b not in placed for b in p.before.get(c, ())):
                return got < wanted and search(at + 1, got)
            open_terms = sorted(t for t in p.terms.get(c, ()) if p.start <= t <= last) if free else options[c]
            floor = max((placed[b] + 1 for b in p.before.get(c, ()) if b in placed), default=p.start)
            # fuller terms first, so that loads reach their minimum
            for t in sorted((t for t in open_terms if t >= floor), key=lambda t: (load[t] == 0, t)):
                if load[t] + p.credits[c] <= p.high:
                    placed[c] = t
                    load[t] += p.credits[c]
                    if search(at + 1, got + more):
                        return True
                    load[t] -= p.credits[c]
                    del placed[c]
            return free and got < wanted and search(at + 1, got)

        search(0, have)
        if best is not None:
            return "OK", best[1], 1000 * last + best[0]
        late = late or over
    return "TIMEOUT" if late else "INFEASIBLE", {}, 0


PLAN = "scenario_id long, status string, objective int, term int, course_id string, credits int"


def solve_scenarios(scenarios: DataFrame) -> DataFrame:
    """Plans of ``scenarios(scenario_id, start, end, low, high, elective_credits, thesis, courses)``.

    ``courses``: array of (id, credits, terms, before, required, elective). One row per placed course;
    a scenario without a plan has one row with a null course.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            cs = list(r.courses)
            p = Problem(
                {c["id"]: int(c["credits"]) for c in cs}, {c["id"]: set(map(int, c["terms"])) for c in cs}, {c["id"]: set(c["before"]) for c in cs},
                {c["id"] for c in cs if c["required"]}, int(r.start), int(r.end), int(r.low), int(r.high), {c["id"] for c in cs if c["elective"]}, int(r.elective_credits), r.thesis,
            )
            status, placed, objective = solve(p)
            if placed:
                out += [(r.scenario_id, status, objective, t, c, p.credits[c]) for c, t in sorted(placed.items())]
            else:
                out.append((r.scenario_id, status, objective, None, None, None))
        made = pd.DataFrame(out, columns=["scenario_id", "status", "objective", "term", "course_id", "credits"])
        return made.astype({"term": "Int32", "credits": "Int32", "objective": "int32"})

    return scenarios.groupBy("scenario_id").applyInPandas(run, PLAN)


def scenarios_for(goals: DataFrame, graph: DataFrame, pairs: DataFrame, links: DataFrame, low: int = 0, high: int = 24) -> DataFrame:
    """A scenario for each ``goals(scenario_id, course_id)``: the goal and all it needs, nothing elective.

    ``pairs(node, descendant)`` are the graph's ancestor pairs.
    """
    need = goals.select("scenario_id", F.col("course_id").alias("id")).unionByName(
        goals.join(pairs, goals["course_id"] == pairs["descendant"]).select("scenario_id", F.col("node").alias("id"))
    ).distinct()
    before = links.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_set("parent")).alias("before"))
    info = graph.select("id", F.col("credits.total").alias("credits"), offered_terms(F.col("semester")).alias("terms"))
    rows = need.join(info, "id").join(before, "id", "left")
    course = F.struct("id", "credits", "terms", F.coalesce("before", F.array().cast("array<string>")).alias("before"), F.lit(True).alias("required"), F.lit(False).alias("elective"))
    packed = rows.groupBy("scenario_id").agg(F.collect_list(course).alias("courses"))
    return packed.select("scenario_id", F.lit(1).alias("start"), F.lit(HORIZON).alias("end"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(0).alias("elective_credits"), F.lit(None).cast("string").alias("thesis"), "courses")
