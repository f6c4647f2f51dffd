"""Operators on the course graph: validation, adjacency, bounded closures, chains, levels, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ricepaper.functions import text as X
from ricepaper.operators import rendering
from ricepaper.operators.hierarchy import Peeling, counted_links
from ricepaper.session import materialize, new_table_path


def courses(graph: DataFrame) -> DataFrame:
    """One row per course: repeated rows once, the newest version of each id."""
    order = F.struct(F.coalesce("version", F.lit("")), F.to_json(F.struct("name", "credits", "semester", "compulsory", "language", "source")))
    return graph.where("id is not null").groupBy("id").agg(F.max_by(F.struct("name", "credits", "area", "language", "semester", "compulsory", "source", "version", "eligibility"), order).alias("c")).select("id", "c.*")


def violations(graph: DataFrame, edges: DataFrame) -> DataFrame:
    """``(entity, id, rule)`` of everything that breaks a rule; empty for a valid graph."""
    c = F.col("credits")
    terms = F.from_json(F.when(F.col("semester") != "all", F.col("semester")), "array<int>")
    rules = {
        "id": F.coalesce(F.trim("id"), F.lit("")) == "",
        "language": F.coalesce(F.trim("language"), F.lit("")) == "",
        "credits": ~F.coalesce(c["total"] == c["theory"] + c["lab"], F.lit(False)),
        "semester": ~F.coalesce((F.col("semester") == "all") | ((F.size(terms) > 0) & F.forall(terms, lambda t: t > 0)), F.lit(False)),
        "compulsory": ~F.coalesce(F.col("compulsory").isin("Compulsory", "Elective"), F.lit(False)),
        "eligibility": F.coalesce(F.col("eligibility.min_credits") < 0, F.lit(False)),
    }
    broken = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])))
    nodes = graph.select(F.lit("node").alias("entity"), "id", broken.alias("rule"))
    known = graph.select(F.col("id").alias("known")).where("known is not null").distinct()
    ends = edges.select(F.concat(F.coalesce("from", F.lit("?")), F.lit(">"), F.coalesce("to", F.lit("?"))).alias("id"), F.explode(F.array(F.col("from"), F.col("to"))).alias("known"))
    dangling = ends.join(known, "known", "left_anti").select(F.lit("edge").alias("entity"), "id", F.lit("endpoint").alias("rule"))
    kinds = edges.where(F.coalesce(F.lower(F.trim("type")), F.lit("prerequisite")) != "prerequisite").select(F.lit("edge").alias("entity"), F.concat(F.coalesce("from", F.lit("?")), F.lit(">"), F.coalesce("to", F.lit("?"))).alias("id"), F.lit("type").alias("rule"))
    return nodes.unionByName(dangling).unionByName(kinds).distinct()


def adjacency(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(id, incoming, outgoing)`` for every node, lists sorted; no links, empty lists."""
    into = links.groupBy(F.col("child").alias("id")).agg(F.array_sort(F.collect_set("parent")).alias("incoming"))
    out = links.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_set("child")).alias("outgoing"))
    none = F.array().cast("array<string>")
    return nodes.select("id").distinct().join(into, "id", "left").join(out, "id", "left").select("id", F.coalesce("incoming", none).alias("incoming"), F.coalesce("outgoing", none).alias("outgoing"))


def closure(seeds: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """``(seed, node, depth)``: prerequisites within ``depth`` hops, the seed at depth 0; the least depth counts."""
    front = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth"))
    seen = front
    step = links.select(F.col("child").alias("node"), F.col("parent").alias("next"))
    for k in range(1, depth + 1):
        front = front.join(step, "node").select("seed", F.col("next").alias("node"), F.lit(k).alias("depth")).distinct()
        seen = seen.unionByName(front)
    return seen.groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def edge_evidence(seeds: DataFrame, links: DataFrame, depth: int = 5, most: int = 120) -> DataFrame:
    """``(seed, place, evidence)``: ``course <- prerequisite`` within ``depth`` hops, in order, at most ``most``."""
    near = closure(seeds, links, depth - 1).where(F.col("depth") < depth)
    rows = near.join(links, near["node"] == links["child"]).select("seed", F.concat("child", F.lit(" <- "), "parent").alias("evidence"))
    w = rendering.Window.partitionBy("seed").orderBy("evidence")
    return rows.distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("seed", "place", "evidence")


def chains(targets: DataFrame, links: DataFrame) -> DataFrame:
    """``(course, chain)``: every simple path from a course without prerequisites to the target, as an array.

    Extended backwards one link a round; a path whose predecessors are all on it gives nothing.
    """
    spark = links.sparkSession
    step = materialize(links.where("parent <> child").select(F.col("child").alias("head"), "parent").distinct(), "back")
    has = step.select("head").distinct()
    path = new_table_path(spark, "chains")
    front = materialize(targets.select(F.col("course"), F.col("course").alias("head"), F.array("course").alias("chain")), "front")
    while True:
        front.join(has, "head", "left_anti").select("course", "chain").write.mode("append").parquet(path)
        front = materialize(
            front.join(step, "head").where(~F.array_contains("chain", F.col("parent"))).select("course", F.col("parent").alias("head"), F.concat(F.array("parent"), "chain").alias("chain")), "front"
        )
        if front.isEmpty():
            return spark.read.parquet(path)


def levels(links: DataFrame) -> DataFrame:
    """``(node, level)``: layers of the order in which courses can be taken, from 0; null behind a cycle."""
    return Peeling(links, bottom_up=False).run().state.select("node", F.col("height").alias("level"))


def compact_course() -> Column:
    """The course fields a prompt needs, at most five areas."""
    name = F.col("name")
    return F.struct(
        "id", X.display_name(F.col("id"), name).alias("name"), name["vi"].alias("name_vi"), name["en"].alias("name_en"), F.col("credits.total").alias("credits"),
        "semester", "compulsory", (F.col("compulsory") == "Elective").alias("is_elective"), F.slice("area", 1, 5).alias("area"), "language", F.col("eligibility.min_credits").alias("min_credits"),
    )


def relevant_findings(seeds: DataFrame, graph: DataFrame, links: DataFrame, depth: int = 2, max_nodes: int = 120, max_edges: int = 400, max_targets: int = 5) -> DataFrame:
    """``(question, n_closure, n_nodes, n_edges, truncated_nodes, truncated_edges, targets, nodes)`` of ``seeds(question, seed)``.

    Unknown seeds count in the closure but give no node; nodes are JSON without null fields.
    """
    own = seeds.select("question", F.upper("seed").alias("seed")).distinct()
    near = closure(own.select("seed").distinct(), links, depth)
    rel = own.join(near, "seed").select("question", "node").distinct()
    counts = rel.groupBy("question").agg(F.count("*").alias("n_closure"))
    inside = rel.select("question", F.col("node").alias("child")).join(links, "child").join(rel.select("question", F.col("node").alias("parent")), ["question", "parent"], "left_semi")
    edges = inside.groupBy("question").agg(F.least(F.count("*"), F.lit(max_edges)).alias("n_edges"), (F.count("*") >= max_edges).alias("truncated_edges"))
    w = rendering.Window.partitionBy("question").orderBy("node")
    shown = rel.join(graph.select(F.col("id").alias("node"), F.to_json(compact_course()).alias("json")), "node").withColumn("r", F.row_number().over(w))
    nodes = shown.where(F.col("r") <= max_nodes).groupBy("question").agg(F.count("*").alias("n_nodes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "json"))), lambda x: x["json"]), "\n").alias("nodes"))
    cut = shown.groupBy("question").agg((F.count("*") > max_nodes).alias("truncated_nodes"))
    targets = own.groupBy("question").agg(F.array_join(F.slice(F.array_sort(F.collect_set("seed")), 1, max_targets), ",").alias("targets"))
    out = counts.join(edges, "question", "left").join(nodes, "question", "left").join(cut, "question", "left").join(targets, "question")
    no = F.lit(False)
    return out.select("question", "n_closure", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("truncated_nodes", no).alias("truncated_nodes"), F.coalesce("truncated_edges", no).alias("truncated_edges"), "targets", F.coalesce("nodes", F.lit("")).alias("nodes"))


def course_findings(graph: DataFrame, links: DataFrame) -> DataFrame:
    """``(course_id, level, required, parallel)``: prerequisites by study level; ``parallel`` marks levels of two or more.

    Levels are those of the whole graph, from 1 within a course's own prerequisites.
    """
    lev = materialize(levels(links), "levels")
    from ricepaper.operators.hierarchy import Hierarchy

    pairs = Hierarchy(links).descendants().select(F.col("descendant").alias("course_id"), F.col("node").alias("required_id"))
    placed = pairs.join(lev.withColumnRenamed("node", "required_id"), "required_id")
    dense = F.dense_rank().over(rendering.Window.partitionBy("course_id").orderBy("level"))
    ranked = placed.withColumn("level", dense)
    return ranked.groupBy("course_id", "level").agg(F.array_join(F.array_sort(F.collect_set("required_id")), ", ").alias("required"), (F.count("*") >= 2).alias("parallel"))


def stats(graph: DataFrame, links: DataFrame) -> DataFrame:
    n, e = graph.select("id").distinct().agg(F.count("*").alias("n_nodes")), links.agg(F.count("*").alias("n_edges"))
    return n.join(F.broadcast(e))


def execute(requests: DataFrame, graph: DataFrame, links: DataFrame) -> DataFrame:
    """``(request_id, op, result)`` of ``requests(request_id, op, course)``: course_detail, prereqs, graph_stats; else an error."""
    known = ("course_detail", "prereqs", "graph_stats")
    needs = F.col("op").isin("course_detail", "prereqs") & F.col("course").isNull()
    bad = requests.where(F.col("op").isNull() | ~F.col("op").isin(*known) | needs).select("request_id", "op", F.when(F.col("op").isNull(), "error: no op").when(needs, "error: no course").otherwise("error: unknown op").alias("result"))
    info = graph.select(F.upper("id").alias("code"), F.to_json(compact_course()).alias("json"))
    detail = requests.where("op = 'course_detail' and course is not null").withColumn("code", F.upper("course")).join(info, "code", "left").select("request_id", "op", F.coalesce("json", F.lit("error: unknown course")).alias("result"))
    into = links.groupBy(F.col("child").alias("code")).agg(F.array_join(F.array_sort(F.collect_set("parent")), ",").alias("ids"))
    prereqs = requests.where("op = 'prereqs' and course is not null").withColumn("code", F.upper("course")).join(into, "code", "left").select("request_id", "op", F.coalesce("ids", F.lit("")).alias("result"))
    total = requests.where("op = 'graph_stats'").join(F.broadcast(stats(graph, links))).select("request_id", "op", F.concat_ws(",", "n_nodes", "n_edges").alias("result"))
    return bad.unionByName(detail).unionByName(prereqs).unionByName(total)


__all__ = ["courses", "violations", "adjacency", "closure", "edge_evidence", "chains", "levels", "relevant_findings", "course_findings", "stats", "execute", "counted_links"]
