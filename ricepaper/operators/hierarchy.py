"""Parent-child links to full hierarchies: paths, depths, roots, descendants and cycles.

Method. Chains of nodes with one way in and one way out are contracted to single links first, by
pointer jumping, so that the rounds below go by the branching of the hierarchy, not by its depth.
Leaf peeling then removes, round by round, the nodes all of whose children are gone; the round is
the node's height. Nodes that never become leaves reach a cycle. They are trimmed from above in
the same way, and labels travelling both ways over the core that is left separate the nodes that
lie on a cycle from those that only connect cycles. With the cycle nodes taken out, a second peel
orders all other nodes; its reverse order hands root paths down. For descendants each strongly
connected component is contracted to one node; peel order hands them up and the components are
expanded again. Last, the nodes inside chains get their paths and descendants from the chains' ends.

Scale. A chain of n nodes takes about log2(n) rounds. Each round of peeling touches only counters
of the parents of the nodes just removed; several heights form one job (``BAND``) when paths and
descendants are handed on. Each round's table stands in the shared folder and is dropped once the
next is written. Descendants are rows, not arrays, so one huge family is spread over tasks; only a
chain's own ids form an array, as long as a path over it. Nothing is collected to the driver but
counts. A node has one row per path, which grows exponentially over stacked diamonds.

Defined results. Null, blank and unknown ids make no link; a repeated link counts once; a link to
itself is a cycle; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ricepaper.session import materialize, new_table_path, path_exists, release

#: Heights whose paths are handed on in one job, and rounds of peeling in one job.
BAND, ROUNDS = 4, 2


def clean_id(column: Column) -> Column:
    """Upper-cased id without surrounding blanks of any kind; null when nothing is left."""
    trimmed = F.upper(F.regexp_replace(column, r"(?U)^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+$", ""))
    return F.when(trimmed != "", trimmed)


def counted_links(edges: DataFrame, nodes: DataFrame, link_type: str = "prerequisite") -> DataFrame:
    """Distinct ``(parent, child)`` of ``edges(from, to, type)`` whose ends are ids of ``nodes(id)``.

    A link counts if its type, trimmed and lower-cased, is ``link_type`` or is null. A blank type
    is another type, not a null one.
    """
    known = nodes.select(clean_id(F.col("id")).alias("known")).where("known is not null").distinct()
    kind = F.lower(F.regexp_replace(F.col("type"), r"(?U)^\s+|\s+$", ""))
    links = (
        edges.where(kind.isNull() | (kind == link_type))
        .select(clean_id(F.col("from")).alias("parent"), clean_id(F.col("to")).alias("child"))
        .where("parent is not null and child is not null")
        .distinct()
    )
    links = links.join(known.withColumnRenamed("known", "parent"), "parent", "left_semi")
    return links.join(known.withColumnRenamed("known", "child"), "child", "left_semi").select("parent", "child")


class Peeling:
    """Rounds of leaf peeling over ``links``; top-down if ``bottom_up`` is false.

    A node's height is the round in which it went: for a graph without cycles the longest way down
    to a leaf (or up to a root). It stays null where peeling never arrives.
    """

    def __init__(self, links: DataFrame, bottom_up: bool = True):
        above, below = ("parent", "child") if bottom_up else ("child", "parent")
        self.steps = materialize(links.select(F.col(below).alias("node"), F.col(above).alias("up")), "steps")
        self.state = materialize(
            self.steps.select(F.col("up").alias("node"), F.lit(1).alias("open"))
            .unionByName(self.steps.select("node", F.lit(0).alias("open")))
            .groupBy("node").agg(F.sum("open").alias("open"))
            .withColumn("height", F.when(F.col("open") == 0, F.lit(0))),
            "peel",
        )
        self.done = 0

    def _told(self, state: DataFrame, gone: DataFrame) -> DataFrame:
        """``state`` after the parents of the nodes ``gone`` were told: one more round."""
        told = self.steps.join(gone, "node", "left_semi").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("gone"))
        self.done += 1
        left = F.col("open") - F.coalesce("gone", F.lit(0))
        freed = F.col("height").isNull() & (left == 0)
        return state.join(told, "node", "left").select("node", left.alias("open"), F.when(freed, F.lit(self.done)).otherwise(F.col("height")).alias("height"))

    def _write(self, state: DataFrame) -> bool:
        """Put ``state`` in place of the last one; true if its last round freed any node."""
        seen, old = Observation(), self.state
        self.state = materialize(state.observe(seen, F.max("height").alias("last")), "peel")
        release(old)
        return seen.get.get("last") == self.done

    def run(self) -> "Peeling":
        freed = True
        while freed:
            state = self.state
            for _ in range(ROUNDS):
                state = self._told(state, state.where(F.col("height") == self.done).select("node"))
            freed = self._write(state)
        return self

    def run_without(self, nodes: DataFrame) -> "Peeling":
        """Take ``nodes`` out as one more round, then peel on.

        Those that went before, such as a leaf with a link to itself, have told their parents already.
        """
        pending = materialize(self.rest().join(nodes.select("node"), "node", "left_semi"), "pending")
        out = nodes.select("node").withColumn("out", F.lit(True))
        state = self.state.join(out, "node", "left").select("node", F.when(F.col("out"), F.lit(-1)).otherwise(F.col("open")).alias("open"), F.when(F.col("out"), F.lit(-1)).otherwise(F.col("height")).alias("height"))
        return self.run() if self._write(self._told(state, pending)) else self

    def rest(self) -> DataFrame:
        return self.state.where("height is null").select("node")


class Chains:
    """``links`` with every chain of nodes with one way in and one way out contracted.

    ``direct(parent, child)`` are the links between the other nodes, ``segments(head, start, end,
    hops)`` the chains between them, named by their first node, ``inside(node, head, place)`` the
    nodes of the chains, counted from 1, ``bare(node, component)`` the nodes of cycles without any
    other link. Nodes linked to themselves are in no chain.
    """

    def __init__(self, links: DataFrame):
        degree = (
            links.select(F.col("parent").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col("parent") == F.col("child")).cast("int").alias("s"))
            .unionByName(links.select(F.col("child").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("s")))
            .groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("s").alias("s"))
        )
        self.inner = materialize(degree.where("o = 1 and i = 1 and s = 0").select("node"), "inner")
        before = links.join(self.inner.select(F.col("node").alias("child")), "child", "left_semi").join(
            self.inner.select(F.col("node").alias("parent"), F.lit(True).alias("chained")), "parent", "left"
        )
        # at: an earlier node of the same chain, hops before; done once that is the chain's first
        state = materialize(
            before.select(
                F.col("child").alias("node"), F.when(F.col("chained"), F.col("parent")).otherwise(F.col("child")).alias("at"),
                F.when(F.col("chained"), 1).otherwise(0).alias("hops"), F.col("chained").isNull().alias("done"), F.col("child").alias("top"),
            ),
            "jumps",
        )
        was = None
        while True:
            onward = state.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("hops").alias("hops2"), F.col("done").alias("done2"), F.col("top").alias("top2"))
            seen, old = Observation(), state
            moved = state.where("not done").join(onward, "at").select(
                "node", F.col("at2").alias("at"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("done2").alias("done"), F.greatest("top", "top2").alias("top"),
                (F.col("top2") > F.col("top")).alias("higher"),
            )
            state = materialize(
                moved.unionByName(state.where("done").withColumn("higher", F.lit(False)))
                .observe(seen, F.sum((~F.col("done")).cast("long")).alias("open"), F.sum((~F.col("done") & F.col("higher")).cast("long")).alias("higher")).drop("higher"),
                "jumps",
            )
            release(old)
            now = seen.get.get("open") or 0
            # places of a chain have no gaps: when no node was done in a round, what is left runs in circles,
            # and the greatest id passed on the way round names the circle
            if not now or (now == was and not seen.get.get("higher")):
                break
            was = now
        self.bare = state.where("not done").select("node", F.col("top").alias("component"))
        self.inside = state.where("done").select("node", F.col("at").alias("head"), (F.col("hops") + 1).alias("place"))
        ends = self.inside.groupBy("head").agg(F.max_by("node", "place").alias("tail"), (F.max("place") + 1).alias("hops"))
        self.segments = materialize(
            ends.join(links.select(F.col("child").alias("head"), F.col("parent").alias("start")), "head")
            .join(links.select(F.col("parent").alias("tail"), F.col("child").alias("end")), "tail")
            .select("head", "start", "end", "hops"),
            "segments",
        )
        self.direct = links.join(self.inner.withColumnRenamed("node", "parent"), "parent", "left_anti").join(
            self.inner.withColumnRenamed("node", "child"), "child", "left_anti"
        ).select("parent", "child")

    @cached_property
    def links(self) -> DataFrame:
        """Distinct links between the nodes that are kept, chains included."""
        return materialize(self.direct.unionByName(self.segments.select(F.col("start").alias("parent"), F.col("end").alias("child"))).distinct(), "kept")

    def members(self) -> DataFrame:
        """``(node, head, place, start, end)`` of the nodes inside chains."""
        return self.inside.join(self.segments.select("head", "start", "end"), "head")


def _trim(links: DataFrame) -> DataFrame:
    """Links between nodes that peeling removes neither from below nor from above."""
    links = materialize(_within(links, Peeling(links).run().rest()), "trim")
    return materialize(_within(links, Peeling(links, bottom_up=False).run().rest()), "core")


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return links.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").join(
        nodes.withColumnRenamed("node", "child"), "child", "left_semi"
    ).select("parent", "child")


def _components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of strongly connected nodes in trimmed ``links``.

    Labels (the greatest id seen) travel with the links and against them; a node whose two labels
    agree belongs to that id's component. What is left is trimmed and done again.
    """
    found: DataFrame | None = None
    rest = links
    while not rest.isEmpty():
        nodes = rest.select(F.col("parent").alias("node")).distinct()
        state = materialize(nodes.select("node", F.col("node").alias("fwd"), F.col("node").alias("bwd")), "label")
        moved = True
        while moved:
            ahead = rest.join(state.select(F.col("node").alias("parent"), F.col("fwd").alias("m")), "parent").groupBy(F.col("child").alias("node")).agg(F.max("m").alias("f2"))
            behind = rest.join(state.select(F.col("node").alias("child"), F.col("bwd").alias("m")), "child").groupBy(F.col("parent").alias("node")).agg(F.max("m").alias("b2"))
            seen, old = Observation(), state
            state = materialize(
                state.join(ahead, "node").join(behind, "node")
                .withColumn("moved", (F.col("f2") > F.col("fwd")) | (F.col("b2") > F.col("bwd")))
                .observe(seen, F.max("moved").alias("moved"))
                .select("node", F.greatest("fwd", "f2").alias("fwd"), F.greatest("bwd", "b2").alias("bwd")),
                "label",
            )
            release(old)
            moved = bool(seen.get.get("moved"))
        done = state.where("fwd = bwd").select("node", F.col("fwd").alias("component"))
        found = done if found is None else found.unionByName(done)
        left = state.where("fwd <> bwd").select("node")
        rest = _trim(_within(rest, left))
    if found is None:
        return links.select(F.col("parent").alias("node"), F.col("parent").alias("component")).limit(0)
    return found


def _cycle_nodes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, component)`` of the nodes on cycles, and the peeling of ``links`` between different nodes.

    A component's name is the id of one of its nodes.
    """
    straight = links.where("parent <> child")
    peeling = Peeling(straight).run()
    members = links.where("parent = child").select(F.col("parent").alias("node"), F.col("parent").alias("component"))
    residual = materialize(_within(straight, peeling.rest()), "residual")
    if not residual.isEmpty():
        core = materialize(_within(residual, Peeling(residual, bottom_up=False).run().rest()), "core")
        found = materialize(_cycle_nodes_of_core(core), "found")
        members = members.join(found, "node", "left_anti").unionByName(found)
    return materialize(members, "cyclic"), peeling


def _cycle_nodes_of_core(core: DataFrame) -> DataFrame:
    chains = Chains(core)
    comps = materialize(_components(_trim(chains.links.where("parent <> child"))), "comps")
    sized = comps.join(comps.groupBy("component").count().where("count > 1"), "component", "left_semi").select("node", "component")
    turned = chains.links.where("parent = child").select(F.col("parent").alias("node"), F.col("parent").alias("component")).join(sized, "node", "left_anti")
    known = sized.unionByName(turned)
    return known.unionByName(_inside_components(chains, known)).unionByName(chains.bare)


def _inside_components(chains: Chains, members: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes inside chains whose two ends are in the same component."""
    return (
        chains.members().join(members.select(F.col("node").alias("start"), "component"), "start")
        .join(members.select(F.col("node").alias("end"), "component"), ["end", "component"]).select("node", "component")
    )


class Hierarchy:
    """The pieces of one hierarchy, computed once and shared by its views."""

    def __init__(self, links: DataFrame):
        self.links = materialize(links.select("parent", "child"), "links")
        self.nodes = self.links.select(F.col("parent").alias("node")).unionByName(self.links.select(F.col("child").alias("node"))).distinct()
        self.chains = Chains(self.links)
        kept, self.peeling = _cycle_nodes(self.chains.links)
        #: The nodes on cycles and the strongly connected component of each.
        self.members = materialize(kept.unionByName(_inside_components(self.chains, kept)).unionByName(self.chains.bare), "members")
        self.cyclic = self.members.select("node")
        self.cyclic_kept = kept.select("node")

    @cached_property
    def free(self) -> DataFrame:
        """``(parent, child)``: the links between nodes off cycles."""
        free = self.links.join(self.cyclic.withColumnRenamed("node", "parent"), "parent", "left_anti")
        return materialize(free.join(self.cyclic.withColumnRenamed("node", "child"), "child", "left_anti").select("parent", "child"), "free")

    @cached_property
    def heights(self) -> DataFrame:
        """``(node, height, band)`` of the nodes off cycles that are inside no chain."""
        heights = self.peeling.run_without(self.cyclic_kept).state.select("node", "height", F.floor(F.col("height") / BAND).cast("int").alias("band"))
        return materialize(heights.join(self.cyclic_kept, "node", "left_anti"), "heights")

    def paths(self) -> DataFrame:
        """``(node, root, depth, path)``: one row per path from a root, in reverse peel order."""
        place = self.heights.select("node", "band")
        ids = F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"])
        labels = materialize(self.chains.inside.groupBy("head").agg(ids.alias("ids")).join(self.chains.segments, "head"), "labels")
        steps = self.chains.direct.where("parent <> child").select(F.col("parent").alias("node"), "child", F.lit(1).alias("hops"), F.col("child").alias("more")).unionByName(
            labels.select(F.col("start").alias("node"), F.col("end").alias("child"), "hops", F.concat_ws(">", F.array_join("ids", ">"), "end").alias("more"))
        )
        steps = steps.join(place.select(F.col("node").alias("child"), F.col("band").alias("to_band")), "child").join(place.select("node"), "node", "left_semi")
        steps = materialize(steps, "steps")
        roots = place.join(self.links.select(F.col("child").alias("node")), "node", "left_anti")
        start = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.col("node").alias("path"), "band")

        def extend(here: DataFrame) -> DataFrame:
            return here.join(steps, "node").select(
                F.col("child").alias("node"), "root", (F.col("depth") + F.col("hops")).alias("depth"), F.concat("path", F.lit(">"), "more").alias("path"), F.col("to_band").alias("band")
            )

        outer = self._hand_on(start, extend, place, down=True).select("node", "root", "depth", "path")
        inner = self.chains.inside.join(labels.select("head", "start", "ids"), "head").join(outer.withColumnRenamed("node", "start"), "start").select(
            "node", "root", (F.col("depth") + F.col("place")).alias("depth"), F.concat_ws(">", "path", F.array_join(F.slice("ids", F.lit(1), F.col("place")), ">")).alias("path")
        )
        return outer.unionByName(inner)

    def _hand_on(self, start: DataFrame, extend, place: DataFrame, down: bool) -> DataFrame:
        """Band by band, extend the rows that arrived; all rows made, by band, are the result.

        Rows for a later band wait in that band's part of the table, so each row is read once.
        """
        spark = self.links.sparkSession
        path = new_table_path(spark, "handed")
        start.hint("rebalance").write.partitionBy("band").parquet(path)
        top = place.agg(F.max("band")).first()[0] or 0
        kept = T.StructType([f for f in start.schema.fields if f.name != "band"])
        for at in range(top, -1, -1) if down else range(top + 1):
            if not path_exists(spark, f"{path}/band={at}"):
                continue
            here = spark.read.schema(kept).parquet(f"{path}/band={at}").withColumn("band", F.lit(at))
            out = None
            for _ in range(BAND):
                here = extend(here.where(F.col("band") == at))
                out = here if out is None else out.unionByName(here)
            out.distinct().write.partitionBy("band").mode("append").parquet(path)
        return spark.read.schema(start.schema).parquet(path)

    def states(self) -> DataFrame:
        """One row per path, or one row for a node on a cycle or behind one."""
        paths = materialize(self.paths(), "allpaths")
        empty = [F.lit("").alias("root"), F.lit(-1).alias("depth"), F.lit("").alias("path")]
        cyclic = self.cyclic.select("node", F.lit("cycle").alias("state"), *empty)
        blocked = (
            self.nodes.join(self.cyclic, "node", "left_anti").join(paths.select("node"), "node", "left_anti")
            .select("node", F.lit("blocked").alias("state"), *empty)
        )
        return paths.select("node", F.lit("path").alias("state"), "root", "depth", "path").unionByName(cyclic).unionByName(blocked)

    def descendants(self) -> DataFrame:
        """``(node, descendant)`` over links between nodes off cycles, handed up in peel order."""
        place = self.heights.select("node", "band")
        up = self.chains.links.join(place.select(F.col("node").alias("parent"), F.col("band").alias("to_band")), "parent")
        up = materialize(up.select(F.col("child").alias("node"), "parent", "to_band").join(place.select("node"), "node", "left_semi"), "ups")
        own = up.join(place, "node").select(F.col("parent").alias("node"), F.col("node").alias("descendant"), F.col("to_band").alias("band"))

        def extend(here: DataFrame) -> DataFrame:
            return here.join(up, "node").select(F.col("parent").alias("node"), "descendant", F.col("to_band").alias("band")).distinct()

        outer = materialize(self._hand_on(own.distinct(), extend, place, down=False).select("node", "descendant").distinct(), "outer")
        # from and to the nodes inside chains
        reach = outer.unionByName(place.select("node", F.col("node").alias("descendant")))
        inside = materialize(self.chains.members().join(self.cyclic, "node", "left_anti"), "inside")
        segments = self.chains.segments
        into = reach.join(inside.select(F.col("start").alias("descendant"), F.col("node").alias("x")), "descendant").select("node", F.col("x").alias("descendant"))
        out = inside.select("node", "end").join(reach.withColumnRenamed("node", "end"), "end").select("node", "descendant")
        between = (
            segments.select(F.col("head").alias("head1"), F.col("end").alias("node")).join(reach, "node")
            .join(segments.select(F.col("head").alias("head2"), F.col("start").alias("descendant")), "descendant").select("head1", "head2")
        )
        across = between.join(inside.select(F.col("head").alias("head1"), "node"), "head1").join(inside.select(F.col("head").alias("head2"), F.col("node").alias("descendant")), "head2").select("node", "descendant")
        later = inside.select("head", F.col("place").alias("later"), F.col("node").alias("descendant"))
        along = inside.join(later, "head").where("later > place").select("node", "descendant")
        return outer.unionByName(into).unionByName(out).unionByName(across).unionByName(along)

    def all_descendants(self) -> DataFrame:
        """``(node, descendant)`` over all links; a node on a cycle is its own descendant, too."""
        if self.members.isEmpty():
            return self.descendants()
        above = self.members.select(F.col("node").alias("parent"), F.col("component").alias("p"))
        below = self.members.select(F.col("node").alias("child"), F.col("component").alias("c"))
        links = self.links.join(above, "parent", "left").join(below, "child", "left").select(F.coalesce("p", "parent").alias("parent"), F.coalesce("c", "child").alias("child"))
        # a component is named after one of its own nodes, so no other node has its name
        pairs = Hierarchy(links.where("parent <> child").distinct()).descendants()
        names = self.members.select("component").distinct()
        pairs = pairs.unionByName(names.select(F.col("component").alias("node"), F.col("component").alias("descendant")))
        upper = self.members.select(F.col("component").alias("node"), F.col("node").alias("own"))
        lower = self.members.select(F.col("component").alias("descendant"), F.col("node").alias("theirs"))
        return pairs.join(upper, "node", "left").join(lower, "descendant", "left").select(F.coalesce("own", "node").alias("node"), F.coalesce("theirs", "descendant").alias("descendant"))


def course_hierarchy(edges: DataFrame, nodes: DataFrame, link_type: str = "prerequisite") -> DataFrame:
    """``(course_id, state, root_id, depth, path)`` as described in the module's head."""
    states = Hierarchy(counted_links(edges, nodes, link_type)).states()
    return states.select(F.col("node").alias("course_id"), "state", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path").distinct()


def course_descendants(edges: DataFrame, nodes: DataFrame, link_type: str = "prerequisite") -> DataFrame:
    """``(course_id, descendant_id, subtree_size)`` of every course; one without descendants gives one
    row with a null descendant and size 0. A course on a cycle is its own descendant, too."""
    tree = Hierarchy(counted_links(edges, nodes, link_type))
    pairs = materialize(tree.all_descendants(), "pairs")
    sizes = pairs.groupBy("node").agg(F.count("*").alias("subtree_size"))
    return tree.nodes.join(sizes, "node", "left").join(pairs, "node", "left").select(
        F.col("node").alias("course_id"), F.col("descendant").alias("descendant_id"), F.coalesce("subtree_size", F.lit(0)).cast("long").alias("subtree_size")
    )
