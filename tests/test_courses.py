from pyspark.sql import functions as F

from ricepaper.operators import alias, constraints, generation, graph, planning, routing
from ricepaper.plans import course_queries


def test_alias_cascade(spark):
    aliases = spark.createDataFrame([("AB101", ["Algebra One", None, "", "AB 101"]), ("CD202", ["Calculus"]), ("CD202", ["Calculus"]), (None, ["x"])], "canonical string, aliases array<string>")
    asked = spark.createDataFrame([(1, "what is ab 101?"), (2, "take CD202 now"), (3, "ZZ999 please"), (4, "hello"), (5, None), (6, "cd2022x")], "id int, q string")
    got = {r.id: (r.canonical, r.method) for r in alias.resolve(asked, "id", "q", aliases).collect()}
    assert got[1] == ("AB101", "exact") or got[1] == ("AB101", "exact-alias")
    assert got[2] == ("CD202", "exact") and got[3] == (None, "not-found") and got[4] == (None, "none") and got[5] == (None, "none")
    r = alias.normalized(alias.resolve(asked, "id", "q", aliases).join(asked, "id"), "q")
    assert {x.id: x.normalized for x in r.collect()}[3] == "ZZ999 please"


def test_indel_ratio():
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for a, b in (("kitten", "sitting"), ("", "abc"), ("same", "same"), ("algebra one", "algebra two")):
        assert abs(alias.indel_ratio(a, b) - 200 * lcs(a, b) / (len(a) + len(b))) < 1e-9
    assert alias.indel_ratio("", "") == 100


def graph_rows(spark):
    node = "id string, name map<string,string>, credits struct<total:int,theory:int,lab:int>, area array<string>, language string, semester string, compulsory string, source string, version string, eligibility struct<min_credits:int,note:string>"
    rows = [(i, {"en": f"Course {i}"}, (3, 2, 1), ["x"], "en", s, "Compulsory", None, "1", None) for i, s in (("A", "all"), ("B", "[1, 2]"), ("C", "[3]"), ("D", "[2]"))]
    return spark.createDataFrame(rows, node)


def links(spark, pairs):
    return spark.createDataFrame(pairs, "parent string, child string")


def test_graph_operators(spark):
    g = graph_rows(spark)
    edges = spark.createDataFrame([("A", "B", "prerequisite"), ("A", "Z", "prerequisite"), ("B", "C", "other")], "`from` string, `to` string, type string")
    assert {tuple(r) for r in graph.violations(g, edges).collect()} == {("edge", "A>Z", "endpoint"), ("edge", "B>C", "type")}
    k = links(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("D", "C")])
    assert {(r.seed, r.node, r.depth) for r in graph.closure(spark.createDataFrame([("C",)], "seed string"), k, 2).collect()} == {("C", "C", 0), ("C", "B", 1), ("C", "A", 1), ("C", "D", 1)}
    assert {tuple(r.chain) for r in graph.chains(spark.createDataFrame([("C",), ("A",)], "course string"), k).collect()} == {("A", "B", "C"), ("A", "C"), ("D", "C"), ("A",)}
    assert {(r.node, r.level) for r in graph.levels(k).collect()} == {("A", 0), ("D", 0), ("B", 1), ("C", 2)}
    adj = {r.id: (r.incoming, r.outgoing) for r in graph.adjacency(k, g).collect()}
    assert adj["C"] == (["A", "B", "D"], []) and adj["A"] == ([], ["B", "C"])
    req = spark.createDataFrame([(1, "course_detail", "a"), (2, "prereqs", "C"), (3, None, None), (4, "nope", "A"), (5, "prereqs", None), (6, "graph_stats", None)], "request_id int, op string, course string")
    got = {r.request_id: r.result for r in graph.execute(req, g, k).collect()}
    assert '"id":"A"' in got[1] and got[2] == "A,B,D" and got[3] == "error: no op" and got[4] == "error: unknown op" and got[5] == "error: no course" and got[6] == "4,4"


def test_routing_and_constraints(spark):
    q = F.col("q")
    df = spark.createDataFrame([("Lập kế hoạch học 3 học kỳ tới, mỗi kỳ tối đa 18 tín chỉ, không dưới 12 tín chỉ",), ("What are the prerequisites of AB101?",), ("How many credits?",)], "q string")
    got = [r[0] for r in df.select(routing.intent(q, F.lit(0))).collect()]
    assert got == ["course_planning", "prerequisite_reasoning", "generic"]
    c = df.select(constraints.parse(q).alias("c")).first().c
    assert (c.min_credits, c.max_credits) == (12, 18)
    r = spark.createDataFrame([([0.9],), ([0.7],), ([0.1],), ([],), (None,)], "s array<double>").select(routing.heuristic(F.col("s"), F.lit("generic")).alias("h")).collect()
    assert [x.h.route for x in r] == ["FAST", "FAST", "SLOW", "SLOW", "SLOW"]


def problem(**kw):
    base = dict(credits={"A": 3, "B": 3, "C": 3}, terms={"A": {1, 2, 3, 4}, "B": {2, 3, 4}, "C": {1, 2}}, before={"B": {"A"}}, required={"A", "B", "C"}, end=4, low=0, high=6, elective_credits=0)
    return planning.Problem(**{**base, **kw})


def test_solver():
    status, plan, goal = planning.solve(problem())
    assert status == "OK" and goal == 2000 and plan["A"] < plan["B"] and max(plan.values()) == 2
    assert planning.solve(problem(high=2))[0] == "INFEASIBLE"
    assert planning.solve(problem(terms={"A": {2}, "B": {2}, "C": {1}}))[0] == "INFEASIBLE"
    assert planning.solve(problem(required={"A", "X"}))[0] == "ERROR"
    # the thesis shares its term with nothing if a later term is not needed for that
    status, plan, goal = planning.solve(problem(thesis="C", terms={"A": {1}, "B": {2}, "C": {2, 3}}))
    assert status == "OK" and goal % 1000 == 1 and plan["C"] == 2
    status, plan, _ = planning.solve(problem(required={"A"}, electives={"B", "C"}, elective_credits=6))
    assert status == "OK" and set(plan) == {"A", "B", "C"}
    assert planning.solve(problem(before={"A": {"B"}, "B": {"A"}}))[0] == "INFEASIBLE"


def test_solver_against_brute_force():
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(25):
        names = "ABCD"
        p = problem(credits={c: rng.choice([2, 3, 4]) for c in names}, terms={c: set(rng.sample([1, 2, 3, 4], 2)) for c in names}, before={"D": {"A"}, "C": set(rng.sample("AB", 1))}, required=set(names), high=rng.choice([5, 6, 7]))
        best = None
        for ts in itertools.product(*(sorted(p.terms[c]) for c in names)):
            plan = dict(zip(names, ts))
            load = {t: sum(p.credits[c] for c in names if plan[c] == t) for t in set(ts)}
            if all(plan[b] < plan[c] for c, bs in p.before.items() for b in bs) and max(load.values()) <= p.high:
                best = min(best or 99, max(ts))
        status, plan, goal = planning.solve(p)
        assert (status == "OK") == (best is not None)
        if best is not None:
            assert goal == 1000 * best


def test_generation(spark):
    c = F.col("t")
    df = spark.createDataFrame([(' {"a": 1} ',), ('x {"a": 1} y',), ("x [1, 2] y",), ("{broken} [1]",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(generation.json_text(c)).collect()] == ['{"a": 1}', '{"a": 1}', "[1, 2]", None, None, None]
    tried = []

    def flaky(prompts):
        tried.append(1)
        if len(tried) < 3:
            raise RuntimeError("rate limit reached")
        return ["ok"]

    assert generation.call(flaky, "p", sleep=lambda s: None) == ("ok", None)
    assert generation.call(lambda p: 1 / 0, "p", sleep=lambda s: None)[0] is None
    waits = []
    lim = generation.Limiter(10, clock=lambda: 100.0, sleep=waits.append)
    for _ in range(3):
        lim.wait()
    assert waits == [6.0]
    assert generation.backoff(10, jitter=False) == 60.0


GRAPH = [
    ("AB101CD", {"vi": "Đại số", "en": "Algebra"}, "2"), ("AB101CD", {"vi": "Cũ", "en": "Old"}, "1"), ("EF202", {"vi": None, "en": "Logic"}, None),
    ("GH303", {}, "1"), ("IJ404", {"en": "Optics"}, "1"), ("IJ404", {"en": "Acoustics"}, "1"), (None, {"en": "None"}, "1"),
]


def test_alias_build_takes_every_course(spark, tmp_path):
    spark.createDataFrame(GRAPH, "id string, name map<string,string>, version string").write.parquet(str(tmp_path / "knowledge_graph.parquet"))
    got = {r.canonical: r.n_aliases for r in course_queries.alias_build(spark, str(tmp_path)).collect()}
    assert got == {"AB101CD": 4, "EF202": 2, "GH303": 1, "IJ404": 2}
    made = {r.canonical: r.aliases for r in alias.aliases_of_graph(spark.read.parquet(str(tmp_path / "knowledge_graph.parquet"))).collect()}
    assert made["AB101CD"] == ["AB101CD", "Cũ", "Old", "AB 101 CD"] and made["EF202"] == ["EF202", "Logic"] and made["IJ404"] == ["IJ404", "Acoustics"]


def test_alias_update_merges_all_built_aliases(spark, tmp_path):
    spark.createDataFrame(GRAPH, "id string, name map<string,string>, version string").write.parquet(str(tmp_path / "knowledge_graph.parquet"))
    old = [("EF202", ["Logic", "Reasoning", None]), ("ZZ999", ["Lost"]), (None, ["x"])]
    spark.createDataFrame(old, "canonical string, aliases array<string>").write.parquet(str(tmp_path / "aliases.parquet"))
    got = {r.canonical: r.aliases for r in course_queries.alias_update(spark, str(tmp_path)).collect()}
    assert got == {"AB101CD": "AB 101 CD|AB101CD|Cũ|Old", "EF202": "EF202|Logic|Reasoning", "GH303": "GH303", "IJ404": "Acoustics|IJ404", "ZZ999": "Lost"}


def test_a_time_out_proves_nothing(monkeypatch):
    assert planning.solve(problem(seconds=-1.0)) == ("TIMEOUT", {}, 0)
    # the first search runs out of time, later ones don't
    ticks = iter([0.0])
    monkeypatch.setattr(planning.time, "monotonic", lambda: next(ticks, 100.0))
    status, plan, goal = planning.solve(problem())
    assert status == "OK" and goal == 3000 and plan["A"] < plan["B"]


def test_electives_are_part_of_the_search():
    p = planning.Problem({"R": 24, "E1": 15, "E2": 15}, {"R": {1}, "E1": {1}, "E2": {2}}, {}, {"R"}, low=0, high=24, electives={"E1", "E2"})
    assert planning.solve(p) == ("OK", {"R": 1, "E2": 2}, 2000)
    # an elective brings what it needs, and electives may fill a term to its least load
    p = planning.Problem({"R": 9, "E": 15, "B": 6}, {"R": {1, 2, 3}, "E": {3}, "B": {1, 2}}, {"E": {"B"}}, {"R"}, low=5, high=24, electives={"E"})
    status, plan, _ = planning.solve(p)
    assert status == "OK" and plan["E"] == 3 and plan["B"] < 3
    p = planning.Problem({"R": 9, "E": 14}, {"R": {1}, "E": {2}}, {}, {"R"}, low=0, electives={"E"})
    assert planning.solve(p)[0] == "INFEASIBLE"
    # the thesis stands in the last term, beside as few others as possible
    p = planning.Problem({"R": 9, "E": 15, "T": 10}, {"R": {1, 2}, "E": {1, 2}, "T": {2}}, {"T": {"R"}}, {"R", "T"}, low=0, electives={"E"}, thesis="T")
    assert planning.solve(p) == ("OK", {"R": 1, "E": 1, "T": 2}, 2000)
