import random

from ricepaper.operators.hierarchy import course_descendants, course_hierarchy

EDGE = "`from` string, `to` string, type string, extra string"
NODE = "id string, state string"


def tables(spark, links, ids=None):
    ids = ids if ids is not None else sorted({x.strip().upper() for a, b, *_ in links for x in (a, b) if x and x.strip()})
    rows = [(a, b, t[0] if t else "prerequisite", "x") for a, b, *t in links]
    return spark.createDataFrame(rows, EDGE), spark.createDataFrame([(i, "clash") for i in ids], NODE)


def states(spark, links, ids=None):
    return {tuple(r) for r in course_hierarchy(*tables(spark, links, ids)).select("course_id", "state", "root_id", "depth", "path").collect()}


def test_diamond_repeats_case_and_kinds(spark):
    links = [("a", "b"), (" A ", "B"), ("A", "C", None), ("B", "D", " PREREQUISITE "), ("C", "D"), ("A", "D", "corequisite"), (None, "D"), ("", "D"), ("Q", "D")]
    got = states(spark, links, ["A", "B", "C", "D", "D", "E", None])
    assert got == {("A", "path", "A", 0, "A"), ("B", "path", "A", 1, "A>B"), ("C", "path", "A", 1, "A>C"), ("D", "path", "A", 2, "A>B>D"), ("D", "path", "A", 2, "A>C>D")}


def test_cycles_loops_bridges_and_blocked(spark):
    links = [
        ("R", "X"), ("X", "Y"), ("Y", "X"), ("Y", "Z"), ("Z", "W"), ("L", "L"), ("L", "M"), ("R", "M"),
        ("P1", "P2"), ("P2", "P3"), ("P3", "P4"), ("P4", "P1"), ("P2", "B1"), ("B1", "B2"), ("B2", "X"), ("B2", "Q1"), ("Q1", "Q2"), ("Q2", "B3"), ("B3", "Q1"),
    ]
    got = {(c, s) for c, s, *_ in states(spark, links)}
    cycle = {"X", "Y", "L", "P1", "P2", "P3", "P4", "Q1", "Q2", "B3"}
    assert {c for c, s in got if s == "cycle"} == cycle
    assert {c for c, s in got if s == "blocked"} == {"Z", "W", "B1", "B2"}
    assert {c for c, s in got if s == "path"} == {"R", "M"}


def test_leaves_with_loops_tell_their_parents_once(spark):
    links = [("R", "P"), ("P", "L1"), ("P", "L2"), ("P", "X"), ("X", "C1"), ("C1", "C2"), ("C2", "C1"), ("L1", "L1"), ("L2", "L2")]
    got = states(spark, links)
    assert ("P", "path", "R", 1, "R>P") in got and ("X", "path", "R", 2, "R>P>X") in got
    assert {c for c, s, *_ in got if s == "cycle"} == {"L1", "L2", "C1", "C2"}


def test_empty(spark):
    assert states(spark, [], []) == set()
    assert states(spark, [("A", "B", "equivalent")]) == set()


def test_deep_chain_and_descendants(spark):
    links = [(f"N{i:02}", f"N{i + 1:02}") for i in range(11)] + [("N00", "N05")]
    got = states(spark, links)
    assert ("N11", "path", "N00", 11, ">".join(f"N{i:02}" for i in range(12))) in got
    assert ("N11", "path", "N00", 7, "N00>" + ">".join(f"N{i:02}" for i in range(5, 12))) in got
    rows = course_descendants(*tables(spark, links)).collect()
    assert {(r.course_id, r.subtree_size) for r in rows} == {(f"N{i:02}", 11 - i) for i in range(12)}
    assert {r.descendant_id for r in rows if r.course_id == "N09"} == {"N10", "N11"}


def test_descendants_through_cycles(spark):
    links = [
        ("A", "B"), ("B", "C"), ("C", "B"), ("C", "D"), ("L", "L"), ("L", "D"), ("Z", "L"),
        ("P1", "P2"), ("P2", "P3"), ("P3", "P4"), ("P4", "P1"), ("P2", "Q"), ("Q", "P4"), ("P3", "C"),
        ("S1", "S2"), ("S2", "S3"), ("S3", "S1"), ("T1", "T2"), ("T2", "T1"),
        ("U1", "U2"), ("U2", "U3"), ("U3", "U1"), ("U3", "V"), ("V", "W1"), ("W1", "W2"), ("W2", "W1"), ("W2", "W2"), ("W1", "X"), ("X", "Y"), ("Y", "W1"),
    ]
    reach = set(links)
    while more := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
        reach |= more
    rows = course_descendants(*tables(spark, links)).collect()
    assert sorted((r.course_id, r.descendant_id) for r in rows if r.descendant_id) == sorted(reach)
    assert {(r.course_id, r.subtree_size) for r in rows} == {(n, sum(a == n for a, _ in reach)) for n in {n for x in links for n in x}}


def test_random_graphs_against_brute_force(spark):
    for seed in (2,):
        rng = random.Random(seed)
        links = {(f"N{a}", f"N{b}") for a, b in (rng.sample(range(26), 2) for _ in range(22)) if rng.random() < (0.3, 0.6, 0.8, 1)[seed] or a < b}
        # chains hung between, into and out of these, one of them closed, and a circle of its own
        for k, (a, b, n) in enumerate([(0, 5, 6), (0, 5, 6), (7, 7, 4), (9, 3, 5), (None, 2, 5), (4, None, 7), (None, None, 4)]):
            own = ([f"N{a}"] if a is not None else []) + [f"C{k}_{i}" for i in range(n)] + ([f"N{b}"] if b is not None else [])
            links |= set(zip(own, own[1:]))
        links |= {(f"R{i}", f"R{(i + 1) % 9}") for i in range(9)}
        reach = set(links)
        while more := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
            reach |= more
        nodes, cyclic = {n for x in links for n in x}, {a for a, b in reach if a == b}
        want, front = {(n, "cycle", "", -1, "") for n in cyclic}, [(n, n, 0, n) for n in nodes - cyclic - {b for _, b in links}]
        while front:
            want |= {(n, "path", r, d, p) for n, r, d, p in front}
            front = [(b, r, d + 1, f"{p}>{b}") for n, r, d, p in front for a, b in links if a == n and b not in cyclic]
        want |= {(n, "blocked", "", -1, "") for n in nodes - {x[0] for x in want}}
        table = [(a, b) for a, b in sorted(links)]
        assert states(spark, table) == {(a.upper(), s, r, d, p) for a, s, r, d, p in want}
        rows = course_descendants(*tables(spark, table)).collect()
        assert sorted((r.course_id, r.descendant_id) for r in rows if r.descendant_id) == sorted(reach)


def test_rounds_do_not_go_by_the_depth(spark):
    """A chain of 3000 nodes and one that leaves it half way."""
    links = [(f"N{i:05}", f"N{i + 1:05}") for i in range(3000)] + [("N01500", "X0"), ("X0", "X1")]
    got = course_hierarchy(*tables(spark, links)).where("course_id in ('N03000', 'X1', 'N01501')").select("course_id", "root_id", "depth").collect()
    assert sorted(map(tuple, got)) == [("N01501", "N00000", 1501), ("N03000", "N00000", 3000), ("X1", "N00000", 1502)]
