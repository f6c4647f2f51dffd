import numpy as np
from pyspark.sql import functions as F

from ricepaper.llm import neighbours

POINT = "id string, vector array<float>, payload struct<chunk_id:string,source:string,doc_id:string,chunk_index:int,synthetic_question:string,question_index:int>, key string, code string"


def points(spark, rows):
    return spark.createDataFrame([(i, v, ("c", None, None, None, q, None), "clash", "clash") for i, v, q in rows], POINT)


def made(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    for k in range(0, n, 6):
        x[k + 1] = x[k] + 0.15 * rng.normal(size=64)
    x[7] = 3 * x[8]
    return x


def brute(ids, x, k=5, floor=0.9):
    order = np.argsort(ids)
    ids, x = np.array(ids)[order], x[order]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        c = np.flatnonzero(s[i] >= floor)
        for j in c[np.argsort(-s[i, c], kind="stable")[:k]]:
            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_pairs_against_brute_force(spark):
    x = made().astype(np.float32).astype(float)
    ids = [f"{k * 7919:032x}" for k in range(len(x))]
    rows = [(i, v.tolist(), None) for i, v in zip(ids, x)]
    bad = [("bad0", None, None), ("bad1", [0.0] * 64, None), ("bad2", [1.0] * 63, None), ("bad3", [float("nan")] * 64, None), (None, x[0].tolist(), None), ("q", x[0].tolist(), "asked")]
    df = points(spark, rows + bad + rows[:50])
    got = {tuple(r) for r in neighbours.near_pairs(df).collect()}
    want = brute(ids, x)
    assert not got - want and len(got & want) >= 0.97 * len(want)


def test_a_third_of_copies_stays_linear(spark):
    x = made(300)
    rows = [(f"n{k:04}", v.tolist(), None) for k, v in enumerate(x)] + [(f"z{k:04}", (x[10] * (k % 3 + 1)).tolist(), None) for k in range(150)]
    got = {tuple(r) for r in neighbours.near_pairs(points(spark, rows)).collect()}
    want = brute([r[0] for r in rows], np.array([r[1] for r in rows]))
    copies = {p for p in want if p[0][0] == "z" or p[1][0] == "z"}
    assert copies <= got and len(got) < 2500


def test_recall_of_all_five(spark):
    x = made(1500, 4)
    ids = [f"{k * 104729:032x}" for k in range(len(x))]
    df = points(spark, [(i, v.tolist(), None) for i, v in zip(ids, x)])
    asked = F.conv(F.substring("id", -8, 8), 16, 10).cast("long") % 50 == 0
    got = neighbours.nearest(neighbours.chunk_points(df), 5, queries=asked).toPandas().groupby("id").neighbour.apply(set).to_dict()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for k, i in enumerate(ids):
        if int(i[-8:], 16) % 50 == 0:
            s = u @ u[k]
            s[k] = -2
            best = {ids[j] for j in np.argsort(-s)[:5]}
            hits, total = hits + len(best & got[i]), total + 5
    assert total and hits / total >= 0.9


def test_empty(spark):
    assert neighbours.near_pairs(points(spark, [])).count() == 0
    assert neighbours.near_pairs(points(spark, [("a", None, None)])).count() == 0
    assert neighbours.near_pairs(points(spark, [("a", [1.0] * 64, None)])).count() == 0


def recall(got, x, ids, k, asked=lambda i: True):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for at, i in enumerate(ids):
        if asked(i):
            s = u @ u[at]
            s[at] = -2
            best = {ids[j] for j in np.argsort(-s)[:k]}
            hits, total = hits + len(best & got.get(i, set())), total + k
    return hits / total


def grouped(df):
    return df.toPandas().groupby("id").neighbour.apply(set).to_dict()


def test_recall_of_every_vector_and_of_lists_indexed_again(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 64)), 50, axis=0) + 0.5 * rng.normal(size=(3000, 64))
    ids = [f"{k * 104729:032x}" for k in range(len(x))]
    df = points(spark, [(i, v.tolist(), None) for i, v in zip(ids, x)])
    assert recall(grouped(neighbours.nearest(neighbours.chunk_points(df), 5)), x, ids, 5) >= 0.9
    # one list over all, searched through an index of its own
    monkeypatch.setattr(neighbours, "SUB_ROWS", 500)
    keys = [i.encode() for i in sorted(ids)]
    order = np.argsort(ids)
    u = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)[order]
    rows = np.arange(len(u))
    got = {}
    for q, m in neighbours._sublists(u, rows, rows):
        assert len(q) < len(u) / 3
        for a in q:
            s = u[m] @ u[a]
            s[m == a] = -2
            for j in np.argsort(-s)[:5]:
                got.setdefault(a, {})[m[j]] = s[j]
    best = {keys[a].decode(): {keys[b].decode() for b in sorted(o, key=o.get)[-5:]} for a, o in got.items()}
    assert recall(best, x, ids, 5) >= 0.9


def test_copies_for_more_than_five(spark):
    x = made(120, 9)
    rows = [(f"n{k:04}", v.tolist(), None) for k, v in enumerate(x)] + [(f"z{k:04}", (x[10] * (k % 3 + 1)).tolist(), None) for k in range(30)] + [(f"y{k:04}", x[20].tolist(), None) for k in range(4)]
    got = {tuple(sorted(p)) for p in neighbours.nearest(points(spark, rows).select("id", "vector"), 8, 0.9).select("id", "neighbour").collect()}
    want = brute([r[0] for r in rows], np.array([r[1] for r in rows]), 8)
    assert got == want
