import math
from datetime import datetime
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from ricepaper.functions import vectors as V
from ricepaper.operators import dense, fusion, rendering, sparse


def test_bm25_against_the_formula(spark):
    docs = {"a": "x x y", "b": "x z", "c": "x w w w", "d": None, "e": "q"}
    df = spark.createDataFrame(list(docs.items()), "id string, text string")
    index = sparse.build(df, "id", "text")
    words = {k: (v or "").split() for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    terms = {t for w in words.values() for t in w}
    raw = {t: math.log(n - (c := sum(t in w for w in words.values())) + 0.5) - math.log(c + 0.5) for t in terms}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}

    def score(q, d):
        return round(sum(idf.get(t, 0) * words[d].count(t) * 2.5 / (words[d].count(t) + 1.5 * (0.25 + 0.75 * len(words[d]) / avg)) for t in q.split()), 6)

    q = spark.createDataFrame([(1, "z w w"), (2, "nothing"), (3, "x")], "qid int, q string")
    got = sparse.top_k(index, q, "qid", "q", 4).collect()
    for qid, text in ((1, "z w w"), (2, "nothing"), (3, "x")):
        want = sorted(((-score(text, d), d) for d in docs))[:4]
        mine = sorted((r["rank"], r.doc, r.score) for r in got if r["query"] == qid)
        assert [m[1] for m in mine] == [d for _, d in want]
        assert np.allclose([m[2] for m in mine], [-s for s, _ in want], atol=1e-5)


def test_dense_ties_bad_vectors_and_repeats(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "qid int, qv array<double>")
    got = [(r["query"], r["rank"], r.key, r.score) for r in dense.exact_top_k(df, q, "id", "v", "qid", "qv", 3).orderBy("rank").collect()]
    assert got == [(9, 1, 1, 1.0), (9, 2, 2, 1.0), (9, 3, 3, 0.0)]
    inverse = dense.exact_top_k(df, q, "id", "v", "qid", "qv", 1, "inverse_ip").first()
    assert (inverse.key, inverse.score) == (3, 1.0)
    assert dense.exact_top_k(df.where("false"), q, "id", "v", "qid", "qv", 3).count() == 0


def test_hash_embedding_is_unit(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), ([],)], "t array<string>")
    vs = [r.v for r in df.select(V.hash_embedding(F.col("t"), 8).alias("v")).collect()]
    assert abs(sum(x * x for x in vs[0]) - 1) < 1e-9 and vs[1] == [0.0] * 8


def test_fusion(spark):
    s = spark.createDataFrame([(1, 1, "a", 4.0), (1, 2, "b", 2.0)], "query int, rank int, doc string, score double")
    d = spark.createDataFrame([(1, 1, "b", 0.9), (1, 2, "c", 0.5)], "query int, rank int, doc string, score double")
    got = {r.doc: (r.place, r.sparse_norm, r.dense_norm, r.score) for r in fusion.blend(fusion.candidates(s, d)).collect()}
    assert got["a"] == (1, 1.0, 0.0, 0.4) and got["b"][:3] == (2, 0.5, 1.0) and got["c"][0] == 3
    flat = s.withColumn("score", F.lit(1.0))
    assert {r.sparse_norm for r in fusion.blend(fusion.candidates(flat, flat)).collect()} == {0.0}


def greedy(cands, q, k, lam):
    unit = [np.array(v) / (np.linalg.norm(v) + 1e-10) for _, v in cands]
    q = np.array(q) / (np.linalg.norm(q) + 1e-10)
    picked = []
    while len(picked) < min(k, len(cands)):
        best = max((i for i in range(len(cands)) if i not in picked), key=lambda i: (round(lam * round(float(unit[i] @ q), 9) - (1 - lam) * max((round(float(unit[i] @ unit[j]), 9) for j in picked), default=0.0), 9), -i))
        picked.append(best)
    return [cands[i][0] for i in picked]


def test_mmr_matches_greedy_and_is_prefix_stable(spark):
    rng = np.random.default_rng(3)
    cands = [(f"d{i}", rng.normal(size=4).tolist()) for i in range(7)] + [("dup", None)]
    cands[7] = ("dup", cands[0][1])
    q = rng.normal(size=4).tolist()
    df = spark.createDataFrame([(1, n, v, q, i) for i, (n, v) in enumerate(cands)], "query int, doc string, v array<double>, qv array<double>, place int")
    full = [r.doc for r in fusion.mmr(df, "query", "doc", "v", "qv", 6, 0.5, "place").orderBy("pick").collect()]
    assert full == greedy(cands, q, 6, 0.5)
    assert [r.doc for r in fusion.mmr(df, "query", "doc", "v", "qv", 3, 0.5, "place").orderBy("pick").collect()] == full[:3]
    few = df.where("place < 3")
    assert fusion.mmr(few, "query", "doc", "v", "qv", 6, 0.65, "place", shrinking=True).count() == 2


def test_evidence_budget(spark):
    rows = [(1, 1, "s", "x" * 50), (1, 2, "s", "  "), (1, 3, None, "y" * 50), (1, 4, "s", "z" * 5000)]
    df = spark.createDataFrame(rows, "query int, rank int, source string, text string")
    r = rendering.pack_evidence(df, "query", "rank", 200, 1200).first()
    assert r.n_blocks == 2 and "[2] SOURCE: unknown" in r.evidence
    assert rendering.pack_evidence(df.where("rank = 4"), "query", "rank", 200, 1200).count() == 0


def test_sparse_search_against_all_pairs(spark, monkeypatch):
    """Frequent, rare and negative terms, repeated words and questions, ties and blocks, against all pairs; no table of pairs is made."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, size=int(rng.integers(0, 12)), p=[0.5, *[0.5 / 59] * 59])) for _ in range(400)]
    df = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)], "id string, text string").repartition(3)
    asked = [" ".join(rng.choice(words, size=4)) for _ in range(12)] + ["w0", "w0 w0 w3", "w3 w0 w0", "none"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, q string")
    monkeypatch.setattr(sparse, "BLOCK", 5)
    index = sparse.build(df, "id", "text")
    hits: dict = {}
    for r in sparse.scores(index, q, "qid", "q").collect():
        hits.setdefault(r["query"], {})[r.doc] = r.score
    monkeypatch.setattr(sparse, "scores", None)
    for only in (False, True):
        got: dict = {}
        for r in sparse.top_k(index, q, "qid", "q", 7, hits_only=only).orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append((r.doc, r.score))
        for i in range(len(asked)):
            own = hits.get(i, {})
            every = own if only else {f"d{n:03d}": own.get(f"d{n:03d}", 0.0) for n in range(len(texts))}
            want = sorted(every.items(), key=lambda x: (-x[1], x[0]))[:7]
            assert [d for d, _ in got.get(i, [])] == [d for d, _ in want]
            assert np.allclose([s for _, s in got.get(i, [])], [s for _, s in want], atol=2e-6)


def test_chunk_rows_take_only_the_named_fields(spark):
    from ricepaper.plans.tables import chunk_rows

    d = "/root/testdata/sf0.001"
    every, few = chunk_rows(spark, d), chunk_rows(spark, d, "text", "source")
    assert few.columns == ["chunk_id", "text", "source"] and "course_ids" not in few._jdf.queryExecution().optimizedPlan().toString()
    assert not few.exceptAll(every.select(*few.columns)).count() and few.count() == every.count()


def test_dense_search_keeps_k_rows_of_a_query_and_task(spark):
    """Batches of 20 rows: what a task returns does not grow with them; repeated keys take no place."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        vectors = spark.range(1000, numPartitions=1).select("id", F.array(F.cos("id"), F.sin("id"), F.lit(0.5)).alias("v"))
        vectors = vectors.unionByName(vectors.where("id < 30")).coalesce(1)
        ask = vectors.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qv")).distinct()
        found = dense.exact_top_k(vectors, ask, "id", "v", "qid", "qv", 5, exclude_same=True)
        v = {r.id: np.array(r.v) / np.linalg.norm(r.v) for r in vectors.collect()}
        for n in (0, 500):
            want = sorted(((-round(float(v[n] @ x), 6), i) for i, x in v.items() if i != n))[:5]
            assert [r.key for r in found.where(F.col("query") == n).orderBy("rank").collect()] == [i for _, i in want]
        kept = []
        best = dense.Best(1, 5)
        for s in range(0, 1000, 20):
            best.add(np.zeros(20, dtype=int), np.arange(s, s + 20) / 1000, dense.pa.array(range(s, s + 20)))
            kept.append(len(best.rows()[0]))
        assert max(kept) == 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hash_embedded_is_hash_embedding(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["ô", "x"])], "k int, ws array<string>")
    want = {r.k: r.v for r in df.select("k", V.hash_embedding(F.coalesce("ws", F.array().cast("array<string>")), 8).alias("v")).collect()}
    got = {r.k: r.v for r in V.hash_embedded(df, "k", "ws", 8).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


def _shuffle_files(spark):
    """The shuffle files there are, and their sizes."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p.name: p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*.data")}


def _chunk_table(spark, folder, rows):
    meta = "struct<source string, doc_id string, chunk_index int, course_ids array<string>>"
    made = spark.createDataFrame([(i, t, (s, "d", 0, None), at) for i, t, s, at in rows], f"id string, text string, metadata {meta}, indexed_at timestamp")
    made.coalesce(2).write.parquet(f"{folder}/chunks.parquet")


def test_chunk_texts_are_those_of_chunk_rows(spark, tmp_path, monkeypatch):
    from ricepaper import session
    from ricepaper.plans.tables import chunk_rows, chunk_texts

    early, late = datetime(2024, 1, 1), datetime(2025, 1, 1)
    rows = [("a", "x", "s", early), ("b", None, "s", early), ("c", "no time", "s", None), (None, "no id", "s", early), ("", "blank", "s", late)]
    rows += [("d", "second", "s", late), ("d", "first", "s", early), ("e", None, "s", early), ("e", "later", "s", late), ("f", "timed", "s", late), ("f", "no time", "s", None), ("g", "same", "s", early), ("g", "same", "s", early)]
    _chunk_table(spark, tmp_path, rows)
    want = {"a": "x", "b": None, "c": None, "": "blank", "d": "first", "e": None, "f": "timed", "g": "same"}
    for most in (session.HASHES, 1):
        monkeypatch.setattr(session, "HASHES", most)
        got = chunk_texts(spark, str(tmp_path)).collect()
        assert len(got) == len(want) and {r.chunk_id: r.text for r in got} == want
    assert {r.chunk_id: r.text for r in chunk_rows(spark, str(tmp_path), "text").collect()} == want


def test_citations_shuffle_neither_all_texts_nor_all_vectors(spark, tmp_path, monkeypatch):
    from ricepaper import session
    from ricepaper.plans import search_queries

    rng = np.random.default_rng(11)
    words = [f"{x:08x}" for x in rng.integers(0, 1 << 32, size=500)]
    rows = [(f"c{i:05d}", " ".join(rng.choice(words, size=60)), f"s{i % 7}", datetime(2024, 1, 1)) for i in range(4000)]
    _chunk_table(spark, tmp_path, rows + [(i, t + " later", "z", datetime(2025, 1, 1)) for i, t, _, _ in rows[:40]])
    spark.createDataFrame([(50, " ".join(words[:3])), (100, words[7])], "answer_id long, query string").write.parquet(f"{tmp_path}/answers.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffle_files(spark)
        found = sorted(map(tuple, search_queries.retrieve_citations(spark, str(tmp_path)).collect()))
        written = sum(size for name, size in _shuffle_files(spark).items() if name not in before)
        assert len(found) == 8 and all(source == f"s{int(chunk[1:]) % 7}" for _, _, source, chunk in found)
        assert written < 0.1 * sum(len(t) for _, t, _, _ in rows)
        # more hashes than are broadcast: the same results
        monkeypatch.setattr(session, "HASHES", 1)
        assert sorted(map(tuple, search_queries.retrieve_citations(spark, str(tmp_path)).collect())) == found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
