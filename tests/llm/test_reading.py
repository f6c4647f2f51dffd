import random

import numpy as np

from ricepaper.llm import reading

PLAIN = "you can play a game with a friend in the club and we like it".split()
GUIDE = "the advising desk answers questions about laboratory places and course registration every monday".split()
FORMAL = "notwithstanding the completion candidates remain subject to specialisation requirements as approved by the accreditation panel".split()
RESEARCH = "stochastic regularisation marginalises the longitudinal sparsity of embedding manifold geometries under latent perturbations".split()


def text(level, rng, words=80):
    out = []
    while sum(len(s) for s in out) < words:
        pool = (PLAIN, GUIDE, FORMAL, RESEARCH)[level - 1]
        out.append([rng.choice(pool) for _ in range(6 + 4 * level)])
    return ". ".join(" ".join(s).capitalize() for s in out) + "."


def test_held_out_levels(spark):
    rng = random.Random(2)
    docs = [(k, text(k % 4 + 1, rng), f"s{k % 7}", "clash") for k in range(240)] + [(900, None, "s", "c"), (901, "", None, "c"), (902, "too short", "s", "c"), (903, text(4, rng, 30_000), None, "c")]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, level string")
    labels = spark.createDataFrame([(k, k % 4 + 1, "r") for k in range(240) if k % 8 < 4] + [(0, None, "r"), (2, 3, "s"), (4, 9, "r"), (5000, 1, "r"), (900, 2, "r")], "doc_id long, level int, rater string")
    got = {r.doc_id: r.level for r in reading.reading_levels(documents, labels).collect()}
    assert set(got) == set(range(240)) | {903}
    assert np.mean([got[k] == k % 4 + 1 for k in range(240) if k % 8 >= 4]) >= 0.9 and got[903] == 4


def test_too_few_labels(spark):
    documents = spark.createDataFrame([(1, "a " * 50, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 2, "r")], "doc_id long, level int, rater string")
    assert reading.reading_levels(documents, labels).count() == 0
    assert reading.reading_levels(documents.where("false"), labels.where("false")).count() == 0


def test_trees_fit_steps():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = 1.0 + (x[:, 0] > 0) + 2.0 * (x[:, 1] > 0.5)
    m = reading.Trees(trees=80).fit(x, y)
    assert np.abs(m.predict(x) - y).mean() < 0.1
    assert reading.grade_cuts(y, y) == sorted(reading.grade_cuts(y, y))
