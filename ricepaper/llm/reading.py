"""Reading level of each document.

Method. Gradient-boosted regression trees over distributions of length (words, sentences,
paragraphs), vocabulary (word difficulty learned from the raters, word length, variety, rare
words), syntax (commas, semicolons, brackets, hyphens, connectives) and cohesion (word overlap of neighbouring sentences). Everything is
cross-validated by source: word difficulties of a document never come from its own fold, the
number of trees is the one with the least error on held-out sources, and the cuts that turn the
regression into grades are set on held-out predictions.

Scale. Labels are few; the model is fitted on at most ``MAX_LABELLED`` labelled documents (chosen
by hash), whose word counts and features are made on the executors. Predicting is one narrow map
over whole texts, each document once; model and word table (words of at least ``MIN_DOCS`` sample
documents) are broadcast and bounded by the sample.

Defined results. Several ratings of a document are averaged; null or out-of-range ratings are
ignored. Documents under 40 words, null texts included, get no level. With fewer than
``LEAST_LABELLED`` labelled documents, no level is given at all (no rows).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ricepaper.session import materialize

MAX_LABELLED = 12_000
LEAST_LABELLED = 8
MIN_DOCS = 3
MIN_WORDS = 40
FOLDS = 5
LEVELS = (1, 2, 3, 4)

#: Connectives of English and Vietnamese.
CONNECTIVES = frozenset("and but because so then however although whereas therefore thereby moreover notwithstanding while when if unless thus first rồi và nhưng nên vì khi nếu do trừ mặc tuy hoặc cũng đồng theo sau trước".split())
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _spread(values: list[float] | np.ndarray) -> list[float]:
    if not len(values):
        return [0.0] * (2 + len(_QUANTILES))
    v = np.asarray(values, dtype=float)
    return [float(v.mean()), float(v.std()), *np.quantile(v, _QUANTILES).tolist()]


def features(text: str, difficulty: dict[str, float], mean: float) -> list[float]:
    """The feature vector of one whole text."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    words = [w for s in sentences for w in s]
    n = max(1, len(words))
    known = [difficulty[w] for w in words if w in difficulty]
    per_sentence, weight = [], []
    for s in sentences:
        own = [difficulty[w] for w in s if w in difficulty]
        if own:
            # the marked words of a sentence say more than its plain ones
            own.sort(key=lambda d: -abs(d - mean))
            per_sentence.append(sum(own[: max(3, len(own) // 2)]) / len(own[: max(3, len(own) // 2)]))
            weight.append(len(s))
    per = np.asarray(per_sentence or [mean])
    wt = np.asarray(weight or [1.0], dtype=float)
    shares = [float(wt[(per >= lo) & (per < hi)].sum() / wt.sum()) for lo, hi in ((-9, 1.5), (1.5, 2.0), (2.0, 2.5), (2.5, 3.0), (3.0, 3.5), (3.5, 9))]
    lengths = [len(w) for w in words]
    overlap = []
    for a, b in zip(sentences, sentences[1:]):
        x, y = set(a), set(b)
        overlap.append(len(x & y) / max(1, min(len(x), len(y))))
    counts = Counter(words)
    letters = max(1, len(text))
    return [
        math.log(n), len(sentences), n / max(1, len(sentences)),
        *_spread([len(s) for s in sentences]), *_spread(lengths),
        len(counts) / n, sum(1 for c in counts.values() if c == 1) / n, len(known) / n,
        float((per * wt).sum() / wt.sum()), *_spread(per), *_spread(known), *shares,
        sum(x >= 8 for x in lengths) / n, sum(x >= 12 for x in lengths) / n,
        text.count(",") / n, text.count(";") / n, text.count("(") / n, text.count("-") / n,
        sum(c in counts and counts[c] for c in CONNECTIVES) / n,
        *_spread(overlap)[:2], sum(not c.isascii() for c in text) / letters, sum(c.isdigit() for c in text) / letters,
    ]


class Trees:
    """Least-squares gradient boosting with histogram trees."""

    def __init__(self, trees: int = 160, depth: int = 4, rate: float = 0.08, bins: int = 48, leaf: int = 8):
        self.trees, self.depth, self.rate, self.bins, self.leaf = trees, depth, rate, bins, leaf
        self.made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, held: tuple[np.ndarray, np.ndarray] | None = None) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self._bin(x)
        self.base = float(y.mean())
        now = np.full(len(y), self.base)
        self.errors: list[float] = []
        at_held = None
        if held is not None:
            hb, at_held = self._bin(held[0]), np.full(len(held[0]), self.base)
        n_bins = self.bins + 1
        for _ in range(self.trees):
            rest = y - now
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size)
            node = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                at = node - first
                live = at >= 0
                flat = at[live]
                gain_best = np.full(many, 1e-9)
                for k in range(x.shape[1]):
                    cell = flat * n_bins + b[live, k]
                    c = np.bincount(cell, minlength=many * n_bins).reshape(many, n_bins).cumsum(1)
                    s = np.bincount(cell, weights=rest[live], minlength=many * n_bins).reshape(many, n_bins).cumsum(1)
                    ct, st = c[:, -1:], s[:, -1:]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = s**2 / c + (st - s) ** 2 / (ct - c) - st**2 / ct
                    gain = np.where((c >= self.leaf) & (ct - c >= self.leaf), gain, -1.0)
                    best = gain.argmax(1)
                    top = gain[np.arange(many), best]
                    better = top > gain_best
                    gain_best[better] = top[better]
                    feature[first : first + many][better] = k
                    cut[first : first + many][better] = best[better]
                split = live & (feature[node] >= 0)
                goes = b[np.arange(len(y)), np.maximum(feature[node], 0)] > cut[node]
                node = np.where(split, 2 * node + 1 + goes, node)
            sums = np.bincount(node, weights=rest, minlength=size)
            counts = np.bincount(node, minlength=size)
            value = self.rate * sums / (counts + 1.0)
            self.made.append((feature, cut, value))
            now += value[node]
            if at_held is not None:
                at_held += self._tree(hb, self.made[-1])
                self.errors.append(float(((held[1] - at_held) ** 2).mean()))
        return self

    def _tree(self, b: np.ndarray, tree: tuple) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), dtype=np.int64)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            split = feature[node] >= 0
            goes = b[rows, np.maximum(feature[node], 0)] > cut[node]
            node = np.where(split, 2 * node + 1 + goes, node)
        return value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        out = np.full(len(x), self.base)
        for tree in self.made:
            out += self._tree(b, tree)
        return out


def grade_cuts(predicted: np.ndarray, level: np.ndarray) -> list[float]:
    """Cuts between grades with the fewest wrong grades on held-out predictions."""
    cuts = []
    for k in LEVELS[:-1]:
        near = np.sort(predicted[(predicted > k - 0.5) & (predicted < k + 1.5)])
        tries = np.concatenate([[k + 0.5], (near[1:] + near[:-1]) / 2]) if len(near) > 1 else np.array([k + 0.5])
        tries = tries[np.linspace(0, len(tries) - 1, min(len(tries), 400)).astype(int)]
        wrong = np.array([((predicted >= t) != (level > k + 0.49)).sum() for t in tries])
        best = tries[wrong == wrong.min()]
        # of equally good cuts the one nearest to the middle, which few labels move least
        cuts.append(float(best[np.argmin(np.abs(best - (k + 0.5)))]))
    return cuts


class ReadingModel:
    def __init__(self, trees: Trees, cuts: list[float], difficulty: dict[str, float], mean: float, accuracy: float):
        self.trees, self.cuts, self.difficulty, self.mean, self.accuracy = trees, cuts, difficulty, mean, accuracy

    def grade(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.difficulty, self.mean) for t in texts])
        return 1 + np.searchsorted(self.cuts, self.trees.predict(x), side="right")


def _word_table(counts: pd.DataFrame, mean: float, fold: int | None) -> dict[str, float]:
    """Word difficulties from ``counts(word, fold, s, n)``, without one fold."""
    own = counts if fold is None else counts[counts.fold != fold]
    g = own.groupby("word")[["s", "n"]].sum()
    g = g[g.n >= MIN_DOCS]
    return dict(zip(g.index, (g.s + mean) / (g.n + 1.0)))


def fit(counts: pd.DataFrame, x: np.ndarray, level: np.ndarray, fold: np.ndarray, mean: float) -> ReadingModel:
    """Fit on held-out-by-fold features ``x``; the last word table uses all folds."""
    present = [f for f in np.unique(fold) if 0 < (fold == f).sum() < len(fold)]
    errors, held = [], np.full(len(level), np.nan)
    models = {}
    for f in present:
        out = fold == f
        models[f] = Trees().fit(x[~out], level[~out], (x[out], level[out]))
        errors.append(np.array(models[f].errors) * out.sum())
    best = int(np.argmin(np.sum(errors, axis=0))) + 1 if errors else 60
    for f in present:
        models[f].made = models[f].made[:best]
        held[fold == f] = models[f].predict(x[fold == f])
    sure = ~np.isnan(held)
    cuts = grade_cuts(held[sure], level[sure]) if sure.any() else [1.5, 2.5, 3.5]
    grades = 1 + np.searchsorted(cuts, held[sure], side="right")
    accuracy = float((grades == np.rint(level[sure])).mean()) if sure.any() else float("nan")
    return ReadingModel(Trees(trees=best).fit(x, level), cuts, _word_table(counts, mean, None), mean, accuracy)


def _feature_rows(df: DataFrame, tables, mean: float) -> DataFrame:
    """``(doc_id, level, fold, x)`` of ``df(doc_id, text, level, fold)`` with the fold's own word table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(3).to_pylist()
            x = [features(t, tables.value[f], mean) for t, f in zip(b.column(1).to_pylist(), fold)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "level", "fold", "x"])

    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "text", "level", "fold").mapInArrow(run, f"doc_id {kind}, level double, fold int, x array<double>")


def train(documents: DataFrame, labels: DataFrame) -> ReadingModel | None:
    """A model from ``documents(doc_id, text, source)`` and ``labels(doc_id, level)``; None if labels are too few."""
    spark = documents.sparkSession
    rated = labels.where(F.col("level").between(LEVELS[0], LEVELS[-1])).groupBy("doc_id").agg(F.avg("level").alias("level"))
    long_enough = F.size(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), 0)) >= MIN_WORDS
    fold = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(FOLDS)).cast("int")
    # labels are few: the join keeps the labelled texts, then at most MAX_LABELLED by hash
    sample = (
        documents.select("doc_id", "text", "source").join(rated, "doc_id").where(long_enough)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).select("doc_id", "text", "level", fold.alias("fold"))
    )
    sample = materialize(sample, "labelled")
    seen = sample.agg(F.count("*").alias("n"), F.avg("level").alias("mean")).first()
    if seen.n < LEAST_LABELLED:
        return None

    def docs_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, fold_of, level = [], [], []
            for t, v, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = set(words_of(t))
                word += own
                fold_of += [f] * len(own)
                level += [v] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(fold_of, pa.int32()), pa.array(level, pa.float64())], names=["word", "fold", "level"])

    pairs = sample.select("text", "level", "fold").mapInArrow(docs_words, "word string, fold int, level double")
    per_fold = pairs.groupBy("word", "fold").agg(F.sum("level").alias("s"), F.count("*").alias("n"))
    common = per_fold.groupBy("word").agg(F.sum("n").alias("all"), F.collect_list(F.struct("fold", "s", "n")).alias("per")).where(F.col("all") >= MIN_DOCS)
    counts = common.select("word", F.explode("per").alias("p")).select("word", "p.fold", "p.s", "p.n").toPandas()
    mean = float(seen["mean"])
    tables = spark.sparkContext.broadcast({f: _word_table(counts, mean, f) for f in range(FOLDS)})
    # in key order, so that the fit doesn't depend on how tasks finish
    rows = _feature_rows(sample, tables, mean).toPandas().sort_values("doc_id")
    return fit(counts, np.stack(rows["x"]), rows["level"].to_numpy(), rows["fold"].to_numpy(), mean)


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, level)`` of the documents with at least 40 words."""
    spark = documents.sparkSession
    kind = dict(documents.dtypes)["doc_id"]
    model = train(documents, labels)
    if model is None:
        return spark.createDataFrame([], f"doc_id {kind}, level int")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                texts = b.column(1).to_pylist()
                good = [k for k, t in enumerate(texts) if t is not None and len(t.split()) >= MIN_WORDS]
                if good:
                    grades = shared.value.grade([texts[k] for k in good])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), pa.array(grades.astype(np.int32))], names=["doc_id", "level"])

    return documents.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, level int")
