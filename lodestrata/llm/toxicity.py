"""A toxicity classifier, regularised by counterfactual pairs.

Logistic regression over the words of a text and their beginnings and endings
(so that inflected forms count together). Besides the labelled documents, it
sees pairs of sentences that differ in identity terms only: each difference of
their logits is penalised, so that naming a group doesn't raise a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, frozen, pieces, short_batches, table

#: Labelled rows that a fit takes at most: those of the lowest hash of their doc_id.
MAX_ROWS = 12_000
#: Features kept, of those that occur in MIN_DOCS sampled documents and part the labels by chi-squared over MIN_CHI2.
MAX_FEATURES, MIN_DOCS, MIN_CHI2 = 2048, 5, 10.8
#: The folds by crc32 of the doc_id; fold 0 is held out.
FOLDS = 5
#: Sampled rows of one task of the fit.
FIT_ROWS = 750
#: Weights of the ridge and of the counterfactual penalty; steps of the optimiser.
RIDGE, COUNTERFACTUAL, STEPS = 0.02, 1.0, 400
#: Words whose features a worker remembers.
CACHE = 300_000
#: Terms within a row may stand for each other; each is swapped for the next of its row.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("she", "he"),
    ("black", "white", "asian", "latino", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("african", "american", "european", "mexican", "chinese", "indian"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("old", "young"),
    ("frauen", "männer"),
    ("juden", "christen", "muslime"),
    ("femmes", "hommes"),
    ("juifs", "chrétiens", "musulmans"),
    ("mujeres", "hombres"),
    ("judíos", "cristianos", "musulmanes"),
)
SWAPS = {t: row[(i + 1) % len(row)] for row in IDENTITY for i, t in enumerate(row)}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; digits, marks and signs part words."""
    return _WORD.findall((text or "").lower())


def distinct_words(text: str | None) -> set[str]:
    """The distinct words of a whole text, which is cut into words piece by piece."""
    found: set[str] = set()
    for piece in pieces(text):
        found.update(words_of(piece))
    return found


def word_features(w: str) -> list[str]:
    """The word, its beginnings of 3 to 6 letters and its endings of 3 to 5."""
    return ["w:" + w, *("p:" + w[:k] for k in (3, 4, 5, 6) if len(w) >= k), *("s:" + w[-k:] for k in (3, 4, 5) if len(w) >= k)]


def counterfactuals(text: str | None) -> Iterator[tuple[list[str], list[str]]]:
    """(words, words with the identity terms swapped) of each sentence that has such terms, one after the other."""
    text, at = text or "", 0
    while at <= len(text):
        end = _SENTENCE.search(text, at)
        words = words_of(text[at : end.start() if end else len(text)])
        if any(w in SWAPS for w in words):
            yield words, [SWAPS.get(w, w) for w in words]
        at = end.end() if end else len(text) + 1


class Vocabulary:
    """The indices of the kept features that a word has, remembered for a bounded number of words."""

    def __init__(self, features: list[str]):
        self.at, self.cache = {f: i for i, f in enumerate(features)}, {}

    def indices(self, words) -> set[int]:
        found: set[int] = set()
        at, cache = self.at, self.cache
        for w in set(words):
            f = cache.get(w)
            if f is None:
                if len(cache) >= CACHE:
                    cache.clear()
                f = cache[w] = tuple(at[x] for x in word_features(w) if x in at)
            if f:
                found.update(f)
        return found


class Model:
    """Features, weights and bias; at most MAX_FEATURES of them, so it may be sent to every task."""

    def __init__(self, features: list[str], weights: list[float], bias: float):
        self.features, self.weights, self.bias = features, weights, bias

    def scorer(self):
        vocabulary, weights, bias = Vocabulary(self.features), self.weights, self.bias

        def score(text: str | None) -> float:
            x = bias + sum(weights[i] for i in sorted(vocabulary.indices(distinct_words(text))))
            return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))

        return score


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, y): at most max_rows labelled documents, none of fold 0, in an order that depends on the doc_id alone.

    Of contradicting labels of a doc_id the larger one counts; null labels and
    ids are left out. The ids are at most max_rows, hence the broadcast.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != 0))
    own = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(picked), "doc_id").select("text", "y")
    return frozen(rows.repartition(max(2, max_rows // FIT_ROWS)))


def _statistics(rows: DataFrame) -> DataFrame:
    """(feature, pos, neg): sampled documents of each label that have the feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                counts[y].update({f for w in distinct_words(text) for f in word_features(w)})
            if len(counts[0]) + len(counts[1]) > 2_000_000:
                yield _rows(counts)
        yield _rows(counts)

    def _rows(counts: tuple[Counter, Counter]) -> pd.DataFrame:
        names = [*(counts[0].keys() | counts[1].keys())]
        out = pd.DataFrame({"feature": names, "pos": [counts[1][f] for f in names], "neg": [counts[0][f] for f in names]})
        counts[0].clear(), counts[1].clear()
        return out

    sums = rows.mapInPandas(run, "feature string, pos long, neg long").groupBy("feature")
    return sums.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learn from a bounded sample of labelled documents. Without any, or without both labels, every score is the share of label 1 (0 for none)."""
    short_batches(docs.sparkSession)
    rows = sample(docs, labels, label, max_rows)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n, pos = total["n"], total["pos"]
    if not 0 < pos < n:
        share = min(max(pos / n if n else 0.0, 1e-6), 1 - 1e-6)
        return Model([], [], float(np.log(share / (1 - share))))
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    df, neg = a + b, n - pos
    chi2 = n * F.pow(a * (neg - b) - b * (pos - a), 2) / (df * (n - df + 1e-9) * float(pos) * float(neg))
    ranked = _statistics(rows).filter(F.col("pos") + F.col("neg") >= MIN_DOCS).withColumn("chi2", chi2).filter(F.col("chi2") > MIN_CHI2)
    kept = ranked.orderBy(F.desc("chi2"), "feature").limit(MAX_FEATURES).collect()
    features = [r["feature"] for r in kept]

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = Vocabulary(features)
        for b in batches:
            xs, swaps = [], []
            for text in b["text"]:
                xs.append(sorted(v.indices(distinct_words(text))))
                pairs = ((v.indices(p), v.indices(q)) for p, q in counterfactuals(text))
                # sentences that differ in the same features count together: a row's pairs are few, however long its text
                moved = Counter((tuple(sorted(p - q)), tuple(sorted(q - p))) for p, q in pairs if p != q)
                swaps.append([{"up": list(p), "down": list(q), "n": n} for (p, q), n in sorted(moved.items())])
            yield pd.DataFrame({"y": b["y"], "x": xs, "swaps": swaps})

    got = rows.mapInPandas(vectors, "y int, x array<int>, swaps array<struct<up:array<int>,down:array<int>,n:long>>").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))
    times: Counter = Counter()
    for r in got:
        for x in r["swaps"]:
            times[tuple(x["up"]), tuple(x["down"])] += x["n"]
    return train(features, [r["x"] for r in got], [r["y"] for r in got], sorted(times.items()))


def train(features: list[str], xs: list[list[int]], ys: list[int], swaps: list[tuple[tuple[tuple, tuple], int]]) -> Model:
    """Adam on the mean log loss + RIDGE * |w|^2 / 200 + COUNTERFACTUAL * mean squared logit difference of the swapped sentences.

    ``swaps`` has ((features that a swap takes, features that it brings), sentences) for each distinct pair.
    """
    m, n = len(features), len(xs)
    times = np.array([k for _, k in swaps], float)
    swaps = [pair for pair, _ in swaps]
    row = np.repeat(np.arange(n), [len(x) for x in xs])
    col = np.fromiter((i for x in xs for i in x), np.int64, len(row))
    y = np.array(ys, float)
    s_row = np.fromiter((k for k, (p, q) in enumerate(swaps) for _ in range(len(p) + len(q))), np.int64)
    s_col = np.fromiter((i for p, q in swaps for i in (*p, *q)), np.int64)
    s_sign = np.fromiter((s for p, q in swaps for s in (*[1.0] * len(p), *[-1.0] * len(q))), float)
    w, bias = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, w[col], n), -30, 30)))
        err = (p - y) / n
        g = np.bincount(col, err[row], m) + RIDGE * w / 100
        if swaps:
            diff = np.bincount(s_row, w[s_col] * s_sign, len(swaps)) * times
            g += COUNTERFACTUAL * 2 / times.sum() * np.bincount(s_col, diff[s_row] * s_sign, m)
        g = np.append(g, err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * min(1.0, 2 * (1 - t / (STEPS + 1))) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:m], bias - step[m]
    return Model(features, w.tolist(), float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; the score reads the whole text and nothing else.

    A null text scores as an empty one, by the bias. A null doc_id hashes as the
    empty text (fold 0). Repeated rows stay; an empty table gives an empty one.
    """
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = model.scorer()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "score": np.array([f(t) for t in b["text"]], float)})

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("text").cast("string"))
    scored = rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the score of every document, learnt from the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def reject(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score reaches 0.5 go; the others keep every column, in one pass without a shuffle."""
    short_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = model.scorer()
        for b in batches:
            yield b.filter(pa.array([f(t) < 0.5 for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
