"""Toxicity by class-conditional Kneser-Ney bigram models (operator 5).

Two word-bigram models, one of toxic and one of ordinary labelled texts, share their lowest
backoff distribution (continuation counts of both classes), so an expression that is rare in
either class gets nearly the same probability from both.  A text's evidence is the difference
of the two log-likelihoods per word, over the whole text and over its windows of eight words; a logistic
fit on labelled rows that the models have not seen turns it into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bucket_of, texts_of, written

WORDS = re.compile(r"[^\W_]+").findall
WINDOW = 8
#: Bounds of the labelled sample: rows for the models and rows for the logistic fit.
MODEL_ROWS, FIT_ROWS = 20_000, 6_000
#: Expressions rarer than this in the sample use the shared backoff alone.
LEAST_COUNT = 3


class Model:
    """Log-likelihood ratio per word from bounded count tables, held in arrays.

    ``uni``, ``ctx``: by word, of the word itself and of the backoff after it; ``pair``: by
    (word before, word).  The word before the first is "".
    """

    def __init__(self, uni: dict[str, float], ctx: dict[str, float], pair: Iterable[tuple[str, str, float]], unseen: float):
        self.index = {w: k for k, w in enumerate(dict.fromkeys(["", *uni, *ctx]))}
        self.size = len(self.index) + 1  # words of neither table share the last place
        self.uni, self.ctx = np.full(self.size, unseen), np.zeros(self.size)
        for table, values in ((self.uni, uni), (self.ctx, ctx)):
            table[[self.index[w] for w in values]] = list(values.values())
        at = [(self.index[u] * self.size + self.index[w], x) for u, w, x in pair]
        keys, values = np.array([k for k, _ in at], np.int64), np.array([x for _, x in at])
        order = keys.argsort()
        self.keys, self.pair = keys[order], values[order]
        self.weights: np.ndarray | None = None
        self.prior = 0.0

    def ratios(self, text: str) -> np.ndarray:
        get, unseen = self.index.get, self.size - 1
        word = np.array([get(w, unseen) for w in WORDS(text.lower())], np.int64)
        before = np.concatenate([[0], word[:-1]])[:len(word)]
        out = self.ctx[before] + self.uni[word]
        if len(self.keys):
            key = before * self.size + word
            at = self.keys.searchsorted(key).clip(max=len(self.keys) - 1)
            out = np.where(self.keys[at] == key, self.pair[at], out)
        return out

    def features(self, text: str) -> list[float]:
        x = self.ratios(text)
        n = len(x)
        if not n:
            return [0.0] * 5
        x = np.clip(x, -8, 8)
        sums = np.cumsum(np.concatenate([[0.0], x]))
        width = min(WINDOW, n)
        windows = (sums[width:] - sums[:-width]) / WINDOW
        strong = np.sort(x)[-3:]
        return [float(x.mean()), float(windows.max()), float(x.max()), float(strong.sum() / 3), math.log1p(n)]

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.prior
        z = float(np.dot(self.weights, [1.0, *self.features(text)]))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def pair_counts(labelled: DataFrame) -> DataFrame:
    """(toxic, u, w, n): counts of neighbouring words per class, summed in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for c in (0, 1):
                if counts[c]:
                    u, w = zip(*counts[c])
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(u), pa.int32()), pa.array(u, pa.string()), pa.array(w, pa.string()),
                                                      pa.array(list(counts[c].values()), pa.int64())], ["toxic", "u", "w", "n"])
                    counts[c].clear()

        for b in batches:
            for c, t in zip(b.column(0).to_pylist(), texts_of(b)):
                words = WORDS(t.lower())
                counts[c].update(zip(["", *words], words))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield from out()
        yield from out()

    return labelled.select("_toxic", "_text").mapInArrow(run, "toxic int, u string, w string, n long") \
        .groupBy("toxic", "u", "w").agg(F.sum("n").alias("n"))


def estimate(pairs: DataFrame) -> Model:
    """The two models from pair counts; what reaches the driver is bounded by the labelled sample."""
    side = lambda c, x: F.sum(F.when(F.col("toxic") == c, x).otherwise(0))
    one = F.lit(1)
    totals = pairs.agg(*[side(c, one).alias(f"k{c}") for c in (0, 1)],
                       *[side(c, (F.col("n") == j).cast("long")).alias(f"n{j}{c}") for c in (0, 1) for j in (1, 2)]).first()
    words = pairs.groupBy("w").agg(side(0, one).alias("k0"), side(1, one).alias("k1"), F.sum("n").alias("n"))
    vocab = words.agg(*[F.sum((F.col(f"k{c}") > 0).cast("long")).alias(f"v{c}") for c in (0, 1)], F.count(one).alias("v")).first()
    contexts = pairs.groupBy("u").agg(*[side(c, F.col("n")).alias(f"n{c}") for c in (0, 1)], *[side(c, one).alias(f"t{c}") for c in (0, 1)])
    both = pairs.groupBy("u", "w").agg(*[side(c, F.col("n")).alias(f"n{c}") for c in (0, 1)]).filter(f"n0 + n1 >= {LEAST_COUNT}")
    k = [totals["k0"] or 0, totals["k1"] or 0]
    if not min(k):
        return Model({}, {}, (), 0.0)
    d = [totals[f"n1{c}"] / max(1, totals[f"n1{c}"] + 2 * totals[f"n2{c}"]) or 0.5 for c in (0, 1)]
    v = [vocab["v0"], vocab["v1"]]
    back = [d[c] * v[c] / k[c] for c in (0, 1)]
    shared_all = sum(k) + vocab["v"] + 1

    def unigram(kc: list[int]) -> list[float]:
        shared = (sum(kc) + 1) / shared_all
        return [max(kc[c] - d[c], 0) / k[c] + back[c] * shared for c in (0, 1)]

    rare = unigram([0, 0])
    p = {r["w"]: unigram([r["k0"], r["k1"]]) for r in words.filter(f"n >= {LEAST_COUNT}").toLocalIterator()}
    uni = {w: math.log(x[1] / x[0]) for w, x in p.items()}
    gamma, ctx, size = {}, {}, {}
    for r in contexts.filter(f"n0 + n1 >= {LEAST_COUNT}").toLocalIterator():
        g = [d[c] * r[f"t{c}"] / r[f"n{c}"] if r[f"n{c}"] else 1.0 for c in (0, 1)]
        gamma[r["u"]], size[r["u"]] = g, (r["n0"], r["n1"])
        ctx[r["u"]] = math.log(g[1] / g[0])

    def ratios() -> Iterator[tuple[str, str, float]]:
        for r in both.toLocalIterator():
            g, n, x = gamma[r["u"]], size[r["u"]], p.get(r["w"], rare)
            q = [(max(r[f"n{c}"] - d[c], 0) / n[c] if n[c] else 0.0) + g[c] * x[c] for c in (0, 1)]
            yield r["u"], r["w"], math.log(q[1] / q[0])

    return Model(uni, ctx, ratios(), math.log(rare[1] / rare[0]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton fit; the ridge is on standardised features, never on the intercept."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / std])
    w = np.zeros(a.shape[1])
    reg = np.diag([1e-6] + [ridge * len(x) ** 0.5] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w - np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + reg, a.T @ (p - y) + reg @ w)
    return np.concatenate([[w[0] - (w[1:] * mean / std).sum()], w[1:] / std])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = 4,
        held_bucket: int = 2, model_rows: int = MODEL_ROWS, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from labelled rows outside ``held_bucket``: one bucket for the logistic fit, the
    others for the models, each a sample of at most ``fit_rows`` / ``model_rows`` rows in an
    order by a hash of the id.  Labels of a document that disagree count as toxic; null labels don't count.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("_lid"), labels["toxic"].cast("int").alias("_l")) \
        .dropna().groupBy("_lid").agg(F.max("_l").alias("_toxic")).withColumn("_b", bucket_of("_lid", buckets))
    fit_bucket = (held_bucket + 1) % buckets
    sample = lambda rows, n: rows.orderBy(F.xxhash64("_lid"), "_lid").limit(n)
    chosen = written(sample(known.filter(~F.col("_b").isin(held_bucket, fit_bucket)), model_rows)
                     .unionByName(sample(known.filter(F.col("_b") == fit_bucket), fit_rows)))
    rows = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].cast("string").alias("_text"))
    # at most model_rows + fit_rows pairs of numbers
    labelled = written(rows.join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select("_toxic", "_text", "_b"))
    model = estimate(written(pair_counts(labelled.filter(F.col("_b") != fit_bucket))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.features(t) for t in texts_of(b)], pa.list_(pa.float64()))],
                                             ["y", "x"])

    got = labelled.filter(F.col("_b") == fit_bucket).select("_toxic", "_text").mapInArrow(run, "y int, x array<double>").collect()
    y = np.array([float(r["y"]) for r in got])
    model.prior = float(y.mean()) if len(y) else 0.0
    if len(y) and 0 < y.mean() < 1:
        model.weights = logistic(np.array([r["x"] for r in got]), y)
    return model


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = 4,
          held_bucket: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row's whole text.

    Null text counts as empty; an empty text has the score that the fit gives to no evidence.
    Without labels of both classes every score is the share of toxic labels (0 without any).
    Repeated rows repeat their result.
    """
    model = fit(docs, labels, doc_id, text, buckets, held_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in texts_of(b)], pa.float64())], ["doc_id", "score"])

    got = docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", (bucket_of("doc_id", buckets) == held_bucket).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the score does not reject, each judged by its own text.

    One pass over the table: only the texts go to Python and nothing is shuffled.
    Null text counts as empty, and an empty text has the score of no evidence; ids, also null or
    repeated ones, play no part in the filter.
    """
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "") for t in texts], dtype="float64")

    return docs.filter(toxicity(docs["text"].cast("string")) < threshold)
