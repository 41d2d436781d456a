"""Toxic passages by maximum-scoring segments.

Words are hashed to a fixed number of buckets. From labelled documents each bucket gets the log-odds of its rate in toxic
against other texts, a text counting once however often it repeats a word, with an informative Dirichlet prior (Monroe, Colaresi and Quinn 2008); those within the noise of
their own variance count nothing. With a drift subtracted from every word, the mean score of ordinary text is negative,
and a linear scan (Ruzzo and Tompa 1999) finds all maximal segments of a text. The chance of a segment of score S in a
text of n words is that of an extreme value, K n exp(-lambda S) (Karlin and Altschul 1990): lambda follows from the scores
of clean words, K from the best segments of clean documents. A logistic curve turns the evidence into a probability.

Bounds: `buckets` counts of each class and `sample_rows` labelled rows at most (an exact count chooses the share of a hash
of their ids; all of them where there are fewer) are used for fitting, so what the driver holds and broadcasts is fixed.
Bucket scores come from three quarters of the fitting rows and the curve from the rest. Every document is scored, whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofact.llm.text import NOT_WORD, let, lower_ascii, named, words
from chronofact.session import stored

BUCKETS = 1 << 18
SAMPLE_ROWS = 200_000
THRESHOLD = 0.3
E_VALUE = 0.01


@dataclass(frozen=True)
class Model:
    """scores: of each bucket, drift included. lam, k: of the extreme value law. mean, scale, weights: of the curve."""

    scores: np.ndarray
    lam: float
    k: float
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _tokens(text: Column, buckets: int) -> Column:
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")
    return let(words(lower_ascii(text), NOT_WORD), lambda w: F.transform(w, bucket))


def log_odds(toxic: np.ndarray, clean: np.ndarray, share: float = 0.1, z: float = 3.0) -> np.ndarray:
    """Log-odds of buckets by their counts in both classes; zero where within z deviations of zero. The prior is a share of
    the counts of both classes together."""
    n1, n0 = toxic.sum(), clean.sum()
    if not n1 or not n0:
        return np.zeros(len(toxic))
    a = share * (toxic + clean) + 1e-6
    prior = a.sum()
    odds = lambda y, n: np.log((y + a) / (n + prior - y - a))
    delta = odds(toxic, n1) - odds(clean, n0)
    return np.where(np.abs(delta) >= z * np.sqrt(1 / (toxic + a) + 1 / (clean + a)), delta, 0.0)


def extreme_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 where no score is positive."""
    p = counts / max(counts.sum(), 1)
    own = p > 0
    s, p = scores[own], p[own]
    if not len(s) or s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while (p * np.exp(hi * s)).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    return hi


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in linear time. Neighbours of one sign are merged
    before, which changes no segment."""
    if not len(s) or s.max() <= 0:
        return []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(s > 0)) + 1])
    sums = np.add.reduceat(s, starts).tolist()
    ends = np.append(starts[1:], len(s)).tolist()
    starts = starts.tolist()
    stack: list[list] = []  # start, end, total before, total after
    total = 0.0
    for a, z, x in zip(starts, ends, sums, strict=True):
        before, total = total, total + x
        if x <= 0:
            continue
        new = [a, z, before, total]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j -= 1
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3]]
            del stack[j:]
    return [(a, z, r - l) for a, z, l, r in stack]


def evidence(s: np.ndarray, lam: float, k: float, limit: float = E_VALUE) -> tuple[list[float], list[tuple[int, int, float, float]]]:
    """What the curve reads of a text, and its significant passages (start, end, score, E-value)."""
    n = len(s)
    found = segments(s)
    size = np.log(k * max(n, 1))
    passages = [(a, z, x, float(np.exp(min(50.0, size - lam * x)))) for a, z, x in found]
    best = max((lam * x for *_, x in found), default=0.0)
    good = [p for p in passages if p[3] <= limit]
    bits = sum(lam * p[2] - size for p in good)
    return [float(np.clip(best - size, -20, 40)), float(np.log1p(max(0.0, bits))), float(np.log1p(len(good))), float(np.log1p(n))], good


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps; the constant is not shrunk."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    shrink = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + shrink
        w = w - np.linalg.solve(h, a.T @ (p - y) + shrink @ w)
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS, drift: float = 0.25) -> Model:
    """Learn from the labelled documents that aren't held out. Labels other than 0 and 1 are left out."""
    marked = named(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    marked = marked.select(F.col("doc_id").alias("_id"), "toxic").distinct()
    share = min(1.0, sample_rows / max(1, marked.count()))
    marked = F.broadcast(marked.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000)))  # sample_rows
    own = named(docs, "doc_id", "text").join(marked, F.col("doc_id") == F.col("_id"))
    own = own.select("doc_id", "toxic", _tokens(F.col("text"), buckets).alias("t"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 3).alias("curve"))
    own = stored(docs.sparkSession, own, "toxicity-sample")
    counts = np.zeros((2, buckets))
    for r in own.where(~F.col("curve")).select("toxic", F.explode(F.array_distinct("t")).alias("b")).groupBy("b").agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).collect():
        counts[:, r["b"]] = r["n"] - r["y"], r["y"]  # at most `buckets` rows
    scores = log_odds(counts[1], counts[0]) - drift
    lam = extreme_rate(scores, counts[0])
    rows = own.where("curve").select("toxic", "t")
    best = _measured(rows, scores, lam, 1.0)
    clean = best[best[:, 0] == 0]
    k = float(1 / np.mean(np.exp(-(clean[:, 1])))) if len(clean) else 1.0  # K n exp(-lambda S) is exponential with mean 1
    if not len(best) or len(np.unique(best[:, 0])) < 2:
        rate = (counts[1].sum() + 1) / (counts.sum() + 2)
        return Model(scores, lam, k, np.zeros(4), np.ones(4), np.array([np.log(rate / (1 - rate)), 0, 0, 0, 0]))
    best = _measured(rows, scores, lam, k)
    return Model(scores, lam, k, *_curve(best[:, 1:], best[:, 0]))


def _measured(rows: DataFrame, scores: np.ndarray, lam: float, k: float) -> np.ndarray:
    """Label and evidence of sampled rows, as an array of `sample_rows` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [evidence(scores[np.asarray(t.values)], lam, k)[0] for t in b.column(1)]
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(run, "y long, x array<double>").collect()
    return np.array([[r["y"], *r["x"]] for r in got]).reshape(-1, 5)


def apply(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and passages: the significant segments (first word, end, score, E-value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, passages = [], []
            for t in b.column(2):
                e, good = evidence(model.scores[np.asarray(t.values)], model.lam, model.k)
                x.append(e)
                passages.append([dict(zip(("start", "end", "score", "e_value"), p, strict=True)) for p in good])
            z = model.weights[0] + ((np.array(x).reshape(-1, 4) - model.mean) / model.scale) @ model.weights[1:]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            new = [pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(passages, kind)]
            yield pa.record_batch([b.column(0), b.column(1), *new], names=["doc_id", "held_out", "score", "predicted", "passages"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
    rows = named(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _tokens(F.col("text"), len(model.scores)).alias("t"))
    schema = "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start: bigint, end: bigint, score: double, e_value: double>>"
    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """Fit on labels and score all docs.

    A row for each row of docs. Null and empty texts have no words: their score is that of a text without evidence. A null
    doc_id is not held out. Without labels of both kinds, every text gets the share of toxic words. Labels, lang, source
    and doc_id aren't read for a score. Empty tables give no rows. Rows that repeat, and texts that are equal, have equal scores;
    a doc_id labelled both ways teaches both. doc_id is a number: anything else is an error of the cast.
    """
    return apply(docs, fit(docs, labels, **fitting))
