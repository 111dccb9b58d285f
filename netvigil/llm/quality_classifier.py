"""Operator 1, quality classifier: a regularised quadratic discriminant.

Document statistics (lengths, repetition, symbols, byte entropy ...) are computed once and
written.  Class means and scatter matrices come from distributed sums over all labelled rows;
each class covariance is shrunk towards the pooled one and towards a multiple of the identity.
A score is the logistic of the difference of the classes' Mahalanobis log densities, from
Cholesky factors that are computed once.

Defined cases: NULL or empty text has zero statistics and gets a score like any other; NULL
labels and ids teach nothing; several labels of one id count as the smallest; if a class has
fewer than two labelled rows every score is the share of label 1 (0.5 without labels); repeated
rows are scored one by one; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import crc_mod, table, written
from netvigil.llm.quality_rules import SYMBOLS, sigmoid
from netvigil.llm.textvec import (Texts, Words, distinct, duplicate_lines, in_text, keep_rows,
                                  pieces, repeated_windows, sums)

TOWARDS_POOLED = 0.15
TOWARDS_IDENTITY = 0.05
PREDICT_AT = 0.3
N_STATS = 17


def statistics(t: Texts) -> np.ndarray:
    """Transformed statistics of each text, one row per text."""
    w = Words(t)
    n = np.maximum(w.count, 1).astype(float)
    size = np.maximum(np.diff(t.off), 1).astype(float)
    d = t.data
    c = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
    length = (c[w.end] - c[w.start]).astype(float)
    mean_len = sums(length, w.doc, t.n) / n
    var_len = np.maximum(sums(length ** 2, w.doc, t.n) / n - mean_len ** 2, 0)
    lines, dup = duplicate_lines(t, w.start)
    repeat = np.bincount(w.doc[repeated_windows(w)], minlength=t.n)
    uniq, first, inv = distinct(in_text(w.hash, w.doc))
    own = w.doc[first]
    kinds = np.bincount(own, minlength=t.n)
    count = np.bincount(inv, minlength=len(uniq))
    top = np.zeros(t.n)
    np.maximum.at(top, own, count)
    same = np.zeros(len(w.doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    owner = np.repeat(np.arange(t.n), np.diff(t.off))
    hist = np.bincount(owner * 256 + d, minlength=t.n * 256).reshape(t.n, 256) / size[:, None]
    entropy = -(hist * np.log2(hist, where=hist > 0, out=np.zeros_like(hist))).sum(1)
    share = lambda flags: t.per_text(flags) / size
    lone = np.bincount(w.doc[(length == 1) & SYMBOLS[d[w.start]]] if len(w.doc) else [], minlength=t.n)
    root = np.sqrt
    return np.stack([
        np.log1p(w.count),
        np.log1p(mean_len),
        np.log1p(root(var_len)),
        root(share(SYMBOLS[d])),
        root(share((d >= 48) & (d <= 57))),
        root(share((d >= 65) & (d <= 90))),
        root(share((d == 46) | (d == 44))),
        root(share(d >= 128)),
        root(dup / np.maximum(lines, 1)),
        root(repeat / n),
        np.log((kinds + 1) / root(n + 1)),
        root(top / n),
        root(np.bincount(w.doc[same], minlength=t.n) / n),
        root(lone / n),
        entropy / 8,
        np.log1p(n / np.maximum(lines, 1)),
        root(np.bincount(w.doc[length <= 3], minlength=t.n) / n),
    ], 1)


def _stats_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in pieces(batches):
        x = statistics(Texts(p.column("text")))
        flat = pa.array(x.reshape(-1))
        yield pa.RecordBatch.from_arrays(
            [p.column("doc_id"), pa.ListArray.from_arrays(
                pa.array(np.arange(0, x.size + 1, N_STATS, dtype=np.int32)), flat)],
            ["doc_id", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), N_STATS)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and class: the sums of (1, x)(1, x)^T as cells."""
    d = N_STATS + 1
    total = {0: np.zeros((d, d)), 1: np.zeros((d, d))}
    for b in batches:
        x = np.concatenate([np.ones((b.num_rows, 1)), _matrix(b.column("stats"))], 1)
        y = np.asarray(b.column("quality"))
        for k, m in total.items():
            own = x[y == k]
            m += own.T @ own
    for k, m in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(d * d, k, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)),
             pa.array(m.reshape(-1))], ["k", "cell", "v"])


class Discriminant:
    """Means, Cholesky factors and log determinants of two classes, computed once."""

    def __init__(self, moments: dict[int, np.ndarray], towards_pooled: float = TOWARDS_POOLED,
                 towards_identity: float = TOWARDS_IDENTITY):
        n = {k: m[0, 0] for k, m in moments.items()}
        total = sum(n.values())
        self.share = n[1] / total if total else 0.5
        self.ready = min(n.values()) >= 2
        if not self.ready:
            return
        mean = {k: m[0, 1:] / n[k] for k, m in moments.items()}
        cov = {k: m[1:, 1:] / n[k] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = sum(n[k] * cov[k] for k in n) / total
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
        rescale = lambda c: c / np.outer(self.scale, self.scale)
        self.mean = {k: m / self.scale for k, m in mean.items()}
        self.inverse, self.log_det = {}, {}
        for k in n:
            c = (1 - towards_pooled) * rescale(cov[k]) + towards_pooled * rescale(pooled)
            c = (1 - towards_identity) * c + towards_identity * np.trace(c) / N_STATS * np.eye(N_STATS)
            factor = np.linalg.cholesky(c + 1e-9 * np.eye(N_STATS))
            self.inverse[k] = np.linalg.inv(factor)
            self.log_det[k] = 2 * np.log(np.diag(factor)).sum()
        self.log_odds = np.log(n[1] / n[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        z = x / self.scale
        density = {k: -0.5 * (((z - self.mean[k]) @ self.inverse[k].T) ** 2).sum(1) - 0.5 * self.log_det[k]
                   for k in (0, 1)}
        return sigmoid(density[1] - density[0] + self.log_odds)


def _score_rows(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(model.score(_matrix(b.column("stats"))))], ["doc_id", "score"])
    return run


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` of every document: one pass over the texts, written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(_stats_rows, "doc_id long, stats array<double>"), "doc-stats")


def fit(stats: DataFrame, labels: DataFrame, teach=None) -> Discriminant:
    """Fit on all labelled rows (that ``teach`` allows); the driver gets 2 * (statistics + 1)^2 sums."""
    marked = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
              .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    if teach is not None:
        marked = marked.where(teach)
    cells = (stats.join(marked, "doc_id").select("quality", "stats")
             .mapInArrow(_moments, "k int, cell int, v double")
             .groupBy("k", "cell").agg(F.sum("v").alias("v")).collect())
    d = N_STATS + 1
    moments = {0: np.zeros(d * d), 1: np.zeros(d * d)}
    for r in cells:
        moments[r.k][r.cell] = r.v
    return Discriminant({k: m.reshape(d, d) for k, m in moments.items()})


def quality_scores(docs: DataFrame, labels: DataFrame, teach=None) -> DataFrame:
    """``doc_id, score`` of every document; ``teach`` is a condition on the labelled ids to learn from.

    The fit and the scores read only the written statistics.
    """
    stats = document_statistics(docs)
    return stats.mapInArrow(_score_rows(fit(stats, labels, teach)), "doc_id long, score double")


def accepted_documents(docs: DataFrame, model: Discriminant, at: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches ``at``."""
    def kept(p: pa.RecordBatch):
        return model.score(statistics(Texts(p.column("text")))) >= at
    return docs.mapInArrow(keep_rows(kept), docs.schema)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learned from four fifths of the ids."""
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                            teach=crc_mod("doc_id", 5) != 0)
    return scores.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
