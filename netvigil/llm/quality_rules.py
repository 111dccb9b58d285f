"""Operator 3, quality rules: hashed n-gram logistic regression beside fixed count rules.

Words, word pairs and four-byte windows are hashed into fixed tables.  A logistic regression over
their relative frequencies is fitted to a bounded sample of the labelled rows, calibrated on a
fold of it that the fit did not see, and scored in Arrow batches against a fixed threshold.

Defined cases: NULL or wordless text has no words, fails the count rules and is not kept; rows
with a NULL label or id teach nothing; several labels of one id count as the smallest; with
fewer than two classes among the labels there is no model and its probability is 1; repeated
rows are judged one by one; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import crc_mod, table
from netvigil.llm.textvec import (Texts, Words, distinct, duplicate_lines, grams, keep_rows, pieces,
                                  repeated_windows, sums)

BITS = 16  # each of the three tables has 2^16 weights
GROUPS = 3
SCALE = 30.0
MAX_TRAIN_ROWS = 3_000  # labelled rows that the fit may use
KEEP_AT = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

OUT = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
       "n_repeat_words long, base_failed boolean, probability double, kept boolean")


def features(t: Texts, w: Words):
    """Per group: hashed feature index of each occurrence and the text that it occurs in."""
    shift = np.uint64(64 - BITS)
    g, at = grams(w.hash, w.doc, 2)
    out = [(w.hash >> shift, w.doc), (g >> shift, w.doc[at])]
    d = t.data
    n = len(d) - 3
    if n > 0:
        v = (d[:n].astype(np.uint32) | d[1:n + 1].astype(np.uint32) << np.uint32(8)
             | d[2:n + 2].astype(np.uint32) << np.uint32(16) | d[3:n + 3].astype(np.uint32) << np.uint32(24))
        idx = (v * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        doc = np.repeat(np.arange(t.n), np.diff(t.off))
        inside = doc[:n] == doc[3:]
        out.append((idx[inside], doc[:n][inside]))
    else:
        out.append((np.zeros(0, np.uint32), np.zeros(0, np.int64)))
    return [(i.astype(np.int64), doc) for i, doc in out]


@dataclass
class Model:
    """Weights of the three tables, intercept, and the calibration of the margin."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, t: Texts, w: Words) -> np.ndarray:
        m = np.full(t.n, self.intercept)
        for g, (idx, doc) in enumerate(features(t, w)):
            own = self.weights[g << BITS:(g + 1) << BITS]
            m += SCALE * sums(own[idx], doc, t.n) / np.maximum(np.bincount(doc, minlength=t.n), 1)
        return m

    def probability(self, t: Texts, w: Words) -> np.ndarray:
        return sigmoid(self.slope * self.margin(t, w) + self.offset)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _train_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as sparse rows: feature numbers and relative frequencies."""
    for p in pieces(batches):
        t = Texts(p.column("text"), lower=True)
        w = Words(t)
        rows_i: list[list] = [[] for _ in range(t.n)]
        rows_v: list[list] = [[] for _ in range(t.n)]
        for g, (idx, doc) in enumerate(features(t, w)):
            total = np.maximum(np.bincount(doc, minlength=t.n), 1)
            uniq, _, inv = distinct((doc.astype(np.uint64) << np.uint64(BITS)) | idx.astype(np.uint64))
            order = np.argsort(uniq)
            count = np.bincount(inv, minlength=len(uniq))[order]
            uniq = uniq[order].astype(np.int64)
            d = uniq >> BITS
            val = SCALE * count / total[d]
            edge = np.searchsorted(d, np.arange(t.n + 1))
            feat = (uniq & ((1 << BITS) - 1)) + (g << BITS)
            for i in range(t.n):
                rows_i[i].append(feat[edge[i]:edge[i + 1]])
                rows_v[i].append(val[edge[i]:edge[i + 1]])
        yield pa.RecordBatch.from_arrays(
            [p.column("quality"), p.column("fold"),
             pa.array([np.concatenate(x).astype("<u4").tobytes() for x in rows_i], pa.binary()),
             pa.array([np.concatenate(x).astype("<f4").tobytes() for x in rows_v], pa.binary())],
            ["quality", "fold", "idx", "val"])


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows of a binary column side by side, as they lie in it, and where each row starts."""
    whole = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks] or [pa.array([], pa.large_binary())])
    _, offs, data = whole.buffers()
    off = np.frombuffer(offs, np.int64, len(whole) + 1, whole.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]].view(kind), (off - off[0]) // 4


class _Rows:
    """Sparse rows side by side, passed over ``BLOCK`` occurrences at a time: the driver holds them once."""

    BLOCK = 1 << 20

    def __init__(self, tab: pa.Table):
        self.idx, self.off = _flat(tab.column("idx"), "<u4")
        self.val, _ = _flat(tab.column("val"), "<f4")
        self.y = tab.column("quality").to_numpy().astype(float)

    def blocks(self):
        """Rows ``lo`` to ``hi`` with their features, values and sizes."""
        lo, rows = 0, len(self.y)
        while lo < rows:
            hi = max(lo + 1, int(np.searchsorted(self.off, self.off[lo] + self.BLOCK, "right")) - 1)
            own = slice(self.off[lo], self.off[hi])
            yield lo, hi, self.idx[own], self.val[own], np.diff(self.off[lo:hi + 1])
            lo = hi

    def dot(self, w):
        out = np.zeros(len(self.y))
        for lo, hi, idx, val, n in self.blocks():
            some = np.flatnonzero(n)
            if len(some):
                out[lo + some] = np.add.reduceat(w[idx] * val, np.cumsum(n[some]) - n[some])
        return out

    def back(self, r, size):
        out = np.zeros(size)
        for lo, hi, idx, val, n in self.blocks():
            out += np.bincount(idx, weights=np.repeat(r[lo:hi], n) * val, minlength=size)
        return out


def fit_logistic(rows: _Rows, steps: int = 90, rate: float = 0.08, l2: float = 1e-5):
    """Full-batch Adam on the regularised log loss."""
    size = GROUPS << BITS
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    b, mb, vb = np.log((rows.y.mean() + 1e-6) / (1 - rows.y.mean() + 1e-6)), 0.0, 0.0
    for k in range(1, steps + 1):
        r = (sigmoid(rows.dot(w) + b) - rows.y) / len(rows.y)
        g, gb = rows.back(r, size) + l2 * w, r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, cv = 1 - 0.9 ** k, 1 - 0.99 ** k
        w -= rate * (m / c) / (np.sqrt(v / cv) + 1e-8)
        b -= rate * (mb / c) / (np.sqrt(vb / cv) + 1e-8)
    return w, float(b)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets by Newton steps: slope and offset."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    th = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ th)
        grad = x.T @ (p - target) + 1e-3 * (th - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        th = th - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return (float(th[0]), float(th[1])) if th[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """Fit on at most ``max_rows`` labelled documents, the first by a hash of their ids.

    Only the sample's sparse rows reach the driver; each has at most 3 * 2^16 features.
    """
    picked = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
              .withColumn("fold", crc_mod("doc_id", 4).cast("int")))
    sample = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
              .select("text", F.col("quality").cast("int").alias("quality"), "fold"))
    tab = sample.mapInArrow(_train_rows, "quality int, fold int, idx binary, val binary").toArrow()
    y = tab.column("quality").to_numpy()
    fold = tab.column("fold").to_numpy() == 0
    if len(set(y[~fold].tolist())) < 2:
        return None
    taught, tab = tab.filter(pa.array(~fold)), tab.filter(pa.array(fold))  # the whole sample is let go
    w, b = fit_logistic(_Rows(taught))
    model = Model(w.astype(np.float32), b)
    if len(set(y[fold].tolist())) == 2:
        held = _Rows(tab)
        model.slope, model.offset = calibrate(held.dot(w) + b, held.y)
        del held
    del taught, tab
    pa.default_memory_pool().release_unused()
    return model


def judge(model: Model | None, keep_at: float):
    """Counts, probability and verdict of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            t = Texts(p.column("text"))
            w = Words(t)
            cps = (t.data & 0xC0) != 0x80
            c = np.concatenate([[0], np.cumsum(cps)])
            word_chars = sums(c[w.end] - c[w.start], w.doc, t.n).astype(np.int64)
            n_symbols = t.per_text(SYMBOLS[t.data])
            _, dup = duplicate_lines(t, w.start)
            repeat = np.bincount(w.doc[repeated_windows(w)], minlength=t.n)
            failed = (w.count < 50) | (100 * repeat > 50 * w.count)
            if model is None:
                prob = np.ones(t.n)
            else:
                low = Texts(p.column("text"), lower=True)
                prob = model.probability(low, Words(low))
            yield pa.RecordBatch.from_arrays(
                [p.column("doc_id"), *[pa.array(np.asarray(x).astype(np.int64)) for x in
                                       (w.count, word_chars, n_symbols, dup, repeat)],
                 pa.array(failed), pa.array(prob), pa.array(~failed & (prob >= keep_at))],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "probability", "kept"])
    return run


def quality_rules(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT,
                  max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Counts, calibrated probability and verdict of every document (map-only over the texts)."""
    model = fit(docs, labels, max_train_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(judge(model, keep_at), OUT)


def accepted_documents(docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules and the model keep."""
    def kept(p: pa.RecordBatch):
        rows = pa.RecordBatch.from_arrays([pa.nulls(p.num_rows, pa.int64()), p.column("text")], ["doc_id", "text"])
        return np.concatenate([np.asarray(b.column("kept")) for b in judge(model, keep_at)(iter([rows]))])
    return docs.mapInArrow(keep_rows(kept), docs.schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Count rules and the model's verdict on every document."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
