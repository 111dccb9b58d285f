"""Operator 10, benchmark decontamination with SimHash windows.

Windows are sized by the benchmark item's words and shingle weights: W is the largest power of two
so that every passage similar enough to the item, edited anywhere or cut off by the document's ends,
must contain 2W - 1 of the item's words in a run.  The item's windows start at every word, a
document's at every W-th, so one of the document's windows equals one of the item's.  Windows are compared by 64-bit SimHash: the fingerprint is cut into radius + 1 blocks,
and two fingerprints within the radius agree in one block at least, so no pair inside the radius
is missed.  Candidates are verified exactly: weighted Jaccard similarity of word shingles between
the item and every item-sized passage that can hold the window.

The benchmark is a stated query set: it is taken in blocks of bounded size, each against all
documents in a map-only pass.  A document is never shuffled.

Defined cases: NULL, empty or wordless texts and items match nothing; items shorter than a
shingle are one shingle; repeated items and rows give their rows each; NULL ids are kept; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import table
from netvigil.llm.license_scan import word_view
from netvigil.llm.textvec import Texts, Words, grams, keep_rows, pieces, ragged

SHINGLE = 5
MIN_SIMILARITY = 0.8
RADIUS = 3
BLOCK_ITEMS = 2_000  # items of one pass

OUT = ("doc_id long, item_id long, similarity double, first_word long, n_words long, "
       "first_byte long, end_byte long")


def similar_in_runs(run: int, words: int, weights: np.ndarray, distinct: np.ndarray, shared: np.ndarray,
                    similarity: float, k: int) -> bool:
    """Whether a passage whose runs of the item's words are all at most ``run`` long may be similar.

    ``weights`` are the item's shingle weights in order, ``distinct`` those of its distinct shingles,
    ``shared`` the words (up to k - 1) that a run from each of the item's words may share with the
    run before, as they are repeated in the item.  A similar passage keeps ``similarity`` of the
    item's weight, whatever else it holds and wherever the document cuts it off.  In ``p`` runs it
    keeps no more than ``p`` times the heaviest run, and, as it has at most the item's words, a run
    needs ``k - 1`` words beside its shingles.
    """
    length = min(run - k + 1, len(weights))
    if length < 1:
        return False
    run_sums = np.concatenate([[0.0], np.cumsum(weights)])
    heaviest = (run_sums[length:] - run_sums[:-length]).max()
    top = np.concatenate([[0.0], np.cumsum(np.sort(distinct)[::-1])])
    p = np.arange(1, words + 1)
    saved = np.cumsum(np.concatenate([[0], np.sort(shared)[::-1]]))[p - 1]
    room = words - p * (k - 1) + saved
    shingles = np.clip(np.minimum(p * length, room), 0, len(distinct))
    return bool((np.minimum(p * heaviest, top[shingles]) >= similarity * top[-1] - 1e-9).any())


def window_size(words: int, weights: np.ndarray, distinct: np.ndarray, shared: np.ndarray,
                similarity: float, k: int) -> int:
    """Largest power of two W so that every similar passage has a run of 2W - 1 of the item's words."""
    w = 1
    while 4 * w - 1 <= words and (words <= k or not similar_in_runs(4 * w - 2, words, weights, distinct, shared,
                                                                      similarity, k)):
        w *= 2
    return w


def simhash(windows: np.ndarray) -> np.ndarray:
    """64-bit SimHash of the rows of word hashes."""
    n, w = windows.shape
    bits = np.unpackbits(np.ascontiguousarray(windows).view(np.uint8).reshape(n, w, 8), axis=2)
    return np.packbits(bits.sum(1, dtype=np.int32) * 2 > w, axis=1).view(np.uint64).reshape(n)


class Index:
    """Fingerprints, shingles and weights of one block of items."""

    def __init__(self, ids: list, texts: list, weights: dict[int, float] | None = None,
                 similarity: float = MIN_SIMILARITY, k: int = SHINGLE, radius: int = RADIUS):
        _, w = word_view(pa.array(texts, pa.string()))
        self.ids, self.k, self.similarity, self.radius = ids, k, similarity, radius
        self.length = w.count
        self.shingles = [self.shingle_set(w.hash[a:b]) for a, b in zip(w.off[:-1], w.off[1:])]
        self.weights = weights or {}
        self.classes = []
        size = np.array([self.stride(w.hash[a:b]) for a, b in zip(w.off[:-1], w.off[1:])])
        for width in sorted(set(size.tolist()) - {0}):
            own = np.flatnonzero(size == width)
            n = w.count[own] - width + 1
            at = ragged(w.off[own], n)
            item = np.repeat(own, n)
            prints = simhash(w.hash[at[:, None] + np.arange(width)])
            edges = np.linspace(0, 64, radius + 2).astype(int)
            blocks = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                v = self.block(prints, lo, hi)
                order = np.argsort(v, kind="stable")
                blocks.append((lo, hi, v[order], order))
            self.classes.append((width, prints, item, at - w.off[item], blocks))

    @staticmethod
    def block(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    def shingle_set(self, h: np.ndarray) -> np.ndarray:
        """Distinct shingle hashes of a run of words (all words, if they are fewer)."""
        if len(h) == 0:
            return np.zeros(0, np.uint64)
        g, _ = grams(h, np.zeros(len(h), np.int8), min(self.k, len(h)))
        return np.unique(g)

    def stride(self, h: np.ndarray) -> int:
        """Window size of the item with these word hashes, 0 without words."""
        n = len(h)
        if n == 0:
            return 0
        zero = np.zeros(n, np.int8)
        g, _ = grams(h, zero, min(self.k, n))
        each, inv = np.unique(g, return_inverse=True)
        weights = np.array([self.weights.get(x, 1.0) for x in each.tolist()])
        shared = np.zeros(n, np.int64)
        for o in range(1, min(self.k, n + 1)):
            part, at = grams(h, zero, o)
            _, back, times = np.unique(part, return_inverse=True, return_counts=True)
            shared[at[times[back] > 1]] = o
        return window_size(n, weights[inv], weights, shared, self.similarity, self.k)

    def candidates(self, w: Words) -> np.ndarray:
        """Distinct (text, item, start word) rows whose windows are within the radius."""
        found = []
        for width, prints, item, offset, blocks in self.classes:
            n = w.count // width
            doc = np.repeat(np.arange(len(n)), n)
            at = w.off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * width
            if not len(at):
                continue
            own = simhash(w.hash[at[:, None] + np.arange(width)])
            for lo, hi, values, order in blocks:
                v = self.block(own, lo, hi)
                a, b = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
                left = np.repeat(np.arange(len(v)), b - a)
                right = order[ragged(a, b - a)]
                near = np.bitwise_count(own[left] ^ prints[right]) <= self.radius
                left, right = left[near], right[near]
                found.append(np.stack([doc[left], item[right],
                                       at[left] - w.off[doc[left]] - offset[right]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def weighted(self, shingles: np.ndarray) -> float:
        return sum(self.weights.get(s, 1.0) for s in shingles.tolist())

    def verify(self, w: Words, doc: int, item: int, least: int, most: int) -> tuple[float, int, int]:
        """Best weighted similarity of an item-sized passage that starts from word ``least`` to
        ``most``: similarity, first word, words.

        Only passages with enough of the item's weight, repeated shingles counted each time, are
        compared exactly.
        """
        length, target = int(self.length[item]), self.shingles[item]
        base, n = int(w.off[doc]), int(w.count[doc])
        k = min(self.k, length)
        start = np.arange(max(least, 1 - length), min(most, n - 1) + 1)
        lo, hi = np.maximum(start, 0), np.minimum(start + length, n)
        first, last = int(lo[0]), int(hi[-1])
        g, _ = grams(w.hash[base + first:base + last], np.zeros(last - first, np.int8), k)
        at = np.minimum(np.searchsorted(target, g), len(target) - 1)
        weight = np.array([self.weights.get(x, 1.0) for x in target.tolist()])
        total = weight.sum()
        held = np.concatenate([[0.0], np.cumsum(np.where(target[at] == g, weight[at], 0.0))])
        bound = held[np.maximum(hi - first - k + 1, lo - first).clip(0, len(g))] - held[(lo - first).clip(0, len(g))]
        likely = np.flatnonzero(bound >= self.similarity * total - 1e-9)
        best = (0.0, 0, 0)
        for i in likely[np.argsort(-bound[likely], kind="stable")].tolist():
            if bound[i] / total < best[0]:
                break
            a, b = int(lo[i]), int(hi[i])
            own = self.shingle_set(w.hash[base + a:base + b])
            common = self.weighted(np.intersect1d(own, target, assume_unique=True))
            sim = common / (self.weighted(own) + self.weighted(target) - common)
            if sim > best[0]:
                best = (sim, a, b - a)
            if sim == 1.0:
                break
        return best

    def matches(self, w: Words) -> dict[tuple[int, int], tuple[float, int, int]]:
        """Best verified passage by text and item: all passages that can hold a candidate's window."""
        rows: dict[tuple[int, int], tuple] = {}
        c = self.candidates(w)
        if not len(c):
            return rows
        size = self.length[c[:, 1]]
        new = np.ones(len(c), bool)
        new[1:] = (c[1:, :2] != c[:-1, :2]).any(1) | (c[1:, 2] - c[:-1, 2] > 2 * size[1:])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(c)]]) - 1
        for (doc, item, start), end in zip(c[first].tolist(), c[last, 2].tolist()):
            best = rows.get((doc, item), (0.0,))[0]
            if best < 1.0:
                n = int(self.length[item])
                got = self.verify(w, doc, item, start - n, end + n)
                if got[0] >= self.similarity and got[0] > best:
                    rows[doc, item] = got
        return rows


def _find(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            t, w = word_view(p.column("text"))
            yield _rows(p, index, t, w, index.matches(w))
    return run


def _rows(p: pa.RecordBatch, index: Index, t: Texts, w: Words, rows: dict) -> pa.RecordBatch:
    doc = np.array([d for d, _ in rows], np.int64)
    sim, first, n = (np.array([r[j] for r in rows.values()]) for j in range(3))
    first, n = first.astype(np.int64), n.astype(np.int64)
    at = w.off[doc] + first
    return pa.RecordBatch.from_arrays(
        [p.column("doc_id").take(pa.array(doc)), pa.array([index.ids[i] for _, i in rows], pa.int64()),
         pa.array(sim.astype(float)), pa.array(first), pa.array(n),
         pa.array(w.start[at] - t.off[doc] if len(doc) else first),
         pa.array(w.end[at + n - 1] - t.off[doc] if len(doc) else first)],
        ["doc_id", "item_id", "similarity", "first_word", "n_words", "first_byte", "end_byte"])


def _item_shingles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            index = Index([None] * p.num_rows, p.column("text").to_pylist(), k=k)
            flat = np.concatenate([*index.shingles, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], ["shingle"])
    return run


def benchmark_blocks(benchmark: DataFrame, similarity: float, k: int, radius: int,
                     block_items: int) -> Iterator[Index]:
    """Indexes of the benchmark, ``block_items`` items at a time on average.

    A shingle that several items of the whole benchmark share weighs 1 / (their number), others 1.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = -(-items.count() // block_items)
    shingles = lambda df: df.select("text").mapInArrow(_item_shingles(k), "shingle long")
    shared = shingles(items).groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        own = block.collect()
        weights = {r.shingle % (1 << 64): 1.0 / r.n for r in
                   shared.join(shingles(block).distinct(), "shingle", "left_semi").collect()}
        yield Index([r.item_id for r in own], [r.text for r in own], weights, similarity, k, radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = MIN_SIMILARITY,
                 k: int = SHINGLE, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and benchmark item whose passage it holds, with the best passage.

    Every block of items is one map-only pass over the documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in benchmark_blocks(benchmark, similarity, k, radius, block_items):
        found = rows.mapInArrow(_find(index), OUT)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], OUT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, similarity: float = MIN_SIMILARITY,
                    k: int = SHINGLE, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark passage."""
    def without(index: Index):
        def clean(p: pa.RecordBatch):
            _, w = word_view(p.column("text"))
            mask = np.ones(p.num_rows, bool)
            mask[[doc for doc, _ in index.matches(w)]] = False
            return mask
        return keep_rows(clean)

    schema = docs.schema
    for index in benchmark_blocks(benchmark, similarity, k, radius, block_items):
        docs = docs.mapInArrow(without(index), schema)
    return docs


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark passages found in the documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
