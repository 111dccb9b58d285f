"""Operator 13, periodic run detection: internal pattern matching of dyadic blocks of words.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 q)`` words that no
neighbouring word extends.  All texts of a piece are one sequence of word names (a name belongs to
one text), sorted into a suffix array by doubling; the names of all blocks of ``2^k`` words are
the ranks at step ``k``.  For periods in ``(B/2, B]`` every block of ``B`` words at a fixed stride
asks a wavelet tree over the suffix array for the successor of its own position among the block's
occurrences.  A successor at most ``B`` words on starts an arithmetic progression of occurrences,
whose difference is the candidate period: inside a run a block of at least one period recurs
first after exactly the smallest period, as a primitive word never occurs inside its own square
but at the ends.  The stride is small enough that each run holds such a block and its successor.
Longest common extensions, read off the block names, give the ends of the run, exactly.

All work is a map over documents: nothing is shuffled.  Memory follows the piece (about 1 MB of
text) or the longest single text, some 100 to 250 bytes a word.

Defined cases: NULL, empty and white-space texts have no words, no runs and an empty collapsed
text; repeated rows and NULL ids give a row each; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import table
from netvigil.llm.textvec import Texts, Words, in_text, pieces, ragged

LEAST_LENGTH = 6  # words of the shortest run
LEAST_EXPONENT = 4  # periods in a run
RUN = "struct<start: long, length: long, period: long>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class BlockNames:
    """Suffix array of a sequence, and for every ``2^k`` the names of its blocks.

    ``names[k][i]`` is the place in the suffix array of the first suffix that starts with the block
    of ``2^k`` items at ``i``, so equal blocks have equal names.  Doubling goes on with the suffixes
    that still share their block; the last step's names are all different.
    """

    def __init__(self, items: np.ndarray):
        n = len(items)
        self.n = n
        order = np.argsort(items, kind="stable")
        key = items[order]
        sa = order.astype(np.int64)
        slots = np.arange(n)
        rank = np.empty(n, np.int64)
        self.names: list[np.ndarray] = []
        width = 1
        while True:
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(key)))
            rank[sa[slots]] = np.repeat(slots[first], size)
            self.names.append(rank.astype(np.int32))
            shared = np.repeat(size > 1, size)
            slots = slots[shared]
            if not len(slots):
                break
            at = sa[slots]
            after = at + width
            inside = after < n
            nxt = np.zeros(len(at), np.int64)
            nxt[inside] = rank[after[inside]] + 1
            key = rank[at] * (n + 1) + nxt
            by = np.argsort(key, kind="stable")
            sa[slots] = at[by]
            key = key[by]
            width *= 2
        self.sa = sa

    def _equal(self, k: int, i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> np.ndarray:
        same = np.zeros(len(i), bool)
        same[ok] = self.names[k][i[ok]] == self.names[k][j[ok]]
        return same

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of positions ``i < j``."""
        i, j = i.copy(), j.copy()
        start = j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            same = self._equal(k, i, j, j + (1 << k) <= self.n)
            i[same] += 1 << k
            j[same] += 1 << k
        return j - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extension to the left, of the items before ``i < j``."""
        i, j = i.copy(), j.copy()
        start = j.copy()
        for k in range(len(self.names) - 1, -1, -1):
            same = self._equal(k, i - (1 << k), j - (1 << k), i >= 1 << k)
            i[same] -= 1 << k
            j[same] -= 1 << k
        return start - j


class WaveletTree:
    """Range successor over an integer sequence: one packed bit plane a level, highest bit first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n = len(values)
        self.levels = []
        now = values
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1 == 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((level, words, before, self.n - int(before[-1])))
            now = np.concatenate([now[~bit], now[bit]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Set bits ahead of each place."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & low)

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Smallest value of at least ``x`` in each ``[lo, hi)``, or -1."""
        a, b = lo, hi
        less = np.zeros(len(lo), np.int64)
        for level, words, before, zeros in self.levels:
            one = (x >> level) & 1 == 1
            p, q = self._ones(words, before, a), self._ones(words, before, b)
            less += np.where(one, (b - q) - (a - p), 0)
            a, b = np.where(one, zeros + p, a - p), np.where(one, zeros + q, b - q)
        out = np.full(len(lo), -1, np.int64)
        some = np.flatnonzero(less < hi - lo)
        a, b, k = lo[some], hi[some], less[some]
        value = np.zeros(len(some), np.int64)
        for level, words, before, zeros in self.levels:
            p, q = self._ones(words, before, a), self._ones(words, before, b)
            low = (b - q) - (a - p)
            one = k >= low
            value += one.astype(np.int64) << level
            k = k - np.where(one, low, 0)
            a, b = np.where(one, zeros + p, a - p), np.where(one, zeros + q, b - q)
        out[some] = value
        return out


def stride(block: int, least_length: int, least_exponent: int) -> int:
    """Largest distance of blocks so that each run with a period in ``(block/2, block]`` holds one
    of them together with its successor."""
    periods = (block // 2, block // 2 + 1) if block == 2 else (block // 2 + 1,)
    return min(max(least_length, least_exponent * q) - q - block + 1 for q in periods)


def find_runs(items: np.ndarray, least_length: int = LEAST_LENGTH,
              least_exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs of a sequence, by start, then period.

    ``least_exponent`` is 4 or more and ``least_length`` 6 or more, which keeps the stride positive.
    """
    if least_exponent < 4 or least_length < 6:
        raise ValueError("runs of fewer than four periods or six items are not covered by the blocks")
    none = np.zeros(0, np.int64)
    if len(items) < least_length:
        return none, none, none
    blocks = BlockNames(items)
    n, found = blocks.n, []
    tree = None
    for k in range(1, len(blocks.names)):
        block = 1 << k
        name = blocks.names[k]
        size = np.bincount(name, minlength=n)
        if tree is None:  # suffixes whose first two items recur nowhere answer no query
            used = np.repeat(size[size > 0] > 1, size[size > 0])
            place = np.concatenate([[0], np.cumsum(used)])
            tree = WaveletTree(blocks.sa[used], max(1, int(n).bit_length()))
        at = np.arange(0, n, stride(block, least_length, least_exponent))
        at = at[size[name[at]] > 1]
        lo = name[at].astype(np.int64)
        after = tree.successor(place[lo], place[lo + size[lo]], at + 1)
        near = (after >= 0) & (after - at <= block)
        at, after = at[near], after[near]
        period = after - at
        start = at - blocks.backward(at, after)
        end = after + blocks.forward(at, after)
        whole = end - start >= np.maximum(least_length, least_exponent * period)
        found.append(np.stack([start, end - start, period], 1)[whole])
    if not found:
        return none, none, none
    runs = np.unique(np.concatenate(found), axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _joined(t: Texts, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of every text joined by one space: bytes and the texts' boundaries."""
    length = (w.end - w.start)[keep]
    to = np.cumsum(length + 1) - (length + 1)
    out = np.full(int((length + 1).sum()), 32, np.uint8)
    out[ragged(to, length)] = t.data[ragged(w.start[keep], length)]
    kept = np.concatenate([[0], np.cumsum(np.bincount(w.doc[keep], minlength=t.n))])
    edge = np.append(to, len(out))[kept]
    last = np.flatnonzero(np.diff(kept) > 0)  # the space after a text's last word goes
    flag = np.ones(len(out), bool)
    flag[edge[last + 1] - 1] = False
    out = out[flag]
    gone = np.concatenate([[0], np.cumsum(np.diff(kept) > 0)])
    return out, edge - gone


def _runs(least_length: int, least_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            t = Texts(p.column("text"))
            w = Words(t)
            start, length, period = find_runs(in_text(w.hash, w.doc), least_length, least_exponent)
            doc = w.doc[start]
            edges = np.searchsorted(doc, np.arange(t.n + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays(
                [pa.array(start - w.off[doc]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            gone = np.zeros(len(w.doc) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            data, bound = _joined(t, w, np.cumsum(gone)[:-1] == 0)
            text = pa.LargeStringArray.from_buffers(t.n, pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(data))
            yield pa.RecordBatch.from_arrays(
                [p.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges), runs),
                 text.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every text and the text without their repeats.

    ``doc_id, n_words, runs array<struct<start, length, period>>`` (by start, then period, in words)
    and ``collapsed``: the words outside runs and each run's first period, joined by one space.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_runs(least_length, least_exponent),
                           f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in pieces(batches):
        text = p.column("text")
        chosen = {}
        for i, h in enumerate(p.column("h").to_pylist()):
            if h % 10:
                continue
            words = WORD.findall(text[i].as_py() or "")
            n = len(words)
            if n:
                g = h // 10
                a = g % n
                q = 1 + (n - a) // (3 + g % 8)
                chosen[i] = " ".join(words[:a] + (words[a:a + q] * (-(-(n - a) // q)))[:n - a])
        if chosen:
            mask = np.zeros(p.num_rows, bool)
            mask[list(chosen)] = True
            text = pc.replace_with_mask(text, pa.array(mask), pa.array(chosen.values(), pa.string()))
        yield pa.RecordBatch.from_arrays([p.column("doc_id"), text], ["doc_id", "text"])


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where a tenth of the ids (by crc32 of the decimal id, NULL: of the empty text)
    go on from some word with a repeated stretch, as the query's contract sets out."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
            .mapInArrow(_planted, "doc_id long, text string"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Digest of all runs of every document, some of them planted."""
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    text = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), text.alias("_lines"), best.alias("_best"),
                        "collapsed").select(
        "doc_id", "n_runs", (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
