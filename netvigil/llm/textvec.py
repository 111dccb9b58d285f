"""Vectorised text views over Arrow string columns.

A batch's texts lie back to back in one byte buffer.  Words, lines, their 64-bit hashes and
per-text sums are found with whole-buffer numpy operations, so a task never loops over words in
Python.  Batches are cut into pieces of a few MB first (one text always stays whole), which
bounds a worker's memory by the piece size or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_C1 = np.uint64(0xFF51AFD7ED558CCD)
_C2 = np.uint64(0xC4CEB9FE1A85EC53)
_pow = {"n": 0, "p": None, "i": None}

#: bytes that separate words
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int):
    """Powers of the hash base and of its inverse modulo 2^64, at least ``n`` of them."""
    if _pow["n"] < n:
        n = max(n, PIECE_BYTES + (1 << 16))
        one = np.ones(1, np.uint64)
        _pow["p"] = np.cumprod(np.concatenate([one, np.full(n, _P)]))
        _pow["i"] = np.cumprod(np.concatenate([one, np.full(n, _PINV)]))
        _pow["n"] = n
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * _C1
    h ^= h >> np.uint64(33)
    h *= _C2
    h ^= h >> np.uint64(33)
    return h


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece has about ``limit`` bytes of text, or a single row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = np.maximum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64), 8)
        at = np.cumsum(size)
        start = 0
        while start < b.num_rows:
            base = at[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(at, base + limit, "right")))
            yield b.slice(start, stop - start)
            start = stop
        del b
        pa.default_memory_pool().release_unused()


class Texts:
    """The texts of one piece: ``data`` (uint8), ``off`` (text boundaries, int64)."""

    def __init__(self, column: pa.Array, lower: bool = False):
        arr = pc.fill_null(column, "")
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        arr = arr.cast(pa.large_string())
        _, offs, data = arr.buffers()
        off = np.frombuffer(offs, np.int64, count=len(arr) + 1, offset=arr.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[off[0]:off[-1]]
        self.off = off - off[0]
        self.n = len(arr)
        self._cs = None
        if lower:
            self.data = self.data + (((self.data >= 65) & (self.data <= 90)).astype(np.uint8) << 5)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte 0/1 array over each text."""
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return c[self.off[1:]] - c[self.off[:-1]]

    def spans(self, inside: np.ndarray, also: np.ndarray | None = None):
        """Maximal runs of bytes with ``inside``, never across texts (or across the byte
        positions ``also``): starts, ends."""
        n = len(self.data)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = np.zeros(n + 1, bool)
        cut[self.off] = True
        if also is not None:
            cut[:-1] |= also
        before = np.concatenate([[False], inside[:-1]])
        after = np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | cut[:-1]))
        ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
        return starts, ends

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span."""
        p, inv = _powers(len(self.data) + 1)
        if self._cs is None:
            v = (self.data.astype(np.uint64) + np.uint64(1)) * p[:len(self.data)]
            self._cs = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v)])
        return mix((self._cs[ends] - self._cs[starts]) * inv[starts])

    def text_of(self, starts: np.ndarray) -> np.ndarray:
        """Index of the text that holds each byte position."""
        return np.searchsorted(self.off, starts, "right") - 1

    def strings(self, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        """The spans as Python strings."""
        b = self.data.tobytes()
        return [b[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist())]


class Words:
    """Words of a piece: byte spans, hashes, owning text and per-text offsets."""

    def __init__(self, texts: Texts, inside: np.ndarray | None = None):
        if inside is None:
            inside = ~SPACES[texts.data]
        self.texts = texts
        self.start, self.end = texts.spans(inside)
        self.off = np.searchsorted(self.start, texts.off)  # word range of each text
        self.count = np.diff(self.off)
        self.doc = np.repeat(np.arange(texts.n), self.count)
        self._h = None

    @property
    def hash(self) -> np.ndarray:
        if self._h is None:
            self._h = self.texts.hashes(self.start, self.end)
        return self._h

    def grams(self, k: int):
        """Hashes of all k-word windows inside one text, and the windows' first word."""
        return grams(self.hash, self.doc, k)


def grams(h: np.ndarray, doc: np.ndarray, k: int):
    """Hashes of the k-windows over ``h`` that stay inside one text; their first positions."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g = (g ^ h[j:j + n]) * _P
        g ^= g >> np.uint64(29)
    at = np.flatnonzero(doc[:n] == doc[k - 1:k - 1 + n])
    return g[at], at


def in_text(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made distinct by text, for counts inside each text."""
    return mix(h + doc.astype(np.uint64) * _P)


def repeated_windows(w: Words, k: int = 3) -> np.ndarray:
    """Per word: whether it lies in a k-word window found twice or more in its text."""
    cover = np.zeros(len(w.doc), bool)
    g, at = w.grams(k)
    if len(g):
        key = in_text(g, w.doc[at])
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        hit = np.zeros(len(s), bool)
        hit[1:] |= same
        hit[:-1] |= same
        first = at[order[hit]]
        for j in range(k):
            cover[first + j] = True
    return cover


def duplicate_lines(t: Texts, word_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those equal to an earlier line of the text."""
    newline = t.data == 10
    starts, ends = t.spans(~newline)
    first = np.searchsorted(word_start, starts)
    has = np.searchsorted(word_start, ends) > first
    starts, ends = starts[has], ends[has]
    doc = t.text_of(starts)
    lines = np.bincount(doc, minlength=t.n)
    _, one = np.unique(in_text(t.hashes(starts, ends), doc), return_index=True)
    return lines, lines - np.bincount(doc[one], minlength=t.n)


def distinct(h: np.ndarray):
    """Distinct values, the first position of each, and for every position its value's index."""
    d = pa.array(h).dictionary_encode()
    uniq = np.asarray(d.dictionary)
    inv = np.asarray(d.indices)
    first = np.zeros(len(uniq), np.int64)
    first[inv[::-1]] = np.arange(len(h) - 1, -1, -1)
    return uniq, first, inv


def sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by text."""
    return np.bincount(doc, weights=values, minlength=n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all members of the ranges ``[start, start + length)``, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def keep_rows(decide):
    """A mapInArrow function that keeps the rows which ``decide(piece)`` marks (a boolean array)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            yield p.filter(pa.array(np.asarray(decide(p), bool)))
    return run
