"""Token ids of whole texts through the tokenizers library, one call per distinct segment.

The lower-cased BPE vocabulary drops white space and never merges across it, nor across a
change between an ASCII letter and plain ASCII punctuation.  So a text's ids are its segments'
ids in order, and a task asks the library only for segments that it has not met before.
"""

from __future__ import annotations

import numpy as np

from netvigil.llm.textvec import SPACES, Texts, distinct, ragged

DEFAULT_VOCABULARY = "word_bpe_49k.json"
MAX_CACHED_SEGMENTS = 1_000_000  # memory bound of a task's cache; it restarts when full

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 1
# no apostrophe (contractions), none of the marks that special strings are made of
_CLASS[[ord(c) for c in '.,;:!?#*$%&()[]{}"/=+-_@^~`']] = 2
_SPECIAL = (b"<|s", b"<|e")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Path of one of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return table


class SegmentEncoder:
    """Ids of texts for one vocabulary file; keeps the ids of the segments it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self._reset()

    def _reset(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.ids = [np.zeros(0, np.uint32)]
        self.total = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _segments(self, segs: list[str]) -> list[list[int]]:
        """Segments of plain Latin letters are one pre-token: they go straight to the model."""
        out: list = [None] * len(segs)
        rest = []
        for i, s in enumerate(segs):
            if s.isalpha() and max(s) < "ƀ" and "İ" not in s:
                if not s.isascii():
                    s = s.lower().encode().decode("latin-1").translate(self.letters)
                out[i] = [t.id for t in self.model.tokenize(s)]
            else:
                rest.append(i)
        if rest:
            for i, ids in zip(rest, self._library([segs[i] for i in rest])):
                out[i] = ids
        return out

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids back to back (uint32) and the texts' boundaries in them."""
        t = Texts(column, lower=True)
        inside = ~SPACES[t.data]
        c = _CLASS[t.data]
        change = np.zeros(len(c), bool)
        change[1:] = (c[1:] + c[:-1] == 3) & (c[1:] != 0) & (c[:-1] != 0)
        start, end = t.spans(inside, change)
        off = np.searchsorted(start, t.off)
        h = t.hashes(start, end)
        uniq, first, inv = distinct(h)
        if len(self.keys) + len(uniq) > MAX_CACHED_SEGMENTS:
            self._reset()
        pos = np.searchsorted(self.keys, uniq)
        known = pos < len(self.keys)
        known[known] = self.keys[pos[known]] == uniq[known]
        new = np.flatnonzero(~known)
        if len(new):
            got = self._segments(t.strings(start[first[new]], end[first[new]]))
            n = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((i for g in got for i in g), np.uint32, int(n.sum()))
            keys = np.concatenate([self.keys, uniq[new]])
            at = np.concatenate([self.at, self.total + np.cumsum(n) - n])
            ln = np.concatenate([self.len, n])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.len = keys[order], at[order], ln[order]
            self.ids.append(flat)
            self.total += len(flat)
            pos = np.searchsorted(self.keys, uniq)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        n = self.len[pos][inv]
        ids = self.ids[0][ragged(self.at[pos][inv], n)]
        bound = np.concatenate([[0], np.cumsum(n)])[off]
        return self._with_special(column, t, ids, bound)

    def _with_special(self, column, t: Texts, ids, bound):
        """Texts that may hold special strings are encoded whole, as they were before lower-casing."""
        joined = t.data.tobytes()
        if not any(s in joined for s in _SPECIAL):
            return ids, bound
        parts = np.split(ids, bound[1:-1])
        for i in range(t.n):
            if any(s in joined[t.off[i]:t.off[i + 1]] for s in _SPECIAL):
                parts[i] = np.array(self._library([column[i].as_py()])[0], np.uint32)
        n = np.array([len(p) for p in parts])
        return (np.concatenate(parts) if parts else ids), np.concatenate([[0], np.cumsum(n)])


_encoders: dict[str, SegmentEncoder] = {}


def encoder(path: str) -> SegmentEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = SegmentEncoder(path)
    return _encoders[path]
