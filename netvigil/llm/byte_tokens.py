"""Byte-level BPE ids of whole texts through the tokenizers library, one call per distinct segment.

The pre-tokeniser's pattern has no alternative that takes a visible character and white space after
it, nor (apart from contractions, which start with an apostrophe) characters of two kinds among letters, digits and
others.  So a text may be cut before white space that follows a visible character, and between plain
ASCII characters of two kinds: its ids are its segments' ids in order.  The characters of special strings other than
letters and digits are no place to cut, so such a string stays in one segment and the library handles it there.  A vocabulary file built otherwise (a normaliser, another pre-tokeniser, a prefix space,
special strings with white space) is used on whole texts.
"""

from __future__ import annotations

import json

import numpy as np

from netvigil.llm.textvec import SPACES, Texts, distinct, ragged
from netvigil.llm.tokens import _byte_letters

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
MAX_CACHED_SEGMENTS = 1_000_000  # some 40 bytes each; a worker's cache restarts when full
#: first bytes of the two- and three-byte characters among which there is white space
_SPACE_LEADS = np.zeros(256, bool)
_SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTERS, _DIGITS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def kinds(special: list[bytes]) -> np.ndarray:
    """Kind of each byte: 1 letter, 2 digit, 3 other visible ASCII, 0 no place to cut."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 3
    kind[list(_LETTERS)] = 1
    kind[list(_DIGITS)] = 2
    kind[ord("'")] = 0
    marks = list(b"".join(special))
    kind[marks] = np.where(kind[marks] == 3, 0, kind[marks])
    return kind


def _changes(kind: np.ndarray) -> np.ndarray:
    """Per place: another kind than the one before, both places to cut."""
    out = np.zeros(len(kind), bool)
    out[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != 0) & (kind[:-1] != 0)
    return out


def kinds_of(path: str) -> np.ndarray | None:
    """The byte kinds for a vocabulary file, None where its settings forbid encoding by segments."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    if (spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
            or not pre.get("use_regex", True)
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)):
        return None
    special = [t["content"].encode() for t in added]
    kind = kinds(special)
    whole = all(not _changes(kind[np.frombuffer(s, np.uint8)]).any() for s in special)
    return kind if whole else None


def cuts(t: Texts, kind: np.ndarray) -> np.ndarray:
    """Per byte: white space after a visible character of the same text, or a change of kind.

    After a character whose first byte is one of ``_SPACE_LEADS`` there is no cut, visible or not.
    """
    d = t.data
    out = _changes(kind[d])
    at = np.flatnonzero(SPACES[d[1:]]) + 1
    prev = d[at - 1]
    visible = (prev > 0x20) & (prev < 0x7F)
    wide = np.flatnonzero(prev >= 0x80)
    lead = prev[wide]
    for back in (2, 3, 4):
        more = (lead >= 0x80) & (lead < 0xC0)
        lead = np.where(more, d[np.maximum(at[wide] - back, 0)], lead)
    visible[wide] = ~_SPACE_LEADS[lead]
    out[at[visible]] = True
    return out


class ByteEncoder:
    """Ids of texts for one vocabulary file; keeps the ids of the segments it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = kinds_of(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self._reset()

    def _reset(self):
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.len = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.total = 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts back to back, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for g in got for i in g), np.uint32, int(n.sum())), n

    def _single(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for segments that are one pre-token: they go straight to the model."""
        tokenize, letters = self.model.tokenize, self.letters
        got = [tokenize(s.encode().decode("latin-1").translate(letters)) for s in texts]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((t.id for g in got for t in g), np.uint32, int(n.sum())), n

    def _learn(self, keys: np.ndarray, flat: np.ndarray, n: np.ndarray):
        if self.total + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.total + 2 * len(flat), np.uint32)])
        self.ids[self.total:self.total + len(flat)] = flat
        at = self.total + np.cumsum(n) - n
        self.total += len(flat)
        order = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, place, keys[order])
        self.at = np.insert(self.at, place, at[order])
        self.len = np.insert(self.len, place, n[order])

    def _one_token(self, d: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Segments that the pattern takes whole: at most a space, then plain letters, digits or others only."""
        first = start + (d[start] == 0x20)
        out = first < end
        lead = (d[:-1] == 0xC3) & (d[1:] != 0x97) & (d[1:] != 0xB7)  # accented letters, two bytes each
        letters = self.kind[d] == 1
        letters[:-1] |= lead
        letters[1:] |= lead
        part = np.zeros(len(start), bool)
        for member in (letters, self.kind[d] == 2, self.kind[d] == 3):
            inside = np.concatenate([[0], np.cumsum(member, dtype=np.int32)])
            part |= inside[end] - inside[first] == end - first
        return out & part

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids back to back (uint32) and the texts' boundaries in them (NULL: empty)."""
        t = Texts(column)
        if self.kind is None:
            ids, n = self._library(t.strings(t.off[:-1], t.off[1:]))
            return ids, np.concatenate([[0], np.cumsum(n)])
        start, end = t.spans(np.ones(len(t.data), bool), cuts(t, self.kind))
        off = np.searchsorted(start, t.off)
        uniq, first, inv = distinct(t.hashes(start, end))
        if len(self.keys) + len(uniq) > MAX_CACHED_SEGMENTS:
            self._reset()
        pos = np.searchsorted(self.keys, uniq)
        known = pos < len(self.keys)
        known[known] = self.keys[pos[known]] == uniq[known]
        new = np.flatnonzero(~known)
        if len(new):
            a, b = start[first[new]], end[first[new]]
            one = self._one_token(t.data, a, b)
            for some, ids_of in ((one, self._single), (~one, self._library)):
                if some.any():
                    self._learn(uniq[new[some]], *ids_of(t.strings(a[some], b[some])))
            pos = np.searchsorted(self.keys, uniq)
        n = self.len[pos][inv]
        return self.ids[ragged(self.at[pos][inv], n)], np.concatenate([[0], np.cumsum(n)])[off]


_encoders: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]
