"""Operator 12, token ids as binary files: raw id payloads behind a minimal perfect hash index.

``write_store`` deals the documents over shards by ranges of the key; each shard's task encodes its documents and
writes one file, in ascending order of the key (NULL first; equal keys by a hash of their texts):

    magic | ids of all documents, little-endian, 2 or 4 bytes | keys (int64) | starts (uint64, one more
    than documents) | footer: documents, ids, NULL keys, bytes an id, checksum of the tables, magic

The keys are then dealt over index parts by hash.  Each part is a minimal perfect hash of its keys, a
cascade of bit arrays in which every key finds a place of its own; the rank of that place is its slot.  A slot
stores a fingerprint, the first and last shard of the key, its first row and its number of rows.  A lookup is
a hash, a few bit tests and one slot, then two starts and the payload: constant time.  The key in
the shard decides in the end, so a stranger with a matching fingerprint is not found either.

Files are written by tasks through ``pyarrow.fs`` below the folder given (the session's shared checkpoint folder
in the query) under names of their own, and only those of committed tasks are listed in the written tables
``shards`` and ``parts``: a repeated task leaves at most an unlisted file.  A key with a third of all rows
spans as many shards as its rows need (rows of equal keys and texts are told apart by their row number when
dealt, so ``docs`` should be a table that is read, whose rows come in the same order again), and has one
slot.  A single document is encoded and written whole, in one task.

Defined cases: NULL text is the empty document (the end id alone); a repeated key's documents follow one
another and are all found under it; the NULL key has an entry of its own beside the index; an empty table gives
an empty store, in which every lookup finds nothing; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netvigil.llm.byte_tokens import DEFAULT_VOCABULARY, byte_encoder
from netvigil.llm.common import table, written
from netvigil.llm.textvec import mix, pieces, ragged
from netvigil.llm.tokens import vocabulary_path
from netvigil.session import scratch_path

MAGIC = b"TOKENS\x001"
FOOTER = "<QQQII8s"
SHARD_BYTES = 48 << 20  # text of a shard's documents and 16 bytes each, but for documents that are longer alone
LEAST_SHARD_BYTES = 1 << 20  # down to this where there are fewer shards than cores
KEYS_A_PART = 1 << 20
LEAST_KEYS_A_PART = 1 << 13
END_ID = 2
READ_BYTES = 4 << 20  # payload that a reading task holds at a time, or one document
GAMMA = 2  # bits a key of each level of the hash


# ---- files ------------------------------------------------------------------------------------

def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file given as a path or URI that pyarrow knows."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def _new_file(folder: str, name: str):
    """A file of this task attempt's own: its path and an output stream."""
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    return path, system.open_output_stream(f"{base}/{path.rsplit('/', 1)[1]}")


# ---- minimal perfect hash ---------------------------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                                   9650029242287828579, 2870177450012600261))
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def key_hash(keys: np.ndarray) -> np.ndarray:
    """xxHash64 (seed 42) of each int64, as Spark's ``xxhash64`` gives it: one to one."""
    h = np.full(len(keys), np.uint64(42) + _P5 + np.uint64(8), np.uint64)
    h ^= _rotated(keys.astype("<i8").view(np.uint64) * _P2, 31) * _P1
    h = _rotated(h, 27) * _P1 + _P4
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Index part of each key hash (``shiftrightunsigned(h, 33) % parts``)."""
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ _SALT) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Cascade of bit arrays: level by level, the keys alone at their place stay there."""

    def __init__(self, bits: list[int], words: np.ndarray):
        self.bits, self.words = bits, words
        self.base = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _place(h: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(h + np.uint64((level + 1) * int(_SALT) % (1 << 64))) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        """For distinct hashes."""
        bits, planes, left = [], [], h
        while len(left):
            if len(bits) == 200:
                raise ValueError("equal hashes among the keys")
            m = -(-GAMMA * len(left) // 64) * 64
            at = cls._place(left, len(bits), m)
            alone = np.bincount(at, minlength=m) == 1
            planes.append(np.packbits(alone, bitorder="little").view(np.uint64))
            bits.append(m)
            left = left[~alone[at]]
        return cls(bits, np.concatenate(planes) if planes else np.zeros(0, np.uint64))

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash: 0 .. keys - 1 for the keys, any slot or -1 for others."""
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        for level, m in enumerate(self.bits):
            at = self.base[level] + self._place(h[left], level, m)
            word, low = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> low) & np.uint64(1) == 1
            below = (np.uint64(1) << low) - np.uint64(1)
            rank = self.rank[at >> 6] + np.bitwise_count(word & below)
            out[left[hit]] = rank[hit]
            left = left[~hit]
        return out


ENTRY = np.dtype([("fingerprint", "<u4"), ("first_shard", "<u4"), ("last_shard", "<u4"), ("first_row", "<u8"),
                  ("documents", "<u8")])


class IndexPart:
    """One part of the index: a perfect hash and its entries."""

    def __init__(self, raw: bytes):
        n, levels = struct.unpack_from("<QQ", raw, 8)
        if raw[:8] != MAGIC:
            raise ValueError("not an index part")
        bits = struct.unpack_from(f"<{levels}Q", raw, 24)
        at = 24 + 8 * levels
        words = sum(bits) // 64
        self.hash = PerfectHash(list(bits), np.frombuffer(raw, "<u8", words, at))
        self.entries = np.frombuffer(raw, ENTRY, n, at + 8 * words)

    @staticmethod
    def packed(keys: np.ndarray, columns: dict[str, np.ndarray]) -> bytes:
        h = key_hash(keys)
        perfect = PerfectHash.build(h)
        entries = np.zeros(len(keys), ENTRY)
        slot = perfect.slots(h)
        entries["fingerprint"][slot] = fingerprint(h)
        for name, values in columns.items():
            entries[name][slot] = values
        head = struct.pack(f"<QQ{len(perfect.bits)}Q", len(keys), len(perfect.bits), *perfect.bits)
        return MAGIC + head + perfect.words.astype("<u8").tobytes() + entries.tobytes()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys have an entry, and those entries."""
        h = key_hash(keys)
        slot = self.hash.slots(h)
        found = slot >= 0
        found[found] = self.entries["fingerprint"][slot[found]] == fingerprint(h[found])
        return found, self.entries[slot[found]]


# ---- shards -----------------------------------------------------------------------------------

class Shard:
    """An open shard: random access to keys, starts and payloads."""

    def __init__(self, path: str):
        system, name = filesystem(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        foot = struct.calcsize(FOOTER)
        self.documents, self.ids, self.nulls, self.width, self.check, magic = struct.unpack(
            FOOTER, self.file.read_at(foot, size - foot))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {path}")
        self.keys_at = 8 + self.ids * self.width
        self.starts_at = self.keys_at + 8 * self.documents

    @cached_property
    def all_keys(self) -> np.ndarray:
        return self.keys(0, self.documents)

    @cached_property
    def all_starts(self) -> np.ndarray:
        return self.starts(0, self.documents + 1)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()

    def keys(self, row: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(8 * n, self.keys_at + 8 * row), "<i8")

    def starts(self, row: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(8 * n, self.starts_at + 8 * row), "<u8").astype(np.int64)

    def payload(self, start: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - start) * self.width, 8 + start * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, width: int):
    """Payload bytes, number of ids of each document and keys, piece by piece."""
    for p in pieces(batches):
        ids, bound = byte_encoder(vocabulary).encode(p.column("text"))
        n = np.diff(bound)
        out = np.full(len(ids) + len(n), end_id, f"<u{width}")
        out[ragged(bound[:-1] + np.arange(len(n)), n)] = ids
        yield out, n + 1, p.column("key")


SEGMENT = "shard long, file string, key long, first_row long, documents long, ids long"


def _write_shard(folder: str, vocabulary: str, end_id: int, width: int):
    """Sorted documents of one range to one file; returns a row per key with its place there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, path = TaskContext.get().partitionId(), None, None
        keys, sizes, nulls = [], [], 0
        for payload, n, key in _encoded(batches, vocabulary, end_id, width):
            if out is None:
                path, out = _new_file(folder, f"shard-{shard:06d}")
                out.write(MAGIC)
            out.write(payload.data)
            nulls += key.null_count
            keys.append(np.asarray(key.fill_null(0)))
            sizes.append(n)
        if out is None:
            return
        keys, sizes = np.concatenate(keys), np.concatenate(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        tables = keys.astype("<i8").tobytes() + starts.astype("<u8").tobytes()
        out.write(tables)
        out.write(struct.pack(FOOTER, len(keys), int(starts[-1]), nulls, width, zlib.crc32(tables), MAGIC))
        out.close()
        change = np.concatenate([[True], keys[1:] != keys[:-1]])
        change[nulls:nulls + 1] = True  # a key 0 after the NULL keys
        first = np.flatnonzero(change)
        n = np.diff(np.append(first, len(keys)))
        whole = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(first), shard)), pa.array([path] * len(first)),
             pa.array(keys[first], mask=first < nulls), pa.array(first), pa.array(n), pa.array(starts[first + n] - starts[first])],
            ["shard", "file", "key", "first_row", "documents", "ids"])
        for at in range(0, whole.num_rows, 50_000):
            yield whole.slice(at, 50_000)
    return run


def _write_parts(folder: str):
    """Sorted entries of some index parts to one file each."""
    names = ["first_shard", "last_shard", "first_row", "documents"]

    def flush(part, held):
        t = pa.Table.from_batches(held)
        path, out = _new_file(folder, f"part-{part:06d}")
        with out:
            out.write(IndexPart.packed(t.column("key").to_numpy(), {c: t.column(c).to_numpy() for c in names}))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([t.num_rows], pa.int64())],
                                          ["part", "file", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            part = np.asarray(b.column("part"))
            edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
            for a, z in zip(edges, np.append(edges[1:], len(part))):
                if held and part[a] != now:
                    yield flush(now, held)
                    held = []
                now = int(part[a])
                held.append(b.slice(a, z - a))
        if held:
            yield flush(now, held)
    return run


def _pieces_of(total: int, most: int, least: int, cores: int) -> int:
    """As many pieces as keep all cores busy, within the bounds of a piece's size."""
    return max(1, -(-total // most), min(cores, -(-total // least)))


class TokenStore:
    """A written store below ``folder``: written tables ``shards``, ``parts`` and ``null_key``."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")
        self._tables = None

    # -- one key, without Spark

    def _open(self):
        if self._tables is None:
            read = {}
            for name in ("shards", "parts", "null_key"):
                system, path = filesystem(f"{self.folder}/{name}")
                read[name] = pq.read_table(path, filesystem=system)
            shards = {r["shard"]: r for r in read["shards"].to_pylist()}
            parts = {r["part"]: r["file"] for r in read["parts"].to_pylist()}
            n = read["parts"].column("n_parts")[0].as_py() if read["parts"].num_rows else 0
            self._tables = shards, parts, n, read["null_key"].to_pylist(), {}
        return self._tables

    def _entry(self, key: int | None):
        _, parts, n, null_key, loaded = self._open()
        if key is None:
            return null_key[0] if null_key else None
        keys = np.array([key], np.int64)
        part = int(part_of(key_hash(keys), n)[0]) if n else None
        if part not in parts:
            return None
        if part not in loaded:
            system, path = filesystem(parts[part])
            with system.open_input_file(path) as f:
                loaded[part] = IndexPart(f.read())
        found, entries = loaded[part].find(keys)
        return {c: int(entries[0][c]) for c in ENTRY.names} if found[0] else None

    def get(self, key: int | None) -> list[tuple[int, np.ndarray]]:
        """Every document of the key, as (ids of all documents before it, its ids)."""
        out, entry = [], self._entry(key)
        if entry is None:
            return out
        shards = self._open()[0]
        left, row = entry["documents"], entry["first_row"]
        for s in range(entry["first_shard"], entry["last_shard"] + 1):
            if s not in shards:
                continue
            with Shard(shards[s]["file"]) as shard:
                n = min(left, shard.documents - row)
                if key is not None and (row < shard.nulls or shard.keys(row, 1)[0] != key):
                    return []
                starts = shard.starts(row, n + 1)
                out += [(shards[s]["start"] + int(a), shard.payload(int(a), int(b)).astype(np.uint32))
                        for a, b in zip(starts[:-1], starts[1:])]
            left, row = left - n, 0
        return out

    # -- many keys, on Spark

    def entries(self, keys: DataFrame) -> DataFrame:
        """Entries of the distinct ``key`` values that the store holds, by lookups in the index parts."""
        spark = keys.sparkSession
        parts = spark.read.parquet(f"{self.folder}/parts")
        head = parts.agg(F.max("n_parts").alias("n"), F.count("*").alias("files")).first()
        null_key = spark.read.parquet(f"{self.folder}/null_key")
        keys = keys.select("key").distinct()
        asked = keys.where("key is null").withColumn("_one", F.lit(0)).join(
            null_key.withColumn("_one", F.lit(0)), "_one").drop("_one")
        if not head.files:
            return asked
        dealt = (keys.where("key is not null").withColumn("part", _part("key", head.n))
                 .join(parts.select("part", "file"), "part")
                 .repartition(head.files, "part").sortWithinPartitions("part"))
        return dealt.mapInArrow(_looked_up, "key long, first_shard long, last_shard long, first_row long, documents long"
                                ).unionByName(asked)

    def documents(self, keys: DataFrame) -> DataFrame:
        """``key, start, ids`` of all documents of the keys: ids as little-endian unsigned 32-bit bytes."""
        spark = keys.sparkSession
        shards = spark.read.parquet(f"{self.folder}/shards")
        n = shards.count()
        wanted = (self.entries(keys).select("*", F.explode(F.sequence("first_shard", "last_shard")).alias("shard"))
                  .join(shards.select("shard", "file", "start"), "shard")
                  .repartition(max(1, n), "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first()))
        return wanted.mapInArrow(_read_documents, "key long, start long, ids binary")


def _part(key: str, parts: int):
    return F.shiftrightunsigned(F.xxhash64(key), 33) % F.lit(parts).cast("long")


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, index = None, None
    names = ["first_shard", "last_shard", "first_row", "documents"]
    for b in batches:
        part = np.asarray(b.column("part"))
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        for a, z in zip(edges, np.append(edges[1:], len(part))):
            if part[a] != at:
                system, path = filesystem(b.column("file")[int(a)].as_py())
                with system.open_input_file(path) as f:
                    at, index = part[a], IndexPart(f.read())
            keys = b.column("key").slice(a, z - a)
            found, entries = index.find(np.asarray(keys))
            yield pa.RecordBatch.from_arrays(
                [keys.filter(pa.array(found)), *[pa.array(entries[c].astype(np.int64)) for c in names]], ["key", *names])


def _row_ranges(shard: Shard, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each entry in this shard (none where the key there is another)."""
    keys = shard.all_keys
    col = {c: np.asarray(b.column(c)) for c in ("shard", "first_shard", "last_shard", "first_row", "documents")}
    null = np.asarray(b.column("key").is_null())
    key = np.asarray(b.column("key").fill_null(0))
    here = col["shard"] == col["first_shard"]
    first = np.where(here, col["first_row"], np.where(null, 0, shard.nulls))
    ends = np.searchsorted(keys[shard.nulls:], key, "right") + shard.nulls  # of keys that span shards
    end = np.where(here & (col["first_shard"] == col["last_shard"]), first + col["documents"], ends)
    end = np.where(null, shard.nulls, end)
    inside = first < shard.documents
    same = np.zeros(len(key), bool)
    same[inside] = keys[first[inside]] == key[inside]
    same &= first >= shard.nulls
    return first, np.where(null | same, np.maximum(end - first, 0), 0)


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by shard and key to their documents, payload by payload."""
    now, shard = None, None
    try:
        for b in batches:
            no = np.asarray(b.column("shard"))
            edges = np.flatnonzero(np.concatenate([[True], no[1:] != no[:-1]])) if len(no) else []
            for a, z in zip(edges, np.append(edges[1:], len(no))):
                if no[a] != now:
                    if shard is not None:
                        shard.file.close()
                    now, shard = no[a], Shard(b.column("file")[int(a)].as_py())
                yield from _payloads(shard, b.slice(a, z - a))
    finally:
        if shard is not None:
            shard.file.close()


def _payloads(shard: Shard, entries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    first, n = _row_ranges(shard, entries)
    rows = ragged(first, n)
    key = entries.column("key").take(pa.array(np.repeat(np.arange(len(n)), n)))
    base = int(entries.column("start")[0].as_py()) if entries.num_rows else 0
    starts = shard.all_starts
    size = starts[rows + 1] - starts[rows]
    filled = np.cumsum(size) * shard.width
    apart = np.flatnonzero(np.diff(rows) != 1) + 1  # rows that do not follow the one before
    at = 0
    while at < len(rows):
        stop = int(np.searchsorted(filled, (filled[at - 1] if at else 0) + READ_BYTES, "right"))
        after = np.searchsorted(apart, at, "right")
        stop = min(max(stop, at + 1), int(apart[after]) if after < len(apart) else len(rows))
        lo, hi = int(starts[rows[at]]), int(starts[rows[stop - 1] + 1])
        ids = shard.payload(lo, hi).astype("<u4")
        edge = (np.append(starts[rows[at:stop]], hi) - lo) * 4
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), stop - at, [None, pa.py_buffer(edge), pa.py_buffer(ids)])
        yield pa.RecordBatch.from_arrays([key.slice(at, stop - at), pa.array(base + starts[rows[at:stop]]), data.cast(pa.binary())],
                                         ["key", "start", "ids"])
        at = stop


def write_store(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID,
                id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
                keys_a_part: int = KEYS_A_PART) -> TokenStore:
    """Encode, order and write all documents and their index below ``folder``."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    path = vocabulary or vocabulary_path(DEFAULT_VOCABULARY)
    width = 2 if max(byte_encoder(path).size, end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    head = rows.agg((F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 16 * F.count("*")).alias("bytes")).first()
    shards = _pieces_of(head.bytes, shard_bytes, min(LEAST_SHARD_BYTES, shard_bytes), cores)
    order = [F.col("key").asc_nulls_first(), "tie", "row"]
    (rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
     .repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "text")
     .mapInArrow(_write_shard(f"{folder}/files", path, end_id, width), SEGMENT).write.parquet(f"{folder}/segments"))
    segments = spark.read.schema(SEGMENT).parquet(f"{folder}/segments")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    (segments.groupBy("shard", "file").agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"))
     .withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))
     .write.parquet(f"{folder}/shards"))
    entries = written(segments.groupBy("key").agg(
        F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"),
        F.min_by("first_row", "shard").alias("first_row"), F.sum("documents").alias("documents")), "token-entries")
    entries.where("key is null").drop("key").write.parquet(f"{folder}/null_key")
    keyed = entries.where("key is not null")
    parts = _pieces_of(keyed.count(), keys_a_part, min(LEAST_KEYS_A_PART, keys_a_part), cores)
    (keyed.withColumn("part", _part("key", parts)).repartition(parts, "part").sortWithinPartitions("part")
     .mapInArrow(_write_parts(f"{folder}/files"), "part long, file string, keys long")
     .withColumn("n_parts", F.lit(parts).cast("long")).write.parquet(f"{folder}/parts"))
    return TokenStore(folder)


def op12_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads every document back through the index."""
    docs = table(spark, sf_dir, "documents")
    store = write_store(docs, scratch_path(spark, "token-store"))
    back = store.documents(docs.select(F.col("doc_id").cast("long").alias("key")))
    return back.select(F.col("key").alias("doc_id"), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.crc32("ids").alias("ids_crc32"))
