"""Operator 9, n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles (lower-cased words between white space; a shorter text
is one shingle); two are linked if the sets' Jaccard similarity is 0.8 or more.

1. Rows with equal sets collapse into one set with a number of copies.
2. Sets whose MinHash values agree in a band meet in a bucket; buckets with equal members count
   once, and large ones are cut into tiles of bounded size.  In a tile the MinHash values of pairs
   are compared a few at a time, and a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold is below the tolerance.  A tile returns a spanning forest of the
   surviving pairs, never all of them.
3. Components of those edges bring the texts of possible links together, again in bounded tiles.
   Every pair of a component is pruned with all MinHash values and, if it survives, verified exactly.
   A tile returns link counts and a spanning forest of the verified links.
4. Components of the verified links are the classes.

With 32 bands of 5 values a pair at similarity 0.8 shares no band with probability 3e-6; pruning
loses such a pair with a probability below the tolerance of 1e-6 at each of its steps.

Defined cases: rows without words are copies of each other and of nothing else; repeated rows
count as copies; NULL ids take part, a class is named by its smallest non-NULL id; an empty input
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.llm.common import components, key_filter, marked, table, written
from netvigil.llm.textvec import Texts, Words, distinct, grams, in_text, mix, pieces

K = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
N_HASH = BANDS * ROWS
HEAD = 64  # MinHash values (two bytes each) that the bucket tiles compare
TOLERANCE = 1e-6
BUCKET_CHUNK = 1024  # sets of one side of a bucket tile
CLASS_CHUNK = 384  # sets of one side of a verification tile
CHUNK_SHINGLES = 400_000  # shingles of one side of a verification tile, on average
DENSE_FROM = 24  # sets in a tile from which intersections are counted by matrix products

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 32, N_HASH, np.uint32)
_MUL = _rng.integers(0, 1 << 31, N_HASH, np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Least matches among ``n`` MinHash values that keep a pair.

    With a uniform prior the posterior P(J >= t | m of n) is P(Binomial(n + 1, t) <= m).
    """
    p = 0.0
    for m in range(n + 1):
        p += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        if p >= tolerance:
            return m
    return n


def schedule(steps: list[int], threshold: float, tolerance: float) -> list[tuple[int, int, int]]:
    """(from, to, least matches so far) of the incremental comparison."""
    return [(a, b, least_matches(b, threshold, tolerance)) for a, b in zip([0, *steps], steps)]


def shingles(t: Texts, k: int):
    """Shingle hashes in text order without repeats inside a text, and their texts."""
    w = Words(t)
    g, at = grams(w.hash, w.doc, k)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        one = np.array([_chain(w.hash[w.off[i]:w.off[i + 1]]) for i in short], np.uint64)
        g, doc = np.concatenate([g, one]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    _, first, _ = distinct(in_text(g, doc))
    return g[first], doc[first]


def _chain(h: np.ndarray) -> np.uint64:
    return mix(grams(h, np.zeros(len(h), np.int8), len(h))[0] + np.uint64(len(h)))[0]


class Sketch:
    """Sets of a piece: set id (0 without words), size, MinHash values, shingles by text."""

    def __init__(self, column, k: int, hashes: int = N_HASH):
        t = Texts(column, lower=True)
        g, doc = shingles(t, k)
        self.n = np.bincount(doc, minlength=t.n)
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        self.g = g
        self.id = np.zeros(t.n, np.uint64)
        self.sig = np.zeros((t.n, N_HASH), np.uint32)
        own = np.flatnonzero(self.n)
        if len(own):
            at = self.off[own]
            a = np.add.reduceat(mix(g), at)
            b = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), at)
            self.id[own] = mix(a + mix(b + self.n[own].astype(np.uint64)))
            h = (g >> np.uint64(32)).astype(np.uint32)
            v = np.empty_like(h)
            for j in range(hashes):
                np.bitwise_xor(h, _XOR[j], out=v)
                np.multiply(v, _MUL[j], out=v)
                self.sig[own, j] = np.minimum.reduceat(v, at)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows)])


def _values(column, dtype, n: int) -> np.ndarray:
    """Binary values of equal width as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), n)


def _sketch_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            s = Sketch(p.column("text"), k)
            yield pa.RecordBatch.from_arrays(
                [p.column("doc_id"), pa.array(s.id.view(np.int64)), pa.array(s.n.astype(np.int64)),
                 _binary(s.sig)], ["doc_id", "set_id", "size", "sig"])
    return run


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 5_000):
            p = b.slice(at, 5_000)
            sig = _values(p.column("sig"), np.uint32, N_HASH).astype(np.uint64)
            h = np.empty((len(sig), BANDS), np.uint64)
            for j in range(BANDS):
                v = np.full(len(sig), j + 1, np.uint64)
                for r in range(ROWS):
                    v = mix(v ^ sig[:, j * ROWS + r])
                h[:, j] = v
            ids = np.repeat(np.asarray(p.column("set_id")), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(ids)],
                                             ["bucket", "set_id"])


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Whole groups of sorted input, at least ``rows`` rows of them at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        last = np.ones(t.num_rows, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            last &= c == c[-1]
        cut = t.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield t.slice(0, cut)
            t = t.slice(cut)
        held, n = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _group_numbers(t: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    for k in keys:
        c = t.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def _flatten(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def _link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest row of each connected set) after joining the pairs."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        label = _flatten(label)
    return label


def _bucket_forest(steps):
    """Spanning forests of the pairs that survive the incremental comparison, by tile."""
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, keys):
            group = _group_numbers(t, keys)
            ids = t.column("set_id").to_numpy()
            chunk = t.column("chunk").to_numpy()
            one = t.column("i").to_numpy() == t.column("j").to_numpy()
            head = _values(t.column("head"), np.uint16, HEAD)
            label = np.arange(len(ids))
            for d in range(1, int(np.bincount(group).max())):
                a = np.flatnonzero((group[d:] == group[:-d]) & (one[d:] | (chunk[d:] != chunk[:-d])))
                a = a[label[a] != label[a + d]]
                matches = np.zeros(len(a), np.int32)
                for lo, hi, least in steps:
                    matches += (head[a, lo:hi] == head[a + d, lo:hi]).sum(1, dtype=np.int32)
                    keep = matches >= least
                    a, matches = a[keep], matches[keep]
                label = _link(label, a, a + d)
            child = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[label[child]])], ["a", "b"])
    return run


def _set_rows(k: int):
    """Texts of candidate sets with their MinHash values and shingles (eight bytes each)."""
    keep = ["root", "chunk", "chunks", "copies", "set_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            s = Sketch(p.column("text"), k)
            own = np.flatnonzero(s.id.view(np.int64) == np.asarray(p.column("set_id")))
            q = p.take(pa.array(own))
            yield pa.RecordBatch.from_arrays(
                [*[q.column(c) for c in keep], _binary(s.sig[own]),
                 pa.array([np.sort(s.g[s.off[i]:s.off[i + 1]]).tobytes() for i in own], pa.binary())],
                [*keep, "sig", "shingles"])
    return run


def _linked(sig: np.ndarray, sets: list[np.ndarray], cross: np.ndarray, steps, threshold: float):
    """Verified pairs (a < b) of one tile; ``cross`` is each row's side, -1 for within."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    a, b = np.triu_indices(m, 1)
    may = (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
    may &= (cross[a] < 0) | (cross[a] != cross[b])
    a, b = a[may], b[may]
    matches = np.zeros(len(a), np.int32)
    for lo, hi, least in steps:
        got = np.zeros(len(a), np.int32)
        for at in range(0, len(a), 200_000):
            x, y = a[at:at + 200_000], b[at:at + 200_000]
            got[at:at + 200_000] = (sig[x, lo:hi] == sig[y, lo:hi]).sum(1, dtype=np.int32)
        matches += got
        keep = matches >= least
        a, b, matches = a[keep], b[keep], matches[keep]
    if not len(a):
        return a, b
    if m < DENSE_FROM:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                           for i, j in zip(a.tolist(), b.tolist())])
    else:
        common = _common_counts(sets)[a, b]
    ok = common >= threshold * (size[a] + size[b] - common) - 1e-9
    return a[ok], b[ok]


def _common_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a tile's sets, by matrix products over column blocks."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, _, inv = distinct(np.concatenate(sets))
    count = np.bincount(inv)
    shared = count[inv] > 1
    number = np.cumsum(count > 1) - 1
    row, col = row[shared], number[inv[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    last = int(col[-1]) + 1 if len(col) else 0
    for at in range(0, last, columns):
        lo, hi = np.searchsorted(col, [at, at + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[row[lo:hi], col[lo:hi] - at] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify_rows(steps, threshold: float):
    """Per tile and set: links to other sets (their copies count) and an edge of the forest."""
    keys = ["root", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, keys, 512):
            number = _group_numbers(whole, keys)
            for lo, hi in zip(np.searchsorted(number, np.arange(number[-1] + 1)),
                              np.searchsorted(number, np.arange(number[-1] + 1), "right")):
                t = whole.slice(lo, hi - lo)
                ids, first = np.unique(t.column("set_id").to_numpy(), return_index=True)
                t = t.take(pa.array(first))
                copies = t.column("copies").to_numpy()
                cross = np.where(t.column("i").to_numpy() == t.column("j").to_numpy(), -1,
                                 t.column("chunk").to_numpy())
                sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
                a, b = _linked(_values(t.column("sig"), np.uint32, N_HASH), sets, cross, steps, threshold)
                n = len(ids)
                links = (np.bincount(a, weights=copies[b], minlength=n)
                         + np.bincount(b, weights=copies[a], minlength=n)).astype(np.int64)
                label = _link(np.arange(n), a, b)
                has = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[has]), pa.array(links[has]), pa.array(ids[label[has]])],
                    ["set_id", "links", "parent"])
    return run


def _tiles(df: DataFrame, *group: str) -> DataFrame:
    """Rows with ``chunk`` of ``chunks`` go to the tiles (i, j) of all pairs of chunks."""
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    out = df.select("*", other)
    i, j = F.least("chunk", "other"), F.greatest("chunk", "other")
    out = out.withColumn("i", i).withColumn("j", j).drop("other", "chunks")
    return out.repartition(*group, "i", "j").sortWithinPartitions(*group, "i", "j")


def _texts_of(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Texts of ``rows`` beside the set of ``wanted`` that they stand for, found by the set's smallest id.

    Texts that certainly stand for no wanted set are left out before the shuffle.  Where sets share an id (or
    have none) a text meets its own set only, by id and set.
    """
    def near(sets):
        return marked(rows, F.col("doc_id"), key_filter(sets.select("rep"))).where("_maybe").drop("_maybe")

    same_id = F.col("doc_id").eqNullSafe(F.col("rep"))
    shared = written(wanted.groupBy("rep").agg(F.count("*").alias("m")).where("m > 1").select(F.col("rep").alias("_rep")),
                     "shared-ids")
    if shared.isEmpty():
        return near(wanted).join(wanted, same_id).drop("doc_id", "rep")
    on = F.col("rep").eqNullSafe(F.col("_rep"))
    alone = written(wanted.join(shared, on, "left_anti"), "wanted-alone")
    several = written(wanted.join(shared, on, "left_semi"), "wanted-shared")
    named = near(several).mapInArrow(_with_set_id(k), "doc_id long, text string, _set long")
    named = named.join(several, same_id & (F.col("_set") == F.col("set_id"))).drop("doc_id", "rep", "_set")
    return near(alone).join(alone, same_id).drop("doc_id", "rep").unionByName(named)


def set_classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = K,
                tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id, set_id``) and distinct sets (``set_id, rep, copies, links, root``), written.

    ``rep`` is a set's smallest document id, ``links`` the number of rows with other sets linked
    to it, ``root`` names the class.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(rows.mapInArrow(_sketch_rows(k), "doc_id long, set_id long, size long, sig binary"),
                       "sketches")
    sets = written(sketches.groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("size").alias("size"),
        F.max("sig").alias("sig")), "sets")

    # buckets: member sets that differ from those of other buckets, in bounded tiles
    worded = sets.where("size > 0")
    members = worded.select("set_id", "sig").mapInArrow(_bucket_rows, "bucket long, set_id long")
    members = written(members, "buckets")
    hot = (members.groupBy("bucket").agg(F.count("*").alias("m"), F.min("set_id").alias("low"),
                                         F.bit_xor(F.xxhash64("set_id")).alias("who")).where("m > 1"))
    hot = hot.groupBy("m", "low", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "m")
    chunks = F.ceil(F.col("m") / BUCKET_CHUNK).cast("int")
    met = (members.join(hot, "bucket").withColumn("chunks", chunks)
           .withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int")).drop("m"))
    heads = worded.select("set_id", _head("sig").alias("head"))
    steps = schedule([16, 32, HEAD], threshold, tolerance)
    edges = (_tiles(met.join(heads, "set_id"), "bucket")
             .mapInArrow(_bucket_forest(steps), "a long, b long"))
    near = written(components(edges), "near")

    # verification: texts of the sets in one component meet in bounded tiles
    own = near.join(worded.select(F.col("set_id").alias("node"), "rep", "copies", "size"), "node")
    weight = own.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / CLASS_CHUNK), F.ceil(F.sum("size") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    wanted = (own.join(weight, "root").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
              .select("rep", "root", "chunk", "chunks", "copies", F.col("node").alias("set_id")))
    wanted = written(wanted, "wanted")
    texts = _texts_of(rows, wanted, k)
    payload = texts.mapInArrow(_set_rows(k), (
        "root long, chunk int, chunks int, copies long, set_id long, sig binary, shingles binary"))
    full = schedule([32, 64, 96, 128, N_HASH], threshold, tolerance)
    verified = written(_tiles(payload, "root").mapInArrow(
        _verify_rows(full, threshold), "set_id long, links long, parent long"), "links")
    links = verified.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = components(verified.select(F.col("set_id").alias("a"), F.col("parent").alias("b")))

    s = (sets.select("set_id", "rep", "copies").join(links, "set_id", "left")
         .join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
         .withColumn("root", F.coalesce("root", "set_id")))
    return sketches.select("doc_id", "set_id"), written(s, "set-classes")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, k: int = K,
                 tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_copies``.

    ``class_id`` is the smallest id among the documents that links connect to it, ``n_links`` the
    number of other rows linked to it directly, ``n_copies`` the rows with its very shingles.
    """
    rows, s = set_classes(docs, threshold, k, tolerance)
    names = s.groupBy("root").agg(F.min("rep").alias("class_id"))
    s = s.join(names, "root").select(
        "set_id", "class_id", F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.join(s, "set_id").select("doc_id", "class_id", "n_links", "n_copies")


def _with_set_id(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            yield p.append_column("_set", pa.array(Sketch(p.column("text"), k, 0).id.view(np.int64)))
    return run


def distinct_documents(docs: DataFrame, threshold: float = THRESHOLD, k: int = K,
                       tolerance: float = TOLERANCE) -> DataFrame:
    """One row of ``docs``, with all its columns, of each class: that of the smallest id.

    Rows whose id is certainly in no class of several rows stay as they are; texts of the others
    only are shuffled, to keep one row of each class.
    """
    ids, s = set_classes(docs, threshold, k, tolerance)
    classes = written(s.groupBy("root").agg(
        F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "set_id")).alias("c"),
        F.sum("copies").alias("n")), "classes")
    # ids of rows in classes of several: found over set ids by a filter too, so that a set with
    # very many copies meets in no task
    several = s.join(classes.where("n > 1").select("root"), "root", "left_semi").select("set_id")
    repeated = marked(ids, F.col("set_id"), key_filter(several)).where("_maybe").select("doc_id")
    doubtful = key_filter(repeated)
    doc_id = F.col("doc_id").cast("long")
    flagged = marked(docs, doc_id, doubtful)
    clear = flagged.where(~F.col("_maybe")).select(*docs.columns)

    chosen = classes.select(F.col("c.set_id").alias("_chosen"), F.col("c.rep").alias("_rep"))
    chosen = marked(chosen, F.col("_rep"), doubtful).where("_maybe").drop("_maybe")
    rows = (flagged.where("_maybe").select(*docs.columns)
            .mapInArrow(_with_set_id(k), T.StructType([*docs.schema.fields]).add("_set", "long")))
    # both keys, so that a text with very many copies is spread over the tasks
    kept = rows.join(chosen, (F.col("_set") == F.col("_chosen")) & doc_id.eqNullSafe(F.col("_rep")))
    return clear.unionByName(kept.dropDuplicates(["_chosen", "_rep"]).select(*docs.columns))


def _head(sig: str):
    """The low two bytes of the first MinHash values (the signature is little-endian)."""
    return F.unhex(F.regexp_replace(F.hex(F.substring(F.col(sig), 1, HEAD * 4)), "(.{4}).{4}", "$1"))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return jaccard_join(table(spark, sf_dir, "documents"))
