"""Operator 8, best-fit packing: hierarchical residual packing of token sequences.

Every partition packs its pieces by best fit in falling length and emits the bins that are
nearly full.  Underfull bins become items themselves and are merged with those of other
partitions, a fan-in of partitions at a time, for repeated best-fit rounds, until one partition
is left or a round no longer saves bins.  Lengths and ids move, texts do not.

Defined cases: NULL text is the empty document (the end id alone); repeated rows are packed
as often as they occur; a NULL id stays NULL; an empty input gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import table, written
from netvigil.llm.textvec import pieces
from netvigil.llm.tokens import encoder, vocabulary_path

CAPACITY = 2048
NEARLY_FULL = 2040  # a bin of at least so many tokens is emitted at once
ITEMS_A_TASK = 200_000  # underfull bins that one task of a merge round takes
FAN_IN = 8
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = "struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>"


def cut_pieces(path: str, capacity: int, end_id: int):
    """Documents to pieces: ids and the end id, cut every ``capacity`` tokens, with checksums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            ids, bound = encoder(path).encode(p.column("text"))
            raw = ids.astype("<u4")
            end = np.array([end_id], "<u4")
            n = np.diff(bound) + 1
            parts = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), parts)
            no = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = no * capacity
            length = np.minimum(capacity, n[doc] - start)
            lo = bound[doc] + start
            last = start + length == n[doc]
            crc = np.zeros(len(doc), np.int64)
            for i, (a, m, z) in enumerate(zip(lo.tolist(), length.tolist(), last.tolist())):
                c = zlib.crc32(raw[a:a + m - z])
                crc[i] = zlib.crc32(end, c) if z else c
            yield pa.RecordBatch.from_arrays(
                [p.column("doc_id").take(pa.array(doc)), pa.array(no.astype(np.int32)),
                 pa.array(start), pa.array(length), pa.array(crc)],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; items must come in falling length.

    Open bins are kept by their room; a bit mask of the rooms in use finds the tightest room
    that an item fits into.
    """
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    out = np.empty(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        out[i] = b
        left = room - size
        if left:
            rooms[left].append(b)
            mask |= 1 << left
    return out


def _collect(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def pack_round(capacity: int, nearly_full: int, level: int):
    """One best-fit round inside a partition of bins (``fill``, ``members``): merged bins.

    ``bin_id`` is made of the round, the partition and the bin's number there.  Rows are sorted
    by length and first member before packing, so a repeated task gives the same bins.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _collect(batches)
        if t is None:
            return
        fill = t.column("fill").to_numpy()
        bins = best_fit(fill, capacity)
        order = np.argsort(bins, kind="stable")  # the items of a bin side by side
        own, size = bins[order], fill[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        before = np.cumsum(size) - size
        shift = before - np.repeat(before[first], np.diff(np.append(first, len(own))))
        members = t.column("members").combine_chunks().take(pa.array(order))
        offsets = np.asarray(members.offsets).astype(np.int64)
        per_item = np.diff(offsets)
        flat = members.flatten()
        fields = {f.name: flat.field(f.name) for f in flat.type}
        fields["offset"] = pa.array(fields["offset"].to_numpy() + np.repeat(shift, per_item))
        flat = pa.StructArray.from_arrays(list(fields.values()), list(fields))
        edges = np.append(np.concatenate([[0], np.cumsum(per_item)])[first], len(flat))
        total = np.add.reduceat(size, first)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        out = pa.RecordBatch.from_arrays(
            [pa.array(base + np.arange(len(first), dtype=np.int64)), pa.array(total),
             pa.array(total >= nearly_full),
             pa.ListArray.from_arrays(pa.array(edges, pa.int32()), flat)],
            ["bin_id", "fill", "closed", "members"])
        for at in range(0, out.num_rows, 20_000):
            yield out.slice(at, 20_000)
    return run


def pack(items: DataFrame, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL,
         items_a_task: int = ITEMS_A_TASK) -> DataFrame:
    """Pack pieces (columns of ``PIECE``, already written) into bins of ``capacity``.

    Returns the pieces with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).
    """
    schema = ("bin_id long, fill long, closed boolean, members array<struct<doc_id: long, "
              "piece: int, start: long, length: long, ids_crc32: long, offset: long>>")
    order = [F.col("fill").desc(), F.col("members")[0]]
    bins = items.select(F.col("length").alias("fill"), F.array(F.struct(
        "doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))).alias("members"))
    # dealt by the written row's number, so that rows which are equal in every field are spread as others are
    bins = bins.withColumn("bin_id", F.monotonically_increasing_id())
    n = items.count()
    done, level, was = [], 0, None
    while True:
        tasks = max(1, -(-n // items_a_task))
        if level:
            tasks = max(1, min(tasks * FAN_IN, -(-before // FAN_IN)) if tasks > 1 else 1)
        else:
            tasks = bins_partitions(n, items_a_task, items)
        bins = bins.repartition(tasks, F.xxhash64(F.lit(level), "bin_id"))
        before = tasks
        out = written(bins.select("fill", "members").sortWithinPartitions(*order)
                      .mapInArrow(pack_round(capacity, nearly_full, level), schema), "pack")
        open_bins = out.where(~F.col("closed"))
        n = open_bins.count()
        last = n <= 1 or tasks == 1 or (was is not None and n > 0.99 * was)
        done.append(out if last else out.where("closed"))
        if last:
            break
        was, bins, level = n, open_bins, level + 1
    all_bins = done[0]
    for d in done[1:]:
        all_bins = all_bins.unionByName(d)
    return all_bins.select(F.col("bin_id").alias("sequence_id"), F.inline("members"))


def bins_partitions(n: int, items_a_task: int, items: DataFrame) -> int:
    """Partitions of the first round: as many as keep all cores busy, within the task bound."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // items_a_task), min(cores, -(-n // 2_000)))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None,
                   end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole documents: one row per piece with its sequence and offset."""
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = written(rows.mapInArrow(cut_pieces(path, capacity, end_id), PIECE), "pieces")
    return pack(cut, capacity)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
