"""Combining sources (U1 with P1/P2) and file-order shuffling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.functions import vocab
from netvigil.functions.labels import pick_label
from netvigil.operators.sampling import hash_text
from netvigil.sinks.reports import write_table


def union_labelled(frames, candidates=vocab.LABEL_CANDIDATES_TRAIN, out: str = "label_raw"
                   ) -> DataFrame:
    """U1 + P1/P2: per source pick the first label column present, skip
    sources without one, and union the rest by name (missing columns
    become NULL).  The chosen label is copied to ``out``."""
    kept = []
    for df in frames:
        try:
            col = pick_label(df.columns, candidates)
        except ValueError:
            continue  # P2: a source without label is skipped
        kept.append(df.withColumn(out, F.col(f"`{col}`").cast("string")))
    if not kept:
        raise ValueError("no source has a label column")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept)


def hash_shuffled(df: DataFrame, key_cols, seed: int = vocab.SEED) -> DataFrame:
    """A reproducible shuffled order (md5 of seed and key), for
    writing sample files; analytics never depend on row order."""
    return df.orderBy(hash_text(seed, key_cols), *key_cols)


def write_shuffled(df: DataFrame, path: str, key_cols, seed: int = vocab.SEED, files: int | None = None,
                   fmt: str = "csv") -> None:
    """B10 + K1: ``df`` in the order of ``hash_shuffled``, written by many tasks.

    Tasks hold ranges of the hash and part files are numbered in range order, each CSV file with its header:
    the files one after another are the shuffled table.  ``files`` sets their number, else
    the shuffle's partitions do.
    """
    h = hash_text(seed, key_cols)
    if files is None:
        out = df.orderBy(h, *key_cols)
    else:
        out = df.repartitionByRange(files, h, *key_cols).sortWithinPartitions(h, *key_cols)
    write_table(out, path, fmt)
