"""Dataset preparation flows: balanced test files, first-N samples and
fraction samples written back out.  Each is one distributed read, a
selection, and one write (no driver-side row handling)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions import vocab
from netvigil.functions.labels import normalize_label, pick_label
from netvigil.operators import fill, sampling
from netvigil.operators.combine import write_shuffled
from netvigil.sinks import reports as sinks
from netvigil.sources import csv_parts


def balanced_test_file(spark: SparkSession, parts_path: str, names, out_path: str,
                       rows: int = 100_000, pos_frac: float = 0.5, label_col: str = "attack",
                       glob: str = "data_*.csv", key_cols=None, seed: int = vocab.SEED) -> DataFrame:
    """B8 + K1: ``rows`` rows with a share ``pos_frac`` of attacks (quota
    rounded half-even, filled file by file, shortfall warned), written as shuffled CSV
    files with header.  The label column is the first present of ``label_col`` and the
    usual candidates; labels use the map that also knows 'botnet'."""
    parts = csv_parts.read_parts(spark, parts_path, names, glob=glob, file_numbers=True)
    label = pick_label(parts.columns, [label_col, *vocab.LABEL_CANDIDATES_TESTSET])
    keys = list(key_cols or [c for c in names if c != label])
    lab = parts.withColumn("_y", normalize_label(label, "botnet")).filter(F.col("_y").isin(0, 1))
    out = fill.ratio_sample_by_file(lab, "_y", rows, pos_frac, keys, seed=seed).drop("_y", "_file_no")
    write_shuffled(out, out_path, keys, seed)
    return out


def first_n_sample_file(spark: SparkSession, parts_path: str, names, out_path: str,
                        per_class: int = 5000, order_cols=None, glob: str = "data_*.csv",
                        max_files: int | None = None, allow_partial: bool = True, seed: int = vocab.SEED) -> DataFrame:
    """B1 + P4 + K1: the first ``per_class`` rows of each class as they stand in the
    files (the first ``max_files`` by name, if given), or in ``order_cols`` order, the first of
    them numeric (labels: lower-case map, unknown counts as attack),
    canonical ``label`` column with the stale label columns dropped, written
    as shuffled CSV files with header."""
    parts = csv_parts.read_parts(spark, parts_path, names, glob=glob, max_files=max_files, positions=True)
    label = pick_label(parts.columns, vocab.LABEL_CANDIDATES_SAMPLE)
    lab = parts.withColumn("__y__", normalize_label(label, "closed"))
    order = ["_pos"]
    if order_cols:
        known = [c for c in order_cols if c in lab.columns]
        lab, order = lab.withColumn("_ord", F.col(known[0]).try_cast("double")), ["_ord", *known[1:]]
    picked = sampling.first_n_per_class(lab, "__y__", per_class, order,
                                        allow_partial=allow_partial).drop("_pos", "_file_no", "_ord")
    out = picked.withColumn("label", F.col("__y__").cast("int"))
    out = out.drop(*[c for c in vocab.STALE_LABEL_COLUMNS if c in out.columns and c != "label"])
    write_shuffled(out, out_path, [c for c in names if c in out.columns], seed)
    return out


def fraction_to_parquet(spark: SparkSession, path: str, out_path: str, frac: float = 0.05,
                        key_cols=None, seed: int = vocab.SEED) -> DataFrame:
    """B4 + S7 + K2: tolerant read of CSV files with their own header
    (rows with too many fields skipped, short ones padded), a hash fraction kept, written as
    Parquet."""
    names = spark.read.option("header", True).csv(path).columns
    raw = csv_parts.read_csv_with_header(spark, path, names)
    keys = list(key_cols or raw.columns)
    out = sampling.sample_fraction(raw, frac, keys, seed)
    sinks.write_table(out, out_path, "parquet")
    return out
