"""Queries over folders of part files: quotas filled file by file, rows in file order, several headers.

The parts are written from the flow fixture: ``PARTS`` files (by ``pkSeqID``), whose names sort by number, each in
``flow_id`` order where a query asks for rows by their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions.labels import normalize_label
from netvigil.operators import combine, dedup, fill, sampling
from netvigil.operators.sizing import files_for, written
from netvigil.session import scratch_path
from netvigil.sources import csv_parts, fixtures, mixed

PARTS = 13
COLUMNS = ["flow_id", "saddr", "daddr", "proto", "attack", "score"]


def part_number():
    return (F.col("pkSeqID") % PARTS).cast("int")


def written_parts(spark: SparkSession, sf_dir: str, columns=COLUMNS, header: bool = True, ordered: bool = True) -> str:
    """Folder of CSV parts: part k holds the flows with ``pkSeqID % PARTS = k``, if ``ordered`` sorted by ``flow_id``."""
    path = scratch_path(spark, "parts")
    f = fixtures.flows(spark, sf_dir).withColumn("_part", part_number())
    f = f.select(*columns, "_part").repartitionById(PARTS, "_part") if not ordered else (
        f.repartitionById(PARTS, "_part").sortWithinPartitions("flow_id"))
    (f.select(*columns).write.options(**csv_parts.TEXT_OPTS).option("header", header).csv(path))
    return path


def _labelled(spark: SparkSession, sf_dir: str, profile: str, positions: bool = False, **options) -> DataFrame:
    parts = csv_parts.read_parts(spark, written_parts(spark, sf_dir, ordered=positions), COLUMNS, glob="part-*.csv",
                                 positions=positions, file_numbers=True, **options)
    return (parts.withColumn("label", normalize_label("attack", profile)).filter(F.col("label").isin(0, 1))
            .select("flow_id", "label", "_file_no", *["_pos"] * positions))


def ratio_sample_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20,000 rows, three of ten attacks; files are used up one after another."""
    return fill.ratio_sample_by_file(_labelled(spark, sf_dir, "botnet"), "label", 20_000, 0.3, ["flow_id"]
                                     ).select("flow_id", "label", "_file_no")


def holdout_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five files are skipped, the positive quota is truncated."""
    rows = _labelled(spark, sf_dir, "small", skip_files=5)
    return fill.ratio_sample_by_file(rows, "label", 9_999, 0.5, ["flow_id"], rounding="floor").select("flow_id", "label")


def balance_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: a fifth of every class in each batch of five files, at most 1,500 a class, then the smaller class's size."""
    return fill.balance_by_batch(_labelled(spark, sf_dir, "named"), "label", ["flow_id"], cap=1_500).select("flow_id", "label")


def balance_by_batch_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 where a share truncates to nothing: then the batch gives all its rows."""
    rows = _labelled(spark, sf_dir, "named").filter((F.col("label") == 0) | F.col("flow_id").endswith("777"))
    return fill.balance_by_batch(rows, "label", ["flow_id"]).select("flow_id", "label")


def first_n_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: the first 2,500 rows per class as they stand in the files."""
    rows = written(_labelled(spark, sf_dir, "open", positions=True), "labelled")  # the files are parsed for this table only
    return sampling.first_n_per_class(rows, "label", 2_500, ["_pos"]).select("flow_id", "label", "_pos")


def mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder whose files have three headers; those without a label column are skipped."""
    path = scratch_path(spark, "mixed")
    f = fixtures.flows(spark, sf_dir)
    kinds = [["flow_id", "attack", "pkts"], ["saddr", F.col("attack").alias("label"), "flow_id"], ["flow_id", "score"]]
    for k, columns in enumerate(kinds):
        (f.filter(F.col("pkSeqID") % 3 == k).select(*columns).write.mode("append").options(**csv_parts.TEXT_OPTS)
         .option("header", True).csv(path))
    rows, _ = mixed.read_mixed(spark, path, "part-*.csv")
    return rows.select("flow_id", "label_raw", F.col("pkts").cast("bigint").alias("pkts"), "saddr")


def dedup_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal rows go within a batch of five files, not across batches; then a rounded 30 % of each batch."""
    columns = ["saddr", "proto", "category", "attack"]
    path = written_parts(spark, sf_dir, columns, ordered=False)
    rows = csv_parts.read_parts(spark, path, columns, glob="part-*.csv", file_numbers=True)
    rows = rows.withColumn("batch", F.floor(F.col("_file_no") / fill.FILES_PER_BATCH)).drop("_file_no")
    once = written(dedup.dedup_batches(rows, "batch"), "once")  # read for the quotas and for the sample
    return fill.sample_by_batch(once, 0.3, ["batch", *columns], "batch")


def shuffled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled CSV parts written by many tasks, read back in file order: the files in turn are the shuffle."""
    path = scratch_path(spark, "shuffled")
    f = fixtures.flows(spark, sf_dir).select("flow_id", "attack")
    combine.write_shuffled(f, path, ["flow_id"], files=files_for(f, 5))
    back = csv_parts.read_parts(spark, path, ["flow_id", "attack"], glob="part-*.csv", positions=True)
    return back.select("flow_id", (F.col("_pos") - F.col("_file_no")).alias("place"))  # a header line a file


def head_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 rows of every part, as ``nrows`` gives them."""
    parts = csv_parts.read_parts(spark, written_parts(spark, sf_dir), COLUMNS, glob="part-*.csv")
    return csv_parts.head_per_file(parts, 40).select("flow_id", "attack")


QUERIES = {
    "mixed_headers": mixed_headers,
    "dedup_batches": dedup_batches,
    "shuffled_parts": shuffled_parts,
    "head_per_file": head_per_file,
    "ratio_sample_by_file": ratio_sample_by_file,
    "holdout_by_file": holdout_by_file,
    "balance_by_batch": balance_by_batch,
    "balance_by_batch_rest": balance_by_batch_rest,
    "first_n_file_order": first_n_file_order,
}
