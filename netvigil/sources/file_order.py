"""The order of rows in a folder of part files, as ordinary columns that survive shuffles (B1, S3).

A scan knows for each row its file, the start of its split and its place in the scan's task; inside a split
that place rises with the lines.  One aggregate gives rows per split (files ordered by name), and their
running sum makes the place a global row number.  The table of splits (one row per split, some
128 MB of input each) is the only thing ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netvigil.operators.joins import lookup_join
from netvigil.session import scratch_path

MAX_BROADCAST_SPLITS = 200_000


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def with_file_numbers(scan: DataFrame, lines: DataFrame, file_no: str = "_file_no") -> DataFrame:
    """``scan`` with the number of its file among those that hold rows (by name, from 0), where rows need no numbers.

    ``lines`` are the same files as text: a row is a line that is not blank, so no field is parsed to find the files.
    """
    blank = F.ltrim("value", F.lit("".join(map(chr, range(33))))) == ""
    files = lines.filter(~blank).select(F.col("_metadata.file_path").alias("_f")).distinct()
    by_name = Window.orderBy(file_name(F.col("_f")), "_f")
    files = files.select("_f", (F.dense_rank().over(by_name) - 1).cast("long").alias(file_no))  # one row per file
    path = scratch_path(scan.sparkSession, "files")
    files.write.parquet(path)
    files = scan.sparkSession.read.schema(files.schema).parquet(path)
    rows = scan.select("*", F.col("_metadata.file_path").alias("_f"))
    return lookup_join(rows, files, "_f", "left", MAX_BROADCAST_SPLITS).drop("_f")


def with_positions(scan: DataFrame, position: str = "_pos", file_no: str = "_file_no") -> DataFrame:
    """``scan`` (read from files, not yet filtered) with the number of its file (by name, from 0)
    and the row's number in all files (from 0).

    The rows are counted now and read again later; should the settings that cut files into splits change in
    between, reading fails with an error rather than giving other numbers.
    """
    spark = scan.sparkSession
    rows = scan.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                       F.col("_metadata.file_block_length").alias("_len"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("_f", "_b", "_len").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by_name = Window.orderBy(file_name(F.col("_f")), "_f")
    in_order = Window.orderBy(file_name(F.col("_f")), "_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_f", "_b", "_len", "_first",
                           (F.dense_rank().over(by_name) - 1).cast("long").alias(file_no),
                           F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_before"))
    path = scratch_path(spark, "splits")
    splits.write.parquet(path)
    splits = spark.read.schema(splits.schema).parquet(path)
    joined = lookup_join(rows, splits, ["_f", "_b", "_len"], "left", MAX_BROADCAST_SPLITS)
    place = F.when(F.col("_before").isNull() | (F.col("_id") < F.col("_first")),
                   F.raise_error(F.lit("the splits of the files have changed since their rows were counted")).cast("long"))
    return (joined.withColumn(position, place.otherwise(F.col("_before") + F.col("_id") - F.col("_first")))
            .drop("_f", "_b", "_len", "_id", "_first", "_before"))
