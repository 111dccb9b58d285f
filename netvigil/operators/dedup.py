"""Whole-row duplicates inside batches, without shuffling whole rows.

A 128-bit digest of every row is grouped with its batch: only digests are shuffled, merged on the map side, so
a row that makes up a third of the table costs a row a task.  Rows whose digest occurs once in
their batch (of very many digests: those that a key filter tells to be alone) are kept where they lie.  The others are compared exactly, all columns, by a
distinct, again with a map-side merge; equal digests of different rows just make that distinct larger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.operators.joins import DEFAULT_MAX_BROADCAST_ROWS, fits, key_filter, maybe_in
from netvigil.session import scratch_path


def row_digest(columns):
    """Two 64-bit hashes of the named columns; NULLs are told apart from absent values by a mask."""
    cols = [F.col(f"`{c}`") for c in columns]
    nulls = F.concat(*[c.isNull().cast("string") for c in cols])
    return F.xxhash64(*cols, nulls), F.xxhash64(F.lit(1), nulls, *cols)


def dedup_batches(df: DataFrame, batch: str, columns=None, max_broadcast: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """One of each group of equal rows (in ``columns``, default all) of a batch; other batches keep theirs.

    With ``columns`` a subset, rows that are equal in them but differ elsewhere count as equal and the one kept is that of the
    smallest hash of the whole row.
    """
    spark = df.sparkSession
    every = [c for c in df.columns if c != batch]
    columns = [c for c in (columns or every) if c != batch]
    a, b = row_digest(columns)
    rows = df.withColumn("_a", a).withColumn("_b", b)
    path = scratch_path(spark, "duplicates")
    (rows.groupBy(batch, "_a", "_b").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
     .select(F.col(batch).alias("_u"), F.col("_a").alias("_da"), F.col("_b").alias("_db")).write.parquet(path))
    twice = spark.read.parquet(path)
    on = [F.col(batch).eqNullSafe(F.col("_u")), F.col("_a") == F.col("_da"), F.col("_b") == F.col("_db")]
    if fits(twice, max_broadcast):
        marked = rows.join(F.broadcast(twice), on, "left").withColumn("_dup", F.col("_da").isNotNull())
        once, some = marked.filter("NOT _dup"), marked.filter("_dup")
    else:  # rows that are certainly alone stay where they are; of the rest, those alone pass the exact comparison unchanged
        marked = maybe_in(rows, F.col("_a"), key_filter(twice.select("_da")))
        once, some = marked.filter("NOT _maybe"), marked.filter("_maybe")
    some = some.select(*df.columns)
    if set(columns) == set(every):
        some = some.dropDuplicates()
    else:
        pick = F.min_by(F.struct(*df.columns), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        some = some.groupBy(F.col(batch).alias("_u"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(columns)]
                            ).agg(pick.alias("_row")).select("_row.*")
    return once.select(*df.columns).unionByName(some)
