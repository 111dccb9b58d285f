"""Table profiling: value counts, NULL counts, column summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, top: int = 30) -> DataFrame:
    """A1: frequency of each value (NULL kept as a group), most frequent
    first (ties by value), top ``top`` — a top-k, not a global sort."""
    return (df.groupBy(F.col(f"`{col}`").alias(col)).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc_nulls_first(col)).limit(top))


def null_profile(df: DataFrame, top: int = 10) -> DataFrame:
    """A2: NULL count per column (one pass), most first, top ``top``."""
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(f"c{i}").alias("n_null"))
                      for i, c in enumerate(cols)])
    return (counts.select(F.explode(pairs).alias("p")).select("p.*")
            .orderBy(F.desc("n_null"), F.asc("col_name")).limit(top))


def column_summary(df: DataFrame) -> DataFrame:
    """One row per column: name, type, non-NULL count and total rows
    (one aggregate pass)."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("col_name"),
                               F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                               F.col(f"c{i}").alias("non_null")) for i, c in enumerate(cols)])
    return agg.select("_rows", F.explode(pairs).alias("p")).select("p.*", F.col("_rows").alias("rows"))
