"""Lookup joins with a checked broadcast.

A side is broadcast only after a bounded count proves it has at most
``max_rows`` rows; otherwise the plain join is planned and adaptive
execution picks the strategy (and splits skewed partitions) at runtime.  A key filter of fixed
size keeps rows that certainly match nothing out of such a join's shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.session import scratch_path

DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows+1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def lookup_join(big: DataFrame, small: DataFrame, on, how: str = "left",
                max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """``big JOIN small`` that broadcasts ``small`` only when it is proven small."""
    if fits(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


FILTER_WORDS = 1 << 18  # rows of a key filter at most: 64 bits each, about 2 MB when broadcast


def _bit(key):
    return F.pmod(F.xxhash64(key), F.lit(FILTER_WORDS * 64))


def key_filter(keys: DataFrame) -> DataFrame:
    """Bits of the hashes of the only column of ``keys``, written: ``_word, _bits``."""
    at = _bit(F.col(keys.columns[0]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    path = scratch_path(keys.sparkSession, "key-filter")
    (keys.select(F.floor(at / 64).alias("_word"), one.alias("_one")).groupBy("_word")
     .agg(F.bit_or("_one").alias("_bits")).write.parquet(path))
    return keys.sparkSession.read.parquet(path)


def maybe_in(rows: DataFrame, key, bits: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``key`` is certainly none of the filter's keys."""
    at = _bit(key)
    hit = F.getbit("_bits", (at % 64).cast("int")) == 1
    return (rows.join(F.broadcast(bits), F.floor(at / 64) == F.col("_word"), "left")
            .withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_word", "_bits"))
