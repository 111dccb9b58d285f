"""Greedy quotas over files or batches of files.

The original tools read one file (or five) after another and take from each what is still needed.
The running need depends on counts only, so it is a prefix sum: one aggregate gives the
rows per (unit, class), a window over that table (one row per unit and class) gives what earlier
units offered, and each unit's take is what is left of the quota, at most its own offer.  Inside a
unit the rows that come first in md5 order are taken.  The cut is found without ranking the
unit: hashes are uniform, so the k-th smallest lies close to k/n, rows below the margin are in and only
the margin (some 12 square roots of k rows) is ranked.  Were the margin missed (equal keys in great number),
it is widened until it holds the cut, so the result never depends on it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.functions import vocab
from netvigil.operators.joins import lookup_join
from netvigil.operators.sampling import balance_min, hash_text, hash_unit
from netvigil.session import scratch_path

FILES_PER_BATCH = 5


def whole_unit(n: Column) -> Column:
    """A unit offers all its rows."""
    return n


def truncated_share(frac: float) -> Callable[[Column], Column]:
    """A unit offers ``int(n * frac)`` rows, or all of them when that is none (B2)."""
    def offer(n: Column) -> Column:
        share = F.floor(n * F.lit(frac))
        return F.when(share > 0, share).otherwise(n)
    return offer


def rounded_share(frac: float) -> Callable[[Column], Column]:
    """A unit offers ``n * frac`` rows, rounded half to even."""
    return lambda n: F.rint(n * F.lit(frac)).cast("long")


def quotas(df: DataFrame, unit: str, cls: str, need: dict[int, int | None], offer=whole_unit) -> DataFrame:
    """``unit, cls, n, take``: rows there are and rows to take, units in ascending order.

    ``need`` holds the rows wanted per class (None: no limit); other classes get no row.
    """
    counts = df.filter(F.col(cls).isin(list(need))).groupBy(unit, cls).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(cls).orderBy(unit).rowsBetween(Window.unboundedPreceding, -1)
    wanted = None
    for c, k in need.items():
        amount = F.lit(k if k is not None else (1 << 62)).cast("long")
        wanted = F.when(F.col(cls) == c, amount) if wanted is None else wanted.when(F.col(cls) == c, amount)
    left = wanted - F.coalesce(F.sum("_offer").over(before), F.lit(0))
    return (counts.withColumn("_offer", offer(F.col("n")).cast("long"))
            .withColumn("take", F.greatest(F.lit(0), F.least("_offer", left)).cast("long"))
            .select(unit, cls, "n", "take"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def take_first(df: DataFrame, unit: str, cls: str, quota: DataFrame, key_cols,
               seed: int = vocab.SEED, margin: float = 6.0) -> DataFrame:
    """The ``take`` rows of every (unit, class) of ``quota`` that come first in md5 order.

    Two passes over ``df`` in all (one for the quota, one here): the rows up to the upper margin, little more than the result,
    are written, and the exact cut is made there.
    """
    columns = df.columns
    k, n = F.col("take"), F.col("n")
    slack = (F.lit(margin) * F.sqrt(k) + 16) / n
    some = (quota.filter("take > 0").withColumnRenamed(unit, "_u").withColumnRenamed(cls, "_c")
            .withColumn("_lo", F.when(k == n, F.lit(2.0)).otherwise(F.greatest(F.lit(0.0), k / n - slack)))
            .withColumn("_hi", F.when(k == n, F.lit(2.0)).otherwise(k / n + slack)))
    some = _written(some.select("_u", "_c", "take", "_lo", "_hi"), "quota")
    h = hash_text(seed, key_cols)
    while True:
        on = [F.col(unit) == F.col("_u"), F.col(cls) == F.col("_c")]
        # hashes are made of rows whose unit gives some, and again of the few that are ranked: they are not written
        near = lookup_join(df, some, on, "inner").withColumn("_v", hash_unit(h)).filter(F.col("_v") < F.col("_hi"))
        held = _written(near.select(*columns, (F.col("_v") < F.col("_lo")).alias("_sure")), "fill")
        seen = held.groupBy(F.col(unit).alias("_u"), F.col(cls).alias("_c")).agg(
            F.count_if("_sure").alias("_below"), F.count(F.lit(1)).alias("_all"))
        seen = _written(some.join(seen, ["_u", "_c"], "left").fillna(0, ["_below", "_all"]), "fill-seen")
        low, high = F.col("_below") > F.col("take"), F.col("_all") < F.col("take")
        if seen.filter(low | high).isEmpty():
            break
        some = _written(seen.select("_u", "_c", "take", F.when(low, F.lit(0.0)).otherwise(F.col("_lo")).alias("_lo"),
                                    F.when(high, F.lit(2.0)).otherwise(F.col("_hi")).alias("_hi")), "quota")
    edge = held.filter(~F.col("_sure")).withColumn("_h", h)
    w = Window.partitionBy("_u", "_c").orderBy("_h", *key_cols, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    edge = (lookup_join(edge, seen.select("_u", "_c", "_below", "take"), on, "inner")
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("take") - F.col("_below")))
    return held.filter("_sure").select(*columns).unionByName(edge.select(*columns))


def fill(df: DataFrame, unit: str, cls: str, need: dict[int, int | None], key_cols, offer=whole_unit,
         seed: int = vocab.SEED, margin: float = 6.0, warn: bool = False) -> DataFrame:
    """Rows taken unit by unit until every class of ``need`` is full; a shortfall gives fewer rows."""
    quota = _written(quotas(df, unit, cls, need, offer), "quota-all")
    if warn:
        got = {r[0]: r[1] for r in quota.groupBy(cls).agg(F.sum("take")).collect()}  # a row per class
        short = {c: k - got.get(c, 0) for c, k in need.items() if k is not None and got.get(c, 0) < k}
        if short:
            warnings.warn(f"not enough rows for the exact target; missing per class: {short}")
    return take_first(df, unit, cls, quota, key_cols, seed, margin)


def ratio_sample_by_file(df: DataFrame, y: str, rows: int, pos_frac: float, key_cols, file_no: str = "_file_no",
                         seed: int = vocab.SEED, rounding: str = "half_even") -> DataFrame:
    """``rows`` rows with a share ``pos_frac`` of class 1, filled file by file.

    The quota of class 1 is rounded half to even (B8) or truncated (``rounding='floor'``, B9).  Files
    come in the order of ``file_no``: early files give all their rows, one file per class is cut, later ones give none.
    """
    want = rows * pos_frac
    need_pos = int(round(want)) if rounding == "half_even" else int(want)
    return fill(df, file_no, y, {1: need_pos, 0: rows - need_pos}, key_cols, seed=seed, warn=True)


def balance_by_batch(df: DataFrame, y: str, key_cols, file_no: str = "_file_no", files_per_batch: int = FILES_PER_BATCH,
                     frac: float = 0.2, cap: int = 300_000, seed: int = vocab.SEED) -> DataFrame:
    """B2: of every batch of files a truncated share per class (all rows where that is none), until
    ``cap`` rows of the class are there; then both classes are cut to the smaller one (an empty class is an error)."""
    batched = df.withColumn("_batch", F.floor(F.col(file_no) / files_per_batch))
    pool = fill(batched, "_batch", y, {0: cap, 1: cap}, key_cols, truncated_share(frac), seed)
    # another seed: the pool is the smallest hashes of its batches
    return balance_min(pool.drop("_batch"), y, key_cols, seed=seed + 1)


def sample_by_batch(df: DataFrame, frac: float, key_cols, batch: str, seed: int = vocab.SEED) -> DataFrame:
    """A rounded share of every batch's rows."""
    out = fill(df.withColumn("_all", F.lit(0)), batch, "_all", {0: None}, key_cols, rounded_share(frac), seed)
    return out.drop("_all")
