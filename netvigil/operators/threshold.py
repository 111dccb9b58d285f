"""Decision-threshold tuning and score normalisation.

The sweep needs one pass: every row gets the number ``k`` of candidate
thresholds not above its score (0..99); a grouped count by ``(k, label)``
has at most 200 rows, and suffix sums over it give the confusion counts
of every candidate at once.  No subsampling: the result is exact.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.functions import vocab
from netvigil.functions.numeric import safe_ratio
from netvigil.operators.curves import class_counts


def candidate_thresholds() -> list[float]:
    """The 99 evenly spaced candidates (same doubles numpy's linspace gives)."""
    lo, hi, n = vocab.THRESHOLD_GRID
    return [float(x) for x in np.linspace(lo, hi, n)]


def candidate_index(score: Column, cands: list[float]) -> Column:
    """Number of candidates <= score, found from floor(score*100) and two
    comparisons (candidates are ~i/100), so no per-row loop."""
    arr = F.array(*[F.lit(c) for c in cands])
    n = len(cands)
    unit = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))  # clamped before the cast: inf, 3e7
    g = F.least(F.greatest(F.floor(unit * 100).cast("int"), F.lit(0)), F.lit(n))
    a = F.greatest(g - 1, F.lit(0))

    def le(i):  # candidate i (1-based) <= score; false beyond the end
        return F.coalesce((F.try_element_at(arr, i) <= score), F.lit(False)).cast("int")

    return a + le(a + 1) + le(a + 2)


def sweep(df: DataFrame, y: str = "y", score: str = "score", n: str | None = None) -> DataFrame:
    """Confusion counts and measures for every candidate threshold:
    threshold, tp, fp, fn, tn, precision, recall_tpr, f1, fpr, youden.
    With ``n`` every row of ``df`` stands for ``n`` rows."""
    cands = candidate_thresholds()
    s = F.col(score).cast("double")
    base = df.filter(F.col(y).isin(0, 1) & s.isNotNull() & ~F.isnan(s))
    bins = base.groupBy(candidate_index(s, cands).alias("k")).agg(*class_counts(y, n))
    spark = df.sparkSession
    grid = spark.createDataFrame([(0, None)] + [(i + 1, c) for i, c in enumerate(cands)],
                                 "k int, threshold double")
    # grid has 100 rows and bins at most 100: equi-join and windows on them are bounded
    per = grid.join(F.broadcast(bins), "k", "left").fillna(0, ["pos", "neg"])
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    per = (per.withColumn("tp", F.sum("pos").over(suffix)).withColumn("fp", F.sum("neg").over(suffix))
           .withColumn("P", F.sum("pos").over(everything)).withColumn("N", F.sum("neg").over(everything))
           .filter(F.col("k") >= 1))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    return per.select(
        "threshold", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall_tpr"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_ratio(fp, fp + tn).alias("fpr"),
    ).withColumn("youden", F.col("recall_tpr") - F.col("fpr"))


def best_threshold(df: DataFrame, y: str = "y", score: str = "score",
                   objective: str = "f1", n: str | None = None) -> DataFrame:
    """The first candidate (ascending) with the highest F1 or Youden
    index.  One row: metric, threshold, precision, recall_tpr, f1, fpr.
    When no candidate beats -1 the default threshold 0.5 is returned."""
    if objective not in ("f1", "youden"):
        objective = "f1"
    sw = sweep(df, y, score, n)
    w = Window.orderBy(F.col(objective).desc(), F.col("threshold").asc())
    # 99 rows: bounded single-partition window
    best = sw.filter(F.col(objective) > -1).withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    one = df.sparkSession.createDataFrame([(objective, 1)], "metric string, _one int")
    return one.join(best, F.col("_one") == F.col("_r"), "left").select(
        "metric", F.coalesce("threshold", F.lit(vocab.THRESHOLD_DEFAULT)).alias("threshold"),
        "precision", "recall_tpr", "f1", "fpr")


def auto_summary(df: DataFrame, y: str = "y", score: str = "score",
                 objective: str = "youden") -> DataFrame:
    """M9 summary with an automatic threshold, in one pass over the rows.

    Every row falls in a candidate bin (rows without a finite score in
    bin -1); the labelled counts pick the best candidate (as
    ``best_threshold``, default 0.5 when none beats -1) and the all-row
    counts of the same bins give the totals at that threshold; a row without
    a score is normal.  One row: total_records, anomalies_detected,
    normal_records, threshold."""
    if objective not in ("f1", "youden"):
        objective = "f1"
    cands = candidate_thresholds()
    s = F.col(score).cast("double")
    finite = s.isNotNull() & ~F.isnan(s)
    k = F.when(finite, candidate_index(s, cands)).otherwise(F.lit(-1))
    bins = df.groupBy(k.alias("k")).agg(
        F.count_if(finite & (F.col(y) == 1)).alias("pos"),
        F.count_if(finite & (F.col(y) == 0)).alias("neg"),
        F.count(F.lit(1)).alias("n_all"))
    grid = df.sparkSession.createDataFrame(
        [(-1, None), (0, None)] + [(i + 1, c) for i, c in enumerate(cands)], "k int, threshold double")
    # at most 101 rows on both sides: the equi-join and the windows are bounded
    per = grid.join(F.broadcast(bins), "k", "left").fillna(0, ["pos", "neg", "n_all"])
    scored_k = F.col("k") >= 0
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    per = (per.withColumn("tp", F.sum(F.when(scored_k, F.col("pos")).otherwise(0)).over(suffix))
           .withColumn("fp", F.sum(F.when(scored_k, F.col("neg")).otherwise(0)).over(suffix))
           .withColumn("above", F.sum(F.when(scored_k, F.col("n_all")).otherwise(0)).over(suffix))
           .withColumn("P", F.sum("pos").over(every)).withColumn("N", F.sum("neg").over(every))
           .withColumn("total", F.sum("n_all").over(every))
           .filter(F.col("k") >= 1))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    per = (per.withColumn("f1", safe_ratio(2 * tp, 2 * tp + fp + fn))
           .withColumn("youden", safe_ratio(tp, tp + fn) - safe_ratio(fp, fp + tn)))
    best = Window.orderBy((F.col(objective) > -1).desc(), F.col(objective).desc(),
                          F.col("threshold").asc())
    default = F.col("threshold") == F.lit(vocab.THRESHOLD_DEFAULT)
    ranked = per.withColumn("_r", F.row_number().over(best)).withColumn(
        "_ok", F.max(F.col(objective) > -1).over(every))
    pick = ranked.filter((F.col("_ok") & (F.col("_r") == 1)) | (~F.col("_ok") & default))
    return pick.select(F.col("total").alias("total_records"),
                       F.col("above").alias("anomalies_detected"),
                       (F.col("total") - F.col("above")).alias("normal_records"), "threshold")


def best_threshold_value(df: DataFrame, y: str = "y", score: str = "score",
                         objective: str = "youden") -> float:
    row = best_threshold(df, y, score, objective).first()
    return float(row["threshold"]) if row is not None else vocab.THRESHOLD_DEFAULT


def minmax_normalize(df: DataFrame, col: str, out: str | None = None,
                     eps: float = vocab.MINMAX_EPS) -> DataFrame:
    """(d - min) / (max - min + eps) over the whole input.  min and max
    come from one aggregate (two numbers to the driver)."""
    row = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        return df.withColumn(out or col, F.lit(None).cast("double"))
    lo, hi = float(lo), float(hi)
    return df.withColumn(out or col, (F.col(col).cast("double") - F.lit(lo)) / F.lit(hi - lo + eps))
