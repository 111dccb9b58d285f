"""ROC curve and AUC over grouped scores, without a global single-task window.

Scores are first reduced to one row per distinct score (pos, neg counts;
map-side combined).  Running sums in descending score order are then
computed in two levels: scores are cut into at most ``max_buckets``
ranges by approximate quantiles (the bucket count grows with the bytes of input files, or
with the distinct scores where those are not known); a per-bucket totals table (bounded by the bucket count) yields each bucket's offset, and a window partitioned
by bucket adds the running sum inside it.  The result is exact — the
quantiles only decide how work is split.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netvigil.operators.sizing import input_bytes
from netvigil.session import checkpoint_dir

BYTES_PER_BUCKET = 32 << 20  # of input files
ROWS_PER_BUCKET = 1_000_000  # distinct scores, where the input's bytes are not known
MAX_BUCKETS = 16384


def class_counts(y: str, n: str | None):
    """Aggregates ``pos, neg``: rows of each class, or the sums of a column of counts ``n``."""
    if n is None:
        return F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    return tuple(F.coalesce(F.sum(F.when(F.col(y) == c, F.col(n))), F.lit(0)).cast("long").alias(name)
                 for c, name in ((1, "pos"), (0, "neg")))


def score_counts(df: DataFrame, y: str = "y", score: str = "score", n: str | None = None) -> DataFrame:
    """score, pos, neg per distinct finite score (labels 0/1 only); with ``n`` every row of ``df`` stands for ``n`` rows."""
    s = F.col(score).cast("double")
    counts = df.filter(F.col(y).isin(0, 1)).groupBy(F.when(~F.isnan(s), s).alias("score")).agg(*class_counts(y, n))
    # rows without a score go after they are counted: a filter on the score alone would be moved below the model that
    # computes it, which would then run again for every mention of the score
    return counts.filter(F.when(F.col("pos") >= 0, F.col("score").isNotNull()).otherwise(False))


def bucket_count(df: DataFrame) -> int | None:
    """Buckets from the bytes of input below ``df`` (planner statistics, no job): one per
    ``BYTES_PER_BUCKET``, at most MAX_BUCKETS; None where those are not known."""
    n = input_bytes(df)
    return None if n is None else min(MAX_BUCKETS, max(1, math.ceil(n / BYTES_PER_BUCKET)))


def _sized(counts: DataFrame, df: DataFrame, buckets: int | None) -> tuple[DataFrame, int]:
    """The grouped scores and their buckets; without known input bytes they are written and counted."""
    buckets = buckets or bucket_count(df)
    if buckets is None:
        checkpoint_dir(counts.sparkSession)
        counts = counts.checkpoint(eager=True)
        buckets = min(MAX_BUCKETS, max(1, math.ceil(counts.count() / ROWS_PER_BUCKET)))
    return counts, buckets


def _bucketed(counts: DataFrame, buckets: int) -> DataFrame:
    """Attach bucket id ``b`` (higher score -> higher b)."""
    if buckets <= 1:
        return counts.withColumn("b", F.lit(0))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(counts.approxQuantile("score", probs, 1.0 / (4 * buckets))))
    if not cuts:
        return counts.withColumn("b", F.lit(0))
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf")] + cuts + [float("inf")]
    bz = Bucketizer(splits=splits, inputCol="score", outputCol="_bd", handleInvalid="keep")
    return bz.transform(counts).withColumn("b", F.col("_bd").cast("int")).drop("_bd")


def running_counts(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """Add, in descending score order: tps/fps (inclusive running sums),
    idx (0-based position), prev/next tps/fps (NULL at the ends),
    tot_pos/tot_neg, n_points and the bucket id ``b``.

    One bucket (small input): plain windows over the distinct scores.
    More buckets: the grouped table is written once to the checkpoint
    folder (read by the quantile job, the bucket totals and the windows),
    then the two-level scheme described in the module docstring."""
    counts, buckets = _sized(counts, counts, buckets)
    every = Window.partitionBy()
    if buckets <= 1:
        w = Window.orderBy(F.desc("score"))
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        j = (counts.withColumn("b", F.lit(0))
             .withColumn("tps", F.sum("pos").over(upto)).withColumn("fps", F.sum("neg").over(upto))
             .withColumn("idx", F.row_number().over(w) - 1)
             .withColumn("tot_pos", F.sum("pos").over(every))
             .withColumn("tot_neg", F.sum("neg").over(every))
             .withColumn("n_points", F.count(F.lit(1)).over(every)))
        return (j.withColumn("prev_tps", F.lag("tps").over(w)).withColumn("prev_fps", F.lag("fps").over(w))
                .withColumn("next_tps", F.lead("tps").over(w)).withColumn("next_fps", F.lead("fps").over(w)))
    checkpoint_dir(counts.sparkSession)
    c = _bucketed(counts.checkpoint(eager=True), buckets)
    tot = c.groupBy("b").agg(F.sum("pos").alias("bpos"), F.sum("neg").alias("bneg"),
                             F.count(F.lit(1)).alias("bn"),
                             F.max_by("pos", "score").alias("first_pos"),
                             F.max_by("neg", "score").alias("first_neg"))
    # at most MAX_BUCKETS rows: a single-partition window here is bounded
    wt = Window.orderBy(F.desc("b"))
    before = wt.rowsBetween(Window.unboundedPreceding, -1)
    tot = (tot.withColumn("off_pos", F.coalesce(F.sum("bpos").over(before), F.lit(0)))
           .withColumn("off_neg", F.coalesce(F.sum("bneg").over(before), F.lit(0)))
           .withColumn("off_idx", F.coalesce(F.sum("bn").over(before), F.lit(0)))
           .withColumn("tot_pos", F.sum("bpos").over(every))
           .withColumn("tot_neg", F.sum("bneg").over(every))
           .withColumn("n_points", F.sum("bn").over(every)))
    tot = (tot.withColumn("next_tps0", F.lead(F.col("off_pos") + F.col("first_pos")).over(wt))
           .withColumn("next_fps0", F.lead(F.col("off_neg") + F.col("first_neg")).over(wt))
           .select("b", "off_pos", "off_neg", "off_idx", "next_tps0", "next_fps0",
                   "tot_pos", "tot_neg", "n_points"))
    j = c.join(F.broadcast(tot), "b")
    w = Window.partitionBy("b").orderBy(F.desc("score"))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = (j.withColumn("tps", F.col("off_pos") + F.sum("pos").over(upto))
         .withColumn("fps", F.col("off_neg") + F.sum("neg").over(upto))
         .withColumn("idx", F.col("off_idx") + F.row_number().over(w) - 1))
    j = (j.withColumn("prev_tps", F.coalesce(F.lag("tps").over(w),
                                             F.when(F.col("idx") > 0, F.col("off_pos"))))
         .withColumn("prev_fps", F.coalesce(F.lag("fps").over(w),
                                            F.when(F.col("idx") > 0, F.col("off_neg"))))
         .withColumn("next_tps", F.coalesce(F.lead("tps").over(w), F.col("next_tps0")))
         .withColumn("next_fps", F.coalesce(F.lead("fps").over(w), F.col("next_fps0"))))
    return j.drop("next_tps0", "next_fps0")


def auc(df: DataFrame, y: str = "y", score: str = "score", buckets: int | None = None,
        n: str | None = None) -> DataFrame:
    """Exact ROC AUC with ties counted half; NULL when one class is
    absent.  One row: auc, n_pos, n_neg."""
    r = running_counts(*_sized(score_counts(df, y, score, n), df, buckets))
    dec = "decimal(38,0)"
    num = F.col("neg").cast(dec) * (2 * F.col("tps") - F.col("pos")).cast(dec)
    agg = r.agg(F.sum(num).alias("num2"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    den = 2 * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return agg.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                             F.col("num2").cast("double") / den).alias("auc"),
                      F.coalesce("n_pos", F.lit(0)).cast("long").alias("n_pos"),
                      F.coalesce("n_neg", F.lit(0)).cast("long").alias("n_neg"))


def score_summary(df: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5,
                  buckets: int | None = None) -> DataFrame:
    """AUC and the confusion counts at ``threshold`` from one grouped pass:
    auc, n_pos, n_neg, tn, fp, fn, tp (rows without a finite score are
    left out of both)."""
    r = running_counts(*_sized(score_counts(df, y, score), df, buckets))
    dec = "decimal(38,0)"
    num = F.col("neg").cast(dec) * (2 * F.col("tps") - F.col("pos")).cast(dec)
    above = F.col("score") >= F.lit(threshold)
    agg = r.agg(F.sum(num).alias("num2"), F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
                F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"))
    den = 2 * F.col("P").cast("double") * F.col("N").cast("double")
    P, N = F.coalesce("P", F.lit(0)).cast("long"), F.coalesce("N", F.lit(0)).cast("long")
    tp, fp = F.coalesce("tp", F.lit(0)).cast("long"), F.coalesce("fp", F.lit(0)).cast("long")
    return agg.select(F.when((F.col("P") > 0) & (F.col("N") > 0),
                             F.col("num2").cast("double") / den).alias("auc"),
                      P.alias("n_pos"), N.alias("n_neg"), (N - fp).alias("tn"), fp.alias("fp"),
                      (P - tp).alias("fn"), tp.alias("tp"))


def roc_curve(df: DataFrame, y: str = "y", score: str = "score", drop_intermediate: bool = True,
              buckets: int | None = None, n: str | None = None) -> DataFrame:
    """A10: ROC points (idx, threshold, fpr, tpr, fps, tps).

    Distinct scores in descending order; with ``drop_intermediate`` a
    point is kept when the second difference of fps or tps is non-zero
    (both ends always kept, and only when there are more than two
    points); then a leading (0, 0) point with NULL threshold is added.
    """
    counts, nb = _sized(score_counts(df, y, score, n), df, buckets)
    r = running_counts(counts, nb)
    last = F.col("n_points") - 1
    if drop_intermediate:
        curv = ((F.col("prev_fps") - 2 * F.col("fps") + F.col("next_fps")) != 0) | (
            (F.col("prev_tps") - 2 * F.col("tps") + F.col("next_tps")) != 0)
        keep = (F.col("n_points") <= 2) | (F.col("idx") == 0) | (F.col("idx") == last) | curv
        r = r.filter(keep)
    cols = ["threshold", "fps", "tps", "tot_pos", "tot_neg"]
    if nb <= 1:
        pts = (r.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("score"))))
               .withColumn("threshold", F.col("score")).select("idx", *cols))
    else:
        # renumber the kept points: per-bucket kept counts (bounded) + offsets
        kept = r.groupBy("b").agg(F.count(F.lit(1)).alias("kn"))
        wt = Window.orderBy(F.desc("b"))
        kept = kept.withColumn("koff", F.coalesce(
            F.sum("kn").over(wt.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        w = Window.partitionBy("b").orderBy(F.desc("score"))
        pts = (r.join(F.broadcast(kept.select("b", "koff")), "b")
               .withColumn("idx", F.col("koff") + F.row_number().over(w))
               .withColumn("threshold", F.col("score"))
               .select("idx", *cols))
    # the first point also emits the origin, so the curve is computed once
    point = F.struct(F.col("idx").cast("long").alias("idx"), F.col("threshold").cast("double").alias("threshold"),
                     F.col("fps").cast("long").alias("fps"), F.col("tps").cast("long").alias("tps"))
    zero = F.struct(F.lit(0).cast("long").alias("idx"), F.lit(None).cast("double").alias("threshold"),
                    F.lit(0).cast("long").alias("fps"), F.lit(0).cast("long").alias("tps"))
    allp = pts.select(F.explode(F.when(F.col("idx") == 1, F.array(zero, point)).otherwise(F.array(point)))
                      .alias("p"), "tot_pos", "tot_neg").select("p.*", "tot_pos", "tot_neg")
    return allp.select(
        F.col("idx").cast("long").alias("idx"), "threshold",
        F.when(F.col("tot_neg") > 0, F.col("fps") / F.col("tot_neg")).alias("fpr"),
        F.when(F.col("tot_pos") > 0, F.col("tps") / F.col("tot_pos")).alias("tpr"),
        F.col("fps").cast("long").alias("fps"), F.col("tps").cast("long").alias("tps"))


def thin_curve(roc: DataFrame, max_points: int = 500) -> DataFrame:
    """Keep finite points inside [0,1]; when more than ``max_points``
    remain keep every ceil(n/max_points)-th by position."""
    ok = (F.col("fpr").isNotNull() & F.col("tpr").isNotNull() & ~F.isnan("fpr") & ~F.isnan("tpr")
          & F.col("fpr").between(0, 1) & F.col("tpr").between(0, 1))
    pts = roc.filter(ok)
    n = pts.count()
    if n <= max_points:
        return pts
    step = -(-n // max_points)
    return pts.filter(F.col("idx") % step == 0)
