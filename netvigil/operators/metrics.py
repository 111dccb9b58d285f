"""Binary classification measures from (label, prediction) columns.

Everything is one aggregate pass producing four counts; the rest is
arithmetic on a one-row DataFrame.  Labels other than 0/1 are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.functions.numeric import round_half_even, safe_ratio


def _binary(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.filter(F.col(y).isin(0, 1))


def confusion_counts(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: tn, fp, fn, tp (labels forced to [0, 1])."""
    yy, pp = F.col(y), F.col(pred)
    return _binary(df, y, pred).agg(
        F.count_if((yy == 0) & (pp != 1)).alias("tn"),
        F.count_if((yy == 0) & (pp == 1)).alias("fp"),
        F.count_if((yy == 1) & (pp != 1)).alias("fn"),
        F.count_if((yy == 1) & (pp == 1)).alias("tp"))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """A5 as a long table: actual, predicted, n (always four rows)."""
    return confusion_rows(confusion_counts(df, y, pred))


def confusion_rows(c: DataFrame) -> DataFrame:
    """A (tn, fp, fn, tp) row as the long table of ``confusion``."""
    return c.select(F.explode(F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")),
    )).alias("c")).select("c.*")


def metrics_from_counts(c: DataFrame, *extra: str) -> DataFrame:
    """A6 on a (tn, fp, fn, tp) row: accuracy, precision, recall_tpr, f1,
    fpr, tnr_specificity, mse, support_0, support_1 (zero division -> 0);
    ``extra`` columns of the row are passed through."""
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return c.select(*extra,
        safe_ratio(tp + tn, n).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall_tpr"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        safe_ratio(fp, fp + tn).alias("fpr"),
        safe_ratio(tn, tn + fp).alias("tnr_specificity"),
        safe_ratio(fp + fn, n).alias("mse"),
        (tn + fp).alias("support_0"),
        (fn + tp).alias("support_1"),
    )


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return metrics_from_counts(confusion_counts(df, y, pred))


def class_report(df: DataFrame, y: str = "y", pred: str = "pred",
                 digits: int | None = None) -> DataFrame:
    """Per-class precision/recall/f1/support plus accuracy, macro and
    weighted averages.  Rows: '0', '1', 'accuracy', 'macro avg', 'weighted avg'."""
    c = confusion_counts(df, y, pred)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    per = c.select(
        safe_ratio(tn, tn + fn).alias("p0"), safe_ratio(tn, tn + fp).alias("r0"),
        safe_ratio(2 * tn, 2 * tn + fp + fn).alias("f0"), (tn + fp).alias("s0"),
        safe_ratio(tp, tp + fp).alias("p1"), safe_ratio(tp, tp + fn).alias("r1"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("s1"),
        safe_ratio(tp + tn, tn + fp + fn + tp).alias("acc"))
    s0, s1 = F.col("s0"), F.col("s1")
    tot = s0 + s1

    def wavg(a, b):
        return safe_ratio(F.col(a) * s0 + F.col(b) * s1, tot)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.cast("long").alias("support"))

    none = F.lit(None).cast("double")
    out = per.select(F.explode(F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), s0),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), s1),
        row("accuracy", none, none, F.col("acc"), tot),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2,
            (F.col("f0") + F.col("f1")) / 2, tot),
        row("weighted avg", wavg("p0", "p1"), wavg("r0", "r1"), wavg("f0", "f1"), tot),
    )).alias("r")).select("r.*")
    if digits is not None:
        for k in ("precision", "recall", "f1_score"):
            out = out.withColumn(k, round_half_even(k, digits))
    return out


def confusion_pct(df: DataFrame, y: str = "y", pred: str = "pred",
                  normalize: str = "true", digits: int = 4) -> DataFrame:
    """Confusion shares, rounded.  normalize='true' divides by the row
    (actual class) total (an empty row divides by 1); 'all' by the grand total."""
    conf = confusion(df, y, pred)
    if normalize == "all":
        from pyspark.sql import Window
        # four rows only: a bounded window
        denom = F.sum("n").over(Window.partitionBy())
    elif normalize == "true":
        from pyspark.sql import Window
        denom = F.sum("n").over(Window.partitionBy("actual"))
    else:
        raise ValueError("normalize must be 'true' or 'all'")
    d = F.when(denom == 0, F.lit(1)).otherwise(denom)
    return conf.withColumn("pct", round_half_even(F.col("n").cast("double") / d, digits))
