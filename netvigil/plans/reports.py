"""End-to-end report compositions (M9, M10) as DataFrames.

Each section of a report is its own small DataFrame (one row, four rows,
or a bounded curve), computed on the executors; ``write_report`` stores
them as JSON tables in a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.functions import vocab
from netvigil.functions.numeric import round_half_even
from netvigil.operators import curves, devices, metrics, threshold
from netvigil.session import scratch_path
from netvigil.sinks import reports as sinks


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    # both sides are single-row aggregates
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def predicted(score, t):
    """1 for a score of at least ``t``; 0 below, and for NULL and NaN (Spark sorts NaN above all)."""
    s = score.cast("double")
    return F.coalesce((s >= F.lit(t)) & ~F.isnan(s), F.lit(False)).cast("int")


def predict_report(scored: DataFrame, y: str | None = "y", score: str = "score",
                   threshold_value: float = vocab.THRESHOLD_DEFAULT,
                   auto_metric: str | None = None) -> DataFrame:
    """M9: summary (totals at the final threshold) plus, when labels are
    present, the metrics row (A6 + AUC).  With ``auto_metric`` the
    threshold is tuned first (A11) on the labelled rows."""
    t = threshold_value
    labelled = scored.filter(F.col(y).isin(0, 1)) if y else None
    if auto_metric and labelled is not None:
        t = threshold.best_threshold_value(labelled, y, score, auto_metric)
    hit = predicted(F.col(score), t) == 1
    summary = scored.agg(F.count(F.lit(1)).alias("total_records"),
                         F.count_if(hit).alias("anomalies_detected"),
                         F.count_if(~hit).alias("normal_records")).select(
        "*", F.lit(t).alias("threshold"), F.lit(True).alias("has_proba"))
    if labelled is None:
        return summary
    m = metrics.metrics_from_counts(curves.score_summary(labelled, y, score, t), "auc")
    return _one_row_join(summary, m)


def score_table(scored: DataFrame, y: str | None, score: str) -> DataFrame:
    """``y, score, n``: rows per label (0, 1, else NULL) and score (NaN as NULL), written once.

    Whatever computes the score (a model, usually) runs for this table only; every section of a
    report is derived from it.
    """
    label = F.when(F.col(y).isin(0, 1), F.col(y).cast("int")) if y else F.lit(None).cast("int")
    s = F.col(score).cast("double")
    counts = (scored.groupBy(label.alias("y"), F.when(~F.isnan(s), s).alias("score"))
              .agg(F.count(F.lit(1)).alias("n")))
    path = scratch_path(scored.sparkSession, "scores")
    counts.write.parquet(path)
    return scored.sparkSession.read.parquet(path)


def _totals(counts: DataFrame, t: float) -> DataFrame:
    """One row: totals of all rows and the confusion counts of the labelled ones, all by ``predicted``."""
    hit = predicted(F.col("score"), t)

    def rows(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")

    cells = {name: rows((F.col("y") == a) & (hit == p))
             for name, a, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))}
    return counts.agg(rows(F.lit(True)).alias("total_records"), rows(hit == 1).alias("anomalies_detected"),
                      rows(hit == 0).alias("normal_records"), *[v.alias(k) for k, v in cells.items()]).select(
        "*", F.lit(t).cast("double").alias("threshold"), F.lit(True).alias("has_proba"))


SUMMARY = ["total_records", "anomalies_detected", "normal_records", "threshold", "has_proba"]


def _tuned(counts: DataFrame, labelled: bool, t: float, auto_metric: str | None):
    """The threshold and, when it was tuned, the row that tells how."""
    if not auto_metric or not labelled:
        return t, None
    best = threshold.best_threshold(counts, "y", "score", auto_metric, n="n")
    return float(best.first()["threshold"]), best


def predict_full(scored: DataFrame, y: str | None = "y", score: str = "score",
                 threshold_value: float = vocab.THRESHOLD_DEFAULT, auto_metric: str | None = None) -> DataFrame:
    """M9 in one row, from one scored table: totals, threshold, confusion counts and their shares of each true
    class (4 digits), metrics, AUC and the number of ROC points.

    One rule throughout: a row is an anomaly when its score reaches the threshold, and normal
    otherwise, also without a score.  AUC and ROC rank the rows that have one.
    """
    counts = score_table(scored, y, score)
    t, _ = _tuned(counts, y is not None, threshold_value, auto_metric)
    totals = _totals(counts, t)
    if y is None:
        return totals.select(*SUMMARY)
    row = metrics.metrics_from_counts(totals, *SUMMARY, "tn", "fp", "fn", "tp")
    for name, part, a, b in (("tn", "tn", "tn", "fp"), ("fp", "fp", "tn", "fp"), ("fn", "fn", "fn", "tp"), ("tp", "tp", "fn", "tp")):
        of = F.col(a) + F.col(b)
        row = row.withColumn(f"{name}_share", round_half_even(F.col(part) / F.when(of == 0, 1).otherwise(of), 4))
    ranked = curves.auc(counts, "y", "score", n="n").select("auc")
    points = curves.roc_curve(counts, "y", "score", n="n").agg(F.count(F.lit(1)).alias("roc_points"))
    return _one_row_join(_one_row_join(row, ranked), points)


def predict_outputs(scored: DataFrame, y: str | None = "y", score: str = "score",
                    order_cols=None, threshold_value: float = vocab.THRESHOLD_DEFAULT,
                    auto_metric: str | None = None) -> dict:
    """Every section of the prediction report: summary, auto_threshold,
    metrics, confusion (matrix and share of each true row), roc (all
    points + auc) and preview (first 20 predictions and scores).  All but the preview
    come from one table of score counts (``score_table``), by the rule of ``predict_full``."""
    out = {}
    counts = score_table(scored, y, score)
    t, best = _tuned(counts, y is not None, threshold_value, auto_metric)
    if best is not None:
        out["auto_threshold"] = best
    totals = _totals(counts, t)
    out["summary"] = totals.select(*SUMMARY)
    if y is not None:
        rank = curves.auc(counts, "y", "score", n="n")
        out["metrics"] = _one_row_join(metrics.metrics_from_counts(totals), rank.select("auc"))
        out["confusion"] = sinks.confusion_report(metrics.confusion_rows(totals), normalize="true")
        out["roc"] = sinks.roc_report(curves.roc_curve(counts, "y", "score", n="n"), rank)
    out["preview"] = preview(scored, score, t, order_cols)
    return out


def preview(scored: DataFrame, score: str = "score", t: float = vocab.THRESHOLD_DEFAULT,
            order_cols=None, keep=()) -> DataFrame:
    """O3: the first 20 predictions and scores in ``order_cols`` order, beside the ``keep`` columns."""
    order = [c for c in (order_cols or []) if c in scored.columns]
    head = scored.orderBy(*order) if order else scored
    return head.limit(vocab.PREVIEW_ROWS).select(
        *keep, predicted(F.col(score), t).alias("prediction"), F.round(score, 6).alias("score"))


def device_outputs(scored: DataFrame, mode: str = "auto", vendors: DataFrame | None = None,
                   names: DataFrame | None = None, pred_col: str = "pred") -> dict:
    """The device table plus the address statistics and the grouping
    label (both / saddr / daddr)."""
    _, label = devices.resolve_roles(scored.columns, mode)
    return {
        "devices": devices.device_report(scored, mode, vendors=vendors, names=names,
                                         pred_col=pred_col),
        "dev_stats": devices.device_stats(scored),
        "dev_col": scored.sparkSession.range(1).select(F.lit(label).alias("dev_col")),
    }


def write_report(sections: dict, path: str) -> None:
    """Write every section as a JSON table under ``path/<section>``
    (NaN / infinity written as NULL)."""
    for name, df in sections.items():
        sinks.write_table(df, f"{path.rstrip('/')}/{name}", "json")


def evaluate_holdout(spark, parts_path: str, names, model_path: str, out_path: str,
                     rows: int = 300_000, pos_frac: float = 0.5, skip_files: int = 5,
                     glob: str = "data_*.csv", key_cols=None) -> dict:
    """Holdout evaluation: parts after the first ``skip_files`` (all when
    none are left), labels from the nine-key map, ``rows`` rows with a
    truncated positive quota filled file by file, scored with a saved model; writes metrics
    (JSON and CSV), the confusion matrix with shares of the total and the
    ROC report under ``out_path``.  Returns the report sections."""
    from netvigil.functions.labels import normalize_label
    from netvigil.operators import features, fill, models
    from netvigil.sources import csv_parts

    model, meta = models.load_model(model_path)
    label_col = meta.get("label_col", "attack")
    parts = csv_parts.read_parts(spark, parts_path, names, glob=glob, skip_files=skip_files, positions=True)
    labelled = parts.withColumn("y", normalize_label(label_col, "small")).filter(F.col("y").isNotNull())
    keys = list(key_cols or [c for c in names if c != label_col])
    hold = fill.ratio_sample_by_file(labelled, "y", rows, pos_frac, keys, rounding="floor").drop("_file_no", "_pos")
    other = [c for c in hold.columns if c not in meta["numeric_cols"]]
    x = features.align_features(hold, meta["numeric_cols"], strict_numeric=True, keep=other)
    scored = models.with_score(model, x)
    pred = scored.withColumn("_pred", predicted(F.col("score"), 0.5))
    sections = {
        "metrics": metrics.metrics_from_counts(curves.score_summary(scored, "y", "score", 0.5), "auc"),
        "confusion": sinks.confusion_report(metrics.confusion(pred, "y", "_pred"), normalize="all"),
        "roc": sinks.roc_report(curves.roc_curve(scored, "y", "score"), curves.auc(scored, "y", "score")),
    }
    write_report(sections, out_path)
    sinks.write_metrics(sections["metrics"], f"{out_path.rstrip('/')}/metrics_csv", fmt="csv")
    return sections
