"""Label, cleaning and scoring-measure queries over the fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions.labels import label_from_keywords, normalize_label
from netvigil.functions.numeric import to_numeric_text, zero_fill
from netvigil.operators import curves, metrics, threshold
from netvigil.plans import reports
from netvigil.sources import fixtures

THRESHOLD = 0.5


def labelled_flows(spark: SparkSession, sf_dir: str, profile: str = "open",
                   t: float = THRESHOLD) -> DataFrame:
    """Flows with y (label profile, unmappable rows dropped) and pred."""
    f = fixtures.flows(spark, sf_dir)
    return (f.withColumn("y", normalize_label("attack", profile)).filter(F.col("y").isNotNull())
            .withColumn("pred", reports.predicted(F.col("score"), t)))


def label_query(profile: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = fixtures.flows(spark, sf_dir)
        return (f.select("flow_id", normalize_label("attack", profile).alias("y"))
                .filter(F.col("y").isNotNull()))
    run.__name__ = f"label_{profile}"
    return run


def label_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixtures.connlog(spark, sf_dir)
    return c.select("uid", label_from_keywords("tunnel_parents").alias("attack"))


def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    num = to_numeric_text("attack")
    return f.select("flow_id", num.alias("attack_num"), zero_fill(num).alias("attack_filled"),
                    zero_fill(to_numeric_text("state")).alias("state_filled"))


def confusion(spark, sf_dir):
    return metrics.confusion(labelled_flows(spark, sf_dir), "y", "pred")


def binary_metrics(spark, sf_dir):
    """A6 + A9 from one grouped pass (confusion counts at the threshold and
    the AUC both come from the per-score counts)."""
    summary = curves.score_summary(labelled_flows(spark, sf_dir), "y", "score", THRESHOLD)
    return metrics.metrics_from_counts(summary, "auc")


def class_report(spark, sf_dir):
    return metrics.class_report(labelled_flows(spark, sf_dir), "y", "pred")


def confusion_pct(spark, sf_dir):
    return metrics.confusion_pct(labelled_flows(spark, sf_dir), "y", "pred", normalize="true")


def auc(spark, sf_dir):
    return curves.auc(labelled_flows(spark, sf_dir), "y", "score")


def roc_curve(spark, sf_dir):
    return curves.roc_curve(labelled_flows(spark, sf_dir), "y", "score")


def roc_thinned(spark, sf_dir):
    roc = curves.roc_curve(labelled_flows(spark, sf_dir), "y", "score", drop_intermediate=False)
    return curves.thin_curve(roc, 500)


def threshold_query(objective: str):
    def run(spark, sf_dir):
        return threshold.best_threshold(labelled_flows(spark, sf_dir), "y", "score", objective)
    run.__name__ = f"threshold_{objective}"
    return run


def minmax_score(spark, sf_dir):
    f = fixtures.flows(spark, sf_dir).select("flow_id", "score")
    return threshold.minmax_normalize(f, "score", "score_mm").select("flow_id", "score_mm")


def predict_summary(spark, sf_dir):
    """M9 summary: auto (Youden) threshold from the labelled rows and the
    totals at that threshold over every row, in one pass."""
    f = fixtures.flows(spark, sf_dir).withColumn("y", normalize_label("attack", "open"))
    return threshold.auto_summary(f, "y", "score", "youden")


def preview(spark, sf_dir):
    """O3: first 20 predictions and scores in flow order (top-k, no global sort)."""
    f = fixtures.flows(spark, sf_dir)
    return reports.preview(f, "score", THRESHOLD, ["ltime", "pkSeqID", "flow_id"],
                           keep=["flow_id"]).withColumnRenamed("prediction", "pred")


QUERIES = {
    "label_open": label_query("open"),
    "label_named": label_query("named"),
    "label_closed": label_query("closed"),
    "label_small": label_query("small"),
    "label_botnet": label_query("botnet"),
    "label_strict": label_query("strict"),
    "label_keyword": label_keyword,
    "clean_numeric": clean_numeric,
    "confusion": confusion,
    "metrics": binary_metrics,
    "class_report": class_report,
    "confusion_pct": confusion_pct,
    "auc": auc,
    "roc_curve": roc_curve,
    "roc_thinned": roc_thinned,
    "threshold_f1": threshold_query("f1"),
    "threshold_youden": threshold_query("youden"),
    "minmax_score": minmax_score,
    "predict_summary": predict_summary,
    "preview": preview,
}
