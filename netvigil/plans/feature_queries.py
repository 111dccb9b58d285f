"""Feature preparation and profiling queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions import vocab
from netvigil.functions.labels import normalize_label
from netvigil.operators import features as ft
from netvigil.operators import profile as pf
from netvigil.sources import fixtures

FLOW_FEATURES = ["pkts", "bytes", "dur", "proto", "score"]
CONN_FEATURES = ["id_orig_p", "duration", "orig_bytes", "conn_state", "resp_bytes"]


def clean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    x, _, _ = ft.clean_features(f, "attack", vocab.DROP_BALANCED, vocab.CATEGORICAL_BALANCED,
                                keep=["flow_id"])
    return x


def prepare_numeric(spark, sf_dir):
    f = fixtures.flows(spark, sf_dir).drop("ltime")
    x, _ = ft.prepare_numeric(f, "attack", vocab.DROP_PREPROCESS, keep=["flow_id"])
    return x


def downcast(spark, sf_dir):
    f = fixtures.flows(spark, sf_dir).select("flow_id", "attack", "category", "pkts", "score")
    return ft.downcast(f, keep=["flow_id"])


def align_features(spark, sf_dir):
    f = fixtures.flows(spark, sf_dir)
    return ft.align_features(f, FLOW_FEATURES, strict_numeric=True, keep=["flow_id"])


def align_connlog(spark, sf_dir):
    c = fixtures.connlog(spark, sf_dir)
    return ft.align_features(c, CONN_FEATURES, strict_numeric=True, keep=["uid"])


def standardise(spark, sf_dir):
    ev = fixtures.labelled_events(spark, sf_dir).select("event_id", "value", "user_id")
    z = ft.standardize(ev, ["value", "user_id"], suffix="_z")
    return z.select("event_id", F.round("value_z", 6).alias("value_z"),
                    F.round("user_id_z", 6).alias("user_id_z"))


def class_weights(spark, sf_dir):
    f = fixtures.flows(spark, sf_dir)
    y = f.select(normalize_label("attack", "open").alias("label")).filter("label IS NOT NULL")
    return ft.with_class_weight(y, "label").groupBy("label", "weight").agg(F.count(F.lit(1)).alias("n"))


def null_profile(spark, sf_dir):
    return pf.null_profile(fixtures.flows(spark, sf_dir), 10)


def value_counts(spark, sf_dir):
    return pf.value_counts(fixtures.flows(spark, sf_dir), "category", 30)


def column_summary(spark, sf_dir):
    return pf.column_summary(fixtures.flows(spark, sf_dir))


def connlog_clean(spark, sf_dir):
    """Conn-log preprocessing chain over the conn-log fixture."""
    return ft.preprocess_connlog(fixtures.connlog(spark, sf_dir))


QUERIES = {
    "clean_features": clean_features,
    "prepare_numeric": prepare_numeric,
    "downcast": downcast,
    "align_features": align_features,
    "align_connlog": align_connlog,
    "standardise": standardise,
    "class_weights": class_weights,
    "null_profile": null_profile,
    "value_counts": value_counts,
    "column_summary": column_summary,
    "connlog_clean": connlog_clean,
}
