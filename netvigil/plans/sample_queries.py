"""Sampling, balancing and splitting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions.labels import normalize_label
from netvigil.operators import sampling
from netvigil.sources import fixtures

SEED = 42


def _events(spark, sf_dir) -> DataFrame:
    return fixtures.labelled_events(spark, sf_dir).select("event_id", "label")


def _flows(spark, sf_dir) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    return (f.select("flow_id", normalize_label("attack", "open").alias("label"))
            .filter(F.col("label").isNotNull()))


def balance_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 500 per class in md5 order (the sampling fixture)."""
    return sampling.balance_min(_events(spark, sf_dir), "label", ["event_id"], cap=500, seed=SEED)


def balance_min(spark, sf_dir):
    return sampling.balance_min(_flows(spark, sf_dir), "label", ["flow_id"], seed=SEED)


def balance_target(spark, sf_dir):
    return sampling.balance_target(_events(spark, sf_dir), "label", 3000, ["event_id"], seed=SEED)


def ratio_sample(spark, sf_dir):
    return sampling.ratio_sample(_flows(spark, sf_dir), "label", 10000, 0.3, ["flow_id"], seed=SEED)


def holdout(spark, sf_dir):
    """Holdout labels use the small nine-key map; the positive quota is
    truncated."""
    f = fixtures.flows(spark, sf_dir)
    small = (f.select("flow_id", normalize_label("attack", "small").alias("label"))
             .filter(F.col("label").isNotNull()))
    return sampling.ratio_sample(small, "label", 9999, 0.5, ["flow_id"], seed=SEED, rounding="floor")


def balance_to_class(spark, sf_dir):
    """Keep every row of the smaller class (errors) and sample the
    other class down to the same count."""
    return sampling.balance_to_class(_events(spark, sf_dir), "label", ["event_id"], keep_class=1,
                                     sample_class=0, seed=SEED)


def first_n_per_class(spark, sf_dir):
    return sampling.first_n_per_class(_events(spark, sf_dir), "label", 500, ["event_id"])


def split_exact(spark, sf_dir):
    return sampling.stratified_split(_events(spark, sf_dir), "label", 0.3, ["event_id"], seed=SEED,
                                     exact=True)


def split_hash(spark, sf_dir):
    return sampling.stratified_split(_events(spark, sf_dir), "label", 0.3, ["event_id"], seed=SEED)


def sample_frac(spark, sf_dir):
    return sampling.sample_fraction(_flows(spark, sf_dir), 0.05, ["flow_id"], seed=SEED)


def dedup_sample(spark, sf_dir):
    f = fixtures.flows(spark, sf_dir).select("saddr", "daddr", "proto", "state")
    return sampling.dedup_sample(f, 0.3, ["saddr", "daddr", "proto", "state"], seed=SEED)


QUERIES = {
    "balance_cap": balance_cap,
    "balance_min": balance_min,
    "balance_target": balance_target,
    "ratio_sample": ratio_sample,
    "holdout": holdout,
    "balance_to_class": balance_to_class,
    "first_n_per_class": first_n_per_class,
    "split_exact": split_exact,
    "split_hash": split_hash,
    "sample_frac": sample_frac,
    "dedup_sample": dedup_sample,
}
