"""Rules that the plain fixtures do not reach: label texts that tell the profiles apart, ties and
missing order values, scores outside [0, 1], text columns, ragged CSV rows, report round trips."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions.labels import normalize_label
from netvigil.operators import combine, curves, features, metrics, models, sampling, threshold
from netvigil.operators import devices as dv
from netvigil.plans import datasets, file_queries, reports
from netvigil.plans.score_queries import labelled_flows
from netvigil.session import scratch_path
from netvigil.sinks import reports as sinks
from netvigil.sources import csv_parts, fixtures, mixed

LABEL_TEXTS = ["ddos", "botnet", "yes", "no", "2", "-1", "0.5", "inf", "", " Normal", "BENIGN", "n/a",
               None, "Attack", "1.0", "scan", "true", "0", "Theft "]
CSV_NAMES = ["doc_id", "lang", "source"]


def label_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1-L6 side by side; ``strict`` raises on a label that is no whole number, so it sees none."""
    parts = fixtures.table(spark, sf_dir, "part", key="p_partkey").select("p_partkey")
    texts = F.array(*[F.lit(t).cast("string") for t in LABEL_TEXTS])
    p = parts.withColumn("text", texts[(F.col("p_partkey") % len(LABEL_TEXTS)).cast("int")])
    whole = F.when(~F.col("text").isin("0.5", "inf"), F.col("text"))
    return p.select("p_partkey", *[normalize_label("text", x).alias(x)
                                   for x in ("closed", "open", "named", "botnet", "small")],
                    normalize_label(whole, "strict").alias("strict"))


def first_n_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 where far more rows share the order value than one ranking step takes."""
    ev = fixtures.labelled_events(spark, sf_dir).select(
        "event_id", "label", (F.col("event_id") % 10).alias("bucket"))
    return sampling.first_n_per_class(ev, "label", 500, ["bucket", "event_id"], max_boundary=50)


def first_n_null_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 where three rows of five have no order value."""
    ev = fixtures.labelled_events(spark, sf_dir).select(
        "event_id", "label", F.when(F.col("event_id") % 5 >= 3, F.col("event_id")).alias("ord"))
    return sampling.first_n_per_class(ev, "label", 1500, ["ord", "event_id"])


def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 300 events."""
    ev = fixtures.labelled_events(spark, sf_dir).select("event_id", "label")
    return sampling.sample_n(ev, 300, ["event_id"], seed=42)


def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled flows, some with scores that are infinite, huge, negative, NULL or NaN."""
    f = labelled_flows(spark, sf_dir)
    k = F.col("pkSeqID") % 50
    return f.withColumn("score", F.when(k == 0, F.lit(float("inf"))).when(k == 1, F.lit(3e7))
                        .when(k == 2, F.lit(-2.0)).when(k == 3, F.lit(None).cast("double"))
                        .when(k == 4, F.lit(float("nan"))).otherwise(F.col("score")))


def threshold_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold.best_threshold(edge_scores(spark, sf_dir), "y", "score", "youden")


def threshold_one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No candidate beats -1 when every row is normal and scored 1: the default threshold."""
    f = labelled_flows(spark, sf_dir).filter("y = 0").withColumn("score", F.lit(1.0))
    return threshold.best_threshold(f, "y", "score", "youden")


def predict_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 totals at 0.5: a score that is NULL or NaN counts as normal."""
    return reports.predict_report(edge_scores(spark, sf_dir), None, "score")


def predict_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9 in one row with a tuned threshold, scores missing among the rows."""
    return reports.predict_full(edge_scores(spark, sf_dir), "y", "score", auto_metric="youden")


def predict_summary_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 in one pass: the same totals as ``predict_full``, rows without a score are normal."""
    return threshold.auto_summary(edge_scores(spark, sf_dir), "y", "score", "youden")


def device_rollup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 over flows whose columns are all text, as read from CSV; P13 drops blank and 'nan'."""
    f = labelled_flows(spark, sf_dir)
    k = F.col("pkSeqID") % 97
    f = f.select(F.when(k == 0, "  ").when(k == 1, "nan").otherwise(F.col("saddr")).alias("saddr"), "daddr",
                 (F.col("pkSeqID") % 5000).cast("string").alias("ltime"), F.col("pkts").cast("string").alias("pkts"),
                 F.col("bytes").cast("string").alias("bytes"), "category", "pred")
    roll = dv.device_rollup(dv.explode_roles(f, "both"))
    return roll.select("device", "total", "anomalies", "status", F.col("pkts").cast("bigint").alias("pkts"),
                       F.col("bytes").cast("bigint").alias("bytes"), "last_seen")


def roc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the whole curve, written and read back."""
    f = labelled_flows(spark, sf_dir)
    path = scratch_path(spark, "roc")
    sinks.write_table(sinks.roc_report(curves.roc_curve(f, "y", "score"), curves.auc(f, "y", "score")), path)
    return spark.read.parquet(path)


def metrics_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3/K4: the metrics row written as JSON and as CSV, read back, with the format's name."""
    summary = curves.score_summary(labelled_flows(spark, sf_dir), "y", "score", 0.5)
    row = metrics.metrics_from_counts(summary, "auc")
    path = scratch_path(spark, "metrics")
    for fmt in ("json", "csv"):
        sinks.write_metrics(row, f"{path}/{fmt}", fmt)
    read = spark.read.schema(row.schema)
    back = {"json": read.json(f"{path}/json"), "csv": read.option("header", True).csv(f"{path}/csv")}
    json, csv = (df.select(F.lit(fmt).alias("fmt"), "*") for fmt, df in back.items())
    return json.unionByName(csv)


def json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: a nested report with NaN and infinite numbers at every depth, written as JSON and read back."""
    f = labelled_flows(spark, sf_dir)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    top = F.max("score")
    report = f.groupBy("proto").agg(
        F.struct(top.alias("top"), nan.alias("gap"), F.struct((-inf).alias("low"), F.count("*").alias("n")).alias("inner")).alias("s"),
        F.array(top, inf, nan, F.min("score")).alias("a"),
        F.array(F.struct(top.alias("x")), F.struct(nan.alias("x"))).alias("rows"),
        F.create_map(F.lit("top"), top, F.lit("gap"), nan).alias("m"), F.max("bytes").cast("float").alias("f"))
    path = scratch_path(spark, "nested")
    sinks.write_table(report, path, "json")
    back = spark.read.schema(report.schema).json(path)
    return back.select("proto", "s.top", "s.gap", "s.inner.low", F.col("s.inner.n").alias("n"), F.col("a")[0].alias("a0"),
                       F.col("a")[1].alias("a1"), F.col("a")[2].alias("a2"), F.col("a")[3].alias("a3"), F.size("a").alias("a_size"),
                       F.col("rows")[0].x.alias("x0"), F.col("rows")[1].x.alias("x1"), F.try_element_at("m", F.lit("top")).alias("m_top"),
                       F.try_element_at("m", F.lit("gap")).alias("m_gap"), F.col("f").cast("double").alias("f"))


def confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: matrix and shares of the total, written as JSON and read back."""
    f = labelled_flows(spark, sf_dir)
    report = sinks.confusion_report(metrics.confusion(f, "y", "pred"), normalize="all")
    path = scratch_path(spark, "confusion")
    sinks.write_json_row(report, path)
    back = spark.read.schema(report.schema).json(path)
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    return back.select(F.array_join("labels", ",").alias("labels"), *[F.col("matrix")[a][p].alias(f"n{a}{p}") for a, p in cells],
                       *[F.col("matrix_pct")[a][p].alias(f"p{a}{p}") for a, p in cells])


def align_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's columns in its order, absent ones 0, others dropped, present ones (also text) as they are."""
    f = fixtures.flows(spark, sf_dir)
    return features.align_features(f, ["score", "proto", "spkts", "category", "pkts"], keep=["flow_id"])


def typed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns typed by their values, then told apart as numeric (with their types) and categorical."""
    f = fixtures.flows(spark, sf_dir)
    text = f.select("flow_id", "proto", F.col("pkts").cast("string").alias("pkts"), F.col("score").cast("string").alias("score"),
                    F.when(F.col("pkts") > 25, F.col("bytes")).cast("string").alias("some"), F.col("score").alias("ratio"), "category")
    typed = features.downcast(text, keep=["flow_id"])
    nums, cats = features.numeric_and_categorical(typed, keep=["flow_id"])
    kinds = ",".join(f"{c}:{typed.schema[c].dataType.simpleString()}" for c in nums)
    return typed.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pkts").cast("long")).alias("pkts"), F.count("some").alias("some")).select(
        "*", F.lit(kinds).alias("numeric"), F.lit(",".join(cats)).alias("categorical"))


def encode_whole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 beside M1: width of the feature vector when the encoder sees the whole table or the training rows only, and how many
    rows of a value that is not among those have no mark."""
    f = fixtures.flows(spark, sf_dir).select("proto", F.col("pkts").cast("double").alias("pkts"))
    train = f.filter("proto <> 'arp'")
    row = None
    for name, on in (("whole", f), ("train", train)):
        x = Pipeline(stages=models.feature_stages(["pkts"], ["proto"])).fit(on).transform(f)
        v = vector_to_array("features")
        one = x.agg(F.max(F.size(v)).cast("long").alias(f"{name}_width"),
                    F.count_if(F.aggregate(F.slice(v, 2, 100), F.lit(0.0), lambda a, b: a + b) == 0).alias(f"{name}_unmarked"))
        row = one if row is None else row.crossJoin(one)  # two single rows
    return row


def first_n_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 400 rows per class of the part files, one integer label, stale label columns gone, as
    shuffled CSV files read back."""
    names = ["flow_id", "attack", "category", "pkts"]
    path = scratch_path(spark, "first")
    parts = file_queries.written_parts(spark, sf_dir, names)
    datasets.first_n_sample_file(spark, parts, names, path, per_class=400, glob="part-*.csv")
    rows, _ = mixed.read_mixed(spark, path, "part-*.csv", candidates=["label"])
    return rows.select("flow_id", F.col("pkts").cast("bigint").alias("pkts"), F.col("label").cast("int").alias("label"),
                       F.lit(",".join(c for c in rows.columns if c != "label_raw")).alias("columns"))


def balanced_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The balanced test file, filled file by file, written and read back."""
    names = ["flow_id", "attack"]
    path = scratch_path(spark, "balanced")
    parts = file_queries.written_parts(spark, sf_dir, names, ordered=False)
    datasets.balanced_test_file(spark, parts, names, path, rows=1_000, pos_frac=0.25, glob="part-*.csv")
    rows, _ = mixed.read_mixed(spark, path, "part-*.csv")
    return rows.select("flow_id", "attack")


def union_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with different label columns; one without any is left out."""
    sources = [fixtures.flows(spark, sf_dir).select("flow_id", "attack"),
               fixtures.labelled_events(spark, sf_dir).select("event_id", "label"),
               fixtures.table(spark, sf_dir, "part").select("p_partkey")]
    return combine.union_labelled(sources).select("flow_id", "event_id", "label_raw")


def csv_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short rows are padded, rows with too many fields dropped (the last may be empty), quoted commas and
    doubled quotes kept."""
    d = fixtures.table(spark, sf_dir, "documents", key="doc_id").select("doc_id", "lang", "source")
    k = F.col("doc_id")
    line = (F.when(k % 7 == 0, F.concat_ws(",", "doc_id", "lang"))
            .when(k % 11 == 0, F.concat_ws(",", "doc_id", "lang", "source", F.lit("more")))
            .when(k % 13 == 0, F.concat_ws(",", "doc_id", "lang", "source", F.lit("")))
            .when(k % 17 == 0, F.concat(k.cast("string"), F.lit(',"say ""'), F.col("lang"), F.lit('"", ok",'), F.col("source")))
            .when(k % 5 == 0, F.concat(k.cast("string"), F.lit(',"a,'), F.col("lang"), F.lit('",'), F.col("source")))
            .otherwise(F.concat_ws(",", "doc_id", "lang", "source")))
    path = scratch_path(spark, "ragged")
    d.select(line.alias("value")).write.text(path)
    back = csv_parts.read_csv_with_header(spark, path, CSV_NAMES)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source")


QUERIES = {
    "label_profiles": label_profiles,
    "first_n_ties": first_n_ties,
    "first_n_null_order": first_n_null_order,
    "sample_n": sample_n,
    "threshold_edge": threshold_edge,
    "threshold_one_class": threshold_one_class,
    "predict_edge": predict_edge,
    "predict_full": predict_full,
    "predict_summary_edge": predict_summary_edge,
    "device_rollup_text": device_rollup_text,
    "roc_report": roc_report,
    "metrics_roundtrip": metrics_roundtrip,
    "json_safe": json_safe,
    "confusion_report": confusion_report,
    "align_loose": align_loose,
    "typed_features": typed_features,
    "encode_whole_table": encode_whole_table,
    "first_n_file": first_n_file,
    "balanced_file": balanced_file,
    "union_labelled": union_labelled,
    "csv_tolerant": csv_tolerant,
}
