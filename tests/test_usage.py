"""The README usage example, run end to end on CSV parts written from the fixtures."""

from pyspark.sql import functions as F

from netvigil.session import scratch_path
from netvigil.sources import csv_parts, fixtures


def test_readme_example(spark, sf_dir):
    base = scratch_path(spark, "usage")
    cols = ["pkSeqID", "saddr", "daddr", "smac", "dmac", "proto", "state", "pkts", "bytes", "ltime",
            "category", "attack"]
    src = fixtures.flows(spark, sf_dir).select(*[F.col(c).cast("string") for c in cols])
    csv_parts.write_parts(src, f"{base}/parts", parts=3, header=False)
    spark.createDataFrame([tuple(cols)], ", ".join(f"c{i} string" for i in range(len(cols)))) \
        .write.csv(f"{base}/names")

    # --- README example --------------------------------------------------
    from netvigil.functions import normalize_label
    from netvigil.operators import devices, features, models
    from netvigil.plans.reports import predict_outputs, write_report
    from netvigil.plans.training import train_and_evaluate
    from netvigil.sources import lookups

    names = csv_parts.load_columns(spark, f"{base}/names")
    flows = csv_parts.read_parts(spark, f"{base}/parts", names, glob="part-*.csv")

    model, metrics_row, meta = train_and_evaluate(flows, "attack", ["pkSeqID", "saddr"],
                                                  profile="named", num_trees=10, max_depth=6,
                                                  save_path=f"{base}/model")
    model, meta = models.load_model(f"{base}/model")
    other = [c for c in flows.columns if c not in meta["numeric_cols"]]
    x = features.align_features(flows, meta["numeric_cols"], strict_numeric=True, keep=other)
    scored = models.with_score(model, x).withColumn("y", normalize_label("attack", "named"))
    report = predict_outputs(scored, "y", "score", order_cols=["ltime", "pkSeqID"],
                             auto_metric="youden")
    write_report(report, f"{base}/report")
    table = devices.device_report(scored.withColumn("pred", (F.col("score") >= 0.5).cast("int")),
                                  "both", vendors=lookups.vendor_table(spark))
    page = devices.device_page(table, sort="anomalies_desc", page=1, size=25)
    # ----------------------------------------------------------------------

    assert 0 <= metrics_row.first()["accuracy"] <= 1
    assert report["summary"].first()["total_records"] == src.count()
    assert page.count() == 25 and page.first()["row_no"] == 1


def test_evaluate_holdout(spark, sf_dir):
    from netvigil.plans.reports import evaluate_holdout
    from netvigil.plans.training import train_and_evaluate

    base = scratch_path(spark, "holdout")
    cols = ["pkSeqID", "flow_id", "proto", "state", "pkts", "bytes", "attack"]
    src = fixtures.flows(spark, sf_dir).select(*[F.col(c).cast("string") for c in cols])
    csv_parts.write_parts(src, f"{base}/parts", parts=7, header=True)
    flows = csv_parts.read_parts(spark, f"{base}/parts", cols, glob="part-*.csv")
    train_and_evaluate(flows, "attack", ["flow_id"], profile="open", num_trees=5, max_depth=4,
                       save_path=f"{base}/model")
    out = evaluate_holdout(spark, f"{base}/parts", cols, f"{base}/model", f"{base}/report",
                           rows=400, pos_frac=0.5, skip_files=5, glob="part-*.csv",
                           key_cols=["flow_id"])
    m = out["metrics"].first()
    assert m["support_0"] + m["support_1"] <= 400 and m["support_1"] <= 200
    assert spark.read.option("header", True).csv(f"{base}/report/metrics_csv").count() == 1
    assert len(out["confusion"].first()["matrix_pct"]) == 2


def test_dataset_flows(spark, sf_dir):
    from netvigil.plans import datasets

    base = scratch_path(spark, "datasets")
    cols = ["pkSeqID", "flow_id", "proto", "pkts", "attack"]
    src = fixtures.flows(spark, sf_dir).select(*[F.col(c).cast("string") for c in cols])
    csv_parts.write_parts(src, f"{base}/parts", parts=3, header=False)
    test_file = datasets.balanced_test_file(spark, f"{base}/parts", cols, f"{base}/test.csv",
                                            rows=300, pos_frac=0.3, glob="part-*.csv",
                                            key_cols=["flow_id"])
    back = spark.read.option("header", True).csv(f"{base}/test.csv")
    assert back.count() == 300 == test_file.count()
    first = datasets.first_n_sample_file(spark, f"{base}/parts", cols, f"{base}/first.csv",
                                         per_class=50, order_cols=("pkSeqID", "flow_id"),
                                         glob="part-*.csv")
    per = {r[0]: r[1] for r in first.groupBy("label").count().collect()}
    assert per == {0: 50, 1: 50} and "attack" not in first.columns
    # the test file holds the smallest hashes under seed 42: sample it with another seed
    frac = datasets.fraction_to_parquet(spark, f"{base}/test.csv", f"{base}/frac.parquet", 0.5,
                                        key_cols=["flow_id"], seed=7)
    assert 0 < spark.read.parquet(f"{base}/frac.parquet").count() == frac.count() < 300
