"""Report writers and the MLlib path (rows-only checks, as for the driver)."""

import json
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from netvigil.functions.labels import normalize_label
from netvigil.operators import curves, metrics, models, sampling
from netvigil.plans import model_queries as mq
from netvigil.sinks import reports


def test_null_nonfinite_and_writers(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.5)], "i int, x double")
    clean = reports.null_nonfinite(df).orderBy("i").collect()
    assert [r["x"] for r in clean] == [None, None, 1.5]
    d = tempfile.mkdtemp(prefix="netvigil-out-")
    reports.write_metrics(df, f"{d}/m.json")
    back = [json.loads(line) for f in os.listdir(f"{d}/m.json") if f.endswith(".json")
            for line in open(f"{d}/m.json/{f}")]
    assert sorted(r.get("x") is None for r in back) == [False, True, True]
    reports.write_table(df, f"{d}/t.csv", "csv")
    assert spark.read.option("header", True).csv(f"{d}/t.csv").count() == 3


def test_confusion_and_roc_reports(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8), (1, 0.9)]
    df = spark.createDataFrame(rows, "y int, score double").withColumn(
        "pred", (F.col("score") >= 0.5).cast("int"))
    rep = reports.confusion_report(metrics.confusion(df, "y", "pred")).first()
    assert rep["labels"] == ["0", "1"]
    assert rep["matrix"] == [[2, 0], [1, 2]]
    assert rep["matrix_pct"] == [[0.4, 0.0], [0.2, 0.4]]
    roc = reports.roc_report(curves.roc_curve(df, "y", "score"), curves.auc(df, "y", "score")).orderBy(
        "idx").collect()
    assert roc[0]["fpr"] == 0.0 and roc[-1]["tpr"] == 1.0
    assert roc[0]["threshold"] is None
    assert all(math.isclose(r["auc"], 5 / 6) for r in roc)


def test_roc_report_keeps_every_point(spark):
    n = 2400  # alternating classes: no point lies on a line with its neighbours
    df = spark.range(n).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") / n).alias("score"))
    rep = reports.roc_report(curves.roc_curve(df, "y", "score"), curves.auc(df, "y", "score"))
    assert rep.count() == n + 1


def test_forest_scores_and_roundtrip(spark, sf_dir):
    s = mq.score_query("rf")(spark, sf_dir)
    stats = s.agg(F.min("score"), F.max("score"), F.count("*")).first()
    assert 0.0 <= stats[0] <= stats[1] <= 1.0 and stats[2] > 0
    back = mq.model_roundtrip(spark, sf_dir).first()
    assert back["rows_scored"] == stats[2] and back["rows_different"] == 0


def test_train_and_evaluate_and_report_sections(spark, sf_dir):
    from netvigil.plans.reports import predict_outputs, write_report
    from netvigil.plans.training import train_and_evaluate
    from netvigil.session import scratch_path
    from netvigil.operators import models
    from netvigil.sources import fixtures

    flows = fixtures.flows(spark, sf_dir)
    path = scratch_path(spark, "train")
    model, result, meta = train_and_evaluate(flows, "attack", ["flow_id"], profile="open",
                                             num_trees=5, max_depth=4, save_path=path)
    row = result.first()
    assert 0.0 <= row["accuracy"] <= 1.0 and row["support_0"] == row["support_1"] > 0
    assert meta["categorical_cols"] == ["proto", "state"]
    loaded, meta2 = models.load_model(path)
    assert meta2["feature_cols"] == meta["feature_cols"]
    from netvigil.functions.labels import normalize_label
    scored = models.with_score(loaded, flows).withColumn("y", normalize_label("attack", "open"))
    out = predict_outputs(scored, "y", "score", order_cols=["pkSeqID", "flow_id"], auto_metric="youden")
    assert set(out) == {"auto_threshold", "summary", "metrics", "confusion", "roc", "preview"}
    assert out["preview"].count() == 20
    assert out["summary"].first()["total_records"] == flows.count()
    write_report(out, scratch_path(spark, "report"))


def test_logistic_l2_and_encode_before_split(spark, sf_dir):
    from netvigil.operators import models
    from netvigil.plans.training import train_and_evaluate
    from netvigil.sources import fixtures

    flows = fixtures.flows(spark, sf_dir)
    model, result, _ = train_and_evaluate(flows, "attack", ["flow_id"], profile="open",
                                          algorithm="lr", max_iter=20, encode_before_split=True)
    lr = model.stages[-1]
    assert lr.getRegParam() > 0 and lr.getStandardization() is False
    assert 0.0 <= result.first()["auc"] <= 1.0
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, w double")
    assert models.l2_reg_param(df, "w") == 1.0 / 6.0


def test_train_target_balanced(spark, sf_dir):
    from netvigil.plans.training import train_target_balanced
    from netvigil.sources import fixtures

    flows = fixtures.flows(spark, sf_dir).drop("score")
    model, result, meta = train_target_balanced(flows, "attack", ["flow_id"], k=400,
                                                sample_frac=0.9, num_trees=5, max_depth=4)
    row = result.first()
    assert 0.0 <= row["accuracy"] <= 1.0 and row["support_0"] > 0 and row["support_1"] > 0
    assert set(meta["categorical_cols"]) == {"proto", "state", "category"}
    assert "pkSeqID" not in meta["feature_cols"] and "saddr" not in meta["feature_cols"]


def test_numeric_scaler_is_the_population_one(spark, tmp_path):
    """Mean 0 and population deviation 1 on the training rows, no variance gives 0; kept by a saved model."""
    import numpy as np

    from netvigil.operators import models

    rows = [(float(i), 5.0, i % 3, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "`id.p` double, flat double, cat int, label int").withColumnRenamed("id.p", "id_p")
    stage = models.numeric_scaler(df, ["id_p", "flat"])
    out = stage.transform(df).toPandas()
    x = np.arange(40.0)
    assert np.allclose(out["id_p__std"], (x - x.mean()) / x.std()) and (out["flat__std"] == 0).all()
    model = models.fit_pipeline(df, ["id_p", "flat"], ["cat"], "lr", scale=True, max_iter=5)
    models.save_model(model, {}, str(tmp_path / "m"))
    again, _ = models.load_model(str(tmp_path / "m"))
    one, two = (models.with_score(m, df).select("score").toPandas() for m in (model, again))
    assert (one == two).all().all()


def test_split_and_balanced_rows_are_made_once(spark):
    rows = [(f"id{i // 2 if i < 6 else i}", "tcp" if i % 3 else None, "F", i % 7, i * 10, i / 100.0, ["1", " Attack ", "Normal", "n/a", None][i % 5])
            for i in range(80)]
    flows = spark.createDataFrame(rows, "flow_id string, proto string, state string, pkts long, bytes long, score double, attack string")
    data, nums, cats = mq._split(flows)
    plan = data._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "Join" not in plan  # later passes read files: no hash, no label parsed again
    labelled = flows.withColumn("label", normalize_label("attack", "open")).filter(F.col("label").isin(0, 1))
    x, want_nums, want_cats = mq._cleaned(labelled, ["flow_id", "label"])
    want = sampling.stratified_split(x, "label", 0.3, ["flow_id"], seed=mq.SEED)
    assert (nums, cats, data.dtypes) == (want_nums, want_cats, want.dtypes)
    assert data.exceptAll(want).count() == want.exceptAll(data).count() == 0
    picked = sampling.balance_min(want.filter("split = 'train'"), "label", ["flow_id"], cap=mq.TRAIN_CAP, seed=mq.SEED)
    train = mq._training(data)
    assert train.exceptAll(picked).count() == picked.exceptAll(train).count() == 0


def test_models_are_fitted_together_and_are_the_same(spark, monkeypatch):
    import threading

    rows = [(f"id{i}", "tcp" if i % 3 else "udp", "F", i % 7, i * 10, (i * 37 % 100) / 100.0, ["1", "Normal"][i % 2])
            for i in range(120)]
    flows = spark.createDataFrame(rows, "flow_id string, proto string, state string, pkts long, bytes long, score double, attack string")
    monkeypatch.setitem(mq.FOREST, "num_trees", 4)
    data, nums, cats = mq._split(flows)
    train = mq._training(data)
    alone = {algo: mq.fitted(train, nums, cats, algo) for algo in ("rf", "lr", "mlp")}
    together, fitted, kept = threading.Barrier(3, timeout=60), mq.fitted, {}

    def waits(*args):
        together.wait()  # breaks unless all three run
        kept[args[3]] = fitted(*args)
        return kept[args[3]]
    monkeypatch.setattr(mq, "fitted", waits)
    monkeypatch.setattr(mq, "_prepared", lambda spark, sf_dir: (data, nums, cats))
    test = data.filter("split = 'test'")
    want = (test.count(), test.filter("label = 1").count(), test.count())
    assert [tuple(r) for r in mq.score_ranges(spark, "").collect()] == [(algo, *want) for algo in ("rf", "lr", "mlp")]
    for algo, model in kept.items():
        one, two = (models.with_score(m, test).select("flow_id", "score").orderBy("flow_id").collect() for m in (model, alone[algo]))
        assert [r.flow_id for r in one] == [r.flow_id for r in two]
        assert [r.score for r in one] == pytest.approx([r.score for r in two], rel=1e-9)


WHOLE_QUERIES = ["lr_score", "mlp_score", "rf_score", "predict_report", "score_ranges", "model_comparison", "model_checks"]


def test_forest_of_shares_is_one_whole_model(spark, monkeypatch, tmp_path):
    """Of many rows the trees are grown in shares, each with draws of its own; of few rows they are the trees of one fit."""
    rows = [(i, float(i % 17), (i * 37 % 100) / 100.0, "tcp" if i % 3 else "udp", float((i * 37 % 100) + i % 9 > 55), 1.0 + i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, proto string, label double, weight double")
    fit = lambda: models.fit_pipeline(df, ["a", "b"], ["proto"], "rf", weight_col="weight", num_trees=11, max_depth=4)
    whole = fit()
    monkeypatch.setattr(models, "TREES_A_FIT", 5)
    trees = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.stages[-1].trees]
    assert trees(fit()) == trees(whole)  # 400 rows are few
    monkeypatch.setattr(models, "ROWS_A_FIT", 399)
    made, plain = [], models.RandomForestClassifier.fit
    monkeypatch.setattr(models.RandomForestClassifier, "fit", lambda clf, *args: made.append(
        (clf.getNumTrees(), clf.getSeed(), clf.getFeatureSubsetStrategy())) or plain(clf, *args))
    model = fit()
    assert [n for n, _, _ in made] == [5, 5, 1] and len({s for _, s, _ in made}) == 3 and {f for _, _, f in made} == {"sqrt"}
    forest = model.stages[-1]
    assert forest.getNumTrees == 11 and forest.numFeatures == whole.stages[-1].numFeatures and forest.numClasses == 2
    assert len(set(trees(model))) == 11
    models.save_model(model, {}, str(tmp_path / "m"))
    again, _ = models.load_model(str(tmp_path / "m"))
    one, two, other = ([r.score for r in models.with_score(m, df).orderBy("id").select("score").collect()] for m in (model, again, whole))
    assert one == two and all(0 <= x <= 1 for x in one)
    assert sum((x >= 0.5) == (y >= 0.5) for x, y in zip(one, other)) > 360


def test_a_row_is_scored_once(spark):
    """No filter that repeats the model, which would run again for every mention of its score."""
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5 > 2).cast("int").alias("label"))
    scored = models.with_score(models.fit_pipeline(df, ["a"], [], "rf", num_trees=3, max_depth=3), df)
    for counted in (curves.score_counts(scored, "label", "score"), curves.score_summary(scored, "label", "score", 0.5),
                    curves.auc(scored, "label", "score")):
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Filter" in line and "UDF" in line]
        assert plan.count("UDF(UDF(features") <= 1
    rows = [(1, 0.5), (0, 0.5), (1, float("nan")), (0, None), (None, 0.5), (2, 0.25), (1, 0.75), (0, -0.0), (1, 0.0)]
    got = curves.score_counts(spark.createDataFrame(rows, "y int, score double")).orderBy("score").collect()
    assert [tuple(r) for r in got] == [(0.0, 1, 1), (0.5, 1, 1), (0.75, 1, 0)]


def _uneven_flows(spark):
    """Three attacks to one normal flow, some ids twice, some NULL, and rows without a usable label."""
    rows = [(f"id{i // 2 if i < 8 else i}" if i % 31 else None, "tcp" if i % 3 else None, "F", i % 7, i * 10, (i * 37 % 100) / 100.0,
             ["1", " Attack ", "Normal", "1.0", "n/a"][i % 5]) for i in range(150)]
    return spark.createDataFrame(rows, "flow_id string, proto string, state string, pkts long, bytes long, score double, attack string")


@pytest.mark.parametrize("query", WHOLE_QUERIES)
def test_models_learn_from_every_training_row(spark, monkeypatch, query):
    data, nums, cats = mq._split(_uneven_flows(spark))
    want = data.filter("split = 'train' AND label IN (0, 1)")
    n0, n1 = (want.filter(f"label = {c}").count() for c in (0, 1))
    assert n1 > 2 * n0 > 0
    given, plain = [], mq.models.fit_pipeline

    def fit(train, num_cols, cat_cols, algorithm, *args, **params):
        given.append((algorithm, train, params.get("weight_col")))
        return plain(train, num_cols, cat_cols, "lr", *args, max_iter=2)
    monkeypatch.setattr(mq.models, "fit_pipeline", fit)
    monkeypatch.setattr(mq, "_prepared", lambda spark, sf_dir: (data, nums, cats))
    mq.QUERIES[query](spark, "")
    algos = {query[:-len("_score")]} if query.endswith("_score") else {"rf"} if query == "predict_report" else {"rf", "lr", "mlp"}
    assert {a for a, _, _ in given} == algos and len(given) == len(algos)
    for algorithm, train, weight in given:
        assert sorted(map(str, train.select(want.columns).collect())) == sorted(map(str, want.collect()))
        assert weight == (None if algorithm == "mlp" else "weight")
        if weight:  # the classes weigh the same though their sizes differ
            w = {r.label: r.w for r in train.groupBy("label").agg(F.sum(weight).alias("w")).collect()}
            assert w[0] == pytest.approx(w[1]) == pytest.approx((n0 + n1) / 2)


def test_whole_classes_are_not_cut_and_an_empty_one_is_an_error(spark):
    df = spark.range(50).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    assert sorted(r.id for r in sampling.balance_min(df, "y", ["id"], cap=sampling.WHOLE).collect()) == [*range(50)]
    assert sampling.balance_min(df, "y", ["id"]).count() == 20
    with pytest.raises(ValueError, match="one class is empty: class0=40, class1=0"):
        sampling.balance_min(df.filter("y = 0"), "y", ["id"], cap=sampling.WHOLE)
