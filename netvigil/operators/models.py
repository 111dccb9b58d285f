"""MLlib pipelines: encode, assemble, train, score, save/load (M1-M8, K7).

Training and scoring run on the executors (MLlib); only model parameters
and the small metadata row live on the driver.
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions import vocab

ALGORITHMS = ("rf", "lr", "mlp")
TREES_A_FIT = 25  # statistics of more trees leave a core's cache, and their draws take four bytes a row and tree beside the rows
ROWS_A_FIT = 100_000  # training rows up to which a forest is fitted at once


def _depth(max_depth: int) -> int:
    """Depth of a forest; Spark's trees end at 30."""
    if max_depth > 30:
        raise ValueError(f"max_depth is {max_depth}; Spark's trees have at most 30 levels")
    return max_depth


def numeric_scaler(train: DataFrame, num_cols) -> SQLTransformer:
    """M3 as a stage: ``(x - mean) / population std`` of each numeric column into ``<column>__std``; no variance gives 0.

    Fitted by one aggregate over ``train``; the numbers are literals in the stage, so they are saved with it.
    """
    row = train.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(num_cols)
                      for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [f"(CAST(`{c}` AS DOUBLE) - {row[f'm{i}'] or 0.0!r}D) / {row[f's{i}'] or 1.0!r}D AS `{c}__std`"
              for i, c in enumerate(num_cols)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__")


def feature_stages(num_cols, cat_cols, scaler: SQLTransformer | None = None):
    """M1/M4 (+M3): index and one-hot the categoricals (an unseen value maps
    to the dropped last slot, i.e. the all-zero vector), assemble with the
    numeric columns, as they are or as the fitted ``scaler`` makes them."""
    stages = [scaler] if scaler is not None else []
    ohe_out = []
    if cat_cols:
        idx = [f"{c}__idx" for c in cat_cols]
        ohe_out = [f"{c}__ohe" for c in cat_cols]
        stages.append(StringIndexer(inputCols=list(cat_cols), outputCols=idx, handleInvalid="keep"))
        # the indexer's extra value is the last one, which the encoder drops; its own "keep" would add another
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe_out, dropLast=True))
    numbers = [f"{c}__std" for c in num_cols] if scaler is not None else list(num_cols)
    stages.append(VectorAssembler(inputCols=[*numbers, *ohe_out], outputCol="features",
                                  handleInvalid="keep"))
    return stages


def classifier(algorithm: str = "rf", label_col: str = "label", weight_col: str | None = None,
               num_trees: int = 200, max_depth: int = 20, max_iter: int = 2000,
               layers=None, seed: int = vocab.SEED, reg_param: float = 0.0):
    """M5 random forest / M6 logistic regression / M7 perceptron."""
    if algorithm == "rf":
        # node ids are not cached: they take as much as the rows, twice, and are written every few levels;
        # walking down the trees again costs less than a level's statistics
        rf = RandomForestClassifier(labelCol=label_col, featuresCol="features", numTrees=num_trees,
                                    maxDepth=_depth(max_depth), seed=seed)
        if weight_col:
            rf.setWeightCol(weight_col)
        return rf
    if algorithm == "lr":
        lr = LogisticRegression(labelCol=label_col, featuresCol="features", maxIter=max_iter,
                                standardization=False, regParam=reg_param, elasticNetParam=0.0)
        if weight_col:
            lr.setWeightCol(weight_col)
        return lr
    if algorithm == "mlp":
        return MultilayerPerceptronClassifier(labelCol=label_col, featuresCol="features",
                                              layers=list(layers), seed=seed, maxIter=max_iter)
    raise ValueError(f"unknown algorithm {algorithm!r}; use one of {ALGORITHMS}")


def l2_reg_param(train: DataFrame, weight_col: str | None, c: float = 1.0) -> float:
    """MLlib ``regParam`` equal to an L2 penalty with inverse strength ``c``
    on the summed sample weights: 1 / (c * sum(w))  (one aggregate)."""
    total = train.agg(F.sum(F.col(weight_col)) if weight_col else F.count(F.lit(1))).first()[0]
    return 1.0 / (c * float(total)) if total else 0.0


def fit_forest(clf: RandomForestClassifier, train: DataFrame) -> RandomForestClassificationModel:
    """The forest of ``clf``; of many rows its trees are grown ``TREES_A_FIT`` at a time, which draw rows and features by
    seeds of their own and make one model of all trees."""
    trees = clf.getNumTrees()
    if trees <= TREES_A_FIT or train.count() <= ROWS_A_FIT:
        return clf.fit(train)
    some = clf.copy()
    if some.getFeatureSubsetStrategy() == "auto":  # of a forest, whatever a share's size
        some.setFeatureSubsetStrategy("sqrt")
    shares = []
    for first in range(0, trees, TREES_A_FIT):
        share = some.copy({some.numTrees: min(TREES_A_FIT, trees - first), some.seed: clf.getSeed() + first * 1_000_003})
        shares.append(share.fit(train))
    jvm, gateway = train.sparkSession._jvm, train.sparkSession.sparkContext._gateway
    grown = [t for share in shares for t in share._java_obj.trees()]
    array = gateway.new_array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(grown))
    for i, tree in enumerate(grown):
        array[i] = tree
    forest = jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(
        clf.uid, array, shares[0].numFeatures, shares[0].numClasses)
    clf._transfer_params_to_java()
    forest = clf._java_obj.copyValues(forest, jvm.org.apache.spark.ml.param.ParamMap())
    return clf._copyValues(clf._create_model(forest))


def fit_pipeline(train: DataFrame, num_cols, cat_cols, algorithm: str = "rf",
                 label_col: str = "label", scale: bool = False, weight_col: str | None = None,
                 encode_on: DataFrame | None = None, **params) -> PipelineModel:
    """Fit encoder + classifier.  For the perceptron the input width is
    taken from the fitted feature stages.  With ``encode_on`` the encoders
    are fitted on that frame (e.g. the whole table before the split) and
    the classifier on ``train``.  ``scale`` standardises the numeric columns by
    ``train``.  Logistic regression defaults to the L2 penalty with C = 1 (``l2_reg_param``)."""
    if algorithm == "lr" and "reg_param" not in params:
        params["reg_param"] = l2_reg_param(train, weight_col, params.pop("c", 1.0))
    stages = feature_stages(num_cols, cat_cols, numeric_scaler(train, num_cols) if scale and num_cols else None)
    if encode_on is not None:
        feat_model = Pipeline(stages=stages).fit(encode_on)
        if algorithm == "mlp":
            width = feat_model.transform(train.limit(1)).select("features").first()[0].size
            params["layers"] = [width, *params.pop("hidden", [128, 64]), 2]
        clf = classifier(algorithm, label_col, weight_col, **params)
        rows = feat_model.transform(train)
        return PipelineModel(stages=[*feat_model.stages, fit_forest(clf, rows) if algorithm == "rf" else clf.fit(rows)])
    if algorithm == "mlp":
        feat_model = Pipeline(stages=stages).fit(train)
        width = feat_model.transform(train.limit(1)).select("features").first()[0].size
        hidden = params.pop("hidden", [128, 64])
        params["layers"] = [width, *hidden, 2]
        clf = classifier(algorithm, label_col, weight_col, **params)
        return Pipeline(stages=[*feat_model.stages, clf]).fit(train)
    clf = classifier(algorithm, label_col, weight_col, **params)
    if algorithm == "rf":
        feat_model = Pipeline(stages=stages).fit(train)
        return PipelineModel(stages=[*feat_model.stages, fit_forest(clf, feat_model.transform(train))])
    return Pipeline(stages=[*stages, clf]).fit(train)


def with_score(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """M8: positive-class probability when the model has one, else the
    min-max scaled raw decision, else the hard label."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        arr = vector_to_array(F.col("probability"))
        s = F.when(F.size(arr) >= 2, F.try_element_at(arr, F.lit(2))).otherwise(
            F.try_element_at(arr, F.lit(1)))
        return scored.withColumn(out, s)
    if "rawPrediction" in scored.columns:
        from netvigil.operators.threshold import minmax_normalize
        raw = scored.withColumn("_raw", F.try_element_at(vector_to_array("rawPrediction"), F.lit(2)))
        return minmax_normalize(raw, "_raw", out).drop("_raw")
    return scored.withColumn(out, F.col("prediction").cast("double"))


def save_model(model: PipelineModel, meta: dict, path: str) -> None:
    """K7: MLlib persistence plus a one-row JSON metadata table."""
    model.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode(
        "overwrite").text(f"{path}/meta")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    spark = SparkSession.getActiveSession()
    model = PipelineModel.load(f"{path}/pipeline")
    row = spark.read.text(f"{path}/meta").first()
    return model, json.loads(row[0]) if row else {}
