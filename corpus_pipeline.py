"""The training-data pipeline over ``documents``: each stage is one numbered operator.

``STAGES`` are ``(name, function)`` with ``function(spark, docs, sf_dir) -> DataFrame``; each
result is written as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.  The two quality stages learn from the labelled rows of the
whole ``documents`` table, so that an earlier stage's rejections do not change what they learn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.llm import decontaminate, jaccard_join, packing, quality_classifier
from netvigil.llm import quality_rules as rules
from netvigil.llm.common import key_filter, marked, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the count rules or the n-gram model reject go."""
    return rules.accepted_documents(docs.select(*COLUMNS), rules.fit(*_labelled(spark, sf_dir)))


def quality_classification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quadratic discriminant rejects go."""
    all_docs, labels = _labelled(spark, sf_dir)
    # statistics of labelled rows (and of a few others, which the fit's join drops); no text is shuffled
    taught = marked(all_docs, F.col("doc_id").cast("long"), key_filter(labels.select(F.col("doc_id").cast("long"))))
    model = quality_classifier.fit(quality_classifier.document_statistics(taught.where("_maybe")), labels)
    return quality_classifier.accepted_documents(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each class of near copies stays, that of the smallest id."""
    return jaccard_join.distinct_documents(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark passage go."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: the kept documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classification", quality_classification),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: tokenisation and trained models are outside SQL; tests hold the stages to brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
