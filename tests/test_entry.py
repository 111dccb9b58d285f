"""Driver contract: entry runs, every query has a name, oracles agree at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracles import TABLES, _canon

SLOW = {"rf_score", "lr_score", "mlp_score", "predict_report", "device_report_model",
        "model_roundtrip"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "device" in df.columns and "status" in df.columns


def test_oracles_are_a_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 50


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
                 "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = E.queries()[name](spark, sf_dir)
    rel = duck.execute(E.oracle_sql()[name])
    duck_types = {d[0]: str(d[1]).upper() for d in rel.description}
    dd = rel.df()
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == duck_types
    assert _canon(df.toPandas()) == _canon(dd)
