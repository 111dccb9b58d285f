"""Plan-shape guards: the properties the scale design relies on."""

import __spark_entry__ as E


def _executed(spark, df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_device_rollup_combines_map_side(spark, sf_dir):
    plan = _executed(spark, E.queries()["device_rollup_both"](spark, sf_dir))
    assert "partial_count" in plan and "partial_sum" in plan
    assert "SinglePartition" not in plan


def test_first_macs_limit_before_shuffle(spark, sf_dir):
    plan = _executed(spark, E.queries()["device_vendor"](spark, sf_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "SinglePartition" not in plan


def test_scans_are_pruned(spark, sf_dir):
    plan = _executed(spark, E.queries()["device_stats"](spark, sf_dir))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans
    for line in scans:
        assert "l_tax" not in line and "l_discount" not in line and "o_totalprice" not in line


def test_threshold_sweep_aggregates_before_shuffle(spark, sf_dir):
    plan = _executed(spark, E.queries()["threshold_youden"](spark, sf_dir))
    assert "partial_count" in plan
