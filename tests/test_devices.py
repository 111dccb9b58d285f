"""Device rollup rules on a small inline fixture."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from netvigil.operators import devices as dv
from netvigil.sources import lookups

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("pkSeqID long, saddr string, daddr string, smac string, dmac string, pkts string, "
          "bytes long, ltime timestamp, category string, score double")


def _flows(spark):
    rows = [
        (1, "10.0.0.1", "10.1.0.1", "AA:BB", "D8-9E-F3-00-00-01", "5", 100, T0, "DDoS", 0.9),
        (2, "10.0.0.1", "10.1.0.2", "zz:zz:zz:1", None, "x", 50, T0 + dt.timedelta(1), "DoS", 0.8),
        (3, "10.0.0.1", "10.1.0.1", "00:1a:2b:00:00:09", None, "2", 10, T0 + dt.timedelta(2), "DoS", 0.1),
        (4, " 10.0.0.2 ", "", None, "44-65-0d-00-00-01", None, 7, T0, None, 0.2),
        (5, "nan", "10.1.0.1", None, None, "1", 1, T0, " ", 0.3),
        (6, "10.0.0.2", None, None, None, "3", 2, T0 + dt.timedelta(3), "Theft", 0.4),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("pred", (F.col("score") >= 0.5).cast("int"))


def test_roles_and_modes(spark):
    f = _flows(spark)
    assert dv.resolve_roles(f.columns, "weird")[1] == "both"
    assert dv.resolve_roles(f.columns, "src")[1] == "saddr"
    with pytest.raises(ValueError):
        dv.resolve_roles(["x"], "auto")
    both = {r["device"]: r for r in dv.device_rollup(dv.explode_roles(f, "both")).collect()}
    assert set(both) == {"10.0.0.1", "10.0.0.2", "10.1.0.1", "10.1.0.2"}  # blank / nan / NULL dropped
    d = both["10.0.0.1"]
    assert (d["total"], d["anomalies"], d["status"], d["pkts"], d["bytes"]) == (3, 2, "RED", 7, 160)
    assert d["top_attack"] in ("DDoS", "DoS")
    assert d["top_attack"] == "DDoS"  # tie 1-1 among anomalies -> smallest name
    assert both["10.0.0.2"]["top_attack"] == "Theft"  # no anomaly: mode over all rows
    assert both["10.0.0.2"]["status"] == "GREEN" and both["10.0.0.2"]["anomaly_rate"] == 0.0
    assert both["10.0.0.2"]["last_seen"] == T0 + dt.timedelta(3)
    dst = {r["device"] for r in dv.device_rollup(dv.explode_roles(f, "dst")).collect()}
    assert dst == {"10.1.0.1", "10.1.0.2"}


@pytest.mark.parametrize("salts", [1, 4])
def test_vendor_first_three_macs(spark, salts):
    f = _flows(spark)
    long = dv.explode_roles(f, "both")
    info = {r["device"]: r for r in dv.mac_info(dv.first_macs(long, salts=salts),
                                                 lookups.vendor_defaults(spark)).collect()}
    # 10.0.0.1: smacs AA:BB (no prefix), zz:zz:zz (unknown), 00:1a:2b (Cisco) -> Cisco
    assert info["10.0.0.1"]["vendor"] == "Cisco"
    assert info["10.0.0.1"]["smac"] == "AA:BB"
    assert info["10.0.0.1"]["dmac"] == "D8-9E-F3-00-00-01"
    # 10.0.0.2: no smac, dmac 44-65-0d -> Samsung
    assert info["10.0.0.2"]["vendor"] == "Samsung"


def test_device_names_rules(spark):
    rows = [("10.0.0.1", "cam", "camera", 1), (" ", "x", "y", 2), ("10.0.0.1", " ", "hub", 3),
            ("10.0.0.2", "gw", "", 4), (None, "z", "z", 5)]
    df = spark.createDataFrame(rows, "ip string, name string, type string, row_no int")
    got = {r["device"]: (r["name"], r["dtype"]) for r in dv.device_names(df, "row_no").collect()}
    assert got == {"10.0.0.1": (None, "hub"), "10.0.0.2": ("gw", None)}


def test_device_stats_and_page(spark):
    f = _flows(spark)
    st = dv.device_stats(f).first()
    assert (st["unique_saddr"], st["unique_daddr"], st["unique_union"]) == (4, 3, 7)
    table = dv.device_rollup(dv.explode_roles(f, "both")).withColumn("name", F.lit(None).cast("string"))
    page = dv.device_page(table, sort="device_asc", page=9, size=3).collect()
    assert [r["row_no"] for r in page] == [4]  # page clamped to the last one
    hits = dv.device_filter(table, query="THE", status="").collect()
    assert [r["device"] for r in hits] == ["10.0.0.2"]


def test_vendor_table_fallback(spark, tmp_path):
    missing = lookups.vendor_table(spark, str(tmp_path / "none.json"))
    assert missing.count() == 5
    p = tmp_path / "oui.json"
    p.write_text('{" aa:bb:cc ": "One", "AA:BB:CC": "Two", "11:22:33": "Three"}')
    got = {r["prefix"]: r["vendor"] for r in lookups.vendor_table(spark, str(p)).collect()}
    assert got == {"AA:BB:CC": "Two", "11:22:33": "Three"}


def test_device_report_on_minimal_columns(spark):
    df = spark.createDataFrame([("a", "b", 1), ("a", None, 0), ("c", "b", 0)],
                               "saddr string, daddr string, pred int")
    rows = {r["device"]: r for r in dv.device_report(df, "both").collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"]["total"], rows["a"]["anomalies"], rows["a"]["pkts"]) == (2, 1, 0)
    assert rows["b"]["status"] == "RED" and rows["c"]["status"] == "GREEN"
    assert rows["a"]["top_attack"] is None and rows["a"]["smac"] is None and rows["a"]["last_seen"] is None
    only_src = {r["device"] for r in dv.device_report(df.drop("daddr"), "auto").collect()}
    assert only_src == {"a", "c"}
