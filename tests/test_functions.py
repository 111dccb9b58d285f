"""Table-driven cases for labels, numeric coercion and MAC prefixes."""

import math

import pytest
from pyspark.sql import functions as F

from netvigil.functions import label_from_keywords, mac_prefix, normalize_label, to_numeric_text
from netvigil.functions.numeric import safe_ratio, zero_fill

TEXTS = ["0", "1", " Normal", "BENIGN", "Attack", "attacks", "ddos", "botnet", "true", "no",
         "1.0", "2", "-1", "0.5", "n/a", "", None, "inf"]

EXPECTED = {
    # closed: lower only (no trim), unknown and NULL -> 1
    "closed": [1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1],
    # open: trim+lower map, numeric fallback truncated, else dropped
    "open": [0, 1, 0, 0, 1, 1, None, None, 1, 0, 1, 2, -1, 0, None, None, None, None],
    # named: attack names added, clipped to 0..1
    "named": [0, 1, 0, 0, 1, 1, 1, None, 1, 0, 1, 1, 0, 0, None, None, None, None],
    "botnet": [0, 1, 0, 0, 1, 1, None, 1, 1, 0, 1, 2, -1, 0, None, None, None, None],
    # small: nine keys only
    "small": [0, 1, 0, 0, 1, None, None, None, 1, 0, None, None, None, None, None, None, None, None],
}


@pytest.mark.parametrize("profile", sorted(EXPECTED))
def test_label_profiles(spark, profile):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(normalize_label("t", profile)).collect()]
    assert got == EXPECTED[profile]


def test_label_strict_rejects_fraction(spark):
    df = spark.createDataFrame([("0.5",)], "t string")
    with pytest.raises(Exception):
        df.select(normalize_label("t", "strict")).collect()
    ok = spark.createDataFrame([("1.0",), ("attack",)], "t string")
    assert [r[0] for r in ok.select(normalize_label("t", "strict")).collect()] == [1, 1]


def test_label_closed_numeric(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None), (4, 5.0), (5, -2.0)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(normalize_label("x", "closed", numeric_input=True)).collect()]
    assert got == [0, 1, 1, 1, 0]


def test_keyword_labels(spark):
    vals = [None, "-   Benign   -", "-   Malicious   C&C", "Okiru", "benign mirai", "other"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(label_from_keywords("v")).collect()]
    assert got == [0, 0, 1, 1, 0, 0]


NUMERIC = [(" 1 ", 1.0), ("1e3", 1000.0), ("inf", math.inf), ("-Infinity", -math.inf),
           ("nan", None), ("0x10", None), ("1_0", None), ("1d", None), ("1.0f", None),
           ("", None), ("true", None), (".5", 0.5), ("5.", 5.0), ("+1", 1.0), ("1e", None),
           ("1.2.3", None), ("\t7\n", 7.0), ("1E+2", 100.0), ("++1", None)]


def test_to_numeric_text(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(NUMERIC)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(to_numeric_text("s")).collect()]
    assert got == [e for _, e in NUMERIC]
    filled = [r[0] for r in df.orderBy("i").select(zero_fill(to_numeric_text("s"))).collect()]
    assert filled == [0.0 if (e is None or math.isinf(e)) else e for _, e in NUMERIC]


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (0, 0)], "a int, b int")
    assert [r[0] for r in df.select(safe_ratio("a", "b")).collect()] == [0.5, 0.0, 0.0]


MACS = [("00:1a:2b:00:00:01", "00:1A:2B"), ("44-65-0D-00-00-02", "44:65:0D"),
        (" F4:92:BF:00:00:03", "F4:92:BF"), ("AA:BB", None), (None, None), ("", None),
        ("AA:BB:", "AA:BB:"), ("a-b-c-d", "A:B:C")]


def test_mac_prefix(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(MACS)], "i int, m string")
    got = [r[0] for r in df.orderBy("i").select(mac_prefix("m")).collect()]
    assert got == [e for _, e in MACS]


def test_mac_prefix_handles_null_column(spark):
    df = spark.range(1).select(F.lit(None).cast("string").alias("m"))
    assert df.select(mac_prefix("m")).first()[0] is None


def test_label_keys_strip_all_whitespace(spark):
    df = spark.createDataFrame([("\tAttack\n",), (" normal\r",)], "t string")
    assert [r[0] for r in df.select(normalize_label("t", "open")).collect()] == [1, 0]


@pytest.mark.parametrize("profile", ["open", "named", "botnet"])
def test_label_text_is_cleaned_once(spark, profile):
    """The key and the number are computed once for a label, not once for each value of the map."""
    label = spark.range(1).select(F.col("id").cast("string").alias("t")).select(normalize_label("t", profile).alias("y"))
    text = label._jdf.queryExecution().analyzed().toString()
    assert text.count("btrim(") <= (14 if profile == "named" else 7), text
