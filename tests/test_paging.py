"""Pages of a sorted table against a full sort; mergeable sketches; nested JSON safety; CSV quoting."""

import json
import random

import pytest
from pyspark.sql import functions as F

from netvigil.operators import devices as dv
from netvigil.operators import paging
from netvigil.sinks import reports as sinks
from netvigil.sources import csv_parts


def _devices(n, seed, ties):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = f"{'10.0.' if i % 3 else 'très long préfixe commun de noms '}{rng.randint(0, 255)}.{i}"
        key = rng.choice([0, 0, 0, 5, None]) if ties else rng.randint(-10 ** 15, 10 ** 15)
        rows.append((name, key, rng.random() ** 9 if not ties else 0.25, rng.choice(["RED", "GREEN"])))
    return rows


@pytest.mark.parametrize("ties", [True, False])
def test_pages_match_a_full_sort(spark, ties):
    rows = _devices(700, 7, ties)
    df = spark.createDataFrame(rows, "device string, anomalies long, anomaly_rate double, status string").repartition(5)
    df = df.withColumn("bytes", F.col("anomalies")).withColumn("top_attack", F.lit(None).cast("string")).withColumn("name", F.lit("x"))
    for sort, key in (("anomalies_desc", lambda r: (-(r[1] or 0), r[0].encode())), ("device_asc", lambda r: r[0].encode()),
                      ("anomaly_rate_desc", lambda r: (-r[2], r[0].encode()))):
        order = sorted(rows, key=key)
        for page, size in ((1, 25), (14, 25), (28, 25), (99, 25), (3, 199)):
            at = (min(page, -(-len(rows) // size)) - 1) * size
            got = dv.device_page(df, sort=sort, page=page, size=size, max_sorted=30).orderBy("row_no").collect()
            assert [r.device for r in got] == [r[0] for r in order[at:at + size]]
            assert [r.row_no for r in got] == list(range(at + 1, at + 1 + len(got)))
    red = [r for r in sorted(rows, key=lambda r: r[0].encode()) if r[3] == "RED"]
    got = dv.device_page(df, status="RED", sort="device_asc", page=2, size=100, max_sorted=30).orderBy("row_no").collect()
    assert [r.device for r in got] == [r[0] for r in red[100:200]]
    assert dv.device_page(df.limit(0), sort="device_asc", max_sorted=0).count() == 0


def test_page_sorts_little(spark):
    """The range found for the last page holds few rows, also where one value fills the first level."""
    df = spark.range(20_000).select((F.col("id") % 2 * 0).alias("v"), F.format_string("%08d", "id").alias("t")).cache()
    rows = df.select("*", F.col("v").alias("_l0"), *[c.alias(f"_l{i + 1}") for i, c in enumerate(paging.text_levels("t"))])
    names = [c for c in rows.columns if c.startswith("_l")]
    first = paging.locate(rows, names, 19_990, 100)
    assert first.fixed[0] == 0 and first.before <= 19_990
    assert rows.filter(first.reached(names)).count() == 20_000 - first.before <= 110
    assert paging.locate(rows, names, 20_000, 100).past
    df.unpersist()


def test_sketches_merge(spark):
    df = spark.createDataFrame([(i % 4, f"a{i % 900}", f"a{i % 500 + 700}") for i in range(4000)], "part int, saddr string, daddr string")
    parts = dv.address_sketches(df, ["part"])
    assert parts.count() == 4
    one, all_ = dv.device_stats_approx(parts).first(), dv.device_stats(df).first()
    for c in ("unique_saddr", "unique_daddr", "unique_union"):
        assert abs(one[c] - all_[c]) <= 0.02 * all_[c]
    own = {r.part: r.unique_saddr for r in dv.device_stats_approx(parts, ["part"]).collect()}
    assert set(own) == {0, 1, 2, 3} and max(own.values()) < one.unique_saddr
    none = dv.device_stats_approx(dv.address_sketches(df.limit(0), ["part"])).first()
    assert tuple(none) == (0, 0, 0)


def test_nested_numbers_are_safe(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    schema = ("k int, d double, s struct<a: double, t: struct<b: float, c: string>>, l array<array<double>>, "
              "m map<string, struct<x: double>>, p array<int>")
    rows = [(1, nan, (inf, (nan, "c")), [[1.0, nan], [], None], {"u": (inf,), "v": (2.0,)}, [1]), (2, 1.5, None, None, None, None)]
    safe = sinks.null_nonfinite(spark.createDataFrame(rows, schema))
    assert safe.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    got = {r.k: r.asDict(recursive=True) for r in safe.collect()}
    assert got[1] == {"k": 1, "d": None, "s": {"a": None, "t": {"b": None, "c": "c"}}, "l": [[1.0, None], [], None],
                      "m": {"u": {"x": None}, "v": {"x": 2.0}}, "p": [1]}
    assert got[2] == {"k": 2, "d": 1.5, "s": None, "l": None, "m": None, "p": None}
    sinks.write_table(spark.createDataFrame(rows, schema), str(tmp_path / "out"), "json")
    text = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert {x["k"] for x in text} == {1, 2}


def test_csv_surplus_and_quotes(spark, tmp_path):
    (tmp_path / "data_1.csv").write_text('1,2,3\n1,2,3,\n4,"a ""q"", b",\n5,6\n7,"x,y","z",\n8,,"w"\n9,"open,1,2\n')
    df = csv_parts.read_parts(spark, str(tmp_path), ["a", "b", "c"])
    want = {("1", "2", "3"), ("4", 'a "q", b', None), ("5", "6", None), ("8", None, "w")}
    got = {tuple(r) for r in df.collect()}
    assert want <= got and len(got) == 5  # an unclosed quote takes the rest of its line, as a short row
    assert df.count() == 5 and df.select("c").distinct().count() == 3
