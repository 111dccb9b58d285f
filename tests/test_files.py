"""Quotas over files, file order over several splits, mixed headers, batch dedup, shuffled parts, size rule."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netvigil.operators import combine, curves, dedup, fill, sampling, sizing
from netvigil.plans import reports
from netvigil.sources import csv_parts, fixtures, mixed


def _md5(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def greedy(rows, need, offer):
    """The original's loop: unit after unit, from each class what is offered and still needed."""
    by = defaultdict(list)
    for u, c, k in rows:
        by[u, c].append(k)
    left, out = dict(need), []
    for u, c in sorted(by):
        if c not in left:
            continue
        keys = sorted(by[u, c], key=lambda k: (_md5(k), k))
        take = min(offer(len(keys)), left[c])
        left[c] -= take
        out += [(u, c, k) for k in keys[:take]]
    return sorted(out)


@pytest.mark.parametrize("margin", [6.0, -5.0])
def test_fill_is_the_greedy_loop(spark, margin):
    """A negative margin is always missed: the cut is then widened, with the same rows."""
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, 5, 9]), rng.choice([0, 0, 1, 7]), i) for i in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "u int, y int, k long, extra string").repartition(7)
    share = lambda n: int(n * 0.2) or n
    for need in ({0: 700, 1: 90}, {0: 1, 1: 0}, {0: 10_000, 1: 333}):
        for offer, own in ((fill.whole_unit, lambda n: n), (fill.truncated_share(0.2), share)):
            got = fill.fill(df, "u", "y", need, ["k"], offer, margin=margin)
            assert got.columns == df.columns
            assert sorted((r.u, r.y, r.k) for r in got.collect()) == greedy(rows, need, own)


def test_fill_with_equal_keys(spark):
    """A third of all rows share one key: the counts still are exact."""
    rows = [(0, 1, "hot")] * 1000 + [(i % 3, 1, str(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "u int, y int, k string")
    got = fill.fill(df, "u", "y", {1: 1200}, ["k"]).groupBy("u").count().collect()
    assert {r.u: r["count"] for r in got} == {0: 1200}
    got = fill.fill(df, "u", "y", {1: 2000}, ["k"]).groupBy("u").count().collect()
    assert {r.u: r["count"] for r in got} == {0: 1667, 1: 333}


def test_balance_by_batch(spark):
    rows = [(f, 0 if i % 4 else 1, f * 100 + i) for f in range(12) for i in range(100)] + [(11, 1, 5000)]
    df = spark.createDataFrame(rows, "_file_no int, y int, k long")
    batches = [(f // 5, y, k) for f, y, k in rows]
    pool = greedy(batches, {0: 100, 1: 300}, lambda n: int(n * 0.2) or n)
    pool0 = greedy(batches, {0: 100, 1: 100}, lambda n: int(n * 0.2) or n)
    n = min(Counter(y for _, y, _ in pool0).values())
    got = fill.balance_by_batch(df, "y", ["k"], cap=100).collect()
    assert Counter(r.y for r in got) == {0: n, 1: n} and {r.k for r in got} <= {k for *_, k in pool0}
    assert len(pool) >= len(pool0)
    with pytest.raises(ValueError):
        fill.balance_by_batch(df.filter("y = 0"), "y", ["k"])


@pytest.fixture
def small_splits(spark):
    """A session that cuts files into splits of 4 kB."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    own.conf.set("spark.sql.files.openCostInBytes", "512")
    return own


def test_positions_follow_the_lines(small_splits, tmp_path):
    want, rng = [], random.Random(4)
    for name, n in (("data_2.csv", 900), ("data_10.csv", 40), ("data_1.csv", 1300)):
        lines = [f"{name}-{i},{'x' * rng.randint(0, 60)},{i % 3 % 2}" for i in range(n)]
        lines[n // 2] += ",surplus"
        (tmp_path / name).write_text("\n".join(["a,b,attack", *lines]) + "\n")
    for no, name in enumerate(sorted(["data_2.csv", "data_10.csv", "data_1.csv"])):
        lines = (tmp_path / name).read_text().splitlines()
        want += [(no, *line.split(",")) for line in lines]
    df = csv_parts.read_parts(small_splits, str(tmp_path), ["a", "b", "attack"], positions=True)
    assert df.rdd.getNumPartitions() > 10
    got = {r._pos: (r._file_no, r.a) for r in df.repartition(5).collect()}
    assert got == {i: (no, f[0]) for i, (no, *f) in enumerate(want) if f[0] != "a" and len(f) == 3}
    first = sampling.first_n_per_class(df.withColumn("y", F.col("attack").cast("int")), "y", 350, ["_pos"]).collect()
    for y in "01":
        lines = [f[0] for _, *f in want if f[0] != "a" and len(f) == 3 and f[2] == y][:350]
        assert [r.a for r in sorted(first, key=lambda r: r._pos) if r.attack == y] == lines
    small_splits.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    with pytest.raises(Exception, match="splits of the files have changed"):
        df.filter("a <> ''").collect()


def test_file_numbers_without_counting_rows(spark, tmp_path):
    """The same numbers as those of positions: files without a row have none."""
    for name, text in {"b.csv": "a,b\n1,2\n", "a.csv": "3,4\n5,6,7\n", "c.csv": "", "d.csv": " \t\n\n", "e.csv": "8\n"}.items():
        (tmp_path / name).write_text(text)
    read = lambda **k: csv_parts.read_parts(spark, str(tmp_path), ["a", "b"], glob="*.csv", **k)
    numbered = read(file_numbers=True)
    assert numbered.columns == ["a", "b", "_file_no"]
    assert sorted(numbered.collect(), key=str) == sorted(read(positions=True).drop("_pos").collect(), key=str)
    assert {r.a: r._file_no for r in numbered.collect()} == {"3": 0, "1": 1, "8": 2}
    listed = csv_parts.read_parts(spark, [str(tmp_path / "e.csv"), str(tmp_path / "b.csv")], ["a", "b"], file_numbers=True)
    assert {r.a: r._file_no for r in listed.collect()} == {"1": 0, "8": 1}


def test_fill_writes_no_hashes(spark, monkeypatch):
    """What is written on the way to the cut are the rows alone."""
    kept = {}
    monkeypatch.setattr(fill, "_written", lambda df, name, w=fill._written: kept.setdefault(name, []).append(df.columns) or w(df, name))
    df = spark.range(2000).select("id", (F.col("id") % 4).alias("u"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    got = {r.id for r in fill.fill(df, "u", "y", {0: 700, 1: 90}, ["id"]).collect()}
    want = set()
    for y, k in ((0, 700), (1, 90)):
        for u in range(4):
            some = sorted((i for i in range(2000) if i % 4 == u and (i % 3 == 0) == y), key=_md5)[:k]
            want |= set(some)
            k -= len(some)
    assert got == want
    assert kept["fill"] == [["id", "u", "y", "_sure"]]


def test_dedup_of_many_digests_joins_no_table_of_digests(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("b"), (F.col("id") % 40).alias("k"))
    out = dedup.dedup_batches(df, "b", max_broadcast=0)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 2 and all("broadcast" in x for x in joins), joins  # the key filter, for both kinds of rows
    assert out.count() == 120


def test_missing_parts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_parts.read_parts(spark, str(tmp_path), ["a"], glob="none_*.csv")


def test_mixed_headers(spark, tmp_path):
    files = {"u1.csv": "id,Attack Type,attack\n1,x,normal\n2,\"a,b\",attack\n", "u2.csv": "Label,id\nzzz,3\n",
             "u3.csv": "label,id,,id\n1,4,u,v\nlabel,id,,id\n0,5,,\n", "u4.csv": "id, ATTACK type ,Attack\n6,y,attack\n", "empty.csv": "",
             "other.txt": "label\n1\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows, report = mixed.read_mixed(spark, str(tmp_path))
    assert sorted((r.id, r.label_raw) for r in rows.collect()) == [
        ("1", "normal"), ("2", "attack"), ("4", "1"), ("5", "0"), ("6", "attack")]
    told = {r.file.rsplit("/", 1)[1]: (r.columns, r.label) for r in report.collect()}
    assert told == {"u1.csv": (["id", "Attack Type", "attack"], "attack"), "u2.csv": (["Label", "id"], None),
                    "u3.csv": (["label", "id", "Unnamed: 2", "id.1"], "label"),
                    "u4.csv": (["id", "Attack Type", "attack"], "attack")}
    forced, _ = mixed.read_mixed(spark, str(tmp_path), "u2.csv", names=["label", "id"])
    assert [(r.label_raw, r.id) for r in forced.collect()] == [("zzz", "3")]
    with pytest.raises(ValueError):
        mixed.read_mixed(spark, str(tmp_path), "u2.csv")
    with pytest.raises(FileNotFoundError):
        mixed.read_mixed(spark, str(tmp_path), "none*.csv")


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_dedup_batches(spark, broadcast):
    rng = random.Random(5)
    rows = [(rng.randint(0, 2), rng.choice(["a", None, ""]), rng.choice([1.0, None]), rng.randint(0, 3)) for _ in range(400)]
    rows += [(0, "hot", 2.0, 7)] * 300 + [(None, "n", None, 1)] * 3 + [(i % 3, f"one{i}", 0.5, i) for i in range(50)]
    df = spark.createDataFrame(rows, "b int, s string, d double, k int").repartition(6)
    got = dedup.dedup_batches(df, "b", max_broadcast=broadcast)
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, set(rows)))
    subset = dedup.dedup_batches(df, "b", ["s"], max_broadcast=broadcast).collect()
    assert Counter((r.b, r.s) for r in subset) == Counter({(b, s) for b, s, *_ in rows})
    assert {tuple(r) for r in subset} <= set(rows)


def test_dedup_shuffles_digests(spark):
    """The wide column is in no exchange but that of the rows which occur twice."""
    df = spark.createDataFrame([(i % 2, i, "wide" * 50) for i in range(100)], "b int, k int, w string")
    out = dedup.dedup_batches(df, "b")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and out.count() == 100


def test_shuffled_parts_in_order(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    combine.write_shuffled(df, str(tmp_path / "out"), ["k"], files=6)
    files = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    assert len(files) == 6
    got = []
    for f in files:
        head, *lines = f.read_text().splitlines()
        assert head == "k,v"
        got += [int(line.split(",")[0]) for line in lines]
    assert got == sorted(range(500), key=_md5)


def test_size_rule(spark, sf_dir, tmp_path):
    """Only the bytes of files decide; rows without file statistics are grouped and counted."""
    made = spark.createDataFrame([(i % 2, i / 1000) for i in range(1000)], "y int, score double")
    assert sizing.input_bytes(made) is None and not sizing.small_input(made)
    flows = fixtures.flows(spark, sf_dir)
    assert 0 < sizing.input_bytes(flows) < 10_000_000
    assert sizing.input_bytes(flows.checkpoint()) is None
    for df, one in ((made, True), (flows.select((F.col("pkts") % 2).alias("y"), "score").checkpoint(), True)):
        counts, buckets = curves._sized(curves.score_counts(df), df, None)
        assert (buckets == 1) == one
    assert curves.bucket_count(flows) == 1
    assert curves.auc(made).first().auc == pytest.approx(0.5 + 0.5 / 500)


def test_predict_full_sections_agree(spark):
    nan = float("nan")
    rows = [(0, 0.1), (1, 0.9), (1, None), (0, nan), (0, 0.7), (1, 0.6), (None, 0.95), (2, 0.99)]
    df = spark.createDataFrame(rows, "y int, score double")
    r = reports.predict_full(df).first()
    assert (r.total_records, r.anomalies_detected, r.normal_records) == (8, 5, 3)
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 1, 1, 2) and r.auc == 0.75 and r.tp_share == 0.6667
    out = reports.predict_outputs(df, auto_metric="youden")
    t = out["auto_threshold"].first().threshold
    assert out["summary"].first().threshold == t
    assert sum(sum(x) for x in out["confusion"].first().matrix) == 6
    assert out["metrics"].first().auc == 0.75
    bare = reports.predict_full(df, None).first()
    assert bare.asDict() == {"total_records": 8, "anomalies_detected": 5, "normal_records": 3, "threshold": 0.5, "has_proba": True}


def test_predict_full_scores_once(spark, tmp_path):
    """The input (a model's scoring, usually) is evaluated for one table only."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.createDataFrame([(i % 2, i / 100) for i in range(100)], "y int, score double").mapInArrow(count, "y int, score double")
    assert reports.predict_full(df, auto_metric="f1").first().total_records == 100
    assert seen.value == 100
    assert math.isclose(reports.predict_full(df).first().threshold, 0.5)


def test_files_and_training_parts_follow_the_rows(spark, sf_dir, monkeypatch):
    f = fixtures.flows(spark, sf_dir)
    assert sizing.files_for(f, 4) == 4
    monkeypatch.setattr(sizing, "BYTES_A_FILE", sizing.input_bytes(f) // 10)
    assert sizing.files_for(f, 4) in (10, 11)
    assert sizing.files_for(spark.range(5).rdd.toDF("k long"), 4) == 4  # size not known

    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    few = sizing.training_rows(df.coalesce(1), ["id"], rows_a_task=100)
    many = sizing.training_rows(df.repartition(90), ["id"], rows_a_task=100)
    assert few.rdd.getNumPartitions() == many.rdd.getNumPartitions() == 10
    assert few.rdd.glom().collect() == many.rdd.glom().collect()  # the learners' draws do not depend on the source


def test_training_parts_grow_before_they_are_more(spark):
    """A learner's parts: one per so many rows, then a fixed number of larger ones, then more of the largest."""
    df = spark.range(6000).withColumn("x", F.col("id") % 7)
    for rows_a_task, parts in ((400, 15), (250, 24), (100, 24), (25, 24), (20, 30)):
        out = sizing.training_rows(df, ["id"], rows_a_task=rows_a_task)
        assert out.rdd.getNumPartitions() == parts
        assert out.count() == 6000 and out.distinct().count() == 6000


def test_csv_and_stream_files_grow_with_the_input(spark, sf_dir, monkeypatch):
    from netvigil.plans import file_queries, source_queries

    plain = {q.__name__: sorted(map(str, q(spark, sf_dir).collect()))
             for q in (source_queries.csv_roundtrip, source_queries.stream_device_rollup, file_queries.shuffled_parts)}
    monkeypatch.setattr(sizing, "BYTES_A_FILE", 20_000)
    asked = []
    monkeypatch.setattr(source_queries.csv_parts, "write_parts", lambda df, path, parts, header=False, w=source_queries.csv_parts.write_parts:
                        (asked.append(parts), w(df, path, parts, header))[1])
    for q in (source_queries.csv_roundtrip, source_queries.stream_device_rollup, file_queries.shuffled_parts):
        assert sorted(map(str, q(spark, sf_dir).collect())) == plain[q.__name__]
    assert asked[0] > 4
