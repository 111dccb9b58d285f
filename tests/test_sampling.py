"""Sampling invariants and exactness against a full md5 ranking."""

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from netvigil.operators import sampling
from netvigil.sources import fixtures


def _events(spark, sf_dir):
    return fixtures.labelled_events(spark, sf_dir).select("event_id", "label")


def _brute(pdf, k_by_class, seed=42):
    pdf = pdf.assign(h=[hashlib.md5(f"{seed}:{e}".encode()).hexdigest() for e in pdf.event_id])
    out = []
    for c, k in k_by_class.items():
        part = pdf[pdf.label == c].sort_values(["h", "event_id"]).head(k)
        out.append(part)
    return set(pd.concat(out).event_id)


@pytest.mark.parametrize("cache_input", [True, False])
def test_exact_k_matches_brute_force(spark, sf_dir, cache_input):
    ev = _events(spark, sf_dir)
    got = sampling.exact_k(ev, "label", {0: 123, 1: 45}, ["event_id"], cache_input=cache_input)
    ids = {r[0] for r in got.select("event_id").collect()}
    assert ids == _brute(ev.toPandas(), {0: 123, 1: 45})


def test_refinement_path_is_exact(spark, sf_dir, monkeypatch):
    # force several refinement rounds with tiny boundary and bucket counts
    monkeypatch.setattr(sampling, "MAX_BOUNDARY", 3)
    monkeypatch.setattr(sampling, "BUCKETS", 4)
    ev = _events(spark, sf_dir)
    got = sampling.exact_k(ev, "label", {0: 300, 1: 77}, ["event_id"])
    ids = [r[0] for r in got.select("event_id").collect()]
    assert len(ids) == 377
    assert set(ids) == _brute(ev.toPandas(), {0: 300, 1: 77})


def test_same_result_under_repartition(spark, sf_dir):
    ev = _events(spark, sf_dir)
    a = {r[0] for r in sampling.balance_min(ev, "label", ["event_id"], cap=50).collect()}
    b = {r[0] for r in sampling.balance_min(ev.repartition(7), "label", ["event_id"], cap=50).collect()}
    assert a == b and len(a) == 100


def test_balance_target_replicates_minority(spark, sf_dir):
    ev = _events(spark, sf_dir)
    counts = sampling.class_counts(ev, "label")
    k = counts[1] + 10  # minority needs two copies
    out = sampling.balance_target(ev, "label", k, ["event_id"])
    per = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    assert per == {0: min(counts[0], k), 1: k}
    assert out.filter("label = 0").select("rep").distinct().collect()[0][0] == 1


def test_ratio_sample_rounding_and_shortfall(spark, sf_dir):
    ev = _events(spark, sf_dir)
    n1 = sampling.class_counts(ev, "label")[1]
    out = sampling.ratio_sample(ev, "label", 101, 0.5, ["event_id"])
    per = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    assert per == {1: 50, 0: 51}  # round(50.5) = 50 (half-even)
    out = sampling.ratio_sample(ev, "label", 101, 0.5, ["event_id"], rounding="floor")
    assert {r[0]: r[1] for r in out.groupBy("label").count().collect()} == {1: 50, 0: 51}
    big = sampling.ratio_sample(ev, "label", 4 * n1, 0.5, ["event_id"])
    assert big.filter("label = 1").count() == n1  # shortfall: fewer rows, no error


def test_split_exact_counts_and_disjoint(spark, sf_dir):
    ev = _events(spark, sf_dir)
    counts = sampling.class_counts(ev, "label")
    sp = sampling.stratified_split(ev, "label", 0.3, ["event_id"], exact=True)
    per = {(r[0], r[1]): r[2] for r in sp.groupBy("label", "split").count().collect()}
    for c, n in counts.items():
        assert per[(c, "test")] == math.ceil(0.3 * n)
        assert per[(c, "test")] + per[(c, "train")] == n
    assert sp.count() == ev.count()


def test_first_n_per_class(spark, sf_dir):
    ev = _events(spark, sf_dir)
    out = sampling.first_n_per_class(ev, "label", 20, ["event_id"])
    pdf = ev.toPandas()
    want = set(pdf.sort_values("event_id").groupby("label").head(20).event_id)
    assert {r[0] for r in out.select("event_id").collect()} == want
    with pytest.raises(ValueError):
        sampling.first_n_per_class(ev.filter("label = 0"), "label", 5, ["event_id"])


def test_sample_n_errors_when_too_many(spark, sf_dir):
    ev = _events(spark, sf_dir)
    assert sampling.sample_n(ev, 17, ["event_id"]).count() == 17
    with pytest.raises(ValueError):
        sampling.sample_n(ev.limit(5), 6, ["event_id"])


def test_hash_split_is_stable(spark, sf_dir):
    ev = _events(spark, sf_dir)
    a = sampling.stratified_split(ev, "label", 0.3, ["event_id"]).filter("split='test'")
    b = sampling.stratified_split(ev.repartition(3), "label", 0.3, ["event_id"]).filter("split='test'")
    assert {r[0] for r in a.select("event_id").collect()} == {r[0] for r in b.select("event_id").collect()}
    assert 0 < a.count() < ev.count()
    assert sampling.sample_fraction(ev, 1.0, ["event_id"]).count() == ev.count()
    assert F is not None


def test_first_n_with_heavy_ties_is_exact_and_bounded(spark, monkeypatch):
    # a third of class 0 shares one order value; boundary ranking must not see all of it
    monkeypatch.setattr(sampling, "MAX_BOUNDARY", 20)
    monkeypatch.setattr(sampling, "BUCKETS", 8)
    rows = [(i, 0, 5 if i % 3 == 0 else i) for i in range(300)] + [(1000 + i, 1, i) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, label int, ts long")
    out = sampling.first_n_per_class(df, "label", 40, ["ts"])
    got = out.collect()
    per = {}
    for r in got:
        per.setdefault(r["label"], []).append(r["ts"])
    assert len(per[0]) == 40 and len(per[1]) == 40
    # class 0: everything with ts < 5 (ids 1, 2, 4) then 37 of the 100 tied rows at ts = 5
    assert sorted(per[0])[:3] == [1, 2, 4] and sorted(per[0])[3:] == [5] * 37
    assert sorted(per[1]) == list(range(40))
    again = sampling.first_n_per_class(df.repartition(4), "label", 40, ["ts"])
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in got)


def test_balance_to_class_and_dedup_cap(spark, sf_dir):
    ev = _events(spark, sf_dir)
    counts = sampling.class_counts(ev, "label")
    out = sampling.balance_to_class(ev, "label", ["event_id"], keep_class=1, sample_class=0)
    per = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    assert per == {1: counts[1], 0: counts[1]}
    with pytest.raises(ValueError):
        sampling.balance_to_class(ev, "label", ["event_id"], keep_class=0, sample_class=1)
    capped = sampling.dedup_sample(ev.select("label", "event_id"), 0.9, ["event_id"], cap=30)
    assert capped.count() == 30


def test_ratio_sample_warns_on_shortfall(spark, sf_dir):
    ev = _events(spark, sf_dir)
    n1 = sampling.class_counts(ev, "label")[1]
    with pytest.warns(UserWarning):
        sampling.ratio_sample(ev, "label", 4 * n1, 0.5, ["event_id"])


@pytest.mark.parametrize("limit", [20, 100_000])
def test_first_n_same_rows_at_every_size(spark, limit):
    rows = [(i, 0, 5 if i % 2 else None, (i * 37) % 101) for i in range(200)] + [(300 + i, 1, i, 0) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label int, ts long, part long")
    for n in (40, 85):
        got = sampling.first_n_per_class(df, "label", n, ["ts", "part", "id"], max_boundary=limit).collect()
        for c in (0, 1):
            own = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2] is None, r[2] or 0, r[3], r[0]))[:n]
            assert sorted(r["id"] for r in got if r["label"] == c) == sorted(r[0] for r in own)


def test_first_n_of_equal_rows_ends(spark, monkeypatch):
    df = spark.createDataFrame([(c, 1) for c in (0, 1) for _ in range(100)], "label int, ts long")
    assert sampling.first_n_per_class(df, "label", 20, ["ts"], max_boundary=10).count() == 40
    nulls = spark.createDataFrame([(c, None) for c in (0, 1) for _ in range(9)], "label int, ts long")
    assert sampling.first_n_per_class(nulls, "label", 4, ["ts"]).count() == 8


@pytest.mark.parametrize("order", [["a", "s"], ["a", "s", "k"], ["a"]])
def test_tied_boundaries_are_refined(spark, order):
    """Three order values, far more rows each than are ranked at once: next columns decide, then the row."""
    import random

    rng = random.Random(6)
    rows = [(rng.randint(0, 1), rng.choice([1, 2, 2, 2, None]), rng.choice(["x", "y", "ü", None]), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "y int, a int, s string, k int").repartition(5)
    got = sampling.first_n_per_class(df, "y", 900, order, max_boundary=40).collect()
    last = lambda v: (v is None, v.encode() if isinstance(v, str) else v or 0)
    at = {"a": 1, "s": 2, "k": 3}
    key = lambda r: tuple(last(r[at[c]]) for c in order)
    for c in (0, 1):
        want = sorted((r for r in rows if r[0] == c), key=key)[:900]
        own = [tuple(r) for r in got if r.y == c]
        assert len(set(own)) == 900
        assert sorted(map(key, own)) == [key(r) for r in want]
    again = sampling.first_n_per_class(df.repartition(3), "y", 900, order, max_boundary=40).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_equal_rows_need_no_ranking(spark, monkeypatch):
    """A third of all rows are one row: exact counts in the sample and in the split, no window over them."""
    monkeypatch.setattr(sampling, "MAX_BOUNDARY", 50)
    monkeypatch.setattr(sampling, "COPIES_A_ROW", 64)
    rows = [(0, "hot")] * 1000 + [(0, f"k{i}") for i in range(1500)] + [(1, f"k{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "label int, k string").repartition(6)
    take = sampling.exact_k(df, "label", {0: 1600, 1: 10}, ["k"]).collect()
    order = sorted((hashlib.md5(f"42:{k}".encode()).hexdigest(), k) for c, k in rows if c == 0)[:1600]
    assert sorted(r.k for r in take if r.label == 0) == sorted(k for _, k in order)
    split = sampling.stratified_split(df, "label", 0.5, ["k"], exact=True)
    assert "_order" not in " ".join(split.columns)
    got = split.groupBy("label", "split").count().collect()
    assert {(r.label, r.split): r["count"] for r in got} == {(0, "test"): 1250, (0, "train"): 1250, (1, "test"): 250, (1, "train"): 250}
    assert split.filter("k = 'hot'").count() == 1000


def test_split_makes_no_copy(spark, sf_dir):
    """The split flag is planned over the input itself: no checkpoint, no cache."""
    split = sampling.stratified_split(_events(spark, sf_dir), "label", 0.3, ["event_id"], exact=True)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "InMemoryRelation" not in plan and "ExistingRDD" not in plan
