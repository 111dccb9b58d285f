"""Live device rollup: incremental, resumable from its checkpoint."""

from pyspark.sql import functions as F

from netvigil.operators import devices as dv
from netvigil.operators.joins import fits, lookup_join
from netvigil.session import scratch_path
from netvigil.sources import fixtures
from netvigil.streaming import live

COLS = ["saddr", "daddr", "pkts", "bytes", "ltime", "score"]


def test_stream_resumes_and_matches_batch(spark, sf_dir):
    base = scratch_path(spark, "stream-test")
    f = fixtures.flows(spark, sf_dir).select(*COLS)
    halves = f.randomSplit([0.5, 0.5], seed=1)
    halves[0].repartition(2).write.mode("append").parquet(f"{base}/in")
    src = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    live.run_available(live.rollup_stream(src), f"{base}/out", f"{base}/ckpt")
    first = live.current_status(spark, f"{base}/out").count()
    assert first > 0
    # new files arrive; the restarted query continues from its checkpoint
    halves[1].repartition(2).write.mode("append").parquet(f"{base}/in")
    src = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    live.run_available(live.rollup_stream(src), f"{base}/out", f"{base}/ckpt")
    got = {r["device"]: (r["total"], r["anomalies"], r["pkts"], r["bytes"])
           for r in live.current_status(spark, f"{base}/out").collect()}
    scored = f.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    want = {r["device"]: (r["total"], r["anomalies"], r["pkts"], r["bytes"])
            for r in dv.device_rollup(dv.explode_roles(scored, "both")).collect()}
    assert got == want


def test_checked_broadcast_join(spark):
    big = spark.range(100).withColumnRenamed("id", "k")
    small = spark.range(5).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    assert fits(small, 5) and not fits(small, 4)
    out = lookup_join(big, small, "k", "left", max_rows=10)
    assert out.filter(F.col("v").isNotNull()).count() == 5
    assert lookup_join(big, small, "k", "left", max_rows=2).count() == 100
