"""Source/sink round trips over data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.operators.sizing import files_for
from netvigil.session import scratch_path
from netvigil.sources import csv_parts, fixtures

CSV_COLS = ["flow_id", "saddr", "smac", "attack", "pkts", "score"]


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2-S7 + K1: flows written as CSV parts (each with a header line) and
    a names file into the shared checkpoint folder, then read back by
    name list with header rows dropped."""
    base = scratch_path(spark, "csv-parts")
    f = fixtures.flows(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in CSV_COLS])
    csv_parts.write_parts(f, f"{base}/parts", parts=files_for(f, 4), header=True)
    spark.createDataFrame([tuple(CSV_COLS)], ", ".join(f"c{i} string" for i in range(len(CSV_COLS)))) \
        .coalesce(1).write.mode("overwrite").csv(f"{base}/names")
    names = csv_parts.load_columns(spark, f"{base}/names")
    back = csv_parts.read_parts(spark, f"{base}/parts", names, glob="part-*.csv")
    return back.select("flow_id", "saddr", "smac", "attack",
                       F.col("pkts").try_cast("bigint").alias("pkts"),
                       F.col("score").try_cast("double").alias("score"))


QUERIES = {"csv_roundtrip": csv_roundtrip}


BATCHES = 4


def stream_device_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live device totals: flows land as parquet files in the shared
    folder, a file stream (a quarter of the files per micro-batch) keeps per-device
    state, and the latest state per device is read back."""
    from netvigil.streaming import live

    base = scratch_path(spark, "stream")
    f = fixtures.flows(spark, sf_dir).select("saddr", "daddr", "pkts", "bytes", "ltime", "score")
    files = files_for(f, BATCHES)
    f.repartition(files).write.mode("overwrite").parquet(f"{base}/in")
    src = (spark.readStream.schema(f.schema).option("maxFilesPerTrigger", -(-files // BATCHES))
           .parquet(f"{base}/in"))
    live.run_available(live.rollup_stream(src), f"{base}/out", f"{base}/ckpt")
    return live.current_status(spark, f"{base}/out").select(
        "device", "total", "anomalies", "anomaly_rate", "status", "pkts", "bytes", "last_seen")


QUERIES["stream_device_rollup"] = stream_device_rollup
