"""Live device status with Structured Streaming.

The dashboard's "live" mode re-scores a flow file every few seconds; on
Spark the same table is maintained incrementally: flow files arrive in a
folder, every micro-batch is scored and exploded into device roles, and
a stateful aggregation keeps per-device totals.  Updated rows are
appended (with the batch id) to a table; the current status is the
latest row per device.  Checkpoints live in the shared checkpoint
folder, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions import vocab
from netvigil.functions.numeric import safe_ratio
from netvigil.operators.devices import explode_roles
from netvigil.plans.reports import predicted


def rollup_stream(flows: DataFrame, threshold: float = vocab.THRESHOLD_DEFAULT,
                  mode: str = "both", score_col: str = "score",
                  watermark: str | None = None) -> DataFrame:
    """Streaming per-device totals (A12) from a streaming flow frame."""
    scored = flows.withColumn("pred", predicted(F.col(score_col), threshold))
    long = explode_roles(scored, mode)
    if watermark:
        long = long.withWatermark("ltime", watermark)
    return long.groupBy("dev").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("pred") == 1).alias("anomalies"),
        F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"), F.max("ltime").alias("last_seen"))


def run_available(stream: DataFrame, sink_path: str, checkpoint_path: str) -> None:
    """Process everything available now; append changed rows per batch."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_path)

    q = (stream.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
    q.awaitTermination()


def current_status(spark: SparkSession, sink_path: str) -> DataFrame:
    """Latest row per device from the appended updates."""
    t = spark.read.parquet(sink_path)
    cols = [c for c in t.columns if c not in ("dev", "batch_id")]
    latest = t.groupBy("dev").agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
    out = latest.select(F.col("dev").alias("device"), "s.*")
    return (out.withColumn("anomaly_rate", safe_ratio("anomalies", "total"))
            .withColumn("status", F.when(F.col("anomalies") > 0, "RED").otherwise("GREEN")))
