"""Device-table queries over the ``flows`` fixture (score column given)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.functions.mac import mac_prefix
from netvigil.operators import devices as dv
from netvigil.plans import reports
from netvigil.session import scratch_path
from netvigil.sources import fixtures, lookups

THRESHOLD = 0.5


def scored_flows(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    return f.withColumn("pred", reports.predicted(F.col("score"), threshold))


_ROLLUP_COLS = ["device", "total", "anomalies", "anomaly_rate", "status", "pkts", "bytes",
                "last_seen", "top_attack"]


def device_rollup(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        long = dv.explode_roles(scored_flows(spark, sf_dir), mode)
        return dv.device_rollup(long).select(*_ROLLUP_COLS)
    run.__name__ = f"device_rollup_{mode}"
    return run


def device_top_attack(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = dv.explode_roles(scored_flows(spark, sf_dir), "both")
    return dv.device_rollup(long).select("device", "top_attack")


def device_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = dv.explode_roles(scored_flows(spark, sf_dir), "both")
    return dv.mac_info(dv.first_macs(long), lookups.vendor_table(spark)).select(
        "device", "smac", "dmac", "vendor")


def device_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dv.device_names(fixtures.device_map_rows(spark, sf_dir), "row_no")


def device_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dv.device_stats(fixtures.flows(spark, sf_dir))


def device_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = dv.device_names(fixtures.device_map_rows(spark, sf_dir), "row_no")
    return dv.device_report(scored_flows(spark, sf_dir), "both",
                            vendors=lookups.vendor_table(spark), names=names)


def device_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = dv.explode_roles(scored_flows(spark, sf_dir), "both")
    table = dv.device_rollup(long)
    return dv.device_page(table, sort="bytes_desc", page=2, size=25).select(
        "row_no", "device", "anomalies", "bytes", "status")


def device_page_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: a page number far past the end gives the last page, its key range found by histograms."""
    table = dv.device_rollup(dv.explode_roles(scored_flows(spark, sf_dir), "both"))
    return dv.device_page(table, sort="anomaly_rate_desc", page=1_000_000, size=10, max_sorted=20).select(
        "row_no", "device", "anomalies", "anomaly_rate")


def device_stats_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 from sketches stored per part and united later: whether each count is within 2 % of the exact one."""
    flows = fixtures.flows(spark, sf_dir).select("saddr", "daddr", (F.col("pkSeqID") % 13).alias("part"))
    path = scratch_path(spark, "sketches")
    dv.address_sketches(flows, ["part"]).write.parquet(path)
    near = dv.device_stats_approx(spark.read.parquet(path)).withColumn("_one", F.lit(1))
    exact = dv.device_stats(flows).select(F.lit(1).alias("_one"), *[
        F.col(c).alias(f"_{c}") for c in ("unique_saddr", "unique_daddr", "unique_union")])
    return near.join(exact, "_one").select(*[
        (F.abs(F.col(c) - F.col(f"_{c}")) <= 0.02 * F.col(f"_{c}")).alias(f"{c}_near")
        for c in ("unique_saddr", "unique_daddr", "unique_union")])


def device_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = dv.explode_roles(scored_flows(spark, sf_dir), "both")
    table = dv.device_rollup(long).withColumn("name", F.lit(None).cast("string"))
    return dv.device_filter(table, query="dos", status="RED").select(
        "device", "top_attack", "anomalies")


def mac_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixtures.flows(spark, sf_dir)
    return f.select("flow_id", mac_prefix("smac").alias("smac_prefix"),
                    mac_prefix("dmac").alias("dmac_prefix"))


QUERIES = {
    "device_rollup_both": device_rollup("both"),
    "device_rollup_src": device_rollup("src"),
    "device_rollup_dst": device_rollup("dst"),
    "device_top_attack": device_top_attack,
    "device_vendor": device_vendor,
    "device_named": device_named,
    "device_stats": device_stats,
    "device_report": device_report,
    "device_page": device_page,
    "device_page_last": device_page_last,
    "device_stats_approx": device_stats_approx,
    "device_search": device_search,
    "mac_prefix": mac_prefixes,
}
