"""Flow-shaped inputs derived from the given parquet tables.

The test data has no network flows, so flows are derived from
``lineitem JOIN orders`` (one flow per line item).  The SQL text next to
each builder is the same definition for the DuckDB oracle; both must be
kept in sync.  All builders only project the columns they need, so the
parquet scans read just those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Spread a scan that has fewer input splits than the cluster has cores
    (e.g. one file with a single row group) over all cores, hash-partitioned
    on ``key`` (deterministic on task retry).  Large inputs already have
    many splits and are returned unchanged (no shuffle)."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= cores:
            return df
    except Exception:  # no RDD view (e.g. a remote session): leave the scan as is
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df, key) if key else df


# ------------------------------------------------------------------ flows
FLOWS_SQL = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS pkSeqID,
       concat_ws('|', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
                 cast(l.l_quantity AS bigint), cast(round(l.l_extendedprice * 100) AS bigint)) AS flow_id,
       concat('10.0.0.', cast(l.l_suppkey AS varchar(20))) AS saddr,
       concat('10.1.0.', cast(o.o_custkey % 200 AS varchar(20))) AS daddr,
       CASE l.l_suppkey % 5 WHEN 0 THEN '00:1a:2b:00:00:01' WHEN 1 THEN '44-65-0D-00-00-02'
            WHEN 2 THEN ' F4:92:BF:00:00:03' WHEN 3 THEN 'AA:BB' ELSE NULL END AS smac,
       CASE o.o_custkey % 3 WHEN 0 THEN 'D8:9E:F3:00:00:04' WHEN 1 THEN '00-1A-2B-00-00-05' ELSE NULL END AS dmac,
       CASE l.l_returnflag WHEN 'A' THEN 'tcp' WHEN 'N' THEN 'udp' ELSE 'arp' END AS proto,
       l.l_linestatus AS state,
       cast(l.l_quantity AS bigint) AS pkts,
       cast(round(l.l_extendedprice) AS bigint) AS bytes,
       l.l_shipdate AS ltime,
       CASE WHEN l.l_linenumber % 7 = 0 THEN NULL WHEN o.o_orderpriority LIKE '1%' THEN 'DDoS'
            WHEN o.o_orderpriority LIKE '2%' THEN 'DoS' WHEN o.o_orderpriority LIKE '3%' THEN 'Theft'
            ELSE 'Normal' END AS category,
       CASE l.l_partkey % 11 WHEN 0 THEN 'n/a' WHEN 1 THEN ' Attack ' WHEN 2 THEN '1.0'
            ELSE CASE WHEN o.o_orderpriority LIKE '4%' OR o.o_orderpriority LIKE '5%'
                      THEN 'Normal' ELSE '1' END END AS attack,
       cast(CASE WHEN o.o_orderpriority LIKE '4%' OR o.o_orderpriority LIKE '5%' THEN 0 ELSE 300 END
            + (l.l_partkey * 37 + l.l_linenumber * 11) % 700 AS double) / 1000 AS score
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records with the Bot-IoT shape used throughout (see FLOWS_SQL)."""
    li = table(spark, sf_dir, "lineitem", key="l_orderkey").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    prio = F.col("o_orderpriority")
    low_prio = prio.startswith("4") | prio.startswith("5")
    supp5 = F.col("l_suppkey") % 5
    cust3 = F.col("o_custkey") % 3
    part11 = F.col("l_partkey") % 11
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pkSeqID"),
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.col("l_quantity").cast("bigint"),
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("flow_id"),
        F.concat(F.lit("10.0.0."), F.col("l_suppkey").cast("string")).alias("saddr"),
        F.concat(F.lit("10.1.0."), (F.col("o_custkey") % 200).cast("string")).alias("daddr"),
        F.when(supp5 == 0, "00:1a:2b:00:00:01").when(supp5 == 1, "44-65-0D-00-00-02")
         .when(supp5 == 2, " F4:92:BF:00:00:03").when(supp5 == 3, "AA:BB").alias("smac"),
        F.when(cust3 == 0, "D8:9E:F3:00:00:04").when(cust3 == 1, "00-1A-2B-00-00-05").alias("dmac"),
        F.when(F.col("l_returnflag") == "A", "tcp").when(F.col("l_returnflag") == "N", "udp")
         .otherwise("arp").alias("proto"),
        F.col("l_linestatus").alias("state"),
        F.col("l_quantity").cast("bigint").alias("pkts"),
        F.round(F.col("l_extendedprice")).cast("bigint").alias("bytes"),
        F.col("l_shipdate").alias("ltime"),
        F.when(F.col("l_linenumber") % 7 == 0, F.lit(None).cast("string"))
         .when(prio.startswith("1"), "DDoS").when(prio.startswith("2"), "DoS")
         .when(prio.startswith("3"), "Theft").otherwise("Normal").alias("category"),
        F.when(part11 == 0, "n/a").when(part11 == 1, " Attack ").when(part11 == 2, "1.0")
         .when(low_prio, "Normal").otherwise("1").alias("attack"),
        ((F.when(low_prio, F.lit(0)).otherwise(F.lit(300))
          + (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 700).cast("double")
         / 1000).alias("score"),
    )


# ---------------------------------------------------------------- connlog
CONNLOG_SQL = """
SELECT event_id AS uid, user_id AS id_orig_p, value AS duration, event_type AS conn_state,
       user_id * 7 % 1000 AS orig_bytes,
       CASE event_type WHEN 'error' THEN '-   Malicious   DDoS' WHEN 'click' THEN 'benign mirai'
            WHEN 'view' THEN 'Okiru' WHEN 'signup' THEN NULL ELSE 'other' END AS tunnel_parents
FROM events
"""


def connlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conn-log shaped records (underscored names; see CONNLOG_SQL)."""
    ev = table(spark, sf_dir, "events", key="event_id")
    et = F.col("event_type")
    return ev.select(
        F.col("event_id").alias("uid"),
        F.col("user_id").alias("id_orig_p"),
        F.col("value").alias("duration"),
        et.alias("conn_state"),
        (F.col("user_id") * 7 % 1000).alias("orig_bytes"),
        F.when(et == "error", "-   Malicious   DDoS").when(et == "click", "benign mirai")
         .when(et == "view", "Okiru").when(et == "signup", F.lit(None).cast("string"))
         .otherwise("other").alias("tunnel_parents"),
    )


# ------------------------------------------------------------- device map
# Raw device-name map rows (ip, name, type) in file order.  Addresses
# repeat (later rows win), some are blank and some names are blank.
DEVICE_MAP_SQL = """
SELECT CASE WHEN s_suppkey % 17 = 5 THEN '  ' ELSE concat('10.0.0.', cast(s_suppkey % 80 AS varchar(20))) END AS ip,
       CASE WHEN s_suppkey % 13 = 0 THEN ' ' ELSE s_name END AS name,
       CASE s_nationkey % 4 WHEN 0 THEN 'camera' WHEN 1 THEN 'sensor' WHEN 2 THEN 'router' ELSE NULL END AS type,
       s_suppkey AS row_no
FROM supplier
"""


def device_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nk = F.col("s_nationkey") % 4
    return s.select(
        F.when(F.col("s_suppkey") % 17 == 5, F.lit("  "))
         .otherwise(F.concat(F.lit("10.0.0."), (F.col("s_suppkey") % 80).cast("string"))).alias("ip"),
        F.when(F.col("s_suppkey") % 13 == 0, F.lit(" ")).otherwise(F.col("s_name")).alias("name"),
        F.when(nk == 0, "camera").when(nk == 1, "sensor").when(nk == 2, "router").alias("type"),
        F.col("s_suppkey").alias("row_no"),
    )


# ---------------------------------------------------------- labelled events
LABELLED_EVENTS_SQL = """
SELECT event_id, user_id, event_type, value, ts,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
FROM events
"""


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a 0/1 label (error = 1) and a unique key ``event_id``."""
    ev = table(spark, sf_dir, "events", key="event_id").select(
        "event_id", "user_id", "event_type", "value", "ts")
    return ev.withColumn("label", (F.col("event_type") == "error").cast("int"))
