"""Per-device rollup of scored flows.

Plan shape (see ``device_report``):

* one scan explodes every flow into one row per role (src / dst);
* one two-level hash aggregate: ``(dev, attack)`` with map-side combine,
  then ``dev`` on the reduced rows -> counts, sums, last seen and the
  most frequent attack name (a hot device costs one partial-aggregate
  row per task, never a task holding its group);
* one pass over non-null MACs picks the first three per device and side
  with ``row_number() <= 3``; Spark plans this as a map-side partial
  window-group limit before the shuffle, so every map task sends at most
  three rows per (device, side) and a hot device never reaches one task
  whole (an optional salted first level splits it further), then a
  size-checked broadcast lookup of the vendor prefix;
* per-device tables are joined on ``dev``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.functions import vocab
from netvigil.functions.mac import mac_prefix, strip
from netvigil.functions.numeric import safe_ratio, to_numeric, to_numeric_text, zero_fill
from netvigil.operators.paging import MAX_SORTED, page_rows, text_levels
from netvigil.session import scratch_path

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DEFAULT_MAC_SALTS = 1


# ------------------------------------------------------------------ roles
_WANTED = {"src": ("src",), "dst": ("dst",), "both": ("src", "dst")}


def resolve_roles(columns, mode: str = "auto", src_col: str = "saddr", dst_col: str = "daddr"):
    """Which address columns become devices.

    ``mode`` names the wanted roles; auto (and any other word) wants those whose column is there.
    Returns ``([(role, column), ...], label)``, the label naming the column, or 'both' when two
    roles were wanted; raises when no wanted column is there.
    """
    address = {"src": src_col, "dst": dst_col}
    present = [role for role, col in address.items() if col in columns]
    wanted = _WANTED.get((mode or "auto").lower(), present)
    roles = [(role, address[role]) for role in wanted if role in present]
    if not roles:
        raise ValueError(f"no {src_col}/{dst_col} columns to group")
    return roles, address[wanted[0]] if len(wanted) == 1 else "both"


def _time_order(df: DataFrame, name: str) -> Column:
    """Sort key of a time column: text holding numbers sorts as numbers, before it other text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.struct(to_numeric_text(F.col(name)), F.col(name))
    return F.col(name)


def _latest(df: DataFrame, name: str) -> Column:
    """The largest value by ``_time_order``, in the column's own type."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.max_by(name, _time_order(df, name))
    return F.max(name)


def _amount(df: DataFrame, name: str) -> Column:
    """Numeric amount column (pkts/bytes): missing -> 0, bad text -> 0."""
    if name not in df.columns:
        return F.lit(0).cast("long")
    dtype = df.schema[name].dataType
    if isinstance(dtype, _INTEGRAL):
        return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))
    return zero_fill(to_numeric(df, name))


def explode_roles(df: DataFrame, mode: str = "auto", src_col: str = "saddr",
                  dst_col: str = "daddr", pred_col: str = "pred",
                  attack_col: str | None = None, order_cols=None) -> DataFrame:
    """One row per (flow, role): dev, role, role_rank, pred, pkts, bytes,
    ltime, smac, dmac, attack and the order columns.  Blank and 'nan'
    devices are dropped."""
    roles, _ = resolve_roles(df.columns, mode, src_col, dst_col)
    if attack_col is None:
        attack_col = next((c for c in vocab.ATTACK_NAME_CANDIDATES if c in df.columns), None)
    order_cols = [c for c in (order_cols or ["ltime", "pkSeqID"]) if c in df.columns]

    def opt(name, dtype="string"):
        return (F.col(name) if name in df.columns else F.lit(None).cast(dtype)).alias(name)

    carry = [F.col(pred_col).cast("int").alias("pred"),
             _amount(df, "pkts").alias("pkts"), _amount(df, "bytes").alias("bytes"),
             opt("ltime", "timestamp"), opt("smac"), opt("dmac"),
             (F.col(attack_col).cast("string") if attack_col else F.lit(None).cast("string"))
             .alias("attack")]
    carry += [_time_order(df, c).alias(f"_o_{i}") for i, c in enumerate(order_cols)]

    if len(roles) == 1:
        role, col = roles[0]
        long = df.select(F.col(col).cast("string").alias("dev"), F.lit(role).alias("role"),
                         F.lit(0).alias("role_rank"), *carry)
    else:
        arr = F.array(*[F.struct(F.col(c).cast("string").alias("dev"), F.lit(r).alias("role"),
                                 F.lit(i).alias("role_rank")) for i, (r, c) in enumerate(roles)])
        long = df.select(F.explode(arr).alias("_r"), *carry).select("_r.*", *[
            c for c in ["pred", "pkts", "bytes", "ltime", "smac", "dmac", "attack"]] + [
            f"_o_{i}" for i in range(len(order_cols))])
    dev = strip(F.col("dev"))
    return (long.withColumn("dev", dev)
            .filter(F.col("dev").isNotNull() & (F.col("dev") != "") & (F.col("dev") != "nan")))


def _order_names(long: DataFrame):
    return ["role_rank"] + sorted(c for c in long.columns if c.startswith("_o_"))


# ---------------------------------------------------------------- rollups
def device_rollup(long: DataFrame, with_top_attack: bool = True) -> DataFrame:
    """A12 (+A13): per-device totals from ``explode_roles`` output.

    Two-level aggregate: ``(dev, attack)`` first (map-side combined),
    then ``dev`` over the reduced rows.
    """
    att = strip(F.col("attack"))
    att = F.when(att != "", att)
    per_attack = (long.groupBy("dev", att.alias("attack"))
                  .agg(F.count(F.lit(1)).alias("n_all"),
                       F.count_if(F.col("pred") == 1).alias("n_anom"),
                       F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"),
                       _latest(long, "ltime").alias("last_seen")))
    aggs = [F.sum("n_all").alias("total"), F.sum("n_anom").alias("anomalies"),
            F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"),
            _latest(per_attack, "last_seen").alias("last_seen")]
    if with_top_attack:
        # most frequent name among predicted anomalies, else among all rows;
        # ties go to the smallest name
        aggs += [
            F.min_by("attack", F.when((F.col("n_anom") > 0) & F.col("attack").isNotNull(),
                                      F.struct(-F.col("n_anom"), F.col("attack"))))
            .alias("_top_anom"),
            F.min_by("attack", F.when(F.col("attack").isNotNull(),
                                      F.struct(-F.col("n_all"), F.col("attack"))))
            .alias("_top_all"),
        ]
    out = per_attack.groupBy("dev").agg(*aggs)
    out = (out.withColumn("pkts", F.col("pkts").cast("long"))
           .withColumn("bytes", F.col("bytes").cast("long"))
           .withColumn("anomaly_rate", safe_ratio("anomalies", "total"))
           .withColumn("status", F.when(F.col("anomalies") > 0, "RED").otherwise("GREEN")))
    if with_top_attack:
        out = out.withColumn("top_attack", F.coalesce("_top_anom", "_top_all")).drop(
            "_top_anom", "_top_all")
    return out.withColumnRenamed("dev", "device")


def first_macs(long: DataFrame, per_side: int = 3, salts: int = DEFAULT_MAC_SALTS) -> DataFrame:
    """The first ``per_side`` non-null MACs of each device and side
    (side 0 = smac, 1 = dmac) in device-row order: dev, side, pos, mac."""
    order = _order_names(long)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("smac").cast("string").alias("mac")),
                    F.struct(F.lit(1).alias("side"), F.col("dmac").cast("string").alias("mac")))
    m = (long.filter(F.col("smac").isNotNull() | F.col("dmac").isNotNull())
         .select("dev", *order, F.explode(sides).alias("_s"))
         .select("dev", *order, "_s.side", "_s.mac")
         .filter(F.col("mac").isNotNull()))
    keys = [F.col(c).asc_nulls_last() for c in order] + [F.col("mac").asc()]
    if salts and salts > 1:
        m = m.withColumn("_salt", F.pmod(F.xxhash64(*order, "mac"), F.lit(salts)))
        w1 = Window.partitionBy("dev", "side", "_salt").orderBy(*keys)
        m = m.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= per_side)
    w2 = Window.partitionBy("dev", "side").orderBy(*keys)
    return (m.withColumn("pos", F.row_number().over(w2)).filter(F.col("pos") <= per_side)
            .select("dev", "side", "pos", "mac"))


def mac_info(macs: DataFrame, vendors: DataFrame | None) -> DataFrame:
    """Per device: first smac, first dmac and the vendor of the first MAC
    (smac side first, then dmac) whose prefix is known."""
    aggs = [F.max(F.when((F.col("side") == 0) & (F.col("pos") == 1), F.col("mac"))).alias("smac"),
            F.max(F.when((F.col("side") == 1) & (F.col("pos") == 1), F.col("mac"))).alias("dmac")]
    if vendors is not None:
        # vendors come size-checked (broadcast hint) from sources.lookups.vendor_table
        macs = macs.withColumn("prefix", mac_prefix("mac")).join(
            vendors.select("prefix", "vendor"), "prefix", "left")
        aggs.append(F.min_by("vendor", F.when(F.col("vendor").isNotNull(),
                                              F.struct("side", "pos"))).alias("vendor"))
    return macs.groupBy("dev").agg(*aggs).withColumnRenamed("dev", "device")


def device_stats(df: DataFrame, src_col: str = "saddr", dst_col: str = "daddr") -> DataFrame:
    """A3: distinct source, destination and union address counts in one
    shuffle (raw values, NULL ignored)."""
    parts = []
    if src_col in df.columns:
        parts.append(F.struct(F.col(src_col).cast("string").alias("addr"), F.lit(True).alias("s"),
                              F.lit(False).alias("d")))
    if dst_col in df.columns:
        parts.append(F.struct(F.col(dst_col).cast("string").alias("addr"), F.lit(False).alias("s"),
                              F.lit(True).alias("d")))
    if not parts:
        raise ValueError("no address columns")
    per_addr = (df.select(F.explode(F.array(*parts)).alias("_a")).select("_a.*")
                .filter(F.col("addr").isNotNull())
                .groupBy("addr").agg(F.bool_or("s").alias("s"), F.bool_or("d").alias("d")))
    return per_addr.agg(F.count_if("s").alias("unique_saddr"),
                        F.count_if("d").alias("unique_daddr"),
                        F.count(F.lit(1)).alias("unique_union"))


SKETCH_LG_K = 14  # 2^14 registers: a standard error of some 0.7 %, at most 16 kB a sketch


def address_sketches(df: DataFrame, by=(), src_col: str = "saddr", dst_col: str = "daddr",
                     lg_k: int = SKETCH_LG_K) -> DataFrame:
    """A3, approximate: one mergeable sketch of the source and one of the destination addresses per value of
    ``by`` (a part, a day), to be stored: ``*by, src_sketch, dst_sketch``.

    No address is shuffled, only sketches of bounded size; later parts add rows, earlier ones are not read again.
    """
    sketch = lambda c: F.hll_sketch_agg(F.col(c).cast("string"), lg_k)
    return df.groupBy(*by).agg(sketch(src_col).alias("src_sketch"), sketch(dst_col).alias("dst_sketch"))


def device_stats_approx(sketches: DataFrame, by=()) -> DataFrame:
    """A3 from stored sketches, united over their rows or per value of ``by``: estimates of the distinct
    source, destination and all addresses (the union of both sketches).  No rows at all count 0."""
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("src_sketch").alias("s"), F.hll_union_agg("dst_sketch").alias("d"))
    estimate = lambda c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).cast("long")
    return merged.select(*by, estimate(F.col("s")).alias("unique_saddr"), estimate(F.col("d")).alias("unique_daddr"),
                         estimate(F.hll_union("s", "d")).alias("unique_union"))


def device_names(rows: DataFrame, order_col: str | None = None) -> DataFrame:
    """Clean device-map rows (ip, name, type): blank ip skipped, blank
    name/type -> NULL, the later row wins for a repeated ip."""
    ip = strip(F.col("ip").cast("string"))
    name = strip(F.col("name").cast("string"))
    typ = strip(F.col("type").cast("string"))
    clean = rows.select(ip.alias("ip"), F.when(name != "", name).alias("name"),
                        F.when(typ != "", typ).alias("dtype"),
                        (F.col(order_col) if order_col else F.monotonically_increasing_id())
                        .alias("_ord"))
    return (clean.filter(F.col("ip").isNotNull() & (F.col("ip") != ""))
            .groupBy("ip").agg(F.max_by(F.struct("name", "dtype"), "_ord").alias("_v"))
            .select(F.col("ip").alias("device"), "_v.name", "_v.dtype"))


def device_report(scored: DataFrame, mode: str = "auto", vendors: DataFrame | None = None,
                  names: DataFrame | None = None, pred_col: str = "pred",
                  src_col: str = "saddr", dst_col: str = "daddr", attack_col: str | None = None,
                  order_cols=None, mac_salts: int = DEFAULT_MAC_SALTS) -> DataFrame:
    """Full device table from flows carrying a 0/1 prediction column.

    Columns: device, name, dtype, vendor, status, total, anomalies,
    anomaly_rate, top_attack, pkts, bytes, last_seen, smac, dmac.
    """
    long = explode_roles(scored, mode, src_col, dst_col, pred_col, attack_col, order_cols)
    roll = device_rollup(long)
    info = mac_info(first_macs(long, salts=mac_salts), vendors)
    out = roll.join(info, "device", "left")
    if names is not None:
        # per-device tables on both sides: adaptive execution broadcasts the
        # name map only when its runtime size is under the threshold
        out = out.join(names, "device", "left")
    else:
        out = (out.withColumn("name", F.lit(None).cast("string"))
               .withColumn("dtype", F.lit(None).cast("string")))
    if vendors is None:
        out = out.withColumn("vendor", F.lit(None).cast("string"))
    return out.select("device", "name", "dtype", "vendor", "status", "total", "anomalies",
                      "anomaly_rate", "top_attack", "pkts", "bytes", "last_seen", "smac", "dmac")


# ------------------------------------------------------------ table views
_SORT_KEYS = {
    "anomalies_desc": "anomalies",
    "anomaly_rate_desc": "anomaly_rate",
    "bytes_desc": "bytes",
    "pkts_desc": "pkts",
}


def device_filter(devices: DataFrame, query: str = "", status: str = "") -> DataFrame:
    """Status equality and a case-insensitive substring search over
    device, top attack (or the dash shown for none) and name."""
    out = devices
    if status:
        out = out.filter(F.col("status") == status)
    q = (query or "").lower().strip()
    if q:
        attack_text = F.lower(F.coalesce(F.col("top_attack"), F.lit("—")))
        name_text = F.lower(F.coalesce(F.col("name"), F.lit("")))
        out = out.filter(F.lower(F.col("device").cast("string")).contains(q)
                         | attack_text.contains(q) | name_text.contains(q))
    return out


def device_sort_keys(sort: str = "anomalies_desc"):
    key = _SORT_KEYS.get(sort)
    tie = F.col("device").asc()
    if key is None:  # device_asc and unknown values
        return [tie]
    return [F.coalesce(F.col(key), F.lit(0)).desc(), tie]


def device_page(devices: DataFrame, query: str = "", status: str = "",
                sort: str = "anomalies_desc", page: int = 1,
                size: int = vocab.DEVICE_PAGE_SIZE_DEFAULT, max_sorted: int = MAX_SORTED) -> DataFrame:
    """Filter, sort, then one page (page clamped to the last).

    The filtered table is written once; of a large one only the key range that holds the page is
    sorted, so the last page costs what the first does (see ``paging``).
    Adds ``row_no`` (1-based position in the filtered, sorted table).
    """
    size = max(1, int(size))
    spark = devices.sparkSession
    path = scratch_path(spark, "devices")
    device_filter(devices, query, status).write.parquet(path)
    filtered = spark.read.parquet(path)
    total = filtered.count()
    page = min(max(1, int(page)), max(1, -(-total // size)))
    key = _SORT_KEYS.get(sort)
    levels = [-F.coalesce(F.col(key), F.lit(0))] if key else []
    return page_rows(filtered, [*levels, *text_levels("device")], device_sort_keys(sort), (page - 1) * size, size, total,
                     max_sorted=max_sorted)
