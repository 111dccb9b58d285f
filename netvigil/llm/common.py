"""Spark helpers shared by the operators: tables, written intermediates, graph components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netvigil.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder (with Parquet writer options) and read it back.

    Cuts the lineage: later stages re-read files instead of recomputing, and a lost
    executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_columns_of(docs: DataFrame, *needed: str) -> DataFrame:
    """``docs`` narrowed to the named columns (missing ones raise Spark's own error)."""
    return docs.select(*[docs[c] for c in needed])


def crc_mod(col: str, n: int):
    """crc32 of an id's decimal text, modulo ``n`` (NULL ids: of the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


FILTER_BITS = 1 << 24


def _place(key):
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame) -> DataFrame:
    """One-hash Bloom filter over the only column of ``keys``, written: ``_word, _bits``.

    At most ``FILTER_BITS / 64`` (262,144) rows, whatever the input, so it may be broadcast.
    """
    at = _place(keys[keys.columns[0]])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return written(keys.select(F.shiftright(at, 6).alias("_word"), bit.alias("_bit"))
                   .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "key-filter")


def marked(rows: DataFrame, key, words: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only if ``key`` is certainly not among the filter's keys.

    Nothing is shuffled.  It spares a join's shuffle the rows that match nothing; with more keys
    than the filter can tell apart, more rows go through that exact join and the result is the same.
    """
    at = _place(key)
    hit = F.getbit("_bits", at.bitwiseAND(F.lit(63)).cast("int")) == 1
    return (rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col("_word"), "left")
            .withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_word", "_bits"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list ``a, b`` (long or string ids): ``node, root``.

    Alternates the large-star and small-star rewrites until the edge list stops changing:
    every round is two shuffles of at most the edge list, no node's neighbours are gathered in
    memory (minima are map-side combined aggregates, written so that the joins read plain shuffles
    and a hub's edges are split over tasks) and each round is written to the shared folder.  The root is the smallest id of the component.  Nodes without an edge to another
    node do not appear.
    """
    spark = edges.sparkSession
    e = (edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = written(e, "cc-edges")
    before = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node is linked to the node's smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        low = written(low, "cc-low")
        large = (both.join(low, F.col("u") == F.col("k")).where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        e2 = written(large.where("u != v").distinct(), "cc-large")
        # small star: every neighbour below a node, and the node, to the smallest of them
        low = e2.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        low = written(low, "cc-low")
        small = (e2.join(low, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                 .union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))))
        e = written(small.distinct(), "cc-small")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
                    ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
