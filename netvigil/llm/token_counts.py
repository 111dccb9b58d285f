"""Operator 2, token counts: a digest cache of stored counts.

Content is normalised without changing its tokens (white-space runs become one space, ends are
trimmed) and named by a SHA-256 digest; the vocabulary file's own digest names the tokenizer
version.  Digests are joined to the cache, only distinct misses are encoded, and their counts
are appended to the cache, which is a Parquet folder.

Defined cases: NULL text counts as empty (0 tokens, 0 bytes); NULL and repeated ids stay, row
by row; an empty input gives an empty result; other columns of the input are kept only when
asked for by ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netvigil.llm.common import table, written
from netvigil.llm.textvec import pieces
from netvigil.llm.tokens import encoder, vocabulary_path
from netvigil.session import scratch_path

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
OVER_LIMIT = 2048


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: counts of another file are never reused."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text):
    """SHA-256 of the white-space-normalised text, as bytes."""
    plain = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.unhex(F.sha2(plain.cast("binary"), 256))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in pieces(batches):
            _, bound = encoder(path).encode(p.column("text"))
            yield pa.RecordBatch.from_arrays(
                [p.column("digest"), pa.array(np.diff(bound).astype(np.int64))],
                ["digest", "n_tokens"])
    return run


def read_cache(spark, cache: str) -> DataFrame:
    """The stored counts; a folder that nothing was stored in yet is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache)


def token_counts(docs: DataFrame, cache: str, vocabulary: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, n_bytes, n_tokens`` of every row; encodes what ``cache`` lacks and appends it.

    Copies meet in a map-side partial aggregate before the digest shuffle, so a text that holds
    a third of all rows costs one row per task.  The last join is on digests and counts only;
    a digest with very many rows is split by adaptive execution.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    version = tokenizer_version(path)
    keyed = docs.select(F.col(text_col).alias("text"), content_digest(F.col(text_col)).alias("digest"))
    stored = read_cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens")
    misses = (keyed.dropDuplicates(["digest"]).join(stored, "digest", "left_anti"))
    (misses.select("digest", "text").mapInArrow(_count(path), "digest binary, n_tokens long")
     .withColumn("version", F.lit(version)).select("digest", "version", "n_tokens")
     .write.mode("append").parquet(cache))
    # written, so that the join below reads plain shuffles and a hot digest can be split
    counts = written(read_cache(spark, cache).where(F.col("version") == version)
                     .groupBy(F.col("digest").alias("_digest")).agg(F.max("n_tokens").alias("n_tokens")), "counts")
    rows = docs.select(F.col(id_col), *[F.col(c) for c in keep],
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       content_digest(F.col(text_col)).alias("_digest"))
    return rows.join(counts, "_digest").drop("_digest")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes, tokens and the over-limit mark of every document."""
    cache = scratch_path(spark, "token-cache")
    return token_counts(table(spark, sf_dir, "documents"), cache).withColumn(
        "over_limit", F.col("n_tokens") > OVER_LIMIT)
