"""Multi-part CSV flow files.

Parts are read as one distributed scan with an explicit all-string
schema taken from a names file; header rows are dropped wherever they
occur (a row whose every field equals its column name, ignoring case
and surrounding blanks); rows with too many fields are dropped while
short rows are kept NULL-padded.  A quote inside a quoted field is doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.functions.mac import strip as strip_ws
from netvigil.sources.file_order import with_file_numbers, with_positions

RAGGED = "_ragged_line"  # the raw line of a row with too few or too many fields
TEXT_OPTS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}


def load_columns(spark: SparkSession, names_path: str, strip: bool = True) -> list[str]:
    """Ordered column names from the first row of the names file."""
    row = spark.read.options(**TEXT_OPTS).csv(names_path, header=False).first()
    if row is None:
        raise ValueError(f"empty names file {names_path}")
    names = [c if c is not None else "" for c in row]
    return [c.strip() for c in names] if strip else names


def _names(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path")


def list_parts(spark: SparkSession, path: str, glob: str = "data_*.csv") -> list[str]:
    """S3: part files in name order (file listing only; contents not read)."""
    return sorted((r[0] for r in _names(spark, path, glob).collect()), key=lambda p: p.rsplit("/", 1)[-1])


def header_row(names, header=None) -> F.Column:
    """The row repeats the header (trimmed, lower-case) in every field; ``header`` where its texts are not the names."""
    cond = None
    for n, h in zip(names, header or names):
        c = F.lower(strip_ws(F.coalesce(F.col(f"`{n}`"), F.lit("")))) == F.lit(h.strip().lower())
        cond = c if cond is None else cond & c
    return F.coalesce(cond, F.lit(False))


def not_surplus(names) -> F.Column:
    """The row has at most as many fields as there are names.  Only the lines of ragged rows are looked at: commas
    outside quotes are counted, so an empty last field is a field too."""
    bare = F.regexp_replace(RAGGED, '"[^"]*("|$)', "")
    commas = F.length(bare) - F.length(F.translate(bare, ",", ""))
    some = F.coalesce(F.col(f"`{names[0]}`"), F.lit("")) != F.lit("\0")  # Spark wants a field read beside the line
    return (F.col(RAGGED).isNull() | (commas < len(names))) & some


def _selected(spark: SparkSession, path, glob: str, max_files: int | None, skip_files: int):
    """Paths to scan and the glob to scan them with; file names come to the driver only to skip some."""
    if isinstance(path, (list, tuple)):
        files = list(path)
    elif not skip_files and max_files is None:
        if _names(spark, path, glob).isEmpty():
            raise FileNotFoundError(f"no parts matching {glob} under {path}")
        return [path], glob
    else:
        files = list_parts(spark, path, glob)
        files = files[skip_files:] or files
        if max_files is not None:
            files = files[:max_files]
    if not files:
        raise FileNotFoundError(f"no parts matching {glob} under {path}")
    return files, None


def read_parts(spark: SparkSession, path, names, glob: str = "data_*.csv",
               max_files: int | None = None, skip_files: int = 0, tolerant: bool = True,
               drop_header_rows: bool = True, with_file: bool = False, positions: bool = False,
               header=None, file_numbers: bool = False) -> DataFrame:
    """Read CSV parts under ``path`` (or an explicit list of files)
    as strings with the given column names.

    ``positions`` adds ``_file_no`` and ``_pos`` (see ``file_order``): rows are numbered before headers and
    surplus rows go, so numbers follow the lines.  ``file_numbers`` adds ``_file_no`` alone, for which no row is counted."""
    files, pattern = _selected(spark, path, glob, max_files, skip_files)
    fields = [T.StructField(n, T.StringType()) for n in names]
    if tolerant:
        fields.append(T.StructField(RAGGED, T.StringType()))
    # all fields are parsed, or a row's number of fields would not be known
    reader = (spark.read.schema(T.StructType(fields)).options(**TEXT_OPTS).option("header", False)
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAGGED)
              .option("columnPruning", not tolerant))
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(files)
    if with_file:
        df = df.withColumn("_file", F.col("_metadata.file_name"))
    if positions:
        df = with_positions(df)
    elif file_numbers:
        lines = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
        df = with_file_numbers(df, lines.text(files))
    if tolerant:
        df = df.filter(not_surplus(names)).drop(RAGGED)
    if drop_header_rows:
        df = df.filter(~header_row(names, header))
    return df


def read_csv_with_header(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """A CSV file; with ``columns`` the names are forced (a header row,
    if any, is dropped), else the file's own header names the columns."""
    if columns is not None:
        return read_parts(spark, [path], columns)
    return spark.read.options(**TEXT_OPTS).option("header", True).csv(path)


def head_per_file(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of every file, in file order.

    File order is (file, split start, position in the split).  Ranking is
    two-level: per split first (bounded by the split size), then per file
    over at most n rows per split."""
    ordered = df.withColumn("_f", F.col("_metadata.file_path")) \
        .withColumn("_blk", F.col("_metadata.file_block_start")) \
        .withColumn("_pos", F.monotonically_increasing_id())
    w1 = Window.partitionBy("_f", "_blk").orderBy("_pos")
    first = ordered.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= n)
    w2 = Window.partitionBy("_f").orderBy("_blk", "_pos")
    return (first.withColumn("_r2", F.row_number().over(w2)).filter(F.col("_r2") <= n)
            .drop("_f", "_blk", "_pos", "_r1", "_r2"))


def write_parts(df: DataFrame, path: str, parts: int, header: bool = False) -> None:
    """Write ``df`` as ``parts`` CSV files (blanks preserved)."""
    (df.repartition(parts).write.mode("overwrite").options(**TEXT_OPTS)
     .option("header", header).csv(path))
