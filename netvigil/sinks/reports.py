"""Report writers (K1-K6, K9): every writer is a distributed DataFrame write.

Values that are NaN or infinite are written as NULL (JSON has no such
numbers).  The only array-valued report is the 2x2 confusion matrix; a
curve is written as a long table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.functions.numeric import finite_or_null, round_half_even
from netvigil.sources.csv_parts import TEXT_OPTS


def _has_floats(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(_has_floats(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _has_floats(t.elementType)
    if isinstance(t, T.MapType):
        return _has_floats(t.valueType)
    return isinstance(t, (T.DoubleType, T.FloatType))


def _finite(col: Column, t: T.DataType) -> Column:
    """``col`` with every NaN and infinity below it NULL; parts without floats are passed through."""
    if not _has_floats(t):
        return col
    if isinstance(t, T.StructType):
        fields = [_finite(col.getField(f.name), f.dataType).alias(f.name) for f in t.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(t, T.ArrayType):
        return F.transform(col, lambda x: _finite(x, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(col, lambda _, v: _finite(v, t.valueType))
    return finite_or_null(col)


def null_nonfinite(df: DataFrame) -> DataFrame:
    """K9: NaN / +-Infinity -> NULL in every float or double, also inside structs, arrays and map values
    (a map's keys stay: they cannot be NULL)."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True,
                order_by=None) -> None:
    """K1/K2/K4: CSV (with header), Parquet or JSON lines.  ``order_by``
    gives a stable (shuffled-by-hash) file order for sample files."""
    out = null_nonfinite(df)
    if order_by is not None:
        out = out.orderBy(*order_by)
    w = out.write.mode("overwrite")
    if fmt == "csv":
        w.options(**TEXT_OPTS).option("header", header).csv(path)  # blanks in texts are kept
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_metrics(metrics_row: DataFrame, path: str, fmt: str = "json") -> None:
    """K3/K4: the one-row metrics table as JSON or CSV."""
    write_table(metrics_row.coalesce(1), path, fmt)


def confusion_report(confusion_long: DataFrame, normalize: str = "all", digits: int = 4) -> DataFrame:
    """K5: one row {labels, matrix, matrix_pct} from the four-row confusion table."""
    c = confusion_long
    cell = lambda a, p: F.max(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n")))
    m = c.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"),
              cell(1, 1).alias("tp"))
    tn, fp, fn, tp = (F.col(x).cast("double") for x in ("tn", "fp", "fn", "tp"))
    if normalize == "all":
        tot = tn + fp + fn + tp
        d0 = d1 = F.when(tot == 0, F.lit(1.0)).otherwise(tot)
    else:
        d0 = F.when(tn + fp == 0, F.lit(1.0)).otherwise(tn + fp)
        d1 = F.when(fn + tp == 0, F.lit(1.0)).otherwise(fn + tp)
    r = lambda x, d: round_half_even(x / d, digits)
    return m.select(
        F.array(F.lit("0"), F.lit("1")).alias("labels"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("matrix"),
        F.array(F.array(r(tn, d0), r(fp, d0)), F.array(r(fn, d1), r(tp, d1))).alias("matrix_pct"))


def roc_report(roc: DataFrame, auc_row: DataFrame) -> DataFrame:
    """K6: every point of the curve (idx, threshold, fpr, tpr) with the AUC beside it.

    A long table, so that its size has no bound; charts thin it with ``curves.thin_curve``.
    """
    one = auc_row.select(finite_or_null(F.col("auc")).alias("auc"))
    return (roc.select("idx", "threshold", "fpr", "tpr").withColumn("_one", F.lit(1))
            .join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one"))  # one row


def write_json_row(row_df: DataFrame, path: str) -> None:
    row_df.coalesce(1).write.mode("overwrite").json(path)
