"""Feature cleaning, coercion, alignment and scaling.

Schema decisions (which columns exist, are numeric, are all NULL) use
column names plus at most one aggregate row per call; the data itself
stays on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netvigil.functions.numeric import finite_or_null, to_numeric, zero_fill

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def q(name: str):
    """Column reference that tolerates dots and dashes in names."""
    return F.col(f"`{name}`")


def drop_present(df: DataFrame, cols) -> DataFrame:
    """Drop the listed columns that exist (absent names are ignored)."""
    return df.drop(*[c for c in cols if c in df.columns])


def all_null_columns(df: DataFrame, cols) -> list[str]:
    """Columns with no non-NULL value (one aggregate over all columns)."""
    if not cols:
        return []
    row = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"n{i}"] == 0]


def clean_features(df: DataFrame, label_col: str | None, drop=(), categorical=(),
                   drop_all_null: bool = True, keep=()) -> tuple[DataFrame, list, list]:
    """P3-P7 + N1/N2: drop ids and the label, coerce non-categorical columns
    to numbers (bad text -> NULL, +/-inf -> NULL), drop all-NULL columns,
    fill NULL with 0 ('0' in categorical text columns).

    Returns (frame, numeric_cols, categorical_cols); ``keep`` columns
    (e.g. a key) are carried through untouched.
    """
    gone = set(c for c in drop if c in df.columns) | ({label_col} if label_col else set())
    feats = [c for c in df.columns if c not in gone and c not in keep]
    cats = [c for c in categorical if c in feats]
    exprs = []
    for c in feats:
        if c in cats:
            exprs.append(q(c).cast("string").alias(c))
        else:
            exprs.append(finite_or_null(to_numeric(df, c)).alias(c))
    x = df.select(*[q(k) for k in keep], *exprs)
    if drop_all_null:
        dead = all_null_columns(x, feats)
        x = x.drop(*dead)
        feats = [c for c in feats if c not in dead]
        cats = [c for c in cats if c not in dead]
    nums = [c for c in feats if c not in cats]
    x = x.fillna(0.0, subset=nums) if nums else x
    x = x.fillna("0", subset=cats) if cats else x
    return x, nums, cats


def prepare_numeric(df: DataFrame, label_col: str, drop=(), keep=()) -> tuple[DataFrame, list]:
    """Numeric-only preparation: every feature coerced, non-finite -> 0;
    an error when no feature column is left."""
    gone = set(c for c in drop if c in df.columns) | {label_col}
    feats = [c for c in df.columns if c not in gone and c not in keep]
    if not feats:
        raise ValueError("no numeric features survived")
    x = df.select(*[q(k) for k in keep], *[zero_fill(to_numeric(df, c)).alias(c) for c in feats])
    return x, feats


def downcast(df: DataFrame, cols=None, keep=()) -> DataFrame:
    """Text columns with any numeric value become numbers (int if every
    value is integral, else float); floats -> float, ints -> int.  One
    profile aggregate decides the types."""
    cols = [c for c in (cols or df.columns) if c not in keep]
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    prof = {}
    if texts:
        aggs = []
        for i, c in enumerate(texts):
            num = to_numeric(df, c)
            fin = finite_or_null(num)
            aggs += [F.count(num).alias(f"n{i}"),
                     F.coalesce(F.bool_and(F.when(num.isNotNull(), fin.isNotNull() & (fin == F.floor(fin)))),
                                F.lit(True)).alias(f"i{i}")]
        row = df.agg(*aggs).first()
        prof = {c: (row[f"n{i}"], row[f"i{i}"]) for i, c in enumerate(texts)}
    out = []
    for c in df.columns:
        dt = df.schema[c].dataType
        if c in keep or c not in cols:
            out.append(q(c))
        elif c in prof:
            n, integral = prof[c]
            if n == 0:
                out.append(q(c))
            elif integral:
                out.append(to_numeric(df, c).try_cast("int").alias(c))
            else:
                out.append(to_numeric(df, c).cast("float").alias(c))
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            out.append(q(c).cast("float").alias(c))
        elif isinstance(dt, _INTEGRAL):
            out.append(q(c).try_cast("int").alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def numeric_and_categorical(df: DataFrame, keep=()) -> tuple[list, list]:
    """Feature columns by type: numbers, and everything else as categories."""
    feats = [f for f in df.schema.fields if f.name not in keep]
    nums = [f.name for f in feats if isinstance(f.dataType, T.NumericType)]
    return nums, [f.name for f in feats if f.name not in nums]


def align_features(df: DataFrame, features, strict_numeric: bool = False, keep=()) -> DataFrame:
    """Exactly ``features`` in order; a missing feature is 0.  With
    ``strict_numeric`` every feature is coerced and NULL/bad/non-finite -> 0."""
    cols = []
    for f in features:
        if f in df.columns:
            c = zero_fill(to_numeric(df, f)) if strict_numeric else q(f)
        else:
            c = F.lit(0.0) if strict_numeric else F.lit(0)
        cols.append(c.alias(f))
    return df.select(*[q(k) for k in keep], *cols)


def standardize(train: DataFrame, cols, apply_to: DataFrame | None = None,
                suffix: str = "") -> DataFrame:
    """M3: (x - mean) / population std fitted on ``train``; zero variance
    gives 0.  Two numbers per column reach the driver."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(q(c)).alias(f"m{i}"), F.stddev_pop(q(c)).alias(f"s{i}")]
    row = train.agg(*aggs).first()
    target = apply_to if apply_to is not None else train
    for i, c in enumerate(cols):
        m = row[f"m{i}"] or 0.0
        s = row[f"s{i}"] or 0.0
        scale = s if s > 0 else 1.0
        target = target.withColumn(c + suffix, (q(c).cast("double") - F.lit(m)) / F.lit(scale))
    return target


def class_weight_map(df: DataFrame, y: str) -> dict:
    """Balanced weights n / (k * n_c) from one grouped count."""
    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect() if r[0] is not None}
    n, k = sum(counts.values()), len(counts)
    return {c: n / (k * m) for c, m in counts.items()}


def with_class_weight(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    w = class_weight_map(df, y)
    expr = None
    for c, v in w.items():
        expr = F.when(F.col(y) == c, F.lit(v)) if expr is None else expr.when(F.col(y) == c, F.lit(v))
    return df.withColumn(out, expr if expr is not None else F.lit(None).cast("double"))


def preprocess_connlog(df: DataFrame, label_source: str = "tunnel_parents", out: str = "attack",
                       drop=None, keep=()) -> DataFrame:
    """Conn-log cleaning: keyword label (L7) into ``out``, identifier and
    text columns dropped (P3), every other column coerced to a number
    (N1) with NULL -> 0 (N3).  ``keep`` columns (e.g. a key) are carried
    through untouched."""
    from netvigil.functions import vocab
    from netvigil.functions.labels import label_from_keywords

    drop = vocab.DROP_CONNLOG if drop is None else drop
    labelled = df.withColumn(out, label_from_keywords(q(label_source)))
    feats = [c for c in labelled.columns if c not in drop and c != out and c not in keep]
    return labelled.select(*[q(k) for k in keep],
                           *[F.coalesce(to_numeric(labelled, c), F.lit(0.0)).alias(c) for c in feats],
                           F.col(out))

