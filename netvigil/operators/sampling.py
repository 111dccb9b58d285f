"""Reproducible class-balanced sampling and splitting.

Random draws are replaced by a deterministic order: rows are ranked by
``md5('<seed>:<key>')`` (then the key), so the same rows come out on any
cluster, partitioning or engine.  "Take the first k rows of a class in
that order" is done without ranking the whole class:

1. a rank value ``v`` in [0, 1) is derived from the hash prefix (or from
   an explicit order column for first-N sampling);
2. per class, one histogram job counts rows per ``(class, bucket of v)``
   (map-side combined; at most ``BUCKETS`` rows per class reach the driver);
3. every row below the bucket that holds the k-th row is in; that
   boundary bucket is refined the same way until it holds at most
   ``MAX_BOUNDARY`` rows, and only those rows are ranked with a window;
4. where more rows than that share one value of ``v``, the search goes on inside them by the next order
   columns and last by a hash of the row; rows equal in every column need no ranking.

The result is exact (equal to a full ``row_number`` ranking) and no task
ever sorts a whole class, however large or skewed.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netvigil.functions import vocab
from netvigil.operators.paging import locate, order_levels
from netvigil.operators.sizing import small_input
from netvigil.session import checkpoint_dir

BUCKETS = 1024
MAX_BOUNDARY = 100_000
_HEX_DIGITS = 13  # 52 bits: exact in a double
WHOLE = "whole"  # a cap that drops no row: the classes keep their sizes, for a learner that weighs them (A18)


def hash_text(seed: int, key_cols) -> Column:
    """md5 of '<seed>:<key>' (multi-column keys joined by '|')."""
    keys = [F.col(k).cast("string") for k in key_cols]
    key = keys[0] if len(keys) == 1 else F.concat_ws("|", *keys)
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def hash_unit(h: Column) -> Column:
    """Leading hex digits of the hash as a double in [0, 1), monotone in h."""
    return F.conv(F.substring(h, 1, _HEX_DIGITS), 16, 10).cast("double") / float(16 ** _HEX_DIGITS)


@dataclass
class _Cut:
    lo: float            # rows with v < lo are all selected
    hi: float | None     # boundary rows: lo <= v < hi (None: no boundary)
    r: int               # how many boundary rows to take
    tied: bool = False   # too many boundary rows to rank, all with one value


def _resolve(df: DataFrame, cls: str, v: str, need, hi0: dict | None,
             classes=None, max_boundary: int | None = None) -> tuple[dict, dict]:
    """Find, per class, the cut that selects exactly need[c] smallest v.

    ``need`` is a dict, or a function of the class counts; then the first
    round covers the whole range and its histogram also gives the counts
    (no separate counting job).  Returns (cuts, need)."""
    max_boundary = MAX_BOUNDARY if max_boundary is None else max_boundary
    deferred = callable(need)
    keys = list(classes) if deferred else list(need)
    state = {c: {"lo": 0.0, "hi": (hi0 or {}).get(c), "base": 0} for c in keys}
    cuts: dict = {}
    if not deferred:
        for c, k in need.items():
            if k <= 0:
                cuts[c] = _Cut(lo=-math.inf, hi=None, r=0)
    for _ in range(64):
        open_ = [c for c in keys if c not in cuts]
        if not open_:
            break
        conds, bucket = None, None
        for c in open_:
            lo, hi = state[c]["lo"], state[c]["hi"]
            inside = (F.col(cls) == F.lit(c)) & (F.col(v) >= F.lit(lo))
            if hi is not None:
                inside = inside & (F.col(v) < F.lit(hi))
            conds = inside if conds is None else conds | inside
            width = (hi if hi is not None else 1.0) - lo
            b = F.least(F.greatest(F.floor((F.col(v) - F.lit(lo)) / F.lit(width if width > 0 else 1.0)
                                           * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")
            bucket = F.when(F.col(cls) == F.lit(c), b) if bucket is None else bucket.when(
                F.col(cls) == F.lit(c), b)
        hist = (df.filter(conds).groupBy(F.col(cls).alias("c"), bucket.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("vmin"), F.max(v).alias("vmax"))
                .collect())  # at most BUCKETS rows per open class
        per: dict = {c: [] for c in open_}
        for row in hist:
            per[row["c"]].append((row["b"], row["n"], row["vmin"], row["vmax"]))
        if deferred:
            counts = {c: sum(r[1] for r in per[c]) for c in open_}
            need = {c: min(int(k), counts.get(c, 0)) for c, k in need(counts).items()}
            deferred = False
            for c in open_:
                if need.get(c, 0) <= 0:
                    cuts[c] = _Cut(lo=-math.inf, hi=None, r=0)
            open_ = [c for c in open_ if c not in cuts]
        for c in open_:
            st, k = state[c], need[c]
            rows = sorted(per[c])
            total = sum(r[1] for r in rows)
            if st["base"] + total < k:
                if st["hi"] is not None:  # the first guess was too narrow: widen
                    grown = st["lo"] + (st["hi"] - st["lo"]) * 4
                    st["hi"] = grown if grown < 1.0 else None
                    continue
                cuts[c] = _Cut(lo=math.inf, hi=None, r=0)  # fewer rows than asked: all
                continue
            cum = st["base"]
            for i, (_, n, vmin, vmax) in enumerate(rows):
                if cum + n >= k:
                    nxt = rows[i + 1][2] if i + 1 < len(rows) else st["hi"]
                    if cum + n == k:
                        cuts[c] = _Cut(lo=nxt if nxt is not None else math.inf, hi=None, r=0)
                    elif n <= max_boundary or vmin == vmax:
                        # few enough to rank, or rows that only the order columns tell apart
                        cuts[c] = _Cut(lo=vmin, hi=nxt, r=k - cum, tied=n > max_boundary)
                    else:
                        st["lo"], st["base"] = vmin, cum
                        st["hi"] = nxt if nxt is not None else math.nextafter(vmax, math.inf)
                    break
                cum += n
    for c in keys:
        if c not in cuts:  # not reached in practice; rank what is left
            st = state[c]
            cuts[c] = _Cut(lo=st["lo"], hi=st["hi"], r=need[c] - st["base"])
    return cuts, need


def select_smallest(df: DataFrame, cls: str, v: str, order_cols, need,
                    start_fraction: dict | None = None, flag: str | None = None,
                    classes=None, max_boundary: int | None = None) -> DataFrame:
    """Rows with the need[c] smallest (v, *order_cols) per class c.

    ``need`` may be a function of the class counts (see ``_resolve``).
    With ``flag`` every row is returned and the column ``flag`` tells
    whether it was selected (used for splits)."""
    columns = df.columns
    whole = F.xxhash64(*[F.col(f"`{x}`") for x in columns])
    cuts, _ = _resolve(df, cls, v, need, start_fraction, classes, max_boundary)
    levels: list[str] = []
    if any(cut.tied for cut in cuts.values()):
        made = [*order_levels(df, order_cols), whole]
        levels = [f"_order{i}" for i in range(len(made))]
        df = df.select("*", *[c.alias(n) for c, n in zip(made, levels)])
    below, edges, equal = F.lit(False), [], []
    for c, cut in cuts.items():
        is_c = F.col(cls) == F.lit(c)
        if cut.lo == math.inf:
            below = below | is_c
        elif cut.lo != -math.inf:
            below = below | (is_c & (F.col(v) < F.lit(cut.lo)))
            if cut.r <= 0:
                continue
            edge, r = is_c & (F.col(v) >= F.lit(cut.lo)), cut.r
            if cut.hi is not None:
                edge = edge & (F.col(v) < F.lit(cut.hi))
            if cut.tied:
                at = locate(df.filter(edge), levels, r, max_boundary or MAX_BOUNDARY)
                if at.past:  # all of them
                    below = below | edge
                    continue
                below = below | (edge & ~at.reached(levels))
                edge, r = edge & at.bucket(levels), r - at.before
                if r <= 0:
                    continue
                if at.least is None:  # equal in every column
                    equal.append((edge, r, at.rows))
                    continue
            edges.append((edge, r))
    # Boundary rows are ranked class by class in the whole order: few, whatever the input.
    # Rows equal in all order columns are told apart by a hash, equal rows need not be.
    w = Window.partitionBy(cls).orderBy(F.col(v), *[F.col(o).asc_nulls_last() for o in order_cols], whole)
    rank = lambda edge: df.filter(edge).withColumn("_rk", F.row_number().over(w))
    if flag:
        boundary = F.lit(False)
        for edge, *_ in [*edges, *equal]:
            boundary = boundary | edge
        out = df.filter(~F.coalesce(boundary, F.lit(False))).withColumn(flag, below)
        for edge, r in edges:
            out = out.unionByName(rank(edge).withColumn(flag, F.col("_rk") <= r).drop("_rk"))
        for edge, r, n in equal:
            out = out.unionByName(_copies(df.filter(edge).limit(1), n).withColumn(flag, F.col("_copy") < r).drop("_copy"))
    else:
        out = df.filter(below)
        for edge, r in edges:
            out = out.unionByName(rank(edge).filter(F.col("_rk") <= r).drop("_rk"))
        for edge, r, _ in equal:
            out = out.unionByName(_copies(df.filter(edge).limit(1), r).drop("_copy"))
    return out.drop(*levels)


COPIES_A_ROW = 1 << 16


def _copies(row: DataFrame, n: int) -> DataFrame:
    """``n`` copies of the only row, numbered from 0 in ``_copy``, made by many tasks."""
    chunks = -(-n // COPIES_A_ROW)
    many = row.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    if chunks > 1:
        many = many.repartition(min(chunks, 1024), "_chunk")
    first = F.col("_chunk") * COPIES_A_ROW
    last = F.least(first + COPIES_A_ROW, F.lit(n).cast("long")) - 1
    return many.withColumn("_copy", F.explode(F.sequence(first, last))).drop("_chunk")


def class_counts(df: DataFrame, y: str) -> dict:
    """{class: rows} — one small aggregate to the driver."""
    return {r[0]: r[1] for r in df.groupBy(y).count().collect()}


def _start(n: int, k: int) -> float | None:
    """Initial hash range expected to hold k rows plus a safety margin."""
    if k >= n:
        return None
    return min(1.0, (k + 6 * math.sqrt(k) + 16) / n)


def exact_k(df: DataFrame, y: str, need, key_cols, seed: int = vocab.SEED,
            counts: dict | None = None, flag: str | None = None, classes=(0, 1),
            cache_input: bool | None = None) -> DataFrame:
    """need[c] rows of class c, first in md5 order (all rows when fewer).

    ``need`` is a dict or a function of the class counts.  Without known
    counts, the first histogram round spans the whole hash range and also
    yields the counts, so no separate counting pass is made.  ``cache_input=False`` suits a written table, whose
    key and class are read again for less than a copy of its rows costs."""
    h = hash_text(seed, key_cols)
    ranked = df.withColumn("_h", h).withColumn("_v", hash_unit(F.col("_h")))
    if cache_input is None:
        cache_input = small_input(df)
    if cache_input:
        # read once per histogram round and once more at the end: keep the
        # hashed rows (memory, spilling to disk) for the duration
        ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    if counts is not None:
        if callable(need):
            need = need(counts)
        need = {c: min(int(k), counts.get(c, 0)) for c, k in need.items()}
        start = {c: _start(counts.get(c, 0), k) for c, k in need.items()}
        keep = list(need)
    else:
        start, keep = None, list(need) if not callable(need) else list(classes)
    try:
        out = select_smallest(ranked, y, "_v", ["_h", *key_cols], need, start, flag, classes=keep)
        if flag is None:
            out = out.filter(F.col(y).isin(keep)) if keep else out.limit(0)
        if flag:  # every row comes back: nothing is copied, the flag is an expression but for the boundary
            return out.drop("_h", "_v")
        # materialise the result in the reliable checkpoint folder (cuts lineage
        # for the training that usually follows) before the cache is released
        checkpoint_dir(df.sparkSession)
        return out.drop("_h", "_v").checkpoint(eager=True)
    finally:
        if cache_input:
            ranked.unpersist()


# ------------------------------------------------------------- samplers
def sample_n(df: DataFrame, n: int, key_cols, seed: int = vocab.SEED) -> DataFrame:
    """Exactly n rows without replacement; more than available is an error."""
    total = df.count()
    if n > total:
        raise ValueError(f"cannot take {n} rows from {total}")
    one = df.withColumn("_all", F.lit(0))
    return exact_k(one, "_all", {0: n}, key_cols, seed, {0: total}).drop("_all")


def balance_min(df: DataFrame, y: str, key_cols, cap: int | str | None = None,
                seed: int = vocab.SEED, cache_input: bool | None = None) -> DataFrame:
    """Both classes cut to the size of the smaller one (and to
    ``cap`` per class when given); an empty class is an error.  With
    ``cap=WHOLE`` neither is cut: every row of both classes comes back."""
    def smaller(counts):
        n0, n1 = counts.get(0, 0), counts.get(1, 0)
        if n0 == 0 or n1 == 0:
            raise ValueError(f"one class is empty: class0={n0}, class1={n1}")
        return min(n0, n1)

    def target(counts):
        t = min(smaller(counts), cap if cap is not None else counts[0])
        return {0: t, 1: t}

    if cap == WHOLE:
        smaller(class_counts(df, y))
        return df.filter(F.col(y).isin(0, 1))
    return exact_k(df.filter(F.col(y).isin(0, 1)), y, target, key_cols, seed, cache_input=cache_input)


def balance_target(df: DataFrame, y: str, k: int, key_cols,
                   seed: int = vocab.SEED) -> DataFrame:
    """Majority sampled down to min(n, k); minority (ties: class 0)
    replicated ceil(k/n) times, then exactly k drawn (also a cut when n > k);
    an empty minority stays empty.  Adds ``rep`` (copy number)."""
    counts = class_counts(df, y)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    minority, majority = (0, 1) if n0 <= n1 else (1, 0)
    n_min = counts.get(minority, 0)
    reps = math.ceil(k / n_min) if n_min else 0
    base = df.filter(F.col(y).isin(0, 1))
    rep = F.when(F.col(y) == minority, F.sequence(F.lit(1), F.lit(max(reps, 1)))).otherwise(
        F.array(F.lit(1)))
    copies = base.withColumn("rep", F.explode(rep.cast("array<bigint>")))
    new_counts = {minority: n_min * max(reps, 1), majority: counts.get(majority, 0)}
    need = {majority: min(counts.get(majority, 0), k), minority: k if n_min else 0}
    return exact_k(copies, y, need, [*key_cols, "rep"], seed, new_counts)


def ratio_sample(df: DataFrame, y: str, rows: int, pos_frac: float, key_cols,
                 seed: int = vocab.SEED, rounding: str = "half_even") -> DataFrame:
    """``rows`` rows with a share ``pos_frac`` of class 1.

    need_pos is rounded half-even (B8) or truncated (``rounding='floor'``,
    B9); a shortfall gives fewer rows (never an error)."""
    want = rows * pos_frac
    need_pos = int(round(want)) if rounding == "half_even" else int(want)
    need = {1: need_pos, 0: rows - need_pos}

    def quota(counts):
        short = {c: k - counts.get(c, 0) for c, k in need.items() if counts.get(c, 0) < k}
        if short:
            warnings.warn(f"not enough rows for the exact target; missing per class: {short}")
        return need

    return exact_k(df.filter(F.col(y).isin(0, 1)), y, quota, key_cols, seed)


def balance_to_class(df: DataFrame, y: str, key_cols, keep_class: int = 0, sample_class: int = 1,
                     seed: int = vocab.SEED, cache_input: bool | None = None) -> DataFrame:
    """Every row of ``keep_class`` is kept and ``sample_class`` is
    sampled down to the same count (an error when it has fewer rows)."""
    def quota(counts):
        n_keep, n_sample = counts.get(keep_class, 0), counts.get(sample_class, 0)
        if n_sample < n_keep:
            raise ValueError(f"cannot take {n_keep} rows of class {sample_class}: only {n_sample}")
        return {keep_class: n_keep, sample_class: n_keep}

    return exact_k(df.filter(F.col(y).isin(keep_class, sample_class)), y, quota, key_cols, seed,
                   classes=(keep_class, sample_class), cache_input=cache_input)


def first_n_per_class(df: DataFrame, y: str, n: int, order_cols, allow_partial: bool = True,
                      max_boundary: int | None = None) -> DataFrame:
    """B1: the first n rows of each class in ``order_cols`` order; when a
    class is short, both are cut to the smaller size (or an error without
    ``allow_partial``); an empty class is an error.  Rows without a value in
    the first order column come last."""
    first = order_cols[0]
    seen = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("lo"), F.max(first).alias("hi")).collect()
    counts = {r[0]: r.n for r in seen}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if n0 == 0 or n1 == 0:
        raise ValueError(f"no rows for one class: class0={n0}, class1={n1}")
    if min(n0, n1) < n:
        if not allow_partial:
            raise ValueError(f"not enough rows: class0={n0}, class1={n1}")
        n = min(n0, n1)
    ends = [(math.isnan(v), v) for r in seen for v in (r.lo, r.hi) if v is not None] or [(False, 0.0)]  # NaN sorts last
    lo, hi = float(min(ends)[1]), float(max(ends)[1])
    span = (hi - lo) or 1.0
    ranked = df.filter(F.col(y).isin(0, 1)).withColumn(
        "_v", F.coalesce((F.col(first).cast("double") - F.lit(lo)) / F.lit(span * (1 + 1e-9)), F.lit(2.0)))
    out = select_smallest(ranked, y, "_v", list(order_cols), {0: n, 1: n},
                          {0: None, 1: None}, max_boundary=max_boundary)
    return out.drop("_v")


def stratified_split(df: DataFrame, y: str, test_frac: float, key_cols,
                     seed: int = vocab.SEED, exact: bool = False, cache_input: bool | None = None) -> DataFrame:
    """Adds ``split`` = 'train' / 'test'.

    Default: a row is test when its hash falls below ``test_frac`` (no
    shuffle, stable, about test_frac per class).  ``exact=True`` takes
    exactly ceil(test_frac * n_c) rows of each class."""
    h = hash_unit(hash_text(seed, key_cols))
    if not exact:
        return df.withColumn("split", F.when(h < F.lit(test_frac), "test").otherwise("train"))
    counts = class_counts(df, y)
    need = {c: math.ceil(test_frac * n) for c, n in counts.items() if c is not None}
    flagged = exact_k(df.filter(F.col(y).isNotNull()), y, need, key_cols, seed, counts,
                      flag="_test", cache_input=cache_input)
    return flagged.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop(
        "_test")


def sample_fraction(df: DataFrame, frac: float, key_cols, seed: int = vocab.SEED) -> DataFrame:
    """Keep about ``frac`` of the rows (hash filter); no-op unless 0 < frac < 1."""
    if not 0 < frac < 1:
        return df
    return df.filter(hash_unit(hash_text(seed, key_cols)) < F.lit(frac))


def dedup_sample(df: DataFrame, frac: float, key_cols, seed: int = vocab.SEED,
                 cap: int | None = None) -> DataFrame:
    """Drop duplicate rows, keep a hash fraction, and when more than
    ``cap`` rows remain draw exactly ``cap`` of them (md5 order)."""
    out = sample_fraction(df.dropDuplicates(), frac, key_cols, seed)
    if cap is not None:
        n = out.limit(cap + 1).count()
        if n > cap:
            out = sample_n(out, cap, key_cols, seed)
    return out
