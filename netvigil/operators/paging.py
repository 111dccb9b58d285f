"""One page of a sorted table without sorting the table.

The sort order is given as levels that compare natively (numbers, or pieces of a text as numbers).  The row at
which a page starts is looked for by histograms: the range of the first level is cut into ``BUCKETS``, the bucket that
holds the row is cut again, and where it holds a single value the next level goes on inside that value.
Each round is one small aggregate.  Two such searches, for the page's ends, bound the rows that have to be sorted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1024
MAX_SORTED = 20_000  # rows beyond which a bucket is cut further
CHUNK = 6  # bytes of a text in a level: below 2^48, exact as a number
MAX_ROUNDS = 400


def text_levels(column: str, chunks: int = 8) -> list[Column]:
    """The first bytes of a text as numbers that sort as the text does (texts sort by their bytes)."""
    raw = F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")
    return [F.conv(F.rpad(F.hex(F.substring(raw, 1 + i * CHUNK, CHUNK)), 2 * CHUNK, "0"), 16, 10).cast("long")
            for i in range(chunks)]


@dataclass
class Bound:
    """Rows before it come earlier: the values of the first levels, then a least value of the next one."""

    fixed: list = field(default_factory=list)
    least: object = None
    most: object = None  # greatest value of that level in the bucket that starts at the bound
    rows: int = 0  # rows of that bucket
    before: int = 0  # rows ahead of the bound
    past: bool = False  # the place is after the last row
    rounds: int = 0

    def reached(self, levels: list[str]) -> Column:
        """Whether a row is at or after the bound."""
        cond = F.lit(True) if self.least is None else F.col(levels[len(self.fixed)]) >= F.lit(self.least)
        for name, value in reversed(list(zip(levels, self.fixed))):
            cond = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & cond)
        return cond

    def bucket(self, levels: list[str]) -> Column:
        """Whether a row is in the bucket that starts at the bound."""
        cond = F.lit(True) if self.least is None else F.col(levels[len(self.fixed)]).between(F.lit(self.least), F.lit(self.most))
        for name, value in zip(levels, self.fixed):
            cond = cond & (F.col(name) == F.lit(value))
        return cond


def order_levels(df: DataFrame, columns) -> list[Column]:
    """Levels that rise with ``columns`` ascending, NULLs last."""
    out = []
    for c in columns:
        out.append(F.col(c).isNull().cast("int"))
        if isinstance(df.schema[c].dataType, T.NumericType):
            out.append(F.coalesce(F.col(c), F.lit(0)))
        else:
            out += text_levels(c)
    return out


def locate(df: DataFrame, levels: list[str], place: int, max_rows: int) -> Bound:
    """The last bound with at most ``place`` rows ahead of it that has few rows up to that place."""
    b = Bound()
    low = high = None  # range of the level that is searched
    while b.rounds < MAX_ROUNDS and len(b.fixed) < len(levels):
        level = levels[len(b.fixed)]
        inside = F.lit(True)
        for name, value in zip(levels, b.fixed):
            inside = inside & (F.col(name) == F.lit(value))
        rows = df.filter(inside)
        if low is None:
            ends = rows.agg(F.min(level).alias("lo"), F.max(level).alias("hi")).first()
            low, high = ends.lo, ends.hi
            b.rounds += 1
            if low is None:
                b.past = True
                return b
        rows = rows.filter(F.col(level).between(F.lit(low), F.lit(high)))
        width = float(high) - float(low)
        bucket = F.least(F.floor((F.col(level).cast("double") - F.lit(float(low))) / F.lit(width or 1.0) * BUCKETS),
                         F.lit(BUCKETS - 1))
        hist = sorted(rows.groupBy(bucket.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(level).alias("lo"), F.max(level).alias("hi")).collect())  # BUCKETS rows at most
        b.rounds += 1
        b.least = low
        for h in hist:
            if b.before + h.n > place:
                b.least, b.most, b.rows = h.lo, h.hi, h.n
                break
            b.before += h.n
        else:
            b.past = True
            return b
        if h.n <= max_rows:
            return b
        if h.lo == h.hi:
            b.fixed.append(h.lo)
            b.least = b.most = low = high = None
        else:
            low, high = h.lo, h.hi
    return b


def page_rows(df: DataFrame, levels: list[Column], order: list[Column], start: int, size: int, total: int,
              number: str = "row_no", max_sorted: int = MAX_SORTED) -> DataFrame:
    """Rows ``start .. start + size - 1`` of ``df`` (``total`` rows) in ``order``, numbered from 1 in ``number``.

    ``levels`` must rise with ``order`` (rows equal in the former may still differ in the latter).  ``df`` is read
    several times: it should be a written table.
    """
    near, before, names = df, 0, []
    if total > max_sorted:
        names = [f"_level{i}" for i in range(len(levels))]
        rows = df.select("*", *[c.alias(n) for c, n in zip(levels, names)])
        first, end = (locate(rows, names, at, max_sorted) for at in (start, start + size))
        if first.past:
            return df.limit(0).withColumn(number, F.lit(0).cast("long"))
        near, before = rows.filter(first.reached(names)), first.before
        if not end.past:  # of the bucket in which the page ends its first rows
            last = near.filter(end.reached(names)).orderBy(*order).limit(start + size - end.before)
            near = near.filter(~end.reached(names)).unionByName(last)
    place = (F.row_number().over(Window.orderBy(*order)) + F.lit(before)).cast("long")
    return near.withColumn(number, place).filter(F.col(number).between(start + 1, start + size)).drop(*names)
