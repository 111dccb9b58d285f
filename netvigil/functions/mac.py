"""MAC address helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


WHITESPACE = " \t\n\r\f\v"


def strip(c) -> Column:
    """Trim surrounding whitespace (spaces, tabs, line breaks); a plain
    character-set trim, no regular expression per row."""
    col = F.col(c) if isinstance(c, str) else c
    return F.btrim(col, F.lit(WHITESPACE))


def mac_prefix(c) -> Column:
    """Vendor prefix of a MAC: trim, upper-case, '-' -> ':', first three
    parts joined by ':'; NULL for blank input or fewer than three parts."""
    col = F.col(c) if isinstance(c, str) else c
    parts = F.split(F.translate(F.upper(strip(col.cast("string"))), "-", ":"), ":", -1)
    return F.when(col.isNotNull() & (col.cast("string") != "") & (F.size(parts) >= 3),
                  F.array_join(F.slice(parts, 1, 3), ":"))
