"""Label normalisation: map text or numeric labels to 0/1 (or NULL = drop).

One function, several named profiles (the original tools disagree on
unknown text, numeric fallback and clipping; each profile keeps one
behaviour).  Everything is a CASE / map lookup on the JVM side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netvigil.functions import vocab
from netvigil.functions.mac import strip
from netvigil.functions.numeric import to_numeric_text

PROFILES = ("closed", "open", "strict", "named", "botnet", "small")


def _map_lookup(mapping: dict, key: Column) -> Column:
    """The value of ``key`` (NULL when absent); the key is computed once a row, not once a value."""
    table = F.create_map(*[F.lit(x) for item in mapping.items() for x in item])
    return F.try_element_at(table, key).cast("int")


def _truncate_to_int(x: Column) -> Column:
    # int() truncation toward zero; non-finite or out-of-range values are dropped
    return x.try_cast("int")


def _clip01(x: Column) -> Column:
    # greatest/least skip NULLs; a NULL (dropped) label must stay NULL
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0)), F.lit(1)))


def normalize_label(c, profile: str = "named", numeric_input: bool = False) -> Column:
    """Return an INT column with 0/1 (or other ints for ``open``) or NULL.

    Profiles:
      closed  lower-case text lookup, unknown (and NULL) -> 1; numeric
              input: NULL -> 1, truncated, clipped to 0..1
      open    trim+lower lookup, else numeric text truncated, else NULL
      strict  as open, but a fractional numeric label raises an error
      named   open with attack family names, clipped to 0..1
      botnet  open plus 'botnet'
      small   nine-key lookup only, no numeric fallback
    NULL means "drop this row" for every profile but closed.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown label profile {profile!r}; use one of {PROFILES}")
    col = F.col(c) if isinstance(c, str) else c
    text = col.cast("string")

    if profile == "closed":
        if numeric_input:
            num = to_numeric_text(text)
            return _clip01(F.coalesce(_truncate_to_int(num), F.lit(1)))
        key = F.coalesce(F.lower(text), F.lit("nan"))
        return F.coalesce(_map_lookup(vocab.LABELS_CLOSED, key), F.lit(1))

    key = F.lower(strip(text))
    if profile == "small":
        return _map_lookup(vocab.LABELS_SMALL, key)

    mapping = {"open": vocab.LABELS_OPEN, "strict": vocab.LABELS_OPEN,
               "named": vocab.LABELS_NAMED, "botnet": vocab.LABELS_BOTNET}[profile]
    mapped = _map_lookup(mapping, key)
    num = to_numeric_text(text)
    if profile == "strict":
        bad = num.isNotNull() & (num != F.floor(num))
        fallback = F.when(bad, F.raise_error(F.concat(F.lit("fractional label: "), text))
                          .cast("int")).otherwise(_truncate_to_int(num))
    else:
        fallback = _truncate_to_int(num)
    out = F.coalesce(mapped, fallback)
    if profile == "named":
        out = _clip01(out)
    return out


def label_from_keywords(c, benign=None, malicious=None) -> Column:
    """Keyword label (conn-log ``tunnel_parents``): NULL -> 0, any benign
    keyword -> 0, any malicious keyword -> 1, otherwise 0."""
    benign = vocab.KEYWORD_BENIGN if benign is None else benign
    malicious = vocab.KEYWORD_MALICIOUS if malicious is None else malicious
    col = F.col(c) if isinstance(c, str) else c
    s = F.lower(col.cast("string"))
    has_benign = None
    for w in benign:
        cond = s.contains(w)
        has_benign = cond if has_benign is None else (has_benign | cond)
    has_bad = None
    for w in malicious:
        cond = s.contains(w)
        has_bad = cond if has_bad is None else (has_bad | cond)
    return (F.when(col.isNull(), F.lit(0))
            .when(has_benign, F.lit(0))
            .when(has_bad, F.lit(1))
            .otherwise(F.lit(0)))


def pick_label(columns, candidates) -> str:
    """First candidate present in ``columns`` (a schema decision, made on
    the driver from column names only)."""
    for c in candidates:
        if c in columns:
            return c
    raise ValueError(f"no label column found; tried {list(candidates)}")
