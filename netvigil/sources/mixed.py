"""One folder, several headers (P2, S4, S8): files are grouped by their first line.

Every file's first line is read by a short job of its own (a task that stops after one line, ``THREADS`` at a
time), so no data are scanned for it; a line per file is all that reaches the driver.  Each distinct header is
one distributed scan of its files, with the columns it names.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from netvigil.functions import vocab
from netvigil.functions.labels import pick_label
from netvigil.operators.combine import union_labelled
from netvigil.sources import csv_parts

THREADS = 16
MAX_HEADERS = 200  # scans in one plan


def first_lines(spark: SparkSession, files: list[str], threads: int = THREADS) -> dict[str, str | None]:
    """First line of each file (None for an empty one)."""
    def head(path):
        row = spark.read.text(path).head()
        return row[0] if row is not None else None
    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(files, pool.map(head, files)))


def header_names(fields: list[str]) -> list[str]:
    """Column names of a header's fields; blank ones are numbered, repeated ones get a suffix, as pandas does."""
    names, seen = [], {}
    for i, name in enumerate(fields):
        name = name if name.strip() else f"Unnamed: {i}"
        k = seen.get(name, 0)
        seen[name] = k + 1
        names.append(f"{name}.{k}" if k else name)
    return names


@dataclass
class Header:
    fields: list[str]  # as they stand in the files
    columns: list[str]
    files: list[str]


def by_header(spark: SparkSession, path: str, glob: str = "*.csv", names=None) -> list[Header]:
    """The files under ``path``, by name, grouped by their headers (which may differ in case and blanks); empty files
    belong to none.  With ``names`` every file has those columns, with a header line or without one.
    """
    files = csv_parts.list_parts(spark, path, glob)
    if not files:
        raise FileNotFoundError(f"no parts matching {glob} under {path}")
    if names is not None:
        return [Header(list(names), list(names), files)]
    groups: dict[tuple[str, ...], Header] = {}
    for file, line in first_lines(spark, files).items():
        if line is not None:
            fields = next(csv.reader([line.removeprefix("\ufeff")]))
            key = tuple(f.strip().lower() for f in fields)
            groups.setdefault(key, Header(fields, header_names(fields), [])).files.append(file)
    if len(groups) > MAX_HEADERS:
        raise ValueError(f"{len(groups)} different headers under {path}; at most {MAX_HEADERS} are read together")
    return list(groups.values())


def read_mixed(spark: SparkSession, path: str, glob: str = "*.csv", names=None,
               candidates=vocab.LABEL_CANDIDATES_TESTSET, out: str = "label_raw") -> tuple[DataFrame, DataFrame]:
    """All files with a label column, united by name with the label copied to ``out``, and a report
    ``file, columns, label`` (NULL label: the file was skipped).

    The label column is the first of ``candidates`` that the file's own header has.  A folder without any
    labelled file is an error.
    """
    frames, report = [], []
    for h in by_header(spark, path, glob, names):
        try:
            label = pick_label(h.columns, candidates)
            frames.append(csv_parts.read_parts(spark, h.files, h.columns, header=h.fields))
        except ValueError:
            label = None
        report += [(f, h.columns, label) for f in h.files]
    table = spark.createDataFrame(report, "file string, columns array<string>, label string")
    if not frames:
        raise ValueError(f"no file under {path} has a label column")
    return union_labelled(frames, candidates, out), table
