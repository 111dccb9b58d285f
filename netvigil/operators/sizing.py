"""Size decisions from the planner's file statistics (nothing is run for them), and tables written once for many reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from netvigil.session import checkpoint_dir, scratch_path

TRAINING_ROWS_A_TASK = 25_000  # a forest of 200 trees holds some 1 kB a row while it learns
TRAINING_PARTS = 24  # beyond them parts grow, up to LARGEST_PART times the rows: each part sends statistics of every open node
LARGEST_PART = 10
CACHE_MAX_BYTES = 512 << 30  # of input files


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files and literal rows below ``df``, as the planner knows them (no job).

    Counted at the leaves of the logical plan, so a join does not change it.  None where a leaf has no
    statistics of its own (rows from Python, an RDD, a checkpoint: the planner then assumes
    the largest size there is) or the plan cannot be seen (a remote session)."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    except AttributeError:
        return None
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() not in ("LogicalRelation", "LocalRelation", "Range", "OneRowRelation"):
            return None
        total += int(str(leaf.stats().sizeInBytes()))
    return total


def small_input(df: DataFrame) -> bool:
    """True when keeping ``df`` in the executors' cache is cheaper than reading its input again."""
    n = input_bytes(df)
    return n is not None and n <= CACHE_MAX_BYTES


BYTES_A_FILE = 32 << 20  # of input below a file that one task writes


def files_for(df: DataFrame, least: int) -> int:
    """How many files to write ``df`` into: ``least``, and more where a task would otherwise hold a large share of the input."""
    return max(least, -(-(input_bytes(df) or 0) // BYTES_A_FILE))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later passes read the columns they need, nothing is computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def training_rows(df: DataFrame, key_cols, rows_a_task: int = TRAINING_ROWS_A_TASK) -> DataFrame:
    """``df`` dealt by key into parts of about ``rows_a_task`` rows, in key order, and kept in the shared folder.

    Learners pass over their rows hundreds of times and hold a multiple of their size: the number of parts follows the
    rows, not the files or shuffles that the rows came from, so neither one task nor the overhead of many grows.  A forest
    adds up one table of statistics per part at every level, as large as its nodes are many: past ``TRAINING_PARTS`` parts
    the rows of a part grow first, and then the parts again.
    """
    checkpoint_dir(df.sparkSession)
    n = df.count()
    parts = max(1, min(-(-n // rows_a_task), max(TRAINING_PARTS, -(-n // (LARGEST_PART * rows_a_task)))))
    return df.repartition(parts, *key_cols).sortWithinPartitions(*key_cols).checkpoint(eager=True)
