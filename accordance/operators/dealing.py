"""How many tasks a shuffle is dealt to.

Spark sizes tasks by bytes as they are written, and long tables of fields compress ten times and more, so a task that sorts them
holds far more than it seems to read. Dealt by rows, what a task holds doesn't grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task. Up to MANY tasks Spark writes a shuffle without holding its rows, so beyond that tasks first grow to MOST rows.
ROWS, MANY, MOST = 500_000, 200, 4_000_000


def tasks(rows: int) -> int:
    """Tasks for so many rows."""
    return max(1, min(-(-rows // ROWS), MANY), -(-rows // MOST))


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to the tasks that about ``rows`` rows need, at least one a core; as it is without ``rows``."""
    return df if rows is None else df.repartition(max(tasks(rows), df.sparkSession.sparkContext.defaultParallelism), *keys)
