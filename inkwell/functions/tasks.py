"""How many tasks rows are dealt out to where each task holds its share in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a task: with the session's number of shuffle partitions alone a task would grow with the input.
ROWS_A_TASK = 250_000


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows, of which there are about n, by keys: as many partitions as the session has for shuffles, more where a task
    would have over ROWS_A_TASK of them."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_TASK)), *keys)
