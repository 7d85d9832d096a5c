"""Rows dealt into partitions of bounded size.

Spark merges small shuffle partitions by their compressed bytes, so millions of rows of a few numbers each meet in one task, whose
memory grows with the input. A number of partitions that is given is left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a partition holds on average, at most.
MOST_ROWS = 200_000


def parts_for(*tables: DataFrame, most: int | None = None) -> int:
    """How many partitions keep the ``tables`` together at ``most`` rows each (MOST_ROWS), at least as many as shuffles have. Counts the rows."""
    rows = sum(table.count() for table in tables)
    return max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (most or MOST_ROWS)))
