"""Rows in a global order, numbered without a window over all of them.

The rows are dealt by ranges of the order's columns and sorted within them; each
keeps the number of its partition and its place there. Sums over the partitions
before (one row a partition) turn these into global ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import unused


def numbered(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` written in this order (nulls first) with ``part`` and ``pos``, which they must not have.

    Rows that are equal in all of ``order`` take any order among themselves; their place in the input
    tells them apart, so a third of all rows may be equal without meeting in one task. ``rows`` is read
    twice, once for the bounds of the ranges, so it should be a written table.
    """
    tie = unused(rows.columns)
    keys = [*(F.col(c).asc_nulls_first() for c in order), F.col(tie).asc()]
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits, the row's below
    placed = dealt.select(*rows.columns, at.alias(tie))
    return written(placed.select(*rows.columns, F.shiftright(tie, 33).alias("part"), F.col(tie).bitwiseAND((1 << 33) - 1).alias("pos")), name)
