"""Connected components of links, by large-star and small-star rounds on DataFrames.

Each round replaces links by links to the least neighbour; lineage is cut after
each by a written table. Nothing is collected but one checksum a round. Hot nodes
(a star with a large share of all links) are grouped with partial aggregation, and
the least neighbours are joined as a table of their own: sent whole while they are
few, else by a sort-merge join, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructType

from .store import drop, written

BROADCAST_BYTES = 64 << 20


def _bytes(kind: DataType, column: Column) -> Column:
    if isinstance(kind, StructType):
        return sum((_bytes(f.dataType, column[f.name]) for f in kind), F.lit(16))
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    return F.lit(8)


def small(table: DataFrame) -> DataFrame:
    """A written table of numbers, texts and structs of these, marked for broadcast while its rows, measured, take at most BROADCAST_BYTES."""
    row = sum((_bytes(f.dataType, F.col(f.name)) for f in table.schema), F.lit(16))
    size = table.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of the larger neighbours to the least of the closed neighbourhood; and a table to drop later."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    out = both.where("b > a").join(small(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct(), least


def _small_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of the smaller neighbours to the least of them, and of each node to its least."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(small(least), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), least


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every node of ``links`` (a, b: long), as a written table; root is the least id of its component.

    A link of a node with itself is left out; repeated links count once. No links give no rows.
    """
    spark = links.sparkSession
    now, seen = written(links.select("a", "b").where("a != b").distinct(), "links"), None
    while True:
        for star in (_large_star, _small_star):
            moved, least = star(now)
            moved = written(moved, "links")
            drop(spark, least, now)
            now = moved
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    out = written(now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select("b", "b").distinct()), "components")
    drop(spark, now)
    return out
