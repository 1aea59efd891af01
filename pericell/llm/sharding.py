"""Contiguous shards of nearly equal bytes, by DataFrame functions only.

Documents are put in order of doc_id (null first; equal ids by size, then by the
checksum of the text) and dealt over partitions by ranges of it. The bytes of each
partition are summed, the sums of those before it give its first byte, and the cuts
are at equal shares of all bytes: a document belongs to the shard that holds its
middle byte. Only the few partitions with a cut inside need running sums over rows.

So a shard is off its equal share by at most one document at each of its ends. A
size is the UTF-8 bytes of the text and 1 for the row: a null or empty text has size 1
(a null text also has the checksum of the empty one), a very long text is one row
that can fill several shards' shares; those it covers whole stay empty. Repeated rows
are placed one after another. With fewer documents than shards some shards are empty;
an empty table gives an empty one. Groups of equal texts are not kept together and may
be of any size. ``sharded`` passes on all columns with their own values, whatever
their names; added ones are ``ADDED``, and columns of these names make it a ``ValueError``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered
from .store import written

LAW = "bytes"
ADDED = ("size", "text_crc32", "shard", "slot")


def measures() -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [(F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]


def _share(numerator: Column, total: str, shards: int, halves: int = 1) -> Column:
    """The shard at this byte; in decimals, since bytes times shards can pass 64 bits."""
    whole = numerator.cast("decimal(28,0)") * F.lit(shards).cast("decimal(9,0)")
    return F.least(F.call_function("div", whole, (F.col(total) * halves).cast("decimal(28,0)")), F.lit(shards - 1)).cast("int")


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32 and others) with shard and slot."""
    if shards < 1:
        raise ValueError("at least one shard")
    placed = numbered(rows, ("doc_id", "size", "text_crc32"), "in_order")
    sums = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    ahead = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select("part", "bytes", ahead("bytes").alias("byte"), ahead("rows").alias("row"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    low, high = _share(F.col("byte"), "total", shards), _share(F.col("byte") + F.col("bytes"), "total", shards)
    parts = written(sums.select("part", "byte", "row", "total", low.alias("low"), high.alias("high")), "parts")
    joined = placed.join(parts, "part")  # Spark broadcasts parts if its file is small
    whole = joined.where("low = high").withColumn("shard", F.col("low"))
    start = F.col("byte") + F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = joined.where("low < high").withColumn("shard", _share(2 * start + F.col("size"), "total", shards, 2))
    rank = (F.col("row") + F.col("pos")).alias("rank")
    first = parts.where("low = high").select(F.col("low").alias("shard"), F.col("row").alias("rank")).unionByName(cut.select("shard", rank))
    first = first.groupBy("shard").agg(F.min("rank").alias("first"))  # at most a row for each shard
    both = whole.select(*rows.columns, "shard", rank).unionByName(cut.select(*rows.columns, "shard", rank))
    return both.join(F.broadcast(first), "shard").select(*rows.columns, "shard", (F.col("rank") - F.col("first")).alias("slot"))


def plan(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document; texts are read once and not shuffled."""
    return _dealt(written(docs.select("doc_id", *measures()), "sizes"), shards)


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The documents in their order with ``ADDED``; write it with ``partitionBy("shard")``."""
    if clash := [c for c in docs.columns if c.lower() in ADDED]:
        raise ValueError(f"the documents have columns named like added ones: {clash}")
    packed = written(docs.select(F.struct(*docs.columns).alias("own"), "doc_id", *measures()), "sized")
    return _dealt(packed, shards).select("own.*", *ADDED)
