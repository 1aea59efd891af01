"""Seeded splits, shuffles and shards, by ranks of hashes: the same on any cluster and in any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RANGE = 4  # hexadecimal digits of a hash


def order_hash(key: Column, *seeds: int) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(str(s)) for s in seeds], key.cast("string")).cast("binary"))


def holdout_size(n: int, ratio: float, seed: int | None) -> int:
    """max(1, round(ratio n)) with half-even rounding."""
    if seed is None:
        raise ValueError("a split needs a seed")
    if not 0 < ratio < 1:
        raise ValueError("the ratio must be inside (0, 1)")
    size = max(1, round(ratio * n))
    if size >= n:
        raise ValueError("no frame would be left for training")
    return size


def split(frames: DataFrame, ratio: float, seed: int, n: int | None = None) -> DataFrame:
    """frames with ``valid``: exactly the holdout size, the same frames for the same seed.

    The threshold is the hash of that rank. Hashes are counted by their first RANGE digits (16**RANGE
    numbers, whatever the size); only those of the one range that holds the rank are then ranked.
    """
    size = holdout_size(frames.count() if n is None else n, ratio, seed)
    hashed = frames.select("frame_id").select(order_hash(F.col("frame_id"), seed).alias("h")).withColumn("r", F.substring("h", 1, RANGE))
    left = size
    for where, count in sorted((row["r"], row["count"]) for row in hashed.groupBy("r").count().collect()):
        if left <= count:
            break
        left -= count
    last = hashed.where(F.col("r") == where).orderBy("h").limit(left).agg(F.max("h")).first()[0]
    return frames.withColumn("valid", order_hash(F.col("frame_id"), seed) <= F.lit(last))


def batches(frames: DataFrame, seed: int, epoch: int, batch_size: int) -> DataFrame:
    """frames with ``batch``: an order by hash of seed and epoch, cut into batches. Ranks are taken
    inside 16**RANGE hash ranges, and the sizes of the ranges before are added."""
    hashed = frames.withColumn("_h", order_hash(F.col("frame_id"), seed, epoch)).withColumn("_b", F.substring("_h", 1, RANGE))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = hashed.groupBy("_b").count().withColumn("_ahead", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", "frame_id")) - 1
    placed = hashed.withColumn("_r", rank).join(F.broadcast(sizes), "_b")
    return placed.withColumn("batch", F.floor((F.col("_r") + F.col("_ahead")) / batch_size).cast("long")).drop("_h", "_b", "_r", "_ahead")


def shard(frames: DataFrame, shards: int) -> DataFrame:
    """frames with ``shard``; sizes need not be padded."""
    return frames.withColumn("shard", F.pmod(F.conv(F.substring(order_hash(F.col("frame_id"), 0), 1, 8), 16, 10).cast("long"), F.lit(shards)))


def offsets(frames: DataFrame, span: int = 4096) -> DataFrame:
    """Exclusive running sums of natoms in order of frames.

    Ranges of ``span`` frame ids are summed, then ranges of ``span`` such ranges; each window spans
    one range, and the last one a row for ``span`` * ``span`` ids.
    """
    ahead = lambda part, by, what: F.coalesce(F.sum(what).over((Window.partitionBy(part) if part else Window).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranged = frames.withColumn("_b", F.floor(F.col("frame_id") / span))
    small = ranged.groupBy("_b").agg(F.sum("natoms").alias("_n")).withColumn("_c", F.floor(F.col("_b") / span))
    large = small.groupBy("_c").agg(F.sum("_n").alias("_m")).withColumn("_far", ahead(None, "_c", "_m")).select("_c", "_far")
    near = small.withColumn("_near", ahead("_c", "_b", "_n")).join(large, "_c").select("_b", (F.col("_near") + F.col("_far")).alias("_ahead"))
    own = ranged.withColumn("_own", ahead("_b", "frame_id", "natoms"))
    return own.join(near, "_b").withColumn("offset", (F.col("_own") + F.col("_ahead")).cast("long")).drop("_b", "_own", "_ahead")


def present_types(atoms: DataFrame, types: DataFrame) -> DataFrame:
    """Types (type, symbol) that some atom has."""
    return types.join(atoms.select("type").distinct(), "type", "left_semi")


def removed_types(atoms: DataFrame, types: DataFrame) -> DataFrame:
    return types.join(atoms.select("type").distinct(), "type", "left_anti")


def type_ids(atoms: DataFrame, symbols: list[str]) -> DataFrame:
    """species to its place in the list; an unknown symbol raises."""
    at = F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col("species")) - 1
    known = F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown species: "), F.col("species"))).cast("long"))
    return atoms.withColumn("type", known.cast("int"))
