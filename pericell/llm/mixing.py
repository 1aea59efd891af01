"""Mixing sources to target weights, by DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ... and share
the words of all sources; a target stops at ``most`` times its source's words
and what is above is shared again by weight. That fixed point is found in closed
form: with sources ordered by cap / weight, the level is (total - caps before) /
(weights from here on) at the first source it does not exceed. A document is
emitted floor(rate) times, and once more if a hash of its id, seeded, is below
the fraction of the rate.

A null text has 0 words and is never emitted more than its rate says. A null id
is hashed as "null". Repeated rows draw alike. An empty table gives an empty one.
Very long texts count by their words like others. Sources of equal cap / weight
are taken by code point. ``repetition`` replaces columns of the documents that have
the names of added ones (``ADDED``) and passes on all others, whatever their names;
``mix`` passes on all columns with their own values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .words import unused

BROADCAST_ROWS = 50_000
ADDED = ("size", "source_size", "target", "rate", "copies")
SEPARATORS = r"[\x20\x09-\x0D]"
LETTERS = r"[^\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Runs of characters other than 0x20, 0x09-0x0D: each run with what surrounds it becomes one character."""
    one = F.length(F.regexp_replace(text, f"{SEPARATORS}*{LETTERS}+{SEPARATORS}*", "x"))
    return F.when(text.rlike(LETTERS), one).otherwise(0).cast("long")


def rates(sized: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size, target, rate from documents with source and size: one row per source."""
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1)
    ahead = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = ahead.rowsBetween(Window.unboundedPreceding, -1), ahead.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    own = own.withColumn("cap", most * F.col("source_size"))
    level = (F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    own = own.withColumn("level", level).withColumn("free", F.col("level") <= F.col("cap") / F.col("weight"))
    shared = F.max(F.when(F.col("free"), F.col("level"))).over(everywhere) * F.col("weight")
    target = F.when(F.col("free"), shared).otherwise(F.col("cap")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return own.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key: 52 bits of MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def repetition(docs: DataFrame, seed: int = 42, most: int = 3) -> DataFrame:
    """The documents with size, source_size, target, rate and copies."""
    own = [c for c in docs.columns if c.lower() not in ADDED]
    x = unused(docs.columns)
    sized = docs.select(*own).withColumn("size", n_words(F.coalesce(F.col("text"), F.lit(""))))
    per = written(rates(sized.select("source", "size"), most), "rates").withColumnRenamed("source", x)
    if per.count() <= BROADCAST_ROWS:  # one row per source; beyond, a shuffled join, whose hot sources AQE splits
        per = F.broadcast(per)
    joined = sized.join(per, sized["source"].eqNullSafe(per[x]), "left")
    whole = F.floor("rate").cast("long")
    copies = whole + (draw(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.select(*own, "size", "source_size", "target", "rate", copies.alias("copies"))


def mix(docs: DataFrame, seed: int = 42, most: int = 3) -> DataFrame:
    """The documents, each as often as the mix takes it, with their own columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    plan = repetition(packed, seed, most).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
