"""Statistics that are kept by range of the data and merged, so that new data costs a pass over itself only.

A state has for each column the number of values that are not null, the least and the
most, and the sums of values and of squares. Each sum is two doubles that together
hold it to twice a double's digits, so merging in any order and grouping gives the same
doubles as one pass, but in cases that lie on the edge of rounding at that depth. A range's
state is one small file named by the range: to add it again replaces it, so a range
that was lost halfway is simply done again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from math import fsum

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

STATE = "name string, n bigint, least double, most double, high double, low double, square_high double, square_low double"
NAMES = [x.split(" ")[0] for x in STATE.split(", ")]
KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}
ARROW = pa.schema([(x.split(" ")[0], KINDS[x.split(" ")[1]]) for x in STATE.split(", ")])


def exact(values: list[float]) -> tuple[float, float]:
    """A sum as a double and what it lacks."""
    high = fsum(values)
    return high, fsum([*values, -high]) if np.isfinite(high) else 0.0


def product(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares as two doubles: the halves of each factor multiply without loss."""
    big = x * 134217729.0
    top = big - (big - x)
    rest = x - top
    square = x * x
    return square, ((top * top - square) + 2 * top * rest) + rest * rest


def measured(name: str, x: np.ndarray) -> tuple:
    if not len(x):
        return name, 0, None, None, 0.0, 0.0, 0.0, 0.0
    square, lost = product(x)
    return name, len(x), float(x.min()), float(x.max()), *exact(x.tolist()), *exact([*square.tolist(), *lost.tolist()])


def merged(states: pa.Table) -> pa.Table:
    """One row a column."""
    rows: dict[str, list[dict]] = {}
    for r in states.to_pylist():
        rows.setdefault(r["name"], []).append(r)
    out = []
    for name, own in sorted(rows.items()):
        edge = lambda f, k: f((r[k] for r in own if r[k] is not None), default=None)
        total = lambda a, b: exact([r[k] for r in own for k in (a, b)])
        out.append((name, sum(r["n"] for r in own), edge(min, "least"), edge(max, "most"), *total("high", "low"), *total("square_high", "square_low")))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(NAMES), ARROW.types, strict=True)], NAMES)


def state(df: DataFrame, columns: list[str]) -> pa.Table:
    """The state of a DataFrame's columns: summed in tasks, then by column in groups of tasks, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(c, batch.column(c).drop_null().to_numpy().astype(float)) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], NAMES)

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInArrow(partial, STATE)
    grouped = parts.withColumn("part", F.spark_partition_id() % 64).groupBy("part").applyInArrow(merged, STATE)
    return merged(grouped.toArrow().cast(ARROW))  # 64 rows a column at most


class Ranges:
    """States of the ranges of a dataset, in a folder of any store."""

    def __init__(self, folder: str):
        self.folder = folder

    def keys(self) -> list[str]:
        return [n.removesuffix(".parquet") for n in storage.listed(self.folder) if n.endswith(".parquet")]

    def add(self, key: str, df: DataFrame, columns: list[str]) -> None:
        buffer = pa.BufferOutputStream()
        pq.write_table(state(df, columns), buffer)
        storage.commit(storage.join(self.folder, f"{key}.parquet"), buffer.getvalue().to_pybytes())

    def update(self, paths: list[str], read: Callable[[str], DataFrame], columns: list[str]) -> list[str]:
        """Adds the paths that have no state yet, and gives them; the others are not read."""
        known = set(self.keys())
        new = [p for p in paths if md5(p.encode()).hexdigest() not in known]
        for path in new:
            self.add(md5(path.encode()).hexdigest(), read(path), columns)
        return new

    def merged(self, spark: SparkSession) -> DataFrame:
        """name, n, least, most, total, square: one row a column, from all ranges' states by a read in Spark."""
        states = spark.read.schema(STATE).parquet(self.folder)
        one = states.groupBy("name").applyInArrow(merged, STATE)
        return one.select("name", "n", "least", "most", F.col("high").alias("total"), F.col("square_high").alias("square"))


def scalers(found: DataFrame) -> DataFrame:
    """name and 1 / max(most - least, 1e-10)."""
    return found.select("name", (1.0 / F.greatest(F.col("most") - F.col("least"), F.lit(1e-10))).alias("scaler"))
