"""Labelled frames with their neighbor pairs: found once, kept as a table, read by batches of an epoch.

A frame is one row whose arrays are packed bytes (little-endian), so a task reads it
without a pass over its pairs; its size bounds it. The table is bucketed by frame id:
an epoch's order, a few bytes a frame, is shuffled to the buckets and the frames stay
where they are. For an epoch the frames are then laid out by batch, one folder each, so
a step reads its own rows and no others; an epoch reads every row of the layout once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .kernels.pairs import frame_pairs
from .kernels.potential import Batch
from .operators import sampling

PACKED = "frame_id bigint, n int, type binary, i binary, j binary, r binary, volume double, energy double, forces binary, virial binary"
NAMES = [f.split(" ")[0] for f in PACKED.split(", ")]
KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
ARROW = [KINDS[f.split(" ")[1]] for f in PACKED.split(", ")]
#: Frames in one call of a kernel.
CALL = 64
#: Rows can be large: while they are read and handed to Python, few at a time.
SMALL_BATCHES = {"spark__sql__parquet__columnarReaderBatchSize": "64", "spark__sql__execution__arrow__maxRecordsPerBatch": "256", "spark__sql__execution__arrow__maxBytesPerBatch": str(16 << 20)}


@dataclass
class Frame:
    """A labelled frame with its pairs; a missing label is None."""

    frame_id: int
    type: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]
    volume: float
    energy: float | None
    forces: np.ndarray | None
    virial: np.ndarray | None

    @property
    def n(self) -> int:
        return len(self.type)


def prepare(frame_id, types, xyz, cell, cutoff, energy=None, forces=None, virial=None) -> Frame:
    """With its pairs found."""
    cell = np.reshape(np.asarray(cell, float), (3, 3))
    known = lambda x: None if x is None or np.isnan(np.asarray(x, float)).any() else np.asarray(x, float)
    energy = known(energy)
    return Frame(int(frame_id), np.asarray(types), frame_pairs(np.asarray(xyz, float), cell, cutoff), abs(float(np.linalg.det(cell))), None if energy is None else float(energy), known(forces), known(virial))


def collate(frames: list[Frame]) -> Batch:
    at = np.cumsum([0, *(f.n for f in frames)])
    return Batch(
        np.concatenate([f.type for f in frames]),
        np.repeat(np.arange(len(frames)), np.diff(at)),
        np.concatenate([f.pairs[0] + a for f, a in zip(frames, at, strict=False)]),
        np.concatenate([f.pairs[1] + a for f, a in zip(frames, at, strict=False)]),
        np.concatenate([f.pairs[2] for f in frames]),
    )


def gathered(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """A row per frame with its atoms as arrays in order. A frame is one row: its size bounds it."""
    order = lambda *cols: F.sort_array(F.collect_list(F.struct("atom_id", *cols)))
    have = [c for c in ("fx", "fy", "fz") if c in atoms.columns]
    per = atoms.groupBy("frame_id").agg(order("type", "x", "y", "z", *have).alias("a"))
    flat = lambda *names: F.flatten(F.transform("a", lambda r: F.array(*[r[n] for n in names])))
    forces = F.when(F.forall("a", lambda r: r["fx"].isNotNull()), flat("fx", "fy", "fz")) if have else F.lit(None).cast("array<double>")
    virial = F.col("virial") if "virial" in frames.columns else F.lit(None).cast("array<double>")
    return per.join(frames, "frame_id").select("frame_id", F.transform("a", lambda r: r["type"]).alias("type"), flat("x", "y", "z").alias("xyz"), "cell", "energy", forces.alias("forces"), virial.alias("virial"))


def to_frame(row, cutoff: float) -> Frame:
    shaped = lambda x: None if x is None else np.reshape(x, (-1, 3))
    return prepare(row["frame_id"], row["type"], shaped(row["xyz"]), row["cell"], cutoff, row["energy"], shaped(row["forces"]), row["virial"])


def pack(f: Frame) -> tuple:
    i, j, r = f.pairs
    data = lambda x, kind: None if x is None else np.ascontiguousarray(x, kind).tobytes()
    return f.frame_id, f.n, data(f.type, "<i4"), data(i, "<i4"), data(j, "<i4"), data(r, "<f8"), f.volume, f.energy, data(f.forces, "<f8"), data(f.virial, "<f8")


def unpacked(batch: pa.RecordBatch) -> list[Frame]:
    array = lambda x, kind: None if x is None else np.frombuffer(x, kind)
    whole = lambda x: array(x, "<i4").astype(np.int64)
    shaped = lambda x: None if x is None else array(x, "<f8").reshape(-1, 3)
    rows = zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True)
    return [Frame(k, whole(t), (whole(i), whole(j), shaped(r)), volume, energy, shaped(forces), array(virial, "<f8")) for k, _, t, i, j, r, volume, energy, forces, virial in rows]


@dataclass
class Step:
    """The rows of one batch of an epoch, and its frames with energy, atoms with forces and frames with virial."""

    rows: DataFrame
    total: tuple[int, int, int]


class FrameStore:
    """``rows`` as from gathered(). Close it when done; ``built`` counts frames whose pairs were searched, ``read`` rows given to passes."""

    def __init__(self, rows: DataFrame, cutoff: float, groups: int | None = None):
        self.spark = spark = rows.sparkSession
        self.groups = groups or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.built, self.read = (spark.sparkContext.accumulator(0) for _ in range(2))
        built = self.built

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), CALL):
                    found = [pack(to_frame(r, cutoff)) for r in batch.slice(lo, CALL).to_pylist()]
                    built.add(len(found))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), ARROW, strict=True)], NAMES)

        self.path, self.name = storage.new_path(spark, "frames"), f"pericell_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.groups, "frame_id").mapInArrow(build, PACKED)
        with storage.settings(spark, **SMALL_BATCHES):
            dealt.write.bucketBy(self.groups, "frame_id").sortBy("frame_id").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.n = self.table().count()

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        storage.delete(self.path)

    def frames(self) -> DataFrame:
        """frame_id, natoms, volume, energy, virial."""
        number = lambda f: F.when(F.col("virial").isNotNull(), f)

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = [None if x is None else np.frombuffer(x, "<f8") for x in batch.column("virial").to_pylist()]
                yield batch.set_column(batch.schema.get_field_index("virial"), "virial", pa.array(v, pa.list_(pa.float64())))

        rows = self.table().select("frame_id", F.col("n").alias("natoms"), "volume", "energy", number(F.col("virial")).alias("virial"))
        return rows.mapInArrow(values, "frame_id bigint, natoms int, volume double, energy double, virial array<double>")

    def atoms(self) -> DataFrame:
        """frame_id, atom_id, type and reference forces."""

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, n, t, f in zip(*(batch.column(c).to_pylist() for c in ("frame_id", "n", "type", "forces")), strict=True):
                    forces = np.frombuffer(f, "<f8").reshape(-1, 3).T if f is not None else [pa.nulls(n, pa.float64())] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k)), pa.array(np.arange(n)), pa.array(np.frombuffer(t, "<i4")), *(x if f is None else pa.array(np.ascontiguousarray(x)) for x in forces)], ["frame_id", "atom_id", "type", "fx", "fy", "fz"])

        return self.table().select("frame_id", "n", "type", "forces").mapInArrow(spread, "frame_id bigint, atom_id bigint, type int, fx double, fy double, fz double")

    def epoch(self, seed: int, epoch: int, size: int) -> Iterator[Step]:
        """The batches of an epoch in order; its layout is deleted at the end."""
        order = sampling.batches(self.table().select("frame_id"), seed, epoch, size)
        labels = self.table().select("frame_id", "n", "energy", F.col("forces").isNotNull().alias("f"), F.col("virial").isNotNull().alias("v"))
        total = [F.count("energy"), F.coalesce(F.sum(F.when(F.col("f"), F.col("n"))), F.lit(0)), F.count(F.when(F.col("v"), 1))]
        counts = {r[0]: tuple(int(x) for x in r[1:]) for r in labels.join(order, "frame_id").groupBy("batch").agg(*total).collect()}  # a row a step
        path, tasks = storage.new_path(self.spark, f"epoch{epoch}"), max(1, min(self.groups, -(-size // CALL)))
        laid = self.table().join(order, "frame_id").repartition(self.groups, "batch", F.pmod(F.xxhash64("frame_id"), F.lit(tasks)))
        with storage.settings(self.spark, **SMALL_BATCHES):
            laid.write.partitionBy("batch").option("compression", "zstd").parquet(path)
        try:
            for k in range(len(counts)):
                yield Step(self.spark.read.schema(PACKED).parquet(f"{path}/batch={k}"), counts[k])
        finally:
            storage.delete(path)

    def fold(self, rows: DataFrame, run: Callable[[list[Frame]], np.ndarray], combine: Callable = np.add) -> np.ndarray:
        """``run`` on groups of frames; what it gives is combined in each task, then in a few, then here."""
        few, read = max(1, int(self.groups**0.5)), self.read

        def row(found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([found.astype("<f8").tobytes()], pa.binary())], ["x"])

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                read.add(len(batch))
                for lo in range(0, len(batch), CALL):
                    one = run(unpacked(batch.slice(lo, CALL)))
                    found = one if found is None else combine(found, one)
            if found is not None:
                yield row(found)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                for x in batch.column("x"):
                    one = np.frombuffer(x.as_py(), "<f8")
                    found = one if found is None else combine(found, one)
            if found is not None:
                yield row(found)

        with storage.settings(self.spark, **SMALL_BATCHES):
            parts = rows.mapInArrow(go, "x binary").repartition(few).mapInArrow(add, "x binary").collect()  # ``few`` rows, of the model's size
        out = None
        for r in parts:
            one = np.frombuffer(r["x"], "<f8")
            out = one if out is None else combine(out, one)
        return out
