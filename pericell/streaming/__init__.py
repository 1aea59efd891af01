"""Frames that arrive as files: running descriptor ranges, from which the scaler follows, and error sums of a model.

Files of extended XYZ are taken by Spark's own file stream, whose checkpoint says which
it has seen, in any store; a file is one row, so it has to be below 2 GB. Statistics of a
micro-batch are one state, named by the batch (operators.statistics): a batch that was
stopped and is run again replaces its state, so each frame counts once in the totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Model
from ..operators import sampling
from ..operators.metrics import residual
from ..operators.statistics import Ranges
from ..predict import predict_frames, predict_sized
from ..sources import extxyz


def frame_stream(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 16) -> DataFrame:
    """Parquet files of atoms or descriptors, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def running_ranges(stream: DataFrame, names: list[str]) -> DataFrame:
    """One row, kept up to date (complete mode): least and most of each component, and the number of rows."""
    return stream.groupBy().agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))])


def scaler_of(ranges: DataFrame, names: list[str]) -> DataFrame:
    return ranges.select(*[(1.0 / F.greatest(F.col(f"max_{n}") - F.col(f"min_{n}"), F.lit(1e-10))).alias(n) for n in names])


def xyz_stream(spark: SparkSession, folder: str, energy_key: str = "energy", files_a_batch: int = 16) -> DataFrame:
    """Frames as read_xyz gives them; frame_id tells frames apart by a hash of the file's path and the place in it."""
    fields = extxyz.FIELDS

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                for k, text in enumerate(extxyz.frames_of(path, content.decode().removesuffix("\n"))):
                    f = extxyz.parse_block(text, energy_key)
                    rows.append((path, k, *(f[name] for name in fields), text + "\n"))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "place", *fields, "block"])

    inner = [x.split(" ")[1] for x in extxyz.SCHEMA.split(", ")][1:]
    kinds = [pa.string(), pa.int64(), *(extxyz.KINDS[t] for t in inner)]
    schema = "path string, place bigint, " + ", ".join(extxyz.SCHEMA.split(", ")[1:])
    binary = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(binary).option("maxFilesPerTrigger", files_a_batch).load(folder).select("path", "content")
    return files.mapInArrow(parse, schema).select(F.xxhash64("path", "place").alias("frame_id"), *fields, "block")


#: Columns of frame_errors; their sums are the error sums, their numbers the coverage.
ERRORS = ("energy", "force", "virial", "stress")


def frame_errors(read: DataFrame, model: Model) -> DataFrame:
    """A row per frame: the energy's residual per atom, and squares of force (mean over components, a value for each
    atom's sum), virial and stress errors; null without a reference."""
    frames, atoms = extxyz.to_frames(read), sampling.type_ids(extxyz.to_atoms(read), list(model.shape.types))
    per_atom = predict_sized(atoms, frames.select("frame_id", "cell"), model)
    refs = atoms.select("frame_id", "atom_id", *[F.col(f"f{a}").alias(f"r{a}") for a in "xyz"])
    square = sum(((F.col(f"f{a}") - F.col(f"r{a}")) ** 2 for a in "xyz"), F.lit(0.0)) / 3
    force = per_atom.join(refs, ["frame_id", "atom_id"]).groupBy("frame_id").agg(F.sum(square).alias("force"))
    per = predict_frames(per_atom, frames.select("frame_id", "cell")).join(frames.select("frame_id", "energy", "virial"), "frame_id").join(force, "frame_id")
    six = list(zip(("xx", "yy", "zz", "xy", "yz", "zx"), (0, 4, 8, 1, 5, 6), strict=True))
    error = sum(((F.col(f"w_{n}") - F.col("virial")[k] / F.col("natoms")) ** 2 for n, k in six), F.lit(0.0)) / 6
    return per.select("frame_id", residual().alias("energy"), "force", error.alias("virial"), (error * (F.col("natoms") / F.col("volume")) ** 2).alias("stress"))


def keep_errors(stream: DataFrame, model: Model, folder: str, checkpoint: str) -> StreamingQuery:
    """Error sums of frames that arrive, as states in ``folder``, each frame once; ``Ranges(folder).merged`` has the totals."""
    ranges = Ranges(folder)

    def add(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            ranges.add(f"batch-{number:012d}", frame_errors(kept, model), list(ERRORS))
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
