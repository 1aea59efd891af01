"""Frames that fit into a task: their atoms are dealt once, and what is asked of their pairs is found where they land.

Atoms are clustered by frame and go through a task as a stream. Whole frames are cut from it, a few thousand atoms
at a time, so a task's memory does not grow with its share; no pair is sent. Frames too large to be held by
a task go by bins (neighbors.cell_list_pairs) or by blocks of space (operators.blocks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.pairs import binned_pairs, many_pairs

#: Atoms that are looked at together.
CALL = 8192
#: Rows a task when rows are dealt by frame.
ROWS_A_TASK = 1 << 18


def spread(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """Rows dealt by ``key`` to tasks in proportion to their number. The number of tasks is given, since adaptive execution
    would put a session's partitions together to few of up to 64 MB compressed, millions of rows each."""
    parts = -(-rows // ROWS_A_TASK)
    return df.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism), *key) if parts > 1 else df


def clustered(atoms: DataFrame, frames: DataFrame, *more: str) -> DataFrame:
    """Atoms with their frame's cell (null where there is none), a frame's atoms one after the other.

    By a merge join: both sides are dealt by frame anyway, and frames whose cells compress well would be broadcast by the millions.
    """
    both = atoms.select("frame_id", "atom_id", "type", "x", "y", "z", *more).join(frames.select("frame_id", "cell").hint("merge"), "frame_id", "left")
    return both.withColumn("natoms", F.count(F.lit(1)).over(Window.partitionBy("frame_id")))


def whole(batches: Iterator[pa.RecordBatch], least: int = CALL) -> Iterator[pa.Table]:
    """Whole frames of a stream in which their rows follow each other, about ``least`` rows at a time."""
    kept: list[pa.RecordBatch] = []
    held, enough = 0, least
    for batch in batches:
        for lo in range(0, len(batch), least):
            kept.append(batch.slice(lo, least))
            held += len(kept[-1])
            if held < enough:
                continue
            table = pa.Table.from_batches(kept).combine_chunks()
            frame = table.column("frame_id").to_numpy()
            cut = held - int(np.argmax(frame[::-1] != frame[-1])) if frame[0] != frame[-1] else 0
            if cut:
                yield table.slice(0, cut)
            kept = table.slice(cut).to_batches()
            held -= cut
            enough = max(least, 2 * held)
    if held:
        yield pa.Table.from_batches(kept).combine_chunks()


class Chunk:
    """Whole frames end to end, as arrays."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.frame = table.column("frame_id").to_numpy()
        self.first = np.flatnonzero(np.concatenate([[True], self.frame[1:] != self.frame[:-1]]))
        self.type = table.column("type").fill_null(-1).to_numpy().astype(np.int64)
        self.xyz = np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1)
        cell = table.column("cell").take(pa.array(self.first)).combine_chunks()
        self.known = cell.is_valid().to_numpy(zero_copy_only=False)
        self.cells = np.zeros((len(self.first), 3, 3))
        self.cells[self.known] = cell.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3)
        self.sizes = np.diff(np.append(self.first, len(self.frame)))

    def pairs(self, cutoff: float, find: Callable = many_pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """i (ascending), j and r of all pairs; frames without a cell have none."""
        if self.known.all():
            return find(self.xyz, self.first, self.cells, cutoff)
        own = np.flatnonzero(np.repeat(self.known, self.sizes))
        sizes = self.sizes[self.known]
        i, j, r = find(self.xyz[own], np.cumsum(sizes) - sizes, self.cells[self.known], cutoff)
        return own[i], own[j], r

    def columns(self, names: tuple[str, ...]) -> list[pa.ChunkedArray]:
        return [self.table.column(c) for c in names]


def _types(df: DataFrame, *names: str) -> list[str]:
    return [f"{c} {df.schema[c].dataType.simpleString()}" for c in names]


def on_frames(atoms: DataFrame, frames: DataFrame, cutoff: float, run: Callable, names: list[str], place: bool = False) -> DataFrame:
    """frame_id, atom_id, type and ``names`` of every atom, from the pairs of its frame.

    ``run`` gets the types of atoms (-1: null) and, for each pair, the places of its atoms (the first ascending)
    and its vector, and gives [name, atom]. With ``place`` x, y, z and cell stay; rows come frame by frame, so that
    the next step in the same task may go on with on_clustered.
    """
    more = ["x", "y", "z", "cell"] if place else []
    return on_clustered(clustered(atoms, frames), cutoff, lambda types, table, *of_pairs: run(types, *of_pairs), names, more)


def on_clustered(rows: DataFrame, cutoff: float, run: Callable, names: list[str], more: list[str] | None = None) -> DataFrame:
    """As on_frames from rows with frame_id, atom_id, type, x, y, z and cell, a frame's rows one after the other.

    ``run`` gets the rows' table after the types. ``more``: columns to pass on.
    """
    ids = ["frame_id", "atom_id", "type", *(more or [])]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            chunk = Chunk(table)
            found = run(chunk.type, table, *chunk.pairs(cutoff))
            out = [*chunk.columns(tuple(ids)), *(pa.array(np.ascontiguousarray(x)) for x in found)]
            yield from pa.Table.from_arrays(out, [*ids, *names]).to_batches()

    schema = ", ".join([*_types(rows, *ids), *(f"{n} double" for n in names)])
    return rows.mapInArrow(kernel, schema)


def frame_sums(atoms: DataFrame, frames: DataFrame, cutoff: float, run: Callable, names: list[str]) -> DataFrame:
    """frame_id, natoms and the sums of ``names`` over the atoms of each frame; else as on_frames."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            chunk = Chunk(table)
            found = np.add.reduceat(run(chunk.type, *chunk.pairs(cutoff)), chunk.first, axis=1)
            out = [pa.array(chunk.frame[chunk.first]), pa.array(chunk.sizes), *(pa.array(x) for x in found)]
            yield pa.RecordBatch.from_arrays(out, ["frame_id", "natoms", *names])

    schema = ", ".join([*_types(atoms, "frame_id"), "natoms bigint", *(f"{n} double" for n in names)])
    return clustered(atoms, frames).mapInArrow(kernel, schema)


def whole_pairs(atoms: DataFrame, frames: DataFrame, cutoff: float, by_bins: bool = False, least_atoms: int = 64, least_bins: int = 15) -> DataFrame:
    """frame_id, i, j, ti, tj, dx, dy, dz, d of all directed pairs, by cell lists in frames with enough atoms and bins, or
    in all (``by_bins``), else by all shifts within reach."""
    names = ["frame_id", "i", "j", "ti", "tj", "dx", "dy", "dz", "d"]

    def either(xyz: np.ndarray, first: np.ndarray, cells: np.ndarray, cutoff: float) -> tuple[np.ndarray, ...]:
        sizes = np.diff(np.append(first, len(xyz)))
        bins = np.maximum(np.floor(1 / np.linalg.norm(np.linalg.inv(cells), axis=1) / cutoff), 1).prod(axis=1)
        binned, out = (sizes >= least_atoms) & (bins >= least_bins), []
        for of, find in ((binned, binned_pairs), (~binned, many_pairs)):
            own = np.flatnonzero(np.repeat(of, sizes))
            i, j, r = find(xyz[own], np.cumsum(sizes[of]) - sizes[of], cells[of], cutoff)
            out.append((own[i], own[j], r))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            chunk = Chunk(table)
            i, j, r = chunk.pairs(cutoff, binned_pairs if by_bins else either)
            x, y, z = np.ascontiguousarray(r.T)
            atom, kind = chunk.columns(("atom_id", "type"))
            ids = [pa.array(chunk.frame[i]), atom.take(pa.array(i)), atom.take(pa.array(j)), kind.take(pa.array(i)), kind.take(pa.array(j))]
            numbers = [pa.array(c) for c in (x, y, z, np.sqrt(x * x + y * y + z * z))]
            yield from pa.Table.from_arrays([*ids, *numbers], names).to_batches()

    (frame, atom, kind) = (atoms.schema[c].dataType.simpleString() for c in ("frame_id", "atom_id", "type"))
    schema = f"frame_id {frame}, i {atom}, j {atom}, ti {kind}, tj {kind}, dx double, dy double, dz double, d double"
    return clustered(atoms, frames).mapInArrow(kernel, schema)
