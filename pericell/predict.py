"""Predictions of whole datasets: atoms and frames in, energies, forces, virials, stresses and descriptors out.

Frames are dealt by their id once and go through the NumPy kernel as a stream of
Arrow batches, whole frames at a time. Frames of ``tiled_from`` atoms and more are not gathered
into one task: they are cut into blocks of space, a block gets its atoms and those
around it, finds their pairs, and what it gives to its atoms and their neighbors is
summed by atom (``predict_blocks``). ``predict_large`` does the same from pairs of the
distributed join, in blocks of center atoms of any frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .framestore import CALL, FrameStore, collate, unpacked
from .functions import expressions as X
from .functions.tables import GPA_PER_EV_A3, MISSING_VIRIAL
from .kernels.potential import Batch, compute, is_radial, radial_cloud
from .kernels.pairs import cloud_slices, many_pairs
from .model import Model
from .operators import sampling
from .operators.whole import CALL as CHUNK
from .operators.whole import Chunk, clustered, whole

V = [f"v{k}" for k in range(9)]
#: Atoms that a task holds with all their pairs.
BLOCK = 4096
SIX = ("xx", "yy", "zz", "xy", "yz", "zx")


def as_batch(frame: np.ndarray, types: np.ndarray, xyz: np.ndarray, cells: np.ndarray, cutoff: float) -> Batch:
    """Atoms sorted by frame to one batch; cells: [frame, 3, 3] in the same order."""
    first = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1)) if len(frame) else np.zeros(0, int)
    i, j, r = many_pairs(xyz, first, cells, cutoff)
    return Batch(types, np.searchsorted(first, np.arange(len(frame)), "right") - 1, i, j, r)


def predict_atoms(atoms: DataFrame, frames: DataFrame, model: Model, descriptor: bool = False, block: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """frame_id, atom_id, energy, fx, fy, fz, v0 .. v8 (and q: the scaled descriptor) of every atom.

    atoms: frame_id, atom_id, type, x, y, z. A call of the kernel holds whole frames, of about ``block`` atoms together.
    ``keep``: other columns of atoms to pass on.
    """
    spark = atoms.sparkSession
    shared = spark.sparkContext.broadcast(model)  # parameters: fixed by the shape, not by the data
    cutoff = max(model.shape.cutoff_radial, model.shape.cutoff_angular)
    names, keep = ["frame_id", "atom_id", "energy", "fx", "fy", "fz", *V], keep or []
    schema = ", ".join(["frame_id bigint, atom_id bigint", *(f"{c} double" for c in names[2:]), "q array<double>", *(f"{c} {atoms.schema[c].dataType.simpleString()}" for c in keep)])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches, block):
            chunk = Chunk(table)
            n = len(chunk.type)
            result = compute(shared.value, Batch(chunk.type, np.zeros(n, np.int64), *chunk.pairs(cutoff)))
            arrays = [*chunk.columns(("frame_id", "atom_id")), *(pa.array(np.ascontiguousarray(c)) for c in (result["energy"], *result["forces"].T, *result["virial"].T))]
            q = pa.array(list(result["descriptor"]), pa.list_(pa.float64())) if descriptor else pa.nulls(n, pa.list_(pa.float64()))
            yield from pa.Table.from_arrays([*arrays, q, *chunk.columns(tuple(keep))], [*names, "q", *keep]).to_batches()

    out = clustered(atoms, frames, *keep).where("cell IS NOT NULL").mapInArrow(kernel, schema)
    return out if descriptor else out.drop("q")


def predict_frames(per_atom: DataFrame, frames: DataFrame) -> DataFrame:
    """frame_id, natoms, e_pred, w_xx .. (virial per atom), volume, s_xx .. (GPa)."""
    sums = per_atom.groupBy("frame_id").agg(F.count(F.lit(1)).alias("natoms"), F.sum("energy").alias("e_pred"), *[F.sum(v).alias(v) for v in V])
    if "volume" in frames.columns:
        out = sums.join(frames.select("frame_id", "volume"), "frame_id")
    else:
        cells = frames.select("frame_id", *[F.col("cell")[k].alias(f"c{k}") for k in range(9)])
        out = sums.join(cells, "frame_id").withColumn("volume", F.expr(X.volume([f"c{k}" for k in range(9)])))
    six = [(F.col(f"v{k}") / F.col("natoms")).alias(f"w_{n}") for k, n in zip(X.VIRIAL_SIX, SIX, strict=True)]
    stress = [F.expr(X.stress_gpa(f"v{k}", "volume")).alias(f"s_{n}") for k, n in zip(X.VIRIAL_SIX, SIX, strict=True)]
    return out.select("frame_id", "natoms", "e_pred", *six, "volume", *stress)


def predict_large(atoms: DataFrame, frames: DataFrame, model: Model, descriptor: bool = False, block: int = 1024) -> DataFrame:
    """As predict_atoms, for frames too large for one task: about ``block`` center atoms a call, of any frame, with all their pairs.

    Frames of up to ``block`` atoms are dealt whole, so nothing of them is sent but their atoms. Of larger ones a
    center's energy and slopes need its own pairs only; forces and virials of a block are shares, added up by atom.
    """
    large = _larger(atoms, block + 1)
    if large.isEmpty():
        return predict_atoms(atoms, frames, model, descriptor)
    (atoms, frames), few = _parted(atoms, frames, large)
    return _predict_centers(atoms, frames, model, descriptor, block).unionByName(predict_atoms(*few, model, descriptor))


def _larger(atoms: DataFrame, least: int) -> DataFrame:
    """frame_id of frames of ``least`` atoms and more."""
    return atoms.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("frame_id")


def _parted(atoms: DataFrame, frames: DataFrame, large: DataFrame) -> list[list[DataFrame]]:
    """atoms and frames of the large frames, and of the others."""
    return [[t.join(large, "frame_id", how) for t in (atoms, frames)] for how in ("left_semi", "left_anti")]


def _predict_centers(atoms: DataFrame, frames: DataFrame, model: Model, descriptor: bool, block: int) -> DataFrame:
    from .operators import neighbors as N

    s = model.shape
    shared = atoms.sparkSession.sparkContext.broadcast(model)
    near = N.neighbor_pairs(atoms, frames, max(s.cutoff_radial, s.cutoff_angular))
    near = near.select("frame_id", "i", "j", "ti", "tj", "dx", "dy", "dz")
    zero = [F.lit(0.0).alias(c) for c in ("dx", "dy", "dz")]
    centers = atoms.select("frame_id", F.col("atom_id").alias("i"), F.lit(None).cast("bigint").alias("j"), F.col("type").alias("ti"), F.col("type").alias("tj"), *zero)
    parts = max(1, -(-atoms.count() // block))
    fields = ["energy", "fx", "fy", "fz", *V]
    schema = f"frame_id bigint, atom_id bigint, {', '.join(f'{c} double' for c in fields)}, q array<double>"

    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        pair = table.filter(table.column("j").is_valid())
        center = table.filter(table.column("j").is_null())
        name = lambda t, at: np.stack([t.column("frame_id").to_numpy(), t.column(at).to_numpy()], axis=1).astype(np.int64)
        known, at = np.unique(np.concatenate([name(center, "i"), name(pair, "i"), name(pair, "j")]), axis=0, return_inverse=True)
        own, i, j = np.split(at.ravel(), [len(center), len(center) + len(pair)])
        kind = np.empty(len(known), np.int64)
        kind[own] = center.column("ti").to_numpy()
        kind[j] = pair.column("tj").to_numpy()
        r = np.stack([pair.column(c).to_numpy() for c in ("dx", "dy", "dz")], axis=1)
        result = compute(shared.value, Batch(kind, np.zeros(len(known), np.int64), i, j, r))
        mine = np.zeros(len(known), bool)
        mine[own] = True
        columns = [*known.T, np.where(mine, result["energy"], 0.0), *result["forces"].T, *result["virial"].T]
        arrays = [pa.array(np.ascontiguousarray(c)) for c in columns]
        q = [row if m else None for row, m in zip(result["descriptor"], mine, strict=True)] if descriptor else [None] * len(known)
        return pa.Table.from_arrays([*arrays, pa.array(q, pa.list_(pa.float64()))], ["frame_id", "atom_id", *fields, "q"])

    dealt = centers.unionByName(near).withColumn("part", F.pmod(F.xxhash64("frame_id", "i"), F.lit(parts)))
    shares = dealt.groupBy("part").applyInArrow(kernel, schema).groupBy("frame_id", "atom_id")
    out = shares.agg(*[F.sum(c).alias(c) for c in fields], F.first("q", ignorenulls=True).alias("q"))
    return out if descriptor else out.drop("q")


def predict_blocks(atoms: DataFrame, frames: DataFrame, model: Model, descriptor: bool = False, block: int | None = None) -> DataFrame:
    """As predict_large, by blocks of space (operators.blocks): atoms are sent, with a halo, and pairs are found where they land."""
    from .operators.blocks import each_block, in_blocks

    s = model.shape
    shared, cutoff = atoms.sparkSession.sparkContext.broadcast(model), max(s.cutoff_radial, s.cutoff_angular)
    fields = ["energy", "fx", "fy", "fz", *V]
    schema = f"frame_id bigint, atom_id bigint, {', '.join(f'{c} double' for c in fields)}, q array<double>"

    def kernel(table: pa.Table) -> pa.Table:
        frame, own, atom, kind = (table.column(c).to_numpy() for c in ("frame_id", "own", "atom_id", "type"))
        xyz = np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1)
        energy, shares, q_own = np.zeros(len(kind)), np.zeros((12, len(kind))), {}
        held: list[tuple[np.ndarray, ...]] = []

        def give() -> None:
            """One call of the kernel for the pairs that are held, on the atoms that they touch."""
            center, i, j, r = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            touched = np.zeros(len(kind), bool)
            for x in (center, i, j):
                touched[x] = True
            here, at = np.flatnonzero(touched), np.cumsum(touched) - 1
            result = compute(shared.value, Batch(kind[here].astype(np.int64), np.zeros(len(here), np.int64), at[i], at[j], r))
            energy[center] = result["energy"][at[center]]
            shares[:, here] += np.concatenate([result["forces"].T, result["virial"].T])
            if descriptor:
                q_own.update(zip(center.tolist(), result["descriptor"][at[center]], strict=True))

        radial = is_radial(shared.value) and ((kind >= 0) & (kind < len(s.types))).all()
        for a, b in each_block(table):
            if radial:
                energy[a:b], q, shares[:, a:b] = radial_cloud(shared.value, kind[a:b], xyz[a:b], own[a:b])
                if descriptor:
                    q_own.update((a + k, q[:, k]) for k in np.flatnonzero(own[a:b]).tolist())
                continue
            for center, i, j, r in cloud_slices(xyz[a:b], own[a:b], cutoff):
                held.append((center + a, i + a, j + a, r))
                if sum(len(h[1]) for h in held) >= 30_000:  # arrays stay in the cache, and a task's memory does not grow with density
                    give()
        if held:
            give()
        order = np.lexsort((atom, frame))  # an atom may be here more than once, as images
        new = np.append(True, (np.diff(frame[order]) != 0) | (np.diff(atom[order]) != 0))
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        known = np.stack([frame, atom], axis=1)[order[new]]
        add = lambda x: np.bincount(at, x, len(known))
        columns = [*known.T, add(energy), *(add(x) for x in shares)]
        q: list = [None] * len(known)
        for k, row in q_own.items():
            q[at[k]] = row
        return pa.Table.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in columns), pa.array(q, pa.list_(pa.float64()))], ["frame_id", "atom_id", *fields, "q"])

    shares = in_blocks(atoms, frames, cutoff, kernel, schema, block).groupBy("frame_id", "atom_id")
    out = shares.agg(*[F.sum(c).alias(c) for c in fields], F.first("q", ignorenulls=True).alias("q"))
    return out if descriptor else out.drop("q")


def predict_sized(atoms: DataFrame, frames: DataFrame, model: Model, descriptor: bool = False, tiled_from: int = 50_000) -> DataFrame:
    """Frames of ``tiled_from`` atoms and more by predict_blocks, the others by predict_atoms, as those that fit one block."""
    large = _larger(atoms, max(tiled_from, BLOCK + 1))
    if large.isEmpty():
        return predict_atoms(atoms, frames, model, descriptor=descriptor)
    big, small = _parted(atoms, frames, large)
    return predict_blocks(*big, model, descriptor).unionByName(predict_atoms(*small, model, descriptor=descriptor))


def predict_store(store: FrameStore, model: Model, descriptor: bool = False) -> DataFrame:
    """As predict_atoms, from frames whose pairs are kept: no neighbor search and no shuffle."""
    shared = store.spark.sparkContext.broadcast(model)
    names = ["frame_id", "atom_id", "energy", "fx", "fy", "fz", *V, "q"]
    schema = f"frame_id bigint, atom_id bigint, {', '.join(f'{c} double' for c in names[2:-1])}, q array<double>"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), CALL):
                frames = unpacked(batch.slice(lo, CALL))
                found = compute(shared.value, collate(frames))
                ids = [np.repeat([f.frame_id for f in frames], [f.n for f in frames]), np.concatenate([np.arange(f.n) for f in frames])]
                arrays = [pa.array(np.ascontiguousarray(c)) for c in (*ids, found["energy"], *found["forces"].T, *found["virial"].T)]
                q = pa.array(list(found["descriptor"]), pa.list_(pa.float64())) if descriptor else pa.nulls(len(ids[0]), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*arrays, q], names)

    out = store.table().mapInArrow(kernel, schema)
    return out if descriptor else out.drop("q")


def store_tables(store: FrameStore, model: Model) -> dict[str, DataFrame]:
    """Energy, force, virial and stress tables of a store's frames, with their references."""
    per_atom, frames = predict_store(store, model), store.frames()
    per_frame = predict_frames(per_atom, frames)
    return {"energy": energy_table(per_frame, frames), "force": force_table(per_atom, store.atoms()), "virial": virial_table(per_frame, frames), "stress": virial_table(per_frame, frames, stress=True)}


def energy_table(per_frame: DataFrame, frames: DataFrame) -> DataFrame:
    """frame_id, pred, ref in eV per atom; a missing reference is NaN in the file."""
    both = per_frame.join(frames.select("frame_id", "energy"), "frame_id")
    return both.select("frame_id", (F.col("e_pred") / F.col("natoms")).alias("pred"), F.coalesce(F.col("energy") / F.col("natoms"), F.lit(float("nan"))).alias("ref"))


def force_table(per_atom: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """Predicted and reference forces. Without ``atoms`` the references are columns rfx, rfy, rfz of ``per_atom``."""
    if atoms is None:
        return per_atom.select("frame_id", "atom_id", "fx", "fy", "fz", *[F.coalesce(f"r{c}", F.lit(float("nan"))).alias(f"r{c}") for c in ("fx", "fy", "fz")])
    known = [c for c in ("fx", "fy", "fz") if c in atoms.columns]
    refs = atoms.select("frame_id", "atom_id", *[(F.col(c) if c in known else F.lit(None).cast("double")).alias(f"r{c}") for c in ("fx", "fy", "fz")])
    both = per_atom.join(refs, ["frame_id", "atom_id"])
    return both.select("frame_id", "atom_id", "fx", "fy", "fz", *[F.coalesce(f"r{c}", F.lit(float("nan"))).alias(f"r{c}") for c in ("fx", "fy", "fz")])


def virial_table(per_frame: DataFrame, frames: DataFrame, stress: bool = False) -> DataFrame:
    """Six predicted and six reference components per atom, or in GPa; a missing reference is the sentinel, unscaled."""
    of = "s" if stress else "w"
    both = virials_and_stresses(per_frame, frames)
    return both.select("frame_id", *[f"{of}_{n}" for n in SIX], *[F.col(f"r{of}_{n}").alias(f"r_{n}") for n in SIX])


def virials_and_stresses(per_frame: DataFrame, frames: DataFrame) -> DataFrame:
    """frame_id with w_ and rw_ (virials per atom), s_ and rs_ (stresses) of six components each, from one pass."""
    refs = frames.select("frame_id", *[F.col("virial")[k].alias(f"r_{n}") for k, n in zip(X.VIRIAL_SIX, SIX, strict=True)])
    scales = {"w": 1.0 / F.col("natoms"), "s": F.lit(GPA_PER_EV_A3) / F.when(F.col("volume") > 0, F.col("volume")).otherwise(1.0)}
    out = []
    for of, scale in scales.items():
        out += [*(F.col(f"{of}_{n}") for n in SIX), *(F.coalesce(F.col(f"r_{n}") * scale, F.lit(MISSING_VIRIAL)).alias(f"r{of}_{n}") for n in SIX)]
    return per_frame.join(refs, "frame_id").select("frame_id", *out)


def descriptor_table(per_atom: DataFrame, mode: int, dim: int) -> DataFrame:
    """Mode 1: the mean of each frame; mode 2: each atom."""
    columns = [F.col("q")[k].alias(f"q_{k}") for k in range(dim)]
    wide = per_atom.select("frame_id", "atom_id", *columns)
    return wide if mode == 2 else wide.groupBy("frame_id").agg(*[F.avg(f"q_{k}").alias(f"q_{k}") for k in range(dim)])


def write_table(df: DataFrame, path: str) -> None:
    """Numbers as %.10g, rows in order of frame and atom over all parts, as many as the rows ask for; the ids are not written."""
    keys = [c for c in ("frame_id", "atom_id") if c in df.columns]
    shown = F.concat_ws(" ", *[F.format_string("%.10g", c) for c in df.columns if c not in keys])
    df.select(*keys, shown.alias("value")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)


def write_predictions(read: DataFrame, model: Model, out_dir: str, output_descriptor: int = 0, suffix: str = "train", tiled_from: int = 50_000) -> dict[str, DataFrame]:
    """Energy, force, virial, stress (and descriptor) tables of frames as read_xyz gives them, written to ``out_dir``."""
    from .sources.extxyz import to_atoms, to_frames

    frames, atoms = to_frames(read), sampling.type_ids(to_atoms(read), list(model.shape.types))
    per_atom = predict_sized(atoms, frames, model, bool(output_descriptor), tiled_from).persist()
    per_frame = predict_frames(per_atom, frames).persist()
    out = {"energy": energy_table(per_frame, frames), "force": force_table(per_atom, atoms), "virial": virial_table(per_frame, frames), "stress": virial_table(per_frame, frames, stress=True)}
    if output_descriptor:
        out["descriptor"] = descriptor_table(per_atom, output_descriptor, model.shape.dim)
    for name, table in out.items():
        write_table(table, f"{out_dir}/{name}_{suffix}.out")
    for used in (per_atom, per_frame):  # the tables that are returned are computed anew when they are asked for
        used.unpersist()
    return out


def predict_dataset(spark, model_file: str, xyz_file: str, out_dir: str, energy_key: str = "energy", output_descriptor: int = 0, suffix: str = "train", tiled_from: int = 50_000) -> dict[str, DataFrame]:
    """Reads a model and a file or folder and writes its prediction tables to ``out_dir``."""
    from .model import load_model
    from .sources.extxyz import read_xyz

    return write_predictions(read_xyz(spark, xyz_file, energy_key), load_model(model_file), out_dir, output_descriptor, suffix, tiled_from)


class Calculator:
    """One structure at a time, on the driver. ``model``: a Model or the path of a model file."""

    def __init__(self, model: Model | str):
        from .model import load_model

        self.model = load_model(model) if isinstance(model, str) else model

    def compute(self, species: list[str], positions: np.ndarray, cell: np.ndarray | None, descriptor: bool = False, components: bool = False) -> dict:
        s = self.model.shape
        unknown = sorted(set(species) - set(s.types))
        if unknown:
            raise ValueError(f"unknown species: {unknown}")
        positions, cutoff = np.asarray(positions, float), max(s.cutoff_radial, s.cutoff_angular)
        periodic = cell is not None
        if not periodic:
            cell = np.diag(np.ptp(positions, axis=0) + 4 * cutoff + 1)
        kinds = np.array([s.types.index(x) for x in species])
        batch = as_batch(np.zeros(len(kinds), np.int64), kinds, positions, np.reshape(np.asarray(cell, float), (1, 3, 3)), cutoff)
        found = compute(self.model, batch, components)
        out = {"energy": float(found["energy"].sum()), "energies": found["energy"], "forces": found["forces"], "virial": found["virial"].sum(0)}
        if periodic:
            out["stress"] = (-out["virial"] / abs(np.linalg.det(np.reshape(cell, (3, 3)))))[list(X.VOIGT_SIX)]
        if descriptor:
            out["descriptor"] = found["descriptor"]
        for name in ("net", "zbl") if components else ():
            out |= {f"energy_{name}": float(found[f"energy_{name}"].sum()), f"forces_{name}": found[f"forces_{name}"], f"virial_{name}": found[f"virial_{name}"].sum(0)}
        return out

    def get_descriptor(self, species: list[str], positions: np.ndarray, cell: np.ndarray | None) -> np.ndarray:
        return self.compute(species, positions, cell, descriptor=True)["descriptor"]


def adapter():
    """A calculator class for ASE, where that is installed; made from a Model or the path of a model file.

    Results have the parts of the net and of the repulsion (``energy_net``, ``forces_zbl``, ...) with ``components``.
    """
    from ase.calculators.calculator import Calculator as Base
    from ase.calculators.calculator import all_changes

    class Adapter(Base):
        implemented_properties = ("energy", "energies", "forces", "stress")

        def __init__(self, model: Model | str, components: bool = False, **more):
            super().__init__(**more)
            self.own, self.components = Calculator(model), components

        def calculate(self, atoms=None, properties=("energy",), system_changes=all_changes):
            super().calculate(atoms, properties, system_changes)
            cell = atoms.cell.array if all(atoms.pbc) else None
            self.results = self.own.compute(atoms.get_chemical_symbols(), atoms.positions, cell, components=self.components)

        def get_components(self, atoms) -> dict:
            """Energy, forces and virial of the net and of the repulsion alone."""
            cell = atoms.cell.array if all(atoms.pbc) else None
            found = self.own.compute(atoms.get_chemical_symbols(), atoms.positions, cell, components=True)
            return {k: v for k, v in found.items() if k.endswith(("_net", "_zbl"))}

        def get_descriptor(self, atoms) -> np.ndarray:
            cell = atoms.cell.array if all(atoms.pbc) else None
            return self.own.get_descriptor(atoms.get_chemical_symbols(), atoms.positions, cell)

    return Adapter
