"""Rotation-invariant descriptors, their slopes and forces, by columns and grouped sums.

Angular moments, of which an atom has dozens, are summed by NumPy over blocks of atoms with their pairs; as
generated columns they fill methods too long to be compiled. Each operator has two forms. From pairs, for frames of any
size: pairs are dealt by their center atom. From frames (``whole_...``), for frames that fit a task: atoms are
sent, and their pairs are found and summed where the frame lands.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import tables
from ..kernels.potential import chebyshev, contract, evaluate, pair_forces
from .whole import on_clustered, on_frames

ATOM = ["frame_id", "atom_id"]
#: A table of more type pairs than this is joined, not broadcast by hand.
BROADCAST_PAIRS = 20_000


def coefficient_table(spark: SparkSession, c: np.ndarray, prefix: str = "c") -> DataFrame:
    """ti, tj and one column per (n, k) of coefficients [ti, tj, n, k]; rows: types squared."""
    nt, _, n, k = c.shape
    names = [f"{prefix}_{a}_{b}" for a in range(n) for b in range(k)]
    rows = [(a, b, *map(float, c[a, b].ravel())) for a in range(nt) for b in range(nt)]
    table = spark.createDataFrame(rows, f"ti int, tj int, {', '.join(f'{x} double' for x in names)}")
    return F.broadcast(table) if len(rows) <= BROADCAST_PAIRS else table


def contracted(pairs: DataFrame, c: np.ndarray, cutoff: float, slopes: bool = False) -> DataFrame:
    """pairs within the cutoff with g_n = sum_k c[ti, tj, n, k] f_k(d); with ``slopes`` also dg_n."""
    _, _, n, k = c.shape
    near = pairs.where(F.col("d") < cutoff).join(coefficient_table(pairs.sparkSession, c), ["ti", "tj"])
    basis = [F.expr(e).alias(f"f_{b}") for b, e in enumerate(X.chebyshev("d", cutoff, k - 1))]
    rise = [F.expr(e).alias(f"df_{b}") for b, e in enumerate(X.chebyshev_slopes("d", cutoff, k - 1))] if slopes else []
    near = near.select("*", *basis, *rise)
    out = [F.expr(" + ".join(f"c_{a}_{b} * f_{b}" for b in range(k))).alias(f"g_{a}") for a in range(n)]
    out += [F.expr(" + ".join(f"c_{a}_{b} * df_{b}" for b in range(k))).alias(f"dg_{a}") for a in range(n) if slopes]
    return near.select("frame_id", "i", "j", "ti", "tj", "dx", "dy", "dz", "d", *out)


def on_atoms(atoms: DataFrame, terms: DataFrame, names: list[str]) -> DataFrame:
    """Sums of ``names`` over the rows of ``terms`` by atom, with the type, for every atom.

    Each atom gives one row of zeros to the grouped sum, so atoms without terms keep zeros and nothing
    is joined. A term that is NaN shows in the sum.
    """
    zeros = atoms.select(*ATOM, "type", *[F.lit(0.0).alias(n) for n in names])
    own = terms.select(*ATOM, F.lit(None).cast(atoms.schema["type"].dataType).alias("type"), *names)
    return own.unionByName(zeros).groupBy(*ATOM).agg(F.max("type").alias("type"), *[F.sum(n).alias(n) for n in names])


def radial_terms(pairs: DataFrame, c: np.ndarray, cutoff: float) -> tuple[DataFrame, list[str]]:
    """What each pair gives to q_0 .. of its atom i."""
    names = [f"q_{a}" for a in range(c.shape[2])]
    g = contracted(pairs, c, cutoff)
    return g.select("frame_id", F.col("i").alias("atom_id"), *[F.col(f"g_{a}").alias(n) for a, n in enumerate(names)]), names


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values [row, pair] by ``at``, which is in order: [row, n]."""
    out = np.zeros((len(values), n))
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[:, at[first]] = np.add.reduceat(values, first, axis=1)
    return out


def on_blocks(atoms: DataFrame, pairs: DataFrame, run: Callable, names: list[str], block: int = 8192) -> DataFrame:
    """Sums over each atom's pairs by NumPy: frame_id, atom_id, type and ``names`` of every atom.

    Atoms and pairs are dealt by the center atom into groups of about ``block`` atoms, a frame over many of them;
    atoms without pairs are there. ``run`` gets the types of a group's atoms, for each pair its center's place
    (ascending), the type of its neighbor and its vector, and gives [name, atom].
    """
    parts = max(1, -(-atoms.count() // block))
    keys = [("frame_id", atoms.schema["frame_id"].dataType), ("atom_id", atoms.schema["atom_id"].dataType), ("type", atoms.schema["type"].dataType)]
    schema = ", ".join([*(f"{n} {t.simpleString()}" for n, t in keys), *(f"{n} double" for n in names)])
    center = atoms.select("frame_id", "atom_id", F.col("type").alias("kind"), F.lit(True).alias("center"), *[F.lit(0.0).alias(f"d{a}") for a in "xyz"])
    near = pairs.select("frame_id", F.col("i").alias("atom_id"), F.col("tj").alias("kind"), F.lit(False).alias("center"), "dx", "dy", "dz")
    dealt = center.unionByName(near).withColumn("part", F.pmod(F.xxhash64("frame_id", "atom_id"), F.lit(parts)))

    def kernel(table: pa.Table) -> pa.Table:
        frame, atom, kind = (table.column(c).to_numpy() for c in ("frame_id", "atom_id", "kind"))
        own = table.column("center").to_numpy()
        order = np.lexsort((~own, atom, frame))  # every atom before its pairs
        frame, atom, kind, own = frame[order], atom[order], kind[order], own[order]
        r = np.stack([table.column(f"d{a}").to_numpy()[order] for a in "xyz"], axis=1)
        at = np.cumsum(own) - 1
        found = run(kind[own], at[~own], kind[~own], r[~own])
        ids = [pa.array(np.ascontiguousarray(x[own])) for x in (frame, atom, kind)]
        return pa.Table.from_arrays([*ids, *(pa.array(x) for x in found)], [*(n for n, _ in keys), *names])

    return dealt.groupBy("part").applyInArrow(kernel, schema)


def radial(atoms: DataFrame, pairs: DataFrame, c: np.ndarray, cutoff: float) -> DataFrame:
    return on_atoms(atoms, *radial_terms(pairs, c, cutoff))


def invariants(moments: DataFrame, n: int, max_l: int, channels: list[str], before: list[str] | None = None) -> DataFrame:
    """Three-body terms, L by L and n fastest, then each extra channel; columns of ``before`` stand first."""
    size = len(tables.moments(max_l))
    s = [[f"s_{a}_{k}" for k in range(size)] for a in range(n)]
    out = [F.expr(X.q_three_body(s[a], order)).alias(f"q{order}_{a}") for order in range(1, max_l + 1) for a in range(n)]
    out += [F.expr(X.q_extra(s[a], ch)).alias(f"q{ch}_{a}") for ch in channels for a in range(n)]
    return moments.select(*ATOM, "type", *(before or []), *out)


def _summed_by(c2: np.ndarray, c3: np.ndarray, radial_cutoff: float, angular_cutoff: float, max_l: int) -> Callable:
    """For on_blocks: radial components, then moments with n before lm."""

    def sums(types: np.ndarray, at: np.ndarray, tj: np.ndarray, r: np.ndarray) -> np.ndarray:
        d = np.linalg.norm(r, axis=1)
        ti, out = types[at], []
        for c, cutoff, angular in ((c2, radial_cutoff, False), (c3, angular_cutoff, True)):
            if not c.shape[2]:
                continue
            near = np.flatnonzero(d < cutoff)
            g = contract(c, ti[near], tj[near], chebyshev(d[near], cutoff, c.shape[3] - 1)[0])
            if angular:
                y = tables.moment_values(*(r[near] / d[near, None]).T, max_l)
                g = (g[:, None] * y).reshape(len(g) * len(y), len(near))
            out.append(summed(at[near], g, len(types)))
        return np.concatenate(out)

    return sums


def _angular_names(n: int, max_l: int) -> list[str]:
    return [f"s_{a}_{k}" for a in range(n) for k in range(len(tables.moments(max_l)))]


def angular_moments(atoms: DataFrame, pairs: DataFrame, c: np.ndarray, cutoff: float, max_l: int) -> DataFrame:
    """s_<n>_<lm> of every atom."""
    none = np.zeros((*c.shape[:2], 0, 1))
    return on_blocks(atoms, pairs.where(F.col("d") < cutoff), _summed_by(none, c, 0.0, cutoff, max_l), _angular_names(c.shape[2], max_l))


def descriptor_sums(atoms: DataFrame, pairs: DataFrame, c2: np.ndarray, c3: np.ndarray, radial_cutoff: float, angular_cutoff: float, max_l: int) -> DataFrame:
    """q_<n> and s_<n>_<lm> of every atom, with its type."""
    names = [*(f"q_{a}" for a in range(c2.shape[2])), *_angular_names(c3.shape[2], max_l)]
    return on_blocks(atoms, pairs.where(F.col("d") < max(radial_cutoff, angular_cutoff)), _summed_by(c2, c3, radial_cutoff, angular_cutoff, max_l), names)


def descriptors(atoms: DataFrame, pairs: DataFrame, c2: np.ndarray, c3: np.ndarray, radial_cutoff: float, angular_cutoff: float, max_l: int, channels: list[str]) -> DataFrame:
    """All components of every atom in the model's order, as columns, from one pass over the pairs."""
    if not max_l:
        return radial(atoms, pairs, c2, radial_cutoff)
    run, names = _components_by(c2, c3, radial_cutoff, angular_cutoff, max_l, channels)
    return on_blocks(atoms, pairs.where(F.col("d") < max(radial_cutoff, angular_cutoff)), run, names)


def _components_by(c2: np.ndarray, c3: np.ndarray, radial_cutoff: float, angular_cutoff: float, max_l: int, channels: list[str]) -> tuple[Callable, list[str]]:
    """For on_blocks: all components in the model's order, and their names."""
    sums, n, polynomials = _summed_by(c2, c3, radial_cutoff, angular_cutoff, max_l), c3.shape[2], X.monomials(max_l, channels)

    def run(types: np.ndarray, *of_pairs: np.ndarray) -> np.ndarray:
        q, s = np.split(sums(types, *of_pairs), [c2.shape[2]])
        return np.concatenate([q, evaluate(polynomials, s.reshape(n, -1, len(types))).reshape(-1, len(types))])

    return run, [*(f"q_{a}" for a in range(c2.shape[2])), *(f"q{k}_{a}" for k in [*range(1, max_l + 1), *channels] for a in range(n))]


def components(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*ATOM, "type")]


def q_scaler(df: DataFrame, names: list[str]) -> DataFrame:
    """One row: 1 / max(max - min, 1e-10) of each component, in one pass."""
    return df.agg(*[(1.0 / F.greatest(F.max(n) - F.min(n), F.lit(1e-10))).alias(n) for n in names])


def scaled(df: DataFrame, names: list[str]) -> DataFrame:
    """Components times their scaler; the scaler is one row, read once by the driver as numbers of the plan."""
    row = q_scaler(df, names).first()
    return df.select(*[c for c in df.columns if c not in names], *[(F.col(n) * F.lit(row[n])).alias(n) for n in names])


def frame_means(df: DataFrame, names: list[str]) -> DataFrame:
    return df.groupBy("frame_id").agg(*[F.avg(n).alias(n) for n in names])


def net(df: DataFrame, names: list[str], weights: dict, b1: float) -> DataFrame:
    """E = w1 . tanh(W0 q - b0) - b1 by type, with ``weights[type] = (W0, b0, w1)``."""
    branches = []
    for t, (w0, b0, w1) in weights.items():
        hidden = [f"tanh({' + '.join(f'{X.number(w)} * {q}' for w, q in zip(row, names, strict=True))} - {X.number(b)})" for row, b in zip(w0, b0, strict=True)]
        branches.append(f"WHEN type = {int(t)} THEN {' + '.join(f'{X.number(w)} * {h}' for w, h in zip(w1, hidden, strict=True))}")
    return df.withColumn("energy", F.expr(f"CASE {' '.join(branches)} END - {X.number(b1)}"))


def net_slopes(df: DataFrame, names: list[str], weights: dict, keep: list[str] | None = None) -> DataFrame:
    """dE/dq of each component as e_<name>: (w1 (1 - h^2)) W0 by type. ``keep``: other columns to pass on."""
    size = len(next(iter(weights.values()))[1])
    hidden = []
    for k in range(size):
        branches = [f"WHEN type = {int(t)} THEN tanh({' + '.join(f'{X.number(w)} * {q}' for w, q in zip(w0[k], names, strict=True))} - {X.number(b0[k])})" for t, (w0, b0, _) in weights.items()]
        hidden.append(F.expr(f"CASE {' '.join(branches)} END").alias(f"h_{k}"))
    slopes = []
    for c, name in enumerate(names):
        branches = [f"WHEN type = {int(t)} THEN {' + '.join(f'{X.number(w1[k] * w0[k][c])} * (1e0 - h_{k} * h_{k})' for k in range(size))}" for t, (w0, _, w1) in weights.items()]
        slopes.append(F.expr(f"CASE {' '.join(branches)} END").alias(f"e_{name}"))
    return df.select("*", *hidden).select(*ATOM, "type", *(keep or []), *slopes)


def moment_slopes(rows: DataFrame, n: int, max_l: int, channels: list[str], slopes: list[str], keep: list[str] | None = None) -> DataFrame:
    """dE/ds as w_<n>_<lm>, from moments s_<n>_<lm> and dE/dq of the invariants (columns ``slopes``, in the model's order)."""
    size = len(tables.moments(max_l))
    out = []
    for a in range(n):
        found = X.pulled_back([f"s_{a}_{k}" for k in range(size)], slopes[a::n], max_l, channels)
        out += [F.expr(e).alias(f"w_{a}_{k}") for k, e in enumerate(found)]
    return rows.select(*ATOM, *(keep or []), *out)


def gradients(pairs: DataFrame, slopes: DataFrame, c2: np.ndarray, c3: np.ndarray, radial_cutoff: float, angular_cutoff: float, max_l: int, radial: list[str]) -> DataFrame:
    """dE/dr of every pair from its center's slopes: dE/dq of the radial components (columns ``radial``) and dE/ds (w_<n>_<lm>).

    The slopes are joined on the center. Of an angular function the distance part goes along the pair, the rest
    across it: g' Y u + g (grad Y - u (u . grad Y)) / d, with the polynomial's gradient.
    """
    spark, n, size = pairs.sparkSession, c3.shape[2], len(tables.moments(max_l))
    near = pairs.where(F.col("d") < max(radial_cutoff, angular_cutoff)).join(coefficient_table(spark, c2), ["ti", "tj"]).join(coefficient_table(spark, c3, "b"), ["ti", "tj"])
    near = near.select("*", *[(F.col(f"d{a}") / F.col("d")).alias(f"u{a}") for a in "xyz"])
    parts = []
    for name, found, cutoff in (("df", X.chebyshev_slopes("d", radial_cutoff, c2.shape[3] - 1), radial_cutoff), ("h", X.chebyshev("d", angular_cutoff, c3.shape[3] - 1), angular_cutoff), ("dh", X.chebyshev_slopes("d", angular_cutoff, c3.shape[3] - 1), angular_cutoff)):
        parts += [F.when(F.col("d") < cutoff, F.expr(e)).otherwise(0.0).alias(f"{name}_{k}") for k, e in enumerate(found)]
    total = lambda terms: F.expr("(" + " + ".join(terms) + ")")
    near = near.select("*", *parts)
    dq = [total(f"c_{a}_{k} * df_{k}" for k in range(c2.shape[3])).alias(f"dq_{a}") for a in range(c2.shape[2])]
    g = [total(f"b_{a}_{k} * {f}_{k}" for k in range(c3.shape[3])).alias(f"{name}_{a}") for name, f in (("g", "h"), ("dg", "dh")) for a in range(n)]
    near = near.select("frame_id", "i", "j", "d", "dx", "dy", "dz", "ux", "uy", "uz", *dq, *g)
    own = slopes.withColumnRenamed("atom_id", "i")
    both = near.join(own.drop("type"), ["frame_id", "i"])
    along = [f"{e} * dq_{a}" for a, e in enumerate(radial)]
    weights = [total(f"w_{a}_{k} * {f}_{a}" for a in range(n)).alias(f"{name}_{k}") for name, f in (("on_y", "dg"), ("on_dy", "g")) for k in range(size)]
    both = both.select("frame_id", "i", "j", "d", "dx", "dy", "dz", "ux", "uy", "uz", total(along).alias("size"), *weights)
    y, dy = X.angular("ux", "uy", "uz", max_l), X.angular_slopes("ux", "uy", "uz", max_l)
    pulled = [total(f"on_dy_{k} * {dy[k][c]}" for k in range(size)).alias(f"p{a}") for c, a in enumerate("xyz")]
    both = both.select("frame_id", "i", "j", "d", "dx", "dy", "dz", "ux", "uy", "uz", total(["size", *(f"on_y_{k} * {e}" for k, e in enumerate(y))]).alias("size"), *pulled)
    both = both.withColumn("inward", F.expr("ux * px + uy * py + uz * pz"))
    return both.select("frame_id", "i", "j", "dx", "dy", "dz", *[F.expr(f"size * u{a} + (p{a} - inward * u{a}) / d").alias(f"g{a}") for a in "xyz"])


def net_forces(atoms: DataFrame, pairs: DataFrame, c2: np.ndarray, c3: np.ndarray, radial_cutoff: float, angular_cutoff: float, max_l: int, channels: list[str], weights: dict, scaler: np.ndarray) -> DataFrame:
    """fx, fy, fz and v0 .. v8 of every atom under the net, all by columns. ``weights[type] = (W0, b0, w1)``; components
    times ``scaler`` go in."""
    n, size = c3.shape[2], len(tables.moments(max_l))
    moments = [f"s_{a}_{k}" for a in range(n) for k in range(size)]
    q = [f"q_{a}" for a in range(c2.shape[2])]
    sums = descriptor_sums(atoms, pairs, c2, c3, radial_cutoff, angular_cutoff, max_l)
    full = invariants(sums, n, max_l, channels, [*q, *moments])
    names = [c for c in components(full) if c not in moments]
    scaled_weights = {t: (np.asarray(w0) * scaler, b0, w1) for t, (w0, b0, w1) in weights.items()}
    slopes = net_slopes(full, names, scaled_weights, moments)
    on = moment_slopes(slopes, n, max_l, channels, [f"e_{c}" for c in names[len(q) :]], [f"e_{c}" for c in q])
    return forces(atoms, gradients(pairs, on, c2, c3, radial_cutoff, angular_cutoff, max_l, [f"e_{c}" for c in q]))


def zbl_atoms(atoms: DataFrame, pairs: DataFrame, numbers: list[int], inner: float, outer: float, factor: float | None = None) -> DataFrame:
    """Half the pair energies on i. With ``factor``, outer is the typewise cutoff and inner 0."""
    rows = [(a, b, float(za), float(zb), 0.0 if factor else float(inner), float(tables.zbl_outer(za, zb, factor, outer) if factor else outer)) for a, za in enumerate(numbers) for b, zb in enumerate(numbers)]
    table = pairs.sparkSession.createDataFrame(rows, "ti int, tj int, zi double, zj double, r_in double, r_out double")
    near = pairs.join(F.broadcast(table) if len(rows) <= BROADCAST_PAIRS else table, ["ti", "tj"]).where("d < r_out")
    terms = near.select("frame_id", F.col("i").alias("atom_id"), F.expr(f"0.5e0 * {X.zbl('d', 'zi', 'zj', 'r_in', 'r_out')}").alias("zbl"))
    return on_atoms(atoms, terms, ["zbl"])


def forces(atoms: DataFrame, gradients: DataFrame) -> DataFrame:
    """From dE/dr of each directed pair (gx, gy, gz): F_i += g, F_j -= g and V_j[ab] -= r_a g_b, by one grouped sum.

    Each pair is one row that gives two, so the pairs are made once.
    """
    names = ["fx", "fy", "fz", *[f"v{k}" for k in range(9)]]
    outer = [-F.col(f"d{a}") * F.col(f"g{b}") for a in "xyz" for b in "xyz"]
    on_i = F.struct(F.col("i").alias("atom_id"), *[F.col(f"g{a}").alias(f"f{a}") for a in "xyz"], *[F.lit(0.0).alias(f"v{k}") for k in range(9)])
    on_j = F.struct(F.col("j").alias("atom_id"), *[(-F.col(f"g{a}")).alias(f"f{a}") for a in "xyz"], *[e.alias(f"v{k}") for k, e in enumerate(outer)])
    return on_atoms(atoms, gradients.select("frame_id", F.inline(F.array(on_i, on_j))), names)


def radial_gradients(pairs: DataFrame, c: np.ndarray, cutoff: float, slopes_on_q: list[float]) -> DataFrame:
    """dE/dr of pairs for E_i = sum_n slopes_on_q[n] q_n(i)."""
    g = contracted(pairs, c, cutoff, slopes=True)
    size = F.expr(" + ".join(f"{X.number(w)} * dg_{a}" for a, w in enumerate(slopes_on_q)))
    return g.select("frame_id", "i", "j", "dx", "dy", "dz", *[(size * F.col(f"d{a}") / F.col("d")).alias(f"g{a}") for a in "xyz"])


# from whole frames


def _by_center(run: Callable) -> Callable:
    """A function of on_blocks for on_frames."""
    return lambda types, i, j, r: run(types, i, types[j], r)


def pair_sums(atoms: DataFrame, frames: DataFrame, cutoff: float, terms: Callable, names: list[str]) -> DataFrame:
    """Sums of terms(r, d) [name, pair] over each atom's pairs, of the atoms that have any."""

    def run(types: np.ndarray, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> np.ndarray:
        each = np.vstack([terms(r, np.linalg.norm(r, axis=1)), np.ones(len(i))])
        return summed(i, each, len(types))

    return on_frames(atoms, frames, cutoff, run, [*names, "n"]).where("n > 0").drop("n", "type")


def whole_radial(atoms: DataFrame, frames: DataFrame, c: np.ndarray, cutoff: float) -> DataFrame:
    """As radial."""
    none = np.zeros((*c.shape[:2], 0, 1))
    return on_frames(atoms, frames, cutoff, _by_center(_summed_by(c, none, cutoff, 0.0, 0)), [f"q_{a}" for a in range(c.shape[2])])


def whole_moments(atoms: DataFrame, frames: DataFrame, c: np.ndarray, cutoff: float, max_l: int) -> DataFrame:
    """As angular_moments."""
    none = np.zeros((*c.shape[:2], 0, 1))
    return on_frames(atoms, frames, cutoff, _by_center(_summed_by(none, c, 0.0, cutoff, max_l)), _angular_names(c.shape[2], max_l))


def whole_descriptors(atoms: DataFrame, frames: DataFrame, c2: np.ndarray, c3: np.ndarray, radial_cutoff: float, angular_cutoff: float, max_l: int, channels: list[str]) -> DataFrame:
    """As descriptors."""
    run, names = _components_by(c2, c3, radial_cutoff, angular_cutoff, max_l, channels)
    return on_frames(atoms, frames, max(radial_cutoff, angular_cutoff), _by_center(run), names)


FORCE_NAMES = ["fx", "fy", "fz", *[f"v{k}" for k in range(9)]]


def radial_forces_by(c: np.ndarray, cutoff: float, slopes_on_q: list[float]) -> Callable:
    """For on_frames and frame_sums: FORCE_NAMES for E_i = sum_n slopes_on_q[n] q_n(i)."""

    def run(types: np.ndarray, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> np.ndarray:
        d = np.linalg.norm(r, axis=1)
        size = np.asarray(slopes_on_q) @ contract(c, types[i], types[j], chebyshev(d, cutoff, c.shape[3] - 1)[1])
        return np.concatenate(pair_forces(i, j, r, (size / d)[:, None] * r, len(types)))

    return run


def whole_net_forces(atoms: DataFrame, frames: DataFrame, c2: np.ndarray, c3: np.ndarray, radial_cutoff: float, angular_cutoff: float, max_l: int, channels: list[str], weights: dict, scaler: np.ndarray) -> DataFrame:
    """As net_forces, in one pass of a task over its frames: sums over pairs, slopes by columns, then pairs again with
    their center's slopes, which are read in the place where they were made and not joined."""
    n, size, cutoff = c3.shape[2], len(tables.moments(max_l)), max(radial_cutoff, angular_cutoff)
    moments, q, place = _angular_names(n, max_l), [f"q_{a}" for a in range(c2.shape[2])], ["x", "y", "z", "cell"]
    sums = on_frames(atoms, frames, cutoff, _by_center(_summed_by(c2, c3, radial_cutoff, angular_cutoff, max_l)), [*q, *moments], place=True)
    full = invariants(sums, n, max_l, channels, [*q, *moments, *place])
    names = [c for c in components(full) if c not in (*moments, *place)]
    slopes = net_slopes(full, names, {t: (np.asarray(w0) * scaler, b0, w1) for t, (w0, b0, w1) in weights.items()}, [*moments, *place])
    on_q, on_s = [f"e_{c}" for c in q], [f"w_{a}_{k}" for a in range(n) for k in range(size)]
    rows = moment_slopes(slopes, n, max_l, channels, [f"e_{c}" for c in names[len(q) :]], ["type", *place, *on_q])

    def run(types: np.ndarray, table: pa.Table, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> np.ndarray:
        on = lambda names: np.array([table.column(c).to_numpy() for c in names])
        d = np.linalg.norm(r, axis=1)
        u, g = r / d[:, None], np.zeros_like(r)
        near = np.flatnonzero(d < radial_cutoff)
        rise = contract(c2, types[i[near]], types[j[near]], chebyshev(d[near], radial_cutoff, c2.shape[3] - 1)[1])
        g[near] += (on(on_q)[:, i[near]] * rise).sum(axis=0)[:, None] * u[near]
        near = np.flatnonzero(d < angular_cutoff)
        h, dh = (contract(c3, types[i[near]], types[j[near]], f) for f in chebyshev(d[near], angular_cutoff, c3.shape[3] - 1))
        unit, w = u[near].T, on(on_s).reshape(n, size, -1)[:, :, i[near]]
        along = np.einsum("nkp,np,kp->p", w, dh, tables.moment_values(*unit, max_l))
        pulled = np.einsum("kp,kap->ap", np.einsum("nkp,np->kp", w, h), tables.moment_gradients(*unit, max_l))
        g[near] += (along * unit + (pulled - (pulled * unit).sum(axis=0) * unit) / d[near]).T
        return np.concatenate(pair_forces(i, j, r, g, len(types)))

    return on_clustered(rows, cutoff, run, FORCE_NAMES)
