"""Periodic range self-join: all directed pairs of a frame closer than a cutoff, over all images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from .whole import whole_pairs

CELL = [f"c{k}" for k in range(9)]
INVERSE = [f"v{k}" for k in range(9)]
WIDTHS = [f"w{k}" for k in range(3)]
NEAREST = 1e-10


def geometry(frames: DataFrame) -> DataFrame:
    """frame_id with the cell, its inverse and the distances between its planes as columns."""
    flat = frames.select("frame_id", *[F.col("cell")[k].alias(c) for k, c in enumerate(CELL)])
    inverse = [F.expr(e).alias(n) for e, n in zip(X.inverse(CELL), INVERSE, strict=True)]
    return flat.select("*", *inverse, *[F.expr(e).alias(n) for e, n in zip(X.widths(CELL), WIDTHS, strict=True)])


def _placed(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    joined = atoms.select("frame_id", "atom_id", "type", "x", "y", "z").join(geometry(frames), "frame_id")
    fractional = X.fractional(["x", "y", "z"], INVERSE)
    return joined.select("*", *[F.expr(e).alias(n) for e, n in zip(fractional, ("fa", "fb", "fc"), strict=True)]).drop(*INVERSE)


def _measured(candidates: DataFrame, cutoff: float) -> DataFrame:
    """Candidates with base displacement x, y, z and shifts sa, sb, sc to pairs within the cutoff."""
    moved = [f"r{a} + sa * c{k} + sb * c{3 + k} + sc * c{6 + k}" for k, a in enumerate("xyz")]
    out = candidates.select("frame_id", "i", "j", "ti", "tj", *[F.expr(e).alias(n) for e, n in zip(moved, ("dx", "dy", "dz"), strict=True)])
    out = out.withColumn("d", F.expr("sqrt(dx * dx + dy * dy + dz * dz)"))
    return out.where((F.col("d") < cutoff) & (F.col("d") > NEAREST))


def brute_pairs(atoms: DataFrame, frames: DataFrame, cutoff: float) -> DataFrame:
    """Equi-join on the frame, then only the shifts that the plane distances allow for each pair."""
    one = _placed(atoms, frames).withColumnsRenamed({"atom_id": "i", "type": "ti"})
    two = _placed(atoms, frames).select("frame_id", F.col("atom_id").alias("j"), F.col("type").alias("tj"), *[F.col(c).alias(f"{c}2") for c in ("x", "y", "z", "fa", "fb", "fc")])
    both = one.join(two, "frame_id").select("*", *[(F.col(f"{a}2") - F.col(a)).alias(f"r{a}") for a in "xyz"])
    slack = 1e-9
    for axis, f, w in (("sa", "fa", "w0"), ("sb", "fb", "w1"), ("sc", "fc", "w2")):
        reach = f"({X.number(cutoff)} / {w} + {X.number(slack)})"
        lo, hi = f"ceil(-{reach} - ({f}2 - {f}))", f"floor({reach} - ({f}2 - {f}))"
        both = both.withColumn(axis, F.explode(F.expr(f"CASE WHEN {lo} <= {hi} THEN sequence({lo}, {hi}) END")))
    return _measured(both, cutoff)


def _counted(rows: DataFrame, cutoff: float) -> DataFrame:
    """Bins in each direction (na, nb, nc) from the widths, and how many bins a cutoff reaches (ka, kb, kc).

    A bin is at least a cutoff wide, so one step reaches; a direction thinner than the cutoff is one bin, whose
    images are looked at as far as the cutoff goes.
    """
    rc = X.number(cutoff)
    for k, w in zip("abc", WIDTHS, strict=True):
        rows = rows.withColumn(f"n{k}", F.expr(f"greatest(cast(floor({w} / {rc}) as bigint), 1L)"))
        rows = rows.withColumn(f"k{k}", F.expr(f"CASE WHEN {w} >= {rc} THEN 1L ELSE cast(ceil({rc} / {w}) as bigint) END"))
    return rows


def bins(atoms: DataFrame, frames: DataFrame, cutoff: float) -> DataFrame:
    """Atoms wrapped into the cell, with their bin (ba, bb, bc), the bins in each direction and their reach."""
    out = _placed(atoms, frames)
    for f in ("fa", "fb", "fc"):
        out = out.withColumn(f, F.expr(f"{f} - floor({f})"))
    out = _counted(out, cutoff)
    for n, f, b in (("na", "fa", "ba"), ("nb", "fb", "bb"), ("nc", "fc", "bc")):
        out = out.withColumn(b, F.expr(f"least(cast(floor({f} * {n}) as bigint), {n} - 1)"))
    wrapped = X.cartesian(["fa", "fb", "fc"], CELL)
    return out.select("frame_id", "atom_id", "type", *CELL, "na", "nb", "nc", "ka", "kb", "kc", "ba", "bb", "bc", *[F.expr(e).alias(a) for e, a in zip(wrapped, "xyz", strict=True)])


#: Offsets to half of the 26 bins around one, and to itself.
HALF = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]


def _offsets() -> Column:
    """Half of the bins within reach. They count on over the cell's edges: a bin met again there is another image."""
    one = F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{k}") for k, x in zip("abc", o, strict=True)]) for o in HALF])
    steps = lambda k: F.sequence(-F.col(f"k{k}"), F.col(f"k{k}"))
    row = lambda a, b: F.transform(steps("c"), lambda c: F.struct(a.alias("oa"), b.alias("ob"), c.alias("oc")))
    every = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("ka")), lambda a: F.flatten(F.transform(steps("b"), lambda b: row(a, b)))))
    half = F.filter(every, lambda o: (o["oa"] > 0) | (o["ob"] > 0) | ((o["ob"] == 0) & (o["oc"] >= 0)))
    return F.when(F.greatest("ka", "kb", "kc") == 1, one).otherwise(half)


def cell_list_pairs(atoms: DataFrame, frames: DataFrame, cutoff: float, whole_below: int = 4096) -> DataFrame:
    """Pairs by the bins around each atom, for cells of any shape. Frames below ``whole_below`` atoms are binned where their
    atoms land, without sending them once for each bin; larger ones by binned_join."""
    large = atoms.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= whole_below).select("frame_id")
    if large.isEmpty():
        return whole_pairs(atoms, frames, cutoff, by_bins=True)
    big, small = ([t.join(large, "frame_id", how) for t in (atoms, frames)] for how in ("left_semi", "left_anti"))
    return binned_join(*big, cutoff).unionByName(whole_pairs(*small, cutoff, by_bins=True))


def binned_join(atoms: DataFrame, frames: DataFrame, cutoff: float) -> DataFrame:
    """Equi-join on frame and bin over the bins around each atom.

    Atoms go to their own bin and to half of those around it, with the position that they have as seen from there,
    and the bin's number; each pair is met once and gives both of its directions. With one or two bins in a
    direction (slabs, wires, small boxes) an atom goes to a bin once for each image of it that is in reach.
    """
    binned = bins(atoms, frames, cutoff)
    bin_of = lambda a, b, c: ((a * F.col("nb") + b) * F.col("nc") + c).alias("bin")
    two = binned.select("frame_id", bin_of(F.col("ba"), F.col("bb"), F.col("bc")), F.col("atom_id").alias("j"), F.col("type").alias("tj"), *[F.col(a).alias(f"{a}j") for a in "xyz"])
    one = binned.withColumn("o", F.explode(_offsets()))
    there = {k: F.col(f"b{k}") + F.col(f"o.o{k}") for k in "abc"}
    shift = {k: F.floor(there[k] / F.col(f"n{k}")) for k in "abc"}
    seen = [(F.col(a) - sum((shift[n] * F.col(f"c{3 * m + k}") for m, n in enumerate("abc")), F.lit(0.0))).alias(f"{a}i") for k, a in enumerate("xyz")]
    own = (F.col("o.oa") == 0) & (F.col("o.ob") == 0) & (F.col("o.oc") == 0)
    one = one.select("frame_id", bin_of(*[F.pmod(there[k], F.col(f"n{k}")) for k in "abc"]), F.col("atom_id").alias("i"), F.col("type").alias("ti"), *seen, own.alias("own"))
    both = one.join(two, ["frame_id", "bin"]).where("not own or i < j")
    both = both.select("frame_id", "i", "j", "ti", "tj", *[(F.col(f"{a}j") - F.col(f"{a}i")).alias(f"d{a}") for a in "xyz"])
    both = both.withColumn("d", F.expr("sqrt(dx * dx + dy * dy + dz * dz)")).where((F.col("d") < cutoff) & (F.col("d") > NEAREST))
    columns = ("i", "j", "ti", "tj", "dx", "dy", "dz", "d")
    back = {"i": F.col("j"), "j": F.col("i"), "ti": F.col("tj"), "tj": F.col("ti")} | {f"d{a}": 0.0 - F.col(f"d{a}") for a in "xyz"}
    rows = F.array(F.struct(*columns), F.struct(*[back.get(c, F.col(c)).alias(c) for c in columns]))
    return both.select("frame_id", F.inline(rows))


def usable(atoms: DataFrame, frames: DataFrame, cutoff: float, least_atoms: int = 64, large: int = 4096) -> DataFrame:
    """frame_id and ok: whether the cell list is worth it, by its bins against the 14 that each atom goes to. Frames of
    ``large`` atoms and more take it with any bins, since else a frame is one key of the join."""
    sizes = atoms.groupBy("frame_id").agg(F.count(F.lit(1)).alias("natoms"))
    counted = _counted(geometry(frames), cutoff).join(sizes, "frame_id")
    enough = (F.col("na") * F.col("nb") * F.col("nc") > len(HALF)) & (F.col("natoms") >= least_atoms)
    return counted.select("frame_id", (enough | (F.col("natoms") >= large)).alias("ok"))


def neighbor_pairs(atoms: DataFrame, frames: DataFrame, cutoff: float, least_atoms: int = 64) -> DataFrame:
    """Each frame by the strategy that fits it: cell lists where they are usable, else all shifts of all pairs. Frames below
    4096 atoms are searched where their atoms land."""
    large = 4096
    big = atoms.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= large).select("frame_id")
    if big.isEmpty():
        return whole_pairs(atoms, frames, cutoff, least_atoms=least_atoms, least_bins=len(HALF) + 1)
    (some, cells), few = ([t.join(big, "frame_id", how) for t in (atoms, frames)] for how in ("left_semi", "left_anti"))
    return binned_join(some, cells, cutoff).unionByName(whole_pairs(*few, cutoff, least_atoms=least_atoms, least_bins=len(HALF) + 1))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Half lists (i <= j) to directed ones."""
    back = pairs.where("i != j").select("frame_id", F.col("j").alias("i"), F.col("i").alias("j"), F.col("tj").alias("ti"), F.col("ti").alias("tj"), *[(-F.col(c)).alias(c) for c in ("dx", "dy", "dz")], "d")
    return pairs.unionByName(back)


def neighbor_counts(atoms: DataFrame, pairs: DataFrame, radial: float, angular: float) -> DataFrame:
    """Per atom, zero included: neighbors within each cutoff."""
    count = lambda rc: F.count(F.when(F.col("d") < rc, 1))
    # a row without a distance for every atom in place of a join: it counts as none
    every = pairs.select("frame_id", F.col("i").alias("atom_id"), "d").unionByName(atoms.select("frame_id", "atom_id", F.lit(None).cast("double").alias("d")))
    return every.groupBy("frame_id", "atom_id").agg(count(radial).alias("n_radial"), count(angular).alias("n_angular"))


def most_neighbors(counts: DataFrame) -> DataFrame:
    return counts.agg(F.max("n_radial").alias("max_radial"), F.max("n_angular").alias("max_angular"))


def vacuum_box(atoms: DataFrame, cutoff: float) -> DataFrame:
    """frames for atoms without a cell: span + 4 cutoffs + 1 in each direction."""
    side = lambda a: F.max(a) - F.min(a) + F.lit(4.0 * cutoff + 1.0)
    zero = F.lit(0.0)
    spans = atoms.groupBy("frame_id").agg(*[side(a).alias(a) for a in "xyz"])
    return spans.select("frame_id", F.array("x", zero, zero, zero, "y", zero, zero, zero, "z").alias("cell"))
