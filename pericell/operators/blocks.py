"""Frames cut into blocks of neighboring atoms, with the atoms around each block.

A frame's bins (at least a cutoff wide) are put on a space-filling curve, and the curve
is cut where about ``block`` atoms are full, so a block is a compact piece of space. A
block gets its own atoms and, as its halo, the atoms of bins next to its bins, at the
image from which they are seen. Nothing but atoms is sent: those in the middle of
a block once, those near its surface also to the blocks around. Which bins go where is
found from the occupied bins alone, with their counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.pairs import cloud_tiles, squares
from .neighbors import CELL, bins, geometry

#: Bits of a bin's number in each direction (the curve's numbers have three times as many).
DEPTH = 20
#: Places on the curve (as bits) that are summed together before running sums are taken.
SPAN = 12
KEY = ["frame_id", "ba", "bb", "bc"]
#: Most and fewest atoms of a block of space. A cutoff may reach thousands of atoms, and a block is then not much wider than its halo.
BLOCK, LEAST = 32_768, 2048


def curve(a: str, b: str, c: str) -> Column:
    """The place of a bin on the curve: the bits of its three numbers in turn."""
    bits = [f"shiftleft(shiftright({x}, {k}) & 1L, {3 * k + d})" for k in range(DEPTH) for d, x in enumerate((a, b, c))]
    return F.expr(" | ".join(bits))


def placed(binned: DataFrame, block: int) -> DataFrame:
    """Occupied bins (frame_id, ba, bb, bc and what bins has of them) with their ``block``.

    Atoms before a bin on the curve are summed in two levels, so a window spans 2**SPAN bins or a frame's spans.
    """
    shape = ["na", "nb", "nc", "ka", "kb", "kc"]
    held = binned.groupBy(*KEY, *shape).agg(F.count(F.lit(1)).alias("held")).withColumn("place", curve("ba", "bb", "bc"))
    held = held.withColumn("span", F.shiftright("place", SPAN))
    before = lambda key, by, what: F.coalesce(F.sum(what).over(Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = held.groupBy("frame_id", "span").agg(F.sum("held").alias("all"))
    spans = spans.select("frame_id", "span", before(["frame_id"], "span", "all").alias("ahead"))
    near = held.withColumn("near", before(["frame_id", "span"], "place", "held")).join(spans, ["frame_id", "span"])
    return near.select(*KEY, *shape, F.floor((F.col("ahead") + F.col("near")) / block).alias("block"))


def routes(cells: DataFrame) -> DataFrame:
    """frame_id, ba, bb, bc, block, sa, sb, sc: the blocks that need a bin's atoms, and the image they see of it, each once."""
    steps = lambda k: F.explode(F.sequence(-F.col(f"k{k}"), F.col(f"k{k}")))
    out = cells.drop("block")
    for k in "abc":
        out = out.withColumn(f"o{k}", steps(k))
    there = {k: F.col(f"b{k}") + F.col(f"o{k}") for k in "abc"}
    seen = out.select(*KEY, *[F.pmod(there[k], F.col(f"n{k}")).alias(f"t{k}") for k in "abc"], *[(-F.floor(there[k] / F.col(f"n{k}"))).alias(f"s{k}") for k in "abc"])
    target = cells.select("frame_id", *[F.col(f"b{k}").alias(f"t{k}") for k in "abc"], "block")
    return seen.join(target, ["frame_id", "ta", "tb", "tc"]).select(*KEY, "block", "sa", "sb", "sc").distinct()


def _sent(atoms: DataFrame, frames: DataFrame, cutoff: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Atoms with their bins, and for each bin and block that needs its atoms: how far the image it sees is off (mx, my, mz), and whether it owns them."""
    binned = bins(atoms, frames, cutoff)
    cells = placed(binned, block)
    ways = routes(cells).join(cells.select(*KEY, F.col("block").alias("home")), KEY).join(geometry(frames).select("frame_id", *CELL), "frame_id")
    off = [sum((F.col(f"s{k}") * F.col(CELL[3 * m + n]) for m, k in enumerate("abc")), F.lit(0.0)).alias(f"m{a}") for n, a in enumerate("xyz")]
    still = (F.col("sa") == 0) & (F.col("sb") == 0) & (F.col("sc") == 0)
    return binned, ways.select(*KEY, "block", *off, (still & (F.col("block") == F.col("home"))).alias("own"))


def blocked(atoms: DataFrame, frames: DataFrame, cutoff: float, block: int = BLOCK) -> DataFrame:
    """frame_id, block, atom_id, type, x, y, z, own: every block's own atoms and its halo.

    All pairs closer than the cutoff with an own atom as center are among the atoms of its block, as they stand.
    """
    binned, ways = _sent(atoms, frames, cutoff, block)
    return binned.join(ways, KEY).select("frame_id", "block", "atom_id", "type", *[(F.col(a) + F.col(f"m{a}")).alias(a) for a in "xyz"], "own")


def in_blocks(atoms: DataFrame, frames: DataFrame, cutoff: float, kernel: Callable[[pa.Table], pa.Table], schema: str, block: int | None = None) -> DataFrame:
    """kernel of tables as blocked gives them, in order of frame and block, with some blocks in each.

    A block is sent an atom once, however many images it sees, and makes the images itself: in a thin slab they are most of its
    halo. There are as many parts as blocks are full, so blocks of small frames share a call.
    """
    n = atoms.count()
    block = block or min(BLOCK, max(LEAST, n // (4 * atoms.sparkSession.sparkContext.defaultParallelism)))
    parts = max(1, -(-n // block))
    binned, ways = _sent(atoms, frames, cutoff, block)
    part = F.pmod(F.xxhash64("frame_id", "block"), F.lit(parts)).alias("part")
    none = {c: F.lit(None).cast(binned.schema[c].dataType) for c in ("atom_id", "type")}
    sent = binned.join(ways.select(*KEY, "block").distinct(), KEY).select(*KEY, "block", "atom_id", "type", "x", "y", "z", F.lit(None).cast("boolean").alias("own"))
    ways = ways.select(*KEY, "block", *[v.alias(c) for c, v in none.items()], *[F.col(f"m{a}").alias(a) for a in "xyz"], "own")
    dealt = sent.unionByName(ways).withColumn("part", F.pmod(F.xxhash64("frame_id", "block"), F.lit(parts)))

    def images(table: pa.Table) -> pa.Table:
        atom = pc.is_null(table.column("own"))  # the other rows are ways
        here = table.filter(atom).drop_columns(["own", "part"])
        ways = table.filter(pc.invert(atom)).drop_columns(["atom_id", "type", "part"]).rename_columns([*KEY, "block", "mx", "my", "mz", "own"])
        both = ways.join(here, [*KEY, "block"], join_type="inner", use_threads=False)
        moved = [pc.add(both.column(a), both.column(f"m{a}")) for a in "xyz"]
        names = ["frame_id", "block", "atom_id", "type", "x", "y", "z", "own"]
        found = pa.Table.from_arrays([both.column(c) for c in names[:4]] + moved + [both.column("own")], names)
        return kernel(found.sort_by([("frame_id", "ascending"), ("block", "ascending")]))

    return dealt.repartition(parts, "part").groupBy("part").applyInArrow(images, schema)


def each_block(table: pa.Table) -> list[tuple[int, int]]:
    """First and last row of each block of a table in order of frame and block."""
    frame, block = table.column("frame_id").to_numpy(), table.column("block").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (np.diff(frame) != 0) | (np.diff(block) != 0)]))
    return list(zip(first.tolist(), [*first[1:].tolist(), len(frame)], strict=True))


def on_space(atoms: DataFrame, frames: DataFrame, cutoff: float, terms: Callable, names: list[str], block: int | None = None) -> DataFrame:
    """frame_id, atom_id and sums over each atom's pairs, by blocks of space; no pair leaves its task.

    ``terms`` gets atom_ids of centers [a, 1] and of the points around them [1, b], whether they are pairs [a, b] and their
    distances [a, b], the cutoff for those that are not; it gives each center's sums, [name, a].
    """
    (frame, atom) = (atoms.schema[c].dataType.simpleString() for c in ("frame_id", "atom_id"))
    schema = f"frame_id {frame}, atom_id {atom}, {', '.join(f'{n} double' for n in names)}"

    def kernel(table: pa.Table) -> pa.Table:
        atom, own = (table.column(c).to_numpy() for c in ("atom_id", "own"))
        xyz = np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1)
        sums = np.zeros((len(names), len(atom)))
        for a, b in each_block(table):
            for rows, cols in cloud_tiles(xyz[a:b], own[a:b], cutoff):
                one, two = (np.ascontiguousarray(xyz[a + x].T) for x in (rows, cols))
                for at, square in squares(one, two, cutoff):
                    near, mine = square < cutoff * cutoff, a + rows[at]
                    sums[:, mine] = terms(atom[mine][:, None], atom[a + cols], near, np.sqrt(square, out=square))
        mine = np.flatnonzero(own)
        ids = [table.column(c).take(pa.array(mine)) for c in ("frame_id", "atom_id")]
        return pa.Table.from_arrays([*ids, *(pa.array(x[mine]) for x in sums)], ["frame_id", "atom_id", *names])

    return in_blocks(atoms, frames, cutoff, kernel, schema, block)
