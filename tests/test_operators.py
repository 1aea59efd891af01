import numpy as np
import pytest

from pericell.kernels.pairs import frame_pairs
from pericell.operators import descriptors as D
from pericell.operators import neighbors as N
from pericell.operators import sampling as S

CELLS = {1: np.diag([30.0, 30, 30]), 2: np.array([[40.0, 0, 0], [4, 40, 0], [3, 2, 40]]), 3: np.diag([8.0, 8, 8]), 4: np.diag([3.0, 4, 5]), 5: np.diag([30.0, 30, 30])}
SIZES = {1: 120, 2: 150, 3: 20, 4: 2, 5: 0}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    atoms = [(f, a, int(rng.integers(0, 2)), *map(float, rng.uniform(-6, 36, 3))) for f, n in SIZES.items() for a in range(n)]
    frames = [(f, [float(x) for x in c.ravel()], None) for f, c in CELLS.items()]
    return spark.createDataFrame(atoms, "frame_id bigint, atom_id bigint, type int, x double, y double, z double"), spark.createDataFrame(frames, "frame_id bigint, cell array<double>, energy double"), atoms


def rows(df):
    return sorted((r.frame_id, r.i, r.j, round(r.dx, 6), round(r.dy, 6), round(r.dz, 6)) for r in df.collect())


def expected(atoms, frames):
    out = []
    for f in frames:
        xyz = np.array([a[3:] for a in atoms if a[0] == f]).reshape(-1, 3)
        i, j, r = frame_pairs(xyz, CELLS[f], 6.0)
        out += [(f, a, b, *np.round(v, 6)) for a, b, v in zip(i.tolist(), j.tolist(), r.tolist(), strict=True)]
    return sorted(out)


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3:] for x in a], [x[3:] for x in b], atol=2e-6)


def test_brute_pairs(data):
    close(rows(N.brute_pairs(data[0], data[1], 6.0)), expected(data[2], CELLS))


def test_cell_list_where_usable(data):
    frames = data[1].where("frame_id <= 2")
    close(rows(N.cell_list_pairs(data[0].where("frame_id <= 2"), frames, 6.0)), expected(data[2], (1, 2)))


def test_strategy_covers_all_frames(data):
    ok = {r.frame_id: r.ok for r in N.usable(data[0], data[1], 6.0).collect()}
    assert ok == {1: True, 2: True, 3: False, 4: False}
    close(rows(N.neighbor_pairs(data[0], data[1], 6.0)), expected(data[2], CELLS))


#: Slabs, wires and boxes with one or two bins in a direction, also thinner than half of the cutoff, upright and skewed.
THIN = {
    1: np.diag([40.0, 40, 2]),
    2: np.diag([4.0, 60, 5]),
    3: np.diag([13.0, 12.5, 14]),
    4: np.diag([7.0, 50, 13]),
    5: np.array([[40.0, 0, 0], [9, 30, 0], [2, 1, 3.5]]),
    6: np.array([[5.0, 1, 0], [0, 6.1, 1], [1, 0, 70]]),
    7: np.diag([6.0, 6, 6]),
    8: np.diag([2.5, 2.6, 2.7]),
}


def test_thin_frames_by_bins(spark):
    rng = np.random.default_rng(8)
    atoms = [(f, a, a % 2, *map(float, rng.uniform(-6, 46, 3))) for f in THIN for a in range(70 if f < 7 else 4)]
    given = spark.createDataFrame(atoms, "frame_id bigint, atom_id bigint, type int, x double, y double, z double")
    frames = spark.createDataFrame([(f, [float(x) for x in c.ravel()], None) for f, c in THIN.items()], "frame_id bigint, cell array<double>, energy double")
    binned = N.cell_list_pairs(given, frames, 6.0)
    close(rows(binned), rows(N.brute_pairs(given, frames, 6.0)))
    assert {r.frame_id for r in binned.where("i = j").collect()} >= {1, 2, 5, 6, 8}  # own images
    ok = {r.frame_id: r.ok for r in N.usable(given, frames, 6.0).collect()}
    assert ok == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False, 8: False}
    assert {r.ok for r in N.usable(given, frames, 6.0, large=4).collect()} == {True}
    close(rows(N.neighbor_pairs(given, frames, 6.0)), rows(binned))


def test_a_slab_is_dealt_by_bins(spark):
    """20,000 atoms in a slab thinner than the cutoff: candidates stay in proportion to atoms, and no bin has a large share."""
    rng = np.random.default_rng(9)
    xyz = np.column_stack([rng.uniform(0, 300, (20_000, 2)), rng.uniform(0, 2.5, 20_000)])
    given = spark.createDataFrame([(1, k, 0, *map(float, x)) for k, x in enumerate(xyz)], "frame_id bigint, atom_id bigint, type int, x double, y double, z double")
    frames = spark.createDataFrame([(1, np.diag([300, 300, 2.5]).ravel().tolist(), None)], "frame_id bigint, cell array<double>, energy double")
    assert N.bins(given, frames, 4.0).groupBy("ba", "bb", "bc").count().agg({"count": "max"}).first()[0] < 40
    i, j, r = frame_pairs(xyz, np.diag([300, 300, 2.5]), 4.0)
    counts = {r.i: r["count"] for r in N.neighbor_pairs(given, frames, 4.0).groupBy("i").count().collect()}
    assert counts == {k: c for k, c in enumerate(np.bincount(i, minlength=20_000).tolist()) if c}


def test_half_list_mirrored(data):
    full = N.brute_pairs(data[0], data[1].where("frame_id < 4"), 6.0)
    close(rows(N.mirrored(full.where("i <= j"))), rows(full))


def test_columns_agree_with_kernel(spark, data):
    from pericell.kernels.potential import Batch, compute
    from pericell.model import Model, Shape
    from pericell.predict import predict_atoms, predict_large

    model = Model.random(Shape(("A", "B"), 6.0, 4.0, 2, 1, 3, 3, 2, ("222",), 5), 2, uniform=True)
    model.q_scaler = np.linspace(0.5, 1.5, model.shape.dim)
    near = N.brute_pairs(data[0], data[1], 6.0)
    q = D.descriptors(data[0], near, model.c2, model.c3, 6.0, 4.0, 2, ["222"])
    names = D.components(q)
    got = {(r.frame_id, r.atom_id): [r[n] for n in names] for r in q.collect()}
    energies = {(r.frame_id, r.atom_id): r.energy for r in predict_large(data[0], data[1], model).collect()}
    spread = {(r.frame_id, r.atom_id): r for r in predict_atoms(data[0], data[1], model, descriptor=True).collect()}
    assert len(got) == len(energies) == len(spread) == sum(SIZES.values())
    for f in (1, 2, 3, 4):
        own = [a for a in data[2] if a[0] == f]
        xyz, kinds = np.array([a[3:] for a in own]), np.array([a[2] for a in own])
        out = compute(model, Batch(kinds, np.zeros(len(own), int), *frame_pairs(xyz, CELLS[f], 6.0)))
        for a in range(len(own)):
            assert np.allclose(np.array(got[f, a]) * model.q_scaler, out["descriptor"][a], atol=1e-9)
            assert np.isclose(energies[f, a], out["energy"][a], atol=1e-9) and np.isclose(spread[f, a].energy, out["energy"][a], atol=1e-9)
            assert np.allclose([spread[f, a].fx, spread[f, a].fy, spread[f, a].fz], out["forces"][a], atol=1e-9)


def test_large_frames_give_forces_and_virials(spark, data):
    """Frames in blocks of a few atoms, with repulsion and all channels, against whole frames."""
    from pericell.functions import tables
    from pericell.model import Model, Shape
    from pericell.predict import predict_atoms, predict_blocks, predict_large, predict_sized

    model = Model.random(Shape(("Cr", "Ni"), 5.0, 4.0, 2, 1, 3, 3, 4, tables.CHANNELS, 5, (1.0, 2.5)), 2, uniform=True)
    names = ["energy", "fx", "fy", "fz", *[f"v{k}" for k in range(9)]]
    numbers = lambda df: {(r.frame_id, r.atom_id): [*(r[n] for n in names), *r.q] for r in df.collect()}
    want = numbers(predict_atoms(data[0], data[1], model, descriptor=True))
    for df in (predict_large(data[0], data[1], model, descriptor=True, block=8), predict_blocks(data[0], data[1], model, descriptor=True, block=8), predict_sized(data[0], data[1], model, descriptor=True, tiled_from=sorted(SIZES.values())[-2])):
        got = numbers(df)
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-8, atol=1e-8) for k in want)


def test_forces_by_columns_are_the_kernels(spark, data):
    """Angular slopes by the product rule, for all channels and L = 4, joined on pairs; atoms without pairs stay."""
    from pericell.functions import tables
    from pericell.model import Model, Shape
    from pericell.predict import predict_atoms

    model = Model.random(Shape(("Cr", "Ni"), 5.0, 4.0, 1, 0, 2, 2, 4, tables.CHANNELS, 3), 2, uniform=True)
    model.q_scaler = np.linspace(0.5, 1.5, model.shape.dim)
    frames = data[1].where("frame_id IN (3, 4)")
    atoms = data[0].where("frame_id IN (3, 4)")
    weights = {t: (model.w0[t], model.b0[t], model.w1[t]) for t in range(2)}
    got = D.net_forces(atoms, N.brute_pairs(atoms, frames, 5.0), model.c2, model.c3, 5.0, 4.0, 4, list(tables.CHANNELS), weights, model.q_scaler)
    names = ["fx", "fy", "fz", *[f"v{k}" for k in range(9)]]
    numbers = lambda df: {(r.frame_id, r.atom_id): [r[n] for n in names] for r in df.collect()}
    got, want = numbers(got), numbers(predict_atoms(atoms, frames, model))
    assert got.keys() == want.keys() and len(got) == 22
    assert all(np.allclose(got[k], want[k], rtol=1e-8, atol=1e-8) for k in want)


def test_blocks_of_atoms_with_their_pairs(spark, data):
    """Sums by blocks: every atom once, in any block size, with none, one or many pairs."""
    near = N.brute_pairs(data[0], data[1], 6.0)
    want = {(f, a): [0.0, 0.0] for f, a, *_ in data[2]}
    for r in near.collect():
        want[r.frame_id, r.i][0] += 1
        want[r.frame_id, r.i][1] += r.dx * (1 + r.tj) * (1 + r.ti)
    for block in (7, 10_000):

        def run(types, at, tj, r):
            return D.summed(at, np.stack([np.ones(len(at)), r[:, 0] * (1 + tj) * (1 + types[at])]), len(types))

        got = D.on_blocks(data[0], near, run, ["n", "x"], block).collect()
        assert len(got) == len(want) and all(np.allclose([r.n, r.x], want[r.frame_id, r.atom_id]) for r in got)
        assert {(r.frame_id, r.atom_id, r.type) for r in got} == {a[:3] for a in data[2]}


def test_blocks_of_space(spark):
    """A large frame: every atom is own once, halos hold what is in reach and little more, blocks are even, forces are the whole frame's."""
    from pericell.model import Model, Shape
    from pericell.operators.blocks import blocked
    from pericell.predict import predict_atoms, predict_blocks, predict_sized

    rng, side = np.random.default_rng(10), 40.0
    rows = [(1, k, k % 2, *map(float, x)) for k, x in enumerate(rng.uniform(-5, 45, (4000, 3)))]
    rows += [(2, k, 0, *map(float, x)) for k, x in enumerate(rng.uniform(0, 9, (30, 3)))]
    atoms = spark.createDataFrame(rows, "frame_id bigint, atom_id bigint, type int, x double, y double, z double")
    cells = {1: np.diag([side] * 3), 2: np.array([[9.0, 0, 0], [1, 4, 0], [0, 2, 14]])}
    frames = spark.createDataFrame([(f, [float(x) for x in c.ravel()], None) for f, c in cells.items()], "frame_id bigint, cell array<double>, energy double")
    sent = blocked(atoms, frames, 4.0, 500).where("frame_id = 1").toPandas()
    own = sent[sent.own]
    assert sorted(own.atom_id) == list(range(4000)) and own.groupby("block").size().max() < 600 and own.block.nunique() >= 8
    i, j, _ = frame_pairs(np.array([r[3:] for r in rows if r[0] == 1]), cells[1], 4.0)
    home = own.set_index("atom_id").block.loc[range(4000)].to_numpy()
    needed = {(int(home[a]), int(b)) for a, b in zip(i, j, strict=True) if home[a] != home[b]}
    halo = {(b, a) for b, a in zip(sent.block[~sent.own], sent.atom_id[~sent.own], strict=True)}
    assert needed <= halo and len(sent) < 0.5 * len(i)  # atoms, not pairs
    assert all(abs(x - round(x)) < 1e-9 for x in ((sent.merge(own, on="atom_id").eval("x_x - x_y")) / side))
    model = Model.random(Shape(("A", "B"), 4.0, 3.5, 2, 1, 3, 3, 2, ("222",), 5), 2, uniform=True)
    numbers = lambda df: {(r.frame_id, r.atom_id): [r.energy, r.fx, r.fy, r.fz, r.v0, r.v4, r.v5] for r in df.collect()}
    want = numbers(predict_atoms(atoms, frames, model))
    for df in (predict_blocks(atoms, frames, model, block=500), predict_sized(atoms, frames, model, tiled_from=1000)):
        got = numbers(df)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-8, atol=1e-8) for k in want)


def test_unknown_species_raises(spark):
    df = spark.createDataFrame([("Pb",), ("Xx",)], "species string")
    with pytest.raises(Exception, match="unknown species"):
        S.type_ids(df, ["Te", "Pb"]).collect()


def test_split_is_exact_and_stable(spark):
    frames = spark.range(205).withColumnRenamed("id", "frame_id")
    a = {r.frame_id: r.valid for r in S.split(frames, 0.1, 3).collect()}
    b = {r.frame_id: r.valid for r in S.split(frames.repartition(7), 0.1, 3).collect()}
    assert a == b and sum(a.values()) == round(20.5)
    assert a != {r.frame_id: r.valid for r in S.split(frames, 0.1, 4).collect()}
    for ratio, seed in ((0, 1), (1, 1), (0.5, None)):
        with pytest.raises(ValueError):
            S.holdout_size(10, ratio, seed)
    with pytest.raises(ValueError):
        S.holdout_size(1, 0.5, 1)


def test_batches_and_offsets(spark):
    frames = spark.range(10_000).withColumnRenamed("id", "frame_id").selectExpr("frame_id", "frame_id % 5 AS natoms")
    sizes = [r["count"] for r in S.batches(frames.select("frame_id"), 1, 2, 64).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [64] * 156 + [16]
    got = S.offsets(frames).orderBy("frame_id").collect()
    n = np.array([r.natoms for r in got])
    assert [r["offset"] for r in got] == (np.cumsum(n) - n).tolist()
