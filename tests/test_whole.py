"""Frames that fit a task: streams, pairs and sums of whole frames, and what the queries send."""

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from pericell.kernels.pairs import binned_pairs, many_pairs
from pericell.operators import descriptors as D
from pericell.operators import neighbors as N
from pericell.operators import whole as W

SF = "/root/testdata/sf0.001"


def test_streams_are_cut_between_frames():
    frame = np.repeat([5, 3, 9, 1, 7], [3, 40, 1, 2, 30])
    table = pa.table({"frame_id": frame, "k": np.arange(len(frame))})
    for size in (1, 7, 100):
        for least in (1, 5, 1000):
            parts = list(W.whole(iter(table.to_batches(size)), least))
            assert pa.concat_tables(parts).column("k").to_pylist() == list(range(len(frame)))
            seen = [f for p in parts for f in set(p.column("frame_id").to_pylist())]
            assert sorted(seen) == [1, 3, 5, 7, 9]


def test_cell_lists_of_many_frames():
    rng = np.random.default_rng(1)
    cells = np.array([np.diag([8.0, 8, 8]), [[12.0, 0, 0], [3, 11, 0], [1, 2, 9]], np.diag([3.0, 20, 5]), np.diag([30.0, 30, 30])])
    n = np.array([7, 30, 12, 0])
    xyz, first = rng.uniform(-9, 20, (n.sum(), 3)), np.cumsum(n) - n
    near = lambda find: sorted((a, b, *np.round(v, 9)) for a, b, v in zip(*find(xyz, first, cells, 4.0), strict=True))
    a, b = near(binned_pairs), near(many_pairs)
    assert len(a) == len(b) > 100 and np.allclose(a, b)


@pytest.fixture(scope="module")
def mixed(spark):
    """Frames with and without pairs, one without a cell, atoms without a type."""
    rng = np.random.default_rng(3)
    atoms = [(f, a, None if a == 3 else a % 2, *map(float, rng.uniform(0, 8, 3))) for f in range(6) for a in range(f + 1)]
    cells = [(f, np.diag([8.0] * 3).ravel().tolist()) for f in range(5)]
    return spark.createDataFrame(atoms, "frame_id bigint, atom_id bigint, type int, x double, y double, z double"), spark.createDataFrame(cells, "frame_id bigint, cell array<double>")


def numbers(df, skip=("type",)):
    return {(r.frame_id, r.atom_id): [r[c] for c in df.columns if c not in ("frame_id", "atom_id", *skip)] for r in df.collect()}


def same(a, b):
    a, b = numbers(a), numbers(b)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


def test_sums_of_whole_frames_are_those_of_pairs(mixed):
    atoms, frames = mixed
    rng = np.random.default_rng(4)
    c2, c3 = rng.normal(size=(2, 2, 2, 4)), rng.normal(size=(2, 2, 2, 4))
    near = N.brute_pairs(atoms, frames, 6.0)
    same(D.whole_radial(atoms, frames, c2, 6.0), D.radial(atoms, near, c2, 6.0))
    known, pairs = atoms.where("type IS NOT NULL"), near.where("ti IS NOT NULL AND tj IS NOT NULL")
    known_pairs = N.brute_pairs(known, frames, 6.0)
    assert pairs.count() == known_pairs.count()
    same(D.whole_moments(known, frames, c3, 4.0, 2), D.angular_moments(known, known_pairs, c3, 4.0, 2))
    same(D.whole_descriptors(known, frames, c2, c3, 6.0, 4.0, 2, ["222"]), D.descriptors(known, known_pairs, c2, c3, 6.0, 4.0, 2, ["222"]))
    slopes = [0.5, -1.0]
    same(W.on_frames(known, frames, 6.0, D.radial_forces_by(c2, 6.0, slopes), D.FORCE_NAMES), D.forces(known, D.radial_gradients(known_pairs, c2, 6.0, slopes)))
    by_frame = {r.frame_id: r for r in W.frame_sums(known, frames, 6.0, D.radial_forces_by(c2, 6.0, slopes), D.FORCE_NAMES).collect()}
    sums = {r.frame_id: r for r in D.forces(known, D.radial_gradients(known_pairs, c2, 6.0, slopes)).groupBy("frame_id").sum("v0").collect()}
    assert by_frame.keys() == sums.keys() and all(np.isclose(by_frame[f].v0, sums[f]["sum(v0)"]) for f in sums)


def test_atoms_without_near_pairs_have_zero_moments(spark):
    """Blocks without a pair in reach failed before."""
    atoms = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.0)], "frame_id bigint, atom_id bigint, type int, x double, y double, z double")
    frames = spark.createDataFrame([(1, np.diag([50.0] * 3).ravel().tolist())], "frame_id bigint, cell array<double>")
    c = np.ones((1, 1, 1, 3))
    for df in (D.whole_moments(atoms, frames, c, 4.0, 1), D.angular_moments(atoms, N.brute_pairs(atoms, frames, 4.0), c, 4.0, 1)):
        assert numbers(df) == {(1, 0): [0.0, 0.0, 0.0]}


def test_net_forces_of_whole_frames(mixed):
    from pericell.model import Model, Shape
    from pericell.predict import predict_atoms

    atoms, frames = mixed[0].where("type IS NOT NULL AND frame_id < 5"), mixed[1]
    model = Model.random(Shape(("A", "B"), 6.0, 4.0, 1, 1, 3, 3, 2, ("222", "112"), 3), 2, uniform=True)
    weights = {t: (model.w0[t], model.b0[t], model.w1[t]) for t in range(2)}
    got = D.whole_net_forces(atoms, frames, model.c2, model.c3, 6.0, 4.0, 2, ["222", "112"], weights, model.q_scaler)
    same(got, predict_atoms(atoms, frames, model).drop("energy"))


def test_tasks_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS_A_TASK", 500)
    df = entry.queries()["op_a24_bin_counts"](spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert "hashpartitioning(l_orderkey#" in (plan := df._jdf.queryExecution().executedPlan().toString()) and f", {-(-rows // 500)})" in plan


@pytest.mark.parametrize("name", ["a24_bin_counts", "m19_j4_forces_large", "j2_cell_list"])
def test_tasks_are_not_put_together(spark, monkeypatch, name):
    """In a session with many partitions too, which adaptive execution puts together to one here."""
    monkeypatch.setattr(W, "ROWS_A_TASK", 500)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = entry.queries()[f"op_{name}"](spark, SF)
        assert df.rdd.getNumPartitions() == -(-rows // 500)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", ["a24_bin_counts", "m19_angular_forces_large", "j2_cell_list", "k1_energy_table"])
def test_frames_are_not_broadcast(spark, name):
    """4.5 million frames were, since their equal cells compress to a few MB, and the driver ran out of memory."""
    assert "Broadcast" not in entry.queries()[f"op_{name}"](spark, SF)._jdf.queryExecution().executedPlan().toString()


#: Queries that send atoms and frames, and no pairs.
SENT_BY_FRAME = ["a1_a3_radial", "m19_j4_forces_large", "m19_predict_large", "m19_angular_forces_large", "a10_p13_p22_angular_forces", "p16_p20_invariants", "j2_cell_list", "a2_moments", "p10_p12_angular_basis", "j3_strategy", "k2_force_table", "a4_descriptor", "a7_a8_a10_forces", "a9_p28_p29_k4_stress", "p8_radial_basis", "p9_basis_slopes"]


@pytest.mark.parametrize("name", SENT_BY_FRAME)
def test_no_pairs_are_sent(spark, name):
    plan = entry.queries()[f"op_{name}"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "FlatMapGroupsInArrow" not in plan
    assert plan.count("Exchange hashpartitioning") <= (3 if name == "j3_strategy" else 2)  # its sums of a task go to their frame


def test_dense_clouds_are_searched_in_slices():
    """The pairs of all slices are those of the whole, and no slice has many."""
    from pericell.kernels.pairs import cloud_pairs, cloud_slices

    rng = np.random.default_rng(5)
    xyz, center = rng.uniform(-3, 9, (1500, 3)), rng.random(1500) < 0.4
    parts = list(cloud_slices(xyz, center, 4.0, 50_000))
    assert len(parts) > 5 and max(len(p[1]) for p in parts) < 60_000
    assert sorted(np.concatenate([p[0] for p in parts]).tolist()) == np.flatnonzero(center).tolist()
    got = sorted((i, j) for p in parts for i, j in zip(p[1].tolist(), p[2].tolist(), strict=True))
    i, j, _ = cloud_pairs(xyz, center, 4.0)
    assert got == sorted(zip(i.tolist(), j.tolist(), strict=True))


def test_slab_sends_no_pairs(spark):
    plan = entry.queries()["op_j2_slab"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "inline" not in plan


def test_dense_clouds_are_searched_by_matrices():
    """Every center is in one tile with all that it reaches, dense matrices are mostly pairs, and pairs at the cutoff are told exactly."""
    from pericell.kernels.pairs import cloud_pairs, cloud_tiles, squares

    rng = np.random.default_rng(6)
    for n, side, share in ((4000, 9.0, 0.3), (300, 60.0, 1.0), (30, 2.0, 0.5)):
        xyz = rng.integers(0, int(side * 8), (n, 3)) / 8  # many at the cutoff, some at one place
        center = (rng.random(n) < share) & (np.abs(xyz - side / 2) < side / 2 - (2 if share < 0.5 else -1)).all(axis=1)
        seen, got, cells = [], [], 0
        for rows, cols in cloud_tiles(xyz, center, 4.0):
            seen += rows.tolist()
            for at, d in squares(np.ascontiguousarray(xyz[rows].T), np.ascontiguousarray(xyz[cols].T), 4.0):
                assert d.max() <= 16.0
                i, j = np.nonzero(d < 16.0)
                got += zip(rows[at][i].tolist(), cols[j].tolist(), d[i, j].round(9).tolist(), strict=True)
                cells += d.size
        assert sorted(seen) == np.flatnonzero(center).tolist()
        i, j, r = cloud_pairs(xyz, center, 4.0)
        assert sorted(got) == sorted(zip(i.tolist(), j.tolist(), (r * r).sum(axis=1).round(9).tolist(), strict=True))
        assert n != 4000 or cells < 3 * len(i)


def test_blocks_of_a_dense_slab_are_sent_atoms_once(spark):
    """A slab of half the cutoff's height, dense: tasks get atoms once, make their images, and counts are those of its pairs."""
    from pericell.kernels.pairs import frame_pairs
    from pericell.operators.blocks import on_space

    rng = np.random.default_rng(7)
    xyz = np.column_stack([rng.integers(0, 256, 3000) / 8, rng.integers(0, 128, 3000) / 8, rng.integers(0, 16, 3000) / 8])
    atoms = spark.createDataFrame([(1, k, 0, *map(float, x)) for k, x in enumerate(xyz)], "frame_id bigint, atom_id bigint, type int, x double, y double, z double")
    cell = np.diag([32.0, 16, 2])  # whole powers of two, so that wrapping keeps pairs at the cutoff
    frames = spark.createDataFrame([(1, cell.ravel().tolist())], "frame_id bigint, cell array<double>")
    i, j, r = frame_pairs(xyz, cell, 4.0)
    terms = lambda i, j, near, d: [near.sum(axis=1), (d * near).sum(axis=1), (near & (i == j)).sum(axis=1)]
    out = on_space(atoms, frames, 4.0, terms, ["n", "d", "own"], 1000)
    got = {x.atom_id: (x.n, x.d, x.own) for x in out.collect()}
    count, length, own = np.bincount(i, minlength=3000), np.bincount(i, np.linalg.norm(r, axis=1), 3000), np.bincount(i[i == j], minlength=3000)
    assert len(got) == 3000 and all(got[k][::2] == (count[k], own[k]) and np.isclose(got[k][1], length[k]) for k in got)
