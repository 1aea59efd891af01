import warnings

import numpy as np
import pytest

from pericell.functions import tables
from pericell.kernels.potential import Batch, State, chebyshev, compute
from pericell.kernels.pairs import frame_pairs
from pericell.model import Model, Shape, load_model, parse_l_max, save_model

CELL = np.array([[7.0, 0, 0], [0.5, 7.5, 0], [0.3, 0.4, 8.0]])


def model(zbl=(1.0, 2.5), channels=tables.CHANNELS, seed=1, factor=None):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        shape = Shape(("Cr", "Ni"), 5.0, 4.0, 3, 2, 4, 3, 4, channels, 7, zbl, factor)
    m = Model.random(shape, seed, uniform=True)
    m.q_scaler = np.random.default_rng(9).uniform(0.5, 1.5, shape.dim)
    m.b1 = 0.3
    return m


def cluster(n=14, seed=3):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 8, (n, 3)), rng.integers(0, 2, n)


def batch(xyz, types, cell=CELL):
    return Batch(types, np.zeros(len(xyz), int), *frame_pairs(xyz, cell, 5.0))


def test_derived_tables():
    assert [len(tables.cubic(c)) for c in ("222", "112", "123", "233", "134")] == [8, 8, 21, 24, 31]
    assert tables.z_factor(4, 0) == ((3, 0, -30, 0, 35), 1 / 8)
    assert np.allclose(tables.c5b(), (0.026596810706114, 0.053193621412227, 0.026596810706114), rtol=1e-12)
    assert [len(tables.moments(order)) for order in (0, 1, 4, 8)] == [0, 3, 24, 80]
    with pytest.raises(ValueError):
        tables.moments(9)


def test_basis_slope_is_derivative():
    d = np.linspace(0.3, 5.9, 40)
    f, df = chebyshev(d, 6.0, 5)
    h = 1e-6
    assert np.allclose(df, (chebyshev(d + h, 6.0, 5)[0] - chebyshev(d - h, 6.0, 5)[0]) / (2 * h), atol=1e-7)
    assert f.shape == (6, 40)


def test_angular_gradient():
    p = np.random.default_rng(0).normal(size=(3, 20))
    g, h = tables.moment_gradients(*p, 8), 1e-6
    for a in range(3):
        step = np.zeros((3, 1))
        step[a] = h
        assert np.allclose(g[:, a], (tables.moment_values(*(p + step), 8) - tables.moment_values(*(p - step), 8)) / (2 * h), rtol=1e-5, atol=1e-4)


@pytest.mark.parametrize("factor", [None, 0.7])
def test_forces_and_virial_are_derivatives(factor):
    m, (xyz, types), h = model(factor=factor), cluster(), 1e-5
    out = compute(m, batch(xyz, types), components=True)
    energy = lambda x, c=CELL: compute(m, batch(x, types, c))["energy"].sum()
    for a in range(3):
        for k in range(3):
            up, down = xyz.copy(), xyz.copy()
            up[a, k] += h
            down[a, k] -= h
            assert np.isclose(-(energy(up) - energy(down)) / (2 * h), out["forces"][a, k], rtol=1e-6, atol=1e-5)
    for a in range(3):
        up, down = np.eye(3), np.eye(3)
        up[a, a] += h
        down[a, a] -= h
        assert np.isclose(-(energy(xyz @ up, CELL @ up) - energy(xyz @ down, CELL @ down)) / (2 * h), out["virial"].sum(0)[4 * a], rtol=1e-6, atol=1e-4)
    for name in ("energy", "forces", "virial"):
        assert np.allclose(out[f"{name}_net"] + out[f"{name}_zbl"], out[name], atol=1e-9)


def test_descriptor_is_rotation_invariant():
    m, (xyz, types) = model(), cluster()
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    a, b = compute(m, batch(xyz, types)), compute(m, batch(xyz @ turn, types, CELL @ turn))
    assert np.allclose(a["descriptor"], b["descriptor"], atol=1e-9)
    assert np.allclose(a["forces"] @ turn, b["forces"], atol=1e-8)


def test_supercell_has_the_same_energy_per_atom():
    m, (xyz, types) = model(), cluster()
    shifts = np.stack(np.meshgrid(*[range(3)] * 3, indexing="ij"), -1).reshape(-1, 3) @ CELL
    big = (xyz[None] + shifts[:, None]).reshape(-1, 3)
    one, many = compute(m, batch(xyz, types)), compute(m, batch(big, np.tile(types, 27), 3 * CELL))
    assert np.isclose(one["energy"].mean(), many["energy"].mean(), rtol=1e-10)
    assert np.allclose(np.tile(one["forces"], (27, 1)), many["forces"], atol=1e-8)


def test_parameter_gradient():
    m, (xyz, types) = model(), cluster()
    rng = np.random.default_rng(4)
    on_e, on_f, on_v = rng.normal(size=14), rng.normal(size=(14, 3)), rng.normal(size=9) * np.ones((14, 1))
    found = State(m, batch(xyz, types)).gradient(on_e, on_f, on_v)
    g, x = np.concatenate([np.ravel(found[k]) for k in m.NAMES]), m.vector()

    def loss(v):
        r = compute(m.with_vector(v), batch(xyz, types))
        return (on_e * r["energy"]).sum() + (on_f * r["forces"]).sum() + (on_v * r["virial"]).sum()

    for k in [*rng.choice(len(x), 30, replace=False), len(x) - 1]:
        up, down = x.copy(), x.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert np.isclose((loss(up) - loss(down)) / 2e-6, g[k], rtol=1e-5, atol=1e-4)


@pytest.mark.parametrize("cell", [np.diag([30.0, 30, 30]), np.array([[40.0, 0, 0], [4, 40, 0], [3, 2, 40]]), np.diag([40.0, 40, 2]), np.array([[40.0, 0, 0], [9, 30, 0], [2, 1, 3.5]]), np.diag([13.0, 70, 13])])
def test_bins_find_the_pairs_of_brute_force(cell):
    xyz = np.random.default_rng(1).uniform(-5, 35, (450, 3))
    a, b = (frame_pairs(xyz, cell, 6.0, k) for k in (1, 10**9))
    assert all(np.array_equal(x, y) for x, y in zip(a[:2], b[:2], strict=True)) and np.allclose(a[2], b[2])


@pytest.mark.parametrize("n", [50, 900])
def test_pairs_of_some_centers_in_open_space(n):
    from pericell.kernels.pairs import cloud_pairs

    rng = np.random.default_rng(n)
    xyz, center = rng.uniform(-9, 9, (n, 3)), rng.random(n) < 0.4
    i, j, r = cloud_pairs(xyz, center, 3.0)
    d = np.linalg.norm(xyz[None] - xyz[:, None], axis=2)
    a, b = np.nonzero((d < 3) & (d > 0) & center[:, None])
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True)) and np.allclose(r, xyz[j] - xyz[i])


def test_tiny_and_empty_boxes():
    assert len(frame_pairs(np.zeros((0, 3)), np.eye(3), 2.0)[0]) == 0
    i, j, r = frame_pairs(np.zeros((1, 3)), 3 * np.eye(3), 4.5)  # its own images
    assert len(i) == 18 and (i == j).all() and np.allclose(r.sum(0), 0)
    assert len(frame_pairs(np.zeros((1, 3)), 30 * np.eye(3), 6.0)[0]) == 0


def test_model_file_round_trip(tmp_path):
    m, (xyz, types) = model(), cluster()
    path = str(tmp_path / "nep.txt")
    with pytest.raises(ValueError):
        save_model(m, path)
    m.most_neighbors = (50, 30)
    save_model(m, path)
    back = load_model(path)
    assert back.shape == m.shape and back.most_neighbors == (50, 30)
    assert np.allclose(compute(m, batch(xyz, types))["energy"], compute(back, batch(xyz, types))["energy"], rtol=1e-8)


def test_l_max_forms_and_guards():
    assert parse_l_max([4]) == (4, ()) and parse_l_max([4, 2, 1]) == (4, ("222", "1111")) and parse_l_max([4, 1, 0, 1]) == (4, ("222", "112"))
    with pytest.raises(ValueError):
        parse_l_max([])
    with pytest.raises(ValueError):
        Shape(("X",), l_max=3, channels=("134",))
    with pytest.raises(ValueError):
        Shape(("X",), l_max=2, channels=("123",))
    with pytest.warns(UserWarning):
        Shape(("X",), channels=("1111",))
    assert Shape(("Te", "Pb")).dim == 42 and len(Model.random(Shape(("Te", "Pb")), 0).vector()) == 3033


def test_slim():
    m = model()
    small = m.slim(["Ni"])
    xyz, _ = cluster()
    one = np.ones(len(xyz), int)
    assert np.allclose(compute(m, batch(xyz, one))["energy"], compute(small, batch(xyz, 0 * one))["energy"])
    with pytest.raises(ValueError):
        m.slim(["Xx"])


def test_many_frames_together():
    from pericell.kernels.pairs import many_pairs

    rng = np.random.default_rng(2)
    sizes = [3, 1, 3, 40, 5, 3]
    cells = np.array([np.diag(rng.uniform(3, 9, 3)) + rng.uniform(0, 0.5, (3, 3)) for _ in sizes])
    xyz, starts = rng.uniform(-4, 12, (sum(sizes), 3)), np.cumsum([0, *sizes[:-1]])
    i, j, r = many_pairs(xyz, starts, cells, 5.0)
    want = [frame_pairs(xyz[a : a + n], c, 5.0) for a, n, c in zip(starts, sizes, cells, strict=True)]
    key = lambda i, j, r: sorted((a, b, *np.round(v, 7)) for a, b, v in zip(i.tolist(), j.tolist(), r.tolist(), strict=True))
    assert key(i, j, r) == key(*(np.concatenate(x) for x in zip(*((p[0] + a, p[1] + a, p[2]) for p, a in zip(want, starts, strict=True)), strict=True)))


def test_adapter(monkeypatch):
    """Against a stand-in for the ASE base class, which is not installed here: energies, forces, stress and parts."""
    import sys
    import types

    from pericell import predict

    class Base:
        def __init__(self, **more):
            self.results = {}

        def calculate(self, atoms=None, properties=("energy",), system_changes=()):
            self.atoms = atoms

    stand_in = types.ModuleType("ase.calculators.calculator")
    stand_in.Calculator, stand_in.all_changes = Base, ()
    for name, module in {"ase": types.ModuleType("ase"), "ase.calculators": types.ModuleType("ase.calculators"), "ase.calculators.calculator": stand_in}.items():
        monkeypatch.setitem(sys.modules, name, module)

    class Atoms:
        def __init__(self, species, positions, cell, pbc=(True, True, True)):
            self.species, self.positions, self.pbc, self.cell = species, positions, pbc, types.SimpleNamespace(array=cell)

        def get_chemical_symbols(self):
            return self.species

    m = model()
    names = list(m.shape.types)
    xyz, kinds = cluster()
    species, cell = [names[k] for k in kinds], np.reshape(np.asarray(CELL, float), (3, 3))
    calc = predict.adapter()(m, components=True)

    def energy(pos, box):
        calc.calculate(Atoms(species, pos, box))
        return calc.results["energy"]

    first = Atoms(species, xyz, cell)
    calc.calculate(first)
    got = dict(calc.results)
    assert np.isclose(got["energy"], np.sum(got["energies"])) and got["forces"].shape == xyz.shape
    assert np.isclose(got["energy"], got["energy_net"] + got["energy_zbl"]) and np.allclose(got["forces"], got["forces_net"] + got["forces_zbl"])
    parts = calc.get_components(first)
    assert set(parts) == {f"{k}_{n}" for k in ("energy", "forces", "virial") for n in ("net", "zbl")}
    h = 1e-5
    for atom, axis in ((0, 0), (5, 2)):
        step = np.zeros_like(xyz)
        step[atom, axis] = h
        assert np.isclose(got["forces"][atom, axis], -(energy(xyz + step, cell) - energy(xyz - step, cell)) / (2 * h), atol=1e-5)
    volume = abs(np.linalg.det(cell))
    for k, (i, j) in enumerate([(0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1)]):
        strain = np.zeros((3, 3))
        strain[i, j] += h / 2
        strain[j, i] += h / 2
        up, down = np.eye(3) + strain, np.eye(3) - strain
        slope = (energy(xyz @ up, cell @ up) - energy(xyz @ down, cell @ down)) / (2 * h)
        assert np.isclose(got["stress"][k], slope / volume, atol=1e-6)
    assert "stress" not in predict.Calculator(m).compute(species, xyz, None)
    assert calc.get_descriptor(first).shape[0] == len(xyz)


def test_radial_models_by_matrices_of_pairs():
    """Energies, descriptors, forces and virials of a cloud without a list of pairs: those of the kernel over its pairs."""
    from pericell.kernels.pairs import cloud_pairs
    from pericell.kernels.potential import Batch, compute, is_radial, radial_cloud
    from pericell.model import Model, Shape

    rng = np.random.default_rng(12)
    for degree, n, side in ((1, 300, 6.0), (3, 1500, 9.0), (8, 60, 40.0)):
        model = Model.random(Shape(("A", "B", "C"), 4.0, 4.0, 2, 1, degree, 2, 0, (), 5), 2, uniform=True)
        model.q_scaler = np.linspace(0.01, 0.02, model.shape.dim)
        assert is_radial(model)
        xyz, kind, center = rng.uniform(0, side, (n, 3)), 2 * rng.integers(0, 2, n), rng.random(n) < 0.6
        xyz[1], kind[5] = xyz[0], 1  # two atoms at one place are no pair
        i, j, r = cloud_pairs(xyz, center, 4.0)
        want = compute(model, Batch(kind, np.zeros(n, int), i, j, r))
        energy, q, shares = radial_cloud(model, kind, xyz, center)
        assert np.allclose(energy[center], want["energy"][center], atol=1e-10) and np.allclose(q.T[center], want["descriptor"][center], atol=1e-10)
        assert np.allclose(shares[:3].T, want["forces"], atol=1e-10) and np.allclose(shares[3:].T, want["virial"], atol=1e-10)
    assert not is_radial(Model.random(Shape(("A",), 4.0, 4.0, 2, 1, 3, 3, 2, (), 5), 2))
