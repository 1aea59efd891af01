import json
import os
from dataclasses import replace

import numpy as np
import pytest

from pericell import training as T
from pericell.kernels.potential import compute
from pericell.model import Model, load_model
from pericell.predict import Calculator, predict_dataset
from pericell.sources.config import parse_config

CONFIG = "type 2 Te Pb\ncutoff 5 4\nn_max 2 1\nbasis_size 3 3\nl_max 2 1\nneuron 5\nepoch 6\nbatch 4\nlambda_e 1\nlambda_v 0.1\n"
CELL = np.array([[7.0, 0, 0], [0.5, 7.5, 0], [0.3, 0.4, 8.0]])


def structures(n=12):
    rng = np.random.default_rng(0)
    teacher = Model.random(parse_config(CONFIG).shape(), 77)
    out = []
    for k in range(n):
        xyz, kinds = rng.uniform(0, 7, (6, 3)), rng.integers(0, 2, 6)
        bare = T.prepare(k, kinds, xyz, CELL, 5.0)
        found = compute(teacher, T.collate([bare]))
        out.append((k, kinds, xyz, None if k == 3 else found["energy"].sum() - 4.0, None if k == 5 else found["forces"], found["virial"].sum(0) if k % 2 else None))
    return out


def data(n=12):
    return T.LocalData([T.prepare(k, t, x, CELL, 5.0, e, f, v) for k, t, x, e, f, v in structures(n)])


def write(path, n=12):
    with open(path, "w") as out:
        for _, t, x, e, f, v in structures(n):
            out.write(f'{len(t)}\n{"" if e is None else f"energy={float(e)!r} "}Lattice="{" ".join(map(repr, CELL.ravel().tolist()))}"')
            out.write("" if v is None else f' virial="{" ".join(map(repr, v.tolist()))}"')
            out.write(" Properties=species:S:1:pos:R:3" + ("" if f is None else ":force:R:3") + "\n")
            for a in range(len(t)):
                out.write(" ".join([("Te", "Pb")[t[a]], *map(repr, x[a].tolist()), *([] if f is None else map(repr, f[a].tolist()))]) + "\n")


def test_step_gradient_and_masks():
    frames, m = data().frames[:6], Model.random(parse_config(CONFIG).shape(), 1)
    total, weights = T.counts(frames), (0.7, 1.3, 0.4)
    assert total == (5, 30, 3)
    x, (_, g) = m.vector(), T.step(m, frames, weights, total)

    def loss(v):
        s = T.step(m.with_vector(v), frames, weights, total, False)[0]
        return T.weighted(T.means(s, centered=False), weights)

    for k in np.random.default_rng(1).choice(len(x), 20, replace=False):
        up, down = x.copy(), x.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert np.isclose((loss(up) - loss(down)) / 2e-6, g[k], rtol=1e-5, atol=1e-7)


def test_training_learns_and_offset_is_exact():
    out = T.fit(replace(parse_config(CONFIG), epoch=30), data(), seed=3)
    losses = [r[1] for r in out["log"]]
    assert losses[-1] < 0.5 * losses[0] and out["best_loss"] <= min(losses[-3:]) * 1.5
    sums = data().step(out["best"], None, (1, 1, 1), False)[0]
    assert abs(T.means(sums, centered=False)["residual"]) < 1e-9


def test_same_seed_same_run_and_resume(tmp_path):
    config = parse_config(CONFIG + "stage2 1\n")
    a, b = (T.fit(config, data(), seed=5, out_dir=str(tmp_path / n)) for n in "ab")
    assert np.array_equal(a["final"].vector(), b["final"].vector()) and a["log"] == b["log"]
    assert os.path.isdir(tmp_path / "a" / "checkpoint_stage1")
    half = T.fit(replace(config, epoch=4, start_stage2=3), data(), seed=5, out_dir=str(tmp_path / "c"))
    more = T.fit(replace(config, start_stage2=3), data(), out_dir=str(tmp_path / "d"), resume_from=str(tmp_path / "c" / "checkpoint"))
    assert len(half["log"]) == 4 and more["seed"] == 5 and [r[0] for r in more["log"]] == list(range(1, 7))
    assert np.allclose(more["final"].vector(), a["final"].vector(), rtol=1e-12)
    with pytest.raises(ValueError):
        T.fit(config, data(), finetune_from="x", resume_from="y")


def test_resume_keeps_the_jump_and_the_average(tmp_path):
    """Early stop in stage 1 begins stage 2; a run stopped there and resumed ends as one that went through."""
    config = replace(parse_config(CONFIG + "stage2 1\nearly_stop 1\nlr 1e-12\n"), epoch=9, start_stage2=8, stage2_lr=0.01)
    whole = T.fit(config, data(), seed=5, out_dir=str(tmp_path / "a"), average=True)
    with open(tmp_path / "a" / "checkpoint_stage1" / "state.json") as file:
        jump = json.load(file)
    assert jump["epoch"] < 7  # before the configured start
    for last in (jump["epoch"], jump["epoch"] + 1):

        class Stop(Exception):
            pass

        def stop(epoch, model, last=last):
            if epoch == last:
                raise Stop

        with pytest.raises(Stop):
            T.fit(config, data(), seed=5, out_dir=str(tmp_path / f"b{last}"), average=True, on_epoch=stop)
        more = T.fit(config, data(), out_dir=str(tmp_path / "c"), resume_from=str(tmp_path / f"b{last}" / "checkpoint"), average=True)
        assert more["log"] == whole["log"] and np.allclose(more["final"].vector(), whole["final"].vector(), rtol=1e-12)


def test_a_run_without_a_seed_draws_one(tmp_path):
    config = replace(parse_config(CONFIG), epoch=1)
    a, b = (T.fit(config, data(), seed=None, out_dir=str(tmp_path / n)) for n in "ab")
    assert a["seed"] != b["seed"] and not np.array_equal(a["final"].vector(), b["final"].vector())
    with open(tmp_path / "a" / "checkpoint" / "state.json") as file:
        assert json.load(file)["seed"] == a["seed"]
    assert np.array_equal(T.fit(config, data(), seed=a["seed"])["final"].vector(), a["final"].vector())
    with open(tmp_path / "a" / "train.log") as file:
        text = file.read()
    assert f"seed                     {a['seed']}" in text and "neuron" in text and "(default)" in text and "best loss" in text


def test_validation_loss_and_average():
    out = T.fit(parse_config(CONFIG + "stage2 1\n"), data(), valid=data(4), seed=2, average=True)
    assert len(out["log"][0]) == 10
    row = out["log"][-1]
    weights = parse_config(CONFIG).stage2_weights
    assert np.isclose(row[1], weights[0] * row[6] ** 2 + weights[1] * row[7] ** 2 + weights[2] * row[8] ** 2, rtol=1e-5)


def test_regularisation_and_schedules():
    m = Model.random(parse_config(CONFIG).shape(), 1)
    g = T.regularised(m, np.zeros(len(m.vector())), 0.1, 0.2)
    assert g[-1] == 0 and (np.sign(g[:-1]) == np.sign(m.vector()[:-1])).all()
    assert T.clipped(np.array([np.nan]), 1) is None and np.isclose(np.linalg.norm(T.clipped(np.ones(9), 1.0)), 1)
    s = T.Schedule("plateau", 2, 0.5, 0.1)
    assert [s.next(1.0, x) for x in (3, 3, 3, 3)] == [1.0, 1.0, 1.0, 0.5]
    s = T.Schedule("step", 2, 0.5, 0.1)
    assert [s.next(1.0, 1) for _ in range(4)] == [1.0, 0.5, 1.0, 0.5]
    e = T.EarlyStop(2)
    assert [e.done(x) for x in (1, 1, 1)] == [False, False, True]


def test_scaler_of_ones_and_finetune(tmp_path):
    m = Model.random(parse_config(CONFIG).shape(), 1)
    a, b = T.scaler(data(), m), T.scaler(data(), m, ones=True)
    assert a.shape == b.shape and not np.allclose(a, b)
    out = T.fit(parse_config(CONFIG), data(), seed=5, out_dir=str(tmp_path))
    path = str(tmp_path / "nep.txt")
    again = T.fit(replace(parse_config(CONFIG), epoch=1), data(), finetune_from=path)
    assert np.allclose(again["final"].q_scaler, out["best"].q_scaler, rtol=1e-9)


def test_from_file_in_spark_as_on_the_driver(spark, tmp_path):
    path = str(tmp_path / "t.xyz")
    write(path)
    config = replace(parse_config(CONFIG), epoch=1, batch=12)
    a = T.train(spark, config, path, seed=4, out_dir=str(tmp_path / "a"))
    b = T.train(spark, config, path, seed=4, local_atoms=0)
    assert np.allclose(a["final"].vector(), b["final"].vector(), rtol=1e-9, atol=1e-12)
    some = replace(config, batch=4, epoch=2)
    c, d = (T.train(spark, some, path, seed=4, valid_ratio=0.25, local_atoms=n, out_dir=str(tmp_path / f"c{n}"), prediction_interval=1) for n in (0, 10**6))
    assert len(c["log"][0]) == 10 and np.allclose(c["final"].vector(), d["final"].vector(), rtol=1e-7, atol=1e-10)
    for kind in ("energy", "force", "virial", "stress"):
        sizes = [sum(1 for _ in spark.read.text(str(tmp_path / "c0" / f"{kind}_{suffix}.out")).toLocalIterator()) for suffix in ("train", "test")]
        assert sizes == ([54, 18] if kind == "force" else [9, 3])
    with pytest.raises(ValueError):
        T.train(spark, config, path, valid_file=path, valid_ratio=0.1)
    out = predict_dataset(spark, str(tmp_path / "a" / "nep.txt"), path, str(tmp_path / "out"), output_descriptor=1)
    model = load_model(str(tmp_path / "a" / "nep.txt"))
    rows = out["energy"].orderBy("frame_id").collect()
    lines = []
    for part in sorted(os.listdir(tmp_path / "out" / "energy_train.out")):
        if part.startswith("part"):
            with open(tmp_path / "out" / "energy_train.out" / part) as text:
                lines += text.read().split("\n")[:-1]
    assert len(lines) == 12 and np.isnan(float(lines[3].split()[1])) and np.isclose(float(lines[0].split()[0]), rows[0].pred)
    k, t, x, e, f, v = structures()[1]
    assert Calculator(str(tmp_path / "a" / "nep.txt")).model.shape == model.shape
    one = Calculator(model).compute([("Te", "Pb")[i] for i in t], x, CELL, descriptor=True, components=True)
    assert np.isclose(one["energy"] / 6, rows[1].pred, rtol=1e-9) and one["stress"].shape == (6,)
    assert "stress" not in Calculator(model).compute(["Te", "Pb"], x[:2], None)
    w = out["virial"].orderBy("frame_id").collect()
    assert w[0].r_xx == -1e6 and np.isclose(w[1].w_xx, one["virial"][0] / 6, rtol=1e-9) and np.isclose(w[1].r_xy, v[1] / 6)
    with pytest.raises(ValueError):
        Calculator(model).compute(["Xx"], x[:1], CELL)


def stored(spark, n=12, groups=3):
    """The structures as a store, and the same on the driver."""
    from pericell.framestore import gathered

    rows, frames = [], []
    for k, t, x, e, f, v in structures(n):
        frames.append((k, [float(c) for c in CELL.ravel()], None if e is None else float(e), None if v is None else [float(c) for c in v]))
        rows += [(k, a, int(t[a]), *map(float, x[a]), *([None] * 3 if f is None else map(float, f[a]))) for a in range(len(t))]
    atoms = spark.createDataFrame(rows, "frame_id bigint, atom_id bigint, type int, x double, y double, z double, fx double, fy double, fz double")
    cells = spark.createDataFrame(frames, "frame_id bigint, cell array<double>, energy double, virial array<double>")
    return T.SparkData(gathered(atoms, cells), 5.0, groups), atoms, cells


def test_pairs_are_built_once_and_an_epoch_reads_each_row_once(spark):
    from pericell import storage

    own, _, _ = stored(spark)
    config = replace(parse_config(CONFIG), epoch=2)
    a, b = T.fit(config, own, seed=3), T.fit(config, data(), seed=3)
    assert np.allclose(a["final"].vector(), b["final"].vector(), rtol=1e-8, atol=1e-11)
    assert np.allclose([r[1:] for r in a["log"]], [r[1:] for r in b["log"]], rtol=1e-8)
    assert own.store.built.value == 12
    before = own.store.read.value
    model = Model.random(config.shape(), 1)
    seen = []
    for step in own.batches(3, 1, 5):
        own.step(model, step, (1, 1, 1))
        seen.append([r.frame_id for r in step.rows.select("frame_id").collect()])
        assert step.total == T.counts([f for f in data().frames if f.frame_id in seen[-1]])
    assert own.store.read.value - before == 12 and [len(x) for x in seen] == [5, 5, 2]
    assert [sorted(x) for x in seen] == [sorted(f.frame_id for f in x) for x in data().batches(3, 1, 5)]
    assert seen != [[r.frame_id for r in s.rows.select("frame_id").collect()] for s in own.batches(3, 2, 5)]
    plan = own.store.table().join(spark.range(12).withColumnRenamed("id", "frame_id").hint("merge"), "frame_id")._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the order's side alone
    own.close()
    assert not storage.exists(own.store.path) and own.store.name not in [t.name for t in spark.catalog.listTables()]


def test_prediction_from_a_store(spark):
    from pericell.predict import energy_table, force_table, predict_atoms, predict_frames, predict_store, store_tables, virial_table

    own, atoms, frames = stored(spark)
    model = Model.random(parse_config(CONFIG).shape(), 9)
    numbers = lambda df: {tuple(r[: 2 if "atom_id" in df.columns else 1]): [x for v in r[2 if "atom_id" in df.columns else 1 :] for x in (v if isinstance(v, list) else [v])] for r in df.collect()}
    want, got = predict_atoms(atoms, frames, model, descriptor=True), predict_store(own.store, model, descriptor=True)
    tables = {"energy": energy_table(per := predict_frames(want, frames), frames), "force": force_table(want, atoms), "virial": virial_table(per, frames), "stress": virial_table(per, frames, stress=True)}
    for a, b in [(want, got), *zip(tables.values(), store_tables(own.store, model).values(), strict=True)]:
        a, b = numbers(a), numbers(b)
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-9, atol=1e-11, equal_nan=True) for k in a)
    assert own.store.built.value == 12 and own.store.frames().where("virial IS NULL").count() == 6
    own.close()


@pytest.mark.parametrize("scheme", ["file://", ""])
def test_checkpoints_in_a_store(spark, tmp_path, scheme):
    """Through the file system API: a run resumed from a URI ends as one that went through, and a state names whole files only."""
    from pericell import storage
    from pericell.sources.config import read_config

    at = f"{scheme}{tmp_path}/run"
    storage.commit(f"{at}/nep.in", CONFIG + "stage2 1\n")
    config = replace(read_config(f"{at}/nep.in"), start_stage2=3)
    whole = T.fit(config, data(), seed=5, out_dir=f"{at}/a", average=True)
    T.fit(replace(config, epoch=4), data(), seed=5, out_dir=f"{at}/b", average=True)
    more = T.fit(config, data(), out_dir=f"{at}/c", resume_from=f"{at}/b/checkpoint", average=True)
    assert np.allclose(more["final"].vector(), whole["final"].vector(), rtol=1e-12) and more["log"] == whole["log"]
    assert storage.read_text(f"{at}/c/loss.out") == storage.read_text(f"{at}/a/loss.out")
    assert np.allclose(load_model(f"{at}/a/nep_final.txt").vector(), whole["final"].vector(), rtol=1e-9)
    names = storage.listed(f"{at}/b/checkpoint")
    assert len(names) == 2 and names[0] == T.load_state(f"{at}/b/checkpoint")["numbers"] and names[1] == "state.json"
    assert sorted(storage.listed(f"{at}/a")) == ["checkpoint", "checkpoint_stage1", "loss.out", "nep.txt", "nep_final.txt", "train.log"]


def test_a_stopped_write_leaves_the_checkpoint_before(spark, tmp_path, monkeypatch):
    from pericell import storage

    at, config = f"file://{tmp_path}", replace(parse_config(CONFIG), epoch=2)
    T.fit(config, data(), seed=5, out_dir=at)
    commit = storage.commit

    def broken(path, text):
        if path.endswith("state.json"):
            raise OSError("lost")
        commit(path, text)

    monkeypatch.setattr(storage, "commit", broken)
    with pytest.raises(OSError):
        T.fit(replace(config, epoch=3), data(), out_dir=at, resume_from=f"{at}/checkpoint")
    monkeypatch.undo()
    assert T.load_state(f"{at}/checkpoint")["epoch"] == 2
    again = T.fit(replace(config, epoch=3), data(), out_dir=at, resume_from=f"{at}/checkpoint")
    assert len(again["log"]) == 3 and len(storage.listed(f"{at}/checkpoint")) == 2
