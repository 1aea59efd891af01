"""Fitting a model: an optimizer on the driver around gradient passes over labelled frames.

Gradients are analytic (kernels.potential.State.gradient). Sets of up to
``local_atoms`` atoms are kept on the driver, where small steps cost no job;
larger ones stay in Spark, where pairs are found once and each epoch is laid out by
batch, one job a step: tasks add up sums and gradients, whose sizes are fixed by the
model, and a few tasks add up those of the others. Losses
divide by counts of labelled frames and atoms over the whole step, and batches are
ranks of the same hashes in both places, so that a seed gives one model, up to the
rounding of sums, wherever the frames are kept.

A run without a seed draws one, which its result and checkpoints keep.
"""

from __future__ import annotations

import hashlib
import json
import logging
import secrets
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .functions import expressions as X
from .functions.tables import GPA_PER_EV_A3
from .framestore import Frame, FrameStore, collate, gathered, prepare, to_frame
from .kernels.potential import State
from .model import Model, load_model
from .operators import sampling
from .sources.config import Config

log = logging.getLogger(__name__)
SIX = list(X.VIRIAL_SIX)
SUMS = ("se", "sr", "n_e", "sf", "n_f", "sv", "ss", "n_v")


def counts(frames: list[Frame]) -> tuple[int, int, int]:
    """Frames with energy, atoms with forces, frames with virial."""
    return sum(f.energy is not None for f in frames), sum(f.n for f in frames if f.forces is not None), sum(f.virial is not None for f in frames)


def step(model: Model, frames: list[Frame], weights: tuple[float, float, float], total: tuple[int, int, int], want_gradient: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Error sums (as SUMS) and the gradient of the weighted loss whose means divide by ``total``."""
    batch, n = collate(frames), np.array([f.n for f in frames])
    state = State(model, batch)
    g = state.pair_gradients()
    forces, virial = state.forces(g)
    frame_sum = lambda x: np.stack([np.bincount(batch.frame, c, len(frames)) for c in np.atleast_2d(x)])
    has = [np.array([getattr(f, k) is not None for f in frames]) for k in ("energy", "forces", "virial")]
    energy = frame_sum(state.energy + state.zbl)[0]
    r = np.where(has[0], (energy - [f.energy or 0.0 for f in frames]) / n, 0.0)
    ref_f = np.concatenate([f.forces if f.forces is not None else np.zeros((f.n, 3)) for f in frames])
    df = np.where(has[1][batch.frame][:, None], forces - ref_f, 0.0)
    ref_v = np.array([f.virial[SIX] if f.virial is not None else np.zeros(6) for f in frames])
    dv = np.where(has[2][:, None], (frame_sum(virial.T[SIX]).T - ref_v) / n[:, None], 0.0)
    stress = dv * (n / [f.volume for f in frames])[:, None]
    sums = np.array([(r * r).sum(), r.sum(), has[0].sum(), (df * df).sum() / 3, n[has[1]].sum(), (dv * dv).sum() / 6, (stress * stress).sum() / 6, has[2].sum()], float)
    if not want_gradient:
        return sums, None
    share = [w / t if t else 0.0 for w, t in zip(weights, total, strict=True)]
    on_energy = (2 * share[0] * r / n)[batch.frame]
    on_virial = np.zeros((batch.n, 9))
    on_virial[:, SIX] = (2 * share[2] / 6 * dv / n[:, None])[batch.frame]
    found = state.gradient(on_energy, 2 * share[1] / 3 * df, on_virial)
    return sums, np.concatenate([np.ravel(found[k]) for k in model.NAMES])


class LocalData:
    """Prepared frames on the driver, in order of ids."""

    def __init__(self, frames: list[Frame]):
        self.frames = sorted(frames, key=lambda f: f.frame_id)
        self.n = len(self.frames)

    def batches(self, seed: int, epoch: int, size: int):
        # as operators.sampling.batches orders them
        order = sorted(self.frames, key=lambda f: (hashlib.md5(f"{seed}:{epoch}:{f.frame_id}".encode()).hexdigest(), f.frame_id))
        for lo in range(0, self.n, size):
            yield order[lo : lo + size]

    def step(self, model, chosen, weights, want_gradient=True):
        chosen = self.frames if chosen is None else chosen
        if not want_gradient:
            parts = [step(model, chosen[k : k + 64], weights, (1, 1, 1), False)[0] for k in range(0, len(chosen), 64)]
            return np.sum(parts, axis=0), None
        return step(model, chosen, weights, counts(chosen))

    def descriptor_range(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.full(model.shape.dim, np.inf), np.full(model.shape.dim, -np.inf)
        for k in range(0, self.n, 64):
            q = State(model, collate(self.frames[k : k + 64])).q
            lo, hi = np.minimum(lo, q.min(axis=1)), np.maximum(hi, q.max(axis=1))
        return lo, hi

    def most_neighbors(self, shape) -> tuple[int, int]:
        most = [0, 0]
        for f in self.frames:
            d = np.linalg.norm(f.pairs[2], axis=1)
            for k, rc in enumerate((shape.cutoff_radial, shape.cutoff_angular)):
                most[k] = max(most[k], int(np.bincount(f.pairs[0][d < rc], minlength=1).max()))
        return most[0], most[1]

    def mean_energy(self) -> float:
        known = [f.energy / f.n for f in self.frames if f.energy is not None]
        return float(np.mean(known)) if known else 0.0

    def close(self) -> None:
        pass


class SparkData:
    """Frames that stay in Spark (framestore): pairs are found once, a step is one job over the rows of its batch."""

    def __init__(self, rows: DataFrame, cutoff: float, groups: int | None = None):
        self.store = FrameStore(rows, cutoff, groups)
        self.n = self.store.n

    def batches(self, seed: int, epoch: int, size: int):
        return self.store.epoch(seed, epoch, size)

    def step(self, model, chosen, weights, want_gradient=True):
        """``chosen``: a step of an epoch; None: all frames, for their error sums."""
        rows, total = (self.store.table(), (1, 1, 1)) if chosen is None else (chosen.rows, chosen.total)
        both = self.store.fold(rows, lambda f: np.concatenate([x for x in step(model, f, weights, total, want_gradient) if x is not None]))
        return both[: len(SUMS)], both[len(SUMS) :].copy() if want_gradient else None

    def descriptor_range(self, model: Model):
        least = self.store.fold(self.store.table(), lambda f: np.concatenate([(q := State(model, collate(f)).q).min(axis=1), -q.max(axis=1)]), np.minimum)
        lo, hi = np.split(least, 2)
        return lo, -hi

    def most_neighbors(self, shape):
        most = self.store.fold(self.store.table(), lambda f: np.array(LocalData(f).most_neighbors(shape), float), np.maximum)
        return int(most[0]), int(most[1])

    def mean_energy(self) -> float:
        return self.store.table().agg(F.avg(F.col("energy") / F.col("n"))).first()[0] or 0.0

    def close(self) -> None:
        self.store.close()


class Adam:
    """With the largest second moment so far (AMSGrad)."""

    def __init__(self, n: int, lr: float):
        self.lr, self.t = lr, 0
        self.m, self.v, self.top = np.zeros(n), np.zeros(n), np.zeros(n)

    def move(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        self.top = np.maximum(self.top, self.v)
        return -self.lr * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.top / (1 - 0.999**self.t)) + 1e-8)


class Schedule:
    """plateau: fall by the factor when more than ``patience`` epochs bring no relative gain of 1e-4; step: fall every ``patience`` epochs."""

    def __init__(self, kind: str, patience: int, factor: float, floor: float):
        self.kind, self.patience, self.factor, self.floor = kind, patience, factor, floor
        self.best, self.bad, self.epochs = float("inf"), 0, 0

    def next(self, lr: float, loss: float) -> float:
        self.epochs += 1
        if self.kind == "step":
            fall = self.epochs % self.patience == 0
        else:
            better = loss < self.best * (1 - 1e-4)
            self.best, self.bad = (loss, 0) if better else (self.best, self.bad + 1)
            fall = self.bad > self.patience
            if fall:
                self.bad = 0
        return max(lr * self.factor, self.floor) if fall else lr


class EarlyStop:
    """Counts epochs without a relative gain of 1e-4."""

    def __init__(self, patience: int):
        self.patience, self.best, self.bad = patience, float("inf"), 0

    def done(self, loss: float) -> bool:
        better = loss < self.best * (1 - 1e-4)
        self.best, self.bad = (loss, 0) if better else (self.best, self.bad + 1)
        return bool(self.patience) and self.bad >= self.patience


def means(sums: np.ndarray, centered: bool) -> dict[str, float]:
    """MSEs of a pass; ``centered``: the energy's after the best offset."""
    x = dict(zip(SUMS, sums, strict=True))
    at = lambda a, n: x[a] / x[n] if x[n] else 0.0
    e = max(0.0, at("se", "n_e") - at("sr", "n_e") ** 2) if centered else at("se", "n_e")
    return {"e": e, "f": at("sf", "n_f"), "v": at("sv", "n_v"), "s": at("ss", "n_v"), "residual": at("sr", "n_e")}


def weighted(m: dict[str, float], weights: tuple[float, float, float]) -> float:
    return weights[0] * m["e"] + weights[1] * m["f"] + weights[2] * m["v"]


def scaler(data, model: Model, ones: bool = False) -> np.ndarray:
    """1 / max(range, 1e-10) of each component over all atoms; ``ones``: with all expansion coefficients 1."""
    plain = replace(model, q_scaler=np.ones(model.shape.dim))
    if ones:
        plain = replace(plain, c2=np.ones_like(model.c2), c3=np.ones_like(model.c3))
    lo, hi = data.descriptor_range(plain)
    return 1 / np.maximum(hi - lo, 1e-10)


def regularised(model: Model, g: np.ndarray, lambda_1: float, lambda_2: float) -> np.ndarray:
    """Adds the slopes of lambda_1 mean|w| + lambda_2 RMS(w); b1 is the last number and stays out."""
    w = model.vector()[:-1]
    if lambda_1:
        g[:-1] += lambda_1 * np.sign(w) / len(w)
    if lambda_2:
        g[:-1] += lambda_2 * w / (len(w) * max(np.sqrt((w * w).mean()), 1e-12))
    return g


def clipped(g: np.ndarray, most: float) -> np.ndarray | None:
    """None if a number is not finite: the step is then left out, errors and counts alike."""
    norm = np.linalg.norm(g)
    if not np.isfinite(norm):
        return None
    return g * (most / norm) if most and norm > most else g


HEADER = ("epoch", "loss", "rmse_e", "rmse_f", "rmse_v", "rmse_s")


def log_row(epoch: int, loss: float, m: dict, valid: dict | None) -> list[float]:
    values = lambda x: [np.sqrt(x["e"]), np.sqrt(x["f"]), np.sqrt(x["v"]), np.sqrt(x["s"]) * GPA_PER_EV_A3]
    return [epoch, loss, *values(m), *(values(valid) if valid else [])]


def save_checkpoint(path: str, model: Model, adam: Adam, state: dict, averaged: np.ndarray | None = None) -> None:
    """A folder in any store: numbers of the size of the model as Parquet, the rest as JSON that names that file.

    The JSON is put in place last, by renaming, and completes the checkpoint; a run that is stopped before leaves
    the one before it whole. Parts that no state names are deleted after.
    """
    columns = {"x": model.vector(), "m": adam.m, "v": adam.v, "top": adam.top} | ({} if averaged is None else {"averaged": averaged})
    buffer, name = pa.BufferOutputStream(), f"numbers-{uuid.uuid4().hex}.parquet"
    pq.write_table(pa.table({k: pa.array(v) for k, v in columns.items()}), buffer)
    storage.commit(storage.join(path, name), buffer.getvalue().to_pybytes())
    whole = state | {"numbers": name, "q_scaler": model.q_scaler.tolist(), "t": adam.t, "lr": adam.lr, "neighbors": list(model.most_neighbors)}
    storage.commit(storage.join(path, "state.json"), json.dumps(whole))
    for other in storage.listed(path):
        if other.startswith("numbers-") and other != name:
            storage.delete(storage.join(path, other))


def load_state(path: str) -> dict:
    return json.loads(storage.read_text(storage.join(path, "state.json")))


def load_checkpoint(path: str, model: Model) -> tuple[Model, Adam, dict]:
    """The state has the average of stage 2 as ``averaged``, None before."""
    state = load_state(path)
    found = pq.read_table(pa.BufferReader(storage.read_bytes(storage.join(path, state["numbers"]))))
    a = {k: found.column(k).to_numpy().copy() for k in found.column_names}
    model = replace(model.with_vector(a["x"]), q_scaler=np.array(state["q_scaler"]), most_neighbors=tuple(state["neighbors"]))
    adam = Adam(len(a["x"]), state["lr"])
    adam.m, adam.v, adam.top, adam.t = a["m"], a["v"], a["top"], state["t"]
    state["averaged"] = a.get("averaged")
    return model, adam, state


def fresh_seed() -> int:
    return secrets.randbits(32)


class RunLog:
    """Lines of a run to ``train.log`` in its folder, if it has one, and to the logger. A resumed run adds to its file."""

    def __init__(self, out_dir: str | None, resumed: bool):
        self.path, self.text = storage.join(out_dir, "train.log") if out_dir else None, ""
        if out_dir and resumed and storage.exists(self.path):
            self.text = storage.read_text(self.path)

    def __call__(self, text: str) -> None:
        log.info(text)
        self.text += text + "\n"

    def flush(self) -> None:
        """Stores cannot add to a file: the log is put in place whole, once an epoch."""
        if self.path:
            storage.commit(self.path, self.text)

    def banner(self, config: Config, model: Model, n_train: int, n_valid: int | None, seed: int) -> None:
        width = 72
        self("=" * width)
        self("pericell: fitting a model of periodic point sets")
        self("=" * width)
        self(config.summary())
        self(f"{'parameters':24} {len(model.vector())}")
        self(f"{'descriptor components':24} {model.shape.dim}")
        self(f"{'frames':24} {n_train}" + ("" if n_valid is None else f" and {n_valid} for validation"))
        self(f"{'most neighbors':24} {model.most_neighbors[0]} {model.most_neighbors[1]}")
        self(f"{'seed':24} {seed}")
        self("-" * width)
        self(" ".join(f"{h:>12}" for h in (*HEADER, *([f"{h}_test" for h in HEADER[2:]] if n_valid else []))))


def fit(config: Config, data, valid=None, out_dir: str | None = None, seed: int | None = 0, uniform: bool = False, finetune_from: str | None = None, resume_from: str | None = None, recompute_scaler: bool = False, average: bool = False, on_epoch: Callable | None = None) -> dict:
    """Returns best and final models and the loss log. A resumed run takes its checkpoint's seed, rate, stage, start of
    stage 2 and average. Without a seed a fresh one is drawn. ``on_epoch`` gets the epoch and the model after each."""
    if finetune_from and resume_from:
        raise ValueError("finetune or resume, not both")
    seed, tell = fresh_seed() if seed is None else seed, RunLog(out_dir, bool(resume_from))
    model = Model.random(config.shape(), seed, uniform)
    if finetune_from:
        old = load_model(finetune_from)
        if old.shape != model.shape:
            raise ValueError("the file's model has another shape")
        model = old
    model = replace(model, most_neighbors=data.most_neighbors(model.shape))
    adam, first, rows = Adam(len(model.vector()), config.lr), 1, []
    schedule = Schedule(config.lr_scheduler, config.patience, config.factor, config.stop_lr)
    stop, weights, best = EarlyStop(config.early_stop), config.weights, (float("inf"), None, 0)
    stage2, averaged, n_averaged = config.second_stage, None, 0
    if resume_from:
        model, adam, state = load_checkpoint(resume_from, model)
        seed, first, weights = state["seed"], state["epoch"] + 1, tuple(state["weights"])
        schedule.__dict__.update(state["schedule"])
        stop.__dict__.update(state["stop"])
        rows = [r for r in state["log"] if r[0] <= state["epoch"]]
        stage2, averaged, n_averaged = 0 if state["stage"] == 2 else state["start_stage2"], state["averaged"], state["n_averaged"]
        best = (state["best_loss"], model.with_vector(np.array(state["best"])) if state["best"] else None, state["best_epoch"])
    else:
        if not finetune_from or recompute_scaler:
            model.q_scaler = scaler(data, model, ones=uniform)
        if not finetune_from:
            model.b1 = -data.mean_energy()
    in_stage2 = bool(resume_from) and stage2 == 0
    if not resume_from:
        tell.banner(config, model, data.n, valid.n if valid else None, seed)
    epoch = first - 1

    def keep(name: str, done: int) -> None:
        if out_dir:
            state = {"epoch": done, "seed": seed, "weights": weights, "stage": 2 if in_stage2 else 1, "start_stage2": stage2, "n_averaged": n_averaged, "schedule": schedule.__dict__, "stop": stop.__dict__, "log": rows, "best_loss": best[0], "best": list(best[1].vector()) if best[1] else None, "best_epoch": best[2]}
            save_checkpoint(storage.join(out_dir, name), model, adam, state, averaged)

    while epoch < config.epoch:
        epoch += 1
        if stage2 and epoch >= stage2 and not in_stage2:
            keep("checkpoint_stage1", epoch - 1)
            tell(f"stage 2 from epoch {epoch}")
            in_stage2, weights, adam.lr = True, config.stage2_weights, config.stage2_lr
            schedule = Schedule(config.lr_scheduler, config.patience, config.factor, config.stop_lr)
            stop, best = EarlyStop(config.early_stop), (float("inf"), None, 0)
        sums = np.zeros(len(SUMS))
        for chosen in data.batches(seed, epoch, config.batch):
            part, g = data.step(model, chosen, weights)
            g = clipped(regularised(model, g, config.lambda_1, config.lambda_2), config.max_grad_norm)
            if g is None:
                continue
            sums += part
            g[-1] = 0.0  # b1 is solved for, not stepped
            model = model.with_vector(model.vector() + adam.move(g))
            if average and in_stage2:
                n_averaged += 1
                x = model.vector()
                averaged = x if averaged is None else averaged + (x - averaged) / n_averaged
        m = means(sums, centered=True)
        model = replace(model, b1=model.b1 + means(sums, centered=False)["residual"])
        v = means(valid.step(model, None, weights, False)[0], centered=False) if valid else None
        loss = weighted(v or m, weights)
        rows.append(log_row(epoch, loss, m, v))
        adam.lr = schedule.next(adam.lr, loss)
        if v or epoch >= 2 * config.epoch // 3 + 1 or epoch == config.epoch:
            candidate = model
            if not v:  # the sums above are of moving weights: a pass with the weights as they are tells
                frozen = data.step(model, None, weights, False)[0]
                candidate = replace(model, b1=model.b1 + means(frozen, centered=False)["residual"])
                loss = weighted(means(frozen, centered=True), weights)
            if loss < best[0]:
                best = (loss, candidate, epoch)
        tell(" ".join(f"{x:12.6g}" for x in rows[-1]))
        stop_now = stop.done(loss)
        if stop_now and stage2 and not in_stage2:
            stage2, stop_now = epoch + 1, False  # stage 1 has ended; a resumed run must know
        keep("checkpoint", epoch)
        tell.flush()
        if on_epoch:
            on_epoch(epoch, model)
        if stop_now:
            tell(f"no gain for {config.early_stop} epochs, stopped at epoch {epoch}")
            break
    if averaged is not None:
        model = model.with_vector(averaged)
        model.b1 += means(data.step(model, None, weights, False)[0], centered=False)["residual"]
    out = {"final": model, "best": best[1] or model, "best_loss": best[0], "best_epoch": best[2], "log": rows, "seed": seed}
    tell(f"best loss {best[0]:.6g} at epoch {best[2]}")
    tell.flush()
    if out_dir:
        from .model import save_model

        save_model(out["best"], storage.join(out_dir, "nep.txt"))
        save_model(out["final"], storage.join(out_dir, "nep_final.txt"))
        more = [f"{h}_test" for h in HEADER[2:]] if valid else []
        lines = [" ".join(f"{x:.6e}" if k else str(int(x)) for k, x in enumerate(r)) for r in rows]
        storage.commit(storage.join(out_dir, "loss.out"), "\n".join([" ".join(["#", *HEADER, *more]), *lines]) + "\n")
    return out


def load_data(rows: DataFrame, cutoff: float, local_atoms: int = 200_000):
    """``rows`` as from gathered(): on the driver up to a checked size, else in Spark."""
    atoms = rows.agg(F.sum(F.size("type"))).first()[0] or 0
    if atoms <= local_atoms:
        return LocalData([to_frame(r, cutoff) for r in rows.toLocalIterator()])
    return SparkData(rows, cutoff)


def train(spark, config: Config, xyz_file: str, valid_file: str | None = None, valid_ratio: float | None = None, out_dir: str | None = None, seed: int | None = None, local_atoms: int = 200_000, slim_types: bool = False, prediction_interval: int = 0, **parameters) -> dict:
    """From files: read, split, prepare, fit, predict.

    With ``out_dir`` the tables of predictions for the training set, and for the validation set as the test set, are
    written at the end with the final model, and every ``prediction_interval`` epochs with the model of that epoch.
    """
    from .predict import write_predictions
    from .sources.extxyz import read_xyz, to_atoms, to_frames

    if valid_file and valid_ratio:
        raise ValueError("a validation file or a ratio, not both")
    seed = fresh_seed() if seed is None else seed
    resume = parameters.get("resume_from")
    if resume:  # the split must be the same again
        seed = load_state(resume)["seed"]
    read = read_xyz(spark, xyz_file)
    if slim_types:
        seen = {r[0] for r in read.select(F.explode("species")).distinct().collect()}
        config = replace(config, types=tuple(t for t in config.types if t in seen))

    def rows(df: DataFrame) -> DataFrame:
        return gathered(sampling.type_ids(to_atoms(df), list(config.types)), to_frames(df))

    cutoff, valid = max(config.cutoff), None
    if valid_ratio:
        marked = sampling.split(read.select("frame_id"), valid_ratio, seed)
        valid = read.join(marked.where("valid"), "frame_id", "left_semi")
        read = read.join(marked.where("NOT valid"), "frame_id", "left_semi")
    elif valid_file:
        valid = read_xyz(spark, valid_file)
    data = load_data(rows(read), cutoff, local_atoms)

    def predict(model: Model) -> None:
        for some, suffix in ((read, "train"), (valid, "test")):
            if out_dir and some is not None:
                write_predictions(some, model, out_dir, suffix=suffix)

    given = parameters.pop("on_epoch", None)

    def on_epoch(epoch: int, model: Model) -> None:
        if prediction_interval and epoch % prediction_interval == 0 and epoch != config.epoch:
            predict(model)
        if given:
            given(epoch, model)

    checked = load_data(rows(valid), cutoff, local_atoms) if valid is not None else None
    try:
        out = fit(config, data, checked, out_dir, seed, on_epoch=on_epoch, **parameters)
    finally:
        for given_data in filter(None, (data, checked)):
            given_data.close()
    predict(out["final"])
    return out
