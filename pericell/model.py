"""Model: per-type nets over descriptors, its parameters, files and surgery. A small object on the driver."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import numpy as np

from . import storage
from .functions import tables


@dataclass(frozen=True)
class Shape:
    """What fixes the sizes of all parameters."""

    types: tuple[str, ...]
    cutoff_radial: float = 8.0
    cutoff_angular: float = 4.0
    n_max_radial: int = 6
    n_max_angular: int = 6
    basis_radial: int = 6
    basis_angular: int = 6
    l_max: int = 4
    channels: tuple[str, ...] = ("222",)
    neuron: int = 30
    zbl: tuple[float, float] | None = None  # inner, outer
    zbl_factor: float | None = None  # typewise cutoffs

    def __post_init__(self):
        if not 0 <= self.l_max <= tables.MAX_L:
            raise ValueError(f"l_max must be at most {tables.MAX_L}")
        for channel in self.channels:
            need = 1 if channel == "1111" else max(int(c) for c in channel)
            if self.l_max < need:
                raise ValueError(f"q_{channel} needs L >= {need}")
        if "1111" in self.channels:
            warnings.warn("q_1111 is a function of the L = 1 three-body term", stacklevel=3)

    @property
    def dim(self) -> int:
        return self.n_max_radial + 1 + (self.n_max_angular + 1) * (self.l_max + len(self.channels))

    @property
    def numbers(self) -> list[int]:
        return [tables.ELEMENTS.index(t) + 1 for t in self.types]


def parse_l_max(fields: list[int]) -> tuple[int, tuple[str, ...]]:
    """1 to 7 fields: L, then a flag for each extra channel."""
    if not 1 <= len(fields) <= 1 + len(tables.CHANNELS):
        raise ValueError("l_max has 1 to 7 fields")
    return fields[0], tuple(c for c, on in zip(tables.CHANNELS, fields[1:], strict=False) if on > 0)


@dataclass
class Model:
    shape: Shape
    w0: np.ndarray  # type, neuron, dim
    b0: np.ndarray  # type, neuron
    w1: np.ndarray  # type, neuron
    b1: float
    c2: np.ndarray  # type, type, n, k
    c3: np.ndarray
    q_scaler: np.ndarray
    most_neighbors: tuple[int, int] = field(default=(0, 0))

    @staticmethod
    def random(shape: Shape, seed: int, uniform: bool = False) -> Model:
        """Scaled normal start, or all uniform in (-1, 1) with ``uniform``; b1 is 0 in both."""
        rng, t = np.random.default_rng(seed), len(shape.types)
        sizes = [(t, shape.neuron, shape.dim), (t, shape.neuron), (t, shape.neuron), (t, t, shape.n_max_radial + 1, shape.basis_radial + 1), (t, t, shape.n_max_angular + 1, shape.basis_angular + 1)]
        if uniform:
            w0, b0, w1, c2, c3 = (rng.uniform(-1, 1, s) for s in sizes)
        else:
            w0 = rng.normal(0, 1 / np.sqrt(shape.dim + shape.neuron), sizes[0])
            b0 = np.zeros(sizes[1])
            w1 = rng.normal(0, 1 / np.sqrt(shape.neuron + 1), sizes[2])
            c2, c3 = rng.normal(0, 0.1, sizes[3]), rng.normal(0, 0.1, sizes[4])
        return Model(shape, w0, b0, w1, 0.0, c2, c3, np.ones(shape.dim))

    NAMES = ("w0", "b0", "w1", "c2", "c3", "b1")

    def vector(self) -> np.ndarray:
        return np.concatenate([np.ravel(getattr(self, n)) for n in self.NAMES])

    def with_vector(self, x: np.ndarray) -> Model:
        out, at = {}, 0
        for n in self.NAMES:
            old = np.asarray(getattr(self, n))
            out[n] = x[at : at + old.size].reshape(old.shape).copy()
            at += old.size
        out["b1"] = float(out["b1"])
        return replace(self, **out)

    def slim(self, keep: list[str]) -> Model:
        """Only these types, in this order; b1 and q_scaler stay."""
        unknown = [t for t in keep if t not in self.shape.types]
        if unknown:
            raise ValueError(f"unknown types {unknown}")
        at = [self.shape.types.index(t) for t in keep]
        return replace(self, shape=replace(self.shape, types=tuple(keep)), w0=self.w0[at], b0=self.b0[at], w1=self.w1[at], c2=self.c2[np.ix_(at, at)], c3=self.c3[np.ix_(at, at)])

    def params(self, spark):
        """name, idx, value of every parameter."""
        rows = [(n, list(map(int, i)), float(v)) for n in (*self.NAMES, "q_scaler") for i, v in np.ndenumerate(np.asarray(getattr(self, n)))]
        return spark.createDataFrame(rows, "name string, idx array<int>, value double")


def plain(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else f"{x:g}"


def save_model(model: Model, path: str) -> None:
    """The text format, in any store that Spark reaches; both neighbor counts must be known."""
    s, (most_r, most_a) = model.shape, model.most_neighbors
    if most_r <= 0 or most_a <= 0:
        raise ValueError("neighbor counts must be positive")
    flags = [(2 if c == "222" else 1) if c in s.channels else 0 for c in tables.CHANNELS]
    while len(flags) > 2 and not flags[-1]:
        flags.pop()
    lines = [f"nep4{'_zbl' if s.zbl else ''} {len(s.types)} {' '.join(s.types)}"]
    if s.zbl:
        lines.append(f"zbl {plain(s.zbl[0])} {plain(s.zbl[1])}" + (f" {plain(s.zbl_factor)}" if s.zbl_factor else ""))
    lines += [
        f"cutoff {plain(s.cutoff_radial)} {plain(s.cutoff_angular)} {most_r} {most_a}",
        f"n_max {s.n_max_radial} {s.n_max_angular}",
        f"basis_size {s.basis_radial} {s.basis_angular}",
        f"l_max {' '.join(map(str, [s.l_max, *flags]))}",
        f"ANN {s.neuron} 0",
    ]
    body = [np.concatenate([model.w0[t].ravel(), model.b0[t], model.w1[t]]) for t in range(len(s.types))]
    body += [[model.b1], model.c2.transpose(2, 3, 0, 1).ravel()]
    if s.l_max:
        body.append(model.c3.transpose(2, 3, 0, 1).ravel())
    body.append(model.q_scaler)
    storage.commit(path, "\n".join([*lines, *(f"{x:.10e}" for x in np.concatenate(body))]) + "\n")


def load_model(path: str) -> Model:
    lines = storage.read_text(path).split("\n")
    head, at = lines[0].split(), 1
    types, zbl, factor = tuple(head[2 : 2 + int(head[1])]), None, None
    if "zbl" in head[0]:
        fields = [float(x) for x in lines[at].split()[1:]]
        zbl, factor, at = (fields[0], fields[1]), fields[2] if len(fields) > 2 else None, at + 1
    entries = {}
    while True:
        name, *fields = lines[at].split()
        entries[name], at = fields, at + 1
        if name == "ANN":
            break
    l_max, channels = parse_l_max([int(x) for x in entries["l_max"]])
    n_max, basis, cut = entries["n_max"], entries["basis_size"], entries["cutoff"]
    shape = Shape(types, float(cut[0]), float(cut[1]), int(n_max[0]), int(n_max[1]), int(basis[0]), int(basis[1]), l_max, channels, int(entries["ANN"][0]), zbl, factor)
    x = np.array([float(v) for v in " ".join(lines[at:]).split()])
    t, place = len(types), 0

    def take(*size: int) -> np.ndarray:
        nonlocal place
        n = int(np.prod(size))
        if place + n > len(x):
            raise ValueError("the file has too few numbers")
        out = x[place : place + n].reshape(size)
        place += n
        return out

    per = [(take(shape.neuron, shape.dim), take(shape.neuron), take(shape.neuron)) for _ in range(t)]
    b1 = float(take(1)[0])
    c2 = take(shape.n_max_radial + 1, shape.basis_radial + 1, t, t).transpose(2, 3, 0, 1)
    c3 = take(shape.n_max_angular + 1, shape.basis_angular + 1, t, t).transpose(2, 3, 0, 1) if l_max else np.zeros((t, t, shape.n_max_angular + 1, shape.basis_angular + 1))
    scaler = take(shape.dim)
    if place != len(x):
        raise ValueError("the file has more numbers than its header says")
    w0, b0, w1 = (np.array([p[k] for p in per]) for k in range(3))
    return Model(shape, w0, b0, w1, b1, c2.copy(), c3.copy(), scaler, (int(cut[2]), int(cut[3])) if len(cut) > 3 else (0, 0))
