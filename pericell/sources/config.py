"""Run configuration: one key and its values a line, # begins a comment, keys in any case, unknown keys ignored."""

from __future__ import annotations

from dataclasses import dataclass, field

from .. import storage
from ..model import Shape, parse_l_max


@dataclass(frozen=True)
class Config:
    types: tuple[str, ...]
    cutoff: tuple[float, float] = (8.0, 4.0)
    n_max: tuple[int, int] = (6, 6)
    basis_size: tuple[int, int] = (6, 6)
    l_max: tuple[int, ...] = (4, 1, 0)
    neuron: int = 30
    zbl: float | None = None
    use_typewise_cutoff_zbl: float | None = None
    epoch: int = 600
    batch: int = 32
    lr: float = 0.01
    stop_lr: float = 1e-6
    lr_scheduler: str = "plateau"
    patience: int = 15
    factor: float = 0.7
    max_grad_norm: float = 10.0
    lambda_e: float = 0.01
    lambda_f: float = 1.0
    lambda_v: float = 0.01
    lambda_1: float = 0.0
    lambda_2: float = 0.0
    early_stop: int = 0
    stage2: int = 0
    start_stage2: int | None = None
    stage2_lr: float = 1e-3
    stage2_weights: tuple[float, float, float] = (1.0, 0.05, 0.1)
    version: int = 4
    explicit: frozenset[str] = field(default=frozenset())

    def __post_init__(self):
        if self.version != 4:
            raise ValueError("version must be 4")
        if self.lr_scheduler not in ("plateau", "step"):
            raise ValueError("lr_scheduler is plateau or step")

    @property
    def weights(self) -> tuple[float, float, float]:
        return self.lambda_e, self.lambda_f, self.lambda_v

    @property
    def second_stage(self) -> int | None:
        """First epoch of stage 2, counted from 1."""
        if not self.stage2:
            return None
        return self.start_stage2 or max(1, int(0.5 * self.epoch))

    def shape(self) -> Shape:
        l_max, channels = parse_l_max(list(self.l_max))
        zbl = (self.zbl / 2, self.zbl) if self.zbl else None
        return Shape(self.types, *self.cutoff, *self.n_max, *self.basis_size, l_max, channels, self.neuron, zbl, self.use_typewise_cutoff_zbl)

    def summary(self) -> str:
        return "\n".join(f"{k:24} {getattr(self, k)}{'' if k in self.explicit else '  (default)'}" for k in self.__dataclass_fields__ if k != "explicit")


def parse_config(text: str) -> Config:
    found: dict = {}
    for line in text.split("\n"):
        key, *values = line.split("#")[0].split() or [""]
        key = key.lower()
        if key == "type":
            if int(values[0]) != len(values) - 1:
                raise ValueError("type: the number of types and the names differ")
            found["types"] = tuple(values[1:])
        elif key in Config.__dataclass_fields__ and values:
            default = Config.__dataclass_fields__[key].default
            if isinstance(default, tuple):
                kind = type(default[0])
                found[key] = tuple(kind(float(v)) if kind is int else kind(v) for v in values)
                if key in ("cutoff", "n_max", "basis_size") and len(found[key]) == 1:
                    found[key] *= 2
            elif isinstance(default, str):
                found[key] = values[0].lower()
            else:
                found[key] = int(float(values[0])) if isinstance(default, int) or key == "start_stage2" else float(values[0])
    if "types" not in found:
        raise ValueError("no type line")
    return Config(**found, explicit=frozenset(found))


def read_config(path: str) -> Config:
    return parse_config(storage.read_text(path))
