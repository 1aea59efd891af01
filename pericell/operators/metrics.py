"""Coverage, offsets, errors, losses and best epochs. Missing references are null and drop out of every mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import GPA_PER_EV_A3


def coverage(frames: DataFrame) -> DataFrame:
    """Frames with energy, forces and virial (columns energy, has_forces, virial)."""
    return frames.agg(F.count(F.lit(1)).alias("n_frames"), F.count("energy").alias("n_energy"), F.count(F.when(F.col("has_forces"), 1)).alias("n_forces"), F.count("virial").alias("n_virial"))


def initial_offset(frames: DataFrame) -> DataFrame:
    """b1 = -mean(E / N) over labelled frames, each frame once."""
    return frames.agg((-F.avg(F.col("energy") / F.col("natoms"))).alias("b1"))


def offset_change(frames: DataFrame) -> DataFrame:
    """What b1 must rise by for a zero mean residual: mean(E_pred / N - E_ref / N)."""
    return frames.agg(F.avg((F.col("e_pred") - F.col("energy")) / F.col("natoms")).alias("db1"))


def residual() -> Column:
    return (F.col("e_pred") - F.col("energy")) / F.col("natoms")


def energy_sums() -> list[Column]:
    r = residual()
    return [F.sum(r * r).alias("se_sum"), F.sum(r).alias("residual_sum"), F.count(r).alias("n_energy")]


def energy_errors(frames: DataFrame) -> DataFrame:
    return frames.agg(*energy_sums())


def force_errors(atoms: DataFrame) -> DataFrame:
    """Mean over the 3 components, summed over atoms with forces."""
    square = sum(((F.col(f"p{a}") - F.col(f"f{a}")) ** 2 for a in "xyz"), F.lit(0.0)) / 3
    return atoms.agg(F.sum(square).alias("sf_sum"), F.count(square).alias("n_forces"))


def virial_sums() -> list[Column]:
    """Six components per atom; pv and virial are arrays of six. Stress is the same difference times N / V."""
    difference = F.zip_with("pv", "virial", lambda a, b: a - b)
    mean = lambda factor: F.aggregate(F.transform(difference, lambda x: (x * factor) ** 2), F.lit(0.0), lambda s, x: s + x) / 6
    per_atom, stress = mean(1 / F.col("natoms")), mean(1 / F.col("volume"))
    return [F.sum(per_atom).alias("sv_sum"), F.sum(stress).alias("ss_sum"), F.count(per_atom).alias("n_virial")]


def virial_errors(frames: DataFrame) -> DataFrame:
    return frames.agg(*virial_sums())


def centered_mse() -> Column:
    """After the best offset: max(0, mean r^2 - (mean r)^2)."""
    r = residual()
    return F.greatest(F.avg(r * r) - F.avg(r) * F.avg(r), F.lit(0.0))


def plain_mse() -> Column:
    """The offset is not fitted to validation frames."""
    return F.avg(residual() * residual())


def train_mse(frames: DataFrame) -> DataFrame:
    return frames.agg(centered_mse().alias("mse_e"))


def valid_mse(frames: DataFrame) -> DataFrame:
    return frames.agg(plain_mse().alias("mse_e"))


def weighted_loss(e: Column, f: Column, v: Column, weights: tuple[float, float, float] = (0.01, 1.0, 0.01)) -> Column:
    """A channel without labels (null) adds nothing."""
    return sum((w * F.coalesce(x, F.lit(0.0)) for w, x in zip(weights, (e, f, v), strict=True)), F.lit(0.0))


def rmse_gpa(mse: Column) -> Column:
    return F.sqrt(mse) * GPA_PER_EV_A3


def running_best(log: DataFrame) -> DataFrame:
    """epoch, loss and the least loss so far. A loss log has one row an epoch; a window over one log is bounded by its epochs."""
    so_far = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.withColumn("best", F.min("loss").over(so_far))


def best_epoch(log: DataFrame) -> DataFrame:
    return log.groupBy("run").agg(F.min_by("epoch", F.struct("loss", "epoch")).alias("epoch"), F.min("loss").alias("loss"))


def trimmed_log(log: DataFrame, last_epoch: int) -> DataFrame:
    """A resumed run drops the epochs after its checkpoint."""
    return log.where(F.col("epoch") <= last_epoch)
