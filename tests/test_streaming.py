import numpy as np
import pytest

from pericell.operators.statistics import Ranges, scalers, state
from pericell.streaming import frame_stream, running_ranges, scaler_of


def test_running_scaler(spark, tmp_path):
    rows = [(k, float(k % 7), -2.0 * k) for k in range(50)]
    ddl, folder = "id bigint, a double, b double", str(tmp_path / "in")
    for k in range(0, 50, 10):
        spark.createDataFrame(rows[k : k + 10], ddl).coalesce(1).write.mode("append").parquet(folder)
    ranges = running_ranges(frame_stream(spark, folder, ddl, 2), ["a", "b"])
    query = ranges.writeStream.outputMode("complete").format("memory").queryName("ranges").start()
    query.processAllAvailable()
    query.stop()
    got = scaler_of(spark.table("ranges"), ["a", "b"]).first()
    assert spark.table("ranges").first().n == 50 and np.allclose([got.a, got.b], [1 / 6, 1 / 98])


def xyz(energies, start=0):
    rng = np.random.default_rng(start)
    out = ""
    for e in energies:
        out += f'3\n{"" if e is None else f"energy={e} "}Lattice="7 0 0 0 8 0 0 0 9" ' + ('virial="1 2 3 4 5 6 7 8 9" ' if (e or 0) > 2 else "") + "Properties=species:S:1:pos:R:3:force:R:3\n"
        out += "".join(" ".join(["AB"[k % 2], *map(str, rng.uniform(0, 7, 6))]) + "\n" for k in range(3))
    return out


def totals(spark, folder):
    return {r.name: (r.n, r.total, r.square) for r in Ranges(folder).merged(spark).collect()}


def test_merged_states_equal_one_pass(spark, tmp_path):
    """A file is added: its rows alone are read, and scalers and sums are those of a pass over all."""
    rng = np.random.default_rng(2)
    values = [rng.normal(size=500) * 10.0 ** rng.integers(-8, 9, 500) for _ in range(3)]
    read = []

    def load(path):
        read.append(path)
        return spark.createDataFrame([(float(x), None if k % 3 else float(x * x)) for k, x in enumerate(values[int(path)])], "a double, b double").repartition(4)

    ranges = Ranges(f"file://{tmp_path}/states")
    assert ranges.update(["0", "1"], load, ["a", "b"]) == ["0", "1"]
    assert ranges.update(["0", "1", "2"], load, ["a", "b"]) == ["2"] and read == ["0", "1", "2"]
    whole = np.concatenate(values)
    got = {r.name: r for r in ranges.merged(spark).collect()}
    one = {r["name"]: r for r in state(load("0").union(load("1")).union(load("2")).repartition(7), ["a", "b"]).to_pylist()}
    from fractions import Fraction

    assert got["a"].n == 1500 and got["b"].n == sum(1 for v in values for k in range(500) if k % 3 == 0)
    assert (got["a"].least, got["a"].most) == (whole.min(), whole.max())
    assert got["a"].total == one["a"]["high"] == float(sum(map(Fraction, whole.tolist())))
    assert got["a"].square == one["a"]["square_high"] == float(sum(Fraction(x) ** 2 for x in whole.tolist()))
    assert got["b"].square == one["b"]["square_high"]
    assert {r.name: r.scaler for r in scalers(ranges.merged(spark)).collect()}["a"] == 1 / (whole.max() - whole.min())
    ranges.add("none", load("0").where("a IS NULL"), ["a", "b"])
    assert {r.name: r.total for r in ranges.merged(spark).collect()}["a"] == got["a"].total


def test_a_restarted_stream_counts_each_frame_once(spark, tmp_path, monkeypatch):
    """Stopped after a state is written and before its batch is done; totals equal those of one pass."""
    from pericell.model import Model, Shape
    from pericell.operators import statistics
    from pericell.sources.extxyz import read_xyz
    from pericell.streaming import ERRORS, frame_errors, keep_errors, xyz_stream

    model = Model.random(Shape(("A", "B"), 5.0, 4.0, 1, 1, 2, 2, 2, (), 3), 4)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.xyz").write_text(xyz([1.5 * k, None, 2.5], k))
    at = [f"file://{tmp_path}/{x}" for x in ("states", "checkpoint")]
    run = lambda: keep_errors(xyz_stream(spark, str(tmp_path / "in"), files_a_batch=1), model, *at).awaitTermination()
    add, done = statistics.Ranges.add, []

    def stopped(self, key, *more):
        add(self, key, *more)
        done.append(key)
        if len(done) == 2:
            raise OSError("lost")

    monkeypatch.setattr(statistics.Ranges, "add", stopped)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    run()
    (tmp_path / "in" / "9.xyz").write_text(xyz([7.0, 8.0], 9))
    run()
    got = totals(spark, at[0])
    read = read_xyz(spark, str(tmp_path / "in"))
    want = {r["name"]: (r["n"], r["high"], r["square_high"]) for r in state(frame_errors(read, model), list(ERRORS)).to_pylist()}
    assert len(statistics.Ranges(at[0]).keys()) == 4 and done == ["batch-000000000000", "batch-000000000001"]
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    assert (got["energy"][0], got["force"][0], got["virial"][0]) == (8, 11, 6)
