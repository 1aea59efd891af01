import numpy as np
import pytest

from pericell.sources import extxyz as E
from pericell.sources.config import parse_config

BLOCK = """2
energy=-3.5 config_type=x pbc="T T T" Lattice="4 0 0 0 5 0 0 0 6" stress="1 0 0 0 1 0 0 0 1" Properties=pos:R:3:species:S:1:force:R:3
0.0 0.1 0.2 Te 1 2 3
1.0 1.1 1.2 Pb 4 5 6
"""
PLAIN = """1
Lattice="4 0 0 0 5 0 0 0 6" atomization_energy=7 VIRIAL="1 2 3 4 5 6 7 8 9" Properties=species:S:1:pos:R:3
Te 0.5 0.5 0.5
"""


def test_block_rules():
    f = E.parse_block(BLOCK)
    assert f["species"] == ["Te", "Pb"] and f["energy"] == -3.5 and f["forces"] == [1, 2, 3, 4, 5, 6] and np.allclose(f["virial"], -120 * np.eye(3).ravel())
    g = E.parse_block(PLAIN)
    assert g["energy"] is None and g["forces"] is None and g["virial"] == list(range(1, 10))
    assert E.parse_block(PLAIN, "atomization_energy")["energy"] == 7
    for bad in (BLOCK.replace("Lattice", "Latt"), BLOCK.replace("4 0 0 0 5", "4 0 0 5"), BLOCK.replace("Properties=pos:R", "Properties=pos"), BLOCK.replace("energy=-3.5", 'energy="-3.5"')):
        with pytest.raises(ValueError):
            E.parse_block(bad)


def test_reader_in_ranges(spark, tmp_path):
    path = str(tmp_path / "a.xyz")
    with open(path, "w") as out:
        out.write((BLOCK + PLAIN) * 50)
    E.register(spark)
    df = spark.read.format("extxyz").option("partitionbytes", 1000).load(path)
    assert df.rdd.getNumPartitions() > 5
    got = df.orderBy("frame_id").collect()
    assert [r.frame_id for r in got] == list(range(100)) and "".join(r.block for r in got) == (BLOCK + PLAIN) * 50
    atoms = E.to_atoms(df).orderBy("frame_id", "atom_id").limit(2).collect()
    assert (atoms[1].species, atoms[1].x, atoms[1].fz) == ("Pb", 1.0, 6.0)


@pytest.fixture
def folder(tmp_path):
    """Two files, one with a space in its name, with frames of unlike lengths."""
    blocks = [BLOCK.replace("-3.5", f"-{k}.5") if k % 3 else PLAIN for k in range(40)]
    blocks[7] = blocks[31] = "30\n" + BLOCK.split("\n")[1] + "\n" + "0.0 0.1 0.2 Te 1 2 3\n" * 30
    at = tmp_path / "in"
    at.mkdir()
    (at / "a 1.xyz").write_text("".join(blocks[:25]))
    (at / "b.xyz").write_text("".join(blocks[25:]))
    (at / "c.xyz").write_text("")
    return at, blocks


@pytest.mark.parametrize("size", [60, 700, 1 << 20])
def test_index_made_in_tasks(spark, tmp_path, folder, size):
    """Ranges shorter and longer than frames: the rows of read_xyz; two numbers leave few ranges."""
    at, blocks = folder
    E.register(spark)
    E.index_xyz(spark, str(at), str(tmp_path / "index"), size)
    read = spark.read.format("extxyz").option("index", f"file://{tmp_path}/index").load()
    got = read.orderBy("frame_id").collect()
    assert got == E.read_xyz(spark, str(at)).orderBy("frame_id").collect() and [r.block for r in got] == blocks
    index = spark.read.parquet(str(tmp_path / "index"))
    assert read.rdd.getNumPartitions() == index.count() >= 2
    for first, last in ((23, 26), (31, 31), (38, 99), (0, 1), (50, 60), (3, 2)):
        some = spark.read.format("extxyz").options(index=str(tmp_path / "index"), first=first, last=last).load()
        ids = list(range(first, min(last, 39) + 1))
        assert [(r.frame_id, r.block) for r in some.orderBy("frame_id").collect()] == [(k, blocks[k]) for k in ids]
        assert size > 200 or some.rdd.getNumPartitions() <= len(ids) + 1
        assert some.where("frame_id = 31").count() == (31 in ids) and some.count() == len(ids)


def test_index_reads_what_is_asked_for(spark, tmp_path, folder):
    """Frames beside those asked for are not parsed; a file that has changed or has no whole frames is an error."""
    at, blocks = folder
    E.register(spark)
    E.index_xyz(spark, str(at), str(tmp_path / "index"))
    part = lambda lo, hi: spark.read.format("extxyz").options(index=str(tmp_path / "index"), first=lo, last=hi).load()
    (at / "b.xyz").write_text("".join(blocks[25:]).replace("Lattice", "Nothing"))
    assert part(0, 24).count() == 25
    with pytest.raises(Exception, match="no Lattice"):
        part(24, 25).collect()
    (at / "b.xyz").write_text("".join(blocks[25:]) + PLAIN)
    with pytest.raises(Exception, match="has changed"):
        part(39, 39).collect()
    for k, bad in enumerate((BLOCK * 3 + BLOCK[:-30], BLOCK.replace("2\n", "3\n", 1) + BLOCK * 3, "x\n" + BLOCK, BLOCK + "\n")):
        (tmp_path / f"{k}.xyz").write_text(bad)
        for size in (100, 1 << 20):
            with pytest.raises(Exception, match="cut short|whole frames|invalid literal"):
                E.index_xyz(spark, str(tmp_path / f"{k}.xyz"), str(tmp_path / f"bad{k}{size}"), size)
    (tmp_path / "none.xyz").write_text("")
    E.index_xyz(spark, str(tmp_path / "none.xyz"), str(tmp_path / "none"))
    assert spark.read.format("extxyz").option("index", str(tmp_path / "none")).load().count() == 0


def test_driver_scans_small_files_alone(spark, tmp_path, monkeypatch):
    (tmp_path / "a.xyz").write_text(BLOCK * 3)
    reader = E.ExtxyzReader({"path": str(tmp_path / "a.xyz")})
    assert [p.first for p in reader.partitions()] == [0]
    monkeypatch.setattr(E, "SCANNED", 10)
    with pytest.raises(ValueError, match="index_xyz"):
        reader.partitions()


def test_written_parts_read_back(spark, tmp_path):
    path = str(tmp_path / "a.xyz")
    with open(path, "w") as out:
        out.write(BLOCK * 9)
    read = E.read_xyz(spark, path)
    E.write_xyz(E.to_atoms(read), E.to_frames(read), str(tmp_path / "parts"))
    back = E.read_blocks(spark, str(tmp_path / "parts")).orderBy("frame_id").collect()
    for a, b in zip(read.orderBy("frame_id").collect(), back, strict=True):
        assert (a.frame_id, a.species, a.pos, a.forces, a.cell, a.energy) == (b.frame_id, b.species, b.pos, b.forces, b.cell, b.energy)


@pytest.mark.parametrize("size", ["150b", "333b", "1500b", "128m"])
def test_splits_of_files_are_put_together(spark, tmp_path, size):
    """Splits much shorter than a frame, in a folder of two files, read through Spark alone."""
    blocks = [BLOCK.replace("-3.5", f"-{k}.5") if k % 3 else PLAIN for k in range(25)]
    wide = "30\n" + BLOCK.split("\n")[1] + "\n" + "0.0 0.1 0.2 Te 1 2 3\n" * 30
    blocks[7] = blocks[19] = wide
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xyz").write_text("".join(blocks[:20]))
    (tmp_path / "in" / "b.xyz").write_text("".join(blocks[20:]).rstrip("\n"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = E.read_xyz(spark, str(tmp_path / "in")).orderBy("frame_id").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r.frame_id for r in got] == list(range(25)) and [r.block for r in got] == blocks
    (tmp_path / "short.xyz").write_text(BLOCK + BLOCK[:-30])
    with pytest.raises(Exception, match="cut short"):
        E.read_xyz(spark, str(tmp_path / "short.xyz")).collect()


def test_text_is_gone_through_once(spark, tmp_path):
    """However often the rows are used, each line is cut and parsed once; numbering reads no text."""
    text = "".join(BLOCK.replace("-3.5", f"-{k}.5") for k in range(40))
    (tmp_path / "a.xyz").write_text(text)
    seen = spark.sparkContext.accumulator(0)
    read = E.read_xyz(spark, str(tmp_path / "a.xyz"), counter=seen)
    assert [r.energy for r in read.orderBy("frame_id").collect()] == [-k - 0.5 for k in range(40)]
    assert E.to_atoms(read).count() == 80 and read.where("energy < -9").count() == 31 and "".join(r.block for r in read.orderBy("frame_id").collect()) == text
    assert seen.value == len(text)
    plan = read.select("frame_id")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "pos" not in plan.split("Physical Plan")[1]


def test_structures_in_memory(spark):
    one = E.parse_block(BLOCK)
    given = {"species": one["species"], "positions": np.reshape(one["pos"], (2, 3)), "cell": np.diag([4, 5, 6]), "forces": one["forces"], "energy": -3.5}
    rows = E.from_structures(spark, [given, {"species": ["Te"], "positions": [[0, 0, 1]], "cell": np.eye(3)}]).orderBy("frame_id").collect()
    assert (rows[0].pos, rows[0].cell, rows[0].energy, rows[0].forces) == (one["pos"], one["cell"], -3.5, one["forces"])
    assert rows[1].natoms == 1 and rows[1].energy is None and E.to_atoms(E.from_structures(spark, [given])).count() == 2
    with pytest.raises(ValueError):
        E.from_structures(spark, [given | {"positions": [[0, 0, 1]]}])


def test_export_split_keeps_text(spark, tmp_path):
    path = str(tmp_path / "a.xyz")
    blocks = [BLOCK.replace("-3.5", f"-{k}.5") for k in range(20)]
    with open(path, "w") as out:
        out.write("".join(blocks))
    train, test, n, m = E.export_split(spark, path, 0.2, 5, str(tmp_path / "split"))
    parts = ["".join(r.block for r in E.read_xyz(spark, p).orderBy("frame_id").collect()) for p in (train, test)]
    assert (n, m) == (16, 4) and sum(map(len, parts)) == sum(map(len, blocks)) and all((x in parts[0]) != (x in parts[1]) for x in blocks)
    with pytest.raises(ValueError):
        E.export_split(spark, train, 0.2, 5, str(tmp_path / "split"))


def test_config():
    c = parse_config("type 2 Te Pb  # two\nCUTOFF 6 4\nbatch 4\nunknown 7\nl_max 4 2 1\nstage2 1\nepoch 10\n")
    assert c.types == ("Te", "Pb") and c.cutoff == (6.0, 4.0) and c.batch == 4 and c.lr == 0.01 and c.second_stage == 5 and "batch" in c.explicit
    assert c.shape().channels == ("222", "1111") and "neuron" in c.summary()
    for bad in ("version 3\ntype 1 X", "lr_scheduler x\ntype 1 X", "batch 4", "type 2 X"):
        with pytest.raises(ValueError):
            parse_config(bad)
