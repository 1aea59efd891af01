"""Extended XYZ: frames as blocks of a count line, a comment line and one line per atom.

``read_xyz`` reads a file or a folder of files through Spark's text reader, so that
they may lie in any store and nothing is read by the driver: each split of a file is
cut into frames and parsed where it lies, once, into a table in the shared folder,
and only the pieces of frames that cross from one split into the next are put
together. It gives a row per frame: frame_id (order in
the files, by path), natoms, cell, energy, virial, species, pos, forces (null if
absent), block (the text itself, less than 2 GB).

Frames by their number come through an index, which tasks make in one pass over the count lines:

    register(spark); index_xyz(spark, path, index)
    spark.read.format("extxyz").option("index", index).option("first", 5000).option("last", 5999).load()

gives the same rows and numbers as read_xyz; of frames between two numbers only the
ranges of bytes that hold them are read, and only they are parsed. Tasks open the files themselves: plain paths, or stores that pyarrow has a file system for.
Without an index, load(path) takes one file of at most SCANNED bytes, whose count
lines the driver looks at.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import Any, BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pd
from pyarrow import fs as stores
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import storage

SCHEMA = "frame_id bigint, natoms int, cell array<double>, energy double, virial array<double>, species array<string>, pos array<double>, forces array<double>, block string"


def quoted_tag(comment: str, key: str) -> str | None:
    """Value of key="...", any case; the key may end a longer word."""
    found = re.search(re.escape(key) + r'="([^"]*)"', comment, re.IGNORECASE)
    return found[1] if found else None


def scalar_tag(comment: str, key: str) -> str | None:
    """Value of key=..., any case, after white space or at the beginning."""
    found = re.search(r"(?:^|[ \t])" + re.escape(key) + r'=([^ \t"]*)', comment, re.IGNORECASE)
    return found[1] if found else None


def properties(comment: str) -> list[tuple[str, str, int]] | None:
    """(name, type, count) of each column; None if there are none or they don't come in threes."""
    spec = scalar_tag(comment, "Properties")
    fields = spec.split(":") if spec else []
    if not fields or len(fields) % 3:
        return None
    return [(fields[k], fields[k + 1], int(fields[k + 2])) for k in range(0, len(fields), 3)]


def numbers(text: str, n: int, what: str) -> list[float]:
    values = [float(x) for x in text.split()]
    if len(values) != n:
        raise ValueError(f"{what} needs {n} numbers, not {len(values)}")
    return values


def parse_comment(comment: str, energy_key: str = "energy") -> dict[str, Any]:
    lattice = quoted_tag(comment, "Lattice")
    if lattice is None:
        raise ValueError("no Lattice")
    cell = numbers(lattice, 9, "Lattice")
    energy, virial, stress = scalar_tag(comment, energy_key), quoted_tag(comment, "virial"), quoted_tag(comment, "stress")
    out: dict[str, Any] = {"cell": cell, "energy": None if energy is None else float(energy), "virial": None}
    if virial is not None:
        out["virial"] = numbers(virial, 9, "virial")
    elif stress is not None:
        volume = abs(float(np.linalg.det(np.reshape(cell, (3, 3)))))
        out["virial"] = [-x * volume for x in numbers(stress, 9, "stress")]
    return out


def parse_block(block: str, energy_key: str = "energy") -> dict[str, Any]:
    lines = block.rstrip("\n").split("\n")
    n, comment = int(lines[0]), lines[1]
    columns = properties(comment)
    if columns is None:
        raise ValueError("no Properties")
    at, places, text_at = 0, {}, None
    for name, kind, count in columns:
        if kind.upper() == "S" and text_at is None:
            text_at = at
        places[name.lower()] = (at, count)
        at += count
    if text_at is None or "pos" not in places:
        raise ValueError("species and pos are needed")
    rows = [line.split() for line in lines[2 : 2 + n]]
    if len(rows) != n:
        raise ValueError("the frame is cut short")

    def pick(name: str) -> list[float] | None:
        if name not in places:
            return None
        lo, count = places[name]
        return [float(x) for row in rows for x in row[lo : lo + count]]

    forces = pick("force")
    return {"natoms": n, **parse_comment(comment, energy_key), "species": [r[text_at] for r in rows], "pos": pick("pos"), "forces": pick("forces") if forces is None else forces}


#: Bytes of a file that the driver goes through if there is no index.
SCANNED = 256 << 20
#: A row per range of frames that lie together in a file: the first and last frame_id, and where the range is.
INDEX = "file string, length bigint, first bigint, last bigint, start bigint, size bigint"
COUNT = re.compile(r"\s*\d+\s*").fullmatch


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """Plain paths and file: URIs are local; others need a file system of pyarrow."""
    if path.startswith("file:") or "://" not in path:
        return stores.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return stores.FileSystem.from_uri(quote(path, safe=":/"))


def opened(path: str) -> BinaryIO:
    store, at = store_of(path)
    return io.BufferedReader(store.open_input_file(at), 1 << 20)


def aligned(file: BinaryIO, lo: int) -> int | None:
    """Where the first frame at or after byte ``lo`` begins: at 0, or at a count line before a line with Properties."""
    if lo == 0:
        return 0
    file.seek(lo - 1)
    file.readline()
    at, line = file.tell(), file.readline()
    while line:
        place, following = file.tell(), file.readline()
        if COUNT(line.decode()) and b"properties=" in following.lower():
            return at
        at, line = place, following
    return None


def blocks(path: str, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int]]:
    """(byte offset, bytes) of each frame that begins before ``hi``, from the one at ``lo`` on; only count lines are looked at."""
    with opened(path) as file:
        file.seek(lo)
        while hi is None or file.tell() < hi:
            start = file.tell()
            first = file.readline()
            if not first:
                return
            n = int(first)  # a blank line is an error
            for _ in range(n + 1):
                if not file.readline():
                    raise ValueError(f"the frame at byte {start} of {path} is cut short")
            yield start, file.tell() - start


def index_xyz(spark: SparkSession, path: str, target: str, range_bytes: int = 32 << 20) -> None:
    """Writes INDEX of a file or a folder of files, in the order of read_xyz, to the folder ``target``.

    A task looks at the count lines of about ``range_bytes`` and finds its first frame by itself; a frame belongs to
    the range that it begins in. Empty files have no rows. Bytes that are in no frame, or in two, are an error.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    ranges = files.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))))
    ranges = ranges.withColumn("hi", F.least(F.col("lo") + range_bytes, "length"))
    tasks = min(ranges.count(), 20_000)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, length, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "lo", "hi")), strict=True):
                with opened(file) as text:
                    start = aligned(text, lo)
                n = size = 0
                if start is not None and start < hi:
                    for _, more in blocks(file, start, hi):
                        n, size = n + 1, size + more
                rows.append({"file": file, "length": length, "start": start, "size": size, "frames": n})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("length", "start", "size", "frames"))]))

    seen = written(ranges.repartition(max(tasks, 1)).mapInArrow(look, "file string, length bigint, start bigint, size bigint, frames bigint"), "ranges").where("frames > 0")
    ahead = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    bad = seen.withColumn("end", F.coalesce(F.sum("size").over(ahead), F.lit(0))).groupBy("file", "length").agg(F.max((F.col("start") != F.col("end")).cast("int")).alias("apart"), F.sum("size").alias("size"))
    bad = files.join(bad, ["file", "length"], "left").where("apart = 1 OR size IS NULL OR size != length").select("file").first()
    if bad:
        raise ValueError(f"{bad[0]} is no run of whole frames")
    before = F.coalesce(F.sum("frames").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per range
    rows = seen.withColumn("first", before).withColumn("last", F.col("first") + F.col("frames") - 1)
    rows.select(*[x.split(" ")[0] for x in INDEX.split(", ")]).sort("first").write.parquet(target)


class FrameRange(InputPartition):
    def __init__(self, path: str, length: int, first: int, start: int, size: int):
        super().__init__((path, first, start, size))
        self.path, self.length, self.first, self.start, self.size = path, length, first, start, size


class ExtxyzReader(DataSourceReader):
    """Frames of an index, or of one small file, those of numbers ``first`` to ``last`` alone.

    They are options, not conditions pushed down: Spark 4.1 keeps a source that conditions have narrowed, and a later
    read of the same DataFrame without conditions then misses rows.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.index = options.get("path"), options.get("index")
        self.energy_key = options.get("energykey", "energy")
        self.bytes = int(options.get("partitionbytes", 4 << 20))
        self.least, self.most = int(options.get("first", 0)), int(options.get("last", 2**63 - 1))

    def partitions(self) -> list[FrameRange]:
        if self.index:
            store, at = store_of(self.index)
            wanted = (pd.field("first") <= self.most) & (pd.field("last") >= self.least)
            rows = pd.dataset(at, filesystem=store, format="parquet").to_table(filter=wanted).sort_by("first").to_pylist()
            return [FrameRange(r["file"], r["length"], r["first"], r["start"], r["size"]) for r in rows]
        length = bytes_of(self.path)
        if length > SCANNED:
            raise ValueError(f"{self.path} has more than {SCANNED} bytes: make an index of it by index_xyz, or use read_xyz")
        out, first, start, size, count = [], 0, 0, 0, 0
        for at, n in blocks(self.path):
            if size and size + n > self.bytes:
                out.append(FrameRange(self.path, length, first, start, size))
                first, start, size = count, at, 0
            size += n
            count += 1
        if size:
            out.append(FrameRange(self.path, length, first, start, size))
        return out

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        if partition is None:
            return
        if bytes_of(partition.path) != partition.length:
            raise ValueError(f"{partition.path} has changed since its frames were found")
        with opened(partition.path) as file:
            for no, (at, n) in enumerate(blocks(partition.path, partition.start, partition.start + partition.size), partition.first):
                if no > self.most:
                    return
                if no >= self.least:
                    file.seek(at)
                    block = file.read(n).decode()
                    f = parse_block(block, self.energy_key)
                    yield (no, *(f[name] for name in FIELDS), block)


def bytes_of(path: str) -> int:
    store, at = store_of(path)
    return store.get_file_info(at).size


class Extxyz(DataSource):
    @classmethod
    def name(cls) -> str:
        return "extxyz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ExtxyzReader:
        return ExtxyzReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Extxyz)


FIELDS = [x.split(" ")[0] for x in SCHEMA.split(", ")][1:-1]
#: Where a piece stands (no: its order in the split, -1 before the first frame; sub: its order in what was put together),
#: its text and, of whole frames, the tag frame_id and what SCHEMA has between frame_id and block.
PIECE = f"file string, start bigint, no int, sub int, whole boolean, value string, tag string, {', '.join(SCHEMA.split(', ')[1:-1])}"
KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


class Cutter:
    """Cuts the lines of one split into pieces (no, whole, text): frames, and before and after them parts of frames.

    Inside a frame its count says how many lines follow. Before the first one a frame is known to begin at a
    count line whose next line has Properties: a line of an atom has more than one field.
    """

    def __init__(self):
        self.lines: list[str] = []
        self.missing: int | None = None  # lines of the frame that are still to come; None before the first frame
        self.no = -1

    def add(self, line: str) -> Iterator[tuple[int, bool, str]]:
        if self.missing is None:
            begins = bool(self.lines) and bool(COUNT(self.lines[-1])) and "properties=" in line.lower()
            if begins:
                first = self.lines.pop()
                if self.lines:
                    yield -1, False, "\n".join(self.lines)
                self.lines, self.missing, self.no = [first], int(first) + 1, 0
            self.lines.append(line)
            if begins:
                self.missing -= 1
        elif self.missing == 0 and not self.lines:
            if not COUNT(line):
                raise ValueError(f"a count is expected, not {line[:40]!r}")
            self.lines, self.missing, self.no = [line], int(line) + 1, self.no + 1
        else:
            self.lines.append(line)
            self.missing -= 1
        if self.missing == 0 and self.lines:
            yield self.no, True, "\n".join(self.lines)
            self.lines = []

    def end(self) -> Iterator[tuple[int, bool, str]]:
        if self.lines:
            yield self.no, False, "\n".join(self.lines)


def _row(file: str, start: int, no: int, sub: int, whole: bool, text: str, energy_key: str | None) -> tuple:
    """A piece as PIECE has it; a whole frame is parsed if ``energy_key`` is given."""
    if not whole or energy_key is None:
        return (file, start, no, sub, whole, text, *[None] * (1 + len(FIELDS)))
    f = parse_block(text, energy_key)
    return (file, start, no, sub, whole, text, scalar_tag(text.split("\n", 2)[1], "frame_id"), *(f[name] for name in FIELDS))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in PIECE.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], KINDS[t]) for k, t in enumerate(kinds)], list(names))


def pieces(spark: SparkSession, path: str, energy_key: str | None, counter: Accumulator | None = None) -> DataFrame:
    """PIECE of every split: frames, and parts of frames where a split begins or ends. ``counter`` gets the characters that are read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cutter = None, Cutter()
        for batch in batches:
            rows, seen = [], 0
            for line, file, start in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start")), strict=True):
                if at != (file, start):
                    rows += [_row(*at, no, 0, whole, text, energy_key) for no, whole, text in cutter.end()] if at else []
                    at, cutter = (file, start), Cutter()
                rows += [_row(*at, no, 0, whole, text, energy_key) for no, whole, text in cutter.add(line)]
                seen += len(line) + 1
            if counter is not None:
                counter.add(seen)
            if rows:
                yield _batch(rows)
        rows = [_row(*at, no, 0, whole, text, energy_key) for no, whole, text in cutter.end()] if at else []
        if rows:
            yield _batch(rows)

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return lines.mapInArrow(cut, PIECE)


def written(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back."""
    spark = df.sparkSession
    path = storage.new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def framed(spark: SparkSession, path: str, energy_key: str | None = None, counter: Accumulator | None = None) -> DataFrame:
    """frame_id, value, tag and, with ``energy_key``, the fields of every frame, in order of files and places.

    The text is gone through once: its splits are cut into frames, parsed and written as a table. What follows reads
    that table's columns: places alone for the numbering, parts of frames alone to be put together.
    """
    cut = written(pieces(spark, path, energy_key, counter), "pieces")
    splits = cut.groupBy("file", "start").agg(F.max("no").alias("last"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    splits = splits.withColumn("joint", F.last(F.when(F.col("last") >= 0, F.col("start")), ignorenulls=True).over(before))
    # a piece before the first frame of a split goes with the last split that has the beginning of one; a file may have none before it
    parts = cut.where("not whole").select("file", "start", "no", "value").join(splits.select("file", "start", "joint"), ["file", "start"])
    parts = parts.withColumn("of", F.when(F.col("no") >= 0, F.col("start")).otherwise(F.coalesce("joint", F.lit(-1))))
    joined = parts.groupBy("file", F.col("of").alias("start")).agg(F.max("no").alias("no"), F.sort_array(F.collect_list(F.struct("start", "no", "value"))).alias("p"))
    joined = joined.select("file", "start", "no", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, start, no, text in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "no", "value")), strict=True):
                rows += [_row(file, start, no, sub, True, one, energy_key) for sub, one in enumerate(frames_of(file, text))]
            yield _batch(rows)

    # what was put together may hold several frames when counts stood at the end of splits
    every = cut.where("whole").unionByName(written(joined.mapInArrow(mend, PIECE), "mended"))
    counts = every.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    counts = counts.select("file", "start", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    # frames of a split are numbered as they come, and what was put together follows its beginning: no row moves
    at = F.col("ahead") + F.greatest("no", F.lit(0)) + F.col("sub")
    return every.join(counts, ["file", "start"]).select(at.cast("long").alias("frame_id"), "value", "tag", *FIELDS)


def frames_of(file: str, text: str) -> Iterator[str]:
    """The frames of a text that is a run of whole frames."""
    lines, at = text.split("\n"), 0
    while at < len(lines):
        size = int(lines[at]) + 2
        if at + size > len(lines):
            raise ValueError(f"the last frame of {file} is cut short")
        yield "\n".join(lines[at : at + size])
        at += size


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """frame_id, value: the text of every frame."""
    return framed(spark, path).select("frame_id", "value")


def read_xyz(spark: SparkSession, path: str, energy_key: str = "energy", keep_ids: bool = False, counter: Accumulator | None = None) -> DataFrame:
    """A row per frame of a file or a folder of files, in any store that Spark reads; ``keep_ids``: a tag frame_id in
    the comment stands before the order. The text is read and parsed at once, into a table that the result reads."""
    read = framed(spark, path, energy_key, counter)
    key = F.coalesce(F.expr("cast(tag as bigint)"), F.col("frame_id")) if keep_ids else F.col("frame_id")
    return read.select(key.alias("frame_id"), *FIELDS, F.concat("value", F.lit("\n")).alias("block"))


def read_blocks(spark: SparkSession, path: str, energy_key: str = "energy") -> DataFrame:
    """Parts written by write_xyz, with the frame ids that they had."""
    return read_xyz(spark, path, energy_key, keep_ids=True)


def from_structures(spark: SparkSession, structures: list[dict]) -> DataFrame:
    """Structures in memory as read_xyz gives them: dicts of species, positions and cell, and where known energy,
    forces and virial. They are the driver's own objects, sent once; larger sets come as files or tables."""
    flat = lambda x: None if x is None else [float(v) for v in np.ravel(x)]
    rows = []
    for k, one in enumerate(structures):
        species, pos, cell = list(one["species"]), flat(one["positions"]), flat(one["cell"])
        forces, virial, energy = flat(one.get("forces")), flat(one.get("virial")), one.get("energy")
        if len(pos) != 3 * len(species) or len(cell) != 9 or len(forces or pos) != len(pos) or len(virial or cell) != 9:
            raise ValueError(f"structure {k}: the sizes of its arrays differ")
        rows.append((k, len(species), cell, None if energy is None else float(energy), virial, species, pos, forces, None))
    return spark.createDataFrame(rows, SCHEMA)


def to_atoms(read: DataFrame) -> DataFrame:
    """atoms (species still as text) of what read_xyz gives."""
    rows = read.select("frame_id", "pos", "forces", F.posexplode("species").alias("atom_id", "species"))
    value = lambda a, k: F.col(a)[F.col("atom_id") * 3 + k]
    return rows.select("frame_id", F.col("atom_id").cast("long").alias("atom_id"), "species", *[value("pos", k).alias(n) for k, n in enumerate("xyz")], *[value("forces", k).alias(f"f{n}") for k, n in enumerate("xyz")])


def to_frames(read: DataFrame) -> DataFrame:
    return read.select("frame_id", "natoms", "cell", "energy", "virial")


def block_text(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """frame_id and the text of each frame; atoms have species, x, y, z and may have fx, fy, fz."""
    forces = "fx" in atoms.columns
    show = lambda c: F.col(c).cast("string")
    line = F.concat_ws(" ", "species", *[show(c) for c in ("x", "y", "z", *(("fx", "fy", "fz") if forces else ()))])
    per = atoms.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("atom_id", line.alias("line")))).alias("l"), F.count(F.lit(1)).alias("n"))
    cell = F.array_join(F.transform("cell", lambda x: x.cast("string")), " ")
    energy = F.coalesce(F.concat(F.lit("energy="), F.col("energy").cast("string"), F.lit(" ")), F.lit(""))
    comment = F.concat(energy, F.lit("frame_id="), F.col("frame_id").cast("string"), F.lit(' pbc="T T T" Lattice="'), cell, F.lit('" Properties=species:S:1:pos:R:3' + (":force:R:3" if forces else "")))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return per.join(frames.select("frame_id", "cell", "energy"), "frame_id").select("frame_id", F.concat_ws("\n", F.col("n").cast("string"), comment, body).alias("value"))


def write_xyz(atoms: DataFrame, frames: DataFrame, path: str) -> None:
    """Parts in ranges of frames, each in order, as many as the frames ask for."""
    text = block_text(atoms, frames).repartitionByRange("frame_id").sortWithinPartitions("frame_id")
    text.select("value").write.text(path)


def export_split(spark: SparkSession, path: str, ratio: float, seed: int, out_dir: str, energy_key: str = "energy") -> tuple[str, str, int, int]:
    """Folders train.xyz and test.xyz with the blocks of ``path`` as they are, in order, in parts; refuses to write over its input."""
    from ..operators.sampling import split

    targets = [f"{out_dir.rstrip('/')}/{n}.xyz" for n in ("train", "test")]
    whole = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(p)).toString()
    if any(whole(t) == whole(path) for t in targets):
        raise ValueError("the split would overwrite its input")
    blocks = numbered(spark, path).persist()
    marked = blocks.join(split(blocks.select("frame_id"), ratio, seed), "frame_id")
    for target, valid in zip(targets, (False, True), strict=True):
        own = marked.where(F.col("valid") == valid).repartitionByRange("frame_id").sortWithinPartitions("frame_id")
        own.select("value").write.mode("overwrite").text(target)
    n, m = (marked.where(F.col("valid") == valid).count() for valid in (False, True))
    blocks.unpersist()
    return (*targets, n, m)
