"""Files and tables in any store that Spark's file systems reach.

Small files (models, states, logs) are read and written by the driver through
Hadoop's file system API, so a path may be a plain one or a URI of any scheme
the cluster knows. ``commit`` writes beside the target and renames, so that a
reader sees the old file, the new one, or none, but never half of one.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without one, a temporary folder in local mode only."""
    conf = spark.sparkContext
    named = conf.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not conf.master.startswith("local") or conf.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or "file://" + tempfile.gettempdir()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pericell/{uuid.uuid4().hex}/{name}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for a while; double underscores stand for dots."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in named}
    for k, v in named.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _session() -> SparkSession | None:
    return SparkSession.getActiveSession() or SparkSession._instantiatedSession


def _at(path: str):
    spark = _session()
    if spark is None:
        raise RuntimeError("a Spark session is needed to reach files in stores")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def join(folder: str, *names: str) -> str:
    return "/".join([folder.rstrip("/"), *names])


def exists(path: str) -> bool:
    if _session() is None and "://" not in path:
        return Path(path).exists()
    fs, at = _at(path)
    return fs.exists(at)


def delete(path: str) -> None:
    if _session() is None and "://" not in path:
        shutil.rmtree(path) if Path(path).is_dir() else Path(path).unlink(missing_ok=True)
        return
    fs, at = _at(path)
    fs.delete(at, True)


def listed(folder: str) -> list[str]:
    """Names in a folder, in order; none if it does not exist."""
    if _session() is None and "://" not in folder:
        return sorted(x.name for x in Path(folder).iterdir()) if Path(folder).exists() else []
    fs, at = _at(folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_bytes(path: str) -> bytes:
    """Without a session, plain paths only: a calculator needs no Spark to read its model."""
    if _session() is None and "://" not in path:
        return Path(path).read_bytes()
    fs, at = _at(path)
    stream = fs.open(at)
    try:
        return bytes(_session()._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def read_text(path: str) -> str:
    return read_bytes(path).decode()


def commit(path: str, data: bytes | str) -> None:
    """Write a file whole: under another name beside it, then renamed over it. Without a session, plain paths only."""
    data, name = data.encode() if isinstance(data, str) else data, f"{path}.{uuid.uuid4().hex}.tmp"
    if _session() is None and "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(name).write_bytes(data)
        Path(name).replace(path)
        return
    fs, at = _at(path)
    _, beside = _at(name)
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    if not fs.rename(beside, at):  # some stores do not rename over a file that is there
        fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"cannot put {path} in place")
