"""Written tables in the folder that the cluster shares.

Lineage is cut by writing Parquet to ``spark.checkpoint.dir`` and reading it
again, so a lost executor costs no recomputation and the files are seen by all.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: While a table is written: shuffle files go when the job ends, Arrow batches are small.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. A temporary one only in local mode, where one machine does all; else ``ValueError``."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pericell-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pericell/{uuid.uuid4().hex}/{name}"


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in WHILE_WRITING}
    for k, v in WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(df: DataFrame, path: str, codec: str = "zstd", by: str | None = None) -> str:
    """Write ``df``, which is built for this and not run again, and free what its job has shuffled."""
    with _settings(df.sparkSession):
        out = df.write.option("compression", codec)
        (out.partitionBy(by) if by else out).parquet(path)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(write(df, new_path(spark, name), codec))


def drop(spark: SparkSession, *tables: str | DataFrame) -> None:
    """Delete written tables, by path or as read back."""
    for table in tables:
        paths = [table] if isinstance(table, str) else {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def tidy() -> None:
    """In a Python worker: give memory that is free back to the system, since idle workers stay."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
