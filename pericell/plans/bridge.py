"""Star-schema tables seen as frames and atoms: orders are cubic boxes of 8, lineitems their atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.whole import spread

BOX = 8.0
ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
XYZ = (
    "((l_partkey * 37) % 512) / 6.4e1",
    "((l_suppkey * 101 + l_linenumber * 67) % 512) / 6.4e1",
    "((cast(l_quantity as bigint) * 53) % 512) / 6.4e1",
)
SYMBOLS = ["A", "N", "R"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, atom_id, species, type, x, y, z, fx, fy, fz (null where the line is open)."""
    order = Window.partitionBy("frame_id").orderBy(*ORDER)
    known = "l_linestatus <> 'O'"
    lines = table(spark, sf_dir, "lineitem")
    return spread(lines, lines.count(), "l_orderkey").withColumnRenamed("l_orderkey", "frame_id").select(
        "frame_id",
        (F.row_number().over(order) - 1).cast("long").alias("atom_id"),
        F.col("l_returnflag").alias("species"),
        (F.array_position(F.array(*[F.lit(s) for s in SYMBOLS]), F.col("l_returnflag")) - 1).cast("int").alias("type"),
        *[F.expr(e).alias(a) for e, a in zip(XYZ, "xyz", strict=True)],
        *[F.expr(f"CASE WHEN {known} THEN {e} END").alias(n) for e, n in (("l_discount * 1e1", "fx"), ("l_tax * 1e1", "fy"), ("l_extendedprice / 1e5", "fz"))],
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, cell, energy (null for pending orders). Not broadcast: as many as orders, and equal cells compress to nothing."""
    cell = F.array(*[F.lit(BOX if k % 4 == 0 else 0.0) for k in range(9)])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("frame_id"),
        cell.alias("cell"),
        F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1e4 END").alias("energy"),
    ).hint("merge")


ATOMS_SQL = f"""atoms AS (
  SELECT l_orderkey AS frame_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) - 1 AS BIGINT) AS atom_id,
    l_returnflag AS species, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS type,
    {XYZ[0]} AS x, {XYZ[1]} AS y, {XYZ[2]} AS z,
    CASE WHEN l_linestatus <> 'O' THEN l_discount * 1e1 END AS fx, CASE WHEN l_linestatus <> 'O' THEN l_tax * 1e1 END AS fy,
    CASE WHEN l_linestatus <> 'O' THEN l_extendedprice / 1e5 END AS fz
  FROM lineitem
)"""
FRAMES_SQL = """frames AS (SELECT o_orderkey AS frame_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1e4 END AS energy FROM orders)"""


def pairs_sql(cutoff: float) -> str:
    """All pairs by brute force over the 27 images of a box of 8 (cutoff at most 8)."""
    return f"""shifts AS (SELECT a.s * 8e0 AS sx, b.s * 8e0 AS sy, c.s * 8e0 AS sz FROM (VALUES (-1), (0), (1)) a(s), (VALUES (-1), (0), (1)) b(s), (VALUES (-1), (0), (1)) c(s)),
all_pairs AS (
  SELECT a.frame_id, a.atom_id AS i, b.atom_id AS j, a.type AS ti, b.type AS tj, b.x - a.x + sx AS dx, b.y - a.y + sy AS dy, b.z - a.z + sz AS dz
  FROM atoms a JOIN atoms b ON a.frame_id = b.frame_id, shifts
), pairs AS (
  SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS d FROM all_pairs WHERE dx * dx + dy * dy + dz * dz < {cutoff * cutoff}e0 AND dx * dx + dy * dy + dz * dz > 1e-20
)"""
