"""One query per operator over the star-schema tables, with the same question in SQL where it can be asked there."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import tables
from ..kernels.potential import chebyshev
from ..operators import descriptors as D
from ..operators import metrics as M
from ..operators import neighbors as N
from ..operators import sampling as S
from ..operators import statistics as T
from ..operators.blocks import on_space
from ..operators.whole import frame_sums, on_frames
from ..storage import shared_dir
from .bridge import ATOMS_SQL, FRAMES_SQL, atoms, frames, pairs_sql, table

NT, N_RADIAL, N_ANGULAR, BASIS = 3, 3, 2, 3
RC, RA, RCELL = 6.0, 4.0, 2.5
MAX_L = 4
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def coefficients(n: int, shift: int) -> np.ndarray:
    t, u, a, k = np.meshgrid(np.arange(NT), np.arange(NT), np.arange(n), np.arange(BASIS + 1), indexing="ij")
    return ((t * 7 + u * 5 + a * 3 + k * 2 + shift) % 11 - 5) / 10.0


def coefficient_sql(n: int, k: int, shift: int) -> str:
    return f"(((ti * 7 + tj * 5 + {3 * n + 2 * k + shift}) % 11 - 5) / 1e1)"


C2, C3 = coefficients(N_RADIAL, 0), coefficients(N_ANGULAR, 4)


def query(sql: str | None = None):
    """Registers a query as op_<name>."""

    def add(f):
        QUERIES[f"op_{f.__name__}"] = f
        if sql:
            ORACLE_SQL[f"op_{f.__name__}"] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_wide(df: DataFrame, digits: int = 6) -> DataFrame:
    """For dozens of columns: short expressions, whose method the JVM still compiles. Ties go to even numbers."""
    scale = X.number(10.0**digits)
    return df.select(*[F.expr(f"rint({c} * {scale}) / {scale} + 0e0").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def pairs(spark: SparkSession, sf_dir: str, cutoff: float) -> DataFrame:
    return N.brute_pairs(atoms(spark, sf_dir), frames(spark, sf_dir), cutoff)


def r6(expression: str, name: str) -> str:
    return f"round({expression}, 6) AS {name}"


# types, cells


@query(f"WITH {ATOMS_SQL} SELECT frame_id, atom_id, CAST(type AS INTEGER) AS type, x, y, z FROM atoms")
def p1_type_ids(spark, sf_dir):
    return S.type_ids(atoms(spark, sf_dir).drop("type"), ["A", "N", "R"]).select("frame_id", "atom_id", "type", "x", "y", "z")


TYPES = [(k, s, tables.ELEMENTS[k + 20]) for k, s in enumerate("ANRZ")]


@query(f"WITH {ATOMS_SQL} SELECT element, CAST(z AS INTEGER) AS z, count(*) AS n FROM atoms JOIN (VALUES {', '.join(f'({k}, {chr(39)}{e}{chr(39)}, {tables.ELEMENTS.index(e) + 1})' for k, _, e in TYPES)}) t(k, element, z_) ON type = k CROSS JOIN LATERAL (SELECT z_ AS z) GROUP BY 1, 2".replace("CAST(z AS INTEGER) AS z", "CAST(z_ AS INTEGER) AS z").replace(" CROSS JOIN LATERAL (SELECT z_ AS z)", ""))
def p2_atomic_numbers(spark, sf_dir):
    types = spark.createDataFrame([(k, e, tables.ELEMENTS.index(e) + 1) for k, _, e in TYPES], "type int, element string, z int")
    return atoms(spark, sf_dir).select("type").join(F.broadcast(types), "type").groupBy("element", "z").agg(F.count(F.lit(1)).alias("n"))


TRICLINIC = "array(8e0 + o_orderkey % 3, 0e0, 0e0, o_orderkey % 2 * 1e0, 8e0, 0e0, 0.5e0, o_orderkey % 5 * 0.25e0, 9e0)"


@query("""WITH c AS (SELECT o_orderkey AS k, 8e0 + o_orderkey % 3 AS a, o_orderkey % 2 * 1e0 AS b, o_orderkey % 5 * 0.25e0 AS g FROM orders)
SELECT k AS frame_id, round(a * 8e0 * 9e0, 6) AS volume, round(a * 8e0 * 9e0 / sqrt(72e0 * 72e0 + 9e0 * b * 9e0 * b + (b * g - 8e0 * 0.5e0) * (b * g - 8e0 * 0.5e0)), 6) AS w0,
  round(a * 8e0 * 9e0 / sqrt(9e0 * a * 9e0 * a + a * g * a * g), 6) AS w1, 9e0 AS w2 FROM c""")
def p3_p4_cell_geometry(spark, sf_dir):
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), F.expr(TRICLINIC).alias("cell"))
    return rounded(N.geometry(cells).select("frame_id", F.expr(X.volume(N.CELL)).alias("volume"), *N.WIDTHS))


@query(f"WITH {ATOMS_SQL}, m AS (SELECT frame_id, atom_id, x * 3 - 10 AS x, y - 20 AS y, z + 5 AS z FROM atoms) SELECT frame_id, atom_id, x - 8e0 * floor(x / 8e0) AS x, y - 8e0 * floor(y / 8e0) AS y, z - 8e0 * floor(z / 8e0) AS z FROM m")
def p5_wrap(spark, sf_dir):
    moved = atoms(spark, sf_dir).selectExpr("frame_id", "atom_id", "type", "x * 3e0 - 10e0 AS x", "y - 20e0 AS y", "z + 5e0 AS z")
    return N.bins(moved, frames(spark, sf_dir), RCELL).select("frame_id", "atom_id", "x", "y", "z")


# pairs


PAIR_COLUMNS = ["frame_id", "i", "j", "dx", "dy", "dz", "d"]


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RA)} SELECT {', '.join(PAIR_COLUMNS)} FROM pairs")
def j1_brute_pairs(spark, sf_dir):
    return pairs(spark, sf_dir, RA).select(*PAIR_COLUMNS)


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RCELL)} SELECT {', '.join(PAIR_COLUMNS)} FROM pairs")
def j2_cell_list(spark, sf_dir):
    return N.cell_list_pairs(atoms(spark, sf_dir), frames(spark, sf_dir), RCELL).select(*PAIR_COLUMNS)


SLABS, SLAB_X, SLAB_Y, SLAB_Z, SLAB_RC = 4, 128, 32, 2, 4
SLAB_XYZ = [f"x + 8e0 * (frame_id div {SLABS} % {SLAB_X})", f"y + 8e0 * (frame_id div {SLABS * SLAB_X} % {SLAB_Y})", f"z - {SLAB_Z}e0 * floor(z / {SLAB_Z}e0)"]


def slabs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All atoms in SLABS slabs of 1024 x 256 x 2: their boxes side by side, and thinner than the cutoff."""
    xyz = [F.expr(e).alias(a) for e, a in zip(SLAB_XYZ, "xyz", strict=True)]
    rows = atoms(spark, sf_dir).select((F.col("frame_id") % SLABS).alias("frame_id"), (F.col("frame_id") * 1000 + F.col("atom_id")).alias("atom_id"), "type", *xyz)
    cell = F.array(*[F.lit(float(8 * (SLAB_X if k == 0 else SLAB_Y) if k < 8 else SLAB_Z) if k % 4 == 0 else 0.0) for k in range(9)])
    return rows, rows.select("frame_id").distinct().withColumn("cell", cell)


SLAB_SQL = f"""{ATOMS_SQL.replace("atoms AS (", "lines AS (", 1)}, slab AS (
  SELECT frame_id % {SLABS} AS f, frame_id * 1000 + atom_id AS a, type, {SLAB_XYZ[0].replace("div", "//")} AS x, {SLAB_XYZ[1].replace("div", "//")} AS y, {SLAB_XYZ[2]} AS z FROM lines
), image AS (
  SELECT f, a, type, x + {8 * SLAB_X}e0 * sx AS x, y + {8 * SLAB_Y}e0 * sy AS y, z + {SLAB_Z}e0 * sz AS z
  FROM slab, (SELECT unnest(range(-1, 2)) AS sx), (SELECT unnest(range(-1, 2)) AS sy), (SELECT unnest(range(-3, 4)) AS sz)
  WHERE x + {8 * SLAB_X}e0 * sx BETWEEN -{SLAB_RC}e0 AND {8 * SLAB_X + SLAB_RC}e0 AND y + {8 * SLAB_Y}e0 * sy BETWEEN -{SLAB_RC}e0 AND {8 * SLAB_Y + SLAB_RC}e0
), strip AS (
  SELECT f, a, type, x, y, z, unnest(range(-1, 2)) + CAST(floor(x / {SLAB_RC}e0) AS BIGINT) AS k FROM image
), near AS (
  SELECT s.f, s.a AS i, t.a AS j, s.type AS ti, t.type AS tj, t.x - s.x AS dx, t.y - s.y AS dy, t.z - s.z AS dz
  FROM slab s JOIN strip t ON s.f = t.f AND CAST(floor(s.x / {SLAB_RC}e0) AS BIGINT) = t.k AND t.y BETWEEN s.y - {SLAB_RC}e0 AND s.y + {SLAB_RC}e0
), pairs AS (
  SELECT f AS frame_id, i, j, ti, tj, dx, dy, dz, sqrt(dx * dx + dy * dy + dz * dz) AS d FROM near
  WHERE dx * dx + dy * dy + dz * dz < {SLAB_RC**2}e0 AND dx * dx + dy * dy + dz * dz > 1e-20
), atoms AS (SELECT f AS frame_id, a AS atom_id, type FROM slab)"""


@query(f"WITH {SLAB_SQL} SELECT frame_id, i, count(*) AS n, count(CASE WHEN i = j THEN 1 END) AS n_own, round(sum(d), 6) AS sum_d FROM pairs GROUP BY 1, 2")
def j2_slab(spark, sf_dir):
    def terms(i, j, near, d):
        n = [np.count_nonzero(row) for row in near]
        return np.stack([n, [np.count_nonzero(row) for row in near & (i == j)], d.sum(axis=1) - SLAB_RC * (d.shape[1] - np.array(n))])

    found = on_space(*slabs(spark, sf_dir), float(SLAB_RC), terms, ["n", "n_own", "sum_d"]).where("n > 0")
    return found.select("frame_id", F.col("atom_id").alias("i"), *[F.col(c).cast("long").alias(c) for c in ("n", "n_own")], F.round("sum_d", 6).alias("sum_d"))


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RCELL)} SELECT frame_id, count(*) AS n, round(sum(d), 6) AS sum_d FROM pairs GROUP BY 1")
def j3_strategy(spark, sf_dir):
    found = N.neighbor_pairs(atoms(spark, sf_dir), frames(spark, sf_dir), RCELL, least_atoms=4)
    return rounded(found.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("sum_d")))


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, c AS (SELECT frame_id, i, count(*) AS a, count(CASE WHEN d < 4e0 THEN 1 END) AS b FROM pairs GROUP BY 1, 2) SELECT t.frame_id, t.atom_id, coalesce(a, 0) AS n_radial, coalesce(b, 0) AS n_angular FROM atoms t LEFT JOIN c ON t.frame_id = c.frame_id AND t.atom_id = c.i")
def p6_p7_neighbor_counts(spark, sf_dir):
    return N.neighbor_counts(atoms(spark, sf_dir), pairs(spark, sf_dir, RC), RC, RA)


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, c AS (SELECT frame_id, i, count(*) AS a, count(CASE WHEN d < 4e0 THEN 1 END) AS b FROM pairs GROUP BY 1, 2) SELECT max(a) AS max_radial, max(b) AS max_angular FROM c")
def a11_most_neighbors(spark, sf_dir):
    return N.most_neighbors(N.neighbor_counts(atoms(spark, sf_dir), pairs(spark, sf_dir, RC), RC, RA))


BINS_SQL = f"WITH {ATOMS_SQL}, b AS (SELECT *, CAST(least(floor(x / 8e0 * 3), 2) AS BIGINT) AS ba, CAST(least(floor(y / 8e0 * 3), 2) AS BIGINT) AS bb, CAST(least(floor(z / 8e0 * 3), 2) AS BIGINT) AS bc FROM atoms)"


@query(BINS_SQL + " SELECT frame_id, ba, bb, bc, count(*) AS n FROM b GROUP BY ALL")
def a24_bin_counts(spark, sf_dir):
    return N.bins(atoms(spark, sf_dir), frames(spark, sf_dir), RCELL).groupBy("frame_id", "ba", "bb", "bc").agg(F.count(F.lit(1)).alias("n"))


@query(BINS_SQL + " SELECT frame_id, atom_id, CAST(row_number() OVER (PARTITION BY frame_id, ba, bb, bc ORDER BY atom_id) - 1 AS BIGINT) AS place FROM b")
def w2_rank_in_bin(spark, sf_dir):
    from pyspark.sql import Window

    binned = N.bins(atoms(spark, sf_dir), frames(spark, sf_dir), RCELL)
    return binned.select("frame_id", "atom_id", (F.row_number().over(Window.partitionBy("frame_id", "ba", "bb", "bc").orderBy("atom_id")) - 1).cast("long").alias("place"))


@query(f"WITH {ATOMS_SQL} SELECT frame_id, max(x) - min(x) + 25e0 AS a, max(y) - min(y) + 25e0 AS b, max(z) - min(z) + 25e0 AS c FROM atoms GROUP BY 1")
def p31_vacuum_box(spark, sf_dir):
    return N.vacuum_box(atoms(spark, sf_dir), RC).selectExpr("frame_id", "cell[0] AS a", "cell[4] AS b", "cell[8] AS c")


# radial functions


def basis_sql(rc: float) -> list[str]:
    """f_k by the recurrence written out, T_2 = 2 x^2 - 1, T_3 = 4 x^3 - 3 x."""
    x, fc = f"(2e0 * pow(d / {rc}e0 - 1e0, 2) - 1e0)", f"(0.5e0 * cos(pi() * d / {rc}e0) + 0.5e0)"
    t = ["1e0", x, f"(2e0 * pow({x}, 2) - 1e0)", f"(4e0 * pow({x}, 3) - 3e0 * {x})"]
    return [f"(0.5e0 * ({v} + 1e0) * {fc})" for v in t]


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)} SELECT frame_id, i AS atom_id, {', '.join(r6(f'sum({e})', f'f_{k}') for k, e in enumerate(basis_sql(RC)))} FROM pairs GROUP BY 1, 2")
def p8_radial_basis(spark, sf_dir):
    names = [f"f_{k}" for k in range(BASIS + 1)]
    return rounded(D.pair_sums(atoms(spark, sf_dir), frames(spark, sf_dir), RC, lambda r, d: chebyshev(d, RC, BASIS)[0], names))


def slopes_sql(rc: float) -> list[str]:
    x, fc = f"(2e0 * pow(d / {rc}e0 - 1e0, 2) - 1e0)", f"(0.5e0 * cos(pi() * d / {rc}e0) + 0.5e0)"
    dfc, dx = f"(-0.5e0 * pi() / {rc}e0 * sin(pi() * d / {rc}e0))", f"(4e0 * (d / {rc}e0 - 1e0) / {rc}e0)"
    t = ["1e0", x, f"(2e0 * pow({x}, 2) - 1e0)", f"(4e0 * pow({x}, 3) - 3e0 * {x})"]
    u = ["0e0", "1e0", f"(4e0 * {x})", f"(12e0 * pow({x}, 2) - 3e0)"]
    return [f"(0.5e0 * {b} * {dx} * {fc} + 0.5e0 * ({a} + 1e0) * {dfc})" for a, b in zip(t, u, strict=True)]


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)} SELECT frame_id, i AS atom_id, {', '.join(r6(f'sum({e})', f'df_{k}') for k, e in enumerate(slopes_sql(RC)))} FROM pairs GROUP BY 1, 2")
def p9_basis_slopes(spark, sf_dir):
    names = [f"df_{k}" for k in range(BASIS + 1)]
    return rounded(D.pair_sums(atoms(spark, sf_dir), frames(spark, sf_dir), RC, lambda r, d: chebyshev(d, RC, BASIS)[1], names))


def g_sql(n: int, rc: float, shift: int) -> str:
    return "(" + " + ".join(f"{coefficient_sql(n, k, shift)} * {e}" for k, e in enumerate(basis_sql(rc))) + ")"


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RA)} SELECT frame_id, i, j, dx, dy, dz, {', '.join(r6(g_sql(n, RA, 4), f'g_{n}') for n in range(N_ANGULAR))} FROM pairs")
def p14_j6_contraction(spark, sf_dir):
    return rounded(D.contracted(pairs(spark, sf_dir, RA), C3, RA).select("frame_id", "i", "j", "dx", "dy", "dz", *[f"g_{n}" for n in range(N_ANGULAR)]))


RADIAL_SQL = f"""q AS (SELECT frame_id, i, {', '.join(f'sum({g_sql(n, RC, 0)}) AS q_{n}' for n in range(N_RADIAL))} FROM pairs GROUP BY 1, 2),
r AS (SELECT t.frame_id, t.atom_id, t.type, {', '.join(f'coalesce(q_{n}, 0e0) AS q_{n}' for n in range(N_RADIAL))} FROM atoms t LEFT JOIN q ON t.frame_id = q.frame_id AND t.atom_id = q.i)"""
Q = [f"q_{n}" for n in range(N_RADIAL)]


def radial(spark, sf_dir):
    return D.whole_radial(atoms(spark, sf_dir), frames(spark, sf_dir), C2, RC)


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL} SELECT frame_id, atom_id, {', '.join(r6(q, q) for q in Q)} FROM r")
def a1_a3_radial(spark, sf_dir):
    return rounded(radial(spark, sf_dir).select("frame_id", "atom_id", *Q))


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL}, s AS (SELECT {', '.join(f'1 / greatest(max({q}) - min({q}), 1e-10) AS z_{q}' for q in Q)} FROM r) SELECT frame_id, atom_id, {', '.join(r6(f'{q} * z_{q}', q) for q in Q)} FROM r, s")
def scaled_radial(spark, sf_dir):
    """Flagship: pairs, radial descriptor, zero rows, scaler."""
    q = radial(spark, sf_dir).persist()
    return rounded(D.scaled(q, Q).select("frame_id", "atom_id", *Q))


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL} SELECT frame_id, {', '.join(r6(f'avg({q})', q) for q in Q)} FROM r GROUP BY 1")
def k5_a25_frame_means(spark, sf_dir):
    return rounded(D.frame_means(radial(spark, sf_dir), Q))


# angular functions


def y_sql() -> list[str]:
    """L = 1 to 4 in closed form."""
    x, y, z = "(dx / d)", "(dy / d)", "(dz / d)"
    re = ["1e0", x, f"({x} * {x} - {y} * {y})", f"({x} * {x} * {x} - 3e0 * {x} * {y} * {y})", f"(pow({x}, 4) - 6e0 * {x} * {x} * {y} * {y} + pow({y}, 4))"]
    im = ["0e0", y, f"(2e0 * {x} * {y})", f"(3e0 * {x} * {x} * {y} - {y} * {y} * {y})", f"(4e0 * {x} * {x} * {x} * {y} - 4e0 * {x} * {y} * {y} * {y})"]
    height = {
        1: [z, "1e0"],
        2: [f"(3e0 * {z} * {z} - 1e0)", z, "1e0"],
        3: [f"(5e0 * {z} * {z} * {z} - 3e0 * {z})", f"(5e0 * {z} * {z} - 1e0)", z, "1e0"],
        4: [f"(35e0 * pow({z}, 4) - 30e0 * {z} * {z} + 3e0)", f"(7e0 * {z} * {z} * {z} - 3e0 * {z})", f"(7e0 * {z} * {z} - 1e0)", z, "1e0"],
    }
    out = []
    for order, heights in height.items():
        for m, h in enumerate(heights):
            out += [f"({h} * {re[m]})"] + ([f"({h} * {im[m]})"] if m else [])
        assert len(out) == (order + 1) ** 2 - 1
    return out


N_MOMENTS = len(tables.moments(MAX_L))


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RA)} SELECT frame_id, i AS atom_id, {', '.join(r6(f'sum({e})', f'y_{k}') for k, e in enumerate(y_sql()))} FROM pairs GROUP BY 1, 2")
def p10_p12_angular_basis(spark, sf_dir):
    names = [f"y_{k}" for k in range(N_MOMENTS)]
    return rounded(D.pair_sums(atoms(spark, sf_dir), frames(spark, sf_dir), RA, lambda r, d: tables.moment_values(*(r / d[:, None]).T, MAX_L), names))


MOMENTS_SQL = f"""y AS (SELECT *, {', '.join(f'{g_sql(n, RA, 4)} AS g_{n}' for n in range(N_ANGULAR))}, {', '.join(f'{e} AS y_{k}' for k, e in enumerate(y_sql()))} FROM pairs WHERE d < {RA}e0),
m AS (SELECT frame_id, i, {', '.join(f'sum(g_{n} * y_{k}) AS s_{n}_{k}' for n in range(N_ANGULAR) for k in range(N_MOMENTS))} FROM y GROUP BY 1, 2),
s AS (SELECT t.frame_id, t.atom_id, {', '.join(f'coalesce(s_{n}_{k}, 0e0) AS s_{n}_{k}' for n in range(N_ANGULAR) for k in range(N_MOMENTS))} FROM atoms t LEFT JOIN m ON t.frame_id = m.frame_id AND t.atom_id = m.i)"""


def moments(spark, sf_dir):
    return D.whole_moments(atoms(spark, sf_dir), frames(spark, sf_dir), C3, RA, MAX_L)


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RA)}, {MOMENTS_SQL} SELECT frame_id, atom_id, {', '.join(r6(f's_{n}_{k}', f's_{n}_{k}') for n in range(N_ANGULAR) for k in range(N_MOMENTS))} FROM s")
def a2_moments(spark, sf_dir):
    return rounded_wide(moments(spark, sf_dir).drop("type"))


def three_body_sql(n: int) -> dict[str, str]:
    """The addition theorem's weights: (2L+1)/(4 pi) (L-m)!/(L+m)! times the square of the factor taken out of each polynomial."""
    factor = {(1, 0): 1, (1, 1): 1, (2, 0): 1 / 2, (2, 1): 3, (2, 2): 3, (3, 0): 1 / 2, (3, 1): 3 / 2, (3, 2): 15, (3, 3): 15, (4, 0): 1 / 8, (4, 1): 5 / 2, (4, 2): 15 / 2, (4, 3): 105, (4, 4): 105}
    fact = [1, 1, 2, 6, 24, 120, 720, 5040, 40320]
    out = {}
    for order in range(1, MAX_L + 1):
        k, terms = order**2 - 1, []
        for m in range(order + 1):
            w = (2 * order + 1) / (4 * np.pi) * fact[order - m] / fact[order + m] * factor[order, m] ** 2
            parts = 1 if m == 0 else 2
            terms += [f"{float(w * parts)!r} * pow(s_{n}_{k + p}, 2)" for p in range(parts)]
            k += parts
        out[f"q{order}_{n}"] = "(" + " + ".join(t if "e" in t.split(" ")[0] else t.replace(" ", "e0 ", 1) for t in terms) + ")"
    return out


# The extra channels once more, by another way than the operators': an atom's traceless tensors of rank 1 to 4
# (Cartesian moments of its pairs less their traces), contracted over all their axes. The scale of each contraction
# is the published coefficient of one product of moments over the number that the contraction has before it.

AXES = range(3)
RAW = [(i, j, k) for i in range(5) for j in range(5) for k in range(5) if i + j + k <= 4]


def tensors_sql() -> str:
    """c: sums of g x^i y^j z^k of each atom's pairs; u: tensor components of every atom, zero without pairs."""
    raw = ", ".join(f"sum(g_{n} * pow(dx / d, {i}) * pow(dy / d, {j}) * pow(dz / d, {k})) AS c_{n}_{i}{j}{k}" for n in range(N_ANGULAR) for i, j, k in RAW)
    parts = []
    for n in range(N_ANGULAR):

        def at(*axes: int, n: int = n) -> str:
            return f"c_{n}_" + "".join(str(axes.count(a)) for a in AXES)

        for a, b in ((a, b) for a in AXES for b in AXES if a <= b):
            parts.append((f"t_{n}_{a}{b}", at(a, b) + (f" - {at()} / 3e0" if a == b else "")))
        for a, b, c in ((a, b, c) for a in AXES for b in AXES for c in AXES if a <= b <= c):
            traces = [at(z) for x, y, z in ((a, b, c), (a, c, b), (b, c, a)) if x == y]
            parts.append((f"t_{n}_{a}{b}{c}", at(a, b, c) + "".join(f" - {t} / 5e0" for t in traces)))
        for a, b, c, d in ((a, b, c, d) for a in AXES for b in AXES for c in AXES for d in AXES if a <= b <= c <= d):
            one = [at(z, w) for x, y, z, w in ((a, b, c, d), (a, c, b, d), (a, d, b, c), (b, c, a, d), (b, d, a, c), (c, d, a, b)) if x == y]
            two = sum(x == y and z == w for x, y, z, w in ((a, b, c, d), (a, c, b, d), (a, d, b, c)))
            parts.append((f"t_{n}_{a}{b}{c}{d}", at(a, b, c, d) + "".join(f" - {t} / 7e0" for t in one) + (f" + {two}e0 * {at()} / 35e0" if two else "")))
        parts += [(f"t_{n}_{a}", at(a)) for a in AXES]
    shown = ", ".join(f"coalesce({e}, 0e0) AS {name}" for name, e in parts)
    return f"""c AS (SELECT frame_id, i, {raw} FROM y GROUP BY 1, 2),
u AS (SELECT t.frame_id, t.atom_id, {shown} FROM atoms t LEFT JOIN c ON t.frame_id = c.frame_id AND t.atom_id = c.i)"""


def extra_sql(n: int) -> dict[str, str]:
    def t(*axes: int) -> str:
        return f"t_{n}_" + "".join(map(str, sorted(axes)))

    def total(rank: int, *factors: str) -> str:
        """The sum over axes a, b, c, ... of a product of tensors; a factor names its axes by letters."""
        from itertools import product

        terms = [" * ".join(t(*(axes["abcd".index(x)] for x in f)) for f in factors) for axes in product(AXES, repeat=rank)]
        return "(" + " + ".join(terms) + ")"

    return {
        f"q222_{n}": f"(-0.809943929279723e0 / 3e0 * {total(3, 'ab', 'bc', 'ac')})",
        f"q1111_{n}": f"(0.026596810706114e0 * pow({total(1, 'a', 'a')}, 2))",
        f"q112_{n}": f"(0.164961305093080e0 / 2e0 * {total(2, 'a', 'ab', 'b')})",
        f"q123_{n}": f"(-0.168362926992344e0 * {total(3, 'a', 'bc', 'abc')})",
        f"q233_{n}": f"(0.321473273819474e0 * 2e0 * {total(4, 'ab', 'acd', 'bcd')})",
        f"q134_{n}": f"(0.255161500704030e0 / 75e-2 * {total(4, 'a', 'bcd', 'abcd')})",
    }


MOMENTS_SQL += f",\n{tensors_sql()}"
INVARIANTS_SQL = {k: v for n in range(N_ANGULAR) for k, v in (three_body_sql(n) | extra_sql(n)).items()}


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RA)}, {MOMENTS_SQL} SELECT frame_id, atom_id, {', '.join(r6(e, k) for k, e in INVARIANTS_SQL.items())} FROM s JOIN u USING (frame_id, atom_id)")
def p16_p20_invariants(spark, sf_dir):
    none = np.zeros((NT, NT, 0, 1))
    return rounded_wide(D.whole_descriptors(atoms(spark, sf_dir), frames(spark, sf_dir), none, C3, 0.0, RA, MAX_L, list(tables.CHANNELS)).drop("type"))


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL}, {MOMENTS_SQL} SELECT frame_id, atom_id, {', '.join(r6(q, q) for q in Q)}, {', '.join(r6(e, k) for k, e in INVARIANTS_SQL.items())} FROM r JOIN s USING (frame_id, atom_id) JOIN u USING (frame_id, atom_id)")
def a4_descriptor(spark, sf_dir):
    return rounded_wide(D.whole_descriptors(atoms(spark, sf_dir), frames(spark, sf_dir), C2, C3, RC, RA, MAX_L, list(tables.CHANNELS)).drop("type"))


# net

W = {t: (np.array([[((n * 7 + k * 3 + t) % 11 - 5) / 5 for k in range(N_RADIAL)] for n in range(4)]), np.array([0.1, -0.2, 0.3, 0.0]), np.array([0.5, -1.0, 0.25, 0.75])) for t in range(NT)}
B1 = 0.125


def net_sql() -> str:
    parts = [f"{w} * tanh({' + '.join(f'(((({n * 7 + k * 3}) + type) % 11 - 5) / 5e0) * q_{k}' for k in range(N_RADIAL))} - ({b}))" for n, (w, b) in enumerate(zip(("0.5e0", "(-1e0)", "0.25e0", "0.75e0"), ("0.1e0", "-0.2e0", "0.3e0", "0e0"), strict=True))]
    return f"({' + '.join(parts)} - 0.125e0)"


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL} SELECT frame_id, round(sum({net_sql()}), 6) AS energy FROM r GROUP BY 1")
def p24_a6_net_energy(spark, sf_dir):
    q = radial(spark, sf_dir)
    return rounded(D.net(q, Q, W, B1).groupBy("frame_id").agg(F.sum("energy").alias("energy")))


EMBED = [f"q_{k}" for k in range(64)]


@query(f"WITH e AS (SELECT {', '.join(f'CAST(embedding[{k + 1}] AS DOUBLE) AS q_{k}' for k in range(64))} FROM embeddings) SELECT {', '.join(r6(f'1 / greatest(max({q}) - min({q}), 1e-10)', q) for q in EMBED)} FROM e")
def a12_q_scaler(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(*[F.col("embedding")[k].cast("double").alias(q) for k, q in enumerate(EMBED)])
    return rounded(D.q_scaler(e, EMBED))


# physics


ZBL_NUMBERS = (24, 27, 28)


@query(f"""WITH {ATOMS_SQL}, {pairs_sql(3.0)}, z AS (SELECT *, CASE ti WHEN 0 THEN 24e0 WHEN 1 THEN 27e0 ELSE 28e0 END AS zi, CASE tj WHEN 0 THEN 24e0 WHEN 1 THEN 27e0 ELSE 28e0 END AS zj FROM pairs WHERE d < 2.5e0),
x AS (SELECT *, (pow(zi, 0.23e0) + pow(zj, 0.23e0)) * 2.134563e0 * d AS x, least(greatest((d - 1.25e0) / 1.25e0, 0e0), 1e0) AS t FROM z),
e AS (SELECT frame_id, i, sum(0.5e0 * 14.399645e0 * zi * zj / d * (0.18175e0 * exp(-3.1998e0 * x) + 0.50986e0 * exp(-0.94229e0 * x) + 0.28022e0 * exp(-0.4029e0 * x) + 0.02817e0 * exp(-0.20162e0 * x)) * (0.5e0 * cos(pi() * t) + 0.5e0)) AS zbl FROM x GROUP BY 1, 2)
SELECT a.frame_id, a.atom_id, round(ln(1e0 + coalesce(zbl, 0e0)), 8) AS log_zbl FROM atoms a LEFT JOIN e ON a.frame_id = e.frame_id AND a.atom_id = e.i""")
def a5_p26_zbl(spark, sf_dir):
    """As ln(1 + e): close pairs reach energies of which a double has few digits after the point."""
    e = D.zbl_atoms(atoms(spark, sf_dir), pairs(spark, sf_dir, 3.0), list(ZBL_NUMBERS), 1.25, 2.5)
    return rounded(e.select("frame_id", "atom_id", F.log1p("zbl").alias("log_zbl")), 8)


RADII = {z: tables.COVALENT_RADIUS[z - 1] for z in ZBL_NUMBERS}


@query(f"""WITH {ATOMS_SQL}, {pairs_sql(3.0)}, n(type, z, r) AS (VALUES {', '.join(f'({k}, {z}e0, {r}e0)' for k, (z, r) in enumerate(RADII.items()))}),
o AS (SELECT p.*, a.z AS zi, b.z AS zj, least((a.r + b.r) * 0.65e0, 2.5e0) AS r_out FROM pairs p JOIN n a ON a.type = p.ti JOIN n b ON b.type = p.tj),
x AS (SELECT *, (pow(zi, 0.23e0) + pow(zj, 0.23e0)) * 2.134563e0 * d AS x, d / r_out AS t FROM o WHERE d < r_out),
e AS (SELECT frame_id, i, count(*) AS n, sum(0.5e0 * 14.399645e0 * zi * zj / d * (0.18175e0 * exp(-3.1998e0 * x) + 0.50986e0 * exp(-0.94229e0 * x) + 0.28022e0 * exp(-0.4029e0 * x) + 0.02817e0 * exp(-0.20162e0 * x)) * (0.5e0 * cos(pi() * t) + 0.5e0)) AS zbl FROM x GROUP BY 1, 2)
SELECT a.frame_id, a.atom_id, round(ln(1e0 + coalesce(zbl, 0e0)), 8) AS log_zbl FROM atoms a LEFT JOIN e ON a.frame_id = e.frame_id AND a.atom_id = e.i""")
def p27_zbl_typewise(spark, sf_dir):
    """Repulsion of each atom with the cutoff that its and its neighbor's elements give, from 0 on."""
    e = D.zbl_atoms(atoms(spark, sf_dir), pairs(spark, sf_dir, 3.0), list(ZBL_NUMBERS), 0.0, 2.5, 0.65)
    return rounded(e.select("frame_id", "atom_id", F.log1p("zbl").alias("log_zbl")), 8)


FORCE_SQL = f"""g AS (SELECT *, ({' + '.join(f'{w} * (' + ' + '.join(f'{coefficient_sql(n, k, 0)} * {e}' for k, e in enumerate(slopes_sql(RC))) + ')' for n, w in enumerate(('0.5e0', '(-0.25e0)', '1e0')))}) AS size FROM pairs),
h AS (SELECT frame_id, i, j, dx, dy, dz, size * dx / d AS gx, size * dy / d AS gy, size * dz / d AS gz FROM g),
u AS (SELECT frame_id, i AS atom_id, gx, gy, gz, {', '.join(f'0e0 AS v{k}' for k in range(9))} FROM h UNION ALL SELECT frame_id, j, -gx, -gy, -gz, {', '.join(f'-d{a} * g{b}' for a in 'xyz' for b in 'xyz')} FROM h),
f AS (SELECT frame_id, atom_id, sum(gx) AS fx, sum(gy) AS fy, sum(gz) AS fz, {', '.join(f'sum(v{k}) AS v{k}' for k in range(9))} FROM u GROUP BY 1, 2)"""
FORCE_COLUMNS = ["fx", "fy", "fz", *[f"v{k}" for k in range(9)]]


FORCES = D.radial_forces_by(C2, RC, [0.5, -0.25, 1.0])


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {FORCE_SQL} SELECT t.frame_id, t.atom_id, {', '.join(r6(f'coalesce(f.{c}, 0e0)', c) for c in FORCE_COLUMNS)} FROM atoms t LEFT JOIN f USING (frame_id, atom_id)")
def a7_a8_a10_forces(spark, sf_dir):
    return rounded(on_frames(atoms(spark, sf_dir), frames(spark, sf_dir), RC, FORCES, FORCE_COLUMNS).select("frame_id", "atom_id", *FORCE_COLUMNS))


SIX = ("xx", "yy", "zz", "xy", "yz", "zx")


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {FORCE_SQL}, w AS (SELECT t.frame_id, count(*) AS n, {', '.join(f'sum(coalesce(v{k}, 0e0)) AS v{k}' for k in range(9))} FROM atoms t LEFT JOIN f USING (frame_id, atom_id) GROUP BY 1) SELECT frame_id, {', '.join(r6(f'v{k} / n', f'w_{s}') for k, s in zip(X.VIRIAL_SIX, SIX, strict=True))}, {', '.join(f'round(v{k} / 512e0 * 160.21766208e0, 4) AS s_{s}' for k, s in zip(X.VIRIAL_SIX, SIX, strict=True))}, {', '.join(r6(f'-v{k} / 512e0', f'e_{k}') for k in X.VOIGT_SIX)} FROM w")
def a9_p28_p29_k4_stress(spark, sf_dir):
    per = frame_sums(atoms(spark, sf_dir), frames(spark, sf_dir), RC, FORCES, FORCE_COLUMNS).withColumnRenamed("natoms", "n")
    volume = X.number(512)
    return per.select(
        "frame_id",
        *[F.round(F.col(f"v{k}") / F.col("n"), 6).alias(f"w_{s}") for k, s in zip(X.VIRIAL_SIX, SIX, strict=True)],
        *[F.round(F.expr(X.stress_gpa(f"v{k}", volume)), 4).alias(f"s_{s}") for k, s in zip(X.VIRIAL_SIX, SIX, strict=True)],
        *[F.round(F.expr(X.stress_ev(f"v{k}", volume)), 6).alias(f"e_{k}") for k in X.VOIGT_SIX],
    )


# metrics


def labelled(spark, sf_dir):
    """frames with natoms, a made-up prediction, six virial components for two thirds, volume."""
    sizes = atoms(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("natoms"), F.max(F.col("fx").isNotNull()).alias("has_forces"))
    out = frames(spark, sf_dir).join(sizes, "frame_id").withColumn("e_pred", F.expr("natoms * (frame_id % 7) * 0.5e0"))
    virial = F.array(*[F.expr(f"(frame_id % {k + 3}) * 1e0") for k in range(6)])
    predicted = F.array(*[F.expr(f"(frame_id % {k + 5}) * 0.5e0") for k in range(6)])
    return out.withColumn("virial", F.when(F.expr("frame_id % 3 <> 0"), virial)).withColumn("pv", predicted).withColumn("volume", F.lit(512.0))


LABELLED_SQL = f"WITH {ATOMS_SQL}, {FRAMES_SQL}, l AS (SELECT f.frame_id, f.energy, a.n AS natoms, a.h AS has_forces, a.n * (f.frame_id % 7) * 0.5e0 AS e_pred, f.frame_id % 3 <> 0 AS has_virial FROM frames f JOIN (SELECT frame_id, count(*) AS n, max(fx IS NOT NULL) AS h FROM atoms GROUP BY 1) a USING (frame_id)), r AS (SELECT *, (e_pred - energy) / natoms AS r FROM l)"


STATISTICS = ("x", "y", "z", "fx", "fy", "fz")


@query(
    f"WITH {ATOMS_SQL} "
    + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(min({c})::DOUBLE, 6) AS least, round(max({c})::DOUBLE, 6) AS most, round(fsum({c}::DOUBLE), 6) AS total, round(fsum({c}::DOUBLE * {c}::DOUBLE), 6) AS square, round(1 / greatest(max({c}) - min({c}), 1e-10), 6) AS scaler FROM atoms" for c in STATISTICS)
)
def a27_merged_statistics(spark, sf_dir):
    """Ranges, sums and scalers of atoms' columns, kept by ranges of frames and merged."""
    import uuid

    ranges, a = T.Ranges(f"{shared_dir(spark)}/statistics-{uuid.uuid4().hex}"), atoms(spark, sf_dir)
    for part in range(3):
        ranges.add(f"part{part}", a.where(F.col("frame_id") % 3 == part), list(STATISTICS))
    found = ranges.merged(spark)
    return rounded(found.join(T.scalers(found), "name"))


@query(LABELLED_SQL + " SELECT count(*) AS n_frames, count(energy) AS n_energy, count(CASE WHEN has_forces THEN 1 END) AS n_forces, count(CASE WHEN has_virial THEN 1 END) AS n_virial FROM l")
def a13_coverage(spark, sf_dir):
    return M.coverage(labelled(spark, sf_dir))


@query(LABELLED_SQL + " SELECT round(-avg(energy / natoms), 6) AS b1 FROM l")
def a14_initial_offset(spark, sf_dir):
    return rounded(M.initial_offset(labelled(spark, sf_dir)))


@query(LABELLED_SQL + " SELECT round(avg(r), 6) AS db1 FROM r")
def a15_optimal_offset(spark, sf_dir):
    return rounded(M.offset_change(labelled(spark, sf_dir)))


VIRIAL_SQL = " + ".join(f"pow(((frame_id % {k + 5}) * 0.5e0 - frame_id % {k + 3}) / NORM, 2)" for k in range(6))


@query(
    LABELLED_SQL
    + f", v AS (SELECT ({VIRIAL_SQL.replace('NORM', 'natoms')}) / 6 AS v, ({VIRIAL_SQL.replace('NORM', '512e0')}) / 6 AS s FROM l WHERE has_virial), f AS (SELECT (pow(x - fx, 2) + pow(y - fy, 2) + pow(z - fz, 2)) / 3 AS e FROM atoms)"
    + " SELECT round(sum(r * r), 4) AS se_sum, round(sum(r), 4) AS residual_sum, count(r) AS n_energy, (SELECT round(sum(e), 3) FROM f) AS sf_sum, (SELECT count(e) FROM f) AS n_forces, (SELECT round(sum(v), 4) FROM v) AS sv_sum, (SELECT round(sum(s), 6) FROM v) AS ss_sum, (SELECT count(*) FROM v) AS n_virial FROM r"
)
def a16_error_sums(spark, sf_dir):
    l = labelled(spark, sf_dir)  # noqa: E741
    f = M.force_errors(atoms(spark, sf_dir).selectExpr("x AS px", "y AS py", "z AS pz", "fx", "fy", "fz"))
    e = l.agg(*M.energy_sums(), *M.virial_sums())
    # one row each: columns of one are filled by the other's
    names = [*e.columns, *f.columns]
    both = e.unionByName(f, allowMissingColumns=True)
    out = both.agg(*[F.max(c).alias(c) for c in names])
    digits = {"se_sum": 4, "residual_sum": 4, "sf_sum": 3, "sv_sum": 4, "ss_sum": 6}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


@query(LABELLED_SQL + " SELECT frame_id % 2 AS part, round(greatest(avg(r * r) - avg(r) * avg(r), 0e0), 6) AS train, round(avg(r * r), 6) AS valid, round(0.01e0 * avg(r * r), 6) AS loss, round(sqrt(avg(r * r)) * 160.21766208e0, 3) AS gpa FROM r GROUP BY 1")
def a17_a20_losses(spark, sf_dir):
    l = labelled(spark, sf_dir)  # noqa: E741
    per = l.groupBy((F.col("frame_id") % 2).alias("part")).agg(M.centered_mse().alias("train"), M.plain_mse().alias("valid"))
    none = F.lit(None).cast("double")
    return per.select("part", F.round("train", 6).alias("train"), F.round("valid", 6).alias("valid"), F.round(M.weighted_loss(F.col("valid"), none, none), 6).alias("loss"), F.round(M.rmse_gpa(F.col("valid")), 3).alias("gpa"))


@query(
    LABELLED_SQL
    + f", v AS (SELECT avg(({VIRIAL_SQL.replace('NORM', 'natoms')}) / 6) AS v FROM l WHERE has_virial), f AS (SELECT avg((pow(x - fx, 2) + pow(y - fy, 2) + pow(z - fz, 2)) / 3) AS f FROM atoms WHERE fx IS NOT NULL)"
    + " SELECT round(e, 6) AS mse_e, round(f, 6) AS mse_f, round(v, 6) AS mse_v, round(0.01e0 * e + f + 0.01e0 * v, 6) AS loss, round(0.01e0 * e + 0.01e0 * v, 6) AS without_forces FROM (SELECT avg(r * r) AS e FROM r), f, v"
)
def a19_weighted_loss(spark, sf_dir):
    """All three channels, and the loss when forces have no labels."""
    l = labelled(spark, sf_dir)  # noqa: E741
    f = M.force_errors(atoms(spark, sf_dir).selectExpr("x AS px", "y AS py", "z AS pz", "fx", "fy", "fz"))
    both = l.agg(M.plain_mse().alias("e"), *M.virial_sums()).unionByName(f, allowMissingColumns=True)
    one = both.agg(F.max("e").alias("e"), (F.max("sf_sum") / F.max("n_forces")).alias("f"), (F.max("sv_sum") / F.max("n_virial")).alias("v"))
    loss = M.weighted_loss(F.col("e"), F.col("f"), F.col("v"))
    missing = M.weighted_loss(F.col("e"), F.lit(None).cast("double"), F.col("v"))
    return rounded(one.select(F.col("e").alias("mse_e"), F.col("f").alias("mse_f"), F.col("v").alias("mse_v"), loss.alias("loss"), missing.alias("without_forces")))


# sets, windows, order


@query(f"WITH {ATOMS_SQL} SELECT DISTINCT species FROM atoms")
def a23_distinct_species(spark, sf_dir):
    return atoms(spark, sf_dir).select("species").distinct()


def types(spark):
    return spark.createDataFrame([(k, s) for k, s, _ in TYPES], "type int, symbol string")


TYPES_SQL = f"types(type, symbol) AS (VALUES {', '.join(f'({k}, {chr(39)}{s}{chr(39)})' for k, s, _ in TYPES)})"


@query(f"WITH {ATOMS_SQL}, {TYPES_SQL} SELECT type, symbol FROM types WHERE type IN (SELECT type FROM atoms)")
def j9_present_types(spark, sf_dir):
    return S.present_types(atoms(spark, sf_dir), types(spark))


@query(f"WITH {ATOMS_SQL}, {TYPES_SQL} SELECT type, symbol FROM types WHERE type NOT IN (SELECT type FROM atoms)")
def j10_removed_types(spark, sf_dir):
    return S.removed_types(atoms(spark, sf_dir), types(spark))


@query(f"WITH {ATOMS_SQL}, {FRAMES_SQL} SELECT frame_id, atom_id, x, y, z, energy IS NOT NULL AS has_energy FROM atoms JOIN frames USING (frame_id)")
def j7_frame_flags(spark, sf_dir):
    flags = frames(spark, sf_dir).select("frame_id", F.col("energy").isNotNull().alias("has_energy"))
    return atoms(spark, sf_dir).select("frame_id", "atom_id", "x", "y", "z").join(flags, "frame_id")


@query(LABELLED_SQL + " SELECT frame_id, round(e_pred / natoms, 10) AS pred, round(energy / natoms, 10) AS ref FROM l")
def j8_j11_p30_pred_ref(spark, sf_dir):
    l = labelled(spark, sf_dir)  # noqa: E741
    pred = l.select("frame_id", "natoms", "e_pred")
    return rounded(pred.join(frames(spark, sf_dir), "frame_id").select("frame_id", (F.col("e_pred") / F.col("natoms")).alias("pred"), (F.col("energy") / F.col("natoms")).alias("ref")), 10)


@query(f"WITH {ATOMS_SQL} SELECT species FROM atoms WHERE frame_id % 2 = 0 UNION SELECT species FROM atoms WHERE frame_id % 2 = 1")
def u1_union_species(spark, sf_dir):
    a = atoms(spark, sf_dir).select("frame_id", "species")
    return a.where("frame_id % 2 = 0").select("species").union(a.where("frame_id % 2 = 1").select("species")).distinct()


@query(f"WITH {TYPES_SQL}, {ATOMS_SQL} (SELECT symbol, 'dropped' AS what FROM (SELECT symbol FROM types EXCEPT SELECT species FROM atoms)) UNION ALL (SELECT symbol, 'kept' FROM (SELECT symbol FROM types INTERSECT SELECT species FROM atoms))")
def u2_set_difference(spark, sf_dir):
    own, seen = types(spark).select("symbol"), atoms(spark, sf_dir).select(F.col("species").alias("symbol"))
    return own.subtract(seen).withColumn("what", F.lit("dropped")).union(own.intersect(seen).withColumn("what", F.lit("kept")))


SIZES_SQL = f"WITH {ATOMS_SQL}, n AS (SELECT frame_id, count(*) AS natoms FROM atoms GROUP BY 1)"


@query(SIZES_SQL + " SELECT frame_id, natoms, CAST(coalesce(sum(natoms) OVER (ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM n")
def w1_offsets(spark, sf_dir):
    sizes = atoms(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("natoms"))
    return S.offsets(sizes)


def loss_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").cast("double").alias("loss"))


LOG_SQL = "WITH log AS (SELECT user_id AS run, event_id AS epoch, CAST(value AS DOUBLE) AS loss FROM events)"


@query(LOG_SQL + " SELECT run, epoch, loss, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best FROM log")
def w3_running_best(spark, sf_dir):
    return M.running_best(loss_log(spark, sf_dir))


@query(LOG_SQL + " SELECT run, epoch, loss FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS r FROM log WHERE loss IS NOT NULL) WHERE r = 1")
def o3_best_epoch(spark, sf_dir):
    return M.best_epoch(loss_log(spark, sf_dir).where("loss IS NOT NULL"))


@query(LOG_SQL + " SELECT run, epoch, loss FROM log WHERE epoch <= 500")
def k8_trim_log(spark, sf_dir):
    return M.trimmed_log(loss_log(spark, sf_dir), 500)


@query(f"WITH {ATOMS_SQL} SELECT frame_id, atom_id, species FROM atoms WHERE frame_id >= 100 AND frame_id < 900")
def o1_o4_frame_slice(spark, sf_dir):
    return atoms(spark, sf_dir).where("frame_id >= 100 AND frame_id < 900").select("frame_id", "atom_id", "species").orderBy("frame_id", "atom_id")


@query("WITH h AS (SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY md5('7:' || o_orderkey)) AS r, count(*) OVER () AS n FROM orders) SELECT frame_id, r <= greatest(1, round_even(n * 0.1, 0)) AS valid FROM h")
def v1_holdout_split(spark, sf_dir):
    return S.split(frames(spark, sf_dir).select("frame_id"), 0.1, 7).select("frame_id", "valid")


@query("WITH h AS (SELECT o_orderkey AS frame_id, row_number() OVER (ORDER BY md5('7:3:' || o_orderkey)) - 1 AS r FROM orders) SELECT frame_id, CAST(floor(r / 32) AS BIGINT) AS batch FROM h")
def v2_epoch_batches(spark, sf_dir):
    return S.batches(frames(spark, sf_dir).select("frame_id"), 7, 3, 32)


@query("SELECT o_orderkey AS frame_id, CAST(('0x' || substr(md5('0:' || o_orderkey), 1, 8)) AS BIGINT) % 16 AS shard FROM orders")
def v3_shards(spark, sf_dir):
    return S.shard(frames(spark, sf_dir).select("frame_id"), 16)


# models, files


def small_model():
    import warnings

    from ..model import Model, Shape

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        shape = Shape(("A", "N", "R"), RC, RA, N_RADIAL - 1, N_ANGULAR - 1, BASIS, BASIS, 2, ("222",), 4)
    model = Model.random(shape, 0)
    model.c2, model.c3 = C2, C3
    n, k = np.meshgrid(np.arange(4), np.arange(shape.dim), indexing="ij")
    model.w0 = np.stack([((n * 7 + k * 3 + t) % 11 - 5) / 50.0 for t in range(NT)])
    model.b0, model.w1 = np.tile([0.1, -0.2, 0.3, 0.0], (NT, 1)), np.tile([0.5, -1.0, 0.25, 0.75], (NT, 1))
    model.b1 = B1
    return model


def model_sql() -> str:
    """Energy of an atom for small_model, from r and s."""
    q = [f"q_{n}" for n in range(N_RADIAL)]
    q += [f"({three_body_sql(n)[f'q{order}_{n}']})" for order in (1, 2) for n in range(N_ANGULAR)]
    q += [extra_sql(n)[f"q222_{n}"] for n in range(N_ANGULAR)]
    parts = []
    for n, (w, b) in enumerate(zip(("0.5e0", "(-1e0)", "0.25e0", "0.75e0"), ("0.1e0", "-0.2e0", "0.3e0", "0e0"), strict=True)):
        inner = " + ".join(f"(((({n * 7 + k * 3}) + type) % 11 - 5) / 5e1) * {e}" for k, e in enumerate(q))
        parts.append(f"{w} * tanh({inner} - ({b}))")
    return f"({' + '.join(parts)} - 0.125e0)"


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL}, {MOMENTS_SQL} SELECT frame_id, count(*) AS natoms, round(sum({model_sql()}), 6) AS energy FROM r JOIN s USING (frame_id, atom_id) JOIN u USING (frame_id, atom_id) GROUP BY 1")
def m14_predict(spark, sf_dir):
    """Whole pipeline by the NumPy kernel on Arrow batches of frames."""
    from ..predict import predict_atoms, predict_frames

    per_atom = predict_atoms(atoms(spark, sf_dir), frames(spark, sf_dir), small_model())
    return predict_frames(per_atom, frames(spark, sf_dir)).select("frame_id", "natoms", F.round("e_pred", 6).alias("energy"))


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL}, {MOMENTS_SQL} SELECT frame_id, atom_id, round({model_sql()}, 6) AS energy FROM r JOIN s USING (frame_id, atom_id) JOIN u USING (frame_id, atom_id)")
def m19_predict_large(spark, sf_dir):
    """The same energies by blocks of center atoms, for frames too large for one task."""
    from ..predict import predict_large

    return rounded(predict_large(atoms(spark, sf_dir), frames(spark, sf_dir), small_model()).select("frame_id", "atom_id", "energy"))


def radial_model():
    """small_model without angular terms: its forces can be asked for in SQL."""
    from ..model import Model, Shape

    model = Model.random(Shape(("A", "N", "R"), RC, RA, N_RADIAL - 1, N_ANGULAR - 1, BASIS, BASIS, 0, (), 4), 0)
    n, k = np.meshgrid(np.arange(4), np.arange(N_RADIAL), indexing="ij")
    model.c2, model.w0 = C2, np.stack([((n * 7 + k * 3 + t) % 11 - 5) / 50.0 for t in range(NT)])
    model.b0, model.w1, model.b1 = np.tile([0.1, -0.2, 0.3, 0.0], (NT, 1)), np.tile([0.5, -1.0, 0.25, 0.75], (NT, 1)), B1
    return model


def radial_net_sql() -> tuple[str, list[str]]:
    """Energy of an atom for radial_model from r, and its derivatives by q_0, q_1 and q_2."""
    weight = lambda n, k: f"(((({n * 7 + k * 3}) + type) % 11 - 5) / 5e1)"
    out = list(zip(("0.5e0", "(-1e0)", "0.25e0", "0.75e0"), ("0.1e0", "(-0.2e0)", "0.3e0", "0e0"), strict=True))
    hidden = [f"tanh({' + '.join(f'{weight(n, k)} * q_{k}' for k in range(N_RADIAL))} - {b})" for n, (_, b) in enumerate(out)]
    energy = " + ".join(f"{w} * {h}" for (w, _), h in zip(out, hidden, strict=True)) + " - 0.125e0"
    return f"({energy})", ["(" + " + ".join(f"{w} * (1e0 - pow({h}, 2)) * {weight(n, k)}" for n, ((w, _), h) in enumerate(zip(out, hidden, strict=True))) + ")" for k in range(N_RADIAL)]


RADIAL_NET, RADIAL_NET_SLOPES = radial_net_sql()
MODEL_FORCE_SQL = f"""n AS (SELECT frame_id, atom_id, {RADIAL_NET} AS e, {', '.join(f'{u} AS u_{k}' for k, u in enumerate(RADIAL_NET_SLOPES))} FROM r),
g AS (SELECT p.*, ({' + '.join(f'u_{n} * (' + ' + '.join(f'{coefficient_sql(n, k, 0)} * {e}' for k, e in enumerate(slopes_sql(RC))) + ')' for n in range(N_RADIAL))}) AS size FROM pairs p JOIN n ON p.frame_id = n.frame_id AND p.i = n.atom_id),
""" + FORCE_SQL[FORCE_SQL.index("h AS (") :]


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL}, {MODEL_FORCE_SQL} SELECT n.frame_id, n.atom_id, round(e, 6) AS energy, {', '.join(r6(f'coalesce(f.{c}, 0e0)', c) for c in FORCE_COLUMNS)} FROM n LEFT JOIN f USING (frame_id, atom_id)")
def m19_j4_forces_large(spark, sf_dir):
    """Energies, forces and virials of a model by blocks of center atoms."""
    from ..predict import predict_large

    return rounded(predict_large(atoms(spark, sf_dir), frames(spark, sf_dir), radial_model()).select("frame_id", "atom_id", "energy", *FORCE_COLUMNS))


SLAB_FORCE_SQL = ", ".join(x.replace(f"{RC}e0", f"{float(SLAB_RC)}e0") for x in (RADIAL_SQL, MODEL_FORCE_SQL))


@query(f"WITH {SLAB_SQL}, {SLAB_FORCE_SQL} SELECT n.frame_id, n.atom_id, round(e, 6) AS energy, {', '.join(r6(f'coalesce(f.{c}, 0e0)', c) for c in FORCE_COLUMNS)} FROM n LEFT JOIN f USING (frame_id, atom_id)")
def m19_j4_blocks(spark, sf_dir):
    """Large frames by blocks of space with their halos: energies, forces and virials in slabs of all atoms."""
    from ..predict import predict_blocks

    model = radial_model()
    model.shape = replace(model.shape, cutoff_radial=float(SLAB_RC), cutoff_angular=float(SLAB_RC))
    return rounded(predict_blocks(*slabs(spark, sf_dir), model).select("frame_id", "atom_id", "energy", *FORCE_COLUMNS))


@query(f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL}, {MODEL_FORCE_SQL} SELECT t.frame_id, t.atom_id, {', '.join(r6(f'coalesce(f.f{a}, 0e0)', f'f{a}') for a in 'xyz')}, {', '.join(f'round(CAST(t.f{a} AS DOUBLE), 10) AS rf{a}' for a in 'xyz')} FROM atoms t LEFT JOIN f USING (frame_id, atom_id)")
def k2_force_table(spark, sf_dir):
    """Predicted and reference forces by the kernel over whole frames; a missing reference is null here and nan in the file."""
    from ..predict import force_table, predict_atoms

    a = atoms(spark, sf_dir)
    a = a.withColumnsRenamed({f"f{x}": f"rf{x}" for x in "xyz"})
    table_ = force_table(predict_atoms(a, frames(spark, sf_dir), radial_model(), keep=["rfx", "rfy", "rfz"]))
    refs = [F.when(~F.isnan(f"rf{x}"), F.round(f"rf{x}", 10)).alias(f"rf{x}") for x in "xyz"]
    return table_.select("frame_id", "atom_id", *[F.round(f"f{x}", 6).alias(f"f{x}") for x in "xyz"], *refs)


@query(f"WITH {ATOMS_SQL}, {FRAMES_SQL}, {pairs_sql(RC)}, {RADIAL_SQL}, n AS (SELECT frame_id, avg({RADIAL_NET}) AS pred, count(*) AS natoms FROM r GROUP BY 1) SELECT frame_id, round(pred, 6) AS pred, round(energy / natoms, 10) AS ref FROM n JOIN frames USING (frame_id)")
def k1_energy_table(spark, sf_dir):
    """Predicted and reference energies per atom, by predict_sized, which picks the path by a frame's size."""
    from ..predict import energy_table, predict_frames, predict_sized

    f = frames(spark, sf_dir)
    out = energy_table(predict_frames(predict_sized(atoms(spark, sf_dir), f, radial_model(), tiled_from=7), f), f)
    return out.select("frame_id", F.round("pred", 6).alias("pred"), F.when(~F.isnan("ref"), F.round("ref", 10)).alias("ref"))


ANGULAR_L, ANGULAR_CHANNELS = 2, ("222", "1111", "112")


def angular_model():
    """Radial and angular terms up to L = 2 with three extra channels, and a scaler."""
    import warnings

    from ..model import Model, Shape

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        shape = Shape(("A", "N", "R"), RC, RA, N_RADIAL - 1, N_ANGULAR - 1, BASIS, BASIS, ANGULAR_L, ANGULAR_CHANNELS, 4)
    model = Model.random(shape, 0)
    model.c2, model.c3, model.q_scaler = C2, C3, 0.5 + np.arange(shape.dim) % 3 / 2
    n, k = np.meshgrid(np.arange(4), np.arange(shape.dim), indexing="ij")
    model.w0 = np.stack([((n * 7 + k * 3 + t) % 11 - 5) / 50.0 for t in range(NT)])
    model.b0, model.w1, model.b1 = np.tile([0.1, -0.2, 0.3, 0.0], (NT, 1)), np.tile([0.5, -1.0, 0.25, 0.75], (NT, 1)), B1
    return model


def angular_force_sql() -> str:
    """Energies and forces of angular_model by vectors and tensors: with unit vectors u of an atom's pairs, a = sum g u and
    T = sum g (u u - 1/3); invariants a.a, T:T, tr T^3, (a.a)^2 and a.T.a; A = dE/da, M = dE/dT. A pair then has
    dE/dr = (sum u_n q'_n + sum g' (A.u + u.M.u - tr M / 3)) u + sum g / d (A - (A.u) u + 2 (M u - (u.M.u) u))."""
    axes, both = range(3), [(a, b) for a in range(3) for b in range(a, 3)]
    t = lambda n, a, b: f"t_{n}_{min(a, b)}{max(a, b)}"
    m = lambda n, a, b: f"m_{n}_{min(a, b)}{max(a, b)}"
    add = " + ".join
    inside = lambda e: f"CASE WHEN d < {RA}e0 THEN {e} ELSE 0e0 END"
    slope = lambda n: "(" + add(f"{coefficient_sql(n, k, 4)} * {e}" for k, e in enumerate(slopes_sql(RA))) + ")"
    rise = lambda n: "(" + add(f"{coefficient_sql(n, k, 0)} * {e}" for k, e in enumerate(slopes_sql(RC))) + ")"
    ns, one, two = range(N_ANGULAR), 3 / (4 * np.pi), 15 / (8 * np.pi)
    cubic, quartic, mixed = -0.809943929279723 / 3, 0.026596810706114, 0.164961305093080 / 2
    square = {n: "(" + add(f"a_{n}_{x} * a_{n}_{x}" for x in axes) + ")" for n in ns}
    q = [f"q_{k}" for k in range(N_RADIAL)]
    q += [f"{one!r} * {square[n]}" for n in ns]
    q += [f"{two!r} * (" + add(f"{t(n, x, y)} * {t(n, x, y)}" for x in axes for y in axes) + ")" for n in ns]
    q += [f"{cubic!r} * (" + add(f"{t(n, x, y)} * {t(n, y, z)} * {t(n, z, x)}" for x in axes for y in axes for z in axes) + ")" for n in ns]
    q += [f"{quartic!r} * {square[n]} * {square[n]}" for n in ns]
    q += [f"{mixed!r} * (" + add(f"a_{n}_{x} * {t(n, x, y)} * a_{n}_{y}" for x in axes for y in axes) + ")" for n in ns]
    weight = lambda h, k: f"(((({h * 7 + k * 3}) + type) % 11 - 5) / 5e1 * {0.5 + k % 3 / 2}e0)"
    out = list(zip(("0.5e0", "(-1e0)", "0.25e0", "0.75e0"), ("0.1e0", "(-0.2e0)", "0.3e0", "0e0"), strict=True))
    hidden = ", ".join(f"tanh({add(f'{weight(h, k)} * p_{k}' for k in range(len(q)))} - {b}) AS h_{h}" for h, (_, b) in enumerate(out))
    slopes = ", ".join("(" + add(f"{w} * (1e0 - h_{h} * h_{h}) * {weight(h, k)}" for h, (w, _) in enumerate(out)) + f") AS u_{k}" for k in range(len(q)))
    at = lambda channel, n: f"u_{N_RADIAL + N_ANGULAR * channel + n}"
    on_a = [f"({2 * one!r} * {at(0, n)} + {4 * quartic!r} * {square[n]} * {at(3, n)}) * a_{n}_{x} + {2 * mixed!r} * {at(4, n)} * ({add(f'{t(n, x, y)} * a_{n}_{y}' for y in axes)}) AS b_{n}_{x}" for n in ns for x in axes]
    on_t = [f"{2 * two!r} * {at(1, n)} * {t(n, x, y)} + {3 * cubic!r} * {at(2, n)} * ({add(f'{t(n, x, z)} * {t(n, z, y)}' for z in axes)}) + {mixed!r} * {at(4, n)} * a_{n}_{x} * a_{n}_{y} AS m_{n}_{x}{y}" for n in ns for x, y in both]
    u = ("ux", "uy", "uz")
    turned = [f"({add(f'{m(n, x, y)} * {u[y]}' for y in axes)}) AS mu_{n}_{x}" for n in ns for x in axes]
    line = [f"({add(f'b_{n}_{x} * {u[x]}' for x in axes)}) AS bu_{n}, ({add(f'mu_{n}_{x} * {u[x]}' for x in axes)}) AS uu_{n}" for n in ns]
    size = add([*(f"u_{k} * dq_{k}" for k in range(N_RADIAL)), *(f"dg_{n} * (bu_{n} + uu_{n} - ({add(m(n, x, x) for x in axes)}) / 3e0)" for n in ns)])
    pulled = [f"({size}) * {u[x]} + " + add(f"g_{n} / d * (b_{n}_{x} - bu_{n} * {u[x]} + 2e0 * (mu_{n}_{x} - uu_{n} * {u[x]}))" for n in ns) + f" AS g{'xyz'[x]}" for x in axes]
    return f"""p1 AS (SELECT *, dx / d AS ux, dy / d AS uy, dz / d AS uz, {', '.join(f'{inside(g_sql(n, RA, 4))} AS g_{n}, {inside(slope(n))} AS dg_{n}' for n in ns)}, {', '.join(f'{rise(k)} AS dq_{k}' for k in range(N_RADIAL))} FROM pairs),
m1 AS (SELECT frame_id, i, {', '.join(f'sum(g_{n} * {u[x]}) AS a_{n}_{x}' for n in ns for x in axes)}, {', '.join(f'sum(g_{n} * ({u[x]} * {u[y]}{" - 1e0 / 3e0" if x == y else ""})) AS {t(n, x, y)}' for n in ns for x, y in both)} FROM p1 GROUP BY 1, 2),
v1 AS (SELECT r.*, {', '.join(f'coalesce(a_{n}_{x}, 0e0) AS a_{n}_{x}' for n in ns for x in axes)}, {', '.join(f'coalesce({t(n, x, y)}, 0e0) AS {t(n, x, y)}' for n in ns for x, y in both)} FROM r LEFT JOIN m1 ON r.frame_id = m1.frame_id AND r.atom_id = m1.i),
v2 AS (SELECT *, {', '.join(f'{e} AS p_{k}' for k, e in enumerate(q))} FROM v1),
v3 AS (SELECT *, {hidden} FROM v2),
v4 AS (SELECT *, {add(f'{w} * h_{h}' for h, (w, _) in enumerate(out))} - {B1}e0 AS e, {slopes} FROM v3),
v5 AS (SELECT *, {', '.join(on_a)}, {', '.join(on_t)} FROM v4),
g1 AS (SELECT p1.*, {', '.join(f'u_{k}' for k in range(N_RADIAL))}, {', '.join(f'b_{n}_{x}' for n in ns for x in axes)}, {', '.join(m(n, x, y) for n in ns for x, y in both)} FROM p1 JOIN v5 ON p1.frame_id = v5.frame_id AND p1.i = v5.atom_id),
g2 AS (SELECT *, {', '.join(turned)} FROM g1),
g3 AS (SELECT *, {', '.join(line)} FROM g2),
h AS (SELECT frame_id, i, j, dx, dy, dz, {', '.join(pulled)} FROM g3),
{FORCE_SQL[FORCE_SQL.index("u AS (") :]}"""


ANGULAR_SQL = f"WITH {ATOMS_SQL}, {pairs_sql(RC)}, {RADIAL_SQL}, {angular_force_sql()}"
SHOWN_FORCES = ", ".join(f"round(coalesce(f.{c}, 0e0), 5) AS {c}" for c in FORCE_COLUMNS)


@query(f"{ANGULAR_SQL} SELECT t.frame_id, t.atom_id, {SHOWN_FORCES} FROM atoms t LEFT JOIN f USING (frame_id, atom_id)")
def a10_p13_p22_angular_forces(spark, sf_dir):
    """Forces and virials under a net with angular terms, slopes as columns by the product rule, between two passes of a task over its frames' pairs."""
    m = angular_model()
    weights = {t: (m.w0[t], m.b0[t], m.w1[t]) for t in range(NT)}
    return rounded_wide(D.whole_net_forces(atoms(spark, sf_dir), frames(spark, sf_dir), m.c2, m.c3, RC, RA, ANGULAR_L, list(ANGULAR_CHANNELS), weights, m.q_scaler).drop("type"), 5)


@query(f"{ANGULAR_SQL} SELECT v5.frame_id, v5.atom_id, round(e, 5) AS energy, {SHOWN_FORCES} FROM v5 LEFT JOIN f USING (frame_id, atom_id)")
def m19_angular_forces_large(spark, sf_dir):
    """The same, with energies, by the kernel over blocks of center atoms."""
    from ..predict import predict_large

    return rounded(predict_large(atoms(spark, sf_dir), frames(spark, sf_dir), angular_model()).select("frame_id", "atom_id", "energy", *FORCE_COLUMNS), 5)


@query(
    f"{ANGULAR_SQL}, {FRAMES_SQL}, w AS (SELECT t.frame_id, count(*) AS natoms, {', '.join(f'sum(coalesce(v{k}, 0e0)) AS v{k}' for k in X.VIRIAL_SIX)} FROM atoms t LEFT JOIN f USING (frame_id, atom_id) GROUP BY 1) "
    + "SELECT frame_id, "
    + ", ".join(f"round(v{k} {scale}, 5) AS {name}_{c}, CASE WHEN energy IS NULL THEN -1e6 ELSE round(energy * {k + 1}e0 {scale}, 9) END AS r{name}_{c}" for name, scale in (("w", "/ natoms"), ("s", "/ 512e0 * 160.21766208e0")) for k, c in zip(X.VIRIAL_SIX, SIX, strict=True))
    + " FROM w JOIN frames USING (frame_id)"
)
def k3_k4_predicted_virials(spark, sf_dir):
    """Predicted virials and stresses of the kernel over whole frames, beside references and their sentinel."""
    from ..predict import predict_atoms, predict_frames, virials_and_stresses

    f = frames(spark, sf_dir)
    per = predict_frames(predict_atoms(atoms(spark, sf_dir), f, angular_model()), f)
    refs = f.select("frame_id", F.when(F.col("energy").isNotNull(), F.array(*[F.col("energy") * (k + 1.0) for k in range(9)])).alias("virial"))
    both = virials_and_stresses(per, refs)
    return both.select(*[F.round(c, 9 if c.startswith("r") else 5).alias(c) if t == "double" else F.col(c) for c, t in both.dtypes])


NINE = "(frame_id % 7) * 0.5e0 + {k} * 0.25e0 - natoms"
K3_SQL = ", ".join(
    f"round(CASE WHEN energy IS NULL THEN -1e6 ELSE ({NINE.format(k=k)}) {scale} END, 6) AS {name}_{c}"
    for name, scale in (("w", "/ natoms"), ("s", "/ 512e0 * 160.21766208e0"))
    for k, c in zip(X.VIRIAL_SIX, SIX, strict=True)
)


@query(f"WITH {ATOMS_SQL}, {FRAMES_SQL}, n AS (SELECT frame_id, count(*) AS natoms FROM atoms GROUP BY 1) SELECT frame_id, {K3_SQL} FROM n JOIN frames USING (frame_id)")
def k3_missing_sentinel(spark, sf_dir):
    """Reference virials of the output tables, per atom and as stresses; frames without have the sentinel, unscaled."""
    from ..predict import virial_table

    n = atoms(spark, sf_dir).groupBy("frame_id").agg(F.count(F.lit(1)).alias("natoms"))
    virial = F.when(F.col("energy").isNotNull(), F.array(*[F.expr(NINE.format(k=k)) for k in range(9)]))
    refs = frames(spark, sf_dir).join(n, "frame_id").select("frame_id", virial.alias("virial"))
    none = [F.lit(0.0).alias(f"{t}_{c}") for t in "ws" for c in SIX]
    per = n.select("frame_id", "natoms", F.lit(512.0).alias("volume"), *none)
    both = [virial_table(per, refs, stress).select("frame_id", *[F.col(f"r_{c}").alias(f"{t}_{c}") for c in SIX]) for t, stress in (("w", False), ("s", True))]
    return rounded(both[0].join(both[1], "frame_id"))


@query(f"WITH {ATOMS_SQL} SELECT frame_id, atom_id, species, x, y, z FROM atoms")
def s1_extxyz_round_trip(spark, sf_dir):
    """Every frame written as extended XYZ text and read back."""
    import uuid

    from ..sources import extxyz

    path = f"{shared_dir(spark)}/xyz-{uuid.uuid4().hex}"
    extxyz.write_xyz(atoms(spark, sf_dir).drop("fx", "fy", "fz"), frames(spark, sf_dir), path)
    return extxyz.to_atoms(extxyz.read_blocks(spark, path)).select("frame_id", "atom_id", "species", "x", "y", "z")


@query(f"WITH {ATOMS_SQL} SELECT dense_rank() OVER (ORDER BY frame_id) - 1 AS frame_id, atom_id, species, x, y, z FROM atoms")
def s2_indexed_frames(spark, sf_dir):
    """Every frame written as extended XYZ text and read by the numbers that an index made in tasks gives, in order of frames."""
    from .. import storage
    from ..sources import extxyz

    path, index = storage.new_path(spark, "xyz"), storage.new_path(spark, "index")
    extxyz.write_xyz(atoms(spark, sf_dir).drop("fx", "fy", "fz"), frames(spark, sf_dir), path)
    extxyz.register(spark)
    extxyz.index_xyz(spark, path, index)
    read = spark.read.format("extxyz").option("index", index).load()
    return extxyz.to_atoms(read).select("frame_id", "atom_id", "species", "x", "y", "z")


@query(f"""WITH {ATOMS_SQL}, {FRAMES_SQL}, t AS (SELECT count(DISTINCT species) AS n FROM atoms), m AS (SELECT -avg(energy / n) AS b1 FROM frames JOIN (SELECT frame_id, count(*) AS n FROM atoms GROUP BY 1) USING (frame_id))
SELECT name, CAST(size AS BIGINT) AS n, round(total, 6) AS total FROM (
  SELECT 'w0' AS name, n * 4 * {N_RADIAL + 3 * N_ANGULAR} AS size, NULL::DOUBLE AS total FROM t UNION ALL SELECT 'b0', n * 4, 0e0 FROM t UNION ALL SELECT 'w1', n * 4, NULL FROM t
  UNION ALL SELECT 'b1', 1, b1 FROM m UNION ALL SELECT 'c2', n * n * {N_RADIAL * (BASIS + 1)}, NULL FROM t UNION ALL SELECT 'c3', n * n * {N_ANGULAR * (BASIS + 1)}, NULL FROM t
  UNION ALL SELECT 'q_scaler', {N_RADIAL + 3 * N_ANGULAR}, {N_RADIAL + 3 * N_ANGULAR}e0)""")
def m1_params(spark, sf_dir):
    """A model for the species of the atoms, its offset from the frames' energies: numbers of each kind, and sums of those that are not random."""
    from ..model import Model, Shape

    a, f = atoms(spark, sf_dir), frames(spark, sf_dir)
    species = tuple(sorted(r[0] for r in a.select("species").distinct().collect()))
    model = Model.random(Shape(species, RC, RA, N_RADIAL - 1, N_ANGULAR - 1, BASIS, BASIS, 2, ("222",), 4), 0)
    sizes = a.groupBy("frame_id").agg(F.count(F.lit(1)).alias("natoms"))
    model.b1 = M.initial_offset(f.join(sizes, "frame_id")).first()["b1"]
    known = F.col("name").isin("b0", "b1", "q_scaler")
    return rounded(model.params(spark).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(known, F.col("value"))).alias("total")))
