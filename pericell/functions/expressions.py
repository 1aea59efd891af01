"""SQL text of scalar functions. Numbers are written as doubles: Spark reads 64.0 as a decimal."""

from __future__ import annotations

from . import tables


def number(x: float) -> str:
    text = repr(float(x))
    return f"({text})" if "e" in text else f"({text}e0)"


def power(x: str, n: int) -> str:
    return " * ".join([x] * n) if n else number(1)


def polynomial(coefficients, x: str) -> str:
    return "(" + " + ".join(f"{number(c)} * {power(x, k)}" for k, c in enumerate(coefficients) if c) + ")"


# cells: nine columns or numbers, rows are the lattice vectors


def determinant(c: list[str]) -> str:
    a, b, g = c[:3], c[3:6], c[6:]
    return f"({a[0]} * ({b[1]} * {g[2]} - {b[2]} * {g[1]}) - {a[1]} * ({b[0]} * {g[2]} - {b[2]} * {g[0]}) + {a[2]} * ({b[0]} * {g[1]} - {b[1]} * {g[0]}))"


def cross(u: list[str], v: list[str]) -> list[str]:
    return [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]


def volume(c: list[str]) -> str:
    return f"abs({determinant(c)})"


def inverse(c: list[str]) -> list[str]:
    """Nine entries of the inverse, row by row; its columns are the reciprocal vectors."""
    rows = [c[:3], c[3:6], c[6:]]
    columns = [cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])]
    return [f"({columns[k][i]} / {determinant(c)})" for i in range(3) for k in range(3)]


def widths(c: list[str]) -> list[str]:
    """Distances between lattice planes: 1 / |reciprocal vector|."""
    rows = [c[:3], c[3:6], c[6:]]
    normals = [cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])]
    return [f"({volume(c)} / sqrt({' + '.join(f'{x} * {x}' for x in n)}))" for n in normals]


def fractional(xyz: list[str], inv: list[str]) -> list[str]:
    return [f"({' + '.join(f'{xyz[k]} * {inv[3 * k + i]}' for k in range(3))})" for i in range(3)]


def cartesian(frac: list[str], c: list[str]) -> list[str]:
    return [f"({' + '.join(f'{frac[k]} * {c[3 * k + i]}' for k in range(3))})" for i in range(3)]


# radial functions


def cutoff_function(d: str, rc: float) -> str:
    return f"(0.5e0 * cos(pi() * {d} / {number(rc)}) + 0.5e0)"


def chebyshev(d: str, rc: float, basis: int) -> list[str]:
    """f_0 .. f_basis; ``d`` is a column. T_k by its closed polynomial in x = 2 (d / rc - 1)^2 - 1."""
    x = f"(2e0 * ({d} / {number(rc)} - 1e0) * ({d} / {number(rc)} - 1e0) - 1e0)"
    t: list[list[int]] = [[1], [0, 1]]
    while len(t) <= basis:
        nxt = [0, *(2 * c for c in t[-1])]
        for k, c in enumerate(t[-2]):
            nxt[k] -= c
        t.append(nxt)
    return [f"(0.5e0 * ({polynomial(t[k], x) if k else '1e0'} + 1e0) * {cutoff_function(d, rc)})" for k in range(basis + 1)]


def chebyshev_slopes(d: str, rc: float, basis: int) -> list[str]:
    """Derivatives by d: 0.5 k U_{k-1} x' fc + 0.5 (T_k + 1) fc'."""
    x = f"(2e0 * ({d} / {number(rc)} - 1e0) * ({d} / {number(rc)} - 1e0) - 1e0)"
    t: list[list[int]] = [[1], [0, 1]]
    while len(t) <= basis:
        nxt = [0, *(2 * c for c in t[-1])]
        for k, c in enumerate(t[-2]):
            nxt[k] -= c
        t.append(nxt)
    dx = f"(4e0 * ({d} / {number(rc)} - 1e0) / {number(rc)})"
    fc, dfc = cutoff_function(d, rc), f"(-0.5e0 * pi() / {number(rc)} * sin(pi() * {d} / {number(rc)}))"
    out = []
    for k in range(basis + 1):
        slope = [j * c for j, c in enumerate(t[k])][1:]
        rise = f"0.5e0 * {polynomial(slope, x)} * {dx} * {fc} + " if any(slope) else ""
        out.append(f"({rise}0.5e0 * ({polynomial(t[k], x) if k else '1e0'} + 1e0) * {dfc})")
    return out


# angular functions


def plane_powers(x: str, y: str, n: int) -> list[tuple[str, str]]:
    """Real and imaginary part of (x + iy)^m as polynomials."""
    out = [({(0, 0): 1}, {})]
    for _ in range(n):
        re, im = out[-1]
        new_re: dict[tuple[int, int], int] = {}
        new_im: dict[tuple[int, int], int] = {}
        for source, real, sign in ((re, True, 1), (im, False, 1)):
            for (a, b), c in source.items():
                if real:
                    new_re[a + 1, b] = new_re.get((a + 1, b), 0) + c
                    new_im[a, b + 1] = new_im.get((a, b + 1), 0) + c
                else:
                    new_im[a + 1, b] = new_im.get((a + 1, b), 0) + sign * c
                    new_re[a, b + 1] = new_re.get((a, b + 1), 0) - c
        out.append((new_re, new_im))

    def text(poly: dict[tuple[int, int], int]) -> str:
        terms = [" * ".join([number(c), *[x] * a, *[y] * b]) for (a, b), c in sorted(poly.items()) if c]
        return f"({' + '.join(terms)})" if terms else number(0)

    return [(text(re), text(im)) for re, im in out]


def angular(x: str, y: str, z: str, max_l: int) -> list[str]:
    """Y of every moment for the unit vector (x, y, z)."""
    plane = plane_powers(x, y, max_l)
    return [f"({polynomial(tables.z_factor(order, m)[0], z)} * {plane[m][0 if part == 're' else 1]})" for order, m, part in tables.moments(max_l)]


def angular_slopes(x: str, y: str, z: str, max_l: int) -> list[tuple[str, str, str]]:
    """Derivatives of every moment's polynomial by x, y and z: (x + iy)^m has m (x + iy)^(m-1) and i times that."""
    plane = plane_powers(x, y, max_l)
    out = []
    for order, m, part in tables.moments(max_l):
        height = tables.z_factor(order, m)[0]
        rise = [k * c for k, c in enumerate(height)][1:]
        re, im = plane[m - 1] if m else (number(0), number(0))
        by_x, by_y = (re, f"(-1e0 * {im})") if part == "re" else (im, re)
        up = f"({number(m)} * {polynomial(height, z)})"
        own = plane[m][0 if part == "re" else 1]
        out.append((f"({up} * {by_x})", f"({up} * {by_y})", f"({polynomial(rise, z)} * {own})" if any(rise) else number(0)))
    return out


# invariants of moments; s: the moments' columns in order


def q_three_body(s: list[str], order: int) -> str:
    terms = []
    for k, (own, m, _) in enumerate(tables.moments(order)):
        if own == order:
            terms.append(f"{number((2 if m else 1) * tables.three_body_weight(order, m))} * {s[k]} * {s[k]}")
    return f"({' + '.join(terms)})"


def q_cubic(s: list[str], channel: str) -> str:
    return "(" + " + ".join(f"{number(c)} * {s[i]} * {s[j]} * {s[k]}" for c, (i, j, k) in tables.cubic(channel)) + ")"


def q_1111(s: list[str]) -> str:
    a, b = f"({s[0]} * {s[0]})", f"({s[1]} * {s[1]} + {s[2]} * {s[2]})"
    c = tables.c5b()
    return f"({number(c[0])} * {a} * {a} + {number(c[1])} * {a} * {b} + {number(c[2])} * {b} * {b})"


def q_extra(s: list[str], channel: str) -> str:
    return q_1111(s) if channel == "1111" else q_cubic(s, channel)


def monomials(max_l: int, channels: list[str]) -> list[list[tuple[float, tuple[int, ...]]]]:
    """Each invariant in the model's order, as (coefficient, places of its factors)."""
    out = []
    for order in range(1, max_l + 1):
        own = [(k, m) for k, (o, m, _) in enumerate(tables.moments(max_l)) if o == order]
        out.append([((2 if m else 1) * tables.three_body_weight(order, m), (k, k)) for k, m in own])
    for channel in channels:
        if channel == "1111":
            c, plane = tables.c5b(), ((1, 1), (2, 2))
            out.append([(c[0], (0, 0, 0, 0)), *((c[1], (0, 0, *p)) for p in plane), *((c[2], (*p, *q)) for p in plane for q in plane)])
        else:
            out.append(list(tables.cubic(channel)))
    return out


def pulled_back(s: list[str], slopes: list[str], max_l: int, channels: list[str]) -> list[str]:
    """dE/ds of every moment from dE/dq of every invariant, by the product rule: a monomial gives each of its
    factors the product of the others; like ones are put together."""
    out = []
    found: list[dict[int, dict[tuple[int, ...], float]]] = [{} for _ in s]
    for q, poly in enumerate(monomials(max_l, channels)):
        for c, places in poly:
            for at, p in enumerate(places):
                rest = tuple(sorted((*places[:at], *places[at + 1 :])))
                own = found[p].setdefault(q, {})
                own[rest] = own.get(rest, 0.0) + c
    for own in found:
        sums = [f"{slopes[q]} * ({' + '.join(' * '.join([number(c), *(s[k] for k in rest)]) for rest, c in parts.items())})" for q, parts in own.items()]
        out.append(f"({' + '.join(sums)})" if sums else number(0))
    return out


# screened repulsion


def zbl(d: str, z_i: str, z_j: str, inner: str, outer: str) -> str:
    """Energy of a pair; the caller halves it."""
    x = f"((pow({z_i}, {number(tables.ZBL_POWER)}) + pow({z_j}, {number(tables.ZBL_POWER)})) * {number(tables.ZBL_LENGTH)} * {d})"
    phi = " + ".join(f"{number(p)} * exp({number(-e)} * {x})" for p, e in tables.ZBL_TERMS)
    t = f"least(greatest(({d} - {inner}) / ({outer} - {inner}), 0e0), 1e0)"
    return f"({number(tables.COULOMB)} * {z_i} * {z_j} * ({phi}) / {d} * (0.5e0 * cos(pi() * {t}) + 0.5e0))"


# stress: two conventions with opposite signs, never one function


def stress_gpa(virial: str, vol: str) -> str:
    """Of the output files: + W / V in GPa."""
    return f"({virial} / (CASE WHEN {vol} > 0 THEN {vol} ELSE 1e0 END) * {number(tables.GPA_PER_EV_A3)})"


def stress_ev(virial: str, vol: str) -> str:
    """Of calculators: - W / V in eV per cubic Angstrom."""
    return f"(-{virial} / {vol})"


VIRIAL_SIX = (0, 4, 8, 1, 5, 6)  # xx yy zz xy yz zx of nine, row by row
VOIGT_SIX = (0, 4, 8, 5, 2, 1)  # xx yy zz yz xz xy
