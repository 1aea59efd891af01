"""Constants of the descriptors, derived where a rule gives them."""

from __future__ import annotations

from functools import lru_cache
from itertools import product
from math import factorial, gcd, pi

import numpy as np

# Unit constants and the universal screened repulsion (public physical data).
COULOMB = 14.399645
GPA_PER_EV_A3 = 160.21766208
ZBL_TERMS = ((0.18175, 3.1998), (0.50986, 0.94229), (0.28022, 0.4029), (0.02817, 0.20162))
ZBL_LENGTH, ZBL_POWER = 2.134563, 0.23
MISSING_VIRIAL = -1e6

# Element symbols by atomic number.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

# Covalent radii in Angstrom by atomic number (dispersion-correction radii times 4/3 up to 94, single-bond radii above).
COVALENT_RADIUS = (
    0.426667, 0.613333, 1.6, 1.25333, 1.02667, 1.0, 0.946667, 0.84, 0.853333, 0.893333, 1.86667, 1.66667, 1.50667, 1.38667, 1.46667, 1.36, 1.32, 1.28,
    2.34667, 2.05333, 1.77333, 1.62667, 1.61333, 1.46667, 1.42667, 1.38667, 1.33333, 1.32, 1.34667, 1.45333, 1.49333, 1.45333, 1.53333, 1.46667, 1.52, 1.56,
    2.52, 2.22667, 1.96, 1.85333, 1.76, 1.65333, 1.53333, 1.50667, 1.50667, 1.44, 1.53333, 1.64, 1.70667, 1.68, 1.68, 1.64, 1.76, 1.74667,
    2.78667, 2.34667, 2.16, 1.96, 2.10667, 2.09333, 2.08, 2.06667, 2.01333, 2.02667, 2.01333, 2.0, 1.98667, 1.98667, 1.97333, 2.04, 1.94667,
    1.82667, 1.74667, 1.64, 1.57333, 1.54667, 1.48, 1.49333, 1.50667, 1.76, 1.73333, 1.73333, 1.81333, 1.74667, 1.84, 1.89333,
    2.68, 2.41333, 2.22667, 2.10667, 2.02667, 2.04, 2.05333, 2.06667, 1.80, 1.69, 1.68, 1.68, 1.65, 1.67, 1.73, 1.76, 1.61,
    1.57, 1.49, 1.43, 1.41, 1.34, 1.29, 1.28, 1.21, 1.22, 1.36, 1.43, 1.62, 1.75, 1.65, 1.57,
)

# The scale of each cubic invariant, as the coefficient of one of its monomials in moments.
CUBIC_SCALE = {
    "222": ((4, 5, 7), -0.809943929279723),
    "112": ((0, 1, 4), 0.164961305093080),
    "123": ((2, 4, 12), -0.168362926992344),
    "233": ((4, 12, 14), 0.321473273819474),
    "134": ((1, 11, 20), 0.255161500704030),
}
CHANNELS = ("222", "1111", "112", "123", "233", "134")
MAX_L = 8


def legendre(order: int) -> list[float]:
    """Coefficients of the Legendre polynomial, lowest power first, times 2**order (integers)."""
    out = [0] * (order + 1)
    for k in range(order // 2 + 1):
        out[order - 2 * k] = (-1) ** k * factorial(2 * order - 2 * k) // (factorial(k) * factorial(order - k) * factorial(order - 2 * k))
    return out


@lru_cache(None)
def z_factor(order: int, m: int) -> tuple[tuple[int, ...], float]:
    """The m-th derivative of P_L as a primitive integer polynomial in z, and the factor removed."""
    poly = legendre(order)
    for _ in range(m):
        poly = [k * c for k, c in enumerate(poly)][1:]
    common = gcd(*poly)
    return tuple(c // common for c in poly), common / 2**order


@lru_cache(None)
def three_body_weight(order: int, m: int) -> float:
    return (2 * order + 1) / (4 * pi) * factorial(order - m) / factorial(order + m) * z_factor(order, m)[1] ** 2


def moments(max_l: int) -> list[tuple[int, int, str]]:
    """(L, m, part) of each moment in order: m = 0 first, then real and imaginary parts."""
    if not 0 <= max_l <= MAX_L:
        raise ValueError(f"L must be at most {MAX_L}")
    return [(order, m, part) for order in range(1, max_l + 1) for m in range(order + 1) for part in (("re",) if m == 0 else ("re", "im"))]


def moment_values(x: np.ndarray, y: np.ndarray, z: np.ndarray, max_l: int) -> np.ndarray:
    """[moment, ...] of unit vectors."""
    plane = [np.ones_like(x) + 0j]
    for _ in range(max_l):
        plane.append(plane[-1] * (x + 1j * y))
    out = []
    for order, m, part in moments(max_l):
        height = np.polynomial.polynomial.polyval(z, np.array(z_factor(order, m)[0], float))
        out.append(height * (plane[m].real if part == "re" else plane[m].imag))
    return np.array(out)


def moment_gradients(x: np.ndarray, y: np.ndarray, z: np.ndarray, max_l: int) -> np.ndarray:
    """[moment, 3, ...]: derivatives of the polynomials by x, y and z."""
    plane = [np.ones_like(x) + 0j]
    for _ in range(max_l):
        plane.append(plane[-1] * (x + 1j * y))
    out = []
    for order, m, part in moments(max_l):
        coefficients = np.array(z_factor(order, m)[0], float)
        height = np.polynomial.polynomial.polyval(z, coefficients)
        slope = np.polynomial.polynomial.polyval(z, np.polynomial.polynomial.polyder(coefficients)) if len(coefficients) > 1 else np.zeros_like(z)
        dx = m * plane[m - 1] if m else np.zeros_like(plane[0])
        pick = (lambda v: v.real) if part == "re" else (lambda v: v.imag)
        out.append([height * pick(dx), height * pick(1j * dx), slope * pick(plane[m])])
    return np.array(out)


def c5b() -> tuple[float, float, float]:
    base = three_body_weight(1, 0) ** 2 * 7 / 15
    return base, 2 * base, base


@lru_cache(None)
def cubic(channel: str) -> tuple[tuple[float, tuple[int, int, int]], ...]:
    """Terms of the cubic invariant that couples the L's named by ``channel``: the one rotation-invariant
    combination of monomials with one factor from each L, found as a null space over random rotations."""
    orders = [int(c) for c in channel]
    own = {order: list(range(order**2 - 1, (order + 1) ** 2 - 1)) for order in orders}
    monomials = sorted({tuple(sorted(t)) for t in product(*(own[o] for o in orders))})
    rng = np.random.default_rng(20)
    rows = []
    while len(rows) < 2 * len(monomials):
        points = rng.normal(size=(6, 3))
        weights = rng.normal(size=6)
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        turn *= np.sign(np.linalg.det(turn))
        both = []
        for p in (points, points @ turn):
            unit = p / np.linalg.norm(p, axis=1, keepdims=True)
            s = moment_values(*unit.T, max(orders)) @ weights
            both.append([s[a] * s[b] * s[c] for a, b, c in monomials])
        rows.append(np.subtract(*both))
    values, vectors = np.linalg.svd(np.array(rows))[1:]
    assert values[-1] < 1e-9 < values[-2], "the invariant is unique"
    anchor, scale = CUBIC_SCALE[channel]
    found = vectors[-1] * (scale / vectors[-1][monomials.index(anchor)])
    return tuple((float(c), t) for c, t in zip(found, monomials, strict=True) if abs(c) > 1e-9 * abs(scale))


def channel_names(flags: dict[str, bool]) -> list[str]:
    return [c for c in CHANNELS if flags.get(c)]


def zbl_outer(z_i: int, z_j: int, factor: float, outer: float) -> float:
    return min((COVALENT_RADIUS[z_i - 1] + COVALENT_RADIUS[z_j - 1]) * factor, outer)

