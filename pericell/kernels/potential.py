"""Energies, forces, virials and parameter gradients by NumPy, from pairs.

E_i = w1 . tanh(W0 (q_i scaler) - b0) - b1 (+ screened repulsion). Every pair
has g = dE/dr; F_i += g, F_j -= g and V_j[ab] -= r_a g_b.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from ..functions import tables
from ..functions.expressions import monomials
from ..model import Model
from .pairs import TILE, cloud_tiles, squares


def chebyshev(d: np.ndarray, rc: float, basis: int) -> tuple[np.ndarray, np.ndarray]:
    """f_k and their slopes, [k, pair]."""
    x, dx = 2 * (d / rc - 1) ** 2 - 1, 4 * (d / rc - 1) / rc
    fc, dfc = 0.5 * np.cos(np.pi * d / rc) + 0.5, -0.5 * np.pi / rc * np.sin(np.pi * d / rc)
    t = [np.ones_like(x), x]
    dt = [np.zeros_like(x), np.ones_like(x)]
    while len(t) <= basis:
        dt.append(2 * t[-1] + 2 * x * dt[-1] - dt[-2])
        t.append(2 * x * t[-1] - t[-2])
    t, dt = np.array(t[: basis + 1]), np.array(dt[: basis + 1])
    return 0.5 * (t + 1) * fc, 0.5 * dt * dx * fc + 0.5 * (t + 1) * dfc


def scatter(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of values [..., pair] by index: [..., n]."""
    if not values.size:
        return np.zeros((*values.shape[:-1], n))
    rows = values.reshape(-1, values.shape[-1])
    return np.stack([np.bincount(index, row, n) for row in rows]).reshape(*values.shape[:-1], n)


def contract(c: np.ndarray, ti: np.ndarray, tj: np.ndarray, f: np.ndarray) -> np.ndarray:
    """sum_k c[ti, tj, n, k] f[k, pair]: [n, pair]; one product for each pair of types, zero for types that c does not have."""
    nt, _, n, size = c.shape
    known = (ti >= 0) & (ti < nt) & (tj >= 0) & (tj < nt)
    kind = np.where(known, ti * nt + tj, nt * nt).astype(np.uint16 if nt < 256 else np.int64)
    order = np.argsort(kind, kind="stable")
    edge = np.searchsorted(kind[order], np.arange(nt * nt + 1))
    moved, found = f[:, order], np.zeros((n, len(kind)))
    for of, lo, hi in zip(c.reshape(-1, n, size), edge[:-1], edge[1:], strict=True):
        if lo < hi:
            found[:, lo:hi] = of @ moved[:, lo:hi]
    out = np.empty_like(found)
    out[:, order] = found
    return out


def pair_forces(i: np.ndarray, j: np.ndarray, r: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """F [3, atom] and V [9, atom] from g = dE/dr of pairs: F_i += g, F_j -= g and V_j[ab] -= r_a g_b."""
    f = scatter(i, g.T, n) - scatter(j, g.T, n)
    return f, -scatter(j, np.stack([r[:, a] * g[:, b] for a in range(3) for b in range(3)]), n)


@lru_cache(None)
def terms(l_max: int, channels: tuple[str, ...]) -> list[list[tuple[float, tuple[int, ...]]]]:
    """Each invariant of one n as monomials of moments: (coefficient, places)."""
    return monomials(l_max, list(channels))


def evaluate(polynomials, s: np.ndarray) -> np.ndarray:
    """[invariant, n, atom] from s [n, moment, atom]."""
    out = np.zeros((len(polynomials), s.shape[0], s.shape[2]))
    for q, poly in enumerate(polynomials):
        for c, places in poly:
            value = c * s[:, places[0]]
            for p in places[1:]:
                value = value * s[:, p]
            out[q] += value
    return out


def pull_back(polynomials, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """sum_q weight[q] dq/ds: [n, moment, atom]; every monomial gives each of its factors the product of the others."""
    out = np.zeros_like(s)
    for q, poly in enumerate(polynomials):
        for c, places in poly:
            for at, p in enumerate(places):
                value = c * weight[q]
                for other in (*places[:at], *places[at + 1 :]):
                    value = value * s[:, other]
                out[:, p] += value
    return out


def push_forward_back(polynomials, s: np.ndarray, ds: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Derivative of pull_back along ds: the Hessians of the invariants, weighted, times ds."""
    out = np.zeros_like(s)
    for q, poly in enumerate(polynomials):
        for c, places in poly:
            for at, p in enumerate(places):
                rest = (*places[:at], *places[at + 1 :])
                for k, moved in enumerate(rest):
                    value = c * weight[q] * ds[:, moved]
                    for other in (*rest[:k], *rest[k + 1 :]):
                        value = value * s[:, other]
                    out[:, p] += value
    return out


@dataclass
class Batch:
    """Atoms of frames end to end, and their pairs."""

    type: np.ndarray
    frame: np.ndarray  # of each atom
    i: np.ndarray
    j: np.ndarray
    r: np.ndarray  # pair, 3

    @property
    def n(self) -> int:
        return len(self.type)


class State:
    """Everything of a forward pass that the gradients need again."""

    def __init__(self, model: Model, batch: Batch):
        s = model.shape
        self.model, self.batch = model, batch
        self.d = np.linalg.norm(batch.r, axis=1)
        self.u = batch.r / self.d[:, None]
        self.ti, self.tj = batch.type[batch.i], batch.type[batch.j]
        self.near_r = np.flatnonzero(self.d < s.cutoff_radial)
        self.near_a = np.flatnonzero(self.d < s.cutoff_angular)
        self.fr, self.dfr = chebyshev(self.d[self.near_r], s.cutoff_radial, s.basis_radial)
        self.gr, self.dgr = self._contract(model.c2, self.near_r, self.fr), self._contract(model.c2, self.near_r, self.dfr)
        q = [scatter(batch.i[self.near_r], self.gr, batch.n)]
        if s.l_max:
            self.fa, self.dfa = chebyshev(self.d[self.near_a], s.cutoff_angular, s.basis_angular)
            self.ga, self.dga = self._contract(model.c3, self.near_a, self.fa), self._contract(model.c3, self.near_a, self.dfa)
            unit = self.u[self.near_a].T
            self.y, grad = tables.moment_values(*unit, s.l_max), tables.moment_gradients(*unit, s.l_max)
            # of the polynomial taken on the unit sphere, by r
            self.dy = (grad - unit * np.einsum("kap,ap->kp", grad, unit)[:, None]) / self.d[self.near_a]
            self.s = scatter(batch.i[self.near_a], self.ga[:, None] * self.y, batch.n)
            self.polynomials = terms(s.l_max, s.channels)
            q.append(evaluate(self.polynomials, self.s).reshape(-1, batch.n))
        self.q = np.concatenate(q)  # dim, atom
        self.x = self.q * model.q_scaler[:, None]
        self.h = np.empty((s.neuron, batch.n))
        for t in range(len(s.types)):
            own = batch.type == t
            self.h[:, own] = np.tanh(model.w0[t] @ self.x[:, own] - model.b0[t][:, None])
        self.energy = np.einsum("an,na->a", model.w1[batch.type], self.h) - model.b1
        self.zbl, self.zbl_slope = self._zbl()

    def _contract(self, c: np.ndarray, near: np.ndarray, f: np.ndarray) -> np.ndarray:
        return contract(c, self.ti[near], self.tj[near], f)

    def _zbl(self) -> tuple[np.ndarray, np.ndarray]:
        s = self.model.shape
        if not s.zbl:
            return np.zeros(self.batch.n), np.zeros(0)
        near, z = self.near_a, np.array(s.numbers, float)
        zi, zj, d = z[self.ti[near]], z[self.tj[near]], self.d[near]
        inner, outer = np.full(len(near), s.zbl[0]), np.full(len(near), s.zbl[1])
        if s.zbl_factor:
            radius = np.array([tables.COVALENT_RADIUS[k - 1] for k in s.numbers])
            outer = np.minimum((radius[self.ti[near]] + radius[self.tj[near]]) * s.zbl_factor, s.zbl[1])
            inner = np.zeros(len(near))
        a = (zi**tables.ZBL_POWER + zj**tables.ZBL_POWER) * tables.ZBL_LENGTH
        phi = sum(p * np.exp(-e * a * d) for p, e in tables.ZBL_TERMS)
        dphi = sum(-p * e * a * np.exp(-e * a * d) for p, e in tables.ZBL_TERMS)
        t = (d - inner) / (outer - inner)
        inside = (t > 0) & (t < 1)
        fc = 0.5 * np.cos(np.pi * np.clip(t, 0, 1)) + 0.5
        dfc = np.where(inside, -0.5 * np.pi * np.sin(np.pi * np.clip(t, 0, 1)) / (outer - inner), 0)
        k = tables.COULOMB * zi * zj
        e, de = k * phi / d * fc, k * ((dphi / d - phi / d**2) * fc + phi / d * dfc)
        return scatter(self.batch.i[near], 0.5 * e, self.batch.n), 0.5 * de

    def slopes(self) -> np.ndarray:
        """dE/dq, scaler included: [dim, atom]."""
        m = self.model
        inner = m.w1[self.batch.type].T * (1 - self.h**2)
        out = np.empty_like(self.q)
        for t in range(len(m.shape.types)):
            own = self.batch.type == t
            out[:, own] = m.w0[t].T @ inner[:, own]
        return out * m.q_scaler[:, None]

    def pair_gradients(self, parts: bool = False):
        """g = dE/dr of every pair; with ``parts`` of the net and the repulsion apart."""
        s, b = self.model.shape, self.batch
        fp = self.slopes()
        n_r = s.n_max_radial + 1
        g = np.zeros_like(b.r)
        size = (fp[:n_r, b.i[self.near_r]] * self.dgr).sum(0)
        g[self.near_r] += size[:, None] * self.u[self.near_r]
        if s.l_max:
            w = pull_back(self.polynomials, self.s, fp[n_r:].reshape(len(self.polynomials), -1, b.n))[:, :, b.i[self.near_a]]
            along = np.einsum("nkp,np,kp->p", w, self.dga, self.y)
            across = np.einsum("nkp,np,kap->pa", w, self.ga, self.dy)
            g[self.near_a] += along[:, None] * self.u[self.near_a] + across
        z = np.zeros_like(b.r)
        if s.zbl:
            z[self.near_a] += self.zbl_slope[:, None] * self.u[self.near_a]
        return (g, z) if parts else g + z

    def forces(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """F [atom, 3] and V [atom, 9]."""
        b = self.batch
        f, v = pair_forces(b.i, b.j, b.r, g, b.n)
        return f.T, v.T

    def gradient(self, on_energy: np.ndarray, on_force: np.ndarray, on_virial: np.ndarray) -> dict[str, np.ndarray]:
        """Of a loss by parameters, given its derivatives by atom energies [atom], forces [atom, 3] and
        the virial of each atom's frame [atom, 9].

        sum(A . F) + sum(B : V) = sum over pairs of u . g with u = A_i - A_j - B^T r, the derivative
        of the energy along u. So one forward derivative along u and one reverse pass are enough.
        """
        m, s, b = self.model, self.model.shape, self.batch
        n_r, n_types = s.n_max_radial + 1, len(s.types)
        turn = on_virial[b.j].reshape(-1, 3, 3)
        u = on_force[b.i] - on_force[b.j] - np.einsum("pab,pa->pb", turn, b.r)
        along = (u * self.u).sum(1)
        # descriptors along u
        dq = [scatter(b.i[self.near_r], self.dgr * along[self.near_r], b.n)]
        if s.l_max:
            near = self.near_a
            dy = np.einsum("kap,pa->kp", self.dy, u[near])
            ds = scatter(b.i[near], self.dga[:, None] * along[near] * self.y + self.ga[:, None] * dy, b.n)
            slope = np.zeros((len(self.polynomials), *ds[:, 0].shape))
            for q, poly in enumerate(self.polynomials):
                slope[q] = (pull_back([poly], self.s, np.ones((1, *ds[:, 0].shape))) * ds).sum(1)
            dq.append(slope.reshape(-1, b.n))
        dx = np.concatenate(dq) * m.q_scaler[:, None]
        out = {k: np.zeros_like(np.asarray(getattr(m, k), float)) for k in m.NAMES}
        on_x, on_dx = np.empty_like(self.x), np.empty_like(self.x)
        for t in range(n_types):
            own = b.type == t
            x, h, moved, e = self.x[:, own], self.h[:, own], dx[:, own], on_energy[own]
            w0, w1 = m.w0[t], m.w1[t][:, None]
            da = w0 @ moved
            slope = 1 - h**2
            # value: e * w1.h + w1.(slope * da)
            on_a = w1 * (slope * e - 2 * h * slope * da)
            on_da = w1 * slope
            out["w1"][t] = (h * e + slope * da).sum(1)
            out["b0"][t] = -on_a.sum(1)
            out["w0"][t] = on_a @ x.T + on_da @ moved.T
            on_x[:, own], on_dx[:, own] = w0.T @ on_a, w0.T @ on_da
        out["b1"] = np.array(-on_energy.sum())
        on_q, on_dq = on_x * m.q_scaler[:, None], on_dx * m.q_scaler[:, None]
        i = b.i[self.near_r]
        self._to_coefficients(out["c2"], self.near_r, on_q[:n_r, i], self.fr, on_dq[:n_r, i] * along[self.near_r], self.dfr)
        if s.l_max:
            size = (len(self.polynomials), -1, b.n)
            a, c = on_q[n_r:].reshape(size), on_dq[n_r:].reshape(size)
            on_s = pull_back(self.polynomials, self.s, a) + push_forward_back(self.polynomials, self.s, ds, c)
            on_ds = pull_back(self.polynomials, self.s, c)
            i = b.i[near]
            on_g = np.einsum("nkp,kp->np", on_s[:, :, i], self.y) + np.einsum("nkp,kp->np", on_ds[:, :, i], dy)
            on_dg = np.einsum("nkp,kp->np", on_ds[:, :, i], self.y) * along[near]
            self._to_coefficients(out["c3"], near, on_g, self.fa, on_dg, self.dfa)
        return out

    def _to_coefficients(self, out, near, on_g, f, on_dg, df) -> None:
        for a in range(out.shape[0]):
            for b in range(out.shape[1]):
                own = (self.ti[near] == a) & (self.tj[near] == b)
                if own.any():
                    out[a, b] += on_g[:, own] @ f[:, own].T + on_dg[:, own] @ df[:, own].T


def compute(model: Model, batch: Batch, components: bool = False) -> dict[str, np.ndarray]:
    """energy [atom], forces [atom, 3], virial [atom, 9], descriptor [atom, dim]; with ``components`` net and repulsion apart too."""
    state = State(model, batch)
    net, zbl = state.pair_gradients(parts=True)
    f, v = state.forces(net + zbl)
    out = {"energy": state.energy + state.zbl, "forces": f, "virial": v, "descriptor": state.x.T}
    if components:
        for name, e, g in (("net", state.energy, net), ("zbl", state.zbl, zbl)):
            out[f"energy_{name}"] = e
            out[f"forces_{name}"], out[f"virial_{name}"] = state.forces(g)
    return out


#: Multiplications of a product of matrices, which BLAS leaves to one thread.
PRODUCT = 250_000


def is_radial(model: Model) -> bool:
    """Whether radial_cloud knows all terms: none by angles, no repulsion, polynomials of a degree that powers can take."""
    return not model.shape.l_max and not model.shape.zbl and 1 <= model.shape.basis_radial <= 8


def radial_cloud(model: Model, kind: np.ndarray, xyz: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """energy and scaled descriptor [dim, atom] of some centers (a mask) in open space, and what their pairs give to forces and
    virials of all points, [12, atom], as compute does. By dense matrices of neighboring centers with the points around them.

    Forces are along the pairs here, so with g = a r they are products of the matrix of a with coordinates and their squares.
    Functions are polynomials in u = (d / rc - 1)^2 times the cutoff's, whose cosine and sine are those of a tangent, which NumPy
    takes for many numbers at a time.
    """
    s, n_types, degree = model.shape, len(model.shape.types), model.shape.basis_radial
    rc = s.cutoff_radial
    energy, shares, scaled = np.zeros(len(kind)), np.zeros((len(kind), 9)), np.zeros((s.n_max_radial + 1, len(kind)))
    small = kind.astype(np.int16)  # sorted by digits
    powers = np.zeros((degree + 1, degree + 1))  # (T_k(2 u - 1) + 1) / 2 by powers of u
    for k in range(degree + 1):
        found = np.polynomial.Chebyshev.basis(k, domain=[0, 1]).convert(kind=np.polynomial.Polynomial).coef
        powers[k, : len(found)] = found / 2
    powers[:, 0] += 0.5
    for rows, cols in cloud_tiles(xyz, center, rc):
        cols = cols[np.argsort(small[cols], kind="stable")]
        edge = np.searchsorted(small[cols], np.arange(n_types + 1))
        first = edge[:-1][edge[:-1] < edge[1:]]
        parts = [(t, slice(lo, hi)) for t, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if lo < hi]
        one, two = (np.ascontiguousarray(xyz[x].T) for x in (rows, cols))
        a = np.empty((len(rows), len(cols)))
        mine, w0, w1, b0 = model.c2[kind[rows]] @ powers, model.w0[kind[rows]], model.w1[kind[rows]], model.b0[kind[rows]]
        spare = np.empty((5, max(1, TILE // len(cols)), len(cols)))
        for at, d in squares(one, two, rc):
            own = rows[at]
            w, u, fc, y, v = spare[:, : len(own)]
            np.sqrt(d, out=d)
            np.multiply(d, np.pi / 4 / rc, out=w)
            np.multiply(d, 1 / rc, out=y)
            np.subtract(y, 1, out=y)
            np.tan(w, out=w)
            np.multiply(w, w, out=u)
            np.subtract(1, u, out=fc)
            u += 1
            fc /= u  # cos(pi d / 2 rc)
            w /= u  # half of its sine
            w *= fc
            fc *= fc
            np.multiply(y, y, out=u)
            moments = np.zeros((degree + 1, n_types, len(own)))  # sums of u^k fc
            now = fc
            for k in range(degree + 1):
                if k:
                    now = np.multiply(now, u, out=v)
                moments[k, [t for t, _ in parts]] = np.add.reduceat(now, first, axis=1).T
            q = np.einsum("atnk,kta->na", mine[at], moments) * model.q_scaler[:, None]
            hidden = np.tanh(np.einsum("and,da->an", w0[at], q) - b0[at])
            energy[own], scaled[:, own] = (w1[at] * hidden).sum(axis=1) - model.b1, q
            down = np.einsum("an,and->ad", w1[at] * (1 - hidden**2), w0[at]) * model.q_scaler
            value = np.einsum("an,atnk->tka", down, mine[at])[..., None]
            fc *= y
            # p(u) and p'(u) by Horner's rule for each type; a d = p' 2 y / rc fc - p pi / rc sin cos
            for t, part in parts:
                z, p, dp, c = u[:, part], v[:, part], y[:, part], value[t]
                np.multiply(z, c[degree] * (-2 * np.pi / rc), out=p)
                for k in range(degree - 1, 0, -1):
                    p += c[k] * (-2 * np.pi / rc)
                    p *= z
                p += c[0] * (-2 * np.pi / rc)
                dp[:] = c[degree] * (2 * degree / rc)
                for k in range(degree - 1, 0, -1):
                    dp *= z
                    dp += c[k] * (2 * k / rc)
            v *= w
            y *= fc
            y += v
            np.divide(y, d, out=a[at])
        one, two = one - xyz[rows[0]][:, None], two - xyz[rows[0]][:, None]
        left = np.stack([*one, np.ones(len(rows)), *(one[m] * one[n] for m in range(3) for n in range(m, 3))])
        right = np.stack([*two, np.ones(len(cols))], axis=1)
        sums, step = np.zeros((len(rows), 4)), max(1, PRODUCT // (10 * len(rows)))
        given = np.empty((10, len(cols)))
        for lo in range(0, len(cols), step):
            sums += a[:, lo : lo + step] @ right[lo : lo + step]
            given[:, lo : lo + step] = left @ a[:, lo : lo + step]
        shares[rows, :3] += sums[:, :3] - one.T * sums[:, 3:]
        square = [two[m] * (two[n] * given[3] - given[n]) - two[n] * given[m] for m in range(3) for n in range(m, 3)]
        shares[cols] -= np.concatenate([two * given[3] - given[:3], square + given[4:]]).T
    return energy, scaled, shares[:, [0, 1, 2, 3, 4, 5, 4, 6, 7, 5, 7, 8]].T
