"""Directed pairs of one periodic frame by NumPy: bounded shifts per pair, or bins for large frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

NEAREST = 1e-10


def frame_pairs(xyz: np.ndarray, cell: np.ndarray, cutoff: float, binned_from: int = 400, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j and r = r_j(image) - r_i of all pairs closer than the cutoff, in order of i, j. ``of``: the centers i to look at; else all."""
    n = len(xyz)
    cell = np.asarray(cell, float).reshape(3, 3)
    if not n:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3))
    inverse = np.linalg.inv(cell)
    width = 1 / np.linalg.norm(inverse, axis=0)
    frac = xyz @ inverse
    whole = np.floor(frac)
    frac, home = frac - whole, xyz - whole @ cell
    bins = np.maximum(np.floor(width / cutoff).astype(int), 1)
    reach = np.where(width >= cutoff, 1, np.ceil(cutoff / width).astype(int))
    if n >= binned_from and bins.prod() > (2 * reach + 1).prod() // 2:
        i, j, r = _binned(home, frac, cell, bins, reach, cutoff, np.arange(n) if of is None else of)
    else:
        i, j, r = _brute(home, cell, np.ceil(cutoff / width).astype(int), cutoff)
        if of is not None:
            mine = np.isin(i, of)
            i, j, r = i[mine], j[mine], r[mine]
    d = np.linalg.norm(r, axis=1)
    near = (d < cutoff) & (d > NEAREST)
    i, j, r = i[near], j[near], r[near]
    order = np.lexsort((r[:, 2], r[:, 1], r[:, 0], j, i))
    return i[order], j[order], r[order]


def cloud_pairs(xyz: np.ndarray, center: np.ndarray, cutoff: float, binned_from: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As frame_pairs for points in open space, with the pairs of some centers (a mask) alone."""
    xyz = xyz - xyz.min(axis=0)
    if len(xyz) < binned_from:
        own = np.flatnonzero(center)
        r = xyz[None] - xyz[own, None]
        square = np.einsum("ija,ija->ij", r, r)
        i, j = np.nonzero((square < cutoff * cutoff) & (square > NEAREST * NEAREST))
        return own[i], j, r[i, j]
    box = np.diag(np.ptp(xyz, axis=0) + 2 * cutoff)  # nothing lies across its edges
    return frame_pairs(xyz, box, cutoff, binned_from, np.flatnonzero(center))


def _brute(home: np.ndarray, cell: np.ndarray, reach: np.ndarray, cutoff: float):
    n, out = len(home), []
    shifts = np.stack(np.meshgrid(*[np.arange(-k, k + 1) for k in reach], indexing="ij"), -1).reshape(-1, 3) @ cell
    block = max(1, 2_000_000 // max(1, n * len(shifts)))
    for lo in range(0, n, block):
        r = home[None, :, None] - home[lo : lo + block, None, None] + shifts
        a, b, s = np.nonzero((r * r).sum(-1) < cutoff * cutoff)
        out.append((a + lo, b, r[a, b, s]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _binned(home: np.ndarray, frac: np.ndarray, cell: np.ndarray, bins: np.ndarray, reach: np.ndarray, cutoff: float, of: np.ndarray):
    """Bins around each atom, counted on over the cell's edges: one that is met again there is another image."""
    place = np.minimum((frac * bins).astype(int), bins - 1)
    key = (place[:, 0] * bins[1] + place[:, 1]) * bins[2] + place[:, 2]
    order = np.argsort(key, kind="stable")
    counts = np.bincount(key, minlength=int(bins.prod()))
    start = np.cumsum(counts) - counts
    out = []
    for step in np.stack(np.meshgrid(*[np.arange(-k, k + 1) for k in reach], indexing="ij"), -1).reshape(-1, 3):
        to = place[of] + step
        shift, to = np.floor_divide(to, bins), np.mod(to, bins)
        other = (to[:, 0] * bins[1] + to[:, 1]) * bins[2] + to[:, 2]
        n = counts[other]
        i = np.repeat(of, n)
        j = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[other], n)]
        r = home[j] - home[i] + np.repeat(shift @ cell, n, axis=0)
        near = np.einsum("pa,pa->p", r, r) < cutoff * cutoff
        out.append((i[near], j[near], r[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def many_pairs(xyz: np.ndarray, starts: np.ndarray, cells: np.ndarray, cutoff: float, small: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of frames end to end: frame k has the atoms from starts[k] on, cells is [frame, 3, 3].

    Small frames of one size and reach are searched together, larger ones one by one.
    """
    n = np.diff(np.append(starts, len(xyz)))
    inverse = np.linalg.inv(cells) if len(cells) else cells
    reach = np.ceil(cutoff * np.linalg.norm(inverse, axis=1)).astype(int) if len(cells) else np.zeros((0, 3), int)
    out = []
    kinds, which = np.unique(np.column_stack([n, reach]), axis=0, return_inverse=True) if len(n) else (np.zeros((0, 4), int), np.zeros(0, int))
    for k, (size, *steps) in enumerate(kinds.tolist()):
        own = np.flatnonzero(which.ravel() == k)
        if size > small or size * size * np.prod([2 * s + 1 for s in steps]) > 200_000:
            for f in own:
                i, j, r = frame_pairs(xyz[starts[f] : starts[f] + size], cells[f], cutoff)
                out.append((i + starts[f], j + starts[f], r))
            continue
        shifts = np.stack(np.meshgrid(*[np.arange(-s, s + 1) for s in steps], indexing="ij"), -1).reshape(-1, 3)
        block = max(1, 100_000 // max(1, size * size * len(shifts)))  # arrays that stay in the cache
        for lo in range(0, len(own), block):
            f = own[lo : lo + block]
            at = starts[f][:, None] + np.arange(size)
            home = xyz[at]
            whole = np.floor(home @ inverse[f])
            home = home - whole @ cells[f]
            moved = shifts @ cells[f]
            r = [(home[:, None, :, k] - home[:, :, None, k])[..., None] + moved[:, None, None, :, k] for k in range(3)]
            square = r[0] * r[0]
            square += r[1] * r[1]
            square += r[2] * r[2]
            found = np.flatnonzero((square < cutoff * cutoff) & (square > NEAREST * NEAREST))
            a, i, j = np.unravel_index(found // len(shifts), (len(f), size, size))
            out.append((at[a, i], at[a, j], np.stack([x.ravel()[found] for x in r], axis=1)))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3))
    i, j, r = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(i, kind="stable")
    return i[order], j[order], r[order]


def binned_pairs(xyz: np.ndarray, starts: np.ndarray, cells: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As many_pairs by cell lists, of all frames at once: each atom looks at its bin and half of those around it."""
    n = np.diff(np.append(starts, len(xyz)))
    of = np.repeat(np.arange(len(n)), n)
    inverse = np.linalg.inv(cells) if len(cells) else cells
    width = 1 / np.linalg.norm(inverse, axis=1) if len(cells) else np.zeros((0, 3))
    bins = np.maximum(np.floor(width / cutoff), 1).astype(np.int64)
    reach = np.where(width >= cutoff, 1, np.ceil(cutoff / width)).astype(np.int64)
    frac = np.einsum("pa,pab->pb", xyz, inverse[of])
    whole = np.floor(frac)
    frac, home = frac - whole, xyz - np.einsum("pa,pab->pb", whole, cells[of])
    per = bins.prod(axis=1)
    base = (np.cumsum(per) - per)[of]
    bins, reach = bins[of], reach[of]
    place = np.clip(np.nan_to_num(frac * bins).astype(np.int64), 0, bins - 1)
    key = base + (place[:, 0] * bins[:, 1] + place[:, 1]) * bins[:, 2] + place[:, 2]
    order = np.argsort(key, kind="stable")
    ordered, most, out = key[order], (reach.max(axis=0) if len(xyz) else np.zeros(3, int)), []
    for step in np.stack(np.meshgrid(np.arange(most[0] + 1), *[np.arange(-k, k + 1) for k in most[1:]], indexing="ij"), -1).reshape(-1, 3):
        if tuple(step) < (0, 0, 0):
            continue
        i = np.flatnonzero((np.abs(step) <= reach).all(axis=1))
        shift, to = np.divmod(place[i] + step, bins[i])
        other = base[i] + (to[:, 0] * bins[i, 1] + to[:, 1]) * bins[i, 2] + to[:, 2]
        lo = np.searchsorted(ordered, other, "left")
        count = np.searchsorted(ordered, other, "right") - lo
        which = np.repeat(np.arange(len(i)), count)
        i, shift = i[which], shift[which]
        j = order[np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]]
        r = home[j] - home[i] + np.einsum("pa,pab->pb", shift.astype(float), cells[of[i]])
        square = np.einsum("pa,pa->p", r, r)
        near = (square < cutoff * cutoff) & (square > NEAREST * NEAREST)
        if not step.any():
            near &= i < j
        out.append((i[near], j[near], r[near]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 3))
    i, j, r = (np.concatenate(x) for x in zip(*out, strict=True))
    i, j, r = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([r, 0.0 - r])
    order = np.argsort(i, kind="stable")
    return i[order], j[order], r[order]


def cloud_slices(xyz: np.ndarray, center: np.ndarray, cutoff: float, most: int = 250_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of some centers (a mask) in open space: centers, i, j, r of one slice of centers after the other.

    A slice has about ``most`` candidates, so memory does not grow with density. Three bins that follow each other are
    one run of the sorted atoms, so an atom looks at nine runs.
    """
    place = np.floor((xyz - xyz.min(axis=0)) / cutoff).astype(np.int64) + 1
    size = place.max(axis=0) + 2
    key = (place[:, 0] * size[1] + place[:, 1]) * size[2] + place[:, 2]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    own = order[center[order]]  # neighbors in space follow each other
    runs = key[own] + np.array([[(a * size[1] + b) * size[2]] for a in (-1, 0, 1) for b in (-1, 0, 1)])
    lo, hi = np.searchsorted(ordered, runs - 1, "left"), np.searchsorted(ordered, runs + 1, "right")
    count = hi - lo
    share = np.cumsum(count.sum(axis=0)) // most
    for first, last in zip(*(np.searchsorted(share, np.unique(share), side) for side in ("left", "right")), strict=True):
        n, out = count[:, first:last], []
        for k in range(len(n)):
            i = np.repeat(own[first:last], n[k])
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(n[k]) - n[k], n[k]) + np.repeat(lo[k, first:last], n[k])]
            r = xyz[j] - xyz[i]
            square = r[:, 0] * r[:, 0] + r[:, 1] * r[:, 1] + r[:, 2] * r[:, 2]
            near = np.flatnonzero((square < cutoff * cutoff) & (square > NEAREST * NEAREST))
            out.append((i[near], j[near], r[near]))
        yield own[first:last], *(np.concatenate(x) for x in zip(*out, strict=True))


def cloud_tiles(xyz: np.ndarray, center: np.ndarray, cutoff: float, least: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some centers (a mask) that lie together, and all points closer than the cutoff to their box: every center once.

    What is asked of all their pairs is then asked of a dense matrix, without an index for each pair. Cells have about ``least``
    centers or more: a part of the cutoff wide where points are dense, so that few of a matrix's pairs are out of reach, and
    some cutoffs where they are sparse.
    """
    if not center.any():
        return
    low = xyz.min(axis=0)
    fine, reach = 4.0, 4
    while True:
        place = np.floor((xyz - low) * (fine / cutoff)).astype(np.int64) + reach
        size = place.max(axis=0) + reach + 1
        key = (place[:, 0] * size[1] + place[:, 1]) * size[2] + place[:, 2]
        some = len(np.unique(key[center]))
        if some == 1 or center.sum() >= least * some:
            break
        fine = fine - 1 if fine > 1 else fine / 2
        reach = int(np.ceil(fine))
    order = np.argsort(key, kind="stable")
    ordered, at = key[order], xyz[order].T.copy()
    own = order[center[order]]
    cells, first = np.unique(key[own], return_index=True)
    steps = range(-reach, reach + 1)
    runs = cells[:, None] + np.array([(a * size[1] + b) * size[2] for a in steps for b in steps])
    lo, hi = np.searchsorted(ordered, runs - reach, "left"), np.searchsorted(ordered, runs + reach, "right")
    count = hi - lo
    for k, (a, b) in enumerate(zip(first, [*first[1:], len(own)], strict=True)):
        rows, n = own[a:b], count[k]
        near = np.arange(n.sum()) + np.repeat(lo[k] - (np.cumsum(n) - n), n)
        box, away = xyz[rows], 0.0
        for low, high, x in zip(box.min(axis=0), box.max(axis=0), at, strict=True):
            off = x[near]
            off = np.maximum(low - off, off - high)
            away = away + np.square(np.maximum(off, 0, out=off), out=off)
        yield rows, order[near[away < cutoff * cutoff]]


#: Elements of a matrix that stays in the cache with some others like it.
TILE = 48_000


def squares(one: np.ndarray, two: np.ndarray, cutoff: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Squared distances of some points [3, a] after the other to points near to them [3, b]: their places and [some, b]; the
    cutoff's square for those not closer and of a point to itself. By a product of matrices, small enough for BLAS to leave
    it to one thread; where its rounding could matter, very near and at the cutoff, by differences."""
    most, origin = cutoff * cutoff, one.mean(axis=1, keepdims=True)
    x, y = one - origin, two - origin
    left = np.stack([*(-2 * x), (x * x).sum(axis=0), np.ones(x.shape[1])], axis=1)
    right = np.stack([*y, np.ones(y.shape[1]), (y * y).sum(axis=0)])
    full, step = np.full(y.shape[1], most), max(1, TILE // y.shape[1])
    for lo in range(0, x.shape[1], step):
        out = left[lo : lo + step] @ right
        unsure = out < 1e-4 * most
        unsure |= (out < most * (1 + 1e-12)) ^ (out < most * (1 - 1e-12))
        i, j = np.divmod(np.flatnonzero(unsure), out.shape[1])
        r = two[:, j] - one[:, lo + i]
        exact = r[0] * r[0] + r[1] * r[1] + r[2] * r[2]
        out[i, j] = np.where((exact < most) & (exact > NEAREST * NEAREST), exact, most)
        yield slice(lo, lo + len(out)), np.minimum(out, full, out=out)
