"""Moments of the members around queries: the numpy kernel of range aggregation.

Rows of a cell come one after the other, its points first. The points of one
cell are held at a time; its queries pass by, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

AXES = ("x", "y", "z")
SECOND = [(i, j) for i in range(3) for j in range(i, 3)]
MOMENTS = ["n", *(f"s{a}" for a in AXES), *(f"s{AXES[i]}{AXES[j]}" for i, j in SECOND)]
ROOM = 1 << 15  # pairs that are compared at once: as many as stay in a processor's cache
TOGETHER = 24  # queries of a block, on average


def runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns, the first counting most, and the places in it where other values start."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, np.flatnonzero(new)


def ball(radius: float) -> tuple[Callable, Callable]:
    """Extent of the shapes of queries, with room for rounding, and members among pairs."""

    def extent(axis):
        return [radius * (1 + 1e-9)] * 3

    def members(d, axis):
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= radius**2

    return extent, members


def rod(radius: float, depth: float) -> tuple[Callable, Callable]:
    """The same for cylinders along the queries' unit axes."""

    def extent(axis):
        return [np.max(np.abs(n) * depth + np.sqrt(np.maximum(1 - n * n, 0)) * radius) + 1e-7 * radius for n in axis]

    def members(d, axis):
        if not axis[0].any() and not axis[1].any() and (np.abs(axis[2]) == 1).all():  # upright: the same with less work
            return (np.abs(d[2]) <= depth) & (d[0] * d[0] + d[1] * d[1] <= radius**2)
        n = [a[:, None] for a in axis]
        along = d[0] * n[0] + d[1] * n[1] + d[2] * n[2]
        off = [c - along * a for c, a in zip(d, n)]
        return (np.abs(along) <= depth) & (off[0] * off[0] + off[1] * off[1] + off[2] * off[2] <= radius**2)

    return extent, members


class Cell:
    """Distinct places of the points of a cell, in order of x."""

    def __init__(self, at: list[np.ndarray], w: np.ndarray, least: np.ndarray | None):
        order, first = runs(at)
        self.at = [c[order][first] for c in at]
        self.w = np.add.reduceat(w[order], first)
        self.least = None if least is None else np.minimum.reduceat(least[order], first)

    def around(self, q: list[np.ndarray], axis: list[np.ndarray], shape, moments: list[str]) -> tuple[np.ndarray, dict]:
        """Which queries have members, and the moments of these about the query."""
        extent, members = shape
        block = blocks(q, extent(axis))
        order, first = runs([block, *q, *axis])
        own = np.zeros(len(order), int)
        own[first[1:]] = 1
        own[order] = np.cumsum(own)
        one = order[first]  # a query for each place and axis
        q, axis = [c[one] for c in q], [c[one] for c in axis]
        ends = [0, *(np.flatnonzero(np.diff(block[one])) + 1), len(one)]
        found = np.zeros(len(one), bool)
        sums = np.zeros((len(one), len(MOMENTS) if set(moments) - {"n"} else 1))
        least = None if self.least is None else np.zeros(len(one), self.least.dtype)
        for a, b in zip(ends, ends[1:]):
            part, turned = [c[a:b] for c in q], [c[a:b] for c in axis]
            reach = extent(turned)
            lo, hi = [c.min() - e for c, e in zip(part, reach)], [c.max() + e for c, e in zip(part, reach)]
            i, j = np.searchsorted(self.at[0], lo[0], "left"), np.searchsorted(self.at[0], hi[0], "right")
            y, z = self.at[1][i:j], self.at[2][i:j]
            near = i + np.flatnonzero((y >= lo[1]) & (y <= hi[1]) & (z >= lo[2]) & (z <= hi[2]))
            if not len(near):
                continue
            p, w = [c[near] for c in self.at], self.w[near]
            centre = [c[0] for c in part]
            terms = _terms(w, [x - c for x, c in zip(p, centre)]) if sums.shape[1] > 1 else w[:, None].astype(float)
            step = max(1, ROOM // len(near))
            for s in range(a, b, step):
                rows = slice(s, min(b, s + step))
                at = [c[rows] for c in q]
                hit = members([x[None, :] - c[:, None] for x, c in zip(p, at)], [n[rows] for n in axis])
                count = np.count_nonzero(hit, axis=1)
                found[rows] = count > 0
                sums[rows] = hit.astype(float) @ terms
                if sums.shape[1] > 1:
                    _about(sums[rows], [c - x for c, x in zip(centre, at)])
                    # members in one place have no spread, whatever rounding says
                    lone = np.flatnonzero(count == 1)
                    to = hit[lone].argmax(axis=1)
                    sums[s + lone] = _terms(w[to], [x[to] - c[lone] for x, c in zip(p, at)])
                if least is not None:
                    who, to = np.nonzero(hit)
                    start = np.flatnonzero(np.diff(who, prepend=-1))
                    if len(start):
                        least[s + who[start]] = np.minimum.reduceat(self.least[near][to], start)
        rows = np.flatnonzero(found[own])
        out = {m: sums[own[rows], MOMENTS.index(m)] for m in moments}
        if "n" in out and self.w.dtype.kind in "iu":
            out["n"] = np.rint(out["n"]).astype(np.int64)
        return rows, out if least is None else out | {"least": least[own[rows]]}


def blocks(q: list[np.ndarray], extent: list[float]) -> np.ndarray:
    """Numbers for neighbouring queries: blocks as small as leaves some of them together."""
    most = 1 + len(q[0]) // TOGETHER
    for part in (4, 2, 1, 0.5):
        at = [np.nan_to_num(np.floor((c - np.nanmin(c)) / (e / part))) for c, e in zip(q, extent)]
        key = (at[0] * 1e5 + at[1]) * 1e5 + at[2]
        if len(np.unique(key)) <= most:
            break
    return key


def _terms(w: np.ndarray, d: list[np.ndarray]) -> np.ndarray:
    """What each point adds to the moments."""
    v = [w * c for c in d]
    return np.stack([w.astype(float), *v, *(v[i] * d[j] for i, j in SECOND)], axis=1)


def _about(sums: np.ndarray, shift: list[np.ndarray]) -> None:
    """Moments about another point, in place; the shift leads from it to the old one."""
    n, first = sums[:, 0], [sums[:, 1 + i].copy() for i in range(3)]
    for k, (i, j) in enumerate(SECOND):
        sums[:, 4 + k] += first[i] * shift[j] + first[j] * shift[i] + n * shift[i] * shift[j]
    for i in range(3):
        sums[:, 1 + i] += n * shift[i]


def searcher(keys: list[str], by: list[str], axes: list[str], shape, moments: list[str], least: bool) -> Callable:
    """Function over batches in order of the keys, points before queries (``asked``)."""
    kept = [*by, "query_id"]
    made = [*moments, *(["least"] if least else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, cell = None, [], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n - 1, bool)
            for k in keys:
                c = batch.column(k)
                new |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            place = [batch.column(a).to_numpy(zero_copy_only=False) for a in AXES]
            axis = [batch.column(a).to_numpy(zero_copy_only=False) for a in axes]
            asked = batch.column("asked").to_numpy(zero_copy_only=False)
            ends = [0, *(np.flatnonzero(new) + 1), n]
            rows, sums = [], []
            for a, b in zip(ends, ends[1:]):
                key = tuple(batch.column(k)[a].as_py() for k in keys)
                if key != here:
                    here, held, cell = key, [], None
                m = b - int(asked[a:b].sum())
                if m > a:
                    more = [batch.column(c).slice(a, m - a).to_numpy(zero_copy_only=False) for c in ["w", *(["least"] if least else [])]]
                    held.append([*(c[a:m] for c in place), *more])
                if b > m and (held or cell is not None):
                    if cell is None:
                        whole = [np.concatenate(c) for c in zip(*held)]
                        cell, held = Cell(whole[:3], whole[3], whole[4] if least else None), []
                    got, out = cell.around([c[m:b] for c in place], [c[m:b] for c in axis], shape, moments)
                    rows.append(m + got)
                    sums.append(out)
            if sum(map(len, rows)):
                at = pa.array(np.concatenate(rows))
                arrays = [batch.column(c).take(at) for c in kept]
                arrays += [pa.array(np.concatenate([s[c] for s in sums])) for c in made]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *made])

    return run
