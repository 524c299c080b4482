"""Sums over all walls of the area under two walls, without listing the pairs.

The common area of polygons is the signed sum of the strips under their wall pairs. Where
one wall lies below the other all along, the strip is that under the lower one; so walls
sorted by height add up before they meet anything, and only walls whose heights overlap
are measured pair by pair. Ranges of x are halved until one wall of a pair spans them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .strips import WALL, _under

# pairs of walls that are not worth another halving
FEW = 20_000
# heights compared at a time
STEP = 4_000_000
DEEPEST = 50


def listed(rows: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The walls ``_w`` of all rows one after another, and the row of each."""
    walls = rows.column("_w").combine_chunks()
    row = np.repeat(np.arange(len(rows)), pc.list_value_length(walls).to_numpy(zero_copy_only=False))
    return row, {c: walls.flatten().field(c).to_numpy(zero_copy_only=False) for c in WALL}


class Walls:
    """Walls within a range of x: their ends there, heights and sums of weights."""

    def __init__(self, walls: dict[str, np.ndarray], at: np.ndarray, lo: float, hi: float):
        start, stop = np.maximum(walls["lx"][at], lo), np.minimum(walls["rx"][at], hi)
        kept = start < stop
        self.at, self.walls, self.lo, self.hi = at[kept], walls, lo, hi
        self.start, self.stop = start[kept], stop[kept]
        self.spans = (self.start <= lo) & (self.stop >= hi)

    def part(self, some: np.ndarray) -> Walls:
        out = object.__new__(Walls)
        out.walls, out.lo, out.hi = self.walls, self.lo, self.hi
        out.at, out.start, out.stop, out.spans = (c[some] for c in (self.at, self.start, self.stop, self.spans))
        return out

    def measure(self) -> None:
        """Heights at the ends and where the range begins, slope, length and moments."""
        lx, rx, ly, ry = (self.walls[c][self.at] for c in ("lx", "rx", "ly", "ry"))
        self.slope = (ry - ly) / (rx - lx)
        first, last = (ly + (ry - ly) * ((x - lx) / (rx - lx)) for x in (self.start, self.stop))
        self.low, self.high = np.minimum(first, last), np.maximum(first, last)
        self.length = self.stop - self.start
        self.middle = (self.start + self.stop) / 2 - self.lo
        self.area = (first + last) / 2 * self.length
        self.height = ly + (ry - ly) * ((self.lo - lx) / (rx - lx))

    def fields(self, some: np.ndarray) -> dict[str, np.ndarray]:
        return {c: self.walls[c][self.at[some]] for c in WALL}


def _met(e: Walls, f: Walls, weights: np.ndarray, out: np.ndarray, own: bool) -> None:
    """Adds to ``out`` for every wall of ``f`` the weighted strips under it and each of
    ``e``; the walls of ``e`` span the range, or (``own``) those of ``f`` do."""
    if not len(e.at) or not len(f.at):
        return
    e.measure()
    f.measure()
    w = weights[e.at]

    def before(order: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.vstack([np.zeros((1, w.shape[1])), np.cumsum(w[order] * values[order, None], 0)])

    by_high, by_low = np.argsort(e.high), np.argsort(e.low)
    below = np.searchsorted(e.high[by_high], f.low, "right")
    reached = np.searchsorted(e.low[by_low], f.high, "right")

    def above(values: np.ndarray) -> np.ndarray:
        total = before(by_low, values)
        return total[-1] - total[reached]

    if own:
        added = before(by_high, e.area)[below]
        added += f.height[:, None] * above(e.length) + f.slope[:, None] * above(e.length * e.middle)
    else:
        length, middle = f.length[:, None], f.middle[:, None]
        added = (before(by_high, e.height)[below] + before(by_high, e.slope)[below] * middle) * length
        added += f.area[:, None] * above(np.ones(len(e.at)))
    near = np.flatnonzero(reached > below)
    rows = max(1, STEP // len(e.at))
    for start in range(0, len(near), rows):
        some = near[start : start + rows]
        k, i = np.nonzero((e.high > f.low[some, None]) & (e.low <= f.high[some, None]))
        j = some[k]
        lx, rx = (e.start[i], e.stop[i]) if own else (f.start[j], f.stop[j])
        one, other = e.fields(i), f.fields(j)
        one["s"] = other["s"] = np.ones(len(i))
        np.add.at(added, j, w[i] * _under(lx, rx, one, other, 0.0)[0][:, None])
    out[f.at] += added


def strips_under(
    e: dict[str, np.ndarray], f: dict[str, np.ndarray], weights: np.ndarray, lo: float, hi: float
) -> np.ndarray:
    """For every wall of ``f`` the sum of the strips under it and each wall of ``e`` between
    ``lo`` and ``hi``, by the ``weights`` (a row per wall of ``e``), with the signs of both."""
    out = np.zeros((len(f["s"]), weights.shape[1]))
    if not len(e["s"]) or not len(out):
        return out
    weights = weights * e["s"][:, None]
    # near zero, sums keep more digits
    base = np.median(f["ly"])
    e, f = ({**side, "ly": side["ly"] - base, "ry": side["ry"] - base} for side in (e, f))
    todo = [(np.arange(len(e["s"])), np.arange(len(out)), lo, hi, 0)]
    while todo:
        i, j, lo, hi, depth = todo.pop()
        a, b = Walls(e, i, lo, hi), Walls(f, j, lo, hi)
        _met(a.part(a.spans), b, weights, out, False)
        a, b, wide = a.part(~a.spans), b.part(~b.spans), b.part(b.spans)
        _met(a, wide, weights, out, True)
        half = (lo + hi) / 2
        if not len(a.at) or not len(b.at):
            continue
        if len(a.at) * len(b.at) <= FEW or depth >= DEEPEST or not lo < half < hi:
            rows = max(1, FEW // len(a.at))
            for start in range(0, len(b.at), rows):
                some = np.arange(start, min(start + rows, len(b.at)))
                lx, rx = np.maximum(a.start, b.start[some, None]), np.minimum(a.stop, b.stop[some, None])
                k, p = np.nonzero(lx < rx)
                one, other = a.fields(p), b.fields(some[k])
                one["s"] = other["s"] = np.ones(len(p))
                part = _under(lx[k, p], rx[k, p], one, other, 0.0)[0]
                np.add.at(out, b.at[some[k]], weights[a.at[p]] * part[:, None])
            continue
        todo += [(a.at, b.at, lo, half, depth + 1), (a.at, b.at, half, hi, depth + 1)]
    return out * f["s"][:, None]
