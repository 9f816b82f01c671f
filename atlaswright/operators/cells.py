"""Spatial joins decided inside grid cells, on arrays (JN-10..19, 25, 34).

A shape of the first side is dealt to one cell, that of its lower-left corner, and those of the second side to the cells in
which a corner may be of a shape that meets them; so whatever is asked of a shape is answered in one place, and no pair is
shuffled. Both sides have levels, at which a cell is at least twice as long as a shape of the first side and half as long as
one of the second; a pair is held at the coarser level of the two, so the copies of a shape do not grow with its size. In a
cell the first side is halved again and again by place, and the second narrowed to what meets each half, down to small
matrices of boxes; rings and lines decide on what is left, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 128
LEVELS = 54
BOX = ("x0", "y0", "x1", "y1")
#: Boxes held against boxes at once; numbers in a block of exact tests.
LEAF, BLOCK, PAIRS = 1 << 15, 1 << 17, 1 << 18


class Shapes:
    """The shapes of one side in a cell: boxes, and their columns by name."""

    def __init__(self, columns: dict[str, pa.Array], here: np.ndarray):
        self.columns, self.here, self.n = columns, here, len(here)
        self.box = [np.ascontiguousarray(columns[c].to_numpy(zero_copy_only=False), dtype=np.float64) for c in BOX]
        self._edges: dict[bool, Edges] = {}
        self._convex: np.ndarray | None = None

    def sorted_by(self, *keys) -> Shapes:
        """In the order of ``keys``: arrays, or names of columns."""
        keys = [self.columns[k] if isinstance(k, str) else pa.array(k) for k in keys]
        order = pc.sort_indices(pa.table(dict(zip(map(str, range(len(keys))), keys, strict=True))), sort_keys=[(str(i), "ascending") for i in range(len(keys))])
        return Shapes({k: v.take(order) for k, v in self.columns.items()}, self.here[order.to_numpy()])

    def edges(self, slanted: bool = False) -> Edges:
        """The edges of rings; ``slanted``: without those that run straight up or down."""
        if slanted not in self._edges:
            self._edges[slanted] = self.edges().slanted() if slanted else Edges.of(self.columns["ring"]) if "ring" in self.columns else Edges.of_boxes(self.box)
        return self._edges[slanted]

    def convex(self) -> np.ndarray:
        if self._convex is None:
            self._convex = self.edges().convex()
        return self._convex

    def area(self) -> np.ndarray:
        return np.abs(self.edges().area()) if "ring" in self.columns else (self.box[2] - self.box[0]) * (self.box[3] - self.box[1])


class Edges(NamedTuple):
    """Edges of many rings, or steps of many lines, from (px, py) to (qx, qy): ``count`` of each, from ``start`` on."""

    px: np.ndarray
    py: np.ndarray
    qx: np.ndarray
    qy: np.ndarray
    start: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, rings: pa.ListArray, closed: bool = True) -> Edges:
        offsets = rings.offsets.to_numpy().astype(np.int64)
        points = dict(zip([f.name for f in rings.values.type], rings.values.flatten(), strict=True))
        x, y = (np.asarray(points[c].to_numpy(zero_copy_only=False), dtype=np.float64) for c in ("x", "y"))
        first, count = offsets[:-1], np.diff(offsets)
        if closed:
            at = np.arange(offsets[0], offsets[-1])
            after = at + 1
            full = count > 0
            after[(first + count - 1 - offsets[0])[full]] = first[full]
            return cls(x[at], y[at], x[after], y[after], first - offsets[0], count)
        steps = np.maximum(count - 1, 0)
        start = np.cumsum(steps) - steps
        at = np.arange(steps.sum()) + np.repeat(first - start, steps)
        return cls(x[at], y[at], x[at + 1], y[at + 1], start, steps)

    @classmethod
    def of_boxes(cls, box: list[np.ndarray]) -> Edges:
        x0, y0, x1, y1 = box
        ring = lambda *c: np.stack(c, 1).ravel()
        return cls(ring(x0, x1, x1, x0), ring(y0, y0, y1, y1), ring(x1, x1, x0, x0), ring(y0, y1, y1, y0), 4 * np.arange(len(x0)), np.full(len(x0), 4))

    def slanted(self) -> Edges:
        keep = self.px != self.qx
        owner = np.repeat(np.arange(len(self.count)), self.count)
        count = np.bincount(owner[keep], minlength=len(self.count))
        return Edges(self.px[keep], self.py[keep], self.qx[keep], self.qy[keep], np.cumsum(count) - count, count)

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The edges of the rings ``i``, a row each; shorter rows end in edges from a point to itself."""
        count = self.count[i][:, None]
        if not len(self.px) or not count.size:
            return (np.zeros((len(i), 1)),) * 4
        k = np.arange(max(1, count.max()))[None, :]
        at = np.clip(self.start[i][:, None] + np.minimum(k, count - 1), 0, len(self.px) - 1)
        px, py = self.px[at], self.py[at]
        if count.min() == k.shape[1]:
            return px, py, self.qx[at], self.qy[at]
        own = k < count
        return px, py, np.where(own, self.qx[at], px), np.where(own, self.qy[at], py)

    def leftward(self) -> Edges:
        """With the ends of edges changed over in rings of an area below 0."""
        back = np.repeat(self.area() < 0, self.count)
        return self._replace(px=np.where(back, self.qx, self.px), py=np.where(back, self.qy, self.py), qx=np.where(back, self.px, self.qx), qy=np.where(back, self.py, self.qy))

    def convex(self) -> np.ndarray:
        """Rings of an area that only turn one way, and once round: their edges change between right and left twice at most."""
        out = np.zeros(len(self.count), bool)
        own = np.repeat(np.arange(len(self.count)), self.count)
        moving = (self.px != self.qx) | (self.py != self.qy)
        dx, dy, own = (self.qx - self.px)[moving], (self.qy - self.py)[moving], own[moving]
        if not len(own):
            return out
        start, place = firsts(own), np.arange(len(own))
        after = place + 1
        after[np.append(start[1:], len(own)) - 1] = start
        turn = dx * dy[after] - dy * dx[after]
        across = np.flatnonzero(dx != 0)
        ways, owners = dx[across] > 0, own[across]
        changes = np.zeros(len(self.count), np.int64)
        if len(across):
            first = firsts(owners)
            following = np.arange(len(across)) + 1
            following[np.append(first[1:], len(across)) - 1] = first
            changes = np.bincount(owners[ways != ways[following]], minlength=len(self.count))
        low, high = np.minimum.reduceat(turn, start), np.maximum.reduceat(turn, start)
        out[own[start]] = ((low >= 0) | (high <= 0)) & (low != high) | ((low == high) & (low != 0))
        return out & (changes <= 2) & (self.area() != 0)

    def area(self) -> np.ndarray:
        """Signed shoelace areas, summed in the order of the edges."""
        out = np.zeros(len(self.count))
        for rows in blocks(self.count):
            px, py, qx, qy = self.at(rows)
            out[rows] = np.cumsum(px * qy - qx * py, axis=1)[:, -1] / 2
        return out


def blocks(weights: np.ndarray) -> Iterator[np.ndarray]:
    """Places in blocks of like weight, of ``BLOCK`` in all or a single one."""
    order = np.argsort(weights, kind="stable") if len(weights) and weights.min() < weights.max() else np.arange(len(weights))
    at = 0
    while at < len(order):
        n = max(1, BLOCK // max(1, int(weights[order[at]])))
        n = max(1, min(n, BLOCK // max(1, int(weights[order[min(at + n, len(order)) - 1]]))))
        yield order[at : at + n]
        at += n


def _decided(a: Edges, i: np.ndarray, b: Edges, j: np.ndarray, test: Callable, dtype, factor: int = 1) -> np.ndarray:
    """``test`` of the edges of each pair of rings, in blocks."""
    out = np.zeros(len(i), dtype)
    with np.errstate(all="ignore"):
        for rows in blocks(factor * np.maximum(1, a.count[i]) * np.maximum(1, b.count[j])):
            out[rows] = test(a.at(i[rows]), b.at(j[rows]))
    return out


def _wide(e, axis: int):
    return [np.expand_dims(c, axis) for c in e]


def _summed(parts: np.ndarray) -> np.ndarray:
    """Sums over both axes of edges, in the order of the expression, so that rounding is the same."""
    out = np.zeros(len(parts))
    for k in range(parts.shape[1]):
        row = np.zeros(len(parts))
        for n in range(parts.shape[2]):
            row += parts[:, k, n]
        out += row
    return out


def _overlap(e, f) -> np.ndarray:
    """Common area, as ``geometry.ring_overlap`` has it."""
    (px, py, qx, qy), (ux, uy, vx, vy) = _wide(e, 2), _wide(f, 1)
    lo, hi = np.maximum(np.minimum(px, qx), np.minimum(ux, vx)), np.minimum(np.maximum(px, qx), np.maximum(ux, vx))
    sign = np.sign(qx - px) * np.sign(vx - ux)
    if (py == qy).all() and (uy == vy).all():
        return np.abs(_summed(sign * np.maximum(hi - lo, 0) * np.minimum(py, uy)))
    on = (lo < hi) & (px != qx) & (ux != vx)
    at = lambda ax, ay, bx, by, x: ay + (by - ay) * (x - ax) / (bx - ax)
    e0, e1, f0, f1 = at(px, py, qx, qy, lo), at(px, py, qx, qy, hi), at(ux, uy, vx, vy, lo), at(ux, uy, vx, vy, hi)
    plain = (np.minimum(e0, f0) + np.minimum(e1, f1)) / 2
    t = (e0 - f0) / ((e0 - f0) - (e1 - f1))
    bent = (t * (np.minimum(e0, f0) + e0 + t * (e1 - e0)) + (1 - t) * (np.minimum(e1, f1) + e0 + t * (e1 - e0))) / 2
    return np.abs(_summed(np.where(on, sign * (hi - lo) * np.where((e0 - f0) * (e1 - f1) >= 0, plain, bent), 0)))


def _contains(ring, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points, whose last axis is of length 1, are in rings."""
    px, py, qx, qy = ring
    crossed = ((py > y) != (qy > y)) & (x < (qx - px) * (y - py) / (qy - py) + px)
    return crossed.sum(-1) % 2 == 1


def _turn(px, py, qx, qy, x, y) -> np.ndarray:
    return (qx - px) * (y - py) - (qy - py) * (x - px)


def _on(ring, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    px, py, qx, qy = ring
    flat = _turn(px, py, qx, qy, x, y) == 0
    return (flat & (x >= np.minimum(px, qx)) & (x <= np.maximum(px, qx)) & (y >= np.minimum(py, qy)) & (y <= np.maximum(py, qy))).any(-1)


def _across(e, f) -> np.ndarray:
    (px, py, qx, qy), (ux, uy, vx, vy) = _wide(e, 2), _wide(f, 1)
    one = np.sign(_turn(px, py, qx, qy, ux, uy)) * np.sign(_turn(px, py, qx, qy, vx, vy)) < 0
    return (one & (np.sign(_turn(ux, uy, vx, vy, px, py)) * np.sign(_turn(ux, uy, vx, vy, qx, qy)) < 0)).any((1, 2))


def _corners_inside(e, f, proper: bool) -> np.ndarray:
    x, y, ring = e[0][:, :, None], e[1][:, :, None], _wide(f, 1)
    held, edge = _contains(ring, x, y), _on(ring, x, y)
    return ((held & ~edge) if proper else (held | edge)).all(1)


def _sides(e, f, proper: bool) -> np.ndarray:
    """Whether corners are on the inner side of all edges of convex rings that run to the left."""
    px, py, qx, qy = _wide(f, 1)
    turn = _turn(px, py, qx, qy, e[0][:, :, None], e[1][:, :, None])
    return ((turn > 0) | ((px == qx) & (py == qy)) if proper else turn >= 0).all((1, 2))


def _meet(e, f) -> np.ndarray:
    corner = lambda one, other: (_contains(_wide(other, 1), one[0][:, :, None], one[1][:, :, None]) | _on(_wide(other, 1), one[0][:, :, None], one[1][:, :, None])).any(1)
    return corner(e, f) | corner(f, e) | _across(e, f)


def _length(steps, ring) -> np.ndarray:
    """How much of lines is in rings, as ``geometry.length_inside`` has it: a cut more at 0 adds a piece of no length."""
    (px, py, qx, qy), (ux, uy, vx, vy) = _wide(steps, 2), _wide(ring, 1)
    dx, dy = qx - px, qy - py
    cross = dx * (vy - uy) - dy * (vx - ux)
    t = ((ux - px) * (vy - uy) - (uy - py) * (vx - ux)) / cross
    along = lambda x, y: ((x - px) * dx + (y - py) * dy) / (dx * dx + dy * dy)
    cuts = np.concatenate([np.where(cross != 0, t, along(ux, uy)), np.where(cross != 0, t, along(vx, vy))], axis=2)
    cuts = np.where((cuts >= 0) & (cuts <= 1), cuts, 0.0)
    ends = np.ones((*cuts.shape[:2], 1))
    cuts = np.sort(np.concatenate([0 * ends, cuts, ends], axis=2), axis=2)
    middle = (cuts[:, :, :-1] + cuts[:, :, 1:]) / 2
    x, y = (px + middle * dx)[..., None], (py + middle * dy)[..., None]
    wide = [c[:, None, None, :] for c in ring]
    piece = np.where(_contains(wide, x, y) | _on(wide, x, y), np.diff(cuts, axis=2), 0.0)
    return np.cumsum(np.cumsum(piece, axis=2)[:, :, -1] * np.hypot(dx, dy)[:, :, 0], axis=1)[:, -1]


def overlap(a: Shapes, i: np.ndarray, b: Shapes, j: np.ndarray) -> np.ndarray:
    """Common areas of pairs: of rings where both sides have them."""
    if "ring" in a.columns and "ring" in b.columns:
        return _decided(a.edges(True), i, b.edges(True), j, _overlap, np.float64)
    (x0, y0, x1, y1), (u0, v0, u1, v1) = ([c[k] for c in s.box] for s, k in ((a, i), (b, j)))
    return box_overlap((x0, y0, x1, y1), (u0, v0, u1, v1))


def inside(a: Shapes, i: np.ndarray, b: Shapes, j: np.ndarray, proper: bool = False) -> np.ndarray:
    """Whether rings are in rings: their corners are and no edges cross, which takes the corners alone where the outer ring is convex."""
    out, convex = np.zeros(len(i), bool), b.convex()[j]
    plain, other = np.flatnonzero(convex), np.flatnonzero(~convex)
    out[plain] = _decided(a.edges(), i[plain], b.edges().leftward(), j[plain], lambda e, f: _sides(e, f, proper), bool)
    other = other[_decided(a.edges(), i[other], b.edges(), j[other], lambda e, f: _corners_inside(e, f, proper), bool)]
    out[other] = ~_decided(a.edges(), i[other], b.edges(), j[other], _across, bool)
    return out


def meet(a: Shapes, i: np.ndarray, b: Shapes, j: np.ndarray) -> np.ndarray:
    return _decided(a.edges(), i, b.edges(), j, _meet, bool)


def contains(ring: Shapes, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points are in the rings ``j``."""
    out, edges = np.zeros(len(j), bool), ring.edges()
    with np.errstate(all="ignore"):
        for rows in blocks(np.maximum(1, edges.count[j])):
            out[rows] = _contains(edges.at(j[rows]), x[rows, None], y[rows, None])
    return out


def length(lines: Edges, i: np.ndarray, ring: Edges, j: np.ndarray) -> np.ndarray:
    """How much of the lines ``i`` is in the rings ``j``."""
    return _decided(lines, i, ring, j, _length, np.float64, 2 * int(ring.count.max(initial=1)) + 1)


def clipped(lines: Edges, i: np.ndarray, box: list[np.ndarray], j: np.ndarray) -> np.ndarray:
    """How much of the lines ``i`` is in the boxes ``j``, but for rounding: no less than is in rings there."""

    def test(steps, bounds) -> np.ndarray:
        px, py, qx, qy = steps
        lo, hi = np.zeros_like(px), np.ones_like(px)
        for p, q, u, v in ((px, qx, bounds[0], bounds[2]), (py, qy, bounds[1], bounds[3])):
            d = q - p
            s, t = (u[:, None] - p) / d, (v[:, None] - p) / d
            still = np.where((p >= u[:, None]) & (p <= v[:, None]), np.inf, -np.inf)
            lo = np.maximum(lo, np.where(d == 0, -still, np.minimum(s, t)))
            hi = np.minimum(hi, np.where(d == 0, still, np.maximum(s, t)))
        return (np.maximum(hi - lo, 0) * np.hypot(qx - px, qy - py)).sum(1)

    out = np.zeros(len(i))
    with np.errstate(all="ignore"):
        for rows in blocks(np.maximum(1, lines.count[i])):
            out[rows] = test(lines.at(i[rows]), [c[j[rows]] for c in box])
    return out


def box_overlap(a, b) -> np.ndarray:
    w = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])
    h = np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
    return np.maximum(w, 0) * np.maximum(h, 0)


def box_inside(a, b, proper: bool = False) -> np.ndarray:
    if proper:
        return (a[0] > b[0]) & (a[1] > b[1]) & (a[2] < b[2]) & (a[3] < b[3])
    return (a[0] >= b[0]) & (a[1] >= b[1]) & (a[2] <= b[2]) & (a[3] <= b[3])


def box_meet(a, b) -> np.ndarray:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def halves(a: list[np.ndarray], b: list[np.ndarray], narrow: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves ``(i, j)``: every box of ``a`` is in one, with all of ``b`` that meet it and maybe more, in order. ``narrow`` leaves
    out more of ``b`` for some of ``a``."""
    stack = [(np.arange(len(a[0])), np.arange(len(b[0])))]
    while stack:
        i, j = stack.pop()
        j = j[(b[0][j] <= a[2][i].max()) & (b[2][j] >= a[0][i].min()) & (b[1][j] <= a[3][i].max()) & (b[3][j] >= a[1][i].min())] if len(i) else j
        j = narrow(i, j) if narrow and len(i) and len(j) else j
        if not len(i) or not len(j):
            continue
        sides = [np.ptp(a[k][i]) for k in (0, 1)]
        if len(i) * len(j) <= LEAF or len(i) == 1:
            yield i, j
        elif max(sides) == 0:  # all in one place
            n = max(1, LEAF // len(j))
            yield from ((i[k : k + n], j) for k in range(0, len(i), n))
        else:
            order = i[np.argsort(a[0 if sides[0] >= sides[1] else 1][i], kind="stable")]
            stack += [(order[: len(i) // 2], j), (order[len(i) // 2 :], j)]


def pairs(a: Shapes, b: Shapes, test: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(i, j)`` for which ``test(i, j, x, y)`` holds, ``x`` and ``y`` being their boxes, columns against rows: those of a
    shape of ``a`` together in one block, in the order of ``b``."""
    mixed = not (a.here.all() and b.here.all())
    held, n = [], 0
    for i, j in halves(a.box, b.box):
        ok = test(i[:, None], j[None, :], [c[i][:, None] for c in a.box], [c[j][None, :] for c in b.box])
        if mixed:
            ok = ok & (a.here[i][:, None] | b.here[j][None, :])
        p, q = np.nonzero(ok)
        held.append((i[p], j[q]))
        n += len(p)
        if n >= PAIRS:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, n = [], 0
    if n:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def firsts(i: np.ndarray) -> np.ndarray:
    """The places at which runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)


def leading(a: Shapes, b: Shapes, test: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The first ``j`` in the order of ``b`` for each ``i`` that has one, where boxes alone decide: ``b`` is held in growing
    blocks against those that have none yet."""
    mixed, out = not (a.here.all() and b.here.all()), []
    for i, j in halves(a.box, b.box):
        at, step = 0, 64
        while at < len(j) and len(i):
            k = j[at : at + step]
            ok = test(i[:, None], k[None, :], [c[i][:, None] for c in a.box], [c[k][None, :] for c in b.box])
            if mixed:
                ok = ok & (a.here[i][:, None] | b.here[k][None, :])
            found = ok.any(1)
            out.append((i[found], k[ok.argmax(1)[found]]))
            i, at, step = i[~found], at + step, 4 * step
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def listed(i: np.ndarray, columns: dict[str, pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Each number of ``i`` once, and the rows of its run as a list."""
    at = firsts(i)
    offsets = pa.array(np.append(at, len(i)).astype(np.int32))
    return i[at], pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _own(scale: float) -> Column:
    """The finest level at which the longer side of a box is at most ``scale`` cells."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / F.lit(scale * CELL) * F.lit(1 + 1e-9)
    return F.when(side <= 1, 0).otherwise(F.least(F.ceil(F.log2(side)), F.lit(LEVELS))).cast("int")


def _found_levels(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.where("own is not null").select("own").distinct().collect())  # at most LEVELS + 1


def answered(a: DataFrame, b: DataFrame, answer: Callable[[Shapes, Shapes], Iterator[pa.RecordBatch]], schema: str) -> tuple[DataFrame, bool]:
    """What ``answer`` says of the shapes of each cell, and whether all of a shape of ``a`` is in one cell. Both sides have ``x0,
    y0, x1, y1``. Where it is in more, each pair still is in one only."""
    rows = {}
    for side, df, scale in (("a", a, 0.5), ("b", b, 2.0)):
        df = df.where(F.col("ring").isNotNull()) if "ring" in df.columns else df
        rows[side] = df.select(F.struct(*df.columns).alias("row"), *BOX, _own(scale).alias("own"))
    found = {side: _found_levels(df) for side, df in rows.items()}
    first, second = found["a"], found["b"]
    goals = {
        "a": {k: ([k] if any(n <= k for n in second) else []) + [n for n in second if n > k] for k in first},
        "b": {k: ([k] if any(n <= k for n in first) else []) + [n for n in first if n > k] for k in second},
    }
    size = F.lit(CELL).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    dealt = []
    for side, df in rows.items():
        levels = a.sparkSession.createDataFrame([(k, n) for k, at in goals[side].items() for n in at], "own int, level int")
        df = df.join(F.broadcast(levels), "own").withColumn("size", size)
        for c, lo, hi in (("cx", "x0", "x1"), ("cy", "y0", "y1")):
            cell = lambda v: F.floor(v / F.col("size")).cast("long")
            df = df.withColumn(c, cell(F.col(lo)) if side == "a" else F.explode(F.sequence(cell(F.col(lo) - F.col("size") / 2), cell(F.col(hi)))))
        own = {s: F.col("row") if s == side else F.lit(None).cast(rows[s].schema["row"].dataType) for s in rows}
        dealt.append(df.select("level", "cx", "cy", (F.col("own") == F.col("level")).alias("here"), *[v.alias(s) for s, v in own.items()]))

    def side_of(table: pa.Table, name: str) -> Shapes:
        own = table.filter(pc.is_valid(table[name])).combine_chunks()
        column = own[name].combine_chunks()
        columns = dict(zip([f.name for f in column.type], column.flatten(), strict=True))
        return Shapes(columns, own["here"].to_numpy(zero_copy_only=False).astype(bool))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _cells(batches):
            one, other = side_of(table, "a"), side_of(table, "b")
            if one.n and other.n:
                yield from answer(one, other)

    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = dealt[0].union(dealt[1]).repartition(tasks, "level", "cx", "cy").sortWithinPartitions("level", "cx", "cy")
    return cells.mapInArrow(run, schema), all(len(at) <= 1 for at in goals["a"].values())


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one cell after the other."""
    held, last = [], None
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("level", "cx", "cy")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
        for n, at in enumerate(starts):
            key = tuple(keys[at])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(at, (starts[n + 1] if n + 1 < len(starts) else len(keys)) - at))
    if held:
        yield pa.Table.from_batches(held)
