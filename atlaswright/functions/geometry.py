"""Boxes, rings, affine maps and projections as expressions (SC-16..20, 23..29, 38..40)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0  # metres: the sphere of web-mercator


def width(b: str = "") -> Column:
    return F.col(f"{b}x1") - F.col(f"{b}x0")


def height(b: str = "") -> Column:
    return F.col(f"{b}y1") - F.col(f"{b}y0")


def area(b: str = "") -> Column:
    return width(b) * height(b)


def overlap(a: str, b: str) -> Column:
    """Area that two boxes, named by their column prefixes, have in common."""
    w = F.least(F.col(f"{a}x1"), F.col(f"{b}x1")) - F.greatest(F.col(f"{a}x0"), F.col(f"{b}x0"))
    h = F.least(F.col(f"{a}y1"), F.col(f"{b}y1")) - F.greatest(F.col(f"{a}y0"), F.col(f"{b}y0"))
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def inside(a: str, b: str, proper: bool = False) -> Column:
    """Whether box ``a`` is in box ``b``; ``proper``: without touching its edge."""
    if proper:
        return (F.col(f"{a}x0") > F.col(f"{b}x0")) & (F.col(f"{a}y0") > F.col(f"{b}y0")) & (F.col(f"{a}x1") < F.col(f"{b}x1")) & (F.col(f"{a}y1") < F.col(f"{b}y1"))
    return (F.col(f"{a}x0") >= F.col(f"{b}x0")) & (F.col(f"{a}y0") >= F.col(f"{b}y0")) & (F.col(f"{a}x1") <= F.col(f"{b}x1")) & (F.col(f"{a}y1") <= F.col(f"{b}y1"))


def meets(a: str, b: str) -> Column:
    return (F.col(f"{a}x0") <= F.col(f"{b}x1")) & (F.col(f"{b}x0") <= F.col(f"{a}x1")) & (F.col(f"{a}y0") <= F.col(f"{b}y1")) & (F.col(f"{b}y0") <= F.col(f"{a}y1"))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of ``array<struct<x,y>>``, closed or not."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v.cast("double")) / 2


def path_length(points: Column) -> Column:
    after = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), after, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a ring: the edges that a ray to the right crosses are odd in number."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, after, lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]), 1).otherwise(0))
    return F.aggregate(crosses, F.lit(0), lambda s, v: s + v) % 2 == 1


def _edges(ring: Column) -> Column:
    """The edges of a ring, closed or not, as ``struct<p,q>``."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def turn(p: Column, q: Column, r: Column) -> Column:
    """Twice the signed area of a triangle: above 0 where ``r`` is left of the line from ``p`` to ``q``."""
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def on_ring(ring: Column, p: Column) -> Column:
    """Whether a point is on an edge of a ring."""
    between = lambda a, b, c: (c >= F.least(a, b)) & (c <= F.greatest(a, b))
    return F.exists(_edges(ring), lambda e: (turn(e["p"], e["q"], p) == 0) & between(e["p"]["x"], e["q"]["x"], p["x"]) & between(e["p"]["y"], e["q"]["y"], p["y"]))


def ring_inside(inner: Column, outer: Column, proper: bool = False) -> Column:
    """Whether a ring lies in another (``proper``: without touching it): its corners do, and no
    edges cross."""
    cross = lambda e, f: (F.signum(turn(e["p"], e["q"], f["p"])) * F.signum(turn(e["p"], e["q"], f["q"])) < 0) & (F.signum(turn(f["p"], f["q"], e["p"])) * F.signum(turn(f["p"], f["q"], e["q"])) < 0)
    at = lambda p: contains_point(outer, p["x"], p["y"])
    corners = F.forall(inner, (lambda p: at(p) & ~on_ring(outer, p)) if proper else (lambda p: at(p) | on_ring(outer, p)))
    return corners & ~F.exists(_edges(inner), lambda e: F.exists(_edges(outer), lambda f: cross(e, f)))


def ring_overlap(one: Column, other: Column) -> Column:
    """Area that two simple rings have in common. A ring is the signed sum of the strips below its edges, so
    the common area is the signed sum, over pairs of edges, of the area below both: the lower of
    two straight lines over the common range, which bends at most once."""

    def below(e: Column, f: Column) -> Column:
        p, q, u, v = e["p"], e["q"], f["p"], f["q"]
        lo, hi = F.greatest(F.least(p["x"], q["x"]), F.least(u["x"], v["x"])), F.least(F.greatest(p["x"], q["x"]), F.greatest(u["x"], v["x"]))
        at = lambda a, b, x: a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"])
        e0, e1, f0, f1 = at(p, q, lo), at(p, q, hi), at(u, v, lo), at(u, v, hi)
        plain = (F.least(e0, f0) + F.least(e1, f1)) / 2
        t = (e0 - f0) / ((e0 - f0) - (e1 - f1))
        bent = (t * (F.least(e0, f0) + e0 + t * (e1 - e0)) + (1 - t) * (F.least(e1, f1) + e0 + t * (e1 - e0))) / 2
        sign = F.signum(q["x"] - p["x"]) * F.signum(v["x"] - u["x"])
        return F.when((lo < hi) & (p["x"] != q["x"]) & (u["x"] != v["x"]), sign * (hi - lo) * F.when((e0 - f0) * (e1 - f1) >= 0, plain).otherwise(bent)).otherwise(0.0)

    total = F.aggregate(_edges(one), F.lit(0.0), lambda s, e: s + F.aggregate(_edges(other), F.lit(0.0), lambda r, f: r + below(e, f)))
    return F.abs(total)


def rings_meet(one: Column, other: Column) -> Column:
    """Whether two rings have a point in common, if only of their edges."""
    corner = lambda a, b: F.exists(a, lambda p: contains_point(b, p["x"], p["y"]) | on_ring(b, p))
    across = lambda e, f: (F.signum(turn(e["p"], e["q"], f["p"])) * F.signum(turn(e["p"], e["q"], f["q"])) < 0) & (F.signum(turn(f["p"], f["q"], e["p"])) * F.signum(turn(f["p"], f["q"], e["q"])) < 0)
    return corner(one, other) | corner(other, one) | F.exists(_edges(one), lambda e: F.exists(_edges(other), lambda f: across(e, f)))


def box_ring(b: str = "") -> Column:
    """The ring of a box named by its column prefix."""
    corner = lambda x, y: F.struct(F.col(f"{b}{x}").alias("x"), F.col(f"{b}{y}").alias("y"))
    return F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))


def length_inside(points: Column, ring: Column) -> Column:
    """How much of a polyline lies in a ring or on its edge: each segment is cut where edges cross it or end on
    it, and the pieces count whose middle is inside."""
    segments = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def cuts(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]

        def of(e: Column) -> Column:
            u, v = e["p"], e["q"]
            cross = dx * (v["y"] - u["y"]) - dy * (v["x"] - u["x"])
            t = ((u["x"] - p["x"]) * (v["y"] - u["y"]) - (u["y"] - p["y"]) * (v["x"] - u["x"])) / cross
            along = lambda c: ((c["x"] - p["x"]) * dx + (c["y"] - p["y"]) * dy) / (dx * dx + dy * dy)
            return F.when(cross != 0, F.array(t)).otherwise(F.array(along(u), along(v)))

        return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.flatten(F.transform(_edges(ring), of))), lambda t: (t >= 0) & (t <= 1))))

    def inside(p: Column, q: Column) -> Column:
        at = lambda t: F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
        ts = cuts(p, q)
        pieces = F.zip_with(F.slice(ts, 1, F.size(ts) - 1), F.slice(ts, 2, F.size(ts)), lambda a, b: F.struct(at((a + b) / 2).alias("m"), (b - a).alias("d")))
        held = F.filter(pieces, lambda x: contains_point(ring, x["m"]["x"], x["m"]["y"]) | on_ring(ring, x["m"]))
        return F.aggregate(held, F.lit(0.0), lambda s, x: s + x["d"]) * F.hypot(q["x"] - p["x"], q["y"] - p["y"])

    moving = F.filter(segments, lambda s: (s["p"]["x"] != s["q"]["x"]) | (s["p"]["y"] != s["q"]["y"]))
    return F.aggregate(moving, F.lit(0.0), lambda total, s: total + inside(s["p"], s["q"]))


def representative_point(ring: Column) -> Column:
    """A point well inside a ring: the middle of the widest run inside it of a horizontal line, which lies halfway between the
    corners next above and next below the middle of its height."""
    ys = F.transform(ring, lambda p: p["y"].cast("double"))
    middle = (F.array_min(ys) + F.array_max(ys)) / 2
    y = (F.array_max(F.filter(ys, lambda v: v <= middle)) + F.array_min(F.filter(ys, lambda v: v > middle))) / 2
    crossing = F.filter(_edges(ring), lambda e: (e["p"]["y"] > y) != (e["q"]["y"] > y))
    xs = F.array_sort(F.transform(crossing, lambda e: e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"])))
    runs = F.transform(F.sequence(F.lit(1), F.floor(F.size(xs) / 2).cast("int")), lambda k: F.struct((F.element_at(xs, 2 * k) - F.element_at(xs, 2 * k - 1)).alias("width"), (-k).alias("first"), ((F.element_at(xs, 2 * k) + F.element_at(xs, 2 * k - 1)) / 2).alias("x")))
    return F.when(F.array_min(ys) < F.array_max(ys), F.struct(F.array_max(runs)["x"].alias("x"), y.alias("y")))


# An affine map is the six columns (a, b, d, e, tx, ty): x' = a x + b y + tx, y' = d x + e y + ty.
Affine = tuple[Column, Column, Column, Column, Column, Column]


def compose(second: Affine, first: Affine) -> Affine:
    """The map that does ``first``, then ``second``."""
    a, b, d, e, tx, ty = second
    p, q, r, s, ux, uy = first
    return a * p + b * r, a * q + b * s, d * p + e * r, d * q + e * s, a * ux + b * uy + tx, d * ux + e * uy + ty


def apply(m: Affine, x: Column, y: Column) -> tuple[Column, Column]:
    a, b, d, e, tx, ty = m
    return a * x + b * y + tx, d * x + e * y + ty


def invert(m: Affine) -> Affine:
    a, b, d, e, tx, ty = m
    det = a * e - b * d
    return e / det, -b / det, -d / det, a / det, (b * ty - e * tx) / det, (d * tx - a * ty) / det


def to_lnglat(x: Column, y: Column) -> tuple[Column, Column]:
    """Web-mercator metres to degrees."""
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - math.pi / 2)


def to_metres(lng: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lng) * EARTH, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * EARTH


def shape_metrics(shape_area: Column, w: Column, h: Column, map_area: Column) -> dict[str, Column]:
    """Aspect, coverage of the own box, and the box's share of the map; flat boxes are guarded."""
    box = w * h
    return {
        "aspect": F.when((w > 0) & (h > 0), F.least(w, h) / F.greatest(w, h)).otherwise(0.0),
        "coverage": F.when(box > 0, shape_area / box).otherwise(1.0),
        "bbox_coverage": F.when(map_area > 0, box / map_area).otherwise(0.0),
    }


def feature_scale(map_area: Column, own_area: Column) -> Column:
    """``log2`` of how many times the map is as long as the feature; 10 without an area."""
    return F.when(own_area > 0, F.log2(F.sqrt(map_area / own_area))).otherwise(10.0)


def proxy_dot(x0: Column, y0: Column, x1: Column, y1: Column, seq: Column) -> tuple[Column, Column, Column]:
    """Place and radius of the ``seq``-th proxy on a host's box: along its median, the line
    through the middles of the short sides."""
    wide = (x1 - x0) >= (y1 - y0)
    at = 0.8 - 0.15 * seq
    length = F.greatest(x1 - x0, y1 - y0)
    return F.when(wide, x0 + at * (x1 - x0)).otherwise((x0 + x1) / 2), F.when(wide, (y0 + y1) / 2).otherwise(y0 + at * (y1 - y0)), F.least(length / 16, F.lit(1000.0))


def ring(x: Column, y: Column, radius: Column, sides: int) -> Column:
    """Vertices of a regular ring around a point."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda k: 2 * math.pi * k / sides)
    return F.transform(turn, lambda t: F.struct((x + radius * F.cos(t)).alias("x"), (y + radius * F.sin(t)).alias("y")))


def dashed_ring(x: Column, y: Column, radius: Column, dashes: int = 20, ratio: float = 0.5) -> Column:
    """Ends of the dashes of a circle, one after the other (SC-28)."""
    at = lambda t: F.struct((x + radius * F.cos(t)).alias("x"), (y + radius * F.sin(t)).alias("y"))
    step = 2 * math.pi / dashes
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(dashes - 1)), lambda k: F.array(at(k * step), at(k * step + ratio * step))))


def node_radius(own_area: Column) -> Column:
    return F.greatest(F.sqrt(own_area / math.pi), F.lit(6000.0))


def direction(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    d = F.hypot(x1 - x0, y1 - y0)
    return F.when(d > 0, (x1 - x0) / d).otherwise(0.0), F.when(d > 0, (y1 - y0) / d).otherwise(0.0)


def similar_direction(a: tuple[Column, Column], b: tuple[Column, Column], degrees: float = 30.0) -> Column:
    return a[0] * b[0] + a[1] * b[1] >= math.cos(math.radians(degrees))


def cubic(p0: Column, p1: Column, p2: Column, p3: Column, t: Column) -> Column:
    """A coordinate of a cubic curve at parameter ``t``."""
    u = 1 - t
    return u * u * u * p0 + 3 * u * u * t * p1 + 3 * u * t * t * p2 + t * t * t * p3


def at_time(curves: Column, c: str, t: Column) -> Column:
    """A coordinate, ``x`` or ``y``, of a path of cubic curves (``array<struct<x0 .. y3>>``) at a time from 0 to 1, of which each
    curve takes an equal share."""
    n = F.size(curves)
    k = F.least(F.floor(t * n), n - 1).cast("int")
    return _let(F.element_at(curves, k + 1), lambda curve: cubic(*[curve[f"{c}{i}"] for i in range(4)], t * n - k))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is evaluated once, however often it is named in it."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def nearest_time(curves: Column, x: Column, y: Column, steps: int = 100, rounds: int = 4) -> Column:
    """SC-29: ``struct<d2,k,t>`` of the time at which a path of cubic curves comes nearest to a point: all of 0 to 1 in ``steps``
    steps, then a step to either side of the best in as many, ``rounds`` times; of equals the first."""

    def search(path: Column, lo: Column, step: float) -> Column:
        def one(k: Column) -> Column:
            t = F.least(F.greatest(lo + k * F.lit(step), F.lit(0.0)), F.lit(1.0))
            square = lambda c, at: _let(at_time(path, c, t) - at, lambda d: d * d)
            return F.struct((square("x", x) + square("y", y)).alias("d2"), k.alias("k"), t.alias("t"))

        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(steps)), one))

    def rounds_of(path: Column) -> Column:
        step = 1.0 / steps
        best = search(path, F.lit(0.0), step)
        for _ in range(rounds - 1):
            before, step = step, 2 * step / steps
            best = refined(best["t"], path, before, step)
        return best

    def refined(t: Column, path: Column, before: float, step: float) -> Column:
        return _let(t - F.lit(before), lambda lo: search(path, lo, step))

    return _let(curves, rounds_of)
