"""Planar geometry as column expressions: all of it stays in generated code, and degenerate segments are guarded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def distance(ax, ay, bx, by) -> Column:
    dx, dy = _lit(bx) - _lit(ax), _lit(by) - _lit(ay)
    return F.sqrt(dx * dx + dy * dy)


def along(px, py, ax, ay, bx, by) -> Column:
    """Where in [0, 1] of a segment its point nearest to p is; 0 for a segment without length."""
    dx, dy = bx - ax, by - ay
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))


def point_segment(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point from a segment."""
    t = along(px, py, ax, ay, bx, by)
    dx, dy = px - ax - t * (bx - ax), py - ay - t * (by - ay)  # from the start on: its rounding is that of coordinates' differences
    return F.sqrt(dx * dx + dy * dy)


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def crosses(a: tuple, b: tuple) -> Column:
    """Whether two segments (ax, ay, bx, by) cross in a point inside both."""
    o1, o2 = orientation(*a, *b[:2]), orientation(*a, *b[2:])
    o3, o4 = orientation(*b, *a[:2]), orientation(*b, *a[2:])
    return (F.signum(o1) * F.signum(o2) < 0) & (F.signum(o3) * F.signum(o4) < 0)


def astride(a: tuple, b: tuple, slack: float = 0.0) -> Column:
    """Whether segment b is not on one side of the line of a, farther from it than ``slack``. Segments that are no farther apart than that are so both ways round."""
    o1, o2 = orientation(*a, *b[:2]), orientation(*a, *b[2:])
    most = distance(*a) * slack if slack else F.lit(0.0)
    return (F.least(o1, o2) <= most) & (F.greatest(o1, o2) >= -most)


def touches(a: tuple, b: tuple) -> Column:
    """Whether two segments have any point in common: their boxes have, and neither is on one side of the other's line."""
    span = lambda k: (F.least(a[k], a[k + 2]) <= F.greatest(b[k], b[k + 2])) & (F.least(b[k], b[k + 2]) <= F.greatest(a[k], a[k + 2]))
    return span(0) & span(1) & astride(a, b) & astride(b, a)


def segment_segment(a: tuple, b: tuple) -> Column:
    """Distance of two segments."""
    apart = F.least(point_segment(a[0], a[1], *b), point_segment(a[2], a[3], *b), point_segment(b[0], b[1], *a), point_segment(b[2], b[3], *a))
    return F.when(touches(a, b), 0.0).otherwise(apart)


def crossing_at(a: tuple, b: tuple) -> Column:
    """Where in [0, 1] of segment a its line meets that of b; null if they are parallel."""
    dx, dy, ex, ey = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    return ((b[0] - a[0]) * ey - (b[1] - a[1]) * ex) / F.nullif(dx * ey - dy * ex, F.lit(0.0))


def overlap_length(a: tuple, b: tuple) -> Column:
    """Metres over which two segments lie on each other; 0 if they are not on one line."""
    dx, dy = a[2] - a[0], a[3] - a[1]
    size = F.sqrt(dx * dx + dy * dy)
    off = lambda x, y: F.abs(dx * (y - a[1]) - dy * (x - a[0])) / F.nullif(size, F.lit(0.0))
    at = lambda x, y: (dx * (x - a[0]) + dy * (y - a[1])) / F.nullif(size, F.lit(0.0))
    p, q = at(b[0], b[1]), at(b[2], b[3])
    shared = F.greatest(F.lit(0.0), F.least(size, F.greatest(p, q)) - F.greatest(F.lit(0.0), F.least(p, q)))
    return F.coalesce(F.when((off(b[0], b[1]) < 1e-9) & (off(b[2], b[3]) < 1e-9), shared), F.lit(0.0))


def acute_angle(dx, dy, ex, ey) -> Column:
    """Degrees between two directions, 0 to 90; 90 if one has no length."""
    size = F.sqrt(dx * dx + dy * dy) * F.sqrt(ex * ex + ey * ey)
    return F.coalesce(F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dx * ex + dy * ey) / F.nullif(size, F.lit(0.0))))), F.lit(90.0))


def turn(dx, dy, ex, ey) -> Column:
    """Degrees by which the second leg turns from the first, 0 to 180."""
    size = F.sqrt(dx * dx + dy * dy) * F.sqrt(ex * ex + ey * ey)
    return F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dx * ex + dy * ey) / F.nullif(size, F.lit(0.0)))))), F.lit(0.0))


def sector(dx, dy, n: int = 16) -> Column:
    """Which of n equal sectors from -180 degrees on a direction is in."""
    return F.least(F.floor((F.atan2(dy, dx) + F.pi()) / (2 * F.pi()) * n), F.lit(n - 1)).cast("int")


def half_up(x: Column) -> Column:
    """Round halves up, negative ones too."""
    return F.floor(x + 0.5)


def path_length(path: Column) -> Column:
    """Length of an array of points (structs with x and y)."""
    legs = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: distance(a.x, a.y, b.x, b.y))
    return F.aggregate(legs, F.lit(0.0), lambda s, d: s + d)


def chainages(path: Column) -> Column:
    """Running length at each point of a path."""
    tail = F.zip_with(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))), lambda a, b: distance(a.x, a.y, b.x, b.y))
    return F.aggregate(tail, F.array(F.lit(0.0)), lambda s, d: F.concat(s, F.array(F.element_at(s, -1) + d)))


def project(path: Column, x: Column, y: Column) -> Column:
    """Running length of the point of a path that is nearest to (x, y); of equally near ones the first."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    legs = F.zip_with(F.zip_with(F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n), lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by"))), F.slice(chainages(path), F.lit(1), n), lambda s, c: F.struct(s.alias("s"), c.alias("c")))
    of = lambda s: (s.ax, s.ay, s.bx, s.by)
    near = F.transform(legs, lambda v: F.struct(point_segment(x, y, *of(v.s)).alias("gap"), (v.c + along(x, y, *of(v.s)) * distance(*of(v.s))).alias("at")))
    return F.coalesce(F.array_min(near)["at"], F.lit(0.0))


def point_at(path: Column, chainage: Column) -> Column:
    """The point of a path at a running length, clamped to its ends."""
    at = chainages(path)
    legs = F.zip_with(F.zip_with(path, at, lambda p, c: F.struct(p.x.alias("x"), p.y.alias("y"), c.alias("c"))), F.concat(F.slice(F.zip_with(path, at, lambda p, c: F.struct(p.x.alias("x"), p.y.alias("y"), c.alias("c"))), F.lit(2), F.greatest(F.size(path) - 1, F.lit(1))), F.array(F.lit(None).cast("struct<x:double,y:double,c:double>"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    leg = F.element_at(F.filter(legs, lambda s: s.b.isNotNull() & (s.b.c >= chainage)), 1)
    t = F.greatest(F.lit(0.0), F.coalesce((chainage - leg.a.c) / F.nullif(leg.b.c - leg.a.c, F.lit(0.0)), F.lit(0.0)))
    inner = F.struct((leg.a.x + t * (leg.b.x - leg.a.x)).alias("x"), (leg.a.y + t * (leg.b.y - leg.a.y)).alias("y"))
    last = F.element_at(path, -1)
    return F.when(F.exists(legs, lambda s: s.b.isNotNull() & (s.b.c >= chainage)), inner).otherwise(F.struct(last.x.alias("x"), last.y.alias("y")))


def part_of(path: Column, low: Column, high: Column) -> Column:
    """The points of a path between two running lengths, with their own: structs (x, y, at)."""
    named = F.zip_with(path, chainages(path), lambda p, c: F.struct(p.x.alias("x"), p.y.alias("y"), c.alias("at")))
    end = lambda c: F.transform(F.array(point_at(path, c)), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), c.alias("at")))
    return F.concat(end(low), F.filter(named, lambda p: (p.at > low + 1e-9) & (p.at < high - 1e-9)), end(high))


def inside(x, y, rings: Column) -> Column:
    """Even-odd test of a point against rings (arrays of points, closed); holes are rings like others."""
    def crossings(ring: Column) -> Column:
        n = F.greatest(F.size(ring) - 1, F.lit(0))
        hits = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.when(((a.y > y) != (b.y > y)) & (x < (b.x - a.x) * (y - a.y) / F.nullif(b.y - a.y, F.lit(0.0)) + a.x), 1).otherwise(0))
        return F.aggregate(hits, F.lit(0), lambda s, v: s + v)

    return F.aggregate(rings, F.lit(0), lambda s, r: s + crossings(r)) % 2 == 1
