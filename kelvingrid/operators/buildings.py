"""How a pipe leaves the building that its terminal stands in: walls, ports, leads and approaches.

``walls(owner, ring, ax, ay, bx, by)`` are the segments of buildings' rings; ``terminals(id, x, y)`` may stand in one of them. Buildings are met whole, in the cell of a terminal or
in that of their middle (``shapes``); those that are too wide for that are joined wall by wall.
"""

from __future__ import annotations

from math import cos, radians, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from kelvingrid.functions import geometry as g
from kelvingrid.plans import rules
from kelvingrid.plans.shared import sorted_join

from . import shapes
from .legality import half
from .spatial import SEGMENT, cut_by_walls, cut_intervals, islands, overlap_join, point_boxes, segment_boxes

#: Tolerance, slack of offsets, short offsets tried where the full one has no room, angles of escape rays, ports kept at once and a sector.
EPS, SLACK = 1e-5, 0.20
SHORT = (0.05, 0.5, 1.5)
RAYS = (-90, -45, 0, 45, 90)
FIRST, EACH = 8, 3
#: Size against which a building is wide.
SIZE = 200.0


def setback(dn: Column) -> Column:
    """Least distance of a pipe's axis from a building."""
    return rules.building_clearance(dn) + half(dn)


def _right(x: Column, y: Column, prefix: str = "r_") -> Column:
    """Whether a ray from a point to the right meets a wall."""
    ax, ay, bx, by = (F.col(prefix + c) for c in SEGMENT)
    return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)


def _boxes(walls: DataFrame) -> DataFrame:
    low, high = (lambda c: F.min(F.least(f"a{c}", f"b{c}"))), (lambda c: F.max(F.greatest(f"a{c}", f"b{c}")))
    return walls.groupBy("owner").agg(low("x").alias("min_x"), high("x").alias("max_x"), low("y").alias("min_y"), high("y").alias("max_y"))


def _kinds(left: DataFrame, right: DataFrame, rest: str) -> StructType:
    return StructType([StructField("id", left.schema["id"].dataType), StructField("owner", right.schema["owner"].dataType), *StructType.fromDDL(rest).fields])


def owners(points: DataFrame, walls: DataFrame, size: float = SIZE) -> DataFrame:
    """(id, owner): the buildings that cover each of ``points(id, x, y)``, their boundary included."""
    split = shapes.Split(walls, size, EPS)
    return split.united(lambda: _owners_whole(split, points), lambda rest: _owners_by_walls(points, rest))


def _owners_whole(split: shapes.Split, points: DataFrame) -> DataFrame:
    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        (px, py), found = shapes.values(x, "x", "y"), []
        for b in shapes.buckets(y):
            for p, q in shapes.batches(px, px, py, py, b, EPS):
                k = np.flatnonzero(shapes.covered(px[p], py[p], shapes.of(b.walls, q)))
                found.append((p[k], b.at[q[k]]))
        p, q = shapes.concat(found, (int, int))
        return pa.table({"id": shapes.taken(x, "id", p), "owner": shapes.taken(y, "owner", q)})

    return split.with_points(points.select("id", "x", "y"), "x", "y", run, StructType(_kinds(points, split.whole, "n int").fields[:2]))


def _owners_by_walls(points: DataFrame, walls: DataFrame, size: float = 100.0) -> DataFrame:
    near = overlap_join(point_boxes(points.select("id", "x", "y")), _boxes(walls), size, EPS).select("id", "x", "y", F.col("r_owner").alias("owner"))
    j = sorted_join(near, walls.select("owner", *[F.col(c).alias(f"r_{c}") for c in SEGMENT]), "owner")
    gap = g.point_segment(F.col("x"), F.col("y"), *[F.col(f"r_{c}") for c in SEGMENT])
    found = j.groupBy("id", "owner").agg(F.count_if(_right(F.col("x"), F.col("y"))).alias("n"), F.min(gap).alias("gap"))
    return found.where("n % 2 = 1 or gap <= 1e-9").select("id", "owner")


def exterior(walls: DataFrame) -> DataFrame:
    """The walls of rings that no other ring of the building holds, or an even number of them: courtyards are left out."""
    first = walls.groupBy("owner", "ring").agg(F.min_by(F.struct((F.col("ax") + F.col("bx")).alias("x"), (F.col("ay") + F.col("by")).alias("y")), F.struct("ax", "ay", "bx", "by")).alias("p"))
    first = first.select("owner", F.col("ring").alias("own"), (F.col("p.x") / 2).alias("x"), (F.col("p.y") / 2).alias("y"))
    j = sorted_join(first, walls.select("owner", "ring", *[F.col(c).alias(f"r_{c}") for c in SEGMENT]), "owner").where("ring <> own")
    held = j.groupBy("owner", "own", "ring").agg((F.count_if(_right(F.col("x"), F.col("y"))) % 2).alias("odd")).groupBy("owner", "own").agg(F.sum("odd").alias("around"))
    inner = held.where("around % 2 = 1").select("owner", F.col("own").alias("ring"))
    return sorted_join(walls, inner, ["owner", "ring"], "left_anti")


def ports(terminals: DataFrame, walls: DataFrame, dn: int) -> DataFrame:
    """(id, owner, x, y, offset, lead): points outside each exterior wall opposite the terminal, nearest lead first in ``rank``.

    A port lies on the line from the terminal through the wall's nearest point, by the full setback beyond it; where that point is inside the
    building or too near another wall, at three shorter offsets too. A terminal on the wall itself leaves along its normals. ``lead`` is the
    length inside the building. Kept are the first eight, and of each of 16 sectors the first three.
    """
    split = shapes.Split(walls, SIZE, EPS)
    if split.rest is None:
        return _ports_whole(split, terminals, dn)
    wide = overlap_join(point_boxes(terminals.select("id", "x", "y")), _boxes(split.rest), 1000.0, EPS).select("id").distinct()  # their ports are ranked with those of other buildings
    near, far = (sorted_join(terminals.select("id", "x", "y"), wide, "id", how) for how in ("left_semi", "left_anti"))
    return _ports_by_walls(near, walls, dn).unionByName(_ports_whole(split, far, dn))


def _ports_whole(split: shapes.Split, terminals: DataFrame, dn: int) -> DataFrame:
    need_ = setback(F.lit(dn))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        (sx, sy, need), found = shapes.values(x, "x", "y", "need"), []
        need = float(need[0])
        for b in shapes.buckets(y):
            outer = b.outer()
            for p, q in shapes.batches(sx, sx, sy, sy, b, EPS):
                k = np.flatnonzero(shapes.covered(sx[p], sy[p], shapes.of(b.walls, q)))
                p, q = p[k], q[k]
                tx, ty, (ax, ay, bx, by) = sx[p], sy[p], shapes.of(b.walls, q)
                dx, dy = bx - ax, by - ay
                size = dx * dx + dy * dy
                at = np.where(size > 0, np.clip(((tx - ax) * dx + (ty - ay) * dy) / size, 0, 1), 0.0)
                ex, ey = _foot(at, tx, ax, bx), _foot(at, ty, ay, by)
                away, size = np.sqrt((ex - tx) ** 2 + (ey - ty) ** 2), np.sqrt(size)
                held = outer.take(q, axis=1)
                ways = [(held & (away > 1e-8), (ex - tx) / away, (ey - ty) / away), *[(held & ~(away > 1e-8) & (size > 1e-8), s * dy / size, s * -dx / size) for s in (-1.0, 1.0)]]
                ways = [(c, ex[w, c], ey[w, c], nx[w, c], ny[w, c]) for use, nx, ny in ways for w, c in [np.nonzero(use)]]
                c, ex, ey, nx, ny = (np.concatenate(v) for v in zip(*ways, strict=True))
                for k in range(0, len(c), b.chunk):
                    found.append(_ways(b, p, q, tx, ty, *(v[k : k + b.chunk] for v in (c, ex, ey, nx, ny)), need))
        p, q, px, py, offset, lead = shapes.concat(found, (int, int, float, float, float, float))
        keys = (np.floor(py * 1e6 + 0.5), np.floor(px * 1e6 + 0.5), q, p)  # points of one building that differ by a micrometre
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = np.any([v[order[1:]] != v[order[:-1]] for v in keys], axis=0)
        p, q, px, py, offset, lead = (v[order[new]] for v in (p, q, px, py, offset, lead))
        by = np.empty(y.num_rows, int)
        by[pc.sort_indices(y.column("owner")).to_numpy()] = np.arange(y.num_rows)
        dx, dy = px - sx[p], py - sy[p]
        order = np.lexsort((by[q], py, px, np.round(np.sqrt(dx * dx + dy * dy), 9), np.round(lead, 9), p))
        p, q, px, py, offset, lead, dx, dy = (v[order] for v in (p, q, px, py, offset, lead, dx, dy))
        rank = _counted(p)
        sector = np.minimum(np.floor((np.arctan2(dy, dx) + np.pi) / (2 * np.pi) * 16), 15)
        order = np.lexsort((rank, sector, p))
        nth = np.empty_like(rank)
        nth[order] = _counted(p[order] * 16 + sector[order].astype(int))
        k = np.flatnonzero((rank <= FIRST) | (nth <= EACH))
        return pa.table({"id": shapes.taken(x, "id", p[k]), "owner": shapes.taken(y, "owner", q[k]), "x": px[k], "y": py[k], "offset": offset[k], "lead": lead[k], "rank": rank[k].astype(np.int32)})

    kinds = _kinds(terminals, split.whole, "x double, y double, offset double, lead double, rank int")
    return split.with_points(terminals.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), need_.alias("need")), "x", "y", run, kinds)


def _foot(at: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A coordinate of the point of a wall that is nearest to t; not rounded off the terminal's own or the wall's, so that what lies straight across has no angle."""
    e = a + at * (b - a)
    return np.where(a == b, a, np.where(np.abs(e - t) <= 1e-12 * np.abs(t), t, e))


def _counted(group: np.ndarray) -> np.ndarray:
    """The place of each row in its group, from 1; equal values of ``group`` are neighbours."""
    if not len(group):
        return np.empty(0, int)
    new = np.concatenate([[True], group[1:] != group[:-1]])
    return np.arange(len(group)) - np.flatnonzero(new)[np.cumsum(new) - 1] + 1


def _ways(b: shapes.Bucket, p, q, tx, ty, c, ex, ey, nx, ny, need: float) -> tuple[np.ndarray, ...]:
    """The ports of ways out: (terminal, building, x, y, offset, lead). A way begins at (ex, ey) and has a direction; ``c`` is its terminal in its building."""
    walls = shapes.of(b.walls, q[c])

    def room(k: np.ndarray, offset: float) -> tuple[np.ndarray, np.ndarray]:
        x, y, w = ex[k] + nx[k] * offset, ey[k] + ny[k] * offset, shapes.of(walls, k)
        gap = shapes.least(shapes.gaps(x, y, w))
        return ~np.bitwise_xor.reduce(shapes.right(x, y, w), axis=0) & (gap > 1e-9), gap

    every = np.arange(len(c))
    out, gap = room(every, need + SLACK)
    usable = out & (gap >= need - 1e-6)
    outward = np.sqrt((ex - tx[c]) ** 2 + (ey - ty[c]) ** 2) > 1e-8  # else a normal; the inner one of a wall may end beyond the opposite one
    k = np.flatnonzero(~outward)
    outward[k] = room(k, SHORT[0])[0]
    found = [(every[out & outward], need + SLACK)]
    k = np.flatnonzero(outward & ~usable)
    found += [(k[room(k, s)[0]], s) for s in SHORT]
    k, o = np.concatenate([i for i, _ in found]), np.repeat([s for _, s in found], [len(i) for i, _ in found])
    x, y, c, walls = ex[k] + nx[k] * o, ey[k] + ny[k] * o, c[k], shapes.of(walls, k)
    i, low, high = shapes.inside((x, y, tx[c], ty[c]), walls, [v[q[c]] for v in b.box])
    return p[c], b.at[q[c]], x, y, o, np.bincount(i, high - low, len(x))


def _ports_by_walls(terminals: DataFrame, walls: DataFrame, dn: int) -> DataFrame:
    need = setback(F.lit(dn))
    full = need + SLACK
    t = terminals.select("id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    own = sorted_join(_owners_by_walls(terminals, walls), t, "id")
    w = sorted_join(own, exterior(walls).select("owner", *SEGMENT), "owner")
    at = g.along(F.col("tx"), F.col("ty"), *[F.col(c) for c in SEGMENT])
    foot = lambda c: F.when(F.col(f"a{c}") == F.col(f"b{c}"), F.col(f"a{c}")).when(F.abs(F.col(f"__e{c}") - F.col(f"t{c}")) <= 1e-12 * F.abs(F.col(f"t{c}")), F.col(f"t{c}")).otherwise(F.col(f"__e{c}"))
    w = w.withColumns({f"__e{c}": F.col(f"a{c}") + at * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "xy"}).withColumns({"ex": foot("x"), "ey": foot("y")})
    away, size = g.distance(F.col("tx"), F.col("ty"), F.col("ex"), F.col("ey")), g.distance(*[F.col(c) for c in SEGMENT])
    beyond = F.array(F.struct(((F.col("ex") - F.col("tx")) / away).alias("nx"), ((F.col("ey") - F.col("ty")) / away).alias("ny")))
    normal = F.array(*[F.struct((s * (F.col("by") - F.col("ay")) / size).alias("nx"), (s * (F.col("ax") - F.col("bx")) / size).alias("ny")) for s in (-1.0, 1.0)])
    w = w.withColumn("n", F.explode(F.when(away > 1e-8, beyond).when(size > 1e-8, normal)))
    w = w.select("id", "owner", "tx", "ty", "ex", "ey", "n.nx", "n.ny").distinct().withColumn("way", F.monotonically_increasing_id())
    tries = w.withColumn("offset", F.explode(F.array(full, *[F.lit(s) for s in SHORT]))).withColumn("full", F.col("offset") == full)
    tries = tries.withColumn("x", F.col("ex") + F.col("nx") * F.col("offset")).withColumn("y", F.col("ey") + F.col("ny") * F.col("offset"))
    j = sorted_join(tries, walls.select("owner", *[F.col(c).alias(f"r_{c}") for c in SEGMENT]), "owner")
    gap = g.point_segment(F.col("x"), F.col("y"), *[F.col(f"r_{c}") for c in SEGMENT])
    keys = ["id", "owner", "tx", "ty", "ex", "ey", "nx", "ny", "offset", "full", "x", "y"]
    j = j.groupBy(*keys).agg((F.count_if(_right(F.col("x"), F.col("y"))) % 2 == 1).alias("within"), F.min(gap).alias("gap")).withColumn("out", ~F.col("within") & (F.col("gap") > 1e-9))
    way = Window.partitionBy("id", "owner", "ex", "ey", "nx", "ny")
    usable = F.max(F.col("full") & F.col("out") & (F.col("gap") >= need - 1e-6)).over(way)
    outward = (g.distance(F.col("tx"), F.col("ty"), F.col("ex"), F.col("ey")) > 1e-8) | F.max(F.col("out") & (F.col("offset") == SHORT[0])).over(way)  # the inner normal of a wall may end beyond the opposite one
    j = j.withColumns({"usable": usable, "outward": outward}).where(F.col("out") & F.col("outward") & (F.col("full") | ~F.col("usable")))
    j = unique_points(j, ["id", "owner"])  # two buildings that share a wall have a port there each
    legs = j.select(F.struct("id", "x", "y").alias("id"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("tx").alias("bx"), F.col("ty").alias("by"))
    inside = cut_by_walls(legs, walls.select("owner", *SEGMENT), 100.0).groupBy("id", "owner").agg(F.sum(F.col("next") - F.col("cut")).alias("lead"))
    j = sorted_join(j, inside.select("id.*", "owner", "lead"), ["id", "x", "y", "owner"], "left").fillna(0.0, ["lead"])
    order = [F.round("lead", 9), F.round(g.distance(F.col("x"), F.col("y"), F.col("tx"), F.col("ty")), 9), "x", "y", "owner"]
    j = j.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).withColumn("sector", g.sector(F.col("x") - F.col("tx"), F.col("y") - F.col("ty")))
    j = j.withColumn("nth", F.row_number().over(Window.partitionBy("id", "sector").orderBy("rank")))
    return j.where((F.col("rank") <= FIRST) | (F.col("nth") <= EACH)).select("id", "owner", "x", "y", "offset", "lead", "rank")


def unique_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose points (x, y) differ by a micrometre, one of each."""
    return rows.withColumn("__x", g.half_up(F.col("x") * 1e6)).withColumn("__y", g.half_up(F.col("y") * 1e6)).dropDuplicates([*keys, "__x", "__y"]).drop("__x", "__y")


def tiers(found: DataFrame) -> DataFrame:
    """Adds ``tier`` to ports (id, x, y, lead): 0 for the nearest wall, one more where the lead is longer than the one before by more than 1e-5."""
    w = Window.partitionBy("id").orderBy("lead", "x", "y")
    new = F.when(F.col("lead") - F.lag("lead").over(w) > EPS, 1).otherwise(0)
    return found.withColumn("__new", new).withColumn("tier", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def leads(segments: DataFrame, walls: DataFrame, size: float = 100.0) -> DataFrame:
    """(id, owner, inside, straight, nearest) of ``segments(id, ax, ay, bx, by)`` that leave a building which covers their start.

    ``straight``: they are inside it from the start on, once, and leave through an exterior wall; ``nearest``: and no wall is nearer.
    """
    split = shapes.Split(walls, 2 * size, EPS)
    return split.united(lambda: _leads_whole(split, segments), lambda rest: _leads_by_walls(segments, rest, size))


def _leads_whole(split: shapes.Split, segments: DataFrame) -> DataFrame:
    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        s, found = tuple(shapes.values(x, *SEGMENT)), []
        for b in shapes.buckets(y):
            outer = b.outer()
            for p, q in shapes.batches(s[0], s[0], s[1], s[1], b, EPS):
                a, w = shapes.of(s, p), shapes.of(b.walls, q)
                k = np.flatnonzero(shapes.covered(*a[:2], w) & ~shapes.covered(*a[2:], w) & outer.take(q, axis=1).any(axis=0))
                p, q, a, w = p[k], q[k], shapes.of(a, k), shapes.of(w, k)
                i, low, high = shapes.merged(*shapes.inside(a, w, [v[q] for v in b.box]), EPS)
                n = np.bincount(i, minlength=len(p))
                first, last = np.zeros(len(p)), np.zeros(len(p))
                first[i[::-1]], last[i] = low[::-1], high  # one that starts on a wall and goes outward is inside over no length
                inside = np.bincount(i, high - low, len(p))
                n[n == 0] = 1
                facade_ = tuple(np.where(outer.take(q, axis=1), v, np.nan) for v in w)
                t = last / np.sqrt((a[2] - a[0]) ** 2 + (a[3] - a[1]) ** 2)
                exit_ = shapes.least(shapes.gaps(a[0] + t * (a[2] - a[0]), a[1] + t * (a[3] - a[1]), facade_))
                facade = shapes.least(shapes.gaps(*a[:2], facade_))
                straight = (n == 1) & (first <= EPS) & (exit_ <= EPS)
                found.append((p, b.at[q], inside, straight, straight & (np.abs(inside - facade) <= EPS)))
        p, q, inside, straight, nearest = shapes.concat(found, (int, int, float, bool, bool))
        return pa.table({"id": shapes.taken(x, "id", p), "owner": shapes.taken(y, "owner", q), "inside": inside, "straight": straight, "nearest": nearest})

    known = shapes.finite(segments).select("id", *[F.col(c).cast("double").alias(c) for c in SEGMENT])
    return split.with_points(known, "ax", "ay", run, _kinds(segments, split.whole, "inside double, straight boolean, nearest boolean"))


def _leads_by_walls(segments: DataFrame, walls: DataFrame, size: float) -> DataFrame:
    start = segments.select("id", F.col("ax").alias("x"), F.col("ay").alias("y"))
    stop = segments.select("id", F.col("bx").alias("x"), F.col("by").alias("y"))
    own = sorted_join(_owners_by_walls(start, walls), _owners_by_walls(stop, walls), ["id", "owner"], "left_anti")
    spans = sorted_join(cut_by_walls(segments.select("id", *SEGMENT), walls.select("owner", *SEGMENT), size), own, ["id", "owner"])
    spans = islands(spans, ["id", "owner"], "cut", "next", EPS)
    # one that starts on a wall and goes outward is inside over no length
    none = {"n": F.lit(1), "low": F.lit(0.0), "high": F.lit(0.0), "inside": F.lit(0.0)}
    per = spans.groupBy("id", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("cut").alias("low"), F.max("next").alias("high"), F.sum(F.col("next") - F.col("cut")).alias("inside"))
    per = sorted_join(own, per, ["id", "owner"], "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    j = sorted_join(sorted_join(per, segments.select("id", *SEGMENT), "id"), exterior(walls).select("owner", *[F.col(c).alias(f"r_{c}") for c in SEGMENT]), "owner")
    t = F.col("high") / F.nullif(g.distance(*[F.col(c) for c in SEGMENT]), F.lit(0.0))
    wall = [F.col(f"r_{c}") for c in SEGMENT]
    exit_ = g.point_segment(F.col("ax") + t * (F.col("bx") - F.col("ax")), F.col("ay") + t * (F.col("by") - F.col("ay")), *wall)
    out = j.groupBy("id", "owner", "n", "low", "inside").agg(F.min(exit_).alias("exit"), F.min(g.point_segment(F.col("ax"), F.col("ay"), *wall)).alias("facade"))
    straight = (F.col("n") == 1) & (F.col("low") <= EPS) & (F.col("exit") <= EPS)
    return out.select("id", "owner", "inside", straight.alias("straight"), (straight & (F.abs(F.col("inside") - F.col("facade")) <= EPS)).alias("nearest"))


def envelope_intervals(segments: DataFrame, walls: DataFrame, distance: Column, size: float = 100.0, reach: float = 12.0) -> DataFrame:
    """(id, owner, cut, next): the parts of segments within ``distance`` of a building or inside it.

    The points within a distance of a wall are a convex set, so a straight segment meets it in one interval: between where it meets the
    circles about the wall's ends and the strip along it.
    """
    s = segment_boxes(segments.select("id", *SEGMENT))
    j = overlap_join(s, segment_boxes(walls.select("owner", *SEGMENT)), size, reach)
    ax, ay, bx, by = (F.col(c) for c in SEGMENT)
    length = g.distance(ax, ay, bx, by)
    ux, uy = (bx - ax) / F.nullif(length, F.lit(0.0)), (by - ay) / F.nullif(length, F.lit(0.0))

    def circle(px, py) -> Column:
        along = (px - ax) * ux + (py - ay) * uy
        off2 = distance * distance - ((px - ax) * (px - ax) + (py - ay) * (py - ay) - along * along)
        return F.when(off2 >= 0, F.array(along - F.sqrt(off2), along + F.sqrt(off2)))

    px, py, qx, qy = (F.col(f"r_{c}") for c in SEGMENT)
    wall = g.distance(px, py, qx, qy)
    vx, vy = (qx - px) / F.nullif(wall, F.lit(0.0)), (qy - py) / F.nullif(wall, F.lit(0.0))
    # along the segment: place on the wall = p0 + t * pd within [0, wall], offset from it = o0 + t * od within the distance
    p0, pd = (ax - px) * vx + (ay - py) * vy, ux * vx + uy * vy
    o0, od = (ay - py) * vx - (ax - px) * vy, uy * vx - ux * vy
    inf = F.lit(float("inf"))

    def bounded(start, slope, low, high) -> tuple[Column, Column]:
        a, b = (low - start) / F.nullif(slope, F.lit(0.0)), (high - start) / F.nullif(slope, F.lit(0.0))
        held = (start >= low) & (start <= high)
        return F.when(F.abs(slope) > 1e-12, F.least(a, b)).when(held, -inf).otherwise(inf), F.when(F.abs(slope) > 1e-12, F.greatest(a, b)).when(held, inf).otherwise(-inf)

    (a, b), (c, d) = bounded(p0, pd, F.lit(0.0), wall), bounded(o0, od, -distance, distance)
    strip = F.when(F.greatest(a, c) <= F.least(b, d), F.array(F.greatest(a, c), F.least(b, d)))
    places = F.flatten(F.array_compact(F.array(circle(px, py), circle(qx, qy), strip)))
    j = j.select("id", F.col("r_owner").alias("owner"), length.alias("len"), places.alias("p")).where(F.size("p") > 0)
    j = j.select("id", "owner", F.greatest(F.lit(0.0), F.array_min("p")).alias("cut"), F.least(F.col("len"), F.array_max("p")).alias("next")).where("cut <= next")
    inside = cut_intervals(segments.select("id", *SEGMENT), walls.select("owner", *SEGMENT), size).select("id", "owner", "cut", "next")
    return islands(j.unionByName(inside), ["id", "owner"], "cut", "next", EPS)


def approaches(segments: DataFrame, walls: DataFrame, dn: int) -> DataFrame:
    """(id, owner, legal) of ``segments(id, owner, ax, ay, bx, by)`` that go outward from a port of ``owner``.

    Legal: they don't enter the building again, and stay in its envelope at most once, from the port on; they end outside it or on its edge.
    """
    need = setback(F.lit(dn))
    inner = cut_intervals(segments.select("id", *SEGMENT), walls.select("owner", *SEGMENT), 100.0).groupBy("id", "owner").agg(F.sum(F.col("next") - F.col("cut")).alias("inside"))
    spans = envelope_intervals(segments, walls, need).groupBy("id", "owner").agg(F.count(F.lit(1)).alias("n"), F.min("cut").alias("low"), F.max("next").alias("high"))
    j = segments.join(inner, ["id", "owner"], "left").join(spans, ["id", "owner"], "left")
    length = g.distance(*[F.col(c) for c in SEGMENT])
    clear = F.col("n").isNull() | ((F.col("n") == 1) & (F.col("low") <= EPS) & (F.col("high") < length - EPS))
    edge = walls.select("owner", *[F.col(c).alias(f"r_{c}") for c in SEGMENT])
    gap = sorted_join(segments, edge, "owner").groupBy("id", "owner").agg(F.min(g.point_segment(F.col("bx"), F.col("by"), *[F.col(f"r_{c}") for c in SEGMENT])).alias("gap"))
    j = j.join(gap, ["id", "owner"])
    at_edge = (F.col("n") == 1) & (F.col("low") <= EPS) & (F.abs(F.col("gap") - need) <= EPS)
    return j.select("id", "owner", ((F.coalesce("inside", F.lit(0.0)) <= EPS) & (length >= EPS) & (clear | at_edge)).alias("legal"))


def escapes(found: DataFrame, terminals: DataFrame, walls: DataFrame, dn: int, reach: float = 400.0) -> DataFrame:
    """(id, port_x, port_y, angle, x, y): where rays from ports leave their building's envelope, 5 cm beyond it."""
    t = terminals.select("id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    p = found.select("id", "owner", F.col("x").alias("ax"), F.col("y").alias("ay")).join(t, "id")
    size = g.distance(F.col("tx"), F.col("ty"), F.col("ax"), F.col("ay"))
    p = p.withColumn("nx", (F.col("ax") - F.col("tx")) / size).withColumn("ny", (F.col("ay") - F.col("ty")) / size)
    turns = F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(cos(radians(a))).alias("c"), F.lit(sin(radians(a))).alias("s")) for a in RAYS])
    p = p.withColumn("turn", F.explode(turns)).select("*", "turn.*")
    dx, dy = F.col("nx") * F.col("c") - F.col("ny") * F.col("s"), F.col("nx") * F.col("s") + F.col("ny") * F.col("c")
    rays = p.select(F.struct("id", "owner", "ax", "ay", "angle").alias("id"), "ax", "ay", (F.col("ax") + reach * dx).alias("bx"), (F.col("ay") + reach * dy).alias("by"))
    spans = envelope_intervals(rays, walls, setback(F.lit(dn)) + SLACK).where((F.col("owner") == F.col("id.owner")) & (F.col("cut") <= EPS) & (F.col("next") + 0.05 < reach))
    j = spans.select("id", "next").join(rays, "id")
    t = (F.col("next") + 0.05) / reach
    return j.select("id.id", F.col("ax").alias("port_x"), F.col("ay").alias("port_y"), "id.angle", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))


def transit_violations(legs: DataFrame, ends: DataFrame, walls: DataFrame, size: float = 200.0) -> DataFrame:
    """(edge, owner, rule): passages of edges through buildings other than one straight lead to the terminal inside.

    ``legs(edge, at, ax, ay, bx, by)`` with the running length at each leg's start; ``ends(edge, length, terminal, x, y)``: whether the edge ends in a terminal, and where.
    """
    split = shapes.Split(walls, size, EPS)
    return split.united(lambda: _transit_whole(split, legs, ends), lambda rest: _transit_by_walls(legs, ends, rest, size))


def _transit_whole(split: shapes.Split, legs: DataFrame, ends: DataFrame) -> DataFrame:
    """The legs of an edge that come near a building are all in the building's cell, in order."""
    facts = ends.select("edge", F.col("length").cast("double").alias("length"), F.coalesce("terminal", F.lit(False)).alias("terminal"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in "xy"])
    rules_ = np.array(["transit", "passages", "lead"])

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        offsets, legs_ = shapes.lists(x, "legs")
        at, s = legs_["at"], tuple(legs_[c] for c in SEGMENT)
        edge = np.repeat(np.arange(x.num_rows), np.diff(offsets))
        (length, terminal, ex, ey), found = shapes.values(x, "length", "terminal", "x", "y"), []
        for b in shapes.buckets(y):
            spans = []
            for p, q in shapes.segment_batches(s, b):
                i, low, high = shapes.inside(shapes.of(s, p), shapes.of(b.walls, q), [v[q] for v in b.box])
                spans.append((edge[p[i]], q[i], at[p[i]] + low, at[p[i]] + high))
            e, q, low, high = shapes.concat(spans, (int, int, float, float))
            if not len(e):
                continue
            order = np.lexsort((high, low, q, e))
            key, low, high = shapes.merged((e * len(b.at) + q)[order], low[order], high[order], EPS)
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            n, inside, low, high = np.diff([*new, len(key)]), np.add.reduceat(high - low, new), low[new], np.maximum.reduceat(high, new)
            key = key[new]
            k = np.flatnonzero(inside >= EPS)
            n, low, high, e, q = n[k], low[k], high[k], key[k] // len(b.at), key[k] % len(b.at)
            home, rule, outer = terminal[e].astype(bool), np.full(len(e), -1), b.outer()
            for k in np.array_split(np.flatnonzero(home), 1 + len(e) // b.chunk):
                home[k] = shapes.covered(ex[e[k]], ey[e[k]], shapes.of(b.walls, q[k]))
            rule[home & (n > 1)] = 1
            rule[home & (n == 1) & (np.abs(high - length[e]) > EPS)] = 2
            for k in np.array_split(np.flatnonzero(home & (rule < 0)), 1 + len(e) // b.chunk):
                rule[k[_crooked(offsets, at, s, e[k], low[k], high[k], shapes.of(b.walls, q[k]), outer.take(q[k], axis=1))]] = 2
            rule[~home] = 0
            k = np.flatnonzero(rule >= 0)
            found.append((e[k], b.at[q[k]], rule[k]))
        e, q, rule = shapes.concat(found, (int, int, int))
        return pa.table({"edge": shapes.taken(x, "edge", e), "owner": shapes.taken(y, "owner", q), "rule": pa.array(rules_[rule], pa.string())})

    rows = sorted_join(legs.select("edge", F.col("at").cast("double").alias("at"), *[F.col(c).cast("double").alias(c) for c in SEGMENT]), facts, "edge")
    kinds = StructType([legs.schema["edge"], split.whole.schema["owner"], *StructType.fromDDL("rule string").fields])
    return split.with_segments(rows, run, kinds, ("edge",))


def _crooked(offsets, at, s, e, low, high, walls, outer) -> np.ndarray:
    """Which leads turn inside their building, or enter it elsewhere than through an exterior wall: a leg that starts inside the lead may not turn off the one that it begins on."""
    if not len(e):
        return np.empty(0, bool)
    many = offsets[e + 1] - offsets[e]
    begin = np.cumsum(many) - many
    lead = np.repeat(np.arange(len(e)), many)
    leg = np.repeat(offsets[e] - begin, many) + np.arange(many.sum())
    first = np.maximum.reduceat(np.where(at[leg] <= low[lead] + EPS, leg, -1), begin)
    f = tuple(v[np.maximum(first, 0)] for v in s)
    dx, dy = f[2] - f[0], f[3] - f[1]
    size = np.sqrt(dx * dx + dy * dy)
    off = np.abs(dx[lead] * (s[3] - s[1])[leg] - dy[lead] * (s[2] - s[0])[leg]) > EPS * size[lead]
    bent = np.bitwise_or.reduceat(off & (at[leg] > low[lead] + EPS) & (at[leg] < high[lead] - EPS), begin)
    t = (low - at[np.maximum(first, 0)]) / size
    gap = shapes.least(shapes.gaps(f[0] + t * dx, f[1] + t * dy, tuple(np.where(outer, v, np.nan) for v in walls)))
    return (first >= 0) & (bent | (gap > EPS))


def _transit_by_walls(legs: DataFrame, ends: DataFrame, walls: DataFrame, size: float) -> DataFrame:
    named = legs.select(F.struct("edge", "at").alias("id"), *SEGMENT)
    spans = cut_by_walls(named, walls.select("owner", *SEGMENT), size)
    spans = spans.select("id.edge", "owner", "id.at", (F.col("id.at") + F.col("cut")).alias("low"), (F.col("id.at") + F.col("next")).alias("high"))
    bent = legs.groupBy("edge").agg(F.sort_array(F.collect_list(F.struct("at", *SEGMENT))).alias("all"))  # one path's legs
    merged = islands(spans.select("edge", "owner", "low", "high"), ["edge", "owner"], "low", "high", EPS)
    per = merged.groupBy("edge", "owner").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("high") - F.col("low")).alias("inside"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("inside") >= EPS)
    covered = _owners_by_walls(ends.where("terminal").select(F.col("edge").alias("id"), "x", "y"), walls).select(F.col("id").alias("edge"), "owner", F.lit(True).alias("home"))
    j = sorted_join(sorted_join(sorted_join(per, ends.select("edge", "length"), "edge"), covered, ["edge", "owner"], "left"), bent, "edge")
    # straight: no leg that starts inside the lead turns off the leg before it
    inner = F.filter("all", lambda s: (s.at > F.col("low") + EPS) & (s.at < F.col("high") - EPS))
    first = F.element_at(F.filter("all", lambda s: s.at <= F.col("low") + EPS), -1)
    off = lambda s: F.abs((first.bx - first.ax) * (s.by - s.ay) - (first.by - first.ay) * (s.bx - s.ax)) > EPS * g.distance(first.ax, first.ay, first.bx, first.by)
    j = j.withColumn("bent", F.exists(inner, off))
    rule = (
        F.when(F.col("home").isNull(), "transit").when(F.col("n") > 1, "passages")
        .when((F.abs(F.col("high") - F.col("length")) > EPS) | F.col("bent"), "lead")
    )
    found = j.select("edge", "owner", "low", rule.alias("rule"))
    # the lead's entry must be on an exterior wall
    at = sorted_join(legs, found.where("rule is null").select("edge", "owner", "low"), "edge").where(F.col("at") <= F.col("low") + EPS)
    at = at.groupBy("edge", "owner", "low").agg(F.max_by(F.struct("at", *SEGMENT), "at").alias("s")).select("edge", "owner", "low", "s.*")
    t = (F.col("low") - F.col("at")) / F.nullif(g.distance(*[F.col(c) for c in SEGMENT]), F.lit(0.0))
    entry = at.select("edge", "owner", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))
    gap = sorted_join(entry, exterior(walls).select("owner", *[F.col(c).alias(f"r_{c}") for c in SEGMENT]), "owner").groupBy("edge", "owner").agg(F.min(g.point_segment(F.col("x"), F.col("y"), *[F.col(f"r_{c}") for c in SEGMENT])).alias("gap"))
    return found.where("rule is not null").select("edge", "owner", "rule").unionByName(gap.where(F.col("gap") > EPS).select("edge", "owner", F.lit("lead").alias("rule")))
