"""Spatial joins without an index: cells make them equi-joins.

A box is listed in every cell of a grid that it touches; two boxes that overlap meet in the cell that holds the
upper one of their lower corners, and only there the pair is kept, so nothing has to be deduplicated by a shuffle.
Choose the cell about as large as a typical box; cells with very many boxes are split by adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from kelvingrid.functions import geometry as g
from kelvingrid.plans.shared import dealt, materialise, parts, sorted_join


def with_cells(df: DataFrame, size: float, pad: Column | float = 0.0, prefix: str = "") -> DataFrame:
    """A row for each cell (cx, cy) that a row's box, widened by ``pad``, touches. Box columns: <prefix>min_x and so on."""
    c = lambda n: F.col(f"{prefix}{n}")
    cells = lambda lo, hi: F.explode(F.sequence(F.floor((lo - pad) / size), F.floor((hi + pad) / size)))
    return df.withColumn("cx", cells(c("min_x"), c("max_x"))).withColumn("cy", cells(c("min_y"), c("max_y")))


def overlap_join(left: DataFrame, right: DataFrame, size: float, pad: float = 0.0, how_filter: Column | None = None, on: tuple[str, ...] = (), shares: int = 1) -> DataFrame:
    """Pairs whose boxes, the left one widened by ``pad``, overlap. Columns of ``right`` get the prefix ``r_``; pairs are equal in the columns ``on``.

    Cells are dealt over a fixed number of tasks, whatever their bytes: few bytes make many pairs. ``shares`` deals the left rows of each cell over that many
    tasks, which all read the cell's right rows.
    """
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a = with_cells(left, size, pad)
    b = with_cells(right, size, prefix="r_").withColumnRenamed("cx", "r_cx").withColumnRenamed("cy", "r_cy")
    keys = ["cx", "cy", *on]
    if shares > 1:
        a, b = a.withColumn("__share", F.pmod(F.xxhash64(*left.columns), F.lit(shares))), b.withColumn("r___share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        b, keys = b.withColumn("r___share", F.col("r___share").cast("long")), [*keys, "__share"]
    a, b = dealt(a, *keys), dealt(b, *[f"r_{c}" for c in keys])
    meet = (F.col("cx") == F.floor(F.greatest(F.col("min_x") - pad, F.col("r_min_x")) / size)) & (F.col("cy") == F.floor(F.greatest(F.col("min_y") - pad, F.col("r_min_y")) / size))
    over = (F.col("min_x") - pad <= F.col("r_max_x")) & (F.col("max_x") + pad >= F.col("r_min_x")) & (F.col("min_y") - pad <= F.col("r_max_y")) & (F.col("max_y") + pad >= F.col("r_min_y"))
    out = a.join(b.hint("merge"), reduce(lambda x, y: x & y, [F.col(c) == F.col(f"r_{c}") for c in keys])).where(meet & over)
    if how_filter is not None:
        out = out.where(how_filter)
    return out.drop("cx", "cy", "r_cx", "r_cy", "__share", "r___share")


def segment_boxes(df: DataFrame) -> DataFrame:
    """Box columns of segments (ax, ay, bx, by)."""
    return df.withColumns({"min_x": F.least("ax", "bx"), "max_x": F.greatest("ax", "bx"), "min_y": F.least("ay", "by"), "max_y": F.greatest("ay", "by")})


def point_boxes(df: DataFrame) -> DataFrame:
    return df.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_y": F.col("y"), "max_y": F.col("y")})


SEGMENT = ("ax", "ay", "bx", "by")


def _segment(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in SEGMENT)


def window(df: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """Rows whose box overlaps a window: four range predicates that reach the scan."""
    return df.where((F.col("max_x") >= min_x) & (F.col("min_x") <= max_x) & (F.col("max_y") >= min_y) & (F.col("min_y") <= max_y))


def line_cells(df: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """A row for each cell (cx, cy) that comes within ``pad`` of a row's segment, along each axis: about its length in cells, where its box has the square of that."""
    reach = pad + 1e-6  # rounding may list a cell too many, never one too few
    ax, ay, bx, by = _segment()
    cells = lambda lo, hi: F.explode(F.sequence(F.floor((lo - reach) / size), F.floor((hi + reach) / size)))
    at = lambda x, none: F.when(bx == ax, F.lit(none)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - ax) / F.nullif(bx - ax, F.lit(0.0)))))
    out = df.withColumn("cx", cells(F.least(ax, bx), F.greatest(ax, bx)))
    y0, y1 = (ay + at(x, none) * (by - ay) for x, none in ((F.col("cx") * size - reach, 0.0), ((F.col("cx") + 1) * size + reach, 1.0)))
    return out.withColumns({"__y0": F.least(y0, y1), "__y1": F.greatest(y0, y1)}).withColumn("cy", cells(F.col("__y0"), F.col("__y1"))).drop("__y0", "__y1")


def _bare(df: DataFrame) -> DataFrame:
    """Segments whose coordinates are never null, which halves the generated code of tests on pairs; NaN meets nothing."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in SEGMENT})


def line_join(left: DataFrame, right: DataFrame, size: float, test: Column, where: tuple[Column, Column]) -> DataFrame:
    """Pairs of segments that pass ``test``, which have a point in common, ``where``. Columns of ``right`` get the prefix ``r_``.

    Segments are listed in the cells along them; a pair counts in the cell of its common point. Cells get smaller, and partitions more, as the pairs grow in number:
    on average no more than 1,000 right segments a cell and 4 million tests a task.
    """
    left, right = _bare(left), _bare(right)
    ends = [F.count(F.lit(1)), F.sum(g.distance(*_segment())), *[f(F.col(c)) for c in SEGMENT for f in (F.min, F.max)]]
    size_of = lambda df: df.where(~F.isnan(F.col("ax") + F.col("ay") + F.col("bx") + F.col("by"))).agg(*ends).first()
    a, b = size_of(left), size_of(right)
    n = None
    if a[0] and b[0]:
        wide = [max(b[k + 1], b[k + 5]) - min(b[k], b[k + 4]) + size for k in (2, 4)]
        room = wide[0] * wide[1]
        size = min(size, max(1000 * room / (b[1] + b[0] * size), b[1] / b[0] / 64, 1e-3))
        n = parts(left.sparkSession, (a[1] + a[0] * size) * (b[1] + b[0] * size) / room, 4_000_000)
    right = line_cells(right, size).select(*[F.col(c).alias(f"r_{c}") for c in (*right.columns, "cx", "cy")])
    pairs = dealt(line_cells(left, size), "cx", "cy", parts=n).join(dealt(right, "r_cx", "r_cy", parts=n).hint("merge"), (F.col("cx") == F.col("r_cx")) & (F.col("cy") == F.col("r_cy")) & test)
    here = [F.floor(v / size) == F.col(c) for v, c in zip(where, ("cx", "cy"), strict=True)]
    return pairs.where(here[0] & here[1]).drop("cx", "cy", "r_cx", "r_cy")


def _held(v: Column, k: int) -> Column:
    """A coordinate, at most rounded out of the boxes of both segments, put back into them."""
    low, high = (lambda p: F.least(F.col(p + SEGMENT[k]), F.col(p + SEGMENT[k + 2]))), (lambda p: F.greatest(F.col(p + SEGMENT[k]), F.col(p + SEGMENT[k + 2])))
    return F.greatest(low(""), low("r_"), F.least(high(""), high("r_"), v))


def common_point(a: tuple, b: tuple) -> tuple[Column, Column]:
    """A point of segments (ax, ...) and (r_ax, ...) that touch; of parallel ones an end that lies on the other."""
    t = g.crossing_at(a, b)
    on = lambda x, y: x.between(F.least(a[0], a[2]), F.greatest(a[0], a[2])) & y.between(F.least(a[1], a[3]), F.greatest(a[1], a[3]))
    end = lambda k: F.when(on(b[0], b[1]), b[k]).when(on(b[2], b[3]), b[k + 2]).otherwise(a[k])
    return tuple(F.when(t.isNull(), end(k)).otherwise(_held(a[k] + t * (a[k + 2] - a[k]), k)) for k in (0, 1))


def crossings(lines: DataFrame, size: float, key: str = "id") -> DataFrame:
    """Pairs (id < r_id) of segments that cross properly."""
    a, b = _segment(), _segment("r_")
    t = g.crossing_at(a, b)
    return line_join(lines, lines, size, (F.col(key) < F.col(f"r_{key}")) & g.crosses(a, b), tuple(_held(a[k] + t * (a[k + 2] - a[k]), k) for k in (0, 1)))


def contact(pairs: DataFrame) -> DataFrame:
    """Adds to pairs of segments (ax, ... and r_ax, ...) ``gap``, their distance, ``meets`` and ``along``, the metres over which they lie on each other.

    The formulas are those of ``functions.geometry``, on batches: as generated code they become a method that is too long for the JVM to compile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([batch.column(p + c).to_numpy(zero_copy_only=False) for c in SEGMENT] for p in ("", "r_"))
            with np.errstate(divide="ignore", invalid="ignore"):
                out = [pa.array(v) for v in contact_of(tuple(a), tuple(b))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "meets", "gap", "along"])

    fields = [StructField("meets", BooleanType()), StructField("gap", DoubleType()), StructField("along", DoubleType())]
    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, *fields]))


def _turns(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    turn = lambda s, x, y: (s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0])
    return [turn(a, *b[:2]), turn(a, *b[2:]), turn(b, *a[:2]), turn(b, *a[2:])]


def meeting(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], o: list[np.ndarray] | None = None) -> np.ndarray:
    """``geometry.touches`` of segments as arrays."""
    o = o or _turns(a, b)
    meets = (np.minimum(o[0], o[1]) <= 0) & (np.maximum(o[0], o[1]) >= 0) & (np.minimum(o[2], o[3]) <= 0) & (np.maximum(o[2], o[3]) >= 0)
    for k in (0, 1):
        meets &= (np.minimum(a[k], a[k + 2]) <= np.maximum(b[k], b[k + 2])) & (np.minimum(b[k], b[k + 2]) <= np.maximum(a[k], a[k + 2]))
    return meets


def contact_of(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(meets, gap, along) of segments as arrays, or of each with several others, whose arrays have an axis before."""
    def gap2(x, y, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        size = dx * dx + dy * dy
        t = np.where(size > 0, np.clip(((x - s[0]) * dx + (y - s[1]) * dy) / size, 0, 1), 0.0)
        ex, ey = x - s[0] - t * dx, y - s[1] - t * dy
        return ex * ex + ey * ey

    o = _turns(a, b)
    meets = meeting(a, b, o)
    gap = np.sqrt(np.minimum(np.minimum(gap2(*b[:2], a), gap2(*b[2:], a)), np.minimum(gap2(*a[:2], b), gap2(*a[2:], b))))
    dx, dy = a[2] - a[0], a[3] - a[1]
    size = np.sqrt(dx * dx + dy * dy)
    p, q = ((dx * (x - a[0]) + dy * (y - a[1])) / size for x, y in (b[:2], b[2:]))
    shared = np.maximum(0.0, np.minimum(size, np.maximum(p, q)) - np.maximum(0.0, np.minimum(p, q)))
    along = np.where((size > 0) & (np.maximum(np.abs(o[0]), np.abs(o[1])) / size < 1e-9), shared, 0.0)
    return meets, np.where(meets, 0.0, gap), along


def nearby(segments: DataFrame, others: DataFrame, size: float, reach: float) -> DataFrame:
    """Pairs of segments that may be within ``reach`` of each other: boxes overlap, and neither is farther than that on one side of the other's line.

    Where the others are short, as walls are, each is listed only in the cell of its middle, and the segments in the cells along them.
    """
    a, b = _segment(), _segment("r_")
    near = g.astride(a, b, reach * (1 + 1e-9)) & g.astride(b, a, reach * (1 + 1e-9))
    most, many = others.agg(F.max(g.distance(*_segment())), F.count(F.lit(1))).first()
    if most is None or not most <= size / 2:
        return overlap_join(segment_boxes(segments), segment_boxes(others), size, reach, near)
    pad = reach + most / 2
    cell = min(size, max(2 * pad, size / 4))
    n = parts(segments.sparkSession, many, 20_000)
    right = segment_boxes(_bare(others))
    right = right.withColumns({"cx": F.floor((F.col("ax") + F.col("bx")) / 2 / cell), "cy": F.floor((F.col("ay") + F.col("by")) / 2 / cell)})
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    left = line_cells(segment_boxes(_bare(segments)), cell, pad)
    over = [(F.col(f"min_{c}") - reach <= F.col(f"r_max_{c}")) & (F.col(f"max_{c}") + reach >= F.col(f"r_min_{c}")) for c in "xy"]
    on = (F.col("cx") == F.col("r_cx")) & (F.col("cy") == F.col("r_cy")) & over[0] & over[1] & near
    box = [p + c for p in ("", "r_") for c in ("min_x", "max_x", "min_y", "max_y", "cx", "cy")]
    return dealt(left, "cx", "cy", parts=n).join(dealt(right, "r_cx", "r_cy", parts=n).hint("merge"), on).drop(*box)


def clearance(segments: DataFrame, obstacles: DataFrame, size: float, reach: float) -> DataFrame:
    """Pairs of segments, or points (x, y), and obstacle segments nearer than the obstacle's ``need`` (at most ``reach``), with their distance."""
    points = "ax" not in segments.columns  # a point needs a quarter of the arithmetic, without the tests of contact
    near = overlap_join(point_boxes(segments) if points else segment_boxes(segments), segment_boxes(obstacles), size, reach)
    gap = g.point_segment(F.col("x"), F.col("y"), *_segment("r_")) if points else g.segment_segment(_segment(), _segment("r_"))
    return near.withColumn("gap", gap).where(F.col("gap") < F.col("r_need"))


def within(points: DataFrame, others: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """Pairs of points within ``radius``, with their distance."""
    pairs = overlap_join(point_boxes(points), point_boxes(others), size or radius, radius)
    return pairs.withColumn("distance", g.distance(F.col("x"), F.col("y"), F.col("r_x"), F.col("r_y"))).where(F.col("distance") <= radius)


def reached(points: DataFrame, segments: DataFrame, size: float, radius: float, n: int) -> DataFrame:
    """Pairs of ``points(x, y)`` and segments whose boxes are within ``radius``, in ``n`` partitions by the point's cell (cx, cy). Columns of ``segments`` get the prefix ``r_``.

    A point is listed in its own cell only, segments in all cells within the radius: a point's pairs are in one task, and windows by (cx, cy) and the point need no shuffle.
    Callers test distances behind their windows: in the join's condition they would be repeated by each use, in a method that is too long for the JVM to compile.
    """
    nan = F.lit(float("nan"))
    at = points.withColumns({"x": F.coalesce("x", nan), "y": F.coalesce("y", nan)})
    at = at.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    right = line_cells(segment_boxes(_bare(segments)), size, radius)
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    over = [F.col("x") >= F.col("r_min_x") - radius, F.col("x") <= F.col("r_max_x") + radius, F.col("y") >= F.col("r_min_y") - radius, F.col("y") <= F.col("r_max_y") + radius]
    same = (F.col("cx") == F.col("r_cx")) & (F.col("cy") == F.col("r_cy"))
    return dealt(at, "cx", "cy", parts=n).join(dealt(right, "r_cx", "r_cy", parts=n).hint("merge"), reduce(lambda p, q: p & q, over, same))


def nearest(points: DataFrame, segments: DataFrame, k: int, key: str, other: str, size: float | None = None, rounds: int = 24, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k segments nearest to each point, ties by ``other``: (key, r_other, distance, rank), exact; with columns to ``keep`` also x, y and those of the segments as r_<column>.

    Within a radius all segments are found by the cell join. A point is done once its k-th distance is within the radius;
    the rest go on with a radius three times as large, until it spans everything there is. The first radius is ``size``, or what holds
    about 2k segments of their mean length at their mean density. Cells are no smaller than an eighth of a mean segment's box, which would be listed too often.
    """
    points = points.select(key, "x", "y")
    segments = segments.select(other, *SEGMENT, *keep)
    boxed = segment_boxes(segments)
    span = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first(), boxed.agg(F.min("min_x"), F.max("max_x"), F.min("min_y"), F.max("max_y"), F.count(F.lit(1)), F.avg(F.col("max_x") - F.col("min_x") + F.col("max_y") - F.col("min_y")), F.avg(g.distance(*_segment()))).first()
    more = ["x", "y", *[f"r_{c}" for c in keep]] if keep else []
    if span[0][0] is None or span[1][0] is None:
        none = points.select(F.col(key), F.col("x"), F.col("y")).limit(0).crossJoin(segments.limit(0).select(*[F.col(c).alias(f"r_{c}") for c in (other, *keep)]))
        return none.select(key, f"r_{other}", F.lit(0.0).alias("distance"), F.lit(0).alias("rank"), *more)
    far = max(max(s[1] for s in span) - min(s[0] for s in span), max(s[3] for s in span) - min(s[2] for s in span)) * 1.5 + 1
    own = Window.partitionBy("cx", "cy", key)
    box = span[1]
    area = (box[1] - box[0] + 1) * (box[3] - box[2] + 1)
    room = 2 * k * area / box[4]  # a radius r about a segment of length l takes 3.14 r ** 2 + 2 l r
    radius = size or max(1e-6, ((box[6] ** 2 + 3.14 * room) ** 0.5 - box[6]) / 3.14)
    left, done = span[0][4], None
    for _ in range(rounds):
        many = left * min(box[4], box[4] * (3.14 * radius**2 + 2 * box[6] * radius) / area)
        pairs = reached(points, segments, max(radius, box[5] / 8), radius, parts(points.sparkSession, many, 200_000))
        pairs = pairs.withColumn("distance", g.point_segment(F.col("x"), F.col("y"), *_segment("r_")))
        last = radius >= far
        ranked = pairs.select("cx", "cy", key, f"r_{other}", "distance", *more).withColumn("rank", F.row_number().over(own.orderBy("distance", f"r_{other}"))).where(F.col("rank") <= k)
        if not last:
            ranked = ranked.where(F.col("distance") <= radius)
        ranked = materialise(ranked.withColumn("__n", F.max("rank").over(own)).drop("cx", "cy"))
        full = (ranked if last else ranked.where(F.col("__n") >= k)).drop("__n")
        done = full if done is None else done.unionByName(full)
        if last:
            break
        points = points.join(full.where("rank = 1").select(key), key, "left_anti")
        left = points.count()
        if not left:
            break
        radius = min(radius * 3, far)
    return done


def neighbours(points: DataFrame, k: int = 64, key: str = "id") -> DataFrame:
    """The k other points nearest to each of ``points(key, x, y)``, ties by ``key``: (key, r_key, distance, rank, dx, dy), exact."""
    at = points.select(key, "x", "y")
    same = at.select(key, F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    other = f"r_{key}"
    found = nearest(at, same, k + 1, key, key).where(F.col(key) != F.col(other))  # of k + 1 with the point itself at least k are others
    best = Window.partitionBy(key).orderBy("distance", other)
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    to = at.select(F.col(key).alias(other), F.col("x").alias("__x"), F.col("y").alias("__y"))
    return found.join(at, key).join(to, other).select(key, other, "distance", "rank", (F.col("__x") - F.col("x")).alias("dx"), (F.col("__y") - F.col("y")).alias("dy"))


def sectors(pairs: DataFrame, key: str, per: int = 6, n: int = 16, legal: Column | None = None, keep: int | None = None) -> DataFrame:
    """Of each point's neighbours (dx, dy, distance, r_id) in each of n sectors the ``per`` nearest; of those that are ``legal`` the first ``keep``.

    Attempts are counted before legality.
    """
    w = Window.partitionBy(key, "sector").orderBy("distance", "r_id")
    out = pairs.withColumn("sector", g.sector(F.col("dx"), F.col("dy"), n)).withColumn("try", F.row_number().over(w)).where(F.col("try") <= per)
    if legal is not None:
        out = out.where(legal)
    if keep is not None:
        out = out.withColumn("kept", F.row_number().over(w)).where(F.col("kept") <= keep)
    return out


def placed(rows: DataFrame, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based place of each row of a written table in a whole order, without one task for all: ``bucket`` never falls along the order, and places are
    those in the bucket behind a prefix sum over the buckets."""
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__bucket", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return rows.withColumn("__own", own).join(starts, "__bucket").withColumn(name, F.col("__before") + F.col("__own")).drop("__bucket", "__own", "__before")


def radial_sample(nodes: DataFrame, most: int, key: str = "id", buckets: int = 4096) -> DataFrame:
    """At most ``most`` nodes: sorted by angle, then radius about the mean, evenly spaced ones. Angles make the buckets of the order."""
    mean = nodes.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count(F.lit(1)).alias("n"))
    out = nodes.crossJoin(F.broadcast(mean))  # one row
    angle = F.atan2(F.col("y") - F.col("my"), F.col("x") - F.col("mx"))
    out = out.withColumn("angle", F.round(angle, 9)).withColumn("radius", F.round(g.distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my")), 6))
    out = placed(materialise(out), F.floor((F.col("angle") + F.pi()) / (2 * F.pi()) * buckets), [F.col(c) for c in ("angle", "radius", key)], "at")
    slot = lambda at: F.floor(at * most / F.col("n"))
    return out.where((F.col("n") <= most) | (slot(F.col("at")) != slot(F.col("at") - 1))).select(*nodes.columns)


def explode_segments(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Each ring's consecutive points as segments: (..., ring, seq, ax, ay, bx, by)."""
    keep = [c for c in df.columns if c != rings]
    out = df.select(*keep, F.posexplode(rings).alias("ring", "pts"))
    n = F.greatest(F.size("pts") - 1, F.lit(0))
    legs = F.zip_with(F.slice("pts", F.lit(1), n), F.slice("pts", F.lit(2), n), lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))
    return out.select(*keep, "ring", F.posexplode(legs).alias("seq", "s")).select(*keep, "ring", "seq", "s.*")


def cut_intervals(segments: DataFrame, walls: DataFrame, size: float, key: str = "id") -> DataFrame:
    """The parts of each segment inside each polygon: (key, owner, cut, next) in metres along it.

    The polygon's walls cut the segment; between neighbouring cuts the midpoint's even-odd test decides, counted by walls
    to its right, and a part that runs along a wall is inside; touching parts are merged. Polygons that are small against ``size`` are met whole in one cell
    (``shapes``), so that pairs of segments and polygons aren't shuffled; wide ones are joined wall by wall.
    """
    from . import shapes

    split = shapes.Split(walls, size, 1e-9)
    return split.united(lambda: shapes.cut_whole(split, segments, key), lambda rest: cut_by_walls(segments, rest, size, key))


def cut_by_walls(segments: DataFrame, walls: DataFrame, size: float, key: str = "id") -> DataFrame:
    """``cut_intervals`` by joins with single walls."""
    s = segment_boxes(segments).withColumn("len", g.distance(*_segment()))
    hits = nearby(s, walls, size, 1e-9)
    met = hits.select(key, "len", *SEGMENT, F.col("r_owner").alias("owner"), (g.crossing_at(_segment(), _segment("r_")) * F.col("len")).alias("cut"))
    cuts = met.where(F.col("cut").between(0, F.col("len")))
    # a segment that meets no wall is inside over its length or not at all: its start tells
    start = s.select(key, "len", *SEGMENT, F.col("ax").alias("x"), F.col("ay").alias("y"))
    boxes = walls.groupBy("owner").agg(F.min(F.least("ax", "bx")).alias("min_x"), F.max(F.greatest("ax", "bx")).alias("max_x"), F.min(F.least("ay", "by")).alias("min_y"), F.max(F.greatest("ay", "by")).alias("max_y"))
    held = overlap_join(point_boxes(start), boxes, size, 1e-9).select(key, "len", *SEGMENT, F.col("r_owner").alias("owner"))
    pairs = met.drop("cut").unionByName(held)
    ends = pairs.withColumn("cut", F.explode(F.array(F.lit(0.0), F.col("len"))))
    w = Window.partitionBy(key, "owner").orderBy("cut")
    parts = ends.unionByName(cuts).dropDuplicates([key, "owner", "cut"]).withColumn("next", F.lead("cut").over(w)).where("next > cut")
    mid = (F.col("cut") + F.col("next")) / 2 / F.col("len")
    parts = parts.withColumn("mx", F.col("ax") + mid * (F.col("bx") - F.col("ax"))).withColumn("my", F.col("ay") + mid * (F.col("by") - F.col("ay")))
    wall = walls.select("owner", *[F.col(c).alias(f"w_{c}") for c in SEGMENT])
    right = ((F.col("w_ay") > F.col("my")) != (F.col("w_by") > F.col("my"))) & (F.col("mx") < (F.col("w_bx") - F.col("w_ax")) * (F.col("my") - F.col("w_ay")) / F.nullif(F.col("w_by") - F.col("w_ay"), F.lit(0.0)) + F.col("w_ax"))
    on = g.point_segment(F.col("mx"), F.col("my"), *[F.col(f"w_{c}") for c in SEGMENT])
    odd = sorted_join(parts, wall, "owner").groupBy(key, "owner", "cut", "next").agg(F.count_if(right).alias("n"), F.min(on).alias("on")).where("n % 2 = 1 or on <= 1e-9").drop("n", "on")
    return islands(odd, [key, "owner"], "cut", "next").select(key, "owner", "cut", "next")


def islands(df: DataFrame, keys: list[str], low: str, high: str, slack: float = 1e-9) -> DataFrame:
    """Merge intervals that overlap or touch: (keys, low, high) of each island."""
    w = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("__new", F.when(before.isNull() | (F.col(low) > before + slack), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(*keys, "__island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("__island")
