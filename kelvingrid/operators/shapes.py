"""Joins with whole shapes: a polygon or line is one row with all its walls, and what it does to a segment or a point is worked out in the cell where they meet.

Pairs grow faster than both tables, so they are never shuffled: only the rows of the two tables are, once a cell. For segments a shape is listed in the cell of its middle,
and a segment in the cells near it; for points a point is listed in its own cell, and a shape in the cells that its box touches. Either way each pair is found once, with all walls.

Shapes that are wide against a cell or have very many walls would be copied too often; ``split`` sets them apart for joins by wall. Walls are ``(owner, ax, ay, bx, by)``
with ``ring`` where rings matter; walls with a coordinate that is null or NaN meet nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from kelvingrid.plans.shared import dealt, parts, sorted_join

from .spatial import SEGMENT, line_cells, with_cells

#: Walls of a shape that is still whole; shapes that a cell holds on average; shapes a task; values of an array at once.
WALLS, EACH, TASK, BATCH = 4096, 128, 5000, 12_000
#: Tolerances: contact with a wall, and the neighbouring merge of intervals.
TOUCH = 1e-9

Segment = tuple[np.ndarray, ...]


def finite(rows: DataFrame) -> DataFrame:
    return rows.where(~F.isnan(F.coalesce(sum((F.col(c).cast("double") for c in SEGMENT), F.lit(0.0)), F.lit(float("nan")))))


def shapes(walls: DataFrame, *keep: str) -> DataFrame:
    """(owner, *keep, walls, min_x, max_x, min_y, max_y): a row for each shape."""
    ring = (F.col("ring") if "ring" in walls.columns else F.lit(0)).cast("long").alias("ring")
    low, high = (lambda c: F.min(F.least(f"a{c}", f"b{c}"))), (lambda c: F.max(F.greatest(f"a{c}", f"b{c}")))
    wall = F.struct(ring, *[F.col(c).cast("double").alias(c) for c in SEGMENT])
    box = {"min_x": low("x"), "max_x": high("x"), "min_y": low("y"), "max_y": high("y")}
    return finite(walls).groupBy("owner", *keep).agg(F.collect_list(wall).alias("walls"), *[v.cast("double").alias(k) for k, v in box.items()])


class Split:
    """Shapes of at most half of ``size`` and ``WALLS`` walls (``whole``), the walls of the others (``rest``, None where there are none), cells and partitions."""

    def __init__(self, walls: DataFrame, size: float, reach: float, *keep: str) -> None:
        found = shapes(walls, *keep)
        wide = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
        small = (wide <= size / 2) & (F.size("walls") <= WALLS)
        n, some, most, *box = found.agg(F.count_if(small), F.count_if(~small), F.max(F.when(small, wide)), F.min("min_x"), F.max("max_x"), F.min("min_y"), F.max("max_y")).first()
        self.some = n > 0
        self.whole = found.where(small)
        self.rest = None
        if some:
            other = found.where(~small).select(*[F.col(c).alias(f"__{c}") for c in ("owner", *keep)])
            same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keep], F.col("owner") == F.col("__owner"))
            self.rest = sorted_join(walls, other, same, "left_semi")
        self.pad = reach + (most or 0.0) / 2 + 1e-6
        room = max(box[1] - box[0], 1.0) * max(box[3] - box[2], 1.0) if n else 0.0
        self.cell = min(max(2 * self.pad, (room * EACH / max(n, 1)) ** 0.5), 10 * size)
        self.parts = parts(walls.sparkSession, n, TASK)

    def united(self, whole: Callable[[], DataFrame], rest: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What is found with whole shapes, and with the walls of the rest; of either only where there are any."""
        found = [whole()] if self.some else [whole().limit(0)] if self.rest is None else []  # without shapes there is nothing to meet
        return reduce(DataFrame.unionByName, [*found, *([] if self.rest is None else [rest(self.rest)])])

    def _meet(self, left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType) -> DataFrame:
        a, b = (dealt(df, "cx", "cy", parts=self.parts).groupBy("cx", "cy") for df in (left, right))

        def both(x: pa.Table, y: pa.Table) -> pa.Table:
            if not x.num_rows or not y.num_rows:
                return empty
            with np.errstate(all="ignore"):
                return run(x, y)

        empty = to_arrow_schema(schema).empty_table()
        return a.cogroup(b).applyInArrow(both, schema)

    def with_segments(self, segments: DataFrame, run: Callable, schema: StructType, group: tuple[str, ...] = ()) -> DataFrame:
        """``run(segments of a cell, shapes of it)`` for each cell. With columns to ``group`` by, their segments in the cell are one row's list ``legs``, in order."""
        left = line_cells(finite(segments), self.cell, self.pad)
        if group:
            rest = [c for c in segments.columns if c not in group and c not in ("at", *SEGMENT)]
            left = dealt(left, "cx", "cy", parts=self.parts).groupBy("cx", "cy", *group).agg(F.sort_array(F.collect_list(F.struct("at", *SEGMENT))).alias("legs"), *[F.first(c).alias(c) for c in rest])
        middle = {f"c{k}": F.floor((F.col(f"min_{k}") + F.col(f"max_{k}")) / 2 / self.cell) for k in "xy"}
        return self._meet(left, self.whole.withColumns(middle), run, schema)

    def with_points(self, points: DataFrame, x: str, y: str, run: Callable, schema: StructType) -> DataFrame:
        """``run(points of a cell, shapes that touch it)`` for each cell of the points (x, y)."""
        known = points.where(~F.isnan(F.coalesce(F.col(x) + F.col(y), F.lit(float("nan")))))
        at = known.withColumns({"cx": F.floor(F.col(x) / self.cell), "cy": F.floor(F.col(y) / self.cell)})
        return self._meet(at, with_cells(self.whole, self.cell, 1e-4), run, schema)


# ---- in a cell: numpy, P pairs of a segment or point with a shape of W walls, as arrays (W, P); fewer walls are filled up with NaN


def values(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def lists(table: pa.Table, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets and flat fields of a column of lists of structs."""
    col = table.column(name).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten()
    counts = pc.list_value_length(col).to_numpy()
    return np.concatenate([[0], np.cumsum(counts)]), {f.name: flat.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(flat.type)}


class Bucket:
    """Shapes of about the same number of walls: their places ``at`` in the table, walls and rings (w, m), and boxes."""

    def __init__(self, at: np.ndarray, start: np.ndarray, counts: np.ndarray, flat: dict[str, np.ndarray], box: list[np.ndarray]) -> None:
        self.at = at
        self.w = int(counts.max())
        k = np.arange(self.w)[:, None]
        gone = k >= counts
        index = np.where(gone, 0, start + k)
        self.walls = tuple(np.where(gone, np.nan, flat[c][index]) for c in SEGMENT)
        self.ring = np.where(gone, -1, flat["ring"][index])
        self.box = [b[at] for b in box]
        self.chunk = max(1, BATCH // self.w)

    def outer(self) -> np.ndarray:
        """Which walls are of rings that no other ring of the shape holds, or an even number of them: courtyards are left out."""
        out = ~np.isnan(self.walls[0])
        for m in np.flatnonzero(((self.ring != self.ring[:1]) & out).any(axis=0)):
            rows = np.flatnonzero(out[:, m])
            ring = self.ring[rows, m]
            s = np.stack([v[rows, m] for v in self.walls], axis=1)
            for r in np.unique(ring):
                first = min(map(tuple, s[ring == r]))
                x, y = (first[0] + first[2]) / 2, (first[1] + first[3]) / 2
                held = sum(int(right(np.array([x]), np.array([y]), tuple(s[ring == o].T[:, :, None])).sum()) % 2 for o in np.unique(ring) if o != r)
                if held % 2:
                    out[rows[ring == r], m] = False
        return out


def buckets(table: pa.Table) -> Iterator[Bucket]:
    offsets, flat = lists(table, "walls")
    counts = np.diff(offsets)
    kind = np.where(counts <= 8, counts, 2 ** np.ceil(np.log2(np.maximum(counts, 1))).astype(int))
    box = values(table, "min_x", "max_x", "min_y", "max_y")
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        yield Bucket(at, offsets[at], counts[at], flat, box)


def batches(low_x, high_x, low_y, high_y, bucket: Bucket, pad: np.ndarray | float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q) of boxes and shapes of a bucket, widened by ``pad``, that overlap, a batch at a time."""
    x0, x1, y0, y1 = bucket.box
    x0, x1, y0, y1 = x0 - pad, x1 + pad, y0 - pad, y1 + pad
    step = max(1, 1_000_000 // len(bucket.at))
    for k in range(0, len(low_x), step):
        s = slice(k, k + step)
        p, q = np.nonzero((low_x[s, None] <= x1) & (high_x[s, None] >= x0) & (low_y[s, None] <= y1) & (high_y[s, None] >= y0))
        for i in range(0, len(p), bucket.chunk):
            yield p[i : i + bucket.chunk] + k, q[i : i + bucket.chunk]


def segment_batches(s: Segment, bucket: Bucket, wide: np.ndarray | float = 0.0, pad: np.ndarray | float = 0.0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for segments, widened by ``wide``, whose line passes the shape's widened box too."""
    ax, ay, bx, by = s
    wide, pad = np.broadcast_to(wide, ax.shape) + TOUCH * 2, np.broadcast_to(pad, bucket.at.shape)
    x0, x1, y0, y1 = bucket.box
    mx, my, hx, hy = (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2 + pad, (y1 - y0) / 2 + pad
    for p, q in batches(np.minimum(ax, bx) - wide, np.maximum(ax, bx) + wide, np.minimum(ay, by) - wide, np.maximum(ay, by) + wide, bucket, pad):
        dx, dy, more = bx[p] - ax[p], by[p] - ay[p], wide[p]
        off = np.abs(dx * (my[q] - ay[p]) - dy * (mx[q] - ax[p]))
        near = off <= ((hx[q] + more) * np.abs(dy) + (hy[q] + more) * np.abs(dx)) * (1 + 1e-9) + 1e-6
        yield p[near], q[near]


def right(x: np.ndarray, y: np.ndarray, w: Segment) -> np.ndarray:
    """(W, P): whether a ray from a point to the right meets a wall."""
    ax, ay, bx, by = w
    return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)


def gaps(x: np.ndarray, y: np.ndarray, w: Segment) -> np.ndarray:
    """(W, P): distances of points from walls."""
    ax, ay, bx, by = w
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = np.where(size > 0, np.clip(((x - ax) * dx + (y - ay) * dy) / size, 0, 1), 0.0)
    ex, ey = x - ax - t * dx, y - ay - t * dy
    return np.sqrt(ex * ex + ey * ey)


def least(v: np.ndarray) -> np.ndarray:
    return np.fmin.reduce(v, axis=0)


def covered(x: np.ndarray, y: np.ndarray, w: Segment) -> np.ndarray:
    """Whether shapes cover points, their boundary included."""
    return np.bitwise_xor.reduce(right(x, y, w), axis=0) | (least(gaps(x, y, w)) <= TOUCH)


def merged(key: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals in order of key and place, none of which ends behind the next one's end, merged where they overlap or touch."""
    if not len(key):
        return key, low, high
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] > high[:-1] + slack)])
    start = np.flatnonzero(new)
    return key[start], low[start], high[np.concatenate([start[1:] - 1, [len(key) - 1]])]


def inside(s: Segment, w: Segment, box: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, cut, next): the parts of segments inside shapes, in metres along them; as ``spatial.cut_intervals``."""
    ax, ay, bx, by = s
    px, py, qx, qy = w
    dx, dy, ex, ey = bx - ax, by - ay, qx - px, qy - py
    length, reach = np.sqrt(dx * dx + dy * dy), TOUCH * (1 + 1e-9)
    slack, size = length * reach, np.sqrt(ex * ex + ey * ey) * reach
    o1, o2 = dx * (py - ay) - dy * (px - ax), dx * (qy - ay) - dy * (qx - ax)
    hit = (np.minimum(o1, o2) <= slack) & (np.maximum(o1, o2) >= -slack)
    o1, o2 = ex * (ay - py) - ey * (ax - px), ex * (by - py) - ey * (bx - px)
    hit &= (np.minimum(o1, o2) <= size) & (np.maximum(o1, o2) >= -size)
    for a, b, p, q in ((ax, bx, px, qx), (ay, by, py, qy)):
        hit &= (np.minimum(a, b) - TOUCH <= np.maximum(p, q)) & (np.maximum(a, b) + TOUCH >= np.minimum(p, q))
    x0, x1, y0, y1 = box
    held = (s[0] - TOUCH <= x1) & (s[0] + TOUCH >= x0) & (s[1] - TOUCH <= y1) & (s[1] + TOUCH >= y0)
    use = np.flatnonzero(hit.any(axis=0) | held)
    cut = np.where(hit, ((px - ax) * ey - (py - ay) * ex) / (dx * ey - dy * ex) * length, np.nan).take(use, axis=1)
    length = length[use]
    cut[~((cut >= 0) & (cut <= length))] = np.nan
    cuts = np.sort(np.ascontiguousarray(np.concatenate([np.zeros_like(length)[None], length[None], cut]).T), axis=1)
    i, k = np.nonzero(cuts[:, 1:] > cuts[:, :-1])
    low, high, row = cuts[i, k], cuts[i, k + 1], use[i]
    mid = (low + high) / 2 / length[i]
    x, y = s[0][row] + mid * (s[2] - s[0])[row], s[1][row] + mid * (s[3] - s[1])[row]
    held = covered(x, y, of(w, row))
    return merged(row[held], low[held], high[held], TOUCH)


def of(rows: Segment, at: np.ndarray) -> Segment:
    return tuple(v.take(at, axis=-1) for v in rows)


def concat(found: list[tuple[np.ndarray, ...]], kinds: tuple[type, ...]) -> list[np.ndarray]:
    return [np.concatenate([f[k] for f in found]) if found else np.empty(0, t) for k, t in enumerate(kinds)]


def taken(table: pa.Table, name: str, at: np.ndarray) -> pa.ChunkedArray:
    return table.column(name).take(pa.array(at, pa.int64()))


def cut_whole(split: Split, segments: DataFrame, key: str) -> DataFrame:
    """(key, owner, cut, next): the parts of segments inside the whole shapes."""

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        s, found = tuple(values(x, *SEGMENT)), []
        for b in buckets(y):
            for p, q in segment_batches(s, b):
                i, low, high = inside(of(s, p), of(b.walls, q), [v[q] for v in b.box])
                found.append((p[i], b.at[q[i]], low, high))
        p, q, low, high = concat(found, (int, int, float, float))
        return pa.table({key: taken(x, key, p), "owner": taken(y, "owner", q), "cut": low, "next": high})

    kinds = StructType([StructField(key, segments.schema[key].dataType), split.whole.schema["owner"], StructField("cut", DoubleType()), StructField("next", DoubleType())])
    return split.with_segments(segments.select(key, *SEGMENT), run, kinds)
