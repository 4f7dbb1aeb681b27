"""Depth profiles: crossings become intervals along an edge, their plateaus agree, and breakpoints cut the edge into costed pieces.

Intervals are rows (edge, low, high, factor, depth, below, minimum): the normal depth is 3 m; ``depth`` under it passes above an
object, over it below one; ``below`` is the depth that passes below the object, null for roads and tracks, which only set a ``minimum``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g
from kelvingrid.plans import rules
from kelvingrid.plans.shared import dealt

from . import intervals as iv
from .legality import of_type
from .spatial import SEGMENT, cut_intervals, islands, overlap_join, segment_boxes

#: Depth of the top and height of utilities; least depth under roads and tracks; half a plateau; ends that crossings don't count at.
TOP = {"gas_pipeline": (2.8, 0.4), "power_cable": (2.7, 0.2)}
LEAST = {"road": 1.0, "tram_tracks": 1.2, "railway": 1.2}
PLATEAU, END, GAP = 2.0, 0.25, 0.5


def _by(kind: Column, table: dict, pick=lambda v: v) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for k, v in table.items():
        out = out.when(kind == k, F.lit(pick(v)))
    return out


def crossing_intervals(crossings: DataFrame, deep: bool = True) -> DataFrame:
    """Intervals of ``crossings(edge, length, dn, type, low, high, object_dn)``: restrictions that may be crossed, and existing pipes (``object_dn`` set).

    ``low`` and ``high`` are where the crossing begins and ends along the edge. Utilities and pipes are passed above if the
    cover and the ramps allow it, else below; a pipe that is crossed within 25 cm of an end is the edge's own tie.
    """
    kind, pipe = F.col("type"), F.col("object_dn").isNotNull()
    utility = kind.isin(*TOP) & ~pipe
    mid = (F.col("low") + F.col("high")) / 2
    top = F.when(pipe, rules.DEPTH).otherwise(_by(kind, TOP, lambda v: v[0]))
    height = F.when(pipe, rules.by_dn(F.col("object_dn"), "pair_height")).otherwise(_by(kind, TOP, lambda v: v[1]))
    gap = F.when(pipe, GAP).otherwise(of_type(kind, "gap"))
    below = F.when(pipe | utility, top + height + gap)
    above = top - gap - rules.by_dn(F.col("dn"), "pair_height")
    depth = F.when(pipe | utility, iv.crossing_depth(above, below, mid, F.col("length"))).otherwise(rules.DEPTH) if deep else F.lit(rules.DEPTH)
    extra = F.when(pipe, PLATEAU).otherwise(of_type(kind, "extra"))
    point = pipe | utility
    rows = crossings.where(~pipe | mid.between(END, F.col("length") - END)).where(pipe | F.coalesce(of_type(kind, "crossable"), F.lit(False)))
    return rows.select(
        "edge", F.greatest(F.lit(0.0), F.when(point, mid).otherwise(F.col("low")) - extra).alias("low"),
        F.least(F.col("length"), F.when(point, mid).otherwise(F.col("high")) + extra).alias("high"),
        F.when(pipe, 1.05).otherwise(of_type(kind, "factor")).alias("factor"), depth.alias("depth"), below.alias("below"),
        F.coalesce(F.when(~pipe, _by(kind, LEAST)), F.lit(0.7)).alias("minimum"),
    )


def crossings_of(edges: DataFrame, walls: DataFrame, pipes: DataFrame, size: float = 200.0) -> DataFrame:
    """Crossings of ``edges(edge, length, dn, path)`` with restrictions ``walls(owner, type, closed, ax, ...)`` and existing ``pipes(id, dn, ax, ...)``.

    A line is crossed in points; an area from where the edge enters it to where it leaves it.
    """
    legs = legs_of(edges)
    named = legs.withColumn("id", F.struct("edge", "at"))
    ends, other = tuple(F.col(c) for c in SEGMENT), tuple(F.col(f"r_{c}") for c in SEGMENT)
    x = F.round(F.col("at") + g.crossing_at(ends, other) * g.distance(*ends), 6)
    boxed = segment_boxes(named)
    lines = overlap_join(boxed, segment_boxes(walls.where("not closed").select("owner", "type", *SEGMENT)), size, 0.0, g.touches(ends, other))
    points = lines.select("edge", F.col("r_type").alias("type"), x.alias("low"), F.lit(None).cast("int").alias("object_dn"), F.col("r_owner").cast("string").alias("owner")).distinct()
    own = overlap_join(boxed, segment_boxes(pipes.select(F.col("id").alias("pipe"), F.col("dn").alias("object_dn"), *SEGMENT)), size, 0.0, g.touches(ends, other))
    own = own.select("edge", F.lit(None).cast("string").alias("type"), x.alias("low"), F.col("r_object_dn").alias("object_dn"), F.col("r_pipe").cast("string").alias("owner")).distinct()
    points = points.unionByName(own).where("low is not null").withColumn("high", F.col("low"))
    areas = walls.where("closed").select("owner", *SEGMENT)
    spans = cut_intervals(named.select("id", *SEGMENT), areas, size).select("id.edge", "owner", (F.col("id.at") + F.col("cut")).alias("low"), (F.col("id.at") + F.col("next")).alias("high"))
    spans = islands(spans, ["edge", "owner"], "low", "high", 1e-6).join(walls.where("closed").select("owner", "type").distinct(), "owner")
    spans = spans.select("edge", "type", "low", F.lit(None).cast("int").alias("object_dn"), F.col("owner").cast("string").alias("owner"), "high")
    return points.unionByName(spans).join(edges.select("edge", "length", "dn"), "edge")


def legs_of(edges: DataFrame) -> DataFrame:
    """Segments of ``edges(edge, path)`` with the running length ``at`` their start: (edge, seq, at, ax, ay, bx, by)."""
    n = F.greatest(F.size("path") - 1, F.lit(0))
    legs = F.arrays_zip(F.slice("path", F.lit(1), n).alias("p"), F.slice("path", F.lit(2), n).alias("q"), F.slice(g.chainages(F.col("path")), F.lit(1), n).alias("at"))
    rows = edges.select("edge", F.posexplode(legs).alias("seq", "s"))
    return rows.select("edge", "seq", "s.at", F.col("s.p.x").alias("ax"), F.col("s.p.y").alias("ay"), F.col("s.q.x").alias("bx"), F.col("s.q.y").alias("by"))


def held(low: float, high: float, depth: float, x: float) -> float:
    """The depth that an interval asks for at x: its own within, ramps of 10 % to the normal depth outside."""
    away = rules.SLOPE * max(0.0, low - x, x - high)
    return min(rules.DEPTH, depth + away) if depth < rules.DEPTH else max(rules.DEPTH, depth - away)


def settled(low: list[float], high: list[float], depth: list[float], below: list[float | None], minimum: list[float]) -> list[float]:
    """Depths of one edge's intervals once none asks another for more.

    A pass above an object gives way to the pass below it where its ramp would meet a deeper plateau, or leave too little
    cover under a road. Plateaus follow their neighbours' ramps: passes above get shallower, passes below deeper.
    """
    depth, n = list(depth), range(len(depth))
    moving = True
    while moving:
        moving = False
        for i in n:
            for j in n:
                if i == j:
                    continue
                if depth[i] < rules.DEPTH:
                    apart = max(0.0, low[i] - high[j], low[j] - high[i])
                    mixed = depth[j] > rules.DEPTH and apart < (depth[j] - depth[i]) / rules.SLOPE - 1e-8
                    near = max(low[j], min(high[j], (low[i] + high[i]) / 2))
                    bare = below[j] is None and held(low[i], high[i], depth[i], near) < minimum[j] - 1e-8
                    if mixed or bare:
                        depth[i] = below[i]
                        moving = True
                        continue
                if below[i] is None:
                    continue
                asked = [held(low[j], high[j], depth[j], x) for x in (low[i], high[i])]
                if depth[i] < rules.DEPTH and min(asked) < depth[i] - 1e-8:
                    depth[i], moving = min(asked), True
                elif depth[i] > rules.DEPTH and max(asked) > depth[i] + 1e-8:
                    depth[i], moving = max(asked), True
    return depth


def settled_together(low: np.ndarray, high: np.ndarray, depth: np.ndarray, below: np.ndarray, minimum: np.ndarray) -> np.ndarray:
    """``settled`` for many edges with the same number of intervals, a row for each edge (``below`` NaN for none): the same steps in the same order, edge by edge until it rests."""

    def at(i: int, x: np.ndarray) -> np.ndarray:
        away = rules.SLOPE * np.maximum(0.0, np.maximum(lo[:, i] - x, x - hi[:, i]))
        return np.where(d[:, i] < rules.DEPTH, np.minimum(rules.DEPTH, d[:, i] + away), np.maximum(rules.DEPTH, d[:, i] - away))

    depth, n, left = depth.copy(), range(depth.shape[1]), np.arange(len(depth))
    while len(left):
        lo, hi, d, under, least = low[left], high[left], depth[left], below[left], minimum[left]
        moved = np.zeros(len(left), bool)
        for i in n:
            for j in n:
                if i == j:
                    continue
                apart = np.maximum(0.0, np.maximum(lo[:, i] - hi[:, j], lo[:, j] - hi[:, i]))
                mixed = (d[:, j] > rules.DEPTH) & (apart < (d[:, j] - d[:, i]) / rules.SLOPE - 1e-8)
                near = np.maximum(lo[:, j], np.minimum(hi[:, j], (lo[:, i] + hi[:, i]) / 2))
                bare = np.isnan(under[:, j]) & (at(i, near) < least[:, j] - 1e-8)
                give = (d[:, i] < rules.DEPTH) & (mixed | bare)
                if np.isnan(under[give, i]).any():
                    raise ValueError("an interval that passes above its object has no depth below it")
                ask = [at(j, lo[:, i]), at(j, hi[:, i])]
                up, down = np.minimum(*ask), np.maximum(*ask)
                rest = ~give & ~np.isnan(under[:, i])
                up_, down_ = rest & (d[:, i] < rules.DEPTH) & (up < d[:, i] - 1e-8), rest & (d[:, i] > rules.DEPTH) & (down > d[:, i] + 1e-8)
                d[:, i] = np.select([give, up_, down_], [under[:, i], up, down], d[:, i])
                moved |= give | up_ | down_
        depth[left] = d
        left = left[moved]
    return depth


def reconciled(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Intervals with ``depth`` agreed upon edge by edge, in the order of (low, high, depth). An edge's intervals are few; many edges share a group, and those of one number of intervals are settled at once."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        values = {c: group[c].to_numpy(dtype=float, na_value=np.nan) for c in ("low", "high", "depth", "below", "minimum")}
        key = pd.factorize(group["key"])[0]
        order = np.lexsort((values["depth"], values["high"], values["low"], key))
        low, high, depth, below, minimum = (v[order] for v in values.values())
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        size = np.diff(np.r_[first, len(order)])
        for n in np.unique(size[size > 1]).tolist():
            at = first[size == n]
            if len(at) >= 8:
                place = at[:, None] + np.arange(n)
                depth[place] = settled_together(low[place], high[place], depth[place], below[place], minimum[place])
                continue
            for a in at.tolist():
                part = [v[a : a + n].tolist() for v in (low, high, depth, below, minimum)]
                part[3] = [None if v != v else v for v in part[3]]
                depth[a : a + n] = settled(*part)
        return group.iloc[order].drop(columns="__group").assign(depth=depth)

    parts = parts or 4 * max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    named = rows.withColumn("key", F.col("edge").cast("string"))  # an edge may be a struct
    grouped = dealt(named.withColumn("__group", F.pmod(F.xxhash64("key"), F.lit(parts))), "__group", parts=parts)
    return grouped.groupBy("__group").applyInPandas(settle, named.schema).drop("key")


def pieces(edges: DataFrame, found: DataFrame, deep: bool = True) -> DataFrame:
    """(edge, dn, at, to, factor, from_depth, to_depth, cost): ``edges(edge, length, dn)`` cut at every change of factor and slope.

    Breakpoints are the intervals' ends, in the depth mode also the ends of their ramps and the places where two ramps cross.
    """
    e = edges.select("edge", "length", "dn")
    ramp = F.abs(F.col("depth") - rules.DEPTH) / rules.SLOPE if deep else F.lit(0.0)
    i = found.join(e.select("edge", "length"), "edge")
    inner = F.array("low", "high", F.greatest(F.lit(0.0), F.col("low") - ramp), F.least(F.col("length"), F.col("high") + ramp))
    ends = e.select("edge", F.explode(F.array(F.lit(0.0), F.col("length"))).alias("at")).unionByName(i.select("edge", F.explode(inner).alias("at"))).distinct()
    along = Window.partitionBy("edge").orderBy("at")
    if deep:
        numbered = found.select("edge", "low", "high", "depth").withColumn("n", F.row_number().over(Window.partitionBy("edge").orderBy("low", "high", "depth")))
        other = numbered.select("edge", *[F.col(c).alias(f"o_{c}") for c in ("low", "high", "depth", "n")])
        span = ends.withColumn("to", F.lead("at").over(along)).where("to > at")
        pairs = span.join(numbered, "edge").join(other, "edge").where("n < o_n")
        d = lambda x: iv.demand_at(F.col("low"), F.col("high"), F.col("depth"), x) - iv.demand_at(F.col("o_low"), F.col("o_high"), F.col("o_depth"), x)
        pairs = pairs.withColumn("da", d(F.col("at"))).withColumn("db", d(F.col("to"))).where(F.col("da") * F.col("db") < 0)
        ends = ends.unionByName(pairs.select("edge", (F.col("at") + (F.col("to") - F.col("at")) * F.col("da") / (F.col("da") - F.col("db"))).alias("at"))).distinct()
    cut = ends.withColumn("to", F.lead("at").over(along)).where(F.col("to") - F.col("at") >= 1e-7)
    j = cut.join(found, "edge", "left")
    mid = (F.col("at") + F.col("to")) / 2
    ask = lambda x: iv.demand_at(F.col("low"), F.col("high"), F.col("depth"), x)
    j = j.groupBy("edge", "at", "to").agg(
        F.coalesce(F.max(F.when(mid.between(F.col("low"), F.col("high")), F.greatest(F.col("factor"), F.lit(1.0)))), F.lit(1.0)).alias("factor"),
        *[f(ask(F.col(x))).alias(f"{n}_{x}") for x in ("at", "to") for n, f in (("deep", F.max), ("high", F.min))],
    )
    level = lambda x: F.when(F.col(f"deep_{x}") > rules.DEPTH + 1e-9, F.col(f"deep_{x}")).otherwise(F.coalesce(F.least(F.col(f"high_{x}"), F.lit(rules.DEPTH)), F.lit(rules.DEPTH)))
    out = j.withColumn("from_depth", level("at") if deep else F.lit(rules.DEPTH)).withColumn("to_depth", level("to") if deep else F.lit(rules.DEPTH)).join(e.select("edge", "dn"), "edge")
    priced = iv.piece_cost(out, rules.by_dn(F.col("dn"), "new_cost"), F.col("from_depth"), F.col("to_depth"))
    return priced.select("edge", "dn", "at", "to", "factor", "from_depth", "to_depth", "cost")


def profile_violations(parts: DataFrame) -> DataFrame:
    """(edge, at, rule) of pieces that break a depth rule: normal depth at both ends, 0.7 m of cover, no jumps, slopes of 10 % at most."""
    w = Window.partitionBy("edge").orderBy("at")
    rows = parts.withColumns({"before": F.lag("to_depth").over(w), "after": F.lead("at").over(w)})
    low = F.least("from_depth", "to_depth")
    ends = (F.col("before").isNull() & (F.abs(F.col("from_depth") - rules.DEPTH) > 1e-6)) | (F.col("after").isNull() & (F.abs(F.col("to_depth") - rules.DEPTH) > 1e-6))
    found = F.array_compact(F.array(
        F.when(ends, "end"), F.when(low < 0.7 - 1e-8, "shallow"), F.when(F.abs(F.col("from_depth") - F.col("before")) > 1e-6, "jump"),
        F.when(F.abs(F.col("to_depth") - F.col("from_depth")) > 0.100001 * (F.col("to") - F.col("at")), "slope"),
    ))
    return rows.select("edge", "at", F.explode(found).alias("rule"))


def cover_violations(parts: DataFrame, crossings: DataFrame) -> DataFrame:
    """(edge, at, rule): pieces too shallow under a road or tracks, ``crossings(edge, type, low, high)``."""
    under = crossings.where(F.col("type").isin(*LEAST)).withColumn("least", _by(F.col("type"), LEAST))
    j = parts.join(under, "edge").where((F.col("at") <= F.col("high")) & (F.col("to") >= F.col("low")) & (F.least("from_depth", "to_depth") < F.col("least") - 1e-8))
    return j.select("edge", "at", F.lit("cover").alias("rule")).distinct()


def crossing_violations(parts: DataFrame, crossings: DataFrame) -> DataFrame:
    """(edge, at, rule): crossings ``(edge, x, length, dn, top, height, gap)`` without room above or below, or without a plateau of 2 m to either side."""
    c = crossings.where(F.col("x").between(END, F.col("length") - END))
    near = (F.col("x") < PLATEAU) | (F.col("x") > F.col("length") - PLATEAU)
    short = c.where(near).select("edge", F.col("x").alias("at"), F.lit("plateau-room").alias("rule"))
    p = parts.select("edge", F.col("at").alias("p_at"), F.col("to").alias("p_to"), "from_depth", "to_depth")
    j = c.where(~near).join(p, "edge")
    share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("p_at")) / (F.col("p_to") - F.col("p_at"))))
    value = lambda x: F.col("from_depth") + (F.col("to_depth") - F.col("from_depth")) * share(x)
    at = lambda x: F.coalesce(F.min_by(F.when(x <= F.col("p_to") + 1e-8, value(x)), F.when(x <= F.col("p_to") + 1e-8, F.col("p_at"))), F.max_by("to_depth", "p_at"))
    x = F.col("x")
    vertices = F.collect_list(F.when((F.col("p_to") > x - PLATEAU) & (F.col("p_to") < x + PLATEAU), F.col("to_depth")))
    keys = ["edge", "x", "dn", "top", "height", "gap"]
    rows = j.groupBy(*keys).agg(at(x).alias("depth"), at(x - PLATEAU).alias("one"), at(x + PLATEAU).alias("two"), vertices.alias("vertices"))
    above = F.col("depth") + rules.by_dn(F.col("dn"), "pair_height") <= F.col("top") - F.col("gap") + 1e-6
    below = F.col("depth") >= F.col("top") + F.col("height") + F.col("gap") - 1e-6
    bent = (F.abs(F.col("one") - F.col("depth")) > 1e-6) | (F.abs(F.col("two") - F.col("depth")) > 1e-6) | F.exists("vertices", lambda v: F.abs(v - F.col("depth")) > 1e-6)
    found = F.array_compact(F.array(F.when(~above & ~below, "clearance"), F.when(bent, "plateau")))
    return rows.select("edge", F.col("x").alias("at"), F.explode(found).alias("rule")).unionByName(short)
