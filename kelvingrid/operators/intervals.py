"""Interval algebra along a path: breakpoints, covering factors, depth demands and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvingrid.plans import rules


def pieces(edges: DataFrame, intervals: DataFrame, key: str = "edge") -> DataFrame:
    """Cut ``edges(edge, length)`` at the ends of ``intervals(edge, low, high)``: (edge, at, to)."""
    ends = edges.select(key, F.explode(F.array(F.lit(0.0), F.col("length"))).alias("at")).unionByName(intervals.select(key, F.explode(F.array("low", "high")).alias("at")))
    ends = ends.join(edges.select(key, "length"), key).where("at between 0 and length").select(key, "at").distinct()
    return ends.withColumn("to", F.lead("at").over(Window.partitionBy(key).orderBy("at"))).where("to > at")


def stabbed(parts: DataFrame, intervals: DataFrame, key: str = "edge", outside: float = 1.0) -> DataFrame:
    """Adds ``factor``: the largest of the intervals that hold a piece's midpoint, ends included."""
    p, i = parts.alias("p"), intervals.alias("i")
    mid = (F.col("p.at") + F.col("p.to")) / 2
    hit = p.join(i, (F.col(f"p.{key}") == F.col(f"i.{key}")) & mid.between(F.col("i.low"), F.col("i.high")), "left")
    return hit.groupBy(*[F.col(f"p.{c}") for c in parts.columns]).agg(F.coalesce(F.max("i.factor"), F.lit(outside)).alias("factor"))


def crossing_depth(above: Column, below: Column, chainage: Column, length: Column) -> Column:
    """The depth at a crossing: above it if 0.7 m stay and the ramps fit on the shorter side, else below it."""
    room = F.least(chainage, length - chainage) >= 2 + (rules.DEPTH - above) / rules.SLOPE
    return F.when((above >= 0.7) & room, above).otherwise(below)


def demand_at(low: Column, high: Column, depth: Column, x: Column) -> Column:
    """Depth that a demand holds at x: its own within, ramps of 10 % to the normal depth outside."""
    away = F.greatest(F.lit(0.0), low - x, x - high) * rules.SLOPE
    return F.when(depth > rules.DEPTH, F.greatest(F.lit(rules.DEPTH), depth - away)).otherwise(F.least(F.lit(rules.DEPTH), depth + away))


def profile(points: DataFrame, demands: DataFrame, key: str = "edge") -> DataFrame:
    """Adds ``depth`` to ``points(edge, x)``: the deepest demand (edge, low, high, depth) wins over any shallow one."""
    p, d = points.alias("p"), demands.alias("d")
    at = demand_at(F.col("d.low"), F.col("d.high"), F.col("d.depth"), F.col("p.x"))
    j = p.join(d, F.col(f"p.{key}") == F.col(f"d.{key}"), "left").groupBy(*[F.col(f"p.{c}") for c in points.columns]).agg(F.max(at).alias("deep"), F.min(at).alias("high"))
    depth = F.when(F.col("deep") > rules.DEPTH, F.col("deep")).otherwise(F.coalesce("high", F.lit(rules.DEPTH)))
    return j.withColumn("depth", depth).drop("deep", "high")


def slope_violations(points: DataFrame, key: str = "edge") -> DataFrame:
    """Rows of ``points(edge, x, depth)`` that break a rule: ends at 3 m, never under 0.7 m, slope at most 10 %."""
    w = Window.partitionBy(key).orderBy("x")
    rows = points.withColumns({"px": F.lag("x").over(w), "pd": F.lag("depth").over(w), "first": F.row_number().over(w) == 1, "last": F.lead("x").over(w).isNull()})
    steep = F.col("px").isNotNull() & (F.abs(F.col("depth") - F.col("pd")) > 0.100001 * (F.col("x") - F.col("px")))
    ends = (F.col("first") | F.col("last")) & (F.abs(F.col("depth") - rules.DEPTH) > 1e-6)
    rule = F.when(ends, "end").when(F.col("depth") < 0.7 - 1e-8, "shallow").when(steep, "slope")
    return rows.withColumn("rule", rule).where("rule is not null").select(key, "x", "depth", "rule")


def piece_cost(parts: DataFrame, price: Column, from_depth: Column | None = None, to_depth: Column | None = None) -> DataFrame:
    """Adds ``cost`` to costed pieces: price, factor, and the mean of the depth factors at both ends."""
    deep = F.lit(1.0) if from_depth is None else (rules.depth_factor(from_depth) + rules.depth_factor(to_depth)) / 2
    return parts.withColumn("cost", (F.col("to") - F.col("at")) * price * F.col("factor") * deep)
