"""Where a terminal can be tied to the existing network, and where to a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g
from kelvingrid.plans import rules
from kelvingrid.plans.shared import dealt, materialise, parts

from .depth import legs_of
from .spatial import SEGMENT, nearest, overlap_join, point_boxes, reached, segment_boxes, within

#: Weight of missing capacity in the score, metres between samples of a pipe, keys a decimetre apart.
OVERLOAD = 25000 / 107142.86
SPACING = 24.0


def jitter(terminal: Column, candidate: Column, salt: int = 0) -> Column:
    """0 to 2 m from a portable polynomial hash of two integer ids."""
    h = (terminal * 7919 + candidate * 104729 + F.lit(salt * 31 + 17)) % 10007
    return h * 2.0 / 10007


def tie_score(distance: Column, flow: Column, dn: Column, chamber: Column, noise: Column) -> Column:
    return distance + F.greatest(F.lit(0.0), flow - rules.by_dn(dn, "capacity")) * OVERLOAD - F.when(chamber, 5.0).otherwise(0.0) + noise


def samples(pipes: DataFrame, spacing: float = SPACING) -> DataFrame:
    """Points of pipes (id, ax, ay, bx, by, dn) at their ends and every ``spacing`` m: (id, chainage, x, y, dn)."""
    length = g.distance(*[F.col(c) for c in SEGMENT])
    at = F.explode(F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.floor(F.col("length") / spacing)), lambda k: k * spacing), F.array("length"))))
    t = F.coalesce(F.col("chainage") / F.nullif(F.col("length"), F.lit(0.0)), F.lit(0.0))
    return pipes.withColumn("length", length).withColumn("chainage", at).select("id", "chainage", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"), "dn")


def canonical(points: DataFrame, chambers: DataFrame, radius: float = 10.000001, free: int = 3) -> DataFrame:
    """Adds ``chamber``: the nearest chamber (id, x, y, degree) within ``radius`` with at most ``free`` connections, else null."""
    near = within(points.select("id", "x", "y"), chambers.where(F.col("degree") <= free).select("id", "x", "y"), radius, 50.0)
    best = near.groupBy("id").agg(F.min_by("r_id", F.struct("distance", "r_id")).alias("chamber"))
    return points.join(best, "id", "left")


def connections(chambers: DataFrame, pipes: DataFrame, reach: float = 2.0) -> DataFrame:
    """(id, degree): pipes that pass a chamber within ``reach``; an end counts once, a passage twice."""
    near = overlap_join(point_boxes(chambers), segment_boxes(pipes), 100.0, reach)
    seg = [F.col(f"r_{c}") for c in SEGMENT]
    hit = near.where(g.point_segment(F.col("x"), F.col("y"), *seg) < reach)
    end = F.least(g.distance(F.col("x"), F.col("y"), seg[0], seg[1]), g.distance(F.col("x"), F.col("y"), seg[2], seg[3])) < reach
    found = hit.groupBy("id").agg(F.sum(F.when(end, 1).otherwise(2)).alias("degree"))
    return chambers.select("id").join(found, "id", "left").fillna(0, ["degree"])


def sections(points: DataFrame, lines: DataFrame, reach: float = 2.0) -> DataFrame:
    """(id, degree): existing sections at ``points(id, x, y)``, chambers or ties: each of ``lines(id, path)`` that passes within ``reach`` counts by its nearest place.

    Near one end of the line that is one section, elsewhere two; a line that is so short that the place is near both ends counts two.
    """
    legs = legs_of(lines.select(F.col("id").alias("edge"), "path")).join(lines.select(F.col("id").alias("edge"), g.path_length(F.col("path")).alias("whole")), "edge")
    near = overlap_join(point_boxes(points.select("id", "x", "y")), segment_boxes(legs.select("edge", "at", "whole", *SEGMENT)), 100.0, reach)
    seg = [F.col(f"r_{c}") for c in SEGMENT]
    gap = g.point_segment(F.col("x"), F.col("y"), *seg)
    place = F.col("r_at") + g.along(F.col("x"), F.col("y"), *seg) * g.distance(*seg)
    best = near.select("id", F.col("r_edge").alias("line"), F.col("r_whole").alias("whole"), gap.alias("gap"), place.alias("place")).where(F.col("gap") < reach)
    best = best.groupBy("id", "line").agg(F.min(F.struct("gap", "place")).alias("b"), F.max("whole").alias("whole"))
    first, last = F.col("b.place") < reach, F.col("whole") - F.col("b.place") < reach
    found = best.groupBy("id").agg(F.sum(F.when(first != last, 1).otherwise(2)).alias("degree"))
    return points.select("id").join(found, "id", "left").fillna(0, ["degree"])


def tie_points(chambers: DataFrame, pipes: DataFrame) -> DataFrame:
    """Candidates that are the same for all terminals: (id, chamber, chainage, x, y, dn).

    Every chamber; every pipe's far end; its samples, but where a free chamber is within 10 m that chamber stands for the sample.
    """
    s = samples(pipes.select("id", *SEGMENT, "dn"))
    last = Window.partitionBy("id")
    s = s.withColumn("last", F.col("chainage") == F.max("chainage").over(last)).withColumn("id", F.struct("id", "chainage"))
    s = canonical(s, chambers).where(F.col("chamber").isNull() | F.col("last"))
    s = s.select("id.id", F.lit(False).alias("chamber"), "id.chainage", "x", "y", "dn")
    return chambers.select("id", F.lit(True).alias("chamber"), F.lit(-1.0).alias("chainage"), "x", "y", "dn").unionByName(s)


def best_ties(terminals: DataFrame, chambers: DataFrame, pipes: DataFrame, limit: int = 8, rounds: int = 24) -> DataFrame:
    """The ``limit`` candidates of least score of each terminal over the whole network, exact: (id, tie, chamber, chainage, x, y, score, rank).

    ``terminals(id, x, y, flow)``, ``chambers(id, x, y, dn, degree)``, ``pipes(id, ax, ay, bx, by, dn)``. Candidates are the tie points and each
    pipe's point nearest to the terminal; of those of one chamber or pipe in one decimetre the best stays. No candidate beyond a radius
    scores less than the radius - 5, so a terminal whose last score is under that is done, and the rest go on with a radius three times as large.
    """
    points = materialise(tie_points(chambers, pipes))
    left = terminals.select("id", "x", "y", "flow")
    ends = F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))
    span = left.agg(*ends).first(), points.agg(*ends).first()
    if not span[0][4] or not span[1][4]:
        return left.limit(0).select("id", F.lit(None).cast(points.schema["id"].dataType).alias("tie"), F.lit(False).alias("chamber"), *[F.lit(0.0).alias(c) for c in ("chainage", "x", "y", "score")], F.lit(0).alias("rank"))
    lines = pipes.select("id", *SEGMENT, "dn")
    metres = lines.agg(F.sum(g.distance(*[F.col(c) for c in SEGMENT])), F.avg(F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay")))).first()
    wide = max(max(s[1] for s in span) - min(s[0] for s in span), max(s[3] for s in span) - min(s[2] for s in span))
    far = wide * 1.5 + 1
    # within r of a place there are a r ** 2 + b r candidates: three times the limit, and what bonus and jitter may move
    a, b = 3.14 * span[1][4] / (wide + 1) ** 2, 2 * (metres[0] or 0.0) / (wide + 1) ** 2
    radius = min(far, ((b * b + 12 * a * limit) ** 0.5 - b) / (2 * a) + 8)
    # points are segments without length, so that one join finds all candidates
    at = lambda c, d: F.col(c).alias(d)
    every = points.select("id", "chamber", "chainage", at("x", "ax"), at("y", "ay"), at("x", "bx"), at("y", "by"), "dn")
    every = every.unionByName(lines.select("id", F.lit(False).alias("chamber"), F.lit(None).cast("double").alias("chainage"), *SEGMENT, "dn"))
    own = Window.partitionBy("cx", "cy", "id")
    best = own.orderBy("score", "chamber", "tie", "chainage")
    cell = [g.half_up(F.col("px") * 10), g.half_up(F.col("py") * 10)]
    each = Window.partitionBy("cx", "cy", "id", "tie", "chamber", *cell).orderBy("score", "chainage")
    seg = [F.col(f"r_{c}") for c in SEGMENT]
    n, done = span[0][4], None
    for _ in range(rounds):
        many = n * (a * radius**2 + b * radius)
        pairs = reached(left, every, max(radius, (metres[1] or 0.0) / 8), radius, parts(left.sparkSession, many, 200_000))
        pairs = pairs.withColumn("t", g.along(F.col("x"), F.col("y"), *seg)).withColumns({"px": seg[0] + F.col("t") * (seg[2] - seg[0]), "py": seg[1] + F.col("t") * (seg[3] - seg[1])})
        pairs = pairs.withColumn("distance", g.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
        pairs = pairs.select("cx", "cy", "id", "flow", at("r_id", "tie"), at("r_chamber", "chamber"), F.coalesce("r_chainage", F.col("t") * g.distance(*seg)).alias("chainage"), "px", "py", at("r_dn", "dn"), "distance")
        pairs = pairs.withColumn("score", tie_score(F.col("distance"), F.col("flow"), F.col("dn"), F.col("chamber"), jitter(F.col("id"), F.col("tie")))).drop("flow", "dn")
        first = pairs.withColumn("__k", F.row_number().over(each)).where((F.col("__k") == 1) & (F.col("distance") <= radius)).drop("__k", "distance")
        ranked = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
        ranked = ranked.withColumn("__last", F.max(F.when(F.col("rank") == limit, F.col("score"))).over(own))
        ranked = materialise(ranked.select("id", "tie", "chamber", "chainage", F.col("px").alias("x"), F.col("py").alias("y"), "score", "rank", "__last"))
        last = radius >= far
        full = (ranked if last else ranked.where(F.col("__last") < radius - 5)).drop("__last")
        done = full if done is None else done.unionByName(full)
        if last:
            break
        left = left.join(full.where("rank = 1").select("id"), "id", "left_anti")
        n = left.count()
        if not n:
            break
        radius = min(radius * 3, far)
    return done


def nearest_existing(terminals: DataFrame, pipes: DataFrame, chambers: DataFrame) -> DataFrame:
    """(id, distance) of each terminal's nearest existing pipe or chamber."""
    points = chambers.select("id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    every = pipes.select("id", *SEGMENT).unionByName(points).withColumn("id", F.monotonically_increasing_id())
    return nearest(terminals, materialise(every), 1, "id", "id").select("id", "distance")


def centroids(terminals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, plain_x, plain_y): the centres of ``terminals(keys, x, y, flow)``, weighted by flow and plain."""
    mean = lambda c: F.sum(F.col(c) * F.col("flow")) / F.nullif(F.sum("flow"), F.lit(0.0))
    return terminals.groupBy(*keys).agg(F.coalesce(mean("x"), F.avg("x")).alias("x"), F.coalesce(mean("y"), F.avg("y")).alias("y"), F.avg("x").alias("plain_x"), F.avg("y").alias("plain_y"))


def attachments(terminals: DataFrame, ties: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 8) -> DataFrame:
    """The ``limit`` nearest places where each terminal can be attached: ties, plan nodes with fewer than 4 edges, and points of plan edges.

    ``terminals(id, x, y)``. A point of an edge of 4 m or more is the projection clamped to [2, L - 2]; if that is more than 4 m from max(2, L - 12), that is a second
    one. Rows: (id, kind, target, chainage, x, y, distance, rank). The first are nearest points of edges cut by 2 m at both ends, the second are points, so one
    search for the nearest finds both; a second one that doesn't count stands behind its own edge, so twice the number holds enough.
    """
    degree = edges.select(F.explode(F.array("parent", "child")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    point = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("target"), F.lit(0.0).alias("base"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"), F.lit(None).cast("double").alias("back"))
    e = edges.select("child", *SEGMENT, g.distance(*[F.col(c) for c in SEGMENT]).alias("length")).where("length >= 4")
    back = F.greatest(F.lit(2.0), F.col("length") - 12)
    at = lambda c, d: (F.col(f"a{d}") + c / F.col("length") * (F.col(f"b{d}") - F.col(f"a{d}")))
    low, high = F.lit(2.0), F.col("length") - 2
    inner = e.select(F.lit("edge").alias("kind"), F.col("child").alias("target"), low.alias("base"), at(low, "x").alias("ax"), at(low, "y").alias("ay"), at(high, "x").alias("bx"), at(high, "y").alias("by"), F.lit(None).cast("double").alias("back"))
    second = e.select(F.lit("edge").alias("kind"), F.col("child").alias("target"), F.col("length").alias("base"), *SEGMENT, back.alias("back"))
    every = materialise(point(ties, "tie", "id").unionByName(point(nodes.join(degree, "node", "left").where("coalesce(degree, 0) < 4"), "node", "node")).unionByName(inner).unionByName(second).withColumn("n", F.monotonically_increasing_id()))
    t = F.col("back") / F.col("base")
    spot = lambda c: F.when(F.col("back").isNotNull(), F.col(f"a{c}") + t * (F.col(f"b{c}") - F.col(f"a{c}")))
    facts = ("kind", "target", "base", "back")
    places = every.select("n", *[F.coalesce(spot(c[1]), F.col(c)).alias(c) for c in SEGMENT], *facts, F.struct(*SEGMENT).alias("line"))
    found = nearest(terminals, places, 2 * limit, "id", "n", keep=(*facts, "line"))
    found = found.select("id", "distance", "x", "y", *[F.col(f"r_{c}").alias(c) for c in facts], "r_line.*")
    ends = [F.col(c) for c in SEGMENT]
    along = g.along(F.col("x"), F.col("y"), *ends)
    # for a second point: where the clamped projection on its own edge lies
    clamped = F.greatest(F.lit(2.0), F.least(F.col("base") - 2, along * F.col("base")))
    chainage = F.when(F.col("kind") != "edge", 0.0).when(F.col("back").isNotNull(), F.col("back")).otherwise(F.col("base") + along * g.distance(*ends))
    good = found.where(F.col("back").isNull() | (F.abs(clamped - F.col("back")) > 4))
    px, py = (F.coalesce(spot(c), F.col(f"a{c}") + along * (F.col(f"b{c}") - F.col(f"a{c}"))) for c in ("x", "y"))
    good = good.select("id", "kind", "target", chainage.alias("chainage"), px.alias("x"), py.alias("y"), "distance")
    by = Window.partitionBy("id").orderBy(F.round("distance", 9), "kind", "target", F.round("chainage", 6))
    good = dealt(good, "id", parts=parts(terminals.sparkSession, terminals.count() * 2 * limit, 200_000))
    return good.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
