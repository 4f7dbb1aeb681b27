"""Which existing pipes and chambers a plan's ties make too narrow: loads pushed up the existing network, pieces priced as rebuilt.

A tie on a pipe loads it from its upstream end to the tie, and all pipes above it whole; a tie at a chamber loads what is above the chamber. Chambers pass loads on. Which
end of a pipe is upstream follows from where its upstream object lies. Loads are folded by pointers that double their reach, over
the objects at or above a tie only, so levels cost a logarithm of rounds and plans share one look at the network.

``ties(plan, existing_id, existing_type, x, y, flow, dn)`` with the largest diameter of a tie's edges, ``pipes(id, upstream, path, dn, flow)``, ``chambers(id, upstream, dn, x, y)``, ``source(x, y)``. Ids
are unique over pipes and chambers, and what is upstream of an object isn't below it (``graph.reached``, ``graph.cyclic``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g
from kelvingrid.plans import rules
from kelvingrid.plans.shared import dealt, materialise, sorted_join

from . import graph

#: Metres about a chamber within which pipes end at it; the least piece; the least load.
AT, LEAST, LOAD = 2.0, 1e-6, 1e-9


def point_path(x: Column, y: Column, path: Column) -> Column:
    """Distance of a point from a path."""
    n = F.greatest(F.size(path) - 1, F.lit(0))
    legs = F.zip_with(F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n), lambda a, b: g.point_segment(x, y, a.x, a.y, b.x, b.y))
    return F.coalesce(F.array_min(legs), F.when(F.size(path) > 0, g.distance(x, y, F.element_at(path, 1)["x"], F.element_at(path, 1)["y"])))


def plain(path: Column) -> Column:
    return F.transform(path, lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))


def directed(pipes: DataFrame, chambers: DataFrame, source: DataFrame) -> DataFrame:
    """``pipes`` with ``size`` and ``forward``: whether a pipe begins at its upstream end, that is, no farther from its upstream object than it ends."""
    shape = pipes.select(F.col("id").alias("upstream"), plain(F.col("path")).alias("above")).unionByName(chambers.select(F.col("id").alias("upstream"), F.array(F.struct("x", "y")).alias("above")))
    root = source.select(F.array(F.struct("x", "y")).alias("root")).limit(1)
    j = pipes.select("id", "upstream", plain(F.col("path")).alias("path"), "dn", "flow").join(shape, "upstream", "left").join(F.broadcast(root), F.lit(True), "left")  # one source
    up = F.coalesce("above", "root")
    gap = lambda k: point_path(F.element_at("path", k)["x"], F.element_at("path", k)["y"], up)
    return j.select("id", "upstream", "path", "dn", "flow", g.path_length(F.col("path")).alias("size"), F.coalesce(gap(1) <= gap(-1), F.lit(True)).alias("forward"))


def pushed(ties: DataFrame, pipes: DataFrame, chambers: DataFrame) -> DataFrame:
    """(plan, id, load): what ties add to each object above them, all through; their own pipes are not among them."""
    objects = materialise(pipes.select("id", "upstream").unionByName(chambers.select("id", "upstream")).join(pipes.select(F.col("id").alias("upstream")).unionByName(chambers.select(F.col("id").alias("upstream"))), "upstream", "left_semi").select("id", "upstream"), "objects")
    seeds = ties.join(objects, ties["existing_id"] == objects["id"]).groupBy("plan", F.col("upstream").alias("id")).agg(F.sum("flow").alias("load"))
    seeds = materialise(seeds, "loads")
    forest = objects.select(F.col("upstream").alias("parent"), F.col("id").alias("child"))
    marked = graph.below(forest, seeds.select("id", F.lit(1).alias("mark")).distinct(), "mark", F.max).select("id")
    narrow = forest.join(marked.withColumnRenamed("id", "child"), "child", "left_semi").crossJoin(F.broadcast(seeds.select("plan").distinct()))  # a handful of plans
    key = lambda c: F.struct("plan", F.col(c).alias("id"))
    found = graph.below(narrow.select(key("parent").alias("parent"), key("child").alias("child")), seeds.select(key("id").alias("id"), "load"), "load", F.sum).select("id.plan", "id.id", F.col("load"))
    alone = seeds.join(found.select("plan", "id"), ["plan", "id"], "left_anti")  # loaded objects with nothing above them
    return found.unionByName(alone.select("plan", "id", "load"))


def lines(ties: DataFrame, pipes: DataFrame, chambers: DataFrame, source: DataFrame, strict: bool = True) -> DataFrame:
    """(plan, id, low, high, existing_flow, added_flow, flow, existing_dn, dn, length, cost): pieces of pipes, by chainage, that need a larger diameter.

    A piece whose flow no diameter carries is an error or, if not ``strict``, is left out: nothing can be built for it.
    """
    p = materialise(directed(pipes, chambers, source), "directed")
    full = pushed(ties, pipes, chambers).join(p.select("id"), "id", "left_semi")
    own = ties.where("existing_type = 'heat_network'").join(p.select(F.col("id").alias("existing_id"), "path", "size", "forward"), "existing_id")
    at = g.project(F.col("path"), F.col("x"), F.col("y"))
    own = own.select("plan", F.col("existing_id").alias("id"), F.when(F.col("forward"), at).otherwise(F.greatest(F.lit(0.0), F.col("size") - at)).alias("u"), F.col("flow").alias("load"))
    # breakpoints from the upstream end: each tie, and the far end of a pipe that is loaded all through
    points = own.groupBy("plan", "id", "u").agg(F.sum("load").alias("load")).withColumn("whole", F.lit(0.0))
    ends = full.where(F.col("load") > 0).join(p.select("id", "size"), "id").select("plan", "id", F.col("size").alias("u"), F.lit(0.0).alias("load"), F.col("load").alias("whole"))
    points = points.unionByName(ends).groupBy("plan", "id", "u").agg(F.sum("load").alias("load"), F.sum("whole").alias("whole"))
    pipe = Window.partitionBy("plan", "id")
    along = pipe.orderBy("u")
    onward = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    pieces = points.select("plan", "id", F.coalesce(F.lag("u").over(along), F.lit(0.0)).alias("a"), F.col("u").alias("z"), (F.sum("load").over(onward) + F.sum("whole").over(pipe)).alias("added"))
    j = pieces.where((F.col("z") - F.col("a") >= LEAST) & (F.col("added") > LOAD)).join(p.select("id", "dn", "flow", "size", "forward"), "id").withColumn("need", rules.min_dn(F.col("flow") + F.col("added"), strict)).where("need > dn")
    low, high = F.when(F.col("forward"), F.col("a")).otherwise(F.col("size") - F.col("z")), F.when(F.col("forward"), F.col("z")).otherwise(F.col("size") - F.col("a"))
    length = F.col("z") - F.col("a")
    return j.select("plan", "id", low.alias("low"), high.alias("high"), F.col("flow").alias("existing_flow"), F.col("added").alias("added_flow"), (F.col("flow") + F.col("added")).alias("flow"), F.col("dn").alias("existing_dn"), F.col("need").alias("dn"), length.alias("length"), (length * rules.by_dn(F.col("need"), "recon_cost")).alias("cost"))


def legs_of(rows: DataFrame) -> DataFrame:
    """A row for each leg of ``path`` that has a length: (..., at, size, ax, ay, bx, by) with the running length at its start."""
    n = F.greatest(F.size("path") - 1, F.lit(0))
    legs = F.arrays_zip(F.slice("path", F.lit(1), n).alias("a"), F.slice("path", F.lit(2), n).alias("b"), F.slice(g.chainages(F.col("path")), F.lit(1), n).alias("at"))
    rest = [c for c in rows.columns if c != "path"]
    flat = rows.select(*rest, F.explode(legs).alias("leg")).select(*rest, "leg.at", F.col("leg.a.x").alias("ax"), F.col("leg.a.y").alias("ay"), F.col("leg.b.x").alias("bx"), F.col("leg.b.y").alias("by"))
    return flat.withColumn("size", g.distance(*[F.col(k) for k in ("ax", "ay", "bx", "by")])).where("size > 0")


def chambers_of(ties: DataFrame, pipes: DataFrame, chambers: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(plan, id, existing_dn, dn, cost): chambers with ties that need a larger diameter, of their ties' edges, the pipes that end at them, and rebuilt pieces there."""
    from .spatial import within

    tied = ties.where("existing_type = 'heat_chamber'").groupBy("plan", F.col("existing_id").alias("id")).agg(F.max("dn").alias("need"))
    c = chambers.select("id", F.col("dn").alias("own"), "x", "y")
    flat = pipes.select(F.col("id").alias("pipe"), "dn", plain(F.col("path")).alias("path"))
    ends = flat.select("pipe", "dn", "path", F.explode(F.array(F.element_at("path", 1), F.element_at("path", -1))).alias("p")).select("pipe", "dn", "path", "p.x", "p.y")
    met = within(c.join(tied.select("id").distinct(), "id", "left_semi").select("id", "x", "y"), ends, AT, 50.0).where(F.col("distance") < AT).select("id", F.col("r_pipe").alias("pipe"), F.col("r_dn").alias("dn"), F.col("r_path").alias("path"), "x", "y").dropDuplicates(["id", "pipe"])
    here = met.groupBy("id").agg(F.max("dn").alias("pipes"))
    pieces = sorted_join(dealt(rebuilt.select("plan", F.col("id").alias("pipe"), "low", "high", F.col("dn").alias("new")), "pipe"), legs_of(met), "pipe").where("at < high and at + size > low")
    on = lambda c, a, b: F.col(a) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.col("at")) / F.col("size"))) * (F.col(b) - F.col(a))
    part = (on("low", "ax", "bx"), on("low", "ay", "by"), on("high", "ax", "bx"), on("high", "ay", "by"))  # of the leg, between the piece's ends
    near = pieces.where(g.point_segment(F.col("x"), F.col("y"), *part) < AT).groupBy("plan", "id").agg(F.max("new").alias("new"))
    j = sorted_join(sorted_join(sorted_join(tied, c, "id"), here, "id", "left"), near, ["plan", "id"], "left").withColumn("dn", F.greatest("own", "need", "pipes", "new")).where("dn > own")
    return j.select("plan", "id", F.col("own").alias("existing_dn"), "dn", rules.chamber_cost(F.col("dn")).alias("cost"))
