"""The existing network's topology: vertices within 2 m are one, distances from the source give missing upstreams, pipes give chambers' diameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvingrid.plans.shared import materialise

from . import graph
from .spatial import within

#: Fixed value: metres within which ends are one vertex.
SNAP = 2.0


def snapped(points: DataFrame) -> DataFrame:
    """(key, vertex) of ``points(key, order, x, y)``: the first point, by ``order``, of those within 2 m that isn't itself drawn to an earlier one.

    Each round settles the points without an undecided earlier neighbour; a chain of n near points takes n rounds at worst, real ends two or three.
    """
    at = points.select(F.col("order").alias("id"), "x", "y")
    near = within(at, at, SNAP).where((F.col("r_id") < F.col("id")) & (F.col("distance") < SNAP)).select("id", F.col("r_id").alias("before"))
    near = materialise(near)
    head = materialise(at.select("id").join(near.select("id").distinct(), "id", "left_anti"))  # nobody before them
    drawn = None
    rest = materialise(near)
    while not rest.isEmpty():
        to = rest.join(head.select(F.col("id").alias("before")), "before").groupBy("id").agg(F.min("before").alias("to"))
        # settled only if no earlier neighbour that could still become a head comes before
        open_ = rest.join(head.select(F.col("id").alias("before")), "before", "left_anti")
        if drawn is not None:
            open_ = open_.join(drawn.select(F.col("id").alias("before")), "before", "left_anti")
        sure = materialise(to.join(open_.groupBy("id").agg(F.min("before").alias("maybe")), "id", "left").where("maybe is null or to < maybe").select("id", "to"))
        drawn = sure if drawn is None else materialise(drawn.unionByName(sure))
        left = rest.join(drawn.select("id"), "id", "left_anti")
        # points all of whose earlier neighbours were drawn elsewhere are heads themselves
        alive = left.join(drawn.select(F.col("id").alias("before")), "before", "left_anti").select("id").distinct()
        head = materialise(head.unionByName(left.select("id").distinct().join(alive, "id", "left_anti")))
        rest = materialise(left.join(head.select("id"), "id", "left_anti"))
    found = at.select("id") if drawn is None else at.select("id").join(drawn, "id", "left")
    found = found.withColumn("vertex", F.coalesce("to", "id") if drawn is not None else F.col("id"))
    return points.join(found.select(F.col("id").alias("order"), "vertex"), "order").select("key", "vertex")


class Disconnected(ValueError):
    """Pipes or chambers that name no upstream and that the network doesn't connect to the source; ``ids`` are the first of them."""

    def __init__(self, kind: str, ids: list[str]):
        super().__init__(f"{kind} disconnected from the source: {', '.join(ids)}")
        self.ids = ids


def connected(kind: str, rows: DataFrame) -> DataFrame:
    """Raises if one of ``rows(id, upstream)`` still has no upstream."""
    lost = [str(r["id"]) for r in rows.where("upstream is null").select("id").orderBy("id").limit(10).collect()]
    if lost:
        raise Disconnected(kind, lost)
    return rows


def resolve(source: DataFrame, pipes: DataFrame, chambers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pipes, chambers) with ``upstream`` filled in and chambers' missing ``dn`` inferred.

    ``source(id, x, y)``, ``pipes(id, upstream, dn, length, ax, ay, bx, by)`` with their end points, ``chambers(id, upstream, dn, x, y)``. A pipe hangs on the end that is
    nearer to the source along the network: on the source, else on the chamber there, else on the pipe by which that end is reached. A chamber hangs
    on the pipe by which it is reached. A chamber without a diameter takes the largest of the pipes at it, 200 without any. A pipe or chamber that has no
    upstream and that no pipes connect to the source is an error (``Disconnected``).
    """
    order = F.struct
    tag = lambda k, c, *at: order(F.lit(k).alias("k"), F.col(c).cast("string").alias("id"), F.lit(at[2]).alias("e")).alias("key")
    points = (
        source.select(tag(0, "id", 0, 0, 0), "x", "y").unionByName(pipes.select(tag(1, "id", 0, 0, 0), F.col("ax").alias("x"), F.col("ay").alias("y")))
        .unionByName(pipes.select(tag(1, "id", 0, 0, 1), F.col("bx").alias("x"), F.col("by").alias("y"))).unionByName(chambers.select(tag(2, "id", 0, 0, 0), "x", "y"))
    )
    points = materialise(points)
    numbered = materialise(points.withColumn("order", F.col("key")))
    v = materialise(snapped(numbered).withColumn("v", F.xxhash64("vertex")))
    of = lambda k, e: v.where((F.col("key.k") == k) & (F.col("key.e") == e)).select(F.col("key.id").alias("id"), "v")
    text = F.col("id").cast("string")
    legs = pipes.select(text.alias("id"), "dn", "length").join(of(1, 0).withColumnRenamed("v", "a"), "id").join(of(1, 1).withColumnRenamed("v", "b"), "id")
    legs = materialise(legs)
    root = of(0, 0).select(F.col("v").alias("id"))
    best = graph.shortest(legs.select("a", "b", "length"), root).select("id", "distance")
    # the pipe by which each vertex is reached: of those that give its distance the first
    both = legs.select("id", "length", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(legs.select("id", "length", F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v")
    reach = both.join(best.select(F.col("id").alias("u"), F.col("distance").alias("du")), "u").join(best.select(F.col("id").alias("v"), F.col("distance").alias("dv")), "v")
    parent = reach.where(F.abs(F.col("du") + F.col("length") - F.col("dv")) <= 1e-8 * (1 + F.col("dv"))).where("du < dv").groupBy("v").agg(F.min("id").alias("parent"))
    here = of(2, 0).groupBy("v").agg(F.max("id").alias("chamber"))
    facts = best.withColumnRenamed("id", "v").join(parent, "v", "left").join(here, "v", "left").crossJoin(F.broadcast(source.select(F.col("id").cast("string").alias("source")).limit(1)))
    facts = materialise(facts.select("v", "distance", F.when(F.col("distance") == 0, F.col("source")).otherwise(F.coalesce("chamber", "parent")).alias("pipe_up"), F.when(F.col("distance") == 0, F.col("source")).otherwise(F.col("parent")).alias("chamber_up")))
    far = F.lit(float("inf"))
    end = lambda n: facts.select(F.col("v").alias(n), F.col("distance").alias(f"d{n}"), F.col("pipe_up").alias(f"up{n}"))
    hung = legs.join(end("a"), "a", "left").join(end("b"), "b", "left").select("id", F.when(F.coalesce("da", far) <= F.coalesce("db", far), F.col("upa")).otherwise(F.col("upb")).alias("found"))
    out_pipes = pipes.withColumn("__id", text).join(hung.withColumnRenamed("id", "__id"), "__id", "left").withColumn("upstream", F.coalesce("upstream", "found")).drop("__id", "found")
    wide = legs.select(F.explode(F.array("a", "b")).alias("v"), "dn").groupBy("v").agg(F.max("dn").alias("most"))
    own = of(2, 0).join(facts.select("v", "chamber_up"), "v", "left").join(wide, "v", "left").select(F.col("id").alias("__id"), "chamber_up", "most")
    out = chambers.withColumn("__id", text).join(own, "__id", "left").withColumn("upstream", F.coalesce("upstream", "chamber_up")).withColumn("dn", F.coalesce("dn", "most", F.lit(200)))
    return connected("pipe", materialise(out_pipes)), connected("chamber", materialise(out.drop("__id", "chamber_up", "most")))
