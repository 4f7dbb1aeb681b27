"""How different plans are, and the choice of a small portfolio of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g

from .graph import below, union

CELL = 12.0


def corridor_cells(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct cells of 12 m along segments (keys, ax, ay, bx, by), sampled at most 12 m apart."""
    length = g.distance(*[F.col(c) for c in ("ax", "ay", "bx", "by")])
    steps = F.greatest(F.lit(1), F.ceil(length / CELL)).cast("int")
    out = segments.select(*keys, "ax", "ay", "bx", "by", steps.alias("steps")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    t = F.col("k") / F.col("steps")
    return out.select(*keys, F.floor((F.col("ax") + t * (F.col("bx") - F.col("ax"))) / CELL).alias("cell_x"), F.floor((F.col("ay") + t * (F.col("by") - F.col("ay"))) / CELL).alias("cell_y")).distinct()


def tie_items(nodes: DataFrame) -> DataFrame:
    """(plan, item): each tie's existing object, by type and id."""
    return nodes.where("kind = 'TIE_IN'").select("plan", F.concat_ws(":", "existing_type", "existing_id").alias("item")).distinct()


def topology_items(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, item): for each root its existing object and all terminals below it; for each branch the groups of terminals below its children.

    ``nodes(plan, node, kind, oks_id, existing_type, existing_id)``, ``edges(plan, parent, child)``. A list holds the terminals of one root, not of a plan table.
    """
    key = lambda c: F.struct("plan", F.col(c).cast("string").alias("node"))
    ends = nodes.where("kind = 'TERMINAL'").select(key("node").alias("id"), F.array(F.col("oks_id").cast("string")).alias("below"))
    inner = below(edges.select(key("parent").alias("parent"), key("child").alias("child")), ends, "below", union)
    under = inner.unionByName(ends.join(inner, "id", "left_anti"))
    below_ = under.select(F.col("id").alias("anc"), F.concat_ws(",", F.sort_array("below")).alias("below"))
    roots = nodes.where("kind = 'TIE_IN'").select(key("node").alias("anc"), F.concat_ws(":", "existing_type", "existing_id").alias("tie")).join(below_, "anc", "left")
    items = roots.select(F.col("anc.plan").alias("plan"), F.concat(F.col("tie"), F.lit("=>"), F.coalesce("below", F.lit(""))).alias("item"))
    groups = edges.select("plan", F.col("parent").cast("string").alias("parent"), key("child").alias("anc")).join(below_, "anc", "left")
    branches = groups.groupBy("plan", "parent").agg(F.count(F.lit(1)).alias("n"), F.concat_ws("/", F.sort_array(F.collect_list(F.coalesce("below", F.lit(""))))).alias("groups")).where("n > 1")
    return items.unionByName(branches.select("plan", F.concat(F.lit("branch:"), F.col("groups")).alias("item"))).distinct()


def set_distances(members: DataFrame, plan: str, item: str) -> DataFrame:
    """Jaccard distances of all pairs of plans (a < b) from rows (plan, item), by counts: no set is gathered."""
    m = members.select(F.col(plan).alias("plan"), F.col(item).alias("item")).distinct()
    n = m.groupBy("plan").agg(F.count(F.lit(1)).alias("n"))
    both = m.alias("l").join(m.alias("r"), "item").where("l.plan < r.plan").groupBy(F.col("l.plan").alias("a"), F.col("r.plan").alias("b")).agg(F.count(F.lit(1)).alias("both"))
    pairs = n.select(F.col("plan").alias("a"), F.col("n").alias("na")).join(n.select(F.col("plan").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", (1 - F.coalesce("both", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("both", F.lit(0)))).alias("distance"))


def materially_different(ties: Column, topology: Column, corridor: Column) -> Column:
    return (ties >= 0.15) | (topology >= 0.15) | (corridor >= 0.25)


def best_coverage(plans: DataFrame, group: list[str], missing: str = "unconnected") -> DataFrame:
    """The plans of each group with the fewest unconnected terminals."""
    return plans.withColumn("__least", F.min(missing).over(Window.partitionBy(*group))).where(F.col(missing) == F.col("__least")).drop("__least")


def portfolio(plans: DataFrame, different: DataFrame) -> DataFrame:
    """The best set of up to three plans (plan, score), all pairs of it in ``different(a, b)``: (size, best, total, p1, p2, p3).

    More plans are better, then a lower best score, then a lower sum. The plans are few: an archive of one run.
    """
    p = plans.select("plan", "score")
    d = different.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = p.select(F.lit(1).alias("size"), F.col("score").alias("best"), F.col("score").alias("total"), F.col("plan").alias("p1"), F.lit(None).cast("long").alias("p2"), F.lit(None).cast("long").alias("p3"))
    s = lambda n: p.select(F.col("plan").alias(f"p{n}"), F.col("score").alias(f"s{n}"))
    pair = d.select(F.col("a").alias("p1"), F.col("b").alias("p2")).join(s(1), "p1").join(s(2), "p2")
    two = pair.select(F.lit(2).alias("size"), F.least("s1", "s2").alias("best"), (F.col("s1") + F.col("s2")).alias("total"), "p1", "p2", F.lit(None).cast("long").alias("p3"))
    third = pair.join(d.select(F.col("a").alias("p2"), F.col("b").alias("p3")), "p2").join(d.select(F.col("a").alias("p1"), F.col("b").alias("p3")), ["p1", "p3"]).join(s(3), "p3")
    three = third.select(F.lit(3).alias("size"), F.least("s1", "s2", "s3").alias("best"), (F.col("s1") + F.col("s2") + F.col("s3")).alias("total"), "p1", "p2", "p3")
    order = [F.desc("size"), F.round("best", 9), F.round("total", 9), "p1", F.asc_nulls_first("p2"), F.asc_nulls_first("p3")]
    return one.unionByName(two).unionByName(three).orderBy(*order).limit(1)


def ranked_variants(plans: DataFrame, mode: str) -> DataFrame:
    """Adds ``rank`` by score and ``variant_id`` such as 2d_1."""
    w = Window.partitionBy(mode).orderBy("score", "plan")
    return plans.withColumn("rank", F.row_number().over(w)).withColumn("variant_id", F.concat(F.when(F.col(mode) == "DEPTH", "3d_").otherwise("2d_"), F.col("rank").cast("string")))
