"""Prices and scores of plans, aggregated from their nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelvingrid.plans import rules


def node_diameters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, node, dn): the largest diameter of the edges at each node."""
    ends = edges.select("plan", F.explode(F.array("parent", "child")).alias("node"), "dn")
    return nodes.select("plan", "node").join(ends, ["plan", "node"], "left").groupBy("plan", "node").agg(F.max("dn").alias("dn"))


def chamber_costs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, cost): new chambers (kind CHAMBER, or TIE_IN on a pipe), priced by the largest diameter at them; 0 for one without an edge."""
    new = nodes.where("kind = 'CHAMBER' or (kind = 'TIE_IN' and existing_type <> 'heat_chamber')")
    return node_diameters(new, edges).groupBy("plan").agg(F.sum(F.when(F.col("dn").isNull(), 0.0).otherwise(rules.chamber_cost(F.col("dn")))).alias("cost"))


def tie_costs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan, cost): 5 million for each new edge out of an existing chamber."""
    roots = nodes.where("kind = 'TIE_IN' and existing_type = 'heat_chamber'").select("plan", F.col("node").alias("parent"))
    return edges.join(roots, ["plan", "parent"], "left_semi").groupBy("plan").agg((F.count(F.lit(1)) * rules.CHAMBER_TIE).alias("cost"))


def penalties(terminals: DataFrame, nodes: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan, unconnected, cost): the terminals that a plan leaves out: all of them, less those that it has; no plan is paired with each terminal."""
    price = rules.penalty(F.col("flow"))
    every = terminals.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(price), F.lit(0.0)).alias("all"))
    have = nodes.where("oks_id is not null").select("plan", "oks_id").distinct().join(terminals.select("oks_id", "flow"), "oks_id")
    have = have.groupBy("plan").agg(F.count(F.lit(1)).alias("h"), F.sum(price).alias("paid"))
    rows = plans.select("plan").join(have, "plan", "left").crossJoin(F.broadcast(every))  # one row
    left = (F.col("n") - F.coalesce("h", F.lit(0))).alias("unconnected")
    return rows.select("plan", left, (F.col("all") - F.coalesce("paid", F.lit(0.0))).alias("cost")).where("unconnected > 0")


def totals(plans: DataFrame, nodes: DataFrame, edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """(plan, construction, chambers, ties, penalty, unconnected, length, cost, score) of every plan.

    ``edges(plan, parent, child, dn, length, special)``; ``special`` is the mean cost factor of the edge. Rebuilding the existing network is not counted.
    """
    base = edges.groupBy("plan").agg(F.sum("length").alias("length"), F.sum(F.col("length") * rules.by_dn(F.col("dn"), "new_cost") * F.col("special")).alias("construction"))
    out = plans.select("plan").join(base, "plan", "left").join(chamber_costs(nodes, edges).withColumnRenamed("cost", "chambers"), "plan", "left")
    out = out.join(tie_costs(nodes, edges).withColumnRenamed("cost", "ties"), "plan", "left").join(penalties(terminals, nodes, plans).withColumnRenamed("cost", "penalty"), "plan", "left")
    out = out.fillna(0.0, ["length", "construction", "chambers", "ties", "penalty"]).fillna(0, ["unconnected"])
    cost = F.col("construction") + F.col("chambers") + F.col("ties") + F.col("penalty")
    return out.withColumn("cost", cost).withColumn("score", rules.score(F.col("cost"), F.col("length")))


def reconstruction(pipes: DataFrame, ties: DataFrame, upstream: DataFrame) -> DataFrame:
    """Pieces of existing pipes that need a larger diameter: (pipe, at, to, flow, dn, length, cost).

    ``pipes(pipe, dn, flow, length)`` with chainage against the flow's direction: a tie at ``chainage`` loads the pipe from its
    upstream end (0) to the tie; ``upstream(pipe, anc)`` lists the pipes above, which are loaded whole. Pieces are priced as rebuilt.
    """
    own = ties.select("pipe", F.col("chainage").alias("reach"), F.col("flow").alias("more"))
    above = ties.join(upstream, "pipe").select(F.col("anc").alias("pipe"), F.lit(float("inf")).alias("reach"), F.col("flow").alias("more"))
    loads = own.unionByName(above).join(pipes.select("pipe", "length"), "pipe").select("pipe", F.least("reach", "length").alias("reach"), "more")
    from .intervals import pieces

    parts = pieces(pipes.select("pipe", "length"), loads.select("pipe", F.lit(0.0).alias("low"), F.col("reach").alias("high")), "pipe")
    p, q = parts.alias("p"), loads.alias("q")
    load = p.join(q, (F.col("p.pipe") == F.col("q.pipe")) & (F.col("q.reach") >= F.col("p.to") - 1e-9), "left").groupBy("p.pipe", "p.at", "p.to").agg(F.coalesce(F.sum("q.more"), F.lit(0.0)).alias("more"))
    out = load.join(pipes.select("pipe", F.col("dn").alias("old"), F.col("flow").alias("base")), "pipe").withColumn("flow", F.col("base") + F.col("more")).withColumn("dn", rules.min_dn(F.col("flow")))
    return out.where("more > 0 and dn > old").withColumn("length", F.col("to") - F.col("at")).withColumn("cost", F.col("length") * rules.by_dn(F.col("dn"), "recon_cost")).select("pipe", "at", "to", "flow", "dn", "length", "cost")
