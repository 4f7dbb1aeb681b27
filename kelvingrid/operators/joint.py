"""Joint refinement of the places of chambers and pipe ties, for all plans at once, by joins.

A round gives each movable node its candidate places, judges every leg that any pair of places asks for in one legality join, prices every route that is left, and hands
the cost matrices of each plan's tree to the exact program (``treedp``). Its cheapest assignments become candidate plans; they are sized, priced and audited as plans
are, and a plan gives way only to one that passes and scores less. Rounds have ever smaller steps.

``nodes(plan, node, kind, x, y, oks_id, existing_id, existing_type)``, ``edges(plan, parent, child, dn, path)``; plans are longs below 2**56. ``walls(owner, type, closed, ax, ...)``,
``lines(id, path)`` existing pipes and ``pipes(id, dn, ax, ...)`` their legs, ``chambers(id, x, y)``, ``terminals(oks_id, flow)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g
from kelvingrid.operators import buildings, costs, depth, graph, legality, spatial, treedp
from kelvingrid.plans import rules
from kelvingrid.plans.shared import discard, materialise

#: Metres by which the rounds move nodes, metres about an existing chamber without ties, assignments tried, least gain of score.
STEPS, NEAR, TRIED, GAIN = (12.0, 3.0, 1.0), 10.0, 8, 1e-8
SHORT, BACK = 0.05, -1e-6


def positions(nodes: DataFrame, lines: DataFrame, chambers: DataFrame, step: float) -> DataFrame:
    """(plan, node, i, x, y): where each node may go. 0 is its own place; a chamber has eight more about it, a tie on a pipe two along the pipe.

    Along a pipe no place within ``NEAR`` of an existing chamber counts; numbers of places that don't are left out.
    """
    own = nodes.select("plan", "node", F.lit(0).alias("i"), "x", "y")
    turn = F.col("k") * (F.pi() / 4)
    ring = nodes.where("kind = 'CHAMBER'").select("plan", "node", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    ring = ring.select("plan", "node", (F.col("k") + 1).alias("i"), (F.col("x") + step * F.cos(turn)).alias("x"), (F.col("y") + step * F.sin(turn)).alias("y"))
    ties = nodes.where("kind = 'TIE_IN' and existing_type = 'heat_network'").select("plan", "node", "x", "y", F.col("existing_id").alias("id")).join(lines.select("id", "path"), "id")
    ties = ties.withColumn("at", g.project(F.col("path"), F.col("x"), F.col("y"))).withColumn("m", F.explode(F.array(F.struct(F.lit(1).alias("i"), F.lit(-step).alias("by")), F.struct(F.lit(2).alias("i"), F.lit(step).alias("by")))))
    to = F.greatest(F.lit(0.0), F.least(g.path_length(F.col("path")), F.col("at") + F.col("m.by")))
    ties = ties.select("plan", "node", "m.i", g.point_at(F.col("path"), to).alias("p")).select("plan", "node", "i", "p.x", "p.y")
    near = spatial.within(ties, chambers.select("id", "x", "y"), NEAR, 50.0).select("plan", "node", "i")
    return own.unionByName(ring).unionByName(ties.join(near, ["plan", "node", "i"], "left_anti"))


def routes(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(plan, parent, child, dn, i, j, form, path): each edge between each pair of places, with its inner points (form 0) and, if it has any, straight (1)."""
    p = at.select("plan", F.col("node").alias("parent"), "i", F.struct("x", "y").alias("p"))
    c = at.select("plan", F.col("node").alias("child"), F.col("i").alias("j"), F.struct("x", "y").alias("c"))
    inner = F.transform(F.slice("path", F.lit(2), F.greatest(F.size("path") - 2, F.lit(0))), lambda q: F.struct(q.x.alias("x"), q.y.alias("y")))
    form = lambda k, path: F.struct(F.lit(k).alias("form"), path.alias("path"))
    shaped, direct = form(0, F.concat(F.array("p"), inner, F.array("c"))), form(1, F.array("p", "c"))
    rows = edges.select("plan", "parent", "child", "dn", "path").join(p, ["plan", "parent"]).join(c, ["plan", "child"])
    return rows.select("plan", "parent", "child", "dn", "i", "j", F.explode(F.when(F.size("path") > 2, F.array(shaped, direct)).otherwise(F.array(shaped))).alias("r")).select("plan", "parent", "child", "dn", "i", "j", "r.form", "r.path")


def plausible(path: Column) -> Column:
    """Whether a route has 5 cm at least, never turns back on itself, and doesn't cross itself."""
    n = F.size(path)
    leg = F.zip_with(F.slice(path, F.lit(1), n - 1), F.slice(path, F.lit(2), n - 1), lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))
    legs = F.transform(leg, lambda s, k: F.struct(k.alias("k"), s.ax.alias("ax"), s.ay.alias("ay"), s.bx.alias("bx"), s.by.alias("by")))
    of = lambda s: tuple(s[c] for c in spatial.SEGMENT)
    back = F.exists(F.zip_with(F.slice(legs, F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice(legs, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda s, t: (s.bx - s.ax) * (t.bx - t.ax) + (s.by - s.ay) * (t.by - t.ay)), lambda d: d < BACK)
    over = F.exists(legs, lambda s: F.exists(legs, lambda t: (t.k > s.k + 1) & g.touches(of(s), of(t))))
    return (g.path_length(path) >= SHORT) & ~back & ~F.when(n > 3, over).otherwise(False)


def illegal(named: DataFrame, nodes: DataFrame, walls: DataFrame, pipes: DataFrame, deep: bool = False) -> DataFrame:
    """Ids ``edge`` of ``named(edge, dn, path, length)`` (``edge`` a struct with plan and child) that a leg's legality or a passage through a building rules out.

    Legs that many routes share are judged once. The last two legs to a terminal may lie in its own building; that passage is judged as a whole.
    """
    ends = nodes.select("plan", F.col("node").alias("child"), (F.col("kind") == "TERMINAL").alias("terminal"), "x", "y")
    facts = named.select("edge", "edge.plan", "edge.child", "dn", "length", F.size("path").alias("points")).join(ends, ["plan", "child"]).drop("plan", "child")
    legs = depth.legs_of(named).join(facts.select("edge", "dn", "points", "terminal"), "edge").withColumn("tied", F.col("seq") == 0)
    key = [*spatial.SEGMENT, "dn", "tied"]
    s = legs.select(*key).distinct().withColumn("id", F.struct(*key)).withColumns({"tx": F.when(F.col("tied"), F.col("ax")), "ty": F.when(F.col("tied"), F.col("ay"))})
    against = legality.network_conflicts(s.select("id", *spatial.SEGMENT, "dn", "tx", "ty"), pipes, deep).select("id", F.col("other").cast("string").alias("other"), "reason")
    against = against.unionByName(legality.restriction_conflicts(s.select("id", *spatial.SEGMENT, "dn"), walls, deep).select("id", F.col("other").cast("string").alias("other"), "reason"))
    against = against.where("reason is not null").select("id.*", "other")
    houses = walls.where("closed and type = 'oks_existing'")
    home = buildings.owners(ends.where("terminal").select(F.struct("plan", "child").alias("id"), "x", "y"), houses).select(F.col("id.plan").alias("__plan"), F.col("id.child").alias("__child"), F.col("owner").cast("string").alias("__home"))
    found = legs.join(against, key).withColumn("late", F.col("terminal") & (F.col("seq") >= F.col("points") - 3))
    mine = (F.col("edge.plan") == F.col("__plan")) & (F.col("edge.child") == F.col("__child")) & (F.col("other") == F.col("__home"))
    found = found.join(home, mine, "left").where(~F.col("late") | F.col("__home").isNull()).select("edge")
    through = buildings.transit_violations(legs.select("edge", "at", *spatial.SEGMENT), facts.select("edge", "length", "terminal", "x", "y"), houses)
    return found.unionByName(through.select("edge")).distinct()


def priced(named: DataFrame, walls: DataFrame, pipes: DataFrame, deep: bool = False) -> DataFrame:
    """The costed pieces (``depth.pieces``) of ``named(edge, dn, path, length)``."""
    found = depth.crossing_intervals(depth.crossings_of(named, walls, pipes), deep)
    return depth.pieces(named.select("edge", "length", "dn"), depth.reconciled(found) if deep else found, deep)


def matrices(nodes: DataFrame, edges: DataFrame, at: DataFrame, walls: DataFrame, pipes: DataFrame, deep: bool = False) -> DataFrame:
    """(plan, parent, child, i, j, cost, path): the cheapest legal route of each edge between each pair of places, its cost as a score; pairs without one are left out."""
    key = ["plan", "parent", "child", "i", "j", "form"]
    rows = routes(edges, at).where(plausible(F.col("path"))).withColumn("length", g.path_length(F.col("path"))).select(F.struct(*key).alias("edge"), "dn", "path", "length")
    rows = materialise(rows, "routes")
    legal = materialise(rows.join(illegal(rows, nodes, walls, pipes, deep), "edge", "left_anti"), "routes")
    discard(rows)
    parts = priced(legal, walls, pipes, deep)
    if deep:
        parts = materialise(parts, "pieces")
        parts = parts.join(depth.profile_violations(parts).select("edge").distinct(), "edge", "left_anti")
    price = parts.groupBy("edge").agg(F.sum("cost").alias("price")).join(legal.select("edge", "length", "path"), "edge")
    best = price.select("edge.*", rules.score(F.col("price"), F.col("length")).alias("cost"), "path").groupBy("plan", "parent", "child", "i", "j")
    best = best.agg(F.min(F.struct("cost", "form", "path")).alias("b"))
    return best.select("plan", "parent", "child", "i", "j", "b.cost", "b.path")


def tree_costs(nodes: DataFrame, edges: DataFrame, at: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with a root -1 over each plan's roots, at no cost, for plans all of whose edges have a legal route."""
    whole = edges.select("plan", "parent", "child").join(found.select("plan", "parent", "child").distinct(), ["plan", "parent", "child"], "left_anti").select("plan").distinct()
    roots = nodes.select("plan", "node").join(edges.select("plan", F.col("child").alias("node")), ["plan", "node"], "left_anti")
    above = at.join(roots, ["plan", "node"]).select("plan", F.lit(-1).cast("long").alias("parent"), F.col("node").cast("long").alias("child"), F.lit(0).alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("cost"))
    below = found.select("plan", F.col("parent").cast("long").alias("parent"), F.col("child").cast("long").alias("child"), "i", "j", "cost")
    return above.unionByName(below).join(whole, "plan", "left_anti")


def evaluated(nodes: DataFrame, edges: DataFrame, terminals: DataFrame, walls: DataFrame, pipes: DataFrame, deep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(totals, edges): plans sized and priced anew; a plan with a run that no diameter carries is left out. Edges come with flow, dn and length."""
    demand = nodes.join(terminals.select("oks_id", "flow"), "oks_id", "left").select(F.struct("plan", "node").alias("id"), F.coalesce("flow", F.lit(0.0)).alias("demand"))
    end = lambda n: F.struct("plan", F.col(n).alias("node"))
    e = edges.select(end("parent").alias("parent"), end("child").alias("child"), g.path_length(F.col("path")).alias("length"))
    flow = graph.subtree_flow(e.select("parent", "child"), demand).withColumnRenamed("id", "child")
    sized = materialise(e.join(flow, "child"), "flows")
    need = graph.required_diameters(sized, strict=False)
    need = materialise(sized.select("child", "flow", "length").join(need, "child").select("child.plan", F.col("child.node").alias("child"), "flow", "length", "dn"), "sizes")
    bad = need.where("dn is null").select("plan").distinct()
    out = edges.select("plan", "parent", "child", "path").join(need.join(bad, "plan", "left_anti"), ["plan", "child"])
    named = out.select(F.struct("plan", "child").alias("edge"), "dn", "path", "length")
    price = priced(named, walls, pipes, deep).groupBy("edge").agg(F.sum("cost").alias("price")).select("edge.*", "price")
    base = F.nullif(F.col("length") * rules.by_dn(F.col("dn"), "new_cost"), F.lit(0.0))
    exact = out.join(price, ["plan", "child"], "left").withColumn("special", F.coalesce(F.col("price") / base, F.lit(1.0)))
    exact = materialise(exact.select("plan", "parent", "child", "path", "flow", "dn", "length", "special"), "edges")
    plans = nodes.select("plan").distinct().join(bad, "plan", "left_anti")
    return costs.totals(plans, nodes, exact, terminals), exact


def refine(nodes: DataFrame, edges: DataFrame, tables: dict[str, DataFrame], audit: Callable[[DataFrame, DataFrame], DataFrame], deep: bool = False, steps: tuple[float, ...] = STEPS, tried: int = TRIED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals) of the plans after rounds of joint moves; a plan's score never rises.

    ``tables``: terminals, walls, lines, pipes, chambers. ``audit(nodes, edges)`` returns a row with ``plan`` for each rule that a candidate breaks.
    """
    t = tables
    both = (t["terminals"], t["walls"], t["pipes"], deep)
    totals, edges = evaluated(nodes, edges, *both)
    totals, nodes = materialise(totals, "totals"), materialise(nodes, "nodes")
    for step in steps:
        at = materialise(positions(nodes, t["lines"], t["chambers"], step), "positions")
        found = materialise(matrices(nodes, edges, at, t["walls"], t["pipes"], deep), "matrices")
        picks = materialise(treedp.top_assignments(tree_costs(nodes, edges, at, found), tried).where("node >= 0").withColumn("trial", F.col("plan") * (tried + 1) + F.col("rank")), "assignments")
        place = at.select("plan", F.col("node").cast("long").alias("node"), F.col("i").alias("candidate"), F.col("x").alias("nx"), F.col("y").alias("ny"))
        moved = picks.select("trial", "plan", "node", "candidate").join(place, ["plan", "node", "candidate"])
        same = nodes.schema["node"].dataType
        new_nodes = nodes.withColumn("node", F.col("node").cast("long")).join(moved, ["plan", "node"]).select(F.col("trial").alias("plan"), F.col("node").cast(same).alias("node"), "kind", F.col("nx").alias("x"), F.col("ny").alias("y"), "oks_id", "existing_id", "existing_type")
        new_nodes = materialise(new_nodes, "nodes")
        end = lambda n, i: picks.select("trial", "plan", F.col("node").cast(same).alias(n), F.col("candidate").alias(i))
        new_edges = edges.select("plan", "parent", "child").join(end("parent", "i"), ["plan", "parent"]).join(end("child", "j"), ["trial", "plan", "child"]).join(found, ["plan", "parent", "child", "i", "j"])
        new_edges = materialise(new_edges.select(F.col("trial").alias("plan"), "parent", "child", "path"), "edges")
        tried_totals, tried_edges = evaluated(new_nodes, new_edges, *both)
        old = totals.select(F.col("plan").alias("old"), F.col("score").alias("before"))
        better = materialise(tried_totals.withColumn("old", F.expr(f"plan div {tried + 1}")).join(old, "old").where(F.col("score") < F.col("before") - GAIN), "better")
        keep = better.select("plan")
        broken = audit(new_nodes.join(keep, "plan", "left_semi"), tried_edges.join(keep, "plan", "left_semi")).select("plan").distinct()
        won = better.join(broken.withColumn("plan", F.col("plan").cast("long")), "plan", "left_anti").groupBy("old").agg(F.min(F.struct("score", "plan")).alias("w")).select("old", F.col("w.plan").alias("plan"))
        won = materialise(won, "won")
        gone = won.select(F.col("old").alias("plan"))

        def put(before: DataFrame, after: DataFrame) -> DataFrame:
            new = after.join(won, "plan").drop("plan").withColumnRenamed("old", "plan")
            return materialise(before.join(gone, "plan", "left_anti").unionByName(new.select(*before.columns)), "refined")

        nodes, edges, totals = put(nodes, new_nodes), put(edges, tried_edges), put(totals, better.drop("before", "old"))
        for done in (at, found, picks, new_nodes, new_edges, better, won):
            discard(done)
    return nodes, edges, totals
