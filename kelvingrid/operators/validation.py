"""Independent checks of plans and of exported rows. Every check returns rows (plan, rule, object, detail); a plan passes when it has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g
from kelvingrid.operators import buildings, candidates, costs, depth, graph, legality, spatial
from kelvingrid.plans import rules
from kelvingrid.plans.shared import materialise


def _rows(df: DataFrame, rule: str, obj: str, detail) -> DataFrame:
    return df.select("plan", F.lit(rule).alias("rule"), F.col(obj).cast("string").alias("object"), detail.cast("string").alias("detail"))


def topology(nodes: DataFrame, edges: DataFrame, terminals: DataFrame, chambers: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Degree at most 4, also with the existing sections at chambers and ties, terminals are leaves, roots have no parent, no orphans, no cycles, coverage, and no tie on a pipe within 10 m of a chamber that has a free connection.

    ``nodes(plan, node, kind, x, y, oks_id, existing_id, existing_type)``, ``edges(plan, parent, child)``; ``chambers(id, x, y)``, ``lines(id, path)`` existing pipes, none if not given.
    """
    ends = edges.select("plan", F.explode(F.array("parent", "child")).alias("node")).groupBy("plan", "node").agg(F.count(F.lit(1)).alias("n"))
    parts = [_rows(ends.where("n > 4"), "degree", "node", F.col("n"))]
    up = edges.select("plan", F.col("parent").alias("node")).distinct()
    parts.append(_rows(nodes.where("kind = 'TERMINAL'").join(up, ["plan", "node"], "left_semi"), "terminal-leaf", "node", F.col("oks_id")))
    below = edges.select("plan", F.col("child").alias("node"))
    parts.append(_rows(nodes.where("kind <> 'TIE_IN'").join(below, ["plan", "node"], "left_anti"), "orphan", "node", F.col("kind")))
    parts.append(_rows(below.groupBy("plan", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "two-parents", "node", F.col("n")))
    keyed = edges.select(F.concat_ws("/", "plan", "parent").alias("parent"), F.concat_ws("/", "plan", "child").alias("child"))
    cycle = graph.cyclic(keyed).select(F.split("id", "/").alias("s"))
    parts.append(cycle.select(F.col("s")[0].cast(edges.schema["plan"].dataType).alias("plan"), F.lit("cycle").alias("rule"), F.col("s")[1].alias("object"), F.lit(None).cast("string").alias("detail")))
    have = nodes.where("oks_id is not null").groupBy("plan", "oks_id").agg(F.count(F.lit(1)).alias("n"))
    parts.append(_rows(have.where("n > 1"), "terminal-twice", "oks_id", F.col("n")))
    parts.append(_rows(have.join(terminals.select("oks_id"), "oks_id", "left_anti"), "unknown-terminal", "oks_id", F.col("n")))
    ties = nodes.where("kind = 'TIE_IN'")
    parts.append(_rows(ties.join(below, ["plan", "node"], "left_semi"), "root-parent", "node", F.col("kind")))
    return reduce(DataFrame.unionByName, [*parts, *connections(ties, edges, chambers, lines)])


def connections(ties: DataFrame, edges: DataFrame, chambers: DataFrame, lines: DataFrame | None) -> list[DataFrame]:
    """Rules about ties and the existing network: a chamber and a tie on a pipe take four sections, existing and new; a tie on a pipe isn't made within 10 m of a chamber that could take it."""
    new = edges.select("plan", F.col("parent").alias("node")).groupBy("plan", "node").agg(F.count(F.lit(1)).alias("new"))
    ties = ties.select("plan", "node", "x", "y", F.col("existing_id").cast("string").alias("chamber"), (F.coalesce("existing_type", F.lit("")) == "heat_chamber").alias("at")).join(new, ["plan", "node"], "left").fillna(0, ["new"])
    spots = chambers.select(F.col("id").cast("string").alias("id"), "x", "y")
    pipe = ties.where("not at").withColumn("id", F.struct("plan", "node"))
    count = lambda points: points.select("id", F.lit(0).alias("degree")) if lines is None else candidates.sections(points, lines)
    held = count(spots)
    planned = ties.where("at").groupBy("plan", F.col("chamber").alias("id")).agg(F.sum("new").alias("new"))
    full = planned.join(held, "id").where(F.col("degree") + F.col("new") > 4)
    crowded = pipe.join(count(pipe), "id").where(F.col("degree") + F.col("new") > 4)
    near = spatial.within(pipe.select("id", "plan", "node", "x", "y"), spots, 10.0, 50.0).where("distance <= 10").select("plan", "node", F.col("r_id").alias("id"))
    free = near.join(held, "id").join(planned, ["plan", "id"], "left").where(F.col("degree") + F.coalesce("new", F.lit(0)) < 4)
    return [_rows(full, "chamber-degree", "id", F.col("degree") + F.col("new")), _rows(crowded, "tie-degree", "node", F.col("degree") + F.col("new")), _rows(free, "chamber-near", "node", F.col("id"))]


def sizes(edges: DataFrame, demand: DataFrame, skip: bool = False) -> DataFrame:
    """Stored diameters against those computed anew, plan by plan: ``edges(plan, parent, child, dn, length)``, ``demand(plan, id, demand)``; ``skip`` as in ``graph.required_diameters``."""
    key = lambda c: F.concat_ws("/", "plan", c)
    e = edges.select(key("parent").alias("parent"), key("child").alias("child"), "plan", F.col("child").alias("own"), "dn", "length")
    flow = graph.subtree_flow(e.select("parent", "child"), demand.select(key("id").alias("id"), "demand"))
    need = graph.required_diameters(e.join(flow.withColumnRenamed("id", "child"), "child").select("parent", "child", "flow", "length"), skip=skip)
    wrong = e.join(need.withColumnRenamed("dn", "need"), "child").where("dn <> need")
    return _rows(wrong, "diameter", "own", F.concat_ws(" ", "dn", "need"))


def geometry(nodes: DataFrame, edges: DataFrame, size: float = 200.0) -> DataFrame:
    """Paths end at their nodes (1 mm), turn by at most 90 degrees, don't cross themselves, and edges of a plan don't cross.

    ``edges(plan, parent, child, path)``. Edges that share a node may touch there.
    """
    at = lambda end, n: nodes.select("plan", F.col("node").alias(end), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    e = edges.join(at("parent", "p"), ["plan", "parent"]).join(at("child", "c"), ["plan", "child"])
    a, b = F.element_at("path", 1), F.element_at("path", -1)
    off = (g.distance(a["x"], a["y"], F.col("px"), F.col("py")) > 0.001) | (g.distance(b["x"], b["y"], F.col("cx"), F.col("cy")) > 0.001)
    parts = [_rows(e.where(off), "endpoint", "child", F.lit(None))]
    legs = spatial.explode_segments(edges.select("plan", "parent", "child", F.array("path").alias("rings"))).drop("ring")
    w = Window.partitionBy("plan", "child").orderBy("seq")
    d = legs.withColumns({"dx": F.col("bx") - F.col("ax"), "dy": F.col("by") - F.col("ay")}).withColumns({"ux": F.lag("dx").over(w), "uy": F.lag("dy").over(w)})
    bent = d.where(F.col("ux").isNotNull()).withColumn("turn", g.turn(F.col("ux"), F.col("uy"), F.col("dx"), F.col("dy"))).where("turn > 90.0001")
    parts.append(_rows(bent, "turn", "child", F.round("turn", 4)))
    boxed = spatial.segment_boxes(legs.withColumn("id", F.xxhash64("plan", "child", "seq")))
    own, other = [F.col(c) for c in spatial.SEGMENT], [F.col(f"r_{c}") for c in spatial.SEGMENT]
    pairs = spatial.overlap_join(boxed, boxed, size, 0.0, F.col("id") < F.col("r_id"), on=("plan",))
    same = F.col("child") == F.col("r_child")
    itself = pairs.where(same & (F.abs(F.col("seq") - F.col("r_seq")) > 1) & g.touches(tuple(own), tuple(other)))
    parts.append(_rows(itself, "self-cross", "child", F.lit(None)))
    shared = (F.col("child") == F.col("r_parent")) | (F.col("parent") == F.col("r_child")) | (F.col("parent") == F.col("r_parent"))
    crossed = pairs.where(~same & F.when(shared, g.crosses(tuple(own), tuple(other))).otherwise(g.touches(tuple(own), tuple(other))))
    parts.append(_rows(crossed, "new-new-crossing", "child", F.col("r_child")))
    return reduce(DataFrame.unionByName, parts)


def routes(nodes: DataFrame, edges: DataFrame, walls: DataFrame, pipes: DataFrame, deep: bool = False) -> DataFrame:
    """Edges against restrictions and the existing network: every leg's legality, passages through buildings, bends inside special crossings.

    ``edges(plan, parent, child, path, dn)``, ``walls(owner, type, closed, ax, ...)``, ``pipes(id, dn, ax, ...)``. The last legs of a terminal's edge may
    be inside its own building and its envelope; the passage itself is judged as a whole.
    """
    e = edges.select("plan", "child", "parent", "path", "dn", F.struct("plan", "child").alias("edge")).withColumn("length", g.path_length(F.col("path")))
    start = nodes.select("plan", F.col("node").alias("parent"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    end = nodes.select("plan", F.col("node").alias("child"), (F.col("kind") == "TERMINAL").alias("terminal"), "x", "y")
    legs = depth.legs_of(e)
    facts = e.join(start, ["plan", "parent"]).join(end, ["plan", "child"]).select("edge", "dn", "tx", "ty", "terminal", "x", "y", "length", F.size("path").alias("points"))
    s = legs.join(facts, "edge").withColumn("id", F.struct("edge", "seq"))
    found = legality.network_conflicts(s.select("id", *spatial.SEGMENT, "dn", "tx", "ty"), pipes, deep).select("id", F.lit(None).cast("string").alias("other"), "reason")
    own = legality.restriction_conflicts(s.select("id", *spatial.SEGMENT, "dn"), walls, deep).select("id", F.col("other").cast("string").alias("other"), "reason")
    home = buildings.owners(facts.where("terminal").select(F.col("edge").alias("id"), "x", "y"), walls.where("closed and type = 'oks_existing'")).select(F.col("id").alias("edge"), F.col("owner").cast("string").alias("other"), F.lit(True).alias("home"))
    found = found.unionByName(own).where("reason is not null").withColumn("edge", F.col("id.edge")).join(facts.select("edge", "points"), "edge").join(home, ["edge", "other"], "left")
    late = F.col("home").isNotNull() & (F.col("id.seq") >= F.col("points") - 3)
    name = lambda df: df.select(F.col("edge.plan").alias("plan"), F.col("rule"), F.col("edge.child").cast("string").alias("object"), F.col("detail").cast("string").alias("detail"))
    parts = [name(found.where(~late).select("edge", F.lit("restriction").alias("rule"), F.col("reason").alias("detail")).distinct())]
    transit = buildings.transit_violations(legs.select("edge", "at", *spatial.SEGMENT), facts.select("edge", "length", "terminal", "x", "y"), walls.where("closed and type = 'oks_existing'"))
    parts.append(name(transit.select("edge", F.concat(F.lit("building-"), "rule").alias("rule"), F.col("owner").alias("detail"))))
    w = Window.partitionBy("edge").orderBy("at")
    bends = legs.withColumns({"dx": F.col("bx") - F.col("ax"), "dy": F.col("by") - F.col("ay")}).withColumns({"ux": F.lag("dx").over(w), "uy": F.lag("dy").over(w)})
    bends = bends.where("ux is not null").select("edge", "at", g.turn(F.col("ux"), F.col("uy"), F.col("dx"), F.col("dy")).alias("turn"))
    crossings = depth.crossings_of(e.select("edge", "length", "dn", "path"), walls, pipes).where("type is not null").where(legality.crossable(F.col("type")))
    bent = legality.bends_in_crossings(bends, crossings.select("edge", "type", "low", "high", "length"))
    parts.append(name(bent.select("edge", F.lit("special-straight").alias("rule"), F.col("type").alias("detail"))))
    return reduce(DataFrame.unionByName, parts)


def depths(edges: DataFrame, parts: DataFrame, crossings: DataFrame) -> DataFrame:
    """Depth rules of costed ``parts``: slopes and cover, plateaus and clearances at ``crossings``; their ``edge`` is a struct (plan, child)."""
    kind, pipe = F.col("type"), F.col("object_dn").isNotNull()
    utility = crossings.where(pipe | kind.isin(*depth.TOP))
    top = F.when(pipe, 3.0).when(kind == "gas_pipeline", 2.8).otherwise(2.7)
    height = F.when(pipe, rules.by_dn(F.col("object_dn"), "pair_height")).when(kind == "gas_pipeline", 0.4).otherwise(0.2)
    gap = F.when(kind == "gas_pipeline", 0.2).otherwise(0.5)
    at = utility.select("edge", ((F.col("low") + F.col("high")) / 2).alias("x"), "length", "dn", top.alias("top"), height.alias("height"), gap.alias("gap"))
    found = depth.profile_violations(parts).unionByName(depth.cover_violations(parts, crossings.where("type is not null"))).unionByName(depth.crossing_violations(parts, at))
    return found.select(F.col("edge.plan").alias("plan"), F.concat(F.lit("depth-"), "rule").alias("rule"), F.col("edge.child").cast("string").alias("object"), F.round("at", 3).cast("string").alias("detail"))


def scores(stated: DataFrame, plans: DataFrame, nodes: DataFrame, edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """Stated cost (0.1), length (1 mm) and score (1e-8) against the totals computed anew."""
    t = costs.totals(plans, nodes, edges, terminals).select("plan", F.col("cost").alias("c"), F.col("length").alias("l"), F.col("score").alias("s"))
    j = stated.join(t, "plan")
    bad = (F.abs(F.col("cost") - F.col("c")) > 0.1) | (F.abs(F.col("length") - F.col("l")) > 0.001) | (F.abs(F.col("score") - F.col("s")) > 1e-8)
    return _rows(j.where(bad), "score", "plan", F.concat_ws(" ", "cost", "c", "length", "l"))


#: The fields that each type of exported object must have, and the summary's total of each type's costs.
NEEDED = {
    "heat_network": ("id", "start_node_id", "end_node_id", "flow_tph", "diameter", "length", "laying_method", "depth_start", "depth_end", "cost"),
    "heat_chamber": ("id", "diameter", "cost"),
    "technical_node": ("id",),
    "variant_summary": ("id", "rank", "construction_cost", "chamber_construction_cost", "tie_in_cost", "reconstruction_cost", "chamber_reconstruction_cost", "unconnected_penalty", "calculated_cost", "new_network_length", "reconstruction_length", "length", "score", "unconnected_oks_ids"),
}
SUMS = {"construction_cost": "lines", "chamber_construction_cost": "chambers", "tie_in_cost": "ties", "reconstruction_cost": "nothing", "chamber_reconstruction_cost": "nothing"}


def exported(features: DataFrame) -> DataFrame:
    """What is wrong with exported features, ``features(value)`` with a feature's JSON text each: (plan, rule, object, detail), as ``plan`` the variant.

    Known types with all their fields, positions of two or three finite numbers, lines with as many as their depths ask for and z the negative depth at both
    ends, one summary for each variant, no id twice in one, and the summary's costs, length and score those of its objects.
    """
    f = F.from_json("value", "struct<properties:string,geometry:struct<type:string,coordinates:string>>")
    p = lambda name, kind="string": F.get_json_object("p", f"$.{name}").try_cast(kind)
    rows = features.select(f.alias("f")).select(F.col("f.properties").alias("p"), F.col("f.geometry.type").alias("shape"), F.col("f.geometry.coordinates").alias("coordinates"))
    rows = rows.select("p", "shape", "coordinates", p("variant_id").alias("plan"), p("object_type").alias("type"), p("id").alias("id"), *[p(n, "double").alias(n) for n in ("cost", "length", "tie_in_cost", "depth_start", "depth_end")])
    rows = materialise(rows, "exported")
    parts = [
        _rows(rows.where("coalesce(type, '') = '' or coalesce(plan, '') = ''"), "field", "id", F.lit("object_type or variant_id")),
        _rows(rows.where(~F.coalesce(F.col("type").isin(*NEEDED), F.lit(False))), "type", "id", F.col("type")),
    ]
    want = F.create_map(*[x for t, names in NEEDED.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))])
    missing = rows.withColumn("missing", F.explode(F.array_except(want[F.col("type")], F.coalesce(F.json_object_keys("p"), F.array().cast("array<string>")))))
    parts.append(_rows(missing, "missing", "id", F.col("missing")))
    placed = rows.where("coordinates is not null").withColumn("points", F.when(F.col("shape") == "Point", F.array(F.from_json("coordinates", "array<double>"))).otherwise(F.from_json("coordinates", "array<array<double>>")))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = lambda q: q.isNotNull() & F.size(q).between(2, 3) & F.forall(q, finite)
    parts.append(_rows(placed.where(F.col("points").isNull() | ~F.forall("points", sound)), "position", "id", F.lit(None)))
    lines = placed.where("type = 'heat_network' and size(points) > 0").withColumn("deep", F.col("depth_start").isNotNull() & F.col("depth_end").isNotNull())
    parts.append(_rows(lines.where(F.exists("points", lambda q: F.coalesce(F.size(q), F.lit(0)) != F.when(F.col("deep"), 3).otherwise(2))), "dimension", "id", F.lit(None)))
    z = lambda k: F.coalesce(F.get(F.element_at("points", k), 2), F.lit(0.0))
    parts.append(_rows(lines.where(F.col("deep") & ((F.abs(z(1) + F.col("depth_start")) > 1e-7) | (F.abs(z(-1) + F.col("depth_end")) > 1e-7))), "depth", "id", F.lit(None)))
    of = lambda t, c: F.coalesce(F.sum(F.when(F.col("type") == t, F.col(c))), F.lit(0.0))
    object_ = F.coalesce(F.col("type") != "variant_summary", F.lit(True))
    sums = rows.groupBy("plan").agg(
        F.count_if(F.col("type") == "variant_summary").alias("summaries"), of("heat_network", "cost").alias("lines"), of("heat_chamber", "cost").alias("chambers"), of("heat_network", "tie_in_cost").alias("ties"), F.lit(0.0).alias("nothing"),
        F.coalesce(F.sum(F.when(object_, F.col("cost"))), F.lit(0.0)).alias("costs"), F.coalesce(F.sum(F.when(object_, F.col("length"))), F.lit(0.0)).alias("lengths"),
    )
    parts.append(_rows(sums.where("summaries <> 1"), "one-summary", "plan", F.col("summaries")))
    parts.append(_rows(rows.groupBy("plan", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "id-twice", "id", F.col("n")))
    names = [*SUMS, "unconnected_penalty", "calculated_cost", "length", "score"]
    stated = rows.where("type = 'variant_summary'").select("plan", *[F.coalesce(p(n, "double"), F.lit(0.0)).alias(f"s_{n}") for n in names]).join(sums, "plan")
    cost, length = F.col("costs") + F.col("ties") + F.col("s_unconnected_penalty"), F.col("lengths")
    off = [F.when(F.abs(F.col(f"s_{n}") - F.col(c)) > 0.1, n) for n, c in SUMS.items()]
    off += [F.when(F.abs(F.col("s_calculated_cost") - cost) > 0.1, "calculated_cost"), F.when(F.abs(F.col("s_length") - length) > 0.001, "length"), F.when(F.abs(F.col("s_score") - rules.score(cost, length)) > 1e-7, "score")]
    wrong = stated.withColumn("off", F.explode(F.array_compact(F.array(*off))))
    parts.append(_rows(wrong, "totals", "plan", F.col("off")))
    return reduce(DataFrame.unionByName, parts)
