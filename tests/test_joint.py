"""Joint moves of chambers and ties: places, legs, costs, and scores that never rise."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g
from kelvingrid.operators import joint, validation

NODES = "plan long, node int, kind string, x double, y double, oks_id string, existing_id string, existing_type string"
EDGES = "plan long, parent int, child int, dn int, path array<struct<x:double,y:double>>"
WALLS = "owner string, type string, closed boolean, ring int, seq int, ax double, ay double, bx double, by double"


def ring(spark, rows):
    legs = [(o, t, True, 0, k, *a, *b) for o, t, pts in rows for k, (a, b) in enumerate(zip(pts, [*pts[1:], pts[0]]))]
    return spark.createDataFrame(legs, WALLS)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def tables(spark, walls, chambers=()):
    path = [(0.0, 0.0), (300.0, 0.0)]
    return {
        "terminals": spark.createDataFrame([("a", 10.0), ("b", 12.0)], "oks_id string, flow double"), "walls": ring(spark, walls),
        "lines": spark.createDataFrame([("p", [{"x": x, "y": y} for x, y in path])], "id string, path array<struct<x:double,y:double>>"),
        "pipes": spark.createDataFrame([("p", 300, 0.0, 0.0, 300.0, 0.0)], "id string, dn int, ax double, ay double, bx double, by double"),
        "chambers": spark.createDataFrame(list(chambers), "id string, x double, y double"),
    }


def plan(spark, tie=(100.0, 0.0), chamber=(60.0, 60.0), inner=()):
    """A tie on the pipe, a chamber off the best place, two terminals."""
    nodes = [(5, 0, "TIE_IN", *tie, None, "p", "heat_network"), (5, 1, "CHAMBER", *chamber, None, None, None), (5, 2, "TERMINAL", 120.0, 100.0, "a", None, None), (5, 3, "TERMINAL", 140.0, 80.0, "b", None, None)]
    at = {n[1]: {"x": n[3], "y": n[4]} for n in nodes}
    mid = [{"x": x, "y": y} for x, y in inner]
    edges = [(5, 0, 1, 100, [at[0], *mid, at[1]]), (5, 1, 2, 80, [at[1], at[2]]), (5, 1, 3, 80, [at[1], at[3]])]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def test_positions(spark):
    nodes, _ = plan(spark)
    t = tables(spark, [], [("c", 105.0, 3.0)])
    got = {(r.node, r.i): (r.x, r.y) for r in joint.positions(nodes, t["lines"], t["chambers"], 12.0).collect()}
    assert set(got) == {(0, 0), (0, 1)} | {(1, k) for k in range(9)} | {(2, 0), (3, 0)}  # (112, 0) is within 10 m of the chamber
    assert got[0, 1] == pytest.approx((88.0, 0.0)) and got[1, 3] == pytest.approx((60.0, 72.0)) and got[1, 2] == pytest.approx((60 + 12 * math.sqrt(0.5), 60 + 12 * math.sqrt(0.5)))
    near = {(r.node, r.i): r.x for r in joint.positions(plan(spark, tie=(3.0, 0.0))[0], t["lines"], t["chambers"], 12.0).where("node = 0").collect()}
    assert near == {(0, 0): 3.0, (0, 1): 0.0, (0, 2): pytest.approx(15.0)}


def test_projection_is_the_inverse_of_points(spark):
    path = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (30, 0), (30, 40), (100, 40))])
    df = spark.range(0, 141, 7).select(F.col("id").cast("double").alias("at")).withColumn("p", g.point_at(path, F.col("at")))
    got = df.select("at", g.project(path, F.col("p.x"), F.col("p.y")).alias("back")).collect()
    assert all(r.back == pytest.approx(r["at"]) for r in got)
    assert spark.range(1).select(g.project(path, F.lit(31.0), F.lit(20.0))).first()[0] == pytest.approx(50)


def test_implausible_routes(spark):
    cases = {"line": ([(0, 0), (9, 0)], True), "short": ([(0, 0), (0.01, 0)], False), "back": ([(0, 0), (9, 0), (4, 0.1)], False), "loop": ([(0, 0), (9, 0), (9, 9), (4, 9), (4, -5)], False), "bend": ([(0, 0), (9, 0), (9, 9)], True)}
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in p]) for k, (p, _) in cases.items()], "k string, path array<struct<x:double,y:double>>")
    assert {r.k: r.ok for r in df.select("k", joint.plausible(F.col("path")).alias("ok")).collect()} == {k: w for k, (_, w) in cases.items()}


def test_matrices_equal_one_by_one(spark):
    walls = [("park", "park", box(70.0, 10.0, 85.0, 30.0))]
    t = tables(spark, walls)
    nodes, edges = plan(spark, inner=[(95.0, 40.0)])
    at = joint.positions(nodes, t["lines"], t["chambers"], 12.0)
    place = {(r.node, r.i): np.array([r.x, r.y]) for r in at.collect()}
    got = {(r.parent, r.child, r.i, r.j): (r.cost, len(r.path)) for r in joint.matrices(nodes, edges, at, t["walls"], t["pipes"]).collect()}

    def clear(a, b, dn):
        from kelvingrid.functions import planar

        legs = np.array([[*p, *q] for p, q in zip(box(70.0, 10.0, 85.0, 30.0), [*box(70.0, 10.0, 85.0, 30.0)[1:], (70.0, 10.0)])])
        half = {100: 0.255, 80: 0.235}[dn]
        return not planar.clip(a, b, legs) and planar.segment_distances(a, b, legs).min() > 1.0 + half

    price = {100: 89748, 80: 83530}
    want = {}
    for p, c, dn, inner in ((0, 1, 100, [np.array([95.0, 40.0])]), (1, 2, 80, []), (1, 3, 80, [])):
        for (n, i), a in place.items():
            for (m, j), b in place.items():
                if n != p or m != c:
                    continue
                options = []
                for path in ([a, *inner, b], [a, b]):
                    legs = list(zip(path, path[1:]))
                    turned = len(legs) > 1 and (legs[0][1] - legs[0][0]) @ (legs[1][1] - legs[1][0]) < -1e-6
                    if turned or not all(clear(x, y, dn) for x, y in legs):
                        continue
                    size = sum(float(np.hypot(*(y - x))) for x, y in legs)
                    options.append((0.7 * size * price[dn] / 25e6 + 0.3 * size / 100, len(path)))
                if options:
                    want[p, c, i, j] = min(options)
    # the tie's own first leg leaves the pipe at a right angle or so: no conflict with it
    assert set(got) == set(want)
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_scores_never_rise(spark):
    t = tables(spark, [("park", "park", box(70.0, 10.0, 85.0, 30.0))])
    nodes, edges = plan(spark, inner=[(95.0, 40.0)])
    # a second plan, equal to the first, that no audit lets change
    nodes = nodes.unionByName(nodes.withColumn("plan", F.lit(6).cast("long")))
    edges = edges.unionByName(edges.withColumn("plan", F.lit(6).cast("long")))
    audit = lambda n, e: validation.geometry(n, e).select("plan").unionByName(n.select("plan").where("plan div 9 = 6"))
    out_nodes, out_edges, totals = joint.refine(nodes, edges, t, audit, steps=(12.0,))
    after = {r.plan: r for r in totals.collect()}
    assert set(after) == {5, 6} and after[5].score < after[6].score - 0.05 and after[5].unconnected == 0
    place = {(r.plan, r.node): (r.x, r.y) for r in out_nodes.collect()}
    assert {n: p for (k, n), p in place.items() if k == 6} == {r.node: (r.x, r.y) for r in nodes.where("plan = 6").collect()}
    assert place[5, 2] == (120.0, 100.0) and place[5, 3] == (140.0, 80.0) and place[5, 1] != (60.0, 60.0) and place[5, 0][1] == 0.0
    ends = out_edges.select("plan", "parent", "child", "path").collect()
    assert len(ends) == 6 and all((r.path[0].x, r.path[0].y) == pytest.approx(place[r.plan, r.parent]) and (r.path[-1].x, r.path[-1].y) == pytest.approx(place[r.plan, r.child]) for r in ends)


def test_a_plan_without_a_legal_route_is_left(spark):
    t = tables(spark, [("lake", "water", box(-50.0, 20.0, 400.0, 30.0))])
    nodes, edges = plan(spark)
    at = joint.positions(nodes, t["lines"], t["chambers"], 3.0)
    found = joint.matrices(nodes, edges, at, t["walls"], t["pipes"])
    assert found.where("parent = 0").count() == 0 and joint.tree_costs(nodes, edges, at, found).count() == 0


def test_a_terminals_own_building_may_be_entered(spark):
    home = ("h", "oks_existing", box(110.0, 90.0, 130.0, 110.0))
    t = tables(spark, [home])
    nodes, edges = plan(spark)
    legs = edges.select(F.struct("plan", "child").alias("edge"), "dn", "path", g.path_length(F.col("path")).alias("length"))
    assert joint.illegal(legs, nodes, t["walls"], t["pipes"]).count() == 0  # the lead to a ends in its own house
    other = tables(spark, [("h", "oks_existing", box(80.0, 60.0, 110.0, 90.0))])  # on the way to both
    assert sorted(r.edge.child for r in joint.illegal(legs, nodes, other["walls"], t["pipes"]).collect()) == [2, 3]
