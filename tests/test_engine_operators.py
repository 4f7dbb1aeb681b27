"""Goldens and brute-force comparisons of the engine's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g
from kelvingrid.functions import planar
from kelvingrid.operators import candidates, costs, diversity, graph, intervals, spatial, validation
from kelvingrid.plans import rules


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rules(spark):
    dn = spark.createDataFrame([(40.2,), (40.21,), (300.0,), (0.0,), (None,)], "f double").select(rules.min_dn(F.col("f")).alias("d"))
    assert [r.d for r in dn.collect()] == [125, 150, 300, 50, None]
    with pytest.raises(Exception, match="no diameter"):
        value(spark, rules.min_dn(F.lit(22502.0)))
    assert value(spark, rules.score(F.lit(25e6), F.lit(100.0))) == pytest.approx(1)
    assert value(spark, rules.depth_factor(F.lit(2.2))) == 1 and value(spark, rules.depth_factor(F.lit(3.5))) == pytest.approx(1.05)
    assert value(spark, rules.by_dn(F.lit(100), "new_cost")) == 89748


def test_plan_totals(spark):
    plans = spark.createDataFrame([(1,)], "plan long")
    nodes = spark.createDataFrame([(1, 0, "TIE_IN", "heat_network", None), (1, 1, "TERMINAL", None, "a")], "plan long, node long, kind string, existing_type string, oks_id string")
    edges = spark.createDataFrame([(1, 0, 1, 100, 100.0, 1.0)], "plan long, parent long, child long, dn int, length double, special double")
    r = costs.totals(plans, nodes, edges, spark.createDataFrame([("a", 5.0)], "oks_id string, flow double")).first()
    assert (round(r.construction, 6), r.chambers, r.ties, r.length, r.unconnected) == (8974800, 3000000, 0, 100, 0)


def test_reconstruction(spark):
    pipes = spark.createDataFrame([(1, 80, 5.0, 100.0)], "pipe long, dn int, flow double, length double")
    ties = spark.createDataFrame([(1, 30.0, 10.0), (1, 70.0, 10.0)], "pipe long, chainage double, flow double")
    got = costs.reconstruction(pipes, ties, spark.createDataFrame([], "pipe long, anc long")).collect()
    assert sum(r.length for r in got) == 70 and sum(r.cost for r in got) == pytest.approx(30 * 148030 + 40 * 133694)


@pytest.mark.parametrize("edges, want", [([(0, 1, 20.0, 500.0)], {1: 125}), ([(0, 1, 20.0, 300.0), (1, 2, 20.0, 300.0), (2, 3, 20.0, 300.0)], {1: 200, 2: 200, 3: 200})])
def test_required_diameters(spark, edges, want):
    df = spark.createDataFrame(edges, "parent long, child long, flow double, length double")
    assert {r.child: r.dn for r in graph.required_diameters(df).collect()} == want


def test_graph_iterations(spark):
    r = np.random.default_rng(0)
    parent = {k: int(r.integers(0, k)) for k in range(1, 60)}
    edges = spark.createDataFrame([(p, c) for c, p in parent.items()], "parent long, child long")
    demand = spark.createDataFrame([(k, k % 7) for k in range(60)], "id long, demand long")
    below = {k: k % 7 for k in range(60)}
    for k in range(59, 0, -1):
        below[parent[k]] += below[k]
    assert {x.id: x.flow for x in graph.subtree_flow(edges, demand).collect()} == below
    assert graph.cyclic(edges).count() == 0
    assert {x.id for x in graph.cyclic(edges.unionByName(spark.createDataFrame([(59, 5)], "parent long, child long"))).collect()} >= ({5} if parent.get(59) == 5 else set())
    nodes = spark.createDataFrame([(c, p) for c, p in parent.items()] + [(100, 101), (101, 100)], "id long, upstream long")
    seen = {x.id for x in graph.reached(nodes, spark.createDataFrame([(0,)], "id long")).collect()}
    assert seen == set(range(60))


def test_spatial_joins_equal_brute_force(spark):
    r = np.random.default_rng(1)
    seg = np.concatenate([r.uniform(0, 1000, (60, 2))] * 2, axis=1) + np.concatenate([np.zeros((60, 2)), r.normal(0, 120, (60, 2))], axis=1)
    points = r.uniform(0, 1000, (40, 2))
    lines = spark.createDataFrame([(k, *map(float, s)) for k, s in enumerate(seg)], "id long, ax double, ay double, bx double, by double")
    pts = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "id long, x double, y double")
    dist = np.array([planar.point_segments(p, seg) for p in points])
    for size in (None, 3000.0):
        got = spatial.nearest(pts, lines, 4, "id", "id", size).collect()
        assert {(x.id, x["rank"]): x.r_id for x in got} == {(k, j + 1): int(np.argsort(dist[k], kind="stable")[j]) for k in range(40) for j in range(4)}
    near = spatial.clearance(lines, lines.withColumn("need", F.lit(25.0)), 90.0, 25.0).where("id < r_id").collect()
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if planar.segment_distances(seg[a, :2], seg[a, 2:], seg[b : b + 1])[0] < 25}
    assert {(x.id, x.r_id) for x in near} == want
    crossed = {(x.id, x.r_id) for x in spatial.crossings(lines, 150.0).collect()}
    assert crossed == {(a, b) for a in range(60) for b in range(a + 1, 60) if planar.meets(seg[a, :2], seg[a, 2:], seg[b : b + 1])[0]}


def test_intervals_inside_a_notched_polygon(spark):
    ring = [(0, 0), (30, 0), (30, 20), (20, 20), (20, 5), (10, 5), (10, 20), (0, 20), (0, 0)]
    walls = spark.createDataFrame([(1, *map(float, (*a, *b))) for a, b in zip(ring, ring[1:])], "owner long, ax double, ay double, bx double, by double")
    lines = spark.createDataFrame([(7, -10.0, 10.0, 40.0, 10.0)], "id long, ax double, ay double, bx double, by double")
    got = sorted((round(r.cut, 6), round(r.next, 6)) for r in spatial.cut_intervals(lines, walls, 25.0).collect())
    assert got == [(10, 20), (30, 40)]


def test_paths_and_rings(spark):
    df = spark.sql("select array(struct(0D as x, 0D as y), struct(3D as x, 4D as y), struct(3D as x, 10D as y)) as path")
    r = df.select(g.path_length(F.col("path")).alias("n"), g.point_at(F.col("path"), F.lit(7.0)).alias("p"), g.point_at(F.col("path"), F.lit(99.0)).alias("q"), g.chainages(F.col("path")).alias("c")).first()
    assert r.n == 11 and (r.p.x, r.p.y) == (3, 6) and (r.q.x, r.q.y) == (3, 10) and r.c == [0, 5, 11]
    square = spark.sql("select array(array(struct(0D as x,0D as y),struct(4D as x,0D as y),struct(4D as x,4D as y),struct(0D as x,4D as y),struct(0D as x,0D as y))) as rings")
    assert square.select(g.inside(F.lit(1.0), F.lit(1.0), F.col("rings")).alias("a"), g.inside(F.lit(5.0), F.lit(1.0), F.col("rings")).alias("b")).first() == (True, False)


def test_profile_over_a_cable(spark):
    points = spark.createDataFrame([(1, float(x)) for x in range(0, 101, 10)], "edge long, x double")
    demands = spark.createDataFrame([(1, 48.0, 52.0, 4.0)], "edge long, low double, high double, depth double")
    got = {r.x: round(r.depth, 6) for r in intervals.profile(points, demands).collect()}
    assert got[50] == 4 and got[40] == 3.2 and got[0] == got[100] == 3
    assert intervals.slope_violations(intervals.profile(points, demands)).count() == 0


def test_portfolio_and_distances(spark):
    plans = spark.createDataFrame([(1, 5.0), (2, 4.0), (3, 6.0), (4, 1.0)], "plan long, score double")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a long, b long")
    r = diversity.portfolio(plans, pairs).first()
    assert (r["size"], r.p1, r.p2, r.p3) == (3, 1, 2, 3)
    assert diversity.portfolio(plans, pairs.limit(0)).first().p1 == 4
    cells = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c")], "plan long, item string")
    assert diversity.set_distances(cells, "plan", "item").first().distance == pytest.approx(2 / 3)


def test_ties_and_attachments(spark):
    pipes = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 0.0, 100)], "id long, ax double, ay double, bx double, by double, dn int")
    assert [r.chainage for r in candidates.samples(pipes).orderBy("chainage").collect()] == [0, 24, 48, 50]
    chambers = spark.createDataFrame([(9, 0.0, 1.0), (8, 25.0, 0.5), (7, 25.0, 30.0)], "id long, x double, y double")
    assert {r.id: r.degree for r in candidates.connections(chambers, pipes).collect()} == {9: 1, 8: 2, 7: 0}


def test_validators_find_what_is_wrong(spark):
    nodes = spark.createDataFrame([(1, 0, "TIE_IN", 0.0, 0.0, None), (1, 1, "CHAMBER", 10.0, 0.0, None), (1, 2, "TERMINAL", 20.0, 0.0, "a"), (1, 3, "TERMINAL", 10.0, 10.0, "b"), (1, 4, "TERMINAL", 5.0, 5.0, "zz")], "plan long, node long, kind string, x double, y double, oks_id string").withColumns({"existing_id": F.lit("p"), "existing_type": F.when(F.col("kind") == "TIE_IN", "heat_network")})
    path = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    edges = [(1, 0, 1, path((0, 0), (10, 0))), (1, 1, 2, path((10, 0), (20, 0.5))), (1, 1, 3, path((10, 0), (15, 0), (5, 1), (10, 10)))]
    e = spark.createDataFrame(edges, "plan long, parent long, child long, path array<struct<x:double,y:double>>")
    terms = spark.createDataFrame([("a",), ("b",)], "oks_id string")
    chambers = spark.createDataFrame([("c", 6.0, 3.0)], "id string, x double, y double")
    assert {r.rule for r in validation.topology(nodes, e, terms, chambers).collect()} == {"orphan", "unknown-terminal", "chamber-near"}
    assert {r.rule for r in validation.geometry(nodes, e).collect()} >= {"endpoint", "turn"}
