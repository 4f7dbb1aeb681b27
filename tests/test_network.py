"""Hand scenes and brute force for legality, buildings, depth profiles and topology."""

import numpy as np
import pytest
from kelvingrid.operators import buildings, depth, legality, spatial, topology
from pyspark.sql import functions as F

SEG = "id long, ax double, ay double, bx double, by double"


def walls(spark, polygons, kind="oks_existing"):
    rows = [(k, kind, True, [[{"x": float(x), "y": float(y)} for x, y in [*ring, ring[0]]] for ring in rings]) for k, rings in polygons.items()]
    return spatial.explode_segments(spark.createDataFrame(rows, "owner long, type string, closed boolean, rings array<array<struct<x:double,y:double>>>"))


BLOCK = [(0, 0), (30, 0), (30, 20), (0, 20)]
NOTCH = [(0, 0), (30, 0), (30, 20), (14, 20), (14, 5), (10, 5), (10, 20), (0, 20)]


def test_network_legality(spark):
    pipes = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0, 100)], SEG + ", dn int")
    rows = [(1, 50.0, -20.0, 50.0, 20.0), (2, 0.0, 1.2, 50.0, 1.2), (3, 20.0, 0.0, 60.0, 0.0), (4, 0.0, 5.0, 50.0, 5.0), (5, 50.0, 0.0, 50.0, 20.0), (6, 50.0, 0.1, 50.0, 20.0)]
    s = spark.createDataFrame(rows, SEG).withColumn("dn", F.lit(100)).withColumn("tx", F.when(F.col("id") > 4, 50.0)).withColumn("ty", F.when(F.col("id") > 4, 0.0))
    got = {r.id: (r.reason, round(r.factor, 6)) for r in legality.network_conflicts(s, pipes).collect()}
    assert got == {1: (None, 1.05), 2: ("clearance-existing-network", 1), 3: ("overlap-existing-network", 1)}
    assert {r.id: r.feasible for r in legality.assessed(s, legality.network_conflicts(s, pipes)).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True}
    lines = spark.createDataFrame([(9, 0.0, 0.0, 100.0, 0.0)], SEG)
    assert {r.id for r in legality.new_line_conflicts(s, lines).collect()} == {1, 3}


def test_restriction_legality(spark):
    w = walls(spark, {1: [[(40, -10), (60, -10), (60, 10), (40, 10)]]}, "park").unionByName(walls(spark, {2: [[(0, 100), (200, 100), (200, 110), (0, 110)]]}, "road"))
    s = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0), (2, 0.0, 11.2, 100.0, 11.2), (3, 0.0, 12.0, 100.0, 12.0), (4, 50.0, 90.0, 50.0, 120.0), (5, 50.0, 90.0, 150.0, 120.0), (6, 45.0, 0.0, 55.0, 0.0), (7, 0.0, 98.5, 100.0, 98.5)], SEG).withColumn("dn", F.lit(100))
    got = {(r.id, r.other): (r.reason, r.factor) for r in legality.restriction_conflicts(s, w).collect()}
    assert got == {(1, 1): ("forbidden:park", 1), (2, 1): ("forbidden:park", 1), (6, 1): ("forbidden:park", 1), (4, 2): (None, 1.6), (5, 2): ("cross-angle:road", 1), (7, 2): ("clearance:road", 1)}


@pytest.mark.parametrize(("ring", "spot", "lead", "low", "high"), [(BLOCK, (28, 10), 2, 30, 99), (NOTCH, (8, 10), 2, 10, 14)])
def test_ports_of_the_nearest_wall(spark, ring, spot, lead, low, high):
    t = spark.createDataFrame([(1, float(spot[0]), float(spot[1]))], "id long, x double, y double")
    found = buildings.tiers(buildings.ports(t, walls(spark, {1: [ring]}), 100)).where("tier = 0").collect()
    assert found and all(abs(r.lead - lead) < 1e-9 and low < r.x < high for r in found)
    ways = buildings.leads(spark.createDataFrame([(k, float(spot[0]), float(spot[1]), r.x, r.y) for k, r in enumerate(found)], SEG), walls(spark, {1: [ring]})).collect()
    assert all(r.straight and r.nearest and abs(r.inside - lead) < 1e-9 for r in ways) and len(ways) == len(found)


def test_leads_through_a_courtyard_or_twice(spark):
    w = walls(spark, {1: [[(0, 0), (40, 0), (40, 40), (0, 40)], [(10, 10), (30, 10), (30, 30), (10, 30)]]})
    assert {r.ring for r in buildings.exterior(w).select("ring").collect()} == {0}
    s = spark.createDataFrame([(1, 5.0, 20.0, -5.0, 20.0), (2, 5.0, 20.0, 20.0, 20.0), (3, 5.0, 20.0, 60.0, 20.0), (4, 5.0, 20.0, 5.0, 60.0)], SEG)
    got = {r.id: (r.straight, r.nearest) for r in buildings.leads(s, w).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, False)}
    spots = spark.createDataFrame([(1, 20.0, 20.0), (2, 0.0, 7.0), (3, 41.0, 5.0), (4, 5.0, 5.0)], "id long, x double, y double")
    assert {r.id for r in buildings.owners(spots, w).collect()} == {2, 4}


def test_envelopes_equal_sampling(spark):
    ring, need = NOTCH, 3.0
    w = walls(spark, {1: [ring]})
    r = np.random.default_rng(0)
    ends = r.uniform(-15, 45, size=(40, 4))
    s = spark.createDataFrame([(k, *map(float, e)) for k, e in enumerate(ends)], SEG)
    got = {}
    for row in buildings.envelope_intervals(s, w, F.lit(need)).collect():
        got.setdefault(row.id, []).append((row.cut, row.next))
    from kelvingrid.functions import planar

    segs = planar.ring_segments(np.array([*ring, ring[0]], dtype=float))
    for k, e in enumerate(ends):
        length = np.hypot(e[2] - e[0], e[3] - e[1])
        for t in np.linspace(0, 1, 200):
            p = e[:2] + t * (e[2:] - e[:2])
            gap = 0.0 if planar.inside(p, segs) else planar.segment_distances(p, p, segs).min()
            if abs(gap - need) > 1e-3:
                assert any(a - 1e-6 <= t * length <= b + 1e-6 for a, b in got.get(k, [])) == (gap < need)


def test_approaches_and_escapes(spark):
    w = walls(spark, {1: [NOTCH]})
    need = 5 + 0.51 / 2
    t = spark.createDataFrame([(1, 28.0, 10.0)], "id long, x double, y double")
    ports = buildings.ports(t, w, 100).where("lead < 3")
    out = buildings.escapes(ports, t, w, 100).collect()
    from kelvingrid.functions import planar

    segs = planar.ring_segments(np.array([*NOTCH, NOTCH[0]], dtype=float))
    assert len(out) >= 3 and all(abs(planar.segment_distances(np.array([r.x, r.y]), np.array([r.x, r.y]), segs).min() - need - 0.25) < 0.06 for r in out)
    s = spark.createDataFrame([(1, 1, 12.0, 8.0, 12.0, 60.0), (2, 1, 12.0, 8.0, 25.0, 8.0), (3, 1, 36.0, 10.0, 36.0, 40.0), (4, 1, 31.0, 10.0, 31.0, 15.0)], "id long, owner long, ax double, ay double, bx double, by double")
    assert {r.id: r.legal for r in buildings.approaches(s, w, 100).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_transit(spark):
    w = walls(spark, {1: [BLOCK]})
    legs = [(1, 0.0, -20.0, 10.0, 50.0, 10.0), (2, 0.0, -20.0, 10.0, 10.0, 10.0), (3, 0.0, -20.0, 10.0, 5.0, 10.0), (3, 25.0, 5.0, 10.0, 5.0, 15.0), (4, 0.0, -20.0, 30.0, 10.0, 30.0), (5, 0.0, -20.0, 5.0, 35.0, 5.0), (5, 55.0, 35.0, 5.0, 15.0, 5.0)]
    ends = [(1, 70.0, False, 50.0, 10.0), (2, 30.0, True, 10.0, 10.0), (3, 30.0, True, 5.0, 15.0), (4, 30.0, True, 10.0, 30.0), (5, 75.0, True, 15.0, 5.0)]
    got = buildings.transit_violations(spark.createDataFrame(legs, "edge long, at double, ax double, ay double, bx double, by double"), spark.createDataFrame(ends, "edge long, length double, terminal boolean, x double, y double"), w)
    assert {(r.edge, r.rule) for r in got.collect()} == {(1, "transit"), (3, "lead"), (5, "passages")}


def crossing(spark, rows):
    return spark.createDataFrame(rows, "edge long, length double, dn int, type string, low double, high double, object_dn int")


def test_profile_over_a_cable_and_under_a_pipe(spark):
    c = crossing(spark, [(1, 100.0, 100, "power_cable", 50.0, 50.0, None), (2, 100.0, 100, "power_cable", 10.0, 10.0, None), (3, 100.0, 100, None, 50.0, 50.0, 300), (4, 100.0, 100, "road", 40.0, 50.0, None)])
    i = {r.edge: r for r in depth.crossing_intervals(c).collect()}
    assert (i[1].low, i[1].high, round(i[1].depth, 6)) == (48, 52, round(2.7 - 0.5 - 0.18, 6)) and round(i[2].depth, 6) == 3.4
    assert round(i[3].depth, 6) == round(3 - 0.5 - 0.18, 6) and (i[4].low, i[4].high, i[4].depth, i[4].below) == (37, 53, 3, None)
    edges = c.select("edge", "length", "dn")
    parts = depth.pieces(edges, depth.reconciled(depth.crossing_intervals(c)))
    assert depth.profile_violations(parts).count() == 0
    x = spark.createDataFrame([(1, 50.0, 100.0, 100, 2.7, 0.2, 0.5), (2, 10.0, 100.0, 100, 2.7, 0.2, 0.5), (3, 50.0, 100.0, 100, 3.0, 0.45, 0.5), (4, 1.0, 100.0, 100, 3.0, 0.4, 0.5)], "edge long, x double, length double, dn int, top double, height double, gap double")
    assert {(r.edge, r.rule) for r in depth.crossing_violations(parts, x).collect()} == {(4, "plateau-room")}
    flat = depth.pieces(edges, depth.crossing_intervals(c, deep=False), deep=False).where("edge = 4").orderBy("at").collect()
    assert [(r.at, r.to, r.factor) for r in flat] == [(0, 37, 1), (37, 53, 1.6), (53, 100, 1)] and flat[1].cost == pytest.approx(16 * 89748 * 1.6)
    assert depth.cover_violations(parts, spark.createDataFrame([(1, "road", 40.0, 60.0)], "edge long, type string, low double, high double")).count() == 0


def test_depths_settle(spark):
    assert depth.settled([10, 15], [14, 19], [4, 2], [4, 4.5], [0.7, 0.7]) == [pytest.approx(4.4), 4.5]  # and passes below follow each other
    assert depth.settled([15], [19], [2], [4.5], [0.7]) == [2]
    assert depth.settled([48, 45], [52, 55], [0.8, 3], [3.4, None], [0.7, 1.0]) == [3.4, 3]  # too little cover under a road
    assert depth.settled([10, 16], [14, 20], [4, 3.2], [4, 3.2], [0.7, 0.7]) == [4, pytest.approx(3.8)]  # a plateau follows its neighbour's ramp
    rows = spark.createDataFrame([(1, 16.0, 20.0, 1.0, 3.2, 3.2, 0.7), (1, 10.0, 14.0, 1.0, 4.0, 4.0, 0.7), (2, 1.0, 2.0, 1.0, 3.0, None, 1.0)], "edge long, low double, high double, factor double, depth double, below double, minimum double")
    assert {(r.edge, r.low): round(r.depth, 6) for r in depth.reconciled(rows).collect()} == {(1, 16): 3.8, (1, 10): 4, (2, 1): 3}


def test_snapping_is_greedy_in_order(spark):
    r = np.random.default_rng(5)
    points = [(float(x), float(y)) for x, y in r.uniform(0, 30, size=(120, 2))] + [(float(k), 100.0) for k in range(12)]
    heads, want = [], {}
    for k, p in enumerate(points):
        near = [h for h in heads if np.hypot(p[0] - points[h][0], p[1] - points[h][1]) < 2]
        want[k] = near[0] if near else k
        if not near:
            heads.append(k)
    df = spark.createDataFrame([(k, k, *p) for k, p in enumerate(points)], "key long, order long, x double, y double")
    assert {x.key: x.vertex for x in topology.snapped(df).collect()} == want


def test_resolve_keeps_what_is_there(spark):
    source = spark.createDataFrame([("s", 0.0, 0.0)], "id string, x double, y double")
    pipes = spark.createDataFrame([("a", None, 200, 10.0, 0.5, 0.0, 10.0, 0.0), ("b", None, 100, 10.0, 20.0, 0.0, 10.5, 0.0), ("c", "given", 80, 10.0, 20.0, 0.5, 30.0, 0.0)], "id string, upstream string, dn int, length double, ax double, ay double, bx double, by double")
    chambers = spark.createDataFrame([("k", None, None, 10.0, 0.5), ("m", "a", 65, 20.0, 0.0), ("far", "given", None, 500.0, 500.0)], "id string, upstream string, dn int, x double, y double")
    lines, nodes = topology.resolve(source, pipes, chambers)
    assert {r.id: r.upstream for r in lines.collect()} == {"a": "s", "b": "k", "c": "given"}
    assert {r.id: (r.upstream, r.dn) for r in nodes.collect()} == {"k": ("a", 200), "m": ("a", 65), "far": ("given", 200)}
