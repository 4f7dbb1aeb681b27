"""What failed on larger tables: broadcasts of what only looks small, tasks merged by their bytes, values beyond the tables of rules."""

import math
import os
import random

import numpy as np
import pytest

from kelvingrid import network_queries, queries  # noqa: F401
from kelvingrid.functions import geometry as g
from kelvingrid.operators import buildings, depth, graph, legality, reconstruction, spatial
from kelvingrid.plans import shared

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plan(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


@tables
@pytest.mark.parametrize("name", ["building_intervals", "building_transit", "building_leads", "clearance_join", "segment_crossings", "planned_line_conflicts"])
def test_nothing_is_broadcast_and_tasks_are_kept(spark, name, capsys):
    text = plan(queries.QUERIES[name](spark, SF), capsys)
    assert "BroadcastHashJoin" not in text and "REPARTITION_BY_NUM" in text


def test_boxes_of_one_place_meet_only_within_their_key(spark, capsys):
    rows = spark.createDataFrame([(k % 3, k, 0.0, 0.0, 1.0, 1.0) for k in range(9)], "feature long, id long, min_x double, min_y double, max_x double, max_y double")
    for shares in (1, 4):
        found = spatial.overlap_join(rows, rows, 10.0, 0.0, None, ("feature",), shares)
        assert sorted((r.id, r.r_id) for r in found.collect()) == sorted((a, b) for a in range(9) for b in range(9) if a % 3 == b % 3)
        assert "r_feature" in [line for line in plan(found, capsys).splitlines() if "SortMergeJoin" in line][0]


def one_pipe(spark, flow):
    path = "array<struct<x:double,y:double>>"
    ties = spark.createDataFrame([(0, "p", "heat_network", 50.0, 0.0, flow, 80)], "plan long, existing_id string, existing_type string, x double, y double, flow double, dn int")
    pipes = spark.createDataFrame([("p", "s", [(0.0, 0.0), (100.0, 0.0)], 100, 1.0)], f"id string, upstream string, path {path}, dn int, flow double")
    chambers = spark.createDataFrame([], "id string, upstream string, dn int, x double, y double")
    return ties, pipes, chambers, spark.createDataFrame([(0.0, 0.0)], "x double, y double")


def test_a_flow_beyond_the_table_rebuilds_nothing(spark):
    with pytest.raises(Exception, match="no diameter"):
        reconstruction.lines(*one_pipe(spark, 30000.0)).collect()
    assert reconstruction.lines(*one_pipe(spark, 30000.0), strict=False).collect() == []
    assert [r.dn for r in reconstruction.lines(*one_pipe(spark, 40.0), strict=False).collect()] == [150]


def test_diameters_skip_a_flow_beyond_the_table(spark):
    edges = spark.createDataFrame([(1, 2, 30000.0, 50.0), (2, 3, 20000.0, 50.0), (1, 4, 30000.0, 50.0), (2, 5, 1.0, 50.0)], "parent long, child long, flow double, length double")
    assert {r.child: r.dn for r in graph.required_diameters(edges, skip=True).collect()} == {2: 1400, 3: 1400, 4: None, 5: 50}


def test_distances_round_as_in_sql(spark):
    rows = [(float(p * 37 % 997), float(p * 91 % 983), 11.0, 7.0, 311.0, 7.0 + 100 * (p % 5 - 2)) for p in range(400)]
    df = spark.createDataFrame(rows, "x double, y double, ax double, ay double, bx double, by double")

    def sql(x, y, ax, ay, bx, by):
        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        dx, dy = x - ax - t * (bx - ax), y - ay - t * (by - ay)
        return math.sqrt(dx * dx + dy * dy)

    got = df.select("*", g.point_segment(*[df[c] for c in df.columns]).alias("d")).collect()
    assert all(r.d == sql(*r[:6]) for r in got)


def test_contact_along_a_pipe_may_count_as_a_crossing(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0, 200)], "id long, ax double, ay double, bx double, by double, dn int")
    p = spark.createDataFrame([(2, 5.0, 0.0, 15.0, 0.0, 200)], "id long, ax double, ay double, bx double, by double, dn int")
    assert [r.reason for r in legality.network_conflicts(s, p).collect()] == ["overlap-existing-network"]
    assert [(r.reason, r.factor) for r in legality.network_conflicts(s, p, along=False).collect()] == [(None, 1.05)]


def test_a_lead_that_starts_on_the_wall(spark):
    ring = [(0.0, 0.0, 10.0, 0.0), (10.0, 0.0, 10.0, 10.0), (10.0, 10.0, 0.0, 10.0), (0.0, 10.0, 0.0, 0.0)]
    walls = spark.createDataFrame([(7, 0, *w) for w in ring], "owner long, ring int, ax double, ay double, bx double, by double")
    s = spark.createDataFrame([(1, 10.0, 5.0, 30.0, 5.0), (2, 8.0, 5.0, 30.0, 5.0)], "id long, ax double, ay double, bx double, by double")
    assert sorted(tuple(r) for r in buildings.leads(s, walls).collect()) == [(1, 7, 0.0, True, True), (2, 7, 2.0, True, True)]


@tables
def test_degrees_make_no_edges(spark, capsys):
    text = plan(queries.QUERIES["degree_violations"](spark, SF), capsys)
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_depths_settle_edge_by_edge_in_shared_groups(spark):
    rows = [(e, 10.0 * e, 10.0 * e + 4, 1.0, d, b, 0.7) for e in range(20) for d, b in ((4.0, 4.0), (2.0, 4.0))]
    df = spark.createDataFrame(rows, "edge long, low double, high double, factor double, depth double, below double, minimum double")
    assert {r.depth for r in depth.reconciled(df, 2).collect()} == {4.0}


def test_clearance_of_points_is_that_of_segments_without_length(spark):
    p = spark.createDataFrame([(k, float(k % 7), float(k // 7)) for k in range(49)], "id long, x double, y double")
    o = spark.createDataFrame([(1, 1.0, 1.0, 5.0, 2.0, 1.5), (2, 3.0, 3.0, 3.0, 6.0, 0.5)], "id long, ax double, ay double, bx double, by double, need double")
    flat = p.selectExpr("id", "x as ax", "y as ay", "x as bx", "y as by")
    got = lambda df: {(r.id, r.r_id): round(r.gap, 9) for r in spatial.clearance(df, o, 2.0, 1.5).collect()}
    assert got(p) == got(flat) and len(got(p)) > 5


def test_pieces_near_a_chamber_are_cut_by_joins(spark, capsys):
    path = "array<struct<x:double,y:double>>"
    ties = spark.createDataFrame([(0, "c", "heat_chamber", 100.0, 0.0, 1.0, 80)], "plan long, existing_id string, existing_type string, x double, y double, flow double, dn int")
    pipes = spark.createDataFrame([("p", "s", [(0.0, 0.0), (50.0, 0.0), (50.0, 0.0), (100.0, 0.0)], 100, 1.0)], f"id string, upstream string, path {path}, dn int, flow double")
    chambers = spark.createDataFrame([("c", "p", 50, 100.0, 0.0)], "id string, upstream string, dn int, x double, y double")
    for low, high, dn in ((60.0, 98.5, 150), (60.0, 97.5, 100), (0.0, 100.0, 150), (99.0, 100.0, 150)):
        rebuilt = spark.createDataFrame([(0, "p", low, high, 150)], "plan long, id string, low double, high double, dn int")
        found = reconstruction.chambers_of(ties, pipes, chambers, rebuilt)
        assert [r.dn for r in found.collect()] == [dn]
    text = plan(found, capsys)
    assert not any("aggregate(" in line for line in text.splitlines() if "Filter" in line or "Join" in line)


def test_two_buildings_that_share_a_wall_have_a_port_each(spark):
    rings = {1: (0.0, 0.0, 20.0, 20.0), 2: (5.0, 5.0, 20.0, 25.0)}
    walls = spark.createDataFrame([(o, 0, *w) for o, (x0, y0, x1, y1) in rings.items() for w in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))], "owner long, ring int, ax double, ay double, bx double, by double")
    found = buildings.ports(spark.createDataFrame([(1, 15.0, 12.0)], "id long, x double, y double"), walls, 100).where("x > 20").collect()
    assert sorted(r.owner for r in found) == [1, 2] and len({(r.x, r.y) for r in found}) == 1


def test_contact_on_batches_equals_the_columns(spark):
    r = random.Random(5)
    rows = [tuple(float(r.randrange(7)) for _ in range(8)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, r_ax double, r_ay double, r_bx double, r_by double")
    a, b = (tuple(df[p + c] for c in spatial.SEGMENT) for p in ("", "r_"))
    want = df.select(g.touches(a, b), g.segment_segment(a, b), g.overlap_length(a, b)).collect()
    got = spatial.contact(df).select("meets", "gap", "along").collect()
    assert [r[0] for r in got] == [r[0] for r in want] and 0 < sum(r[0] for r in got) < 3000
    assert max(abs(x[k] - y[k]) for x, y in zip(got, want, strict=True) for k in (1, 2)) < 1e-12


def test_only_what_meets_a_wall_or_starts_in_a_box_is_cut(spark):
    walls = spark.createDataFrame([(7, 0.0, 0.0, 90.0, 90.0), (7, 90.0, 90.0, 90.0, 0.0), (7, 90.0, 0.0, 0.0, 0.0)], "owner long, ax double, ay double, bx double, by double")
    s = spark.createDataFrame([(1, 50.0, 10.0, 60.0, 20.0), (2, 1.0, 80.0, 70.0, 85.0), (3, -10.0, 30.0, 100.0, 30.0), (4, 10.0, 0.0, 20.0, 0.0)], "id long, ax double, ay double, bx double, by double")
    found = {r.id: (round(r.cut, 6), round(r.next, 6)) for r in spatial.cut_intervals(s, walls, 50.0).collect()}
    assert found == {1: (0.0, round(200**0.5, 6)), 3: (40.0, 100.0), 4: (0.0, 10.0)}
    pairs = spatial.nearby(s, walls, 50.0, 1e-9).select("id").distinct().collect()
    assert sorted(r.id for r in pairs) == [3, 4]


def test_a_terminal_on_a_wall_leaves_outward(spark):
    ring = [(0.0, 0.0, 40.0, 0.0), (40.0, 0.0, 40.0, 5.0), (40.0, 5.0, 0.0, 5.0), (0.0, 5.0, 0.0, 0.0)]
    walls = spark.createDataFrame([(7, 0, *w) for w in ring], "owner long, ring int, ax double, ay double, bx double, by double")
    found = buildings.ports(spark.createDataFrame([(1, 20.0, 0.0)], "id long, x double, y double"), walls, 100)
    assert sorted((round(r.x, 3), round(r.y, 3)) for r in found.collect()) == [(-5.455, 0.0), (20.0, -5.455), (20.0, 10.455), (45.455, 0.0)]


def test_long_segments_are_listed_along_themselves_and_no_crossing_is_lost(spark, capsys):
    r = random.Random(7)
    rows = [(k, *(float(r.randrange(-60, 60)) for _ in range(4))) for k in range(200)] + [(200, 5.0, -60.0, 5.0, 60.0), (201, -60.0, 5.0, 60.0, 5.0), (-1, 0.0, 40.0, 40.0, 0.0), (203, 10.0, 30.0, 60.0, -20.0), (202, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double")
    turn = lambda s, x, y: (s[3] - s[1]) * (y - s[2]) - (s[4] - s[2]) * (x - s[1])
    sides = lambda s, t: (turn(s, *t[1:3]), turn(s, *t[3:5]))
    cross = {(s[0], t[0]) for s in rows[:-1] for t in rows[:-1] if s[0] < t[0] and min(sides(s, t)) < 0 < max(sides(s, t)) and min(sides(t, s)) < 0 < max(sides(t, s))}
    for size in (1000.0, 10.0, 2.5):
        got = [(x.id, x.r_id) for x in spatial.crossings(df, size).collect()]
        assert len(got) == len(set(got)) and set(got) == cross
    one = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 990.0)], df.schema)
    assert spatial.line_cells(one, 10.0).count() < 310  # its box has 10,000
    want = {(x.id, x.r_id) for x in df.where("id < 60").join(df.where("id >= 60").selectExpr("id r_id", "ax r_ax", "ay r_ay", "bx r_bx", "by r_by"), g.touches(tuple(df[c] for c in spatial.SEGMENT), tuple(spatial.F.col("r_" + c) for c in spatial.SEGMENT))).collect()}
    found = legality.new_line_conflicts(df.where("id < 60"), df.where("id >= 60"), 10.0, single=True)
    got = [(x.id, x.other) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "Aggregate" not in plan(found, capsys)


def test_pairs_of_a_nearest_search_are_ranked_where_they_are_found(spark, capsys):
    r = random.Random(3)
    pts = spark.createDataFrame([(k, r.uniform(-50, 50), r.uniform(-50, 50)) for k in range(60)], "id long, x double, y double")
    seg = spark.createDataFrame([(k, *(r.uniform(-50, 50) for _ in range(4)), f"s{k}") for k in range(40)], "id long, ax double, ay double, bx double, by double, name string")
    found = spatial.reached(pts, seg, 20.0, 10.0, 5)
    ranked = found.withColumn("n", spatial.F.row_number().over(spatial.Window.partitionBy("cx", "cy", "id").orderBy("r_id")))
    assert plan(ranked, capsys).count("Exchange") == 2
    got = spatial.nearest(pts, seg, 3, "id", "id", 5.0, keep=("name",)).collect()
    assert len(got) == 180 and all(x.r_name == f"s{x.r_id}" and x.x is not None for x in got)
    d = g.point_segment(spatial.F.col("x"), spatial.F.col("y"), *[spatial.F.col("r_" + c) for c in spatial.SEGMENT])
    every = pts.crossJoin(seg.select(*[seg[c].alias("r_" + c) for c in seg.columns])).withColumn("d", d).collect()
    for p in range(60):
        assert [x.r_id for x in sorted((x for x in got if x.id == p), key=lambda x: x.rank)] == [x.r_id for x in sorted((x for x in every if x.id == p), key=lambda x: (x.d, x.r_id))[:3]]


def test_edges_settle_together_as_they_do_alone():
    r = random.Random(11)
    for n in (2, 3, 5):
        rows = []
        for _ in range(300):
            kind = [r.randrange(3) for _ in range(n)]
            low = sorted(float(r.randrange(100)) for _ in range(n))
            rows.append((low, [x + 4 for x in low], [(2.0, 4.0, 3.0)[k] for k in kind], [(4.0, 4.0, math.nan)[k] for k in kind], [(0.7, 0.7, 2.5)[k] for k in kind]))
        got = depth.settled_together(*(np.array(v) for v in zip(*rows, strict=True)))
        want = [depth.settled(lo, hi, d, [None if b != b else b for b in under], least) for lo, hi, d, under, least in rows]
        assert got.tolist() == want and (got != np.array([x[2] for x in rows])).any()


def test_partitions_grow_with_the_rows(spark):
    assert shared.parts(spark, 10, 1000) == shared.tasks(spark) and shared.parts(spark, 216_000_000, 40_000) == 5400
    assert shared.shares(spark.range(4_000_000)) == 100


def test_short_walls_are_listed_once(spark, capsys):
    r = random.Random(2)
    s = spark.createDataFrame([(k, *(r.uniform(0, 300) for _ in range(4))) for k in range(40)] + [(40, 7.0, 0.0, 7.0, 300.0)], "id long, ax double, ay double, bx double, by double")
    corner = [(r.uniform(0, 300), r.uniform(0, 300)) for _ in range(80)]
    walls = spark.createDataFrame([(k, x, y, x + r.uniform(-20, 20), y + r.uniform(-20, 20)) for k, (x, y) in enumerate(corner)], s.schema)
    found = spatial.nearby(s, walls, 100.0, 9.0)
    assert plan(found, capsys).split("Initial Plan")[0].count("Generate explode") == 2  # cells of the segments only
    got = {(x.id, x.r_id): x.gap for x in spatial.contact(found).collect()}
    a, b = (tuple(spatial.F.col(p + c) for c in spatial.SEGMENT) for p in ("", "r_"))
    every = s.crossJoin(walls.select(*[walls[c].alias("r_" + c) for c in walls.columns])).withColumn("gap", g.segment_segment(a, b)).where("gap <= 9").collect()
    assert len(got) == found.count() and len(every) > 20 and all((x.id, x.r_id) in got for x in every)
