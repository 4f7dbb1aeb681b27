"""Whole shapes in cells against joins wall by wall, and that pairs aren't shuffled."""

import math
import os
import random

import pytest

from kelvingrid import network_queries, queries  # noqa: F401
from kelvingrid.operators import buildings, legality, shapes, spatial

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
WALL = "owner long, ring int, type string, closed boolean, ax double, ay double, bx double, by double"


def scene(spark, wide=True):
    """Triangles, houses with courtyards, lines, and one polygon that is wide against the cells."""
    r = random.Random(4)
    rows = []
    for k in range(60):
        x, y = r.randrange(300), r.randrange(300)
        if k % 3 == 0:
            rings, kind = [[(x, y), (x + r.randrange(5, 40), y + r.randrange(9)), (x + r.randrange(20), y + r.randrange(10, 40)), (x, y)]], "park"
        elif k % 3 == 1:
            box = lambda a, b, w: [(a, b), (a + w, b), (a + w, b + w), (a, b + w), (a, b)]
            rings, kind = [box(x, y, 30), box(x + 10, y + 10, 8)], "oks_existing"
        else:
            rings, kind = [[(x, y), (x + r.randrange(-20, 20), y + r.randrange(-20, 20) + 0.5), (x + 9, y - 30)]], ("road", "gas_pipeline")[k % 2]
        rows += [(k, i, kind, k % 3 < 2, *map(float, (*a, *b))) for i, ring in enumerate(rings) for a, b in zip(ring, ring[1:])]  # noqa: B905
    if wide:
        ring = [(20.0, 20.0), (280.0, 40.0), (150.0, 290.0), (20.0, 20.0)]
        rows += [(99, 0, "water", True, *a, *b) for a, b in zip(ring, ring[1:])]  # noqa: B905
    s = [(k, *(float(r.randrange(300)) for _ in range(4)), 200) for k in range(120)] + [(120, 0.0, 50.0, 300.0, 50.0, 200), (121, None, 1.0, 2.0, 3.0, 200)]
    return spark.createDataFrame(s, "id long, ax double, ay double, bx double, by double, dn int"), spark.createDataFrame(rows, WALL)


def same(got, want, digits=7):
    tidy = lambda rows: sorted(tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in rows.collect())
    a, b = tidy(got), tidy(want)
    assert a == b
    return a


def exchanges(df, capsys) -> list[str]:
    df.explain()
    lines = capsys.readouterr().out.splitlines()
    top = next(k for k, line in enumerate(lines) if "FlatMapCoGroupsInArrow" in line)
    return [line for line in lines[:top] if "Exchange" in line]


@tables
def test_pairs_of_segments_and_buildings_are_not_shuffled(spark, capsys):
    assert exchanges(queries.QUERIES["building_intervals"](spark, SF), capsys) == []


def test_intervals_equal_those_by_walls(spark):
    s, w = scene(spark)
    w = w.where("closed")
    split = shapes.Split(w, 200.0, 1e-9)
    assert split.some and {r.owner for r in split.rest.collect()} == {99}
    assert len(same(spatial.cut_intervals(s, w, 200.0), spatial.cut_by_walls(s, w, 200.0))) > 100


@tables
def test_pairs_of_segments_and_restrictions_are_not_shuffled(spark, capsys):
    assert exchanges(queries.QUERIES["restriction_legality"](spark, SF), capsys) == []


def test_restrictions_equal_those_by_walls(spark, monkeypatch):
    s, w = scene(spark)
    s = s.where("ax is not null")
    got = legality.restriction_conflicts(s, w).cache()
    some = {r.id for r in legality.restriction_conflicts(s.selectExpr("*", "true once"), w).where("reason is not null").collect()}
    with monkeypatch.context() as m:
        m.setattr(shapes, "WALLS", 0)
        found = same(got, legality.restriction_conflicts(s, w))
    assert len({r[2] for r in found}) > 4 and some == {r[0] for r in found if r[2]}


@tables
def test_passages_are_not_shuffled(spark, capsys):
    assert exchanges(queries.QUERIES["building_transit"](spark, SF), capsys) == []


def test_passages_of_bent_paths_equal_those_by_walls(spark):
    _, w = scene(spark)
    w = w.where("closed")
    r = random.Random(9)
    paths = [[(r.randrange(300), r.randrange(300))] for _ in range(150)]
    for p in paths:
        for _ in range(r.randrange(1, 5)):
            p.append((p[-1][0] + r.randrange(-60, 60), p[-1][1] + r.randrange(-60, 60)))
    legs, ends = [], []
    for e, p in enumerate(paths):
        at = 0.0
        for a, b in zip(p, p[1:]):  # noqa: B905
            legs.append((e, at, *map(float, (*a, *b))))
            at += math.dist(a, b)
        ends.append((e, at, e % 4 > 0, *map(float, p[-1])))
    legs = spark.createDataFrame(legs, "edge long, at double, ax double, ay double, bx double, by double")
    ends = spark.createDataFrame(ends, "edge long, length double, terminal boolean, x double, y double")
    found = same(buildings.transit_violations(legs, ends, w), buildings._transit_by_walls(legs, ends, w, 200.0))
    assert {r[2] for r in found} == {"transit", "passages", "lead"}


@tables
def test_leads_are_not_shuffled(spark, capsys):
    assert exchanges(queries.QUERIES["building_leads"](spark, SF), capsys) == []


def test_leads_and_owners_equal_those_by_walls(spark):
    s, w = scene(spark)
    w = w.where("closed")
    found = same(buildings.leads(s, w), buildings._leads_by_walls(s, w, 100.0))
    assert {r[3:] for r in found} == {(True, True), (True, False), (False, False)}
    points = s.selectExpr("id", "ax x", "ay y").where("x is not null")
    same(buildings.owners(points, w), buildings._owners_by_walls(points, w))


@tables
def test_ports_are_ranked_in_their_cell(spark, capsys):
    assert exchanges(buildings.ports(queries.boxes(spark, SF).selectExpr("id", "min_x + 1 x", "min_y + 1 y"), network_queries.walls(spark, SF), 100), capsys) == []


@pytest.mark.parametrize("wide", [False, True])
def test_ports_equal_those_by_walls(spark, wide):
    s, w = scene(spark, wide)
    w = w.where("closed")
    points = s.selectExpr("id", "ax x", "ay y").where("x is not null")
    assert len(same(buildings.ports(points, w, 100), buildings._ports_by_walls(points, w, 100), 6)) > 100


def test_ports_straight_across_have_no_angle(spark):
    """Of walls along an axis the port lies straight across; rounding dealt those to the left over two sectors, of which each kept three."""
    rings = [(10.0 - k, 0.0, 40.0 + k, 17.0) for k in range(6)] + [(10.0 - k, 0.0, 40.0 + k, 7.0) for k in range(6, 9)]
    walls = spark.createDataFrame([(o, 0, *w) for o, (x0, y0, x1, y1) in enumerate(rings) for w in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))], "owner long, ring int, ax double, ay double, bx double, by double")
    spots = spark.createDataFrame([(0, 17.0, 3.5999999999999996)], "id long, x double, y double")  # 17 + (3.6 - 17) is another number
    at = {r.id: (r.x, r.y) for r in spots.collect()}
    for found in (buildings.ports(spots, walls, 100), buildings._ports_by_walls(spots, walls, 100)):
        rows = found.collect()
        assert all(r.x == at[r.id][0] or r.y == at[r.id][1] for r in rows)
        for k in at:
            left = [r for r in rows if r.id == k and r.x < at[k][0] - 1]
            assert sorted(r["rank"] for r in left) == sorted({r["rank"] for r in left}) and len([r for r in left if r["rank"] > 8]) <= 3
