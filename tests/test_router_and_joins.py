"""The router's test of a segment and the joins' are two forms of one operator: they must agree."""

import numpy as np
from pyspark.sql import functions as F

from kelvingrid.operators import legality, routing, spatial
from kelvingrid.plans import rules


def test_random_segments_among_areas_and_lines(spark):
    r = np.random.default_rng(11)
    kinds = [k[0] for k in rules.RESTRICTIONS] + ["oks_existing"]
    obstacles, legs = [], []
    for k in range(120):
        kind = kinds[k % len(kinds)]
        x, y = r.uniform(0, 2000, 2)
        closed = bool(rules.RESTRICTIONS[k % len(kinds)][1] is False or k % 3) if k % len(kinds) < len(rules.RESTRICTIONS) else True
        if closed:
            w, h = r.uniform(5, 400, 2) if k % 4 == 0 else r.uniform(5, 60, 2)
            ring = np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]])
        else:
            turn = r.uniform(0, np.pi)
            ring = np.array([[x, y], [x + 200 * np.cos(turn), y + 200 * np.sin(turn)], [x + 200 * np.cos(turn) + 50, y + 200 * np.sin(turn) + 20]])
        obstacles.append(routing.obstacle(kind, [ring], closed))
        legs += [(k, kind, closed, *map(float, a), *map(float, b)) for a, b in zip(ring[:-1], ring[1:])]
    a, turn, size = r.uniform(0, 2000, (1000, 2)), r.uniform(0, 2 * np.pi, 1000), r.uniform(1, 250, 1000)
    b = a + size[:, None] * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    dn = [(100, 500, 1000)[k % 3] for k in range(1000)]
    segments = spark.createDataFrame([(k, *map(float, a[k]), *map(float, b[k]), dn[k]) for k in range(1000)], "id long, ax double, ay double, bx double, by double, dn int")
    walls = spark.createDataFrame(legs, "owner long, type string, closed boolean, ax double, ay double, bx double, by double")
    found = legality.assessed(segments, legality.restriction_conflicts(segments, walls))
    joins = {x.id: (x.feasible, round(x.factor, 9)) for x in found.collect()}
    router = {k: (lambda t: (bool(t[0]), round(float(t[1]), 9)))(routing.assess(a[k], b[k], dn[k], obstacles)) for k in range(1000)}
    assert {k: (joins[k], router[k]) for k in joins if joins[k] != router[k]} == {}
    assert 200 < sum(f for f, _ in joins.values()) < 900 and len({f for _, f in joins.values()}) > 3


def test_a_leg_wholly_inside_a_road_is_paid_as_one(spark):
    ring = np.array([[0.0, 0], [1000, 0], [1000, 1000], [0, 1000], [0, 0]])
    for kind, factor in (("road", 1.6), ("tram_tracks", 1.75)):
        road = routing.obstacle(kind, [ring], True)
        assert routing.assess(np.array([400.0, 400]), np.array([600.0, 600]), 100, [road]) == (True, factor, "")
        assert routing.assess(np.array([-50.0, 500]), np.array([1050.0, 500]), 100, [road]) == (True, factor, "")
    walls = spark.createDataFrame([("r", "road", True, *map(float, p), *map(float, q)) for p, q in zip(ring[:-1], ring[1:])], "owner string, type string, closed boolean, ax double, ay double, bx double, by double")
    one = spark.createDataFrame([(1, 400.0, 400.0, 600.0, 600.0, 100)], "id long, ax double, ay double, bx double, by double, dn int")
    assert legality.assessed(one, legality.restriction_conflicts(one, walls)).select("feasible", F.round("factor", 6)).first() == (True, 1.6)
    assert spatial.SEGMENT
