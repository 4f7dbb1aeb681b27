from itertools import product

import numpy as np
import pytest

from kelvingrid.functions import planar
from kelvingrid.operators import planner, routing, treedp


def square(x0, y0, x1, y1):
    return np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]], dtype=float)


def test_direct_route_is_straight():
    path, cost = routing.Router([]).route(np.array([0.0, 0]), np.array([100.0, 0]), 100)
    assert len(path) == 2 and cost == 100


@pytest.mark.parametrize("ring, least", [((40, -10, 60, 10), 100), ((40, -220, 60, 220), 450)])
def test_detours_keep_clear(ring, least):
    park = routing.obstacle("park", [square(*ring)], True)
    path, cost = routing.Router([park]).route(np.array([0.0, 0]), np.array([100.0, 0]), 100)
    assert planar.length(path) > least
    gap = min(planar.segment_distances(a, b, park.segments).min() for a, b in zip(path[:-1], path[1:]))
    assert gap >= 1.255 - 1e-9


@pytest.mark.parametrize("ring, spot, start, lead, low, high", [
    ([(0, 0), (30, 0), (30, 20), (0, 20)], (28, 10), (-20, 10), 2, 30, 99),
    ([(0, 0), (30, 0), (30, 20), (14, 20), (14, 5), (10, 5), (10, 20), (0, 20)], (8, 10), (-20, 30), 2, 10, 14),
])
def test_a_terminal_is_reached_through_the_nearest_facade(ring, spot, start, lead, low, high):
    home = routing.obstacle("oks_existing", [np.array([*ring, ring[0]], dtype=float)], True)
    path, _ = routing.Router([home]).route(np.array(start, dtype=float), np.array(spot, dtype=float), 100)
    inside = [sum(hi - lo for lo, hi in planar.clip(a, b, home.segments)) for a, b in zip(path[:-1], path[1:])]
    assert inside[-1] == pytest.approx(lead) and max(inside[:-1]) < 1e-5 and low < path[-2][0] < high


def test_a_blocked_facade_is_left_for_another():
    home = routing.obstacle("oks_existing", [square(0, 0, 30, 20)], True)
    park = routing.obstacle("park", [square(31, 4, 42, 16)], True)
    path, _ = routing.Router([home, park]).route(np.array([-20.0, 30]), np.array([28.0, 10]), 100)
    assert planar.clip(path[-2], path[-1], home.segments)[0][1] - planar.clip(path[-2], path[-1], home.segments)[0][0] == pytest.approx(10)


def test_existing_pipes_are_crossed_not_followed():
    line = routing.pipe(np.array([[50.0, -100, 50, 100]]), 100)
    r = routing.Router([line])
    assert r.legal(np.array([0.0, 0]), np.array([100.0, 0]), 100) == (True, 1.05, "")
    assert r.legal(np.array([50.0, 0]), np.array([100.0, 0]), 100, np.array([50.0, 0])) == (True, 1.0, "")
    assert r.legal(np.array([50.0, 0]), np.array([50.0, 50]), 100)[2] == "overlap-existing-network"
    assert r.legal(np.array([51.0, 0]), np.array([51.0, 50]), 100)[2] == "clearance-existing-network"


def test_planned_lines_are_gone_round():
    park = routing.obstacle("park", [square(40, -10, 60, 10)], True)
    lines = np.array([[50.0, 0, 50, 300]])
    path, _ = routing.Router([park]).route(np.array([0.0, 0]), np.array([100.0, 0]), 100, lines)
    assert all(p[1] <= 1e-9 for p in path)


def test_crossings():
    road = routing.obstacle("road", [np.array([[50.0, -20], [50, 20]])], False)
    assert routing.assess(np.array([0.0, 0]), np.array([100.0, 0]), 100, [road]) == (True, 1.60, "")
    assert not routing.assess(np.array([48.0, -15]), np.array([53.0, 15]), 100, [road])[0]
    rail = routing.obstacle("railway", [np.array([[50.0, -20], [50, 20]])], False)
    assert not routing.assess(np.array([0.0, 0]), np.array([100.0, 0]), 100, [rail])[0]


def every_assignment(counts, costs, k):
    nodes, rows = sorted(counts), []
    for picks in product(*(range(counts[n]) for n in nodes)):
        at = dict(zip(nodes, picks))
        rows.append((sum(float(m[at[p], at[c]]) for (p, c), m in costs.items()), sorted(at.items())))
    return [(c, dict(p)) for c, p in sorted(r for r in rows if np.isfinite(r[0]))[:k]]


@pytest.mark.parametrize("most", [50, 4])  # few costs: many ties, which go by the candidates in node order
def test_tree_assignments_equal_brute_force(most):
    r = np.random.default_rng(1)
    counts = {0: 2, 1: 3, 2: 2, 3: 3, 4: 2, 5: 2}
    costs = {e: r.integers(1, most, size=(counts[e[0]], counts[e[1]])).astype(float) for e in ((0, 1), (0, 3), (1, 2), (1, 5), (3, 4))}
    costs[(1, 2)][0, 1] = np.inf
    assert treedp.best_assignments(counts, costs, 0, 9) == every_assignment(counts, costs, 9)
    with pytest.raises(ValueError):
        treedp.check([(0, 1), (2, 1)], 0)


def test_tree_assignments_by_plan(spark):
    rows = [(p, 0, 1, i, j, float(p + i * 2 + j)) for p in (1, 2) for i in range(2) for j in range(2)]
    df = spark.createDataFrame(rows, "plan long, parent long, child long, i int, j int, cost double")
    got = treedp.top_assignments(df, 3).where("node = 1").orderBy("plan", "rank").collect()
    assert [(r.plan, r.rank, r.cost) for r in got] == [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 1, 2.0), (2, 2, 3.0), (2, 3, 4.0)]


def scene(extra=()):
    terminals = [(f"o{k}", 40.0 + 60 * k, 70.0 if k % 2 else 105.0, 10.0 + 2 * k) for k in range(4)]
    ties = [(f"p@{x}", "heat_network", float(x), 0.0, 1) for x in range(0, 301, 24)] + [("c1", "heat_chamber", 300.0, 0.0, 3)]
    return planner.Scene(terminals, ties, routing.Router([routing.obstacle("park", [square(90, 20, 130, 60)], True), *extra]))


def test_growth_connects_all_and_refinement_does_not_hurt():
    s = scene()
    plan = planner.build(s)
    value = planner.evaluate(plan, s)
    assert value["unconnected"] == 0 and plan.connected() == {"o0", "o1", "o2", "o3"}
    better = planner.straighten(planner.reconnect(plan, s), s)
    assert planner.evaluate(better, s)["score"] <= value["score"] + 1e-9
    assert all(plan.degree(n) <= 4 for n in plan.nodes)


def test_diameters_of_chains():
    nodes = {k: planner.Node("CHAMBER" if k < 3 else "TERMINAL", 300.0 * k, 0.0, "a" if k == 3 else None) for k in range(4)}
    edges = {k: (k - 1, np.array([[300.0 * (k - 1), 0], [300.0 * k, 0]]), 300.0) for k in (1, 2, 3)}
    assert planner.diameters(planner.Plan(nodes, edges), {"a": 20.0}) == {1: 200, 2: 200, 3: 200}


def test_optimise_over_starts(spark):
    s = scene()
    ring = [{"x": float(x), "y": float(y)} for x, y in square(90, 20, 130, 60)]
    scenes = spark.createDataFrame([("one", [dict(zip(("oks_id", "x", "y", "flow"), t)) for t in s.terminals], [dict(zip(("id", "type", "x", "y", "free"), t)) for t in s.ties], [{"type": "park", "closed": True, "rings": [ring]}], [{"dn": 300, "legs": [{"ax": 0.0, "ay": 0.0, "bx": 300.0, "by": 0.0}]}])], "scenario string, terminals array<struct<oks_id:string,x:double,y:double,flow:double>>, ties array<struct<id:string,type:string,x:double,y:double,free:int>>, restrictions array<struct<type:string,closed:boolean,rings:array<array<struct<x:double,y:double>>>>>, pipes array<struct<dn:int,legs:array<struct<ax:double,ay:double,bx:double,by:double>>>>")
    starts = spark.createDataFrame([("one", k) for k in range(3)], "scenario string, start int")
    got = planner.optimise(starts, scenes).groupBy("start", "stage").agg({"unconnected": "max", "score": "max"}).collect()
    assert len(got) == 6 and all(r["max(unconnected)"] == 0 for r in got)
