"""Loads pushed up the existing network against walks from each tie."""

import random

import pytest

from kelvingrid.operators import reconstruction
from kelvingrid.plans import rules

RECON = {r[0]: r[4] for r in rules.DN_TABLE}


def frames(spark, pipes, chambers, ties, source=(0.0, 0.0)):
    at = lambda path: [{"x": float(x), "y": float(y)} for x, y in path]
    return (
        spark.createDataFrame(ties, "plan long, existing_id string, existing_type string, x double, y double, flow double, dn int"),
        spark.createDataFrame([(i, u, at(p), d, f) for i, u, p, d, f in pipes], "id string, upstream string, path array<struct<x:double,y:double>>, dn int, flow double"),
        spark.createDataFrame(chambers, "id string, upstream string, dn int, x double, y double"), spark.createDataFrame([source], "x double, y double"),
    )


@pytest.mark.parametrize("back", [False, True])
def test_only_the_affected_parts_are_rebuilt(spark, back):
    path = [(100, 0), (0, 0)] if back else [(0, 0), (100, 0)]
    f = frames(spark, [("pipe", "source", path, 80, 5.0)], [], [(1, "pipe", "heat_network", 30.0, 0.0, 10.0, 80), (1, "pipe", "heat_network", 70.0, 0.0, 10.0, 80)])
    got = reconstruction.lines(*f).collect()
    assert sum(r.length for r in got) == pytest.approx(70) and sum(r.cost for r in got) == pytest.approx(30 * RECON[125] + 40 * RECON[100])
    spans = {(round(100 - r.high, 6), round(100 - r.low, 6)) if back else (round(r.low, 6), round(r.high, 6)) for r in got}
    assert spans == {(0, 30), (30, 70)}


def test_levels_chambers_and_plans_equal_walks(spark):
    r = random.Random(2)
    n = 40
    spot = {k: (r.uniform(0, 3000), r.uniform(0, 3000)) for k in range(n)}
    above = {k: r.randrange(0, k) for k in range(1, n)}
    name = lambda k: "s" if k == 0 else f"c{k}" if k % 5 == 0 else f"p{k}"
    turned = {k: r.random() < 0.5 for k in above}
    pipes = [(f"p{k}", name(u), ([spot[k], spot[u]] if turned[k] else [spot[u], spot[k]]), r.choice([50, 80, 100]), float(r.choice([0, 1, 3]))) for k, u in above.items()]
    chambers = [(f"c{k}", f"p{k}", r.choice([50, 100]), *spot[k]) for k in above if k % 5 == 0]
    size = {k: ((spot[k][0] - spot[u][0]) ** 2 + (spot[k][1] - spot[u][1]) ** 2) ** 0.5 for k, u in above.items()}
    ties, truth = [], []
    for _ in range(60):
        plan, k, flow = r.randrange(3), r.randrange(1, n), round(r.uniform(0.5, 6), 2)
        if k % 5 == 0 and r.random() < 0.5:
            ties.append((plan, f"c{k}", "heat_chamber", *spot[k], flow, r.choice([80, 150])))
            truth.append((plan, k, None, flow))
        else:
            t = r.random()  # from the upstream end
            x, y = (spot[above[k]][i] + t * (spot[k][i] - spot[above[k]][i]) for i in (0, 1))
            ties.append((plan, f"p{k}", "heat_network", x, y, flow, 80))
            truth.append((plan, k, t * size[k], flow))
    whole, partial = {}, {}
    for plan, k, u, flow in truth:
        if u is not None:
            partial.setdefault((plan, k), []).append((u, flow))
            k = above[k]
        while k:  # a chamber hangs on its own pipe, which is loaded too
            whole[plan, k] = whole.get((plan, k), 0.0) + flow
            k = above[k]
    by = {p[0]: p for p in pipes}
    want = {}
    for plan, k in set(whole) | set(partial):
        full, own, (_, _, _, dn, flow) = whole.get((plan, k), 0.0), partial.get((plan, k), []), by[f"p{k}"]
        points = sorted({0.0, *([size[k]] if full else []), *[min(size[k], u) for u, _ in own]})
        for a, z in zip(points, points[1:]):
            added = full + sum(q for u, q in own if u + 1e-9 >= (a + z) / 2)
            need = next(x[0] for x in rules.DN_TABLE if flow + added <= x[1] + 1e-9)
            if z - a >= 1e-6 and added > 1e-9 and need > dn:
                want[plan, f"p{k}", round((size[k] - z) if turned[k] else a, 4)] = (need, round(z - a, 4), round(added, 4))
    f = frames(spark, pipes, chambers, ties, spot[0])
    lines = reconstruction.lines(*f)
    rows = lines.collect()
    assert {(r.plan, r.id, round(r.low, 4)): (r.dn, round(r.length, 4), round(r.added_flow, 4)) for r in rows} == want and len(want) > 40
    need = {}
    for (plan, *_), (i, kind, _, _, _, dn) in zip([(t[0],) for t in ties], [t[1:] for t in ties]):
        if kind == "heat_chamber":
            need[plan, i] = max(need.get((plan, i), 0), dn)
    for plan, i in need:
        k = int(i[1:])
        for j in [k, *[c for c, u in above.items() if u == k]]:
            need[plan, i] = max(need[plan, i], by[f"p{j}"][3])
            for (p, name_, low), (dn, length, _) in want.items():
                up = size[j] - low - length if turned[j] else low  # from the upstream end
                if p == plan and name_ == f"p{j}" and (up < 2 if j != k else size[j] - up - length < 2):
                    need[plan, i] = max(need[plan, i], dn)
    old = {c[0]: c[2] for c in chambers}
    got = {(r.plan, r.id): (r.existing_dn, r.dn) for r in reconstruction.chambers_of(f[0], f[1], f[2], lines).collect()}
    assert got == {k: (old[k[1]], d) for k, d in need.items() if d > old[k[1]]} and got


def test_without_ties(spark):
    f = frames(spark, [("p", "s", [(0, 0), (9, 0)], 50, 1.0)], [], [])
    assert reconstruction.lines(*f).count() == 0
