"""Loops over trees and networks against plain versions, and on lines of 100,000 parts."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from kelvingrid.operators import diversity, graph, topology
from kelvingrid.plans import rules

N = 100_000


def smallest(flow, length, floor):
    return next((r[0] for r in rules.DN_TABLE if r[0] >= floor and flow <= r[1] + 1e-9 and length <= r[2] + 1e-9), None)


def brute_diameters(parent, flow, length):
    """Path by path, as the rule is stated: each run of equal flow takes one diameter, none falls toward the root, until nothing changes."""
    inner = set(parent.values())
    dn = {c: smallest(flow[c], 0, 0) for c in parent}
    for _ in range(100):
        old = dict(dn)
        for leaf in parent:
            if leaf in inner:
                continue
            path, c = [], leaf
            while c in parent:
                path.append(c)
                c = parent[c]
            runs = [[path[0]]]
            for a, b in zip(path, path[1:]):
                runs[-1].append(b) if abs(flow[a] - flow[b]) <= 1e-9 else runs.append([b])
            for run in runs:
                d = smallest(max(flow[c] for c in run), sum(length[c] for c in run), max(dn[c] for c in run))
                for c in run:
                    dn[c] = d
            for a, b in zip(path, path[1:]):
                dn[b] = max(dn[a], dn[b])
        if dn == old:
            return dn
    raise AssertionError


@pytest.mark.parametrize("seed", range(3))
def test_diameters_equal_path_by_path(spark, seed):
    r = random.Random(seed)
    n = 70
    parent = {k: r.randrange(max(0, k - 4), k) for k in range(1, n)}
    demand = {k: r.choice([0, 0, 0, 1.5, 4, 30]) for k in range(n)}
    flow = dict(demand)
    for k in range(n - 1, 0, -1):
        flow[parent[k]] += flow[k]
    length = {k: float(r.choice([20, 90, 200])) for k in parent}
    edges = spark.createDataFrame([(p, c, float(flow[c]), length[c]) for c, p in parent.items()], "parent long, child long, flow double, length double")
    assert {x.child: x.dn for x in graph.required_diameters(edges).collect()} == brute_diameters(parent, flow, length)
    runs = {x.child: (x.top, x.length) for x in graph.equal_runs(edges).collect()}
    for c, (top, size) in runs.items():
        total, k = length[c], c
        while k != top:
            k = parent[k]
            total += length[k]
        assert size == pytest.approx(total) and (parent[top] not in parent or abs(flow[top] - flow[parent[top]]) > 1e-9)
    paths = {}
    for x in graph.root_paths(edges).collect():
        paths.setdefault(x.leaf, {})[x["at"]] = x.edge
    want = {}
    for leaf in set(parent) - set(parent.values()):
        c = leaf
        while c in parent:
            want.setdefault(leaf, {})[len(want.get(leaf, {}))] = c
            c = parent[c]
    assert paths == want


def test_a_run_that_nothing_carries(spark):
    edges = spark.createDataFrame([(0, 1, 5.0, 12000.0), (1, 2, 5.0, 10.0), (0, 3, 1.0, 10.0)], "parent long, child long, flow double, length double")
    with pytest.raises(ValueError, match="too long"):
        graph.required_diameters(edges)
    assert {x.child: x.dn for x in graph.required_diameters(edges, strict=False).collect()} == {1: None, 2: None, 3: 50}


def on_or_below(edges):
    left = set(edges)
    while True:
        heads = {c for _, c in left}
        less = {(p, c) for p, c in left if p in heads}
        if less == left:
            return heads
        left = less


@pytest.mark.parametrize("seed", range(4))
def test_cycles_with_and_without_several_parents(spark, seed):
    r = random.Random(seed)
    edges = {(r.randrange(40), k) for k in range(40) for _ in range(1 if seed % 2 else r.choice([0, 1, 1, 2]))}
    got = graph.cyclic(spark.createDataFrame(sorted(edges), "parent long, child long")).collect()
    assert sorted(x.id for x in got) == sorted(on_or_below(edges))


def line(spark, first=0):
    return spark.range(first, N).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))


def test_long_lines_and_rings(spark):
    way = line(spark)
    assert graph.cyclic(way).count() == 0
    ring = way.unionByName(spark.createDataFrame([(N, 0)], "parent long, child long"))
    assert graph.cyclic(ring).count() == N + 1
    sized = way.select("parent", "child", F.lit(1.0).alias("flow"), F.lit(0.05).alias("length"))
    assert {x.dn for x in graph.required_diameters(sized).select("dn").distinct().collect()} == {800}  # 5,000 m
    runs = graph.equal_runs(sized).collect()
    assert [(x.child, x.top) for x in runs] == [(N, 1)] and runs[0].length == pytest.approx(5000)
    nodes = spark.createDataFrame([(0, 0, "TIE_IN", None, "heat_chamber", "e"), (0, N, "TERMINAL", "o1", None, None)], "plan long, node long, kind string, oks_id string, existing_type string, existing_id string")
    assert [x.item for x in diversity.topology_items(nodes, way.withColumn("plan", F.lit(0))).collect()] == ["heat_chamber:e=>o1"]


def test_distances_of_long_lines_combs_and_rings(spark, monkeypatch):
    rounds = []
    whole = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, *a, **k: (rounds.append(1), whole(df, *a, **k))[1])
    roots = spark.createDataFrame([(0,)], "id long")
    way = line(spark).select(F.col("parent").alias("a"), F.col("child").alias("b"), F.lit(1.0).alias("length"))
    got = graph.shortest(way, roots).agg(F.count("*"), F.sum("distance"), F.sum(F.col("id") - F.col("via"))).first()
    assert tuple(got) == (N + 1, N * (N + 1) / 2, N) and len(rounds) < 60
    # a comb: every id of a line has a tooth; and a ring behind, and a part that nothing connects
    comb = way.where("a < 3000").unionByName(spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1_000_000).alias("b"), F.lit(2.0).alias("length")))
    ring = spark.range(50).select((F.lit(2_000_000) + F.col("id")).alias("a"), (F.lit(2_000_000) + (F.col("id") + 1) % 50).alias("b"), F.lit(1.0).alias("length"))
    joined = comb.unionByName(ring).unionByName(spark.createDataFrame([(3000, 2_000_010, 5.0), (5_000_000, 5_000_001, 1.0)], "a long, b long, length double"))
    rounds.clear()
    got = {x.id: x.distance for x in graph.shortest(joined, roots).collect()}
    want = {k: float(k) for k in range(3001)} | {1_000_000 + k: k + 2.0 for k in range(3000)} | {2_000_000 + k: 3005.0 + min((k - 10) % 50, (10 - k) % 50) for k in range(50)}
    assert got == want and len(rounds) < 150


@pytest.mark.parametrize("seed", range(3))
def test_distances_equal_dijkstra(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60), float(r.randrange(1, 30))) for _ in range((55, 90, 200)[seed])]
    roots = [0, 7]
    dist, heap = {}, [(0.0, k) for k in roots]
    while heap:
        d, v = heapq.heappop(heap)
        if v in dist:
            continue
        dist[v] = d
        for a, b, w in edges:
            for x, y in ((a, b), (b, a)):
                if x == v and y not in dist:
                    heapq.heappush(heap, (d + w, y))
    got = graph.shortest(spark.createDataFrame(edges, "a long, b long, length double"), spark.createDataFrame([(k,) for k in roots], "id long")).collect()
    assert {x.id: x.distance for x in got} == dist
    for x in got:
        assert (x.via is None) == (x.id in roots)
        assert x.via is None or any({a, b} == {x.id, x.via} and dist[x.via] + w == x.distance for a, b, w in edges)


def test_a_disconnected_pipe_or_chamber_is_an_error(spark):
    source = spark.createDataFrame([("s", 0.0, 0.0)], "id string, x double, y double")
    pipe = lambda rows: spark.createDataFrame(rows, "id string, upstream string, dn int, length double, ax double, ay double, bx double, by double")
    chamber = lambda rows: spark.createDataFrame(rows, "id string, upstream string, dn int, x double, y double")
    good = [("p", None, 300, 100.0, 0.0, 0.5, 100.0, 0.0)]
    lines, chambers = topology.resolve(source, pipe(good), chamber([("c", None, None, 100.5, 0.0)]))
    assert lines.first().upstream == "s" and tuple(chambers.select("upstream", "dn").first()) == ("p", 300)
    with pytest.raises(topology.Disconnected, match="pipe disconnected.*far"):
        topology.resolve(source, pipe([*good, ("far", None, 100, 10.0, 900.0, 0.0, 910.0, 0.0)]), chamber([]))
    with pytest.raises(topology.Disconnected, match="chamber disconnected.*lone"):
        topology.resolve(source, pipe(good), chamber([("lone", None, 100, 500.0, 500.0)]))
    lines, _ = topology.resolve(source, pipe([*good, ("far", "p", 100, 10.0, 900.0, 0.0, 910.0, 0.0)]), chamber([]))  # says itself where it hangs
    assert {x.id: x.upstream for x in lines.collect()} == {"p": "s", "far": "p"}
