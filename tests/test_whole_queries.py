"""Queries over whole tables against brute force on the smallest tables."""

import math
import os
from collections import Counter

import pytest

from kelvingrid import queries
from kelvingrid.operators import candidates, spatial

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_degrees_count_every_part(spark):
    sizes = {r.p_partkey: r.p_size for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    suppliers = sorted(r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect())
    degree = Counter()
    for p, size in sizes.items():
        for k in range(size % 7):
            degree[-1 - p] += 1
            degree[suppliers[(p * 7 + k) % len(suppliers)]] += 1
    got = {r.node: r.degree for r in queries.QUERIES["degree_violations_all"](spark, SF).collect()}
    assert got == {n: d for n, d in degree.items() if d > 4}
    assert any(n < 0 and sizes[-1 - n] >= 6 for n in got)


def test_links_come_from_the_64_nearest(spark):
    at = {r.id: (r.x, r.y) for r in queries.terminals(spark, SF).collect()}
    near = {a: sorted((b for b in at if b != a), key=lambda b: (math.dist(at[a], at[b]), b))[:64] for a in at}
    got = queries.QUERIES["nearest_node_knn"](spark, SF).collect()
    assert {(r.id, r["rank"]): r.other for r in got} == {(a, k + 1): b for a, bs in near.items() for k, b in enumerate(bs)}
    want = set()
    for a, bs in near.items():
        tries = {}
        for b in bs:
            s = min(15, math.floor((math.atan2(at[b][1] - at[a][1], at[b][0] - at[a][0]) + math.pi) / (2 * math.pi) * 16))
            tries.setdefault(s, []).append(b)
        for s, found in tries.items():
            want |= {(a, b, s, k + 1) for k, b in [(k, b) for k, b in enumerate(found[:6]) if b % 3][:2]}
    links = queries.QUERIES["sector_knn_topk"](spark, SF).collect()
    assert {(r.id, r.other, r.sector, r.attempt) for r in links} == want and {r.id for r in links} == set(at)


def test_neighbours_of_coinciding_points(spark):
    df = spark.createDataFrame([(k, 0.0, 0.0) for k in range(5)] + [(9, 3.0, 4.0)], "id long, x double, y double")
    got = {(r.id, r["rank"]): r.r_id for r in spatial.neighbours(df, 2).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 0, (2, 2): 1, (3, 1): 0, (3, 2): 1, (4, 1): 0, (4, 2): 1, (9, 1): 0, (9, 2): 1}


def test_every_terminal_has_eight_ties(spark):
    got = spark.createDataFrame(queries.QUERIES["tie_candidates_all"](spark, SF).collect())
    n = {r.id: r["count"] for r in got.groupBy("id").count().collect()}
    assert n == {r.id: 8 for r in queries.terminals(spark, SF).collect()}


def test_best_ties_of_a_far_pipe(spark):
    pipe = spark.createDataFrame([(1, 0.0, 0.0, 50.0, 0.0, 100), (2, 0.0, 0.0, 50.0, 0.0, 100)], "id long, ax double, ay double, bx double, by double, dn int")
    chamber = spark.createDataFrame([(5, 0.0, 6.0, 100, 1)], "id long, x double, y double, dn int, degree long")
    terminal = spark.createDataFrame([(0, 30.0, 9000.0, 1.0)], "id long, x double, y double, flow double")
    got = candidates.best_ties(terminal, chamber, pipe, 20).collect()
    # the pipes' ties at one place are different ties; the samples at 0 are the free chamber's
    assert {(r.chamber, r.tie, round(r.chainage, 6)) for r in got} == {(True, 5, -1.0)} | {(False, p, c) for p in (1, 2) for c in (24.0, 30.0, 48.0, 50.0)}
    assert [r.score for r in sorted(got, key=lambda r: r["rank"])] == sorted(r.score for r in got)
