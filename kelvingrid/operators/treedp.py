"""The k cheapest assignments of candidates to the nodes of rooted trees, exactly, one tree to a group."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def check(edges: list[tuple[int, int]], root: int) -> dict[int, list[int]]:
    """Children of each node; an error unless the edges are one tree below the root."""
    children: dict[int, list[int]] = {}
    parents: dict[int, int] = {}
    for p, c in edges:
        if c in parents or c == root:
            raise ValueError(f"node {c} has two parents or is the root")
        parents[c] = p
        children.setdefault(p, []).append(c)
    seen, todo = set(), [root]
    while todo:
        n = todo.pop()
        seen.add(n)
        todo += children.get(n, [])
    if seen != {root} | set(parents):
        raise ValueError("the edges are not one rooted tree")
    return children


def smallest_sums(lists: list[list[tuple[float, tuple]]], k: int) -> list[tuple[float, tuple]]:
    """The k smallest sums of one entry from each sorted list, with their parts joined; ties by the parts in node order.

    Of two sums that differ in one entry only, the order is that entry's, so it never falls along a list, and a list's best entries are enough.
    """
    out: list[tuple[float, tuple]] = [(0.0, ())]
    for options in lists:
        if not options:
            return []
        both = lambda i, j: (out[i][0] + options[j][0], tuple(sorted(out[i][1] + options[j][1])), i, j)  # noqa: E731,B023
        heap = [both(i, 0) for i in range(len(out))]
        heapq.heapify(heap)
        merged = []
        while heap and len(merged) < k:
            cost, picks, i, j = heapq.heappop(heap)
            merged.append((cost, picks))
            if j + 1 < len(options):
                heapq.heappush(heap, both(i, j + 1))
        out = merged
    return out


def best_assignments(counts: dict[int, int], costs: dict[tuple[int, int], np.ndarray], root: int, k: int) -> list[tuple[float, dict[int, int]]]:
    """The k cheapest choices of a candidate for each node; costs[(parent, child)][i, j] may be infinite. Ties by node order."""
    for (p, c), m in costs.items():
        if np.shape(m) != (counts[p], counts[c]) or np.isnan(m).any():
            raise ValueError(f"the costs of {p}-{c} have a wrong shape or nan")
    children = check(list(costs), root)
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += children.get(n, [])
    tables: dict[int, list[list[tuple[float, tuple]]]] = {}
    for n in reversed(order):
        rows = []
        for i in range(counts[n]):
            options = []
            for c in sorted(children.get(n, [])):
                m = costs[(n, c)]
                below = [(m[i, j] + cost, picks) for j in range(counts[c]) if np.isfinite(m[i, j]) for cost, picks in tables[c][j]]
                options.append(heapq.nsmallest(k, below, key=lambda x: (x[0], sorted(x[1]))))
            rows.append([(cost, ((n, i), *picks)) for cost, picks in smallest_sums(options, k)])
        tables[n] = rows
    every = [x for rows in tables[root] for x in rows]
    best = heapq.nsmallest(k, every, key=lambda x: (x[0], sorted(x[1])))
    return [(float(c), dict(sorted(p))) for c, p in best]


def top_assignments(costs: DataFrame, k: int = 8) -> DataFrame:
    """``costs(plan, parent, child, i, j, cost)``, one root in each plan -> (plan, rank, cost, node, candidate)."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        counts: dict[int, int] = {}
        for node, pick in (("parent", "i"), ("child", "j")):
            for n, m in rows.groupby(node)[pick].max().items():
                counts[n] = max(counts.get(n, 0), int(m) + 1)
        matrices = {}
        for (p, c), own in rows.groupby(["parent", "child"]):
            matrices[(p, c)] = np.full((counts[p], counts[c]), np.inf)
            matrices[(p, c)][own.i, own.j] = own.cost
        root = (set(rows.parent) - set(rows.child)).pop()
        found = best_assignments(counts, matrices, root, k)
        return pd.DataFrame([(rows.plan.iloc[0], r, cost, n, c) for r, (cost, picks) in enumerate(found, 1) for n, c in picks.items()], columns=["plan", "rank", "cost", "node", "candidate"])

    return costs.groupBy("plan").applyInPandas(solve, "plan long, rank int, cost double, node long, candidate int")
