"""Plans for one scenario: growth by best increment, reconnection, straightening, and a multi-start over the cluster.

Growth is sequential by nature: each step attaches the next terminal to what the plan has by then. One start is therefore one
task; starts, modes and scenarios are independent and are dealt out as rows. A scenario's working window is bounded, and is what a task holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kelvingrid.functions import planar
from kelvingrid.operators.routing import Router, obstacle, pipe
from kelvingrid.plans import rules

SEED, POLICIES = 20260922, ("BALANCED", "CHEAP", "SHORT")
#: Frontier sizes (the last: all), candidates accepted in a step, metres within which a root is used again.
FRONTIERS, ACCEPTED, REUSE, FREE = (8, 32, 96, None), 3, 0.05, 4


def smallest(flow: float, length: float = 0.0, floor: int = 0) -> int:
    """First diameter of ``floor`` or more that carries a flow over a length."""
    for r in rules.DN_TABLE:
        if r[0] >= floor and flow <= r[1] + rules.SLACK and length <= r[2] + rules.SLACK:
            return r[0]
    raise ValueError(f"no diameter for {flow} t/h over {length} m")


PRICE = {r[0]: r[3] for r in rules.DN_TABLE}


def chamber_price(dn: int) -> float:
    return 3e6 if dn <= 200 else 5e6 if dn <= 500 else 8e6 if dn <= 1000 else 12e6


@dataclass(frozen=True)
class Node:
    kind: str  # TIE_IN, CHAMBER, TERMINAL
    x: float
    y: float
    oks_id: str | None = None
    existing_id: str | None = None
    existing_type: str | None = None

    @property
    def at(self) -> np.ndarray:
        return np.array([self.x, self.y])


@dataclass(frozen=True)
class Plan:
    """A rooted forest: nodes by id, and for each child its parent, path and cost in metres."""

    nodes: dict[int, Node] = field(default_factory=dict)
    edges: dict[int, tuple[int, np.ndarray, float]] = field(default_factory=dict)

    def children(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for c, (p, _, _) in self.edges.items():
            out.setdefault(p, []).append(c)
        return out

    def degree(self, n: int) -> int:
        return sum(p == n for p, _, _ in self.edges.values()) + (n in self.edges)

    def connected(self) -> set[str]:
        return {n.oks_id for n in self.nodes.values() if n.oks_id is not None}


@dataclass
class Scene:
    terminals: list[tuple[str, float, float, float]]  # oks_id, x, y, flow
    ties: list[tuple[str, str, float, float, int]]  # id, type, x, y, free connections
    router: Router

    def flow(self) -> dict[str, float]:
        return {t[0]: t[3] for t in self.terminals}


def flows(plan: Plan, flow: dict[str, float]) -> dict[int, float]:
    """Flow of each edge: the demand below it."""
    children, out = plan.children(), {}

    def below(n: int) -> float:
        own = flow.get(plan.nodes[n].oks_id, 0.0) if plan.nodes[n].oks_id is not None else 0.0
        total = own + sum(below(c) for c in children.get(n, []))
        out[n] = total
        return total

    for n in plan.nodes:
        if n not in plan.edges:
            below(n)
    return {n: f for n, f in out.items() if n in plan.edges}


def diameters(plan: Plan, flow: dict[str, float], rounds: int = 64) -> dict[int, int]:
    """Smallest diameters that carry every run of equal flow over its length and never fall toward the root."""
    f = flows(plan, flow)
    size = {c: planar.length(path) for c, (_, path, _) in plan.edges.items()}
    dn = {c: smallest(f[c]) for c in plan.edges}
    inner = {p for p, _, _ in plan.edges.values()}
    for _ in range(rounds):
        before = dict(dn)
        for leaf in [c for c in plan.edges if c not in inner]:
            n, run = leaf, []
            while n in plan.edges:
                if run and abs(f[run[-1]] - f[n]) > 1e-9:
                    raise_run(run, f, size, dn)
                    run = []
                run.append(n)
                n = plan.edges[n][0]
            raise_run(run, f, size, dn)
            n, floor = leaf, 0
            while n in plan.edges:
                floor = dn[n] = max(dn[n], floor)
                n = plan.edges[n][0]
        if dn == before:
            return dn
    raise ValueError("diameters did not settle")


def raise_run(run: list[int], f: dict[int, float], size: dict[int, float], dn: dict[int, int]) -> None:
    need = smallest(f[run[0]], sum(size[c] for c in run), max(dn[c] for c in run))
    for c in run:
        dn[c] = need


def evaluate(plan: Plan, scene: Scene) -> dict[str, float]:
    """Costs, length and score of a plan."""
    flow = scene.flow()
    dn = diameters(plan, flow)
    build = sum(PRICE[dn[c]] * cost for c, (_, _, cost) in plan.edges.items())
    length = sum(planar.length(path) for _, path, _ in plan.edges.values())
    chambers = ties = 0.0
    for n, node in plan.nodes.items():
        near = [dn[c] for c, (p, _, _) in plan.edges.items() if n in (c, p)]
        if node.kind == "CHAMBER" or (node.kind == "TIE_IN" and node.existing_type != "heat_chamber"):
            chambers += chamber_price(max(near)) if near else 0.0
        elif node.kind == "TIE_IN":
            ties += rules.CHAMBER_TIE * sum(p == n for p, _, _ in plan.edges.values())
    missing = [f for t, f in flow.items() if t not in plan.connected()]
    penalty = sum(1e8 + 5e5 * f for f in missing)
    cost = build + chambers + ties + penalty
    return {"construction": build, "chambers": chambers, "ties": ties, "penalty": penalty, "unconnected": len(missing), "length": length, "cost": cost, "score": 0.7 * cost / 25e6 + 0.3 * length / 100}


def offers(plan: Plan, scene: Scene, at: np.ndarray, limit: int | None) -> list[tuple[str, object, np.ndarray]]:
    """Where a point can be attached, nearest first: ties, nodes with a free connection, points of edges."""
    out: list[tuple[float, str, object, np.ndarray]] = []
    used = {}
    for n, node in plan.nodes.items():
        if node.existing_id is not None:
            used[node.existing_id] = used.get(node.existing_id, 0) + sum(p == n for p, _, _ in plan.edges.values())
        elif node.kind == "CHAMBER" and plan.degree(n) < FREE:
            out.append((float(planar.hypot(node.at - at)), "node", n, node.at))
    for tie in scene.ties:
        if used.get(tie[0], 0) < tie[4]:
            out.append((float(planar.hypot(np.array(tie[2:4]) - at)), "tie", tie, np.array(tie[2:4])))
    for c, (_, path, _) in plan.edges.items():
        size = planar.length(path)
        if size > 4:
            k = float(np.clip(planar.project(at, path)[0], 2, size - 2))
            for chainage in [k, *([size - 12] if size - 12 >= 2 and abs(size - 12 - k) > 4 else [])]:
                p = planar.at(path, chainage)
                out.append((float(planar.hypot(p - at)), "edge", (c, chainage), p))
    out.sort(key=lambda o: (o[0], o[1], str(o[2])))
    return [o[1:] for o in (out if limit is None else out[:limit])]


def attach(plan: Plan, offer: tuple[str, object, np.ndarray], terminal: tuple[str, float, float, float], route: tuple[np.ndarray, float]) -> Plan:
    """A new plan with the terminal attached along a route from the offer's place."""
    nodes, edges = dict(plan.nodes), dict(plan.edges)
    kind, what, at = offer
    fresh = max(nodes, default=-1) + 1
    if kind == "node":
        start = what
    elif kind == "tie":
        same = [n for n, v in nodes.items() if v.existing_id == what[0] and planar.hypot(v.at - at) < REUSE]
        start = same[0] if same else fresh
        if not same:
            nodes[fresh] = Node("TIE_IN", float(at[0]), float(at[1]), None, what[0], what[1])
            fresh += 1
    else:
        child, chainage = what
        parent, path, cost = edges[child]
        size = planar.length(path)
        start = fresh
        nodes[start] = Node("CHAMBER", float(at[0]), float(at[1]))
        edges[start] = (parent, planar.part(path, 0, chainage), cost * chainage / size)
        edges[child] = (start, planar.part(path, chainage, size), cost * (size - chainage) / size)
        fresh += 1
    nodes[fresh] = Node("TERMINAL", terminal[1], terminal[2], terminal[0])
    edges[fresh] = (start, route[0], route[1])
    return Plan(nodes, edges)


def conflicts(plan: Plan, path: np.ndarray) -> bool:
    """Whether a new path crosses the plan's own lines anywhere but at its start."""
    own = planar.ring_segments(path)
    for _, other, _ in plan.edges.values():
        segments = planar.ring_segments(other)
        for s in own:
            t, _ = planar.cross_parameters(s[:2], s[2:], segments)
            hit = planar.meets(s[:2], s[2:], segments)
            points = s[:2] + t[:, None] * (s[2:] - s[:2])
            if (hit & (planar.hypot(points - path[0]) >= REUSE)).any():
                return True
    return False


def improve_step(plan: Plan, scene: Scene, terminal: tuple[str, float, float, float], base: float, accept: int, frontiers: tuple[int | None, ...] = FRONTIERS) -> tuple[float, Plan] | None:
    """The cheapest of the first ``accept`` valid attachments of a terminal, with its increment of the score; a frontier is widened only if it gives none."""
    at = np.array(terminal[1:3])
    dn = smallest(terminal[3])
    unit = 0.003 + 0.7 * PRICE[dn] / 25e6
    best: tuple[float, Plan] | None = None
    seen = valid = 0
    own = [planar.ring_segments(path) for _, path, _ in plan.edges.values()]
    lines = np.concatenate(own) if own else None
    for limit in frontiers:
        found = offers(plan, scene, at, limit)
        for offer in found[seen:]:
            if best is not None and float(planar.hypot(offer[2] - at)) * unit >= best[0]:
                return best
            route = scene.router.route(offer[2], at, dn, lines)
            if route is None or conflicts(plan, route[0]):
                continue
            try:
                new = attach(plan, offer, terminal, route)
                gain = evaluate(new, scene)["score"] - base + 0.7 * (1e8 + 5e5 * terminal[3]) / 25e6
            except ValueError:
                continue
            valid += 1
            if best is None or gain < best[0] - 1e-12:
                best = (gain, new)
            if valid >= accept:
                return best
        seen = len(found)
        if best is not None:
            return best
    return best


def build(scene: Scene, salt: int = 0, accept: int = ACCEPTED) -> Plan:
    """Grow a plan: of the pending terminals, nearest first (times a jitter if salted), the first that can be attached ends a step.

    The next frontier is looked at only when no pending terminal has an attachment in the one before.
    """
    plan, pending = Plan(), list(scene.terminals)
    while pending:
        base = evaluate(plan, scene)["score"]
        places = np.array([t[2:4] for t in scene.ties] + [[n.x, n.y] for n in plan.nodes.values()])

        def near(t, places=places):
            d = float(planar.hypot(places - np.array(t[1:3])).min()) if len(places) else 0.0
            noise = np.random.default_rng([salt, *t[0].encode()]).random() if salt else 0.45
            return d * (0.55 + noise), t[0]

        order = sorted(pending, key=near)
        step = None
        for limit in FRONTIERS:
            for t in order:
                step = improve_step(plan, scene, t, base, accept, (limit,))
                if step is not None:
                    break
            if step is not None:
                break
        if step is None:
            break
        plan = step[1]
        pending.remove(t)
    return plan


def without(plan: Plan, leaf: int) -> Plan:
    """The plan without a terminal, and without the nodes that nothing needs then."""
    nodes, edges = dict(plan.nodes), dict(plan.edges)
    n: int | None = leaf
    while n is not None and not any(p == n for p, _, _ in edges.values()) and (n == leaf or nodes[n].oks_id is None):
        up = edges.pop(n)[0] if n in edges else None
        del nodes[n]
        n = up
    return Plan(nodes, edges)


def reconnect(plan: Plan, scene: Scene) -> Plan:
    """One round: detach each terminal and attach it again where that lowers the score."""
    for oks in sorted(plan.connected()):
        leaf = next(n for n, v in plan.nodes.items() if v.oks_id == oks)
        if any(p == leaf for p, _, _ in plan.edges.values()):
            continue
        rest = without(plan, leaf)
        step = improve_step(rest, scene, next(t for t in scene.terminals if t[0] == oks), evaluate(rest, scene)["score"], ACCEPTED)
        if step is not None and evaluate(step[1], scene)["score"] < evaluate(plan, scene)["score"] - 1e-8:
            plan = step[1]
    return plan


def straighten(plan: Plan, scene: Scene) -> Plan:
    """Replace edges, longest first, by straight segments where that is legal and lowers the score."""
    dn = diameters(plan, scene.flow())
    for c in sorted(plan.edges, key=lambda k: -planar.length(plan.edges[k][1])):
        p, path, _ = plan.edges[c]
        if len(path) < 3:
            continue
        direct = np.array([path[0], path[-1]])
        if scene.router.home(direct[1]) is not None:
            continue  # the lead out of the building stays
        ok, factor, _ = scene.router.legal(direct[0], direct[1], dn[c], direct[0])
        rest = replace(plan, edges={k: v for k, v in plan.edges.items() if k != c})
        if ok and not conflicts(replace(rest, edges={k: v for k, v in rest.edges.items() if v[0] not in (p, c) and k != p}), direct):
            new = replace(plan, edges=plan.edges | {c: (p, direct, planar.length(direct) * factor)})
            if evaluate(new, scene)["score"] < evaluate(plan, scene)["score"] - 1e-8:
                plan = new
    return plan


def salt_of(start: int) -> int:
    return 0 if start == 0 else start + SEED % 10000


def rows_of(plan: Plan, scene: Scene, head: tuple) -> list[tuple]:
    """A plan as one row for each node, with the edge to its parent."""
    value = evaluate(plan, scene)
    dn, flow = diameters(plan, scene.flow()), flows(plan, scene.flow())
    out = []
    for n, v in plan.nodes.items():
        p, path, cost = plan.edges.get(n, (None, np.zeros((0, 2)), 0.0))
        out.append((*head, value["score"], value["cost"], value["length"], value["unconnected"], n, v.kind, v.x, v.y, v.oks_id, v.existing_id, v.existing_type, p, [{"x": float(a), "y": float(b)} for a, b in path], cost, flow.get(n), dn.get(n)))
    return out


PLAN_SCHEMA = "scenario string, start int, policy string, stage string, score double, cost double, length double, unconnected long, node long, kind string, x double, y double, oks_id string, existing_id string, existing_type string, parent long, path array<struct<x:double,y:double>>, metres double, flow double, dn int"


def optimise(starts: DataFrame, scenes: DataFrame) -> DataFrame:
    """``starts(scenario, start)``, ``scenes(scenario, terminals, ties, restrictions, pipes)`` (arrays of structs) -> nodes of all archived plans.

    Each start gives its plan after growth and after refinement. One row of ``starts`` is one unit of work.
    """

    def solve(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                around = [obstacle(o["type"], [np.array([[p["x"], p["y"]] for p in ring]) for ring in o["rings"]], bool(o["closed"])) for o in r.restrictions]
                around += [pipe(np.array([[leg["ax"], leg["ay"], leg["bx"], leg["by"]] for leg in o["legs"]]), int(o["dn"])) for o in r.pipes]
                scene = Scene([(t["oks_id"], t["x"], t["y"], t["flow"]) for t in r.terminals], [(t["id"], t["type"], t["x"], t["y"], t["free"]) for t in r.ties], Router(around))
                head = (r.scenario, r.start, POLICIES[r.start % 3])
                plan = build(scene, salt_of(r.start))
                out += rows_of(plan, scene, (*head, "grown"))
                refined = straighten(reconnect(plan, scene), scene)
                out += rows_of(refined, scene, (*head, "refined"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN_SCHEMA.split(", ")])

    work = starts.join(scenes, "scenario").select("scenario", "start", "terminals", "ties", "restrictions", "pipes")
    return work.repartition(max(1, starts.count()), "scenario", "start").mapInPandas(solve, PLAN_SCHEMA)
