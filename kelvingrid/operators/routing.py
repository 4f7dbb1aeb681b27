"""Routes between points among restrictions: segment legality, a visibility graph and A*, for the planner's steps.

What a segment may do is what ``legality`` says in joins; a test holds the two together.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from kelvingrid.functions import planar
from kelvingrid.plans import rules

RULE = {r[0]: r for r in rules.RESTRICTIONS}
#: Neighbours probed, sectors, tries and links in each, most nodes; metres added to a bend; slack of offsets; contact at a tie.
NEIGHBOURS, SECTORS, TRIES, LINKS, NODES, BEND, SLACK, TOUCH = 64, 16, 6, 2, 1600, 8.0, 0.20, 0.2


def half_width(dn: int) -> float:
    return next(r[5] for r in rules.DN_TABLE if r[0] >= dn) / 2


@dataclass
class Obstacle:
    kind: str
    segments: np.ndarray
    closed: bool
    rings: list[np.ndarray] = field(default_factory=list)
    dn: int | None = None  # of an existing pipe

    def clearance(self, dn: int) -> float:
        """Least distance of a pipe's axis from it."""
        if self.dn is not None:
            return 1.0 + half_width(dn) + half_width(self.dn)
        if self.kind == "oks_existing":
            return (5.0 if dn < 500 else 7.0 if dn <= 800 else 9.0) + half_width(dn)
        rule = RULE.get(self.kind)
        return (rule[2] + rule[7] if rule else 1.0) + half_width(dn)

    def covers(self, p: np.ndarray) -> bool:
        """Whether a point is inside or on the boundary."""
        return self.closed and (planar.inside(p, self.segments) or bool(planar.point_segments(p, self.segments).min() <= 1e-9))

    def walls(self) -> np.ndarray:
        """Segments of the rings that an even number of the others hold."""
        own = [planar.ring_segments(r) for r in self.rings if len(r) > 1]
        kept = [s for k, s in enumerate(own) if sum(planar.inside((s[0, :2] + s[0, 2:]) / 2, o) for j, o in enumerate(own) if j != k) % 2 == 0]
        return np.concatenate(kept)

    @property
    def crossable(self) -> bool:
        rule = RULE.get(self.kind)
        return bool(rule and rule[1])


def obstacle(kind: str, rings: list[np.ndarray], closed: bool) -> Obstacle:
    parts = [planar.ring_segments(r) for r in rings if len(r) > 1]
    return Obstacle(kind, np.concatenate(parts) if parts else np.zeros((0, 4)), closed, rings)


def pipe(legs: np.ndarray, dn: int) -> Obstacle:
    """An existing pipe, by its segments."""
    return Obstacle("existing", legs, False, [], dn)


def beside(a: np.ndarray, b: np.ndarray, o: Obstacle, need: float, touch: np.ndarray | None) -> tuple[str, float]:
    """(reason, factor) of a segment and an existing pipe."""
    hit = planar.meets(a, b, o.segments)
    shared = planar.shared_lengths(a, b, o.segments).sum()
    if not hit.any() and shared == 0:
        tied = touch is not None and planar.point_segments(touch, o.segments).min() < TOUCH and planar.hypot(a - touch) < TOUCH
        near = planar.segment_distances(a, b, o.segments).min() < need - 1e-6
        return ("clearance-existing-network", 1.0) if near and not tied else ("", 1.0)
    if shared > 0.05:
        return "overlap-existing-network", 1.0
    at = a + planar.cross_parameters(a, b, o.segments[hit])[0][:, None] * (b - a)
    return "", 1.05 if touch is None or (planar.hypot(at - touch) >= TOUCH).any() else 1.0


def ports(terminal: np.ndarray, home: Obstacle, dn: int) -> list[list[tuple[float, np.ndarray]]]:
    """Points outside the walls opposite a terminal, in tiers of equal length inside the building, the shortest first."""
    need, out = home.clearance(dn), []
    for w in home.walls():
        d = w[2:] - w[:2]
        size = float(planar.hypot(d))
        if size < 1e-8:
            continue
        entry = w[:2] + float(np.clip((terminal - w[:2]) @ d / size**2, 0, 1)) * d
        gap = float(planar.hypot(entry - terminal))
        for n in [(entry - terminal) / gap] if gap > 1e-8 else [np.array([d[1], -d[0]]) / size, np.array([-d[1], d[0]]) / size]:
            full = entry + n * (need + SLACK)
            room = not home.covers(full) and planar.point_segments(full, home.segments).min() >= need - 1e-6
            for offset in [need + SLACK] if room else [0.05, 0.5, 1.5, need + SLACK]:
                p = entry + n * offset
                if not home.covers(p):
                    out.append((sum(hi - lo for lo, hi in planar.clip(p, terminal, home.segments)), p))
    out.sort(key=lambda v: (round(v[0], 9), float(planar.hypot(v[1] - terminal)), *v[1]))
    tiers: list[list[tuple[float, np.ndarray]]] = []
    for v in out:
        if not tiers or v[0] - tiers[-1][-1][0] > 1e-5:
            tiers.append([])
        tiers[-1].append(v)
    return tiers


def assess(a: np.ndarray, b: np.ndarray, dn: int, obstacles: list[Obstacle], exempt: float = 0.0, touch: np.ndarray | None = None, home: Obstacle | None = None) -> tuple[bool, float, str]:
    """(feasible, cost multiplier, reason) of a straight segment. ``exempt``: metres at either end that clearances don't bind.

    ``touch``: where the route is tied in. ``home``: the building from which the segment comes; it may run along it, but not enter it again.
    """
    best = 1.0
    low, high = np.minimum(a, b), np.maximum(a, b)
    for o in obstacles:
        need = o.clearance(dn)
        s = o.segments
        if o is home:
            if sum(hi - lo for lo, hi in planar.clip(a, b, s)) > 1e-5:
                return False, 1.0, f"forbidden:{o.kind}"
            continue
        if o.dn is not None:
            reason, factor = beside(a, b, o, need, touch)
            if reason:
                return False, 1.0, reason
            best = max(best, factor)
            continue
        near = (np.maximum(s[:, 0], s[:, 2]) >= low[0] - need) & (np.minimum(s[:, 0], s[:, 2]) <= high[0] + need) & (np.maximum(s[:, 1], s[:, 3]) >= low[1] - need) & (np.minimum(s[:, 1], s[:, 3]) <= high[1] + need)
        if not near.any():
            if o.closed and planar.inside(a, s):  # wholly within, far from every wall
                if not o.crossable:
                    return False, 1.0, f"forbidden:{o.kind}"
                best = max(best, RULE[o.kind][4])
            continue
        s = s[near]
        if not o.crossable:
            p, q = a, b
            if exempt and planar.hypot(b - a) > 2 * exempt:
                u = (b - a) / planar.hypot(b - a)
                p, q = a + exempt * u, b - exempt * u
            if planar.segment_distances(p, q, s).min() < need - 1e-9 or (o.closed and planar.inside((p + q) / 2, o.segments)):
                return False, 1.0, f"forbidden:{o.kind}"
            continue
        hit = planar.meets(a, b, s)
        if hit.any():
            d = s[hit][:, 2:] - s[hit][:, :2]
            cosine = np.abs(d @ (b - a)) / np.maximum(planar.hypot(d) * planar.hypot(b - a), 1e-12)
            if np.degrees(np.arccos(np.clip(cosine, 0, 1))).min() < RULE[o.kind][3] - 1e-9:
                return False, 1.0, f"cross-angle:{o.kind}"
            best = max(best, RULE[o.kind][4])
        elif o.closed and planar.inside((a + b) / 2, o.segments):
            best = max(best, RULE[o.kind][4])
        elif planar.segment_distances(a, b, s).min() < need - 1e-9:
            return False, 1.0, f"clearance:{o.kind}"
    return True, best, ""


def blocked(a: np.ndarray, b: np.ndarray, lines: np.ndarray | None, touch: np.ndarray) -> bool:
    """Whether a segment meets lines that are planned already, elsewhere than at the tie."""
    if lines is None or not len(lines):
        return False
    hit = planar.meets(a, b, lines)
    with np.errstate(invalid="ignore"):  # parallel lines meet nowhere
        at = a + planar.cross_parameters(a, b, lines)[0][:, None] * (b - a)
    return bool((hit & (planar.hypot(at - touch) >= 0.05)).any() or (planar.shared_lengths(a, b, lines) > 0.05).any())


class Router:
    """Routes in one scene; graphs are kept by diameter."""

    def __init__(self, obstacles: list[Obstacle]):
        self.obstacles = obstacles
        self.boxes = np.array([[*np.minimum(o.segments[:, :2], o.segments[:, 2:]).min(axis=0), *np.maximum(o.segments[:, :2], o.segments[:, 2:]).max(axis=0)] for o in obstacles if len(o.segments)]).reshape(-1, 4)
        self.obstacles = [o for o in obstacles if len(o.segments)]
        self.graphs: dict[int, tuple[np.ndarray, dict[int, list[tuple[int, float]]]]] = {}

    def near(self, a: np.ndarray, b: np.ndarray, reach: float = 12.0) -> list[Obstacle]:
        """Obstacles whose boxes are within ``reach`` of a segment's; no clearance is larger."""
        low, high = np.minimum(a, b) - reach, np.maximum(a, b) + reach
        v = self.boxes
        return [self.obstacles[k] for k in np.flatnonzero((v[:, 2] >= low[0]) & (v[:, 0] <= high[0]) & (v[:, 3] >= low[1]) & (v[:, 1] <= high[1])).tolist()]

    def nodes(self, dn: int) -> np.ndarray:
        """Mitred corners around what must be gone round, sampled by angle and radius if there are too many."""
        found = []
        for o in self.obstacles:
            if not o.crossable and o.closed:
                for r in o.rings:
                    found.append(planar.mitred(r, o.clearance(dn) + SLACK))
        p = np.concatenate(found) if found else np.zeros((0, 2))
        p = p[[i for i in range(len(p)) if not any(o.closed and not o.crossable and planar.inside(p[i], o.segments) for o in self.obstacles)]] if len(p) else p
        if len(p) > NODES - 2:
            d = p - p.mean(axis=0)
            order = np.lexsort((planar.hypot(d), np.arctan2(d[:, 1], d[:, 0])))
            p = p[order[np.floor(np.arange(NODES - 2) * len(p) / (NODES - 2)).astype(int)]]
        return p

    def legal(self, a: np.ndarray, b: np.ndarray, dn: int, touch: np.ndarray | None = None, home: Obstacle | None = None) -> tuple[bool, float, str]:
        return assess(a, b, dn, self.near(a, b), 0.0, touch, home)

    def home(self, p: np.ndarray) -> Obstacle | None:
        """The building that a point stands in."""
        return next((o for o in self.near(p, p, 0.1) if o.kind == "oks_existing" and o.covers(p)), None)

    def links(self, p: np.ndarray, others: np.ndarray, dn: int, skip: int | None = None, touch: np.ndarray | None = None, home: Obstacle | None = None) -> list[tuple[int, float]]:
        """Legal links from a point: of its nearest neighbours in each sector the first tries, of them the first legal ones."""
        d = others - p
        gap = planar.hypot(d)
        order = [k for k in np.argsort(gap, kind="stable")[: NEIGHBOURS + 1].tolist() if k != skip and gap[k] > 1e-9][:NEIGHBOURS]
        sector = np.minimum(np.floor((np.arctan2(d[:, 1], d[:, 0]) + np.pi) / (2 * np.pi) * SECTORS), SECTORS - 1).astype(int)
        tries, kept, out = {}, {}, []
        for k in order:
            s = int(sector[k])
            if tries.get(s, 0) >= TRIES or kept.get(s, 0) >= LINKS:
                continue
            tries[s] = tries.get(s, 0) + 1
            ok, factor, _ = self.legal(p, others[k], dn, touch, home)
            if ok:
                kept[s] = kept.get(s, 0) + 1
                out.append((k, float(gap[k] * factor)))
        return out

    def graph(self, dn: int) -> tuple[np.ndarray, dict[int, list[tuple[int, float]]]]:
        if dn not in self.graphs:
            p = self.nodes(dn)
            links: dict[int, dict[int, float]] = {k: {} for k in range(len(p))}
            for k in range(len(p)):
                for j, cost in self.links(p[k], p, dn, k):
                    links[k][j] = links[j][k] = cost
            self.graphs[dn] = (p, {k: sorted(v.items()) for k, v in links.items()})
        return self.graphs[dn]

    def route(self, start: np.ndarray, goal: np.ndarray, dn: int, lines: np.ndarray | None = None) -> tuple[np.ndarray, float] | None:
        """(path, cost in metres) or None. A goal inside a building is reached through a port of its nearest wall that can be reached.

        ``lines``: segments of the plan so far, which may not be crossed.
        """
        home = self.home(goal)
        if home is None:
            return self.way(start, goal, dn, None, lines)
        for tier in ports(goal, home, dn):
            best = None
            for _, port in tier:
                lead = goal - port
                size = float(planar.hypot(lead))
                # beyond its own facade the lead must keep clear like any other segment
                if not assess(port, goal, dn, [o for o in self.near(port, goal) if o is not home])[0]:
                    continue
                found = None if blocked(port, goal, lines, start) else self.way(start, port, dn, home, lines)
                if found is not None and ((found[0][-1] - found[0][-2]) * lead).sum() >= -1e-7 and (best is None or found[1] + size < best[1]):
                    best = np.concatenate([found[0], [goal]]), found[1] + size
            if best is not None:
                return best
        return None

    def way(self, start: np.ndarray, goal: np.ndarray, dn: int, home: Obstacle | None = None, lines: np.ndarray | None = None) -> tuple[np.ndarray, float] | None:
        """Straight if legal, else by the graph. ``home``: the building outside which the goal is a port."""
        ok, factor, _ = self.legal(start, goal, dn, start, home)
        if ok and planar.hypot(goal - start) > 1e-9 and not blocked(start, goal, lines, start):
            return np.array([start, goal]), float(planar.hypot(goal - start) * factor)
        p, static = self.graph(max(200, dn))
        found = self.search(start, goal, max(200, dn), p, static, home, lines)
        if found is None and dn < 200:
            found = self.search(start, goal, dn, *self.graph(dn), home, lines)
        if found is None:
            return None
        path = self.straightened(found[0], dn, home, lines)
        cost = sum(float(planar.hypot(b - a)) * self.legal(a, b, dn, start, home if (b == goal).all() else None)[1] for a, b in zip(path[:-1], path[1:], strict=True))
        return path, cost + BEND * sum(planar.turn(b - a, c - b) > 5 for a, b, c in zip(path[:-2], path[1:-1], path[2:], strict=True))

    def search(self, start: np.ndarray, goal: np.ndarray, dn: int, p: np.ndarray, static: dict[int, list[tuple[int, float]]], home: Obstacle | None = None, lines: np.ndarray | None = None) -> tuple[np.ndarray, float] | None:
        n = len(p)
        points = np.concatenate([p, [start], [goal]])
        links = {k: list(v) for k, v in static.items()}
        links[n] = self.links(start, p, dn, None, start) if n else []
        links[n + 1] = []
        for k, cost in self.links(goal, p, dn, None, None, home) if n else []:
            links[k].append((n + 1, cost))
        # the exact distance over the graph without bends never exceeds the real rest
        rest = {n + 1: 0.0}
        back: dict[int, list[tuple[int, float]]] = {}
        for k, v in links.items():
            for j, cost in v:
                back.setdefault(j, []).append((k, cost))
        queue = [(0.0, n + 1)]
        while queue:
            d, k = heapq.heappop(queue)
            if d > rest[k]:
                continue
            for j, cost in back.get(k, []):
                if d + cost < rest.get(j, np.inf):
                    rest[j] = d + cost
                    heapq.heappush(queue, (rest[j], j))
        if n not in rest:
            return None
        best = {(n, -1): 0.0}
        come: dict[tuple[int, int], tuple[int, int]] = {}
        queue2 = [(rest[n], 0.0, n, -1)]
        while queue2:
            _, d, k, before = heapq.heappop(queue2)
            if d > best[(k, before)] + 1e-12:
                continue
            path = [k]
            state = (k, before)
            while state in come:
                state = come[state]
                path.append(state[0])
            if k == n + 1:
                return points[path[::-1]], d
            legs = planar.ring_segments(points[path[::-1]])[:-1] if len(path) > 2 else None
            for j, cost in links[k]:
                if j not in rest or j in path:
                    continue
                u = points[k] - points[before] if before >= 0 else None
                v = points[j] - points[k]
                if u is not None and (u * v).sum() < -1e-7:
                    continue
                if legs is not None and planar.meets(points[k], points[j], legs).any() or blocked(points[k], points[j], lines, start):
                    continue
                total = d + cost + (BEND if u is not None and planar.turn(u, v) > 5 else 0.0)
                if total < best.get((j, k), np.inf) - 1e-12:
                    best[(j, k)] = total
                    come[(j, k)] = (k, before)
                    heapq.heappush(queue2, (total + rest[j], total, j, k))
        return None

    def straightened(self, path: np.ndarray, dn: int, home: Obstacle | None = None, lines: np.ndarray | None = None) -> np.ndarray:
        """Without the corners that a legal straight leg can skip; neither that leg nor the one after may reverse."""
        moving = True
        while moving:
            moving, k = False, 1
            while k < len(path) - 1:
                leg = path[k + 1] - path[k - 1]
                before = path[k - 1] - path[k - 2] if k > 1 else leg
                after = path[k + 2] - path[k + 1] if k + 2 < len(path) else leg
                own = home if k + 2 == len(path) else None
                if (before * leg).sum() >= -1e-7 and (leg * after).sum() >= -1e-7 and self.legal(path[k - 1], path[k + 1], dn, path[0], own)[0] and not blocked(path[k - 1], path[k + 1], lines, path[0]):
                    path, moving = np.delete(path, k, axis=0), True
                else:
                    k += 1
        return path
