"""Planar geometry in numpy, for operators that run inside grouped functions."""

from __future__ import annotations

import numpy as np


def hypot(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=-1))


def length(path: np.ndarray) -> float:
    return float(hypot(np.diff(path, axis=0)).sum())


def point_segments(p: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Distances of one point from segments (n, 4)."""
    a, d = segments[:, :2], segments[:, 2:] - segments[:, :2]
    size = np.maximum((d * d).sum(axis=1), 1e-300)
    t = np.clip(((p - a) * d).sum(axis=1) / size, 0, 1)
    return hypot(a + t[:, None] * d - p)


def cross_parameters(a: np.ndarray, b: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a-b and each segment meet, as fractions of either; nan for parallel ones."""
    d, e = b - a, segments[:, 2:] - segments[:, :2]
    den = d[0] * e[:, 1] - d[1] * e[:, 0]
    w = segments[:, :2] - a
    with np.errstate(divide="ignore", invalid="ignore"):
        return (w[:, 0] * e[:, 1] - w[:, 1] * e[:, 0]) / den, (w[:, 0] * d[1] - w[:, 1] * d[0]) / den


def meets(a: np.ndarray, b: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Which segments cross or touch a-b, parallel ones aside."""
    s, t = cross_parameters(a, b, segments)
    return (s >= 0) & (s <= 1) & (t >= 0) & (t <= 1)


def shared_lengths(a: np.ndarray, b: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Metres over which each segment lies on a-b."""
    size = float(hypot(b - a))
    if size < 1e-12:
        return np.zeros(len(segments))
    u = (b - a) / size
    p, q = segments[:, :2] - a, segments[:, 2:] - a
    off = np.maximum(np.abs(p[:, 0] * u[1] - p[:, 1] * u[0]), np.abs(q[:, 0] * u[1] - q[:, 1] * u[0]))
    low, high = np.minimum(p @ u, q @ u), np.maximum(p @ u, q @ u)
    return np.where(off < 1e-9, np.maximum(0, np.minimum(size, high) - np.maximum(0, low)), 0.0)


def segment_distances(a: np.ndarray, b: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Distances of a-b from segments."""
    if not len(segments):
        return np.zeros(0)
    ends = np.minimum(point_segments(a, segments), point_segments(b, segments))
    d = b - a
    size = max(float((d * d).sum()), 1e-300)

    def to_own(p: np.ndarray) -> np.ndarray:
        t = np.clip((p - a) @ d / size, 0, 1)
        return hypot(a + t[:, None] * d - p)

    back = np.minimum(to_own(segments[:, :2]), to_own(segments[:, 2:]))
    return np.where(meets(a, b, segments), 0.0, np.minimum(ends, back))


def inside(p: np.ndarray, segments: np.ndarray) -> bool:
    """Even-odd test of a point against the segments of closed rings."""
    y0, y1 = segments[:, 1], segments[:, 3]
    cut = (y0 > p[1]) != (y1 > p[1])
    s = segments[cut]
    x = s[:, 0] + (p[1] - s[:, 1]) / (s[:, 3] - s[:, 1]) * (s[:, 2] - s[:, 0])
    return bool((x > p[0]).sum() % 2)


def ring_segments(ring: np.ndarray) -> np.ndarray:
    return np.concatenate([ring[:-1], ring[1:]], axis=1)


def mitred(ring: np.ndarray, by: float) -> np.ndarray:
    """Corners of a closed ring moved outward by ``by``, mitred; sharp corners are cut at three times the distance."""
    p = ring[:-1]
    area = float((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum())
    if area < 0:
        p = p[::-1]
    d = np.roll(p, -1, axis=0) - p
    d = d / np.maximum(hypot(d), 1e-12)[:, None]
    n = np.stack([d[:, 1], -d[:, 0]], axis=1)
    before = np.roll(n, 1, axis=0)
    m = before + n
    m = m / np.maximum(hypot(m), 1e-9)[:, None]
    return p + m * (by / np.maximum((m * n).sum(axis=1), 1 / 3))[:, None]


def turn(u: np.ndarray, v: np.ndarray) -> float:
    """Degrees between two directions, 0 to 180."""
    size = float(hypot(u) * hypot(v))
    return 0.0 if size < 1e-12 else float(np.degrees(np.arccos(np.clip((u * v).sum() / size, -1, 1))))


def clip(a: np.ndarray, b: np.ndarray, segments: np.ndarray) -> list[tuple[float, float]]:
    """The parts of a-b inside a polygon, in metres from a."""
    size = float(hypot(b - a))
    s, t = cross_parameters(a, b, segments)
    cuts = np.unique(np.concatenate([[0.0, 1.0], s[(s > 0) & (s < 1) & (t >= 0) & (t <= 1)]]))
    out: list[tuple[float, float]] = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if inside(a + (lo + hi) / 2 * (b - a), segments):
            if out and out[-1][1] >= lo * size - 1e-9:
                out[-1] = (out[-1][0], hi * size)
            else:
                out.append((lo * size, hi * size))
    return out


def project(p: np.ndarray, path: np.ndarray) -> tuple[float, float]:
    """(chainage, distance) of the point of a path nearest to p."""
    a, d = path[:-1], np.diff(path, axis=0)
    size = hypot(d)
    t = np.clip(((p - a) * d).sum(axis=1) / np.maximum(size**2, 1e-300), 0, 1)
    gap = hypot(a + t[:, None] * d - p)
    k = int(gap.argmin())
    return float(size[:k].sum() + t[k] * size[k]), float(gap[k])


def at(path: np.ndarray, chainage: float) -> np.ndarray:
    """The point of a path at a running length."""
    run = np.concatenate([[0], np.cumsum(hypot(np.diff(path, axis=0)))])
    return np.array([np.interp(chainage, run, path[:, 0]), np.interp(chainage, run, path[:, 1])])


def part(path: np.ndarray, low: float, high: float) -> np.ndarray:
    """The sub-path between two running lengths."""
    run = np.concatenate([[0], np.cumsum(hypot(np.diff(path, axis=0)))])
    inner = path[(run > low + 1e-9) & (run < high - 1e-9)]
    return np.concatenate([[at(path, low)], inner, [at(path, high)]])
