"""WGS 84 longitude and latitude to UTM zone 37 north and back, by the Krueger series, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ellipsoid and the zone.
A, FLATTENING, SCALE, EASTING, MERIDIAN = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 39.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BACK = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
GEODETIC = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)
E2 = 2 * N**0.5 / (1 + N)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, lam = F.radians(lat), F.radians(lon - MERIDIAN)
    t = F.sinh(F.atanh(F.sin(phi)) - E2 * F.atanh(E2 * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(FORWARD, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return SCALE * RADIUS * x + EASTING, SCALE * RADIUS * y


def to_wgs(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi, eta = y / (SCALE * RADIUS), (x - EASTING) / (SCALE * RADIUS)
    u, v = xi, eta
    for k, b in enumerate(BACK, 1):
        u = u - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        v = v - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for k, d in enumerate(GEODETIC, 1):
        phi = phi + d * F.sin(2 * k * chi)
    return MERIDIAN + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(phi)


def path_to_utm(path: Column) -> Column:
    """An array of (x: longitude, y: latitude, z) in metres; z passes through."""
    return F.transform(path, lambda p: F.struct(*[c.alias(n) for c, n in zip(to_utm(p.x, p.y), "xy", strict=True)], p.z.alias("z")))


def path_to_wgs(path: Column) -> Column:
    return F.transform(path, lambda p: F.struct(*[c.alias(n) for c, n in zip(to_wgs(p.x, p.y), "xy", strict=True)], p.z.alias("z")))
