"""Closed-form map projections as column expressions: EPSG codes 4326, 3857, 32649 and 4547."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0

# Transverse Mercator zones: flattening, central meridian, scale, false easting.
_ZONES = {32649: (1 / 298.257223563, 111.0, 0.9996, 500000.0), 4547: (1 / 298.257222101, 114.0, 1.0, 500000.0)}


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - F.lit(math.pi / 2))


def _series(f: float) -> tuple[float, list[float], list[float]]:
    """Rectifying radius and the coefficients of Krueger's forward and inverse series to the third order."""
    n = f / (2 - f)
    a = RADIUS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    return a, alpha, beta


def to_zone(code: int, lon: Column, lat: Column) -> tuple[Column, Column]:
    f, meridian, scale, east = _ZONES[code]
    a, alpha, _ = _series(f)
    c = math.sqrt(f * (2 - f))
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    sin = F.sin(phi)
    t = F.sinh(F.atanh(sin) - c * F.atanh(c * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(alpha, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return x * (scale * a) + east, y * (scale * a)


def from_zone(code: int, x: Column, y: Column) -> tuple[Column, Column]:
    f, meridian, scale, east = _ZONES[code]
    a, _, beta = _series(f)
    xi, eta = y / (scale * a), (x - east) / (scale * a)
    xi1, eta1 = xi, eta
    for j, k in enumerate(beta, 1):
        xi1 = xi1 - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    n = f / (2 - f)
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    lat = chi
    for j, k in enumerate(delta, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + meridian, F.degrees(lat)


def reproject(source: int, target: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Points between two of the known systems, by way of longitude and latitude."""
    if source == target:
        return x, y
    if source == 3857:
        x, y = from_mercator(x, y)
    elif source in _ZONES:
        x, y = from_zone(source, x, y)
    elif source != 4326:
        raise ValueError(f"no projection is known for EPSG:{source}")
    if target == 4326:
        return x, y
    if target == 3857:
        return to_mercator(x, y)
    if target in _ZONES:
        return to_zone(target, x, y)
    raise ValueError(f"no projection is known for EPSG:{target}")


def reproject_ring(source: int, target: int, ring: Column) -> Column:
    """A ring point by point."""

    def move(p: Column) -> Column:
        x, y = reproject(source, target, p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, move)


def reproject_box(source: int, target: int, box: list[Column]) -> list[Column]:
    """Box around the four reprojected corners."""
    x0, y0, x1, y1 = box
    corners = [reproject(source, target, x, y) for x in (x0, x1) for y in (y0, y1)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]
