"""Web-map tiles in the spherical Mercator scheme, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the query of a GetTile request, with places for zoom, column and row.
TILE_QUERY = "?style=default&tilematrixset=EPSG%3A3857&Service=WMTS&Request=GetTile&Version=1.0.0&Format=image%2Fpng&TileMatrix={zoom}&TileCol={col}&TileRow={row}"


def tile_col(lon: Column, zoom: int) -> Column:
    return ((lon + 180) / 360 * F.lit(float(1 << zoom))).cast("long")


def tile_row(lat: Column, zoom: int) -> Column:
    phi = F.radians(lat)
    return ((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / F.lit(math.pi)) / 2 * F.lit(float(1 << zoom))).cast("long")


def tile_extent(row: Column, col: Column, zoom: int) -> list[Column]:
    """min_x, min_y, max_x, max_y of a tile in degrees."""
    n = float(1 << zoom)

    def lat(r: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * r / F.lit(n)))))

    return [col / F.lit(n) * 360.0 - 180.0, lat(row + 1), (col + 1) / F.lit(n) * 360.0 - 180.0, lat(row)]


def tile_url(base: Column, zoom: int, col: Column, row: Column) -> Column:
    """GetTile request of a WMTS service."""
    start, rest = TILE_QUERY.replace("{zoom}", str(zoom)).split("{col}")
    middle, _ = rest.split("{row}")
    return F.concat(base, F.lit(start), col.cast("string"), F.lit(middle), row.cast("string"))
