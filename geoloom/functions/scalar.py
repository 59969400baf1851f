"""Scalar rules over map features: texts, heights, years, angles and frames. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOOT_M, INCH_M = 0.3048, 0.0254
EARTH_RADIUS_M = 6371008.8
#: WGS84.
SEMI_MAJOR_M, FIRST_ECCENTRICITY_2 = 6378137.0, 6.69437999014e-3


def plain(text: Column) -> Column:
    """A class or tag as it is compared: without space around it, in lower case; null is empty."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def length_metres(text: Column) -> Column:
    """Metres of `12`, `12 m`, `40 ft` or `5'6"`; null for any other text. Units are never guessed."""
    t = F.trim(text)
    number = r"[+-]?(?:\d+\.?\d*|\.\d+)"
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    metres, feet, both = rf"^({number})\s*m?$", rf"^({number})\s*(?:ft|feet|')$", r"""^(\d+)'\s*(\d+)"$"""
    return (
        F.when(t.rlike(metres), part(metres, 1).try_cast("double"))
        .when(t.rlike(feet), part(feet, 1).try_cast("double") * FOOT_M)
        .when(t.rlike(both), part(both, 1).try_cast("double") * FOOT_M + part(both, 2).try_cast("double") * INCH_M)
    )


def year_in(text: Column) -> Column:
    """The first year 1900 to 2099 that isn't within a longer number."""
    return F.nullif(F.regexp_extract(text, r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", 1), F.lit("")).try_cast("int")


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two places a little apart: on a sphere, flat at their mean latitude."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * EARTH_RADIUS_M


def tile_fraction(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web Mercator tile coordinates at a zoom, with the place within the tile as the fraction."""
    n = float(2**zoom)
    rad = F.radians(lat)
    return (lon + 180) / 360 * n, (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / F.lit(3.141592653589793)) / 2 * n


def local_frame(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """East and north metres of a place at height 0 in the tangent plane at (lon0, lat0), over earth-centred coordinates."""
    import math

    def centred(lo, la, lib):  # the same formula for columns and numbers
        n = SEMI_MAJOR_M / lib.sqrt(1 - FIRST_ECCENTRICITY_2 * lib.sin(la) * lib.sin(la))
        return n * lib.cos(la) * lib.cos(lo), n * lib.cos(la) * lib.sin(lo), n * (1 - FIRST_ECCENTRICITY_2) * lib.sin(la)

    lo0, la0 = math.radians(lon0), math.radians(lat0)
    here, origin = centred(F.radians(lon), F.radians(lat), F), centred(lo0, la0, math)
    dx, dy, dz = (a - b for a, b in zip(here, origin, strict=True))
    east = dx * -math.sin(lo0) + dy * math.cos(lo0)
    north = dx * (-math.sin(la0) * math.cos(lo0)) + dy * (-math.sin(la0) * math.sin(lo0)) + dz * math.cos(la0)
    return east, north


def triangle_height(v00: Column, v10: Column, v01: Column, v11: Column, tx: Column, ty: Column) -> Column:
    """The height within a lattice cell that is cut along its rising diagonal into two flat triangles."""
    return F.when(tx >= ty, v00 + (v10 - v00) * tx + (v11 - v10) * ty).otherwise(v00 + (v11 - v01) * tx + (v01 - v00) * ty)
