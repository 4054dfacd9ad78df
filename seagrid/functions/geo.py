"""Distances and snapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seagrid.functions.scalars import half_even
from seagrid.rules import RULES, Rules

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    north = F.sin((p2 - p1) / 2)
    east = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = north * north + F.cos(p1) * F.cos(p2) * east * east
    a = F.when(a > 1.0, 1.0).otherwise(a)
    return F.asin(F.sqrt(a)) * (2 * EARTH_RADIUS_KM)


def nearest_site(lat: Column, lon: Column, rules: Rules = RULES) -> Column:
    """Struct (site_km, place, site_id) of the closest landing site.

    The sites are a short fixed list, so the search runs over a literal array
    inside the expression: no join, no shuffle. Equal distances go to the first
    site.
    """
    places = F.array(*[
        F.struct(
            F.lit(place).alias("place"), F.lit(site_id).alias("site_id"),
            F.lit(s_lat).alias("lat"), F.lit(s_lon).alias("lon"),
        )
        for place, (site_id, _, _, s_lat, s_lon) in enumerate(rules.sites)
    ])
    return F.array_min(F.transform(places, lambda s: F.struct(
        haversine_km(lat, lon, s["lat"], s["lon"]).alias("site_km"),
        s["place"].alias("place"), s["site_id"].alias("site_id"),
    )))


def snap_effort(x: Column, res: float, anchor: str = "edge") -> Column:
    """Cell centre for an effort coordinate.

    `edge` expects the lower edge of a cell, as effort reports give it; `any`
    accepts every point inside a cell.
    """
    if anchor == "edge":
        steps = F.rint(x / res)
    elif anchor == "any":
        # The tiny lift keeps an edge such as 0.3 / 0.1 = 2.999... in its cell.
        steps = F.floor(x / res + 1e-9)
    else:
        raise ValueError(f"unknown anchor {anchor!r}")
    return half_even(steps * res + res / 2, 4)
