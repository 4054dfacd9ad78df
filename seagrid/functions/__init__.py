"""Column expressions: one value in, one value out, all inside the JVM."""

from seagrid.functions.geo import haversine_km, nearest_site, snap_effort
from seagrid.functions.scalars import (
    coast_band, cyclic_month, exact_mean, finite, fished, half_even, navigable,
    rating, reachable, safety_class, share, speed, to_celsius, to_day,
    to_index, to_kmh, zone_id,
)

__all__ = [
    "coast_band", "cyclic_month", "exact_mean", "finite", "fished",
    "half_even", "haversine_km", "navigable", "nearest_site", "rating",
    "reachable", "safety_class", "share", "snap_effort", "speed",
    "to_celsius", "to_day", "to_index", "to_kmh", "zone_id",
]
