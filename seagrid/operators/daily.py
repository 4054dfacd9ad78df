"""Sub-daily readings reduced to one row per pixel and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.functions import speed, to_day, to_kmh


def daily_stats(
    readings: DataFrame, variables: Sequence[str],
    pixel: Sequence[str] = ("lat", "lon"), time: str = "time",
) -> DataFrame:
    """`<v>_mean` and `<v>_max` of every variable per day and pixel.

    Both are partial aggregates: however many readings one pixel has, at most
    one row per input task and group is shuffled.
    """
    aggs = []
    for v in variables:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max")]
    return readings.groupBy(*pixel, to_day(F.col(time)).alias("date")).agg(*aggs)


def daily_wind_components(
    readings: DataFrame, east: str, north: str,
    pixel: Sequence[str] = ("lat", "lon"), time: str = "time",
) -> DataFrame:
    """Daily means `wind_east` and `wind_north` and the largest speed of any
    reading, `wind_speed_max`, all in the unit of the components. Directions
    survive regridding only as components, so this is what goes on a grid."""
    u, v = F.col(east), F.col(north)
    return readings.groupBy(*pixel, to_day(F.col(time)).alias("date")).agg(
        F.avg(u).alias("wind_east"), F.avg(v).alias("wind_north"), F.max(speed(u, v)).alias("wind_speed_max"),
    )


def daily_wind(
    readings: DataFrame, east: str, north: str, highest: str = "true",
    pixel: Sequence[str] = ("lat", "lon"), time: str = "time",
) -> DataFrame:
    """Daily `wind_speed` and `wind_speed_max` in km/h from components in m/s.

    `highest="true"` takes the largest speed of any reading. `"component"`
    combines the largest signed value of each component instead, which
    understates wind from the east or north.
    """
    u, v = F.col(east), F.col(north)
    if highest == "true":
        top = F.max(speed(u, v))
    elif highest == "component":
        top = speed(F.max(u), F.max(v))
    else:
        raise ValueError(f"unknown kind of highest wind {highest!r}")
    return readings.groupBy(*pixel, to_day(F.col(time)).alias("date")).agg(
        to_kmh(speed(F.avg(u), F.avg(v))).alias("wind_speed"),
        to_kmh(top).alias("wind_speed_max"),
    )
