"""Unit conversions, thresholds and rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from seagrid.rules import (
    CAUTION, DANGER, RATING_UNKNOWN, RATINGS, RULES, SAFE, UNKNOWN, Rules,
)


def half_even(x: Column, digits: int) -> Column:
    """Round to `digits` decimals, ties to the even neighbour."""
    unit = float(10 ** digits)
    return F.rint(x * unit) / unit


def exact_mean(x: Column, decimals: int = 6) -> Column:
    """Mean of values taken at a fixed number of decimals.

    The sum runs over whole numbers, so the result does not depend on the
    order rows arrive in and coarse rounding afterwards is reproducible.
    """
    unit = float(10 ** decimals)
    return F.avg(F.rint(x * unit).cast("long")) / unit


def share(condition: Column) -> Column:
    """Aggregate: part of the rows that meet a condition (null counts as no)."""
    return F.count_if(condition) / F.count(F.lit(1))


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    x = x.cast("double")
    return F.when(F.abs(x) < F.lit(math.inf), x)


def to_day(ts: Column) -> Column:
    return ts.cast("date")


def to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def to_kmh(metres_per_second: Column) -> Column:
    return metres_per_second * 3.6


def speed(u: Column, v: Column) -> Column:
    """Length of a two-component vector."""
    return F.sqrt(u * u + v * v)


def cyclic_month(date: Column) -> dict[str, Column]:
    """Month number with its sine and cosine on the yearly circle."""
    month = F.month(date)
    angle = (month - 1) * F.lit(2 * math.pi) / 12.0
    return {
        "month": month.cast("byte"),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def fished(hours: Column, rules: Rules = RULES) -> Column:
    return F.when(hours > rules.fished_hours, 1).otherwise(0).cast("byte")


def safety_class(wave: Column, wind: Column, rules: Rules = RULES) -> Column:
    """Sea state from the day's highest wave (m) and wind (km/h).

    One missing input makes the state unknown even if the other is dangerous.
    """
    return (
        F.when(wave.isNull() | wind.isNull(), UNKNOWN)
        .when((wave > rules.wave_danger_m) | (wind > rules.wind_danger_kmh), DANGER)
        .when((wave < rules.wave_safe_m) & (wind < rules.wind_safe_kmh), SAFE)
        .otherwise(CAUTION)
    )


def navigable(wave: Column, wind: Column, rules: Rules = RULES) -> Column:
    """True where a vessel could work; unknown sea state counts as no."""
    workable = (wave <= rules.wave_danger_m) & (wind <= rules.wind_danger_kmh)
    return F.coalesce(workable, F.lit(False))


def coast_band(km: Column, rules: Rules = RULES) -> dict[str, Column]:
    """Band key and names for a distance from the coast; null beyond the last."""
    key = so = en = F.lit(None).cast("string")
    for low, high, name_so, name_en in reversed(rules.bands):
        inside = (km >= low) & (km < high)
        key = F.when(inside, f"{low}-{high}").otherwise(key)
        so = F.when(inside, name_so).otherwise(so)
        en = F.when(inside, name_en).otherwise(en)
    return {"band": key, "band_so": so, "band_en": en}


def reachable(coast_km: Column, site_km: Column, rules: Rules = RULES) -> Column:
    near = (coast_km <= rules.max_coast_km) & (site_km <= rules.max_trip_km)
    return F.coalesce(near, F.lit(False))


def zone_id(site_id: Column, band: Column) -> Column:
    """`site_band`, null where there is no band."""
    return F.concat(site_id, F.lit("_"), band)


def rating(score: Column) -> Column:
    """Plain-language rating of a 0-100 score as a struct (level, so, en)."""

    def entry(level: str, so: str, en: str) -> Column:
        return F.struct(
            F.lit(level).alias("level"), F.lit(so).alias("so"), F.lit(en).alias("en")
        )

    out = F.when(score.isNull(), entry(*RATING_UNKNOWN))
    for low, level, so, en in RATINGS:
        if low is None:
            return out.otherwise(entry(level, so, en))
        out = out.when(score >= low, entry(level, so, en))
    return out


def to_index(probability: Column) -> Column:
    """Probability as a 0-100 display index with one decimal."""
    clipped = F.least(F.greatest(probability * 100.0, F.lit(0.0)), F.lit(100.0))
    # least and greatest skip nulls, which must stay unknown.
    return F.when(probability.isNotNull(), half_even(clipped, 1))
