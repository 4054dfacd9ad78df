"""Operators along the time axis of a cell.

Both share one layout, `(region, lat_idx, lon_idx)` ordered by date, so a
chain of them costs one exchange and one sort. A partition is one cell's
history and grows with the number of days only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.rules import RULES

CELL_KEYS = ("region", "lat_idx", "lon_idx")


def trailing_mean(
    df: DataFrame, col: str, days: int, min_count: int, out: str,
    keys: Sequence[str] = CELL_KEYS, axis: str = "position",
    restart_each_year: bool = False,
) -> DataFrame:
    """Mean of the last `days` values, null below `min_count` non-null ones.

    `axis="position"` counts the source's own days: those on which any cell of
    the region has a row. A cell without a row on some of them has nothing
    there, and its window reaches no further back for it. `axis="calendar"`
    counts calendar days. `restart_each_year` lets no window reach into the
    year before.
    """
    part = [F.col(k) for k in keys]
    if restart_each_year:
        part.append(F.year("date"))
    if axis == "position":
        df = _numbered_days(df, [k for k in keys if k not in ("lat_idx", "lon_idx")], restart_each_year)
        frame = Window.partitionBy(*part).orderBy("_day").rangeBetween(1 - days, 0)
    elif axis == "calendar":
        frame = (
            Window.partitionBy(*part)
            .orderBy(F.unix_date("date"))
            .rangeBetween(1 - days, 0)
        )
    else:
        raise ValueError(f"unknown axis {axis!r}")
    enough = F.count(col).over(frame) >= min_count
    return df.withColumn(out, F.when(enough, F.avg(col).over(frame))).drop("_day")


def _numbered_days(df: DataFrame, place: Sequence[str], per_year: bool) -> DataFrame:
    """Add `_day`, the number of each day among the days of its region. Only the
    list of days is put in order."""
    part = [*place, F.year("date")] if per_year else list(place)
    days = df.select(*place, "date").distinct()
    days = days.withColumn("_day", F.row_number().over(Window.partitionBy(*part).orderBy("date")))
    days = days.withColumnsRenamed({c: f"_{c}" for c in (*place, "date")})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*place, "date")])
    return df.join(days, same).drop(*[f"_{c}" for c in (*place, "date")])


def observed_days(
    df: DataFrame, col: str, per_year: bool = False, calendar: DataFrame | None = None,
) -> DataFrame:
    """For each day the latest day, up to it, on which any cell has `col`.

    Returns region, date, src_date, age_days. `calendar` (region, date) adds
    days on which `df` has no rows. Only the list of days is ever put in order,
    never the cells.
    """
    days = df.groupBy("region", "date").agg(
        F.max(F.col(col).isNotNull()).alias("seen")
    )
    if calendar is not None:
        days = calendar.select("region", "date").join(days, ["region", "date"], "left")
    part = ["region", F.year("date")] if per_year else ["region"]
    so_far = Window.partitionBy(*part).orderBy("date").rowsBetween(
        Window.unboundedPreceding, 0
    )
    seen_on = F.when(F.col("seen"), F.col("date"))
    return (
        days.withColumn("src_date", F.last(seen_on, ignorenulls=True).over(so_far))
        .withColumn("age_days", F.datediff("date", "src_date"))
        .drop("seen")
    )


def carry_planes(
    df: DataFrame, cols: Sequence[str], calendar: DataFrame,
    max_age: int = RULES.chl_max_age_days, age: str = "chl_age_days", per_year: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """`carry_forward` for a source that has no rows on the days it misses.

    Returns the source's rows for every day of `calendar` they serve, and the
    age of each day. An observed plane is pushed on to the days that use it, so
    the source is joined to a list of days only and never to itself.
    """
    days = observed_days(df, cols[0], per_year, calendar)
    fresh = days.where(F.col("age_days") <= max_age).select("region", "src_date", "date")
    planes = df.select(
        "region", F.col("date").alias("src_date"), "lat_idx", "lon_idx", *cols
    ).join(fresh, ["region", "src_date"])
    ages = days.select("region", "date", F.col("age_days").alias(age))
    return planes.select("region", "date", "lat_idx", "lon_idx", *cols), ages


def carry_forward(
    df: DataFrame, cols: Sequence[str], max_age: int = RULES.chl_max_age_days,
    age: str = "chl_age_days", per_cell: bool = False, per_year: bool = False,
) -> DataFrame:
    """Carry the latest observed plane of `cols` forward, with its age in days.

    A day counts as observed when any cell has `cols[0]`; every cell then takes
    that day's values, nulls included. Values older than `max_age` are null;
    their age stays known. Days before the first observation have neither.
    `per_cell` instead carries each cell's own last value.
    """
    cols = list(cols)
    if per_cell:
        keys = [*CELL_KEYS, F.year("date")] if per_year else list(CELL_KEYS)
        so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(
            Window.unboundedPreceding, 0
        )
        kept = F.when(
            F.col(cols[0]).isNotNull(),
            F.struct(F.col("date").alias("at"), *[F.col(c) for c in cols]),
        )
        tagged = df.withColumn("_kept", F.last(kept, ignorenulls=True).over(so_far))
        tagged = tagged.withColumn(age, F.datediff("date", "_kept.at"))
        usable = F.col(age) <= max_age
    else:
        days = observed_days(df, cols[0], per_year)
        so_far = Window.partitionBy(*CELL_KEYS).orderBy("date").rowsBetween(
            Window.unboundedPreceding, 0
        )
        # The days table has one row per calendar day and region.
        tagged = df.join(days, ["region", "date"], "left")
        kept = F.when(
            F.col("age_days") == 0,
            F.struct(F.col("date").alias("at"), *[F.col(c) for c in cols]),
        )
        tagged = tagged.withColumn("_kept", F.last(kept, ignorenulls=True).over(so_far))
        # A cell without a row on the source day has nothing to carry.
        tagged = tagged.withColumnRenamed("age_days", age)
        usable = (F.col(age) <= max_age) & (F.col("_kept.at") == F.col("src_date"))
    for c in cols:
        tagged = tagged.withColumn(c, F.when(usable, F.col(f"_kept.{c}")))
    return tagged.drop("_kept", "src_date")
