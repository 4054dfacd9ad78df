"""Bringing sources together on the cell-day key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.grid import Grid
from seagrid.operators.neighbours import whole_planes

KEYS = ("region", "date", "lat_idx", "lon_idx")


def pick_source(frames: Mapping[str, DataFrame], *preferred: str) -> DataFrame | None:
    """The first of the preferred sources that exists.

    The choice is per source, not per row: gaps of the chosen source stay gaps.
    """
    return next((frames[name] for name in preferred if name in frames), None)


def days_with_values(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """The days (region, date) on which any source has a value."""
    day = [k for k in keys if k not in ("lat_idx", "lon_idx")]
    found = []
    for df in frames:
        some = reduce(
            lambda a, b: a | b, [F.col(c).isNotNull() for c in df.columns if c not in keys]
        )
        found.append(df.where(some).select(*day).distinct())
    return reduce(DataFrame.unionByName, found).distinct()


def align_sources(
    frames: Sequence[DataFrame], keys: Sequence[str] = KEYS, days: DataFrame | None = None,
    fill_grid: Grid | None = None, buckets: int | None = None,
) -> DataFrame:
    """Outer alignment of frames that share the key and differ in variables.

    Stacked and grouped once, where a chain of outer joins would shuffle for
    every source. The one exchange is by day: it serves the grouping as well as
    every operator after it that works on a day's plane. Days on which no
    source has any value are dropped as a whole, within the same layout, so
    every source is read once; `days` names the days to keep if they are known
    already. `fill_grid` needs that list, and works it out if it is not given:
    then sources are read twice and should be tables. It adds the cells no source covers and
    leaves out rows off the grid, so that every day is one whole plane of it.

    With `buckets` the frames are taken to lie by day in so many partitions, as
    tables of `settle_by_day` do, and there is no exchange at all. A frame that
    does not is moved, and the others with it: slower, with the same rows. Rows
    without a cell are left out then.
    """
    day = [k for k in keys if k not in ("lat_idx", "lon_idx")]
    if days is None and (fill_grid is not None or buckets):
        days = days_with_values(frames, keys)
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), frames
    )
    variables = [c for c in stacked.columns if c not in keys]
    # Whole planes of the days say by themselves which rows count, without a join.
    by_cell = buckets is not None and fill_grid is not None
    if days is None:
        stacked = stacked.dropna(subset=day)
    elif not by_cell:
        stacked = stacked.join(days.select(*day), day, "left_semi")
    if fill_grid is not None:
        # Whole planes are read by row offset, so nothing may lie beside them.
        stacked = stacked.where(fill_grid.contains(F.col("lat_idx"), F.col("lon_idx")))
        listed = days.select(*day)
        planes = whole_planes(listed.dropna().repartition(buckets, *day) if by_cell else listed.repartition(*day), fill_grid)
        planes = planes.withColumn("_wanted", F.lit(1)) if by_cell else planes
        stacked = stacked.unionByName(planes, allowMissingColumns=True)
    wanted = ["_wanted"] if by_cell else []
    if buckets:
        # A union has the layout of its parts only if the first is laid out as it
        # stands: the list of days, which is short, as rows without a cell or value.
        blank = [F.lit(None).cast(stacked.schema[c].dataType).alias(c) for c in stacked.columns if c not in day]
        by_day = days.select(*day, *blank).repartition(buckets, *day).unionByName(stacked)
        if not by_cell:
            by_day = by_day.dropna(subset=[k for k in keys if k not in day])
    else:
        by_day = stacked.repartition(*day)
    aligned = by_day.groupBy(*keys).agg(*[F.max(v).alias(v) for v in [*variables, *wanted]])
    if by_cell:
        return aligned.where("_wanted = 1").drop("_wanted")
    if days is not None:
        return aligned
    some = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in variables])
    return aligned.withColumn("_some", F.max(some).over(Window.partitionBy(*day))).where("_some").drop("_some")


def drop_land(df: DataFrame, col: str = "sst") -> DataFrame:
    """Only the rows with a sea temperature: land has none."""
    return df.where(F.col(col).isNotNull())
