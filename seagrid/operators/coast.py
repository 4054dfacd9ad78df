"""Exact distance from every ocean cell to the nearest land cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.grid import Grid


def distance_to_coast(
    cells: DataFrame, grid: Grid, keys: Sequence[str] = ("region",),
) -> DataFrame:
    """Add `dist_coast_km` to the distinct ocean cells of each key.

    Land is every grid cell absent from `cells`; without land the distance is
    null. The Euclidean distance separates: along each column the nearest land
    follows from the ends of the run of ocean cells the cell lies in, and the
    nearest land overall is found among the cells of the same unbroken run
    along the row (beyond the run's end land is nearer anyway). So no land rows
    are made up and no pairs are emitted; the row step works on one array per
    run, never longer than the grid is wide.
    """
    keys = list(keys)
    ocean = cells.select(*keys, "lat_idx", "lon_idx").distinct()
    ocean = _along(ocean, [*keys, "lon_idx"], "lat_idx", grid.n_lat, "up")
    ocean = _along(ocean, [*keys, "lat_idx"], "lon_idx", grid.n_lon, "side")
    dy, dx = grid.row_km, grid.col_km
    runs = ocean.groupBy(*keys, "lat_idx", "_run").agg(
        F.collect_list(F.struct("lon_idx", "up", "side")).alias("run")
    )

    def nearest(cell: Column) -> Column:
        through = F.array_min(F.transform(
            "run",
            lambda other: F.sqrt(
                F.pow((cell["lon_idx"] - other["lon_idx"]) * F.lit(dx), F.lit(2.0))
                + F.pow(other["up"] * F.lit(dy), F.lit(2.0))
            ),
        ))
        # `least` skips nulls, so a missing side or column does not matter.
        return F.least(through, cell["side"] * F.lit(dx))

    return runs.select(
        *keys, "lat_idx",
        F.inline(F.transform("run", lambda cell: F.struct(
            cell["lon_idx"].alias("lon_idx"),
            nearest(cell).alias("dist_coast_km"),
        ))),
    )


def _along(df: DataFrame, line: list[str], along: str, size: int, out: str) -> DataFrame:
    """Add `_run`, naming the unbroken run of cells each cell lies in, and the
    steps from the cell to the nearer end of it. Ends at the grid's edge do not
    count: beyond them nothing is known."""
    place = F.col(along)
    number = F.row_number().over(Window.partitionBy(*line).orderBy(along))
    run = Window.partitionBy(*line, "_run")
    first, last = F.min(along).over(run), F.max(along).over(run)
    back = F.when(first > 0, place - first + 1)
    ahead = F.when(last < size - 1, last - place + 1)
    # Position minus place in order is the same all along a run.
    return df.withColumn("_run", place - number).withColumn(out, F.least(back, ahead))
