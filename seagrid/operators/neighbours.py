"""Values of neighbouring cells without joins.

Cells of one day are put in order once, and every neighbour is then a window
frame over that order: one exchange by day, one sort, any number of neighbours.
A window partition is one day of one region and thus never larger than the
grid.

Sparse planes are ordered along `lat_idx * stride + lon_idx`. With a stride of
twice the grid width every offset (rows, columns) is one fixed step on that
line, so a neighbour is a one-value RANGE frame, and absent cells give null.
Dense planes, which hold a row for every cell of the grid, need no frames: the
neighbour is a fixed number of rows away, which `lag` reads far faster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.grid import Grid

DAY_KEYS = ("region", "date")


def neighbour(
    value: Column, rows: int, columns: int, grid: Grid,
    keys: Sequence[str] = DAY_KEYS, dense: bool = False,
) -> Column:
    """`value` of the cell `rows` north and `columns` east of this one."""
    if abs(columns) >= grid.n_lon:
        return F.lit(None).cast("double")
    day = Window.partitionBy(*keys)
    if dense:
        found = F.lag(value, -(rows * grid.n_lon + columns)).over(
            day.orderBy("lat_idx", "lon_idx")
        )
        on_grid = (F.col("lon_idx") + columns).between(0, grid.n_lon - 1)
        return found if columns == 0 else F.when(on_grid, found)
    stride = 2 * grid.n_lon
    place = F.col("lat_idx").cast("long") * stride + F.col("lon_idx")
    step = rows * stride + columns
    return F.max(value).over(day.orderBy(place).rangeBetween(step, step))


def whole_planes(days: DataFrame, grid: Grid) -> DataFrame:
    """Every cell of the grid on each of `days` (region, date)."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(grid.n_cells - 1)))
    return days.select("region", "date", cell.alias("_cell")).select(
        "region", "date",
        F.floor(F.col("_cell") / grid.n_lon).cast("int").alias("lat_idx"),
        (F.col("_cell") % grid.n_lon).alias("lon_idx"),
    )
