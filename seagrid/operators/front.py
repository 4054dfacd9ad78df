"""Front strength: the horizontal temperature gradient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.grid import KM_PER_DEGREE, Grid
from seagrid.operators.neighbours import DAY_KEYS, neighbour


def gradient(
    grid: Grid, col: str = "sst", keys: Sequence[str] = DAY_KEYS, dense: bool = False,
) -> Column:
    """Gradient magnitude of `col` in units per 100 km.

    Central differences inside the grid, one-sided ones on its edges; null
    where the cell itself or a neighbour it needs has no value. An absent row
    counts as no value. `dense` promises a row for every cell of the grid,
    which is faster.
    """
    here = F.col(col)

    def slope(position: str, size: int, rows: int, columns: int) -> Column:
        ahead = neighbour(here, rows, columns, grid, keys, dense)
        behind = neighbour(here, -rows, -columns, grid, keys, dense)
        return (
            F.when(F.col(position) == 0, ahead - here)
            .when(F.col(position) == size - 1, here - behind)
            .otherwise((ahead - behind) / 2)
        ) / grid.res

    km_lon = F.cos(F.radians(grid.lat(F.col("lat_idx")))) * KM_PER_DEGREE
    north = slope("lat_idx", grid.n_lat, 1, 0) / KM_PER_DEGREE
    east = slope("lon_idx", grid.n_lon, 0, 1) / km_lon
    size = F.sqrt(north * north + east * east) * 100.0
    return F.when(here.isNotNull(), size)


def sst_gradient(
    df: DataFrame, grid: Grid, col: str = "sst", out: str = "sst_gradient",
    keys: Sequence[str] = DAY_KEYS, dense: bool = False,
) -> DataFrame:
    """Add the front strength of `col`; see `gradient`."""
    return df.withColumn(out, gradient(grid, col, keys, dense))
