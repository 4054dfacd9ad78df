"""Coastal gaps filled from the nearest cell that has a value."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.grid import Grid
from seagrid.operators.neighbours import DAY_KEYS, neighbour
from seagrid.rules import RULES


def offsets_within(grid: Grid, max_km: float) -> list[tuple[int, int]]:
    """Cell offsets no further than `max_km`, nearest first.

    Equal distances are ordered by (rows, columns), which settles ties.
    """
    high = int(max_km // grid.row_km)
    wide = int(max_km // grid.col_km)
    found = []
    for di in range(-high, high + 1):
        for dj in range(-wide, wide + 1):
            km = math.hypot(di * grid.row_km, dj * grid.col_km)
            if (di, dj) != (0, 0) and km <= max_km:
                found.append((km, di, dj))
    return [(di, dj) for _, di, dj in sorted(found)]


def filled(
    col: str, grid: Grid, max_km: float = RULES.wave_fill_max_km,
    keys: Sequence[str] = DAY_KEYS, dense: bool = False,
) -> Column:
    """`col`, or where it is null the nearest value of the same day.

    The search radius is a handful of cells, so each offset is one window frame
    over the day (see `neighbours`), not a join. `dense` promises a row for
    every cell of the grid, which is faster.
    """
    near = [
        neighbour(F.col(col), di, dj, grid, keys, dense)
        for di, dj in offsets_within(grid, max_km)
    ]
    return F.coalesce(F.col(col), *near)


def fill_nearest(
    df: DataFrame, col: str, grid: Grid, max_km: float = RULES.wave_fill_max_km,
    flag: str | None = None, keys: Sequence[str] = DAY_KEYS, dense: bool = False,
) -> DataFrame:
    """Replace nulls of `col` by the nearest value within `max_km`; `flag`
    (default `<col>_estimated`) is 1 where a value was filled in."""
    tagged = df.withColumn("_filled", filled(col, grid, max_km, keys, dense))
    return swap_filled(tagged, {col: "_filled"}, {flag or f"{col}_estimated": col})


def swap_filled(
    df: DataFrame, replaced: dict[str, str], flags: dict[str, str],
) -> DataFrame:
    """Put filled columns in place of their originals, flagging the changes."""
    return df.withColumns({
        **{c: F.col(new) for c, new in replaced.items()},
        **{
            flag: (F.col(c).isNull() & F.col(replaced[c]).isNotNull()).cast("byte")
            for flag, c in flags.items()
        },
    }).drop(*replaced.values())
