"""Operators on planes that are too large for one task.

A plane is cut into tiles of `size` by `size` cells. A cell also goes to the
tiles that it is within reach of, as a halo: with the values that are looked at
and nothing else, and only where one is there. Each tile is then worked on alone
and keeps its own cells, so the result is that of the whole plane, and a window
partition holds one tile with its halo. Percentile ranks need the whole plane's
order; they come from counts by value, cut into ranges of values. The way to the
coast has no reach; tiles are completed by the land seen at the edges of others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.functions import half_even
from seagrid.grid import Grid
from seagrid.operators.evaluate import SCORES_PER_RANGE, in_ranges
from seagrid.operators.fill import fill_nearest, offsets_within
from seagrid.operators.front import sst_gradient
from seagrid.operators.neighbours import DAY_KEYS
from seagrid.rules import RULES, Rules
from seagrid.session import settle

#: Cells along a tile's edge.
TILE = 256


def in_tiles(
    df: DataFrame, inputs: Sequence[str], reach: tuple[int, int],
    work: Callable[[DataFrame, list[str]], DataFrame], size: int = TILE,
    keys: Sequence[str] = DAY_KEYS,
) -> DataFrame:
    """`work(cells, keys)` applied tile by tile. It may look at `inputs` of cells
    up to `reach` (rows, columns) away and at all columns of the cell itself,
    and adds or replaces columns. Cells without a place are a tile of their own."""
    place, tile = ["lat_idx", "lon_idx"], ["_tile_row", "_tile_column"]
    rest = [c for c in df.columns if c not in {*keys, *place, *inputs}]
    spread = df
    for name, at, steps in zip(tile, place, reach):
        first, last = (F.floor((F.col(at) + s) / size).cast("int") for s in (-steps, steps))
        spread = spread.select("*", F.explode_outer(F.sequence(first, last)).alias(name))
    own = reduce(lambda a, b: a & b, [
        F.col(name).eqNullSafe(F.floor(F.col(at) / size).cast("int")) for name, at in zip(tile, place)
    ])
    seen = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in inputs])
    spread = spread.withColumn("_own", own).where(F.col("_own") | seen)
    carried = [F.when(F.col("_own"), F.col(c)).alias(c) for c in rest]
    spread = spread.select(*keys, *place, *inputs, *carried, *tile, "_own")
    done = work(spread, [*keys, *tile]).where("_own").drop("_own", *tile)
    return done.select(*df.columns, *(c for c in done.columns if c not in df.columns))


def fill_nearest_tiled(
    df: DataFrame, col: str, grid: Grid, max_km: float = RULES.wave_fill_max_km,
    flag: str | None = None, keys: Sequence[str] = DAY_KEYS, size: int = TILE,
) -> DataFrame:
    """`fill_nearest` for planes of any size."""
    near = offsets_within(grid, max_km)
    reach = max((abs(r) for r, _ in near), default=0), max((abs(c) for _, c in near), default=0)
    return in_tiles(df, [col], reach, lambda cells, own: fill_nearest(cells, col, grid, max_km, flag, own), size, keys)


def sst_gradient_tiled(
    df: DataFrame, grid: Grid, col: str = "sst", out: str = "sst_gradient",
    keys: Sequence[str] = DAY_KEYS, size: int = TILE,
) -> DataFrame:
    """`sst_gradient` for planes of any size."""
    return in_tiles(df, [col], (1, 1), lambda cells, own: sst_gradient(cells, grid, col, out, own), size, keys)


def distance_to_coast_tiled(
    cells: DataFrame, grid: Grid, keys: Sequence[str] = ("region",), size: int = TILE,
) -> DataFrame:
    """`distance_to_coast` for planes of any size.

    Steps to land along columns, then rows, are found within a tile's line and
    completed by the land nearest to its ends in other tiles. Cells of a row
    then look at those of their own tile; what they have found so far is an
    upper bound, and another tile of the row sends only cells whose land could
    be nearer than the largest bound of the tile that asks. Over open sea the
    bounds of neighbouring tiles are alike, so few cells are sent, and an array
    holds a tile's line and what was sent to it.
    """
    keys, dx = list(keys), grid.col_km
    line = [*keys, "lat_idx"]
    ocean = settle(cells.select(*keys, "lat_idx", "lon_idx").distinct())
    ocean = settle(_steps_to_land(ocean, [*keys, "lon_idx"], "lat_idx", grid.n_lat, "up", size))
    ocean = _steps_to_land(ocean, line, "lon_idx", grid.n_lon, "side", size)

    def away(columns: Column, up: Column) -> Column:
        return F.sqrt(F.pow(columns * F.lit(dx), F.lit(2.0)) + F.pow(up * F.lit(grid.row_km), F.lit(2.0)))

    def through(cell: Column, others: str) -> Column:
        return F.array_min(F.transform(others, lambda other: away(cell["lon_idx"] - other["lon_idx"], other["up"])))

    tiles = ocean.groupBy(*line, F.floor(F.col("lon_idx") / size).cast("int").alias("_tile")).agg(
        F.collect_list(F.struct("lon_idx", "up", "side")).alias("_own")
    )
    tiles = settle(tiles.withColumn("_own", F.transform("_own", lambda cell: F.struct(
        cell["lon_idx"].alias("lon_idx"), cell["up"].alias("up"),
        F.least(through(cell, "_own"), cell["side"] * F.lit(dx)).alias("best"),
    ))))
    # A cell that knows of no land yet takes any.
    bound = F.array_max(F.transform("_own", lambda cell: F.coalesce(cell["best"], F.lit(math.inf))))
    asking = tiles.groupBy(*(F.col(c).alias(f"_at_{c}") for c in line)).agg(
        F.collect_list(F.struct(F.col("_tile").alias("tile"), bound.alias("bound"))).alias("_asking")
    )
    least_up = F.array_min(F.transform("_own", lambda cell: cell["up"]))
    gap = (F.abs(F.col("_ask.tile") - F.col("_tile")) - 1) * size + 1
    pairs = tiles.join(asking, _same(line, "_at_")).withColumn("_ask", F.explode("_asking"))
    pairs = pairs.where((F.col("_ask.tile") != F.col("_tile")) & (away(gap, least_up) < F.col("_ask.bound")))

    def to_edge(cell: Column) -> Column:
        ahead = F.col("_ask.tile") * size - cell["lon_idx"]
        return F.when(F.col("_ask.tile") > F.col("_tile"), ahead).otherwise(1 - ahead - size)

    sent = pairs.withColumn("_sent", F.filter("_own", lambda cell: away(to_edge(cell), cell["up"]) < F.col("_ask.bound")))
    sent = sent.withColumn("_tile", F.col("_ask.tile"))
    place = [*line, "_tile"]
    sent = sent.groupBy(*(F.col(c).alias(f"_at_{c}") for c in place)).agg(F.flatten(F.collect_list("_sent")).alias("_sent"))
    return tiles.join(sent, _same(place, "_at_"), "left").select(*line, F.inline(F.transform("_own", lambda cell: F.struct(
        cell["lon_idx"].alias("lon_idx"), F.least(cell["best"], through(cell, "_sent")).alias("dist_coast_km"),
    ))))


def _steps_to_land(df: DataFrame, line: list[str], along: str, n: int, out: str, size: int) -> DataFrame:
    """Add `out`, the steps from each cell to the nearest cell of its line that
    is absent from `df`. Ends of the grid are no land. Tiles without any cell
    have no row; the gap they leave is land."""
    place, tile = F.col(along), [*line, "_tile"]
    start = F.col("_tile") * size
    end = F.least(start + size, F.lit(n)) - 1
    rows = df.withColumn("_tile", F.floor(place / size).cast("int"))
    rows = rows.withColumn("_run", place - F.row_number().over(Window.partitionBy(*tile).orderBy(along)))
    run = Window.partitionBy(*tile, "_run")
    rows = rows.withColumns({"_first": F.min(along).over(run), "_last": F.max(along).over(run)})
    tiles = rows.groupBy(*tile).agg(
        F.min(along).alias("_lowest"), F.max(along).alias("_highest"),
        F.min("_last").alias("_low_end"), F.max("_first").alias("_high_start"),
    )
    order = Window.partitionBy(*line).orderBy("_tile")
    before = F.coalesce(F.lag("_tile").over(order), F.lit(-1))
    after = F.coalesce(F.lead("_tile").over(order), F.lit(math.ceil(n / size)))
    tiles = tiles.withColumns({
        "_below": F.when(F.col("_tile") - before > 1, start - 1),
        "_above": F.when(after - F.col("_tile") > 1, end + 1),
        "_top": F.when(F.col("_highest") < end, end).when(F.col("_high_start") > start, F.col("_high_start") - 1),
        "_bottom": F.when(F.col("_lowest") > start, start).when(F.col("_low_end") < end, F.col("_low_end") + 1),
    })
    lower = order.rowsBetween(Window.unboundedPreceding, -1)
    higher = order.rowsBetween(1, Window.unboundedFollowing)
    tiles = tiles.select(
        *(F.col(c).alias(f"_at_{c}") for c in tile),
        F.greatest("_below", F.max(F.greatest("_top", "_below")).over(lower)).alias("_land_below"),
        F.least("_above", F.min(F.least("_bottom", "_above")).over(higher)).alias("_land_above"),
    )
    back = F.when(F.col("_first") > start, place - F.col("_first") + 1).otherwise(place - F.col("_land_below"))
    ahead = F.when(F.col("_last") < end, F.col("_last") - place + 1).otherwise(F.col("_land_above") - place)
    return rows.join(tiles, _same(tile, "_at_")).select(*df.columns, F.least(back, ahead).alias(out))


def pct_rank_ranged(
    df: DataFrame, col: str, out: str, by: Sequence[str] = DAY_KEYS, per_range: int = SCORES_PER_RANGE,
) -> DataFrame:
    """Add `pct_rank` of `col` for groups of any size; NaN counts as no value.

    Rows are reduced to one per group and distinct value, running counts are
    formed inside ranges of values and completed with the totals of the ranges
    below. Ranks then go back to the rows by group and value.
    """
    by = list(by)
    value = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    counts = df.select(*by, value.alias("_s")).where("_s is not null").groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"))
    counts = in_ranges(settle(counts), per_range)
    group = Window.partitionBy(*by)
    upto = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*by, "_range").agg(F.sum("_n").alias("_of_range"))
    totals = totals.select(
        *(F.col(c).alias(f"_at_{c}") for c in (*by, "_range")),
        F.coalesce(F.sum("_of_range").over(upto), F.lit(0)).alias("_below"), F.sum("_of_range").over(group).alias("_of_group"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.withColumn("_upto", F.sum("_n").over(inside))
    ranks = ranks.join(totals, _same([*by, "_range"], "_at_"))
    # The first place of a tie and its last.
    middle = F.col("_below") + (F.col("_upto") - F.col("_n") + 1 + F.col("_upto")) / F.lit(2.0)
    ranks = ranks.select(
        *(F.col(c).alias(f"_of_{c}") for c in by), F.col("_s").alias("_of__s"), (middle / F.col("_of_group") * 100).alias(out),
    )
    rows = df.withColumn("_s", value)
    return rows.join(ranks, _same([*by, "_s"], "_of_"), "left").select(*df.columns, out)


def _same(columns: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in columns])


def physics_index_ranged(
    df: DataFrame, by: Sequence[str] = DAY_KEYS, rules: Rules = RULES, chl: str = "chl",
    front: str = "sst_gradient", out: str = "physics_index", per_range: int = SCORES_PER_RANGE,
) -> DataFrame:
    """`physics_index` for groups of any size."""
    ranked = pct_rank_ranged(df, chl, "_chl", by, per_range)
    ranked = pct_rank_ranged(ranked, front, "_front", by, per_range)
    parts = (("_chl", rules.chl_weight), ("_front", rules.front_weight))
    total = sum(F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in parts)
    weight = sum(F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts)
    return ranked.withColumn(out, F.when(weight > 0, half_even(total / weight, 1))).drop("_chl", "_front")
