"""Depth, roughness and land share from fine elevation pixels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.functions import share
from seagrid.grid import Grid
from seagrid.operators.evaluate import SCORES_PER_RANGE, in_ranges
from seagrid.operators.regrid import Axis, regrid_bilinear
from seagrid.session import settle


def seabed(
    pixels: DataFrame, grid: Grid, keys: Sequence[str] = ("region",),
    elevation: str = "elevation",
) -> DataFrame:
    """Per cell: mean depth (m, null at or above sea level), spread of the
    elevation inside the cell, and the share of dry pixels."""
    height = F.col(elevation)
    lat_idx = F.floor((F.col("lat") - grid.lat_min) / grid.res).cast("int")
    lon_idx = F.floor((F.col("lon") - grid.lon_min) / grid.res).cast("int")
    blocks = (
        pixels.withColumns({"lat_idx": lat_idx, "lon_idx": lon_idx})
        .where(grid.contains(F.col("lat_idx"), F.col("lon_idx")))
        .groupBy(*keys, "lat_idx", "lon_idx")
        .agg(
            F.avg(height).alias("mean_height"),
            F.stddev_pop(height).alias("seabed_roughness"),
            share(height >= 0).alias("land_fraction"),
        )
    )
    return _with_depth(blocks)


def seabed_interpolated(
    pixels: DataFrame, lat_axis: Axis, lon_axis: Axis, grid: Grid,
    keys: Sequence[str] = ("region",), elevation: str = "elevation",
) -> DataFrame:
    """The same columns when pixels do not nest in the cells: depth is
    interpolated, roughness unknown, and a cell is all land or none."""
    points = regrid_bilinear(pixels, [elevation], lat_axis, lon_axis, grid, keys)
    return _with_depth(
        points.withColumnRenamed(elevation, "mean_height").withColumns({
            "seabed_roughness": F.lit(None).cast("double"),
            "land_fraction": F.when(F.col("mean_height") >= 0, 1.0).otherwise(0.0),
        })
    )


def pixel_spacing(pixels: DataFrame, grid: Grid, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Per region: number, first and spacing of the pixels' latitudes and longitudes,
    and whether they nest in the cells: a whole number of them spans a cell, and a
    whole number of cells the pixels."""
    keys, sides, nests = list(keys), [], F.lit(True)
    for side in ("lat", "lon"):
        lines = pixels.select(*keys, F.col(side).cast("double").alias("_x")).where(F.col("_x").isNotNull()).distinct()
        sides.append(lines.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"n_{side}"), F.min("_x").alias(f"{side}_first"),
            F.try_divide(F.max("_x") - F.min("_x"), F.count(F.lit(1)) - 1).alias(f"{side}_step"),
        ))
        ratio = F.try_divide(F.lit(grid.res), f"{side}_step")
        whole = (F.abs(ratio - F.rint(ratio)) < 1e-6) & (F.try_mod(F.col(f"n_{side}"), F.rint(ratio).cast("long")) == 0)
        nests = nests & F.coalesce(whole, F.lit(False))
    return sides[0].join(sides[1], keys).withColumn("nests", nests)


def seabed_by_spacing(
    pixels: DataFrame, grid: Grid, keys: Sequence[str] = ("region",), elevation: str = "elevation",
) -> DataFrame:
    """Block means where a region's pixels nest in the cells, interpolation where they
    do not, in one table. One row per region reaches the driver; regions whose pixels
    lie on the same axes are interpolated together."""
    keys = list(keys)
    spacing = settle(pixel_spacing(pixels, grid, keys))
    axes: dict[tuple, list] = {}
    for r in spacing.where(~F.col("nests")).collect():
        around = tuple(Axis.regular(r[f"{s}_first"], r[f"{s}_step"] or 1.0, r[f"n_{s}"]) for s in ("lat", "lon"))
        axes.setdefault(around, []).append(tuple(r[k] for k in keys))
    out = [seabed(pixels.join(spacing.where("nests").select(*keys), keys, "left_semi"), grid, keys, elevation)]
    kinds = ", ".join(f"`{k}` {pixels.schema[k].dataType.simpleString()}" for k in keys)
    for (lat_axis, lon_axis), regions in axes.items():
        own = pixels.join(pixels.sparkSession.createDataFrame(regions, kinds), keys, "left_semi")
        out.append(seabed_interpolated(own, lat_axis, lon_axis, grid, keys, elevation))
    return reduce(DataFrame.unionByName, out)


def _with_depth(blocks: DataFrame) -> DataFrame:
    depth = -F.col("mean_height")
    return blocks.withColumn("depth", F.when(depth > 0, depth)).drop("mean_height")


def join_static(
    df: DataFrame, static: DataFrame,
    keys: Sequence[str] = ("region", "lat_idx", "lon_idx"),
) -> DataFrame:
    """Attach per-cell values to cell-days.

    No broadcast is forced: a single region's plane is small and Catalyst will
    broadcast it by itself, many regions' planes may not be.
    """
    return df.join(static, list(keys), "left")


def depth_report(static: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median, least and greatest depth, and cells at or above sea level.

    The median is exact: equal depths are counted, counts are added up inside
    depth ranges, and the ranges' totals tell which one holds the middle.
    """
    keys = list(keys)
    plain = static.groupBy(*keys).agg(
        F.min("depth").alias("min_depth"),
        F.max("depth").alias("max_depth"),
        F.count_if(F.col("depth").isNull()).alias("cells_above_sea"),
    )
    counts = static.where(F.col("depth").isNotNull()).groupBy(*keys, F.col("depth").alias("_s"))
    counts = in_ranges(settle(counts.agg(F.count(F.lit(1)).alias("n"))), SCORES_PER_RANGE)
    totals = counts.groupBy(*keys, "_range").agg(F.sum("n").alias("range_n"))
    group = Window.partitionBy(*keys)
    below = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(c).alias(f"_at_{c}") for c in (*keys, "_range")],
        F.coalesce(F.sum("range_n").over(below), F.lit(0)).alias("below"), F.sum("range_n").over(group).alias("total"),
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (*keys, "_range")])
    inside = Window.partitionBy(*keys, "_range").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.join(totals, same).withColumn("upto", F.sum("n").over(inside) + F.col("below"))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("n") <= place), F.col("_s")))

    middle = (at(F.floor((F.col("total") - 1) / 2)) + at(F.floor(F.col("total") / 2))) / 2
    medians = running.groupBy(*keys).agg(middle.alias("median_depth"))
    # One row per group on either side.
    both = plain.unionByName(medians, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[
        F.max(c).alias(c) for c in ("median_depth", "min_depth", "max_depth", "cells_above_sea")
    ])
