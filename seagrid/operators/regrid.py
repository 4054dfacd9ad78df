"""Bilinear resampling onto the analysis grid."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.grid import Grid
from seagrid.session import small_table

#: A reading belongs to the node within this share of the smallest step.
NEAR = 0.25
#: Coordinates closer than this, in degrees, are one node stored with different precision.
SAME = 1e-4


@dataclass(frozen=True)
class Axis:
    """Ascending coordinates of a source along one direction."""

    values: tuple[float, ...]

    @staticmethod
    def regular(start: float, step: float, n: int) -> "Axis":
        return Axis(tuple(round(start + k * step, 9) for k in range(n)))

    @staticmethod
    def of(readings: DataFrame, column: str) -> "Axis":
        """The axis a source is stored on, taken from its readings. Coordinates
        that differ by rounding alone are one; as many numbers as the axis is
        long reach the driver."""
        found = readings.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("float").alias("f"))
        values: list[float] = []
        for r in found.agg(F.min(F.col(column).cast("double")).alias("x")).orderBy("x").collect():
            if not values or r["x"] - values[-1] > SAME:
                values.append(r["x"])
        return Axis(tuple(values))

    @property
    def step(self) -> float:
        """The smallest distance of two nodes."""
        gaps = [b - a for a, b in zip(self.values, self.values[1:])]
        return min(gaps) if gaps else 1.0

    def places(self, node: int) -> list[int]:
        """The step-wide bins that readings of a node fall into: one, or two if
        it lies near an edge of its bin."""
        x, off = self.values[node] - self.values[0], self.step * NEAR
        return sorted({math.floor((x + d) / self.step + 0.5) for d in (-off, off)})

    def bin(self, x: Column) -> Column:
        return F.floor((x.cast("double") - self.values[0]) / self.step + 0.5).cast("long")

    def weights(self, targets: Sequence[float]) -> list[tuple[int, int, float, int]]:
        """(target index, source index, weight, number of sources needed).

        Targets outside the axis get no entry: nothing is extrapolated.
        """
        out = []
        for t, x in enumerate(targets):
            if not self.values[0] <= x <= self.values[-1]:
                continue
            right = min(bisect_right(self.values, x), len(self.values) - 1)
            left = max(right - 1, 0)
            span = self.values[right] - self.values[left]
            w = (x - self.values[left]) / span if span else 0.0
            pair = [(s, p) for s, p in ((left, 1.0 - w), (right, w)) if p > 0]
            out += [(t, s, p, len(pair)) for s, p in pair]
        return out


def regrid_bilinear(
    readings: DataFrame, variables: Sequence[str], lat_axis: Axis, lon_axis: Axis,
    grid: Grid, keys: Sequence[str] = ("region", "date"), partitions: int | None = None,
) -> DataFrame:
    """Interpolate `variables` from source nodes to the cell centres of `grid`.

    `readings` holds `keys`, `lat`, `lon` and the variables, one row per node.
    A result is null unless all the nodes it needs have a value; cells outside
    the source's extent get no row. A reading belongs to the node it lies within
    a quarter of a step of, whatever precision its coordinates are stored in;
    `unmatched_readings` counts those that belong to none.

    The weights separate into one short table per axis (two entries per grid
    line), so they are broadcast safely whatever the amount of readings. Each
    reading is spread over the cells it touches and summed there. Readings are
    laid out by day before they are spread, which is the one exchange here and
    is reused by the operators that follow on the day's plane; a day holds at
    most one reading per source node. `partitions` says how many there are, the
    session's shuffle partitions by default: a number that adaptive execution
    leaves alone, since it would join partitions by the size of the readings and
    not by that of the cells they are spread over.
    """
    spark = readings.sparkSession
    lat_w = _weights(spark, lat_axis, grid.lat_min, grid.res, grid.n_lat, "lat")
    lon_w = _weights(spark, lon_axis, grid.lon_min, grid.res, grid.n_lon, "lon")
    by_day = readings
    if "date" in keys:
        by_day = readings.repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    spread = (
        by_day.withColumns({"lat_bin": lat_axis.bin(F.col("lat")), "lon_bin": lon_axis.bin(F.col("lon"))})
        .join(F.broadcast(lat_w), "lat_bin")
        .join(F.broadcast(lon_w), "lon_bin")
        .where(_at_node("lat", lat_axis) & _at_node("lon", lon_axis))
        .withColumn("w", F.col("lat_w") * F.col("lon_w"))
    )
    needed = F.any_value(F.col("lat_n") * F.col("lon_n"))
    return spread.groupBy(*keys, "lat_idx", "lon_idx").agg(*[
        F.when(F.count(v) == needed, F.sum(F.col(v) * F.col("w"))).alias(v)
        for v in variables
    ])


def marked_readings(readings: DataFrame, lat_axis: Axis, lon_axis: Axis) -> DataFrame:
    """`readings` with `_matched`: whether a reading belongs to a node of both axes."""
    marked = readings
    for side, axis in (("lat", lat_axis), ("lon", lon_axis)):
        nodes = small_table(
            readings.sparkSession, f"{side}_bin {side}_node", [(p, x) for k, x in enumerate(axis.values) for p in axis.places(k)]
        )
        # A bin is one step wide, so a node and its neighbour may share one.
        nodes = nodes.groupBy(f"{side}_bin").agg(F.collect_list(f"{side}_node").alias(f"{side}_nodes"))
        marked = marked.withColumn(f"{side}_bin", axis.bin(F.col(side))).join(F.broadcast(nodes), f"{side}_bin", "left")
        marked = marked.withColumn(f"{side}_hit", _near_any(side, axis))
    return marked.select(*readings.columns, (F.col("lat_hit") & F.col("lon_hit")).alias("_matched"))


def unmatched_readings(
    readings: DataFrame, lat_axis: Axis, lon_axis: Axis, keys: Sequence[str] = ("region", "date"),
) -> DataFrame:
    """Per group the number of readings and of those that belong to no node of
    the axes, which `regrid_bilinear` cannot use."""
    return marked_readings(readings, lat_axis, lon_axis).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("readings"), F.count_if(~F.col("_matched")).alias("unmatched")
    )


def _near_any(side: str, axis: Axis) -> Column:
    def near(node: Column) -> Column:
        return F.abs(F.col(side).cast("double") - node) <= axis.step * NEAR

    return F.coalesce(F.exists(f"{side}_nodes", near), F.lit(False))


def _at_node(side: str, axis: Axis) -> Column:
    return F.abs(F.col(side).cast("double") - F.col(f"{side}_node")) <= axis.step * NEAR


def _weights(
    spark: SparkSession, axis: Axis, low: float, res: float, size: int, side: str,
) -> DataFrame:
    centres = [round(low + res * (k + 0.5), 4) for k in range(size)]
    rows = [
        (p, axis.values[s], t, w, n) for t, s, w, n in axis.weights(centres) for p in axis.places(s)
    ]
    table = small_table(spark, f"{side}_bin {side}_node {side}_idx {side}_w {side}_n", rows)
    return table.withColumn(f"{side}_idx", F.col(f"{side}_idx").cast("int"))
