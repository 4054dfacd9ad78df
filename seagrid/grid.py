"""The analysis grid: a box cut into equal cells, addressed by integers.

Cell keys are always `(region, lat_idx, lon_idx)`. Indices count from the
south-west corner of the region's own box, so they mean nothing without the
region; coordinates are carried for display and never joined on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32


@dataclass(frozen=True)
class Grid:
    region: str
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float
    res: float = 0.1

    @property
    def n_lat(self) -> int:
        return round((self.lat_max - self.lat_min) / self.res)

    @property
    def n_lon(self) -> int:
        return round((self.lon_max - self.lon_min) / self.res)

    @property
    def n_cells(self) -> int:
        return self.n_lat * self.n_lon

    @property
    def row_km(self) -> float:
        """Height of a cell in km."""
        return self.res * KM_PER_DEGREE

    @property
    def col_km(self) -> float:
        """Width of a cell in km at the middle latitude of the box."""
        middle = self.lat_min + self.n_lat * self.res / 2
        return self.row_km * math.cos(math.radians(middle))

    def lat(self, idx: Column) -> Column:
        return self._centre(idx, self.lat_min)

    def lon(self, idx: Column) -> Column:
        return self._centre(idx, self.lon_min)

    def _centre(self, idx: Column, low: float) -> Column:
        return F.rint((F.lit(low) + F.lit(self.res) * (idx + F.lit(0.5))) * 1e4) / 1e4

    def lat_idx(self, lat: Column) -> Column:
        return self._index(lat, self.lat_min)

    def lon_idx(self, lon: Column) -> Column:
        return self._index(lon, self.lon_min)

    def _index(self, x: Column, low: float) -> Column:
        half = self.res / 2
        return F.rint((x.cast("double") - low - half) / self.res).cast("int")

    def contains(self, lat_idx: Column, lon_idx: Column) -> Column:
        """True where the indices fall on the grid."""
        return (
            (lat_idx >= 0) & (lat_idx < self.n_lat)
            & (lon_idx >= 0) & (lon_idx < self.n_lon)
        )

    def in_box(self, lat: Column, lon: Column) -> Column:
        """True where the coordinates lie in the box, edges included."""
        return lat.between(self.lat_min, self.lat_max) & lon.between(
            self.lon_min, self.lon_max
        )

    def polygon(self) -> list[list[float]]:
        """The box as a closed ring of [lon, lat] corners."""
        w, e, s, n = self.lon_min, self.lon_max, self.lat_min, self.lat_max
        return [[w, s], [e, s], [e, n], [w, n], [w, s]]

    def cells(self, spark: SparkSession) -> DataFrame:
        """One row per cell: region, cell_id, lat_idx, lon_idx, lat, lon."""
        n = F.col("id")
        return (
            spark.range(self.n_cells)
            .select(
                F.lit(self.region).alias("region"),
                F.floor(n / self.n_lon).cast("int").alias("lat_idx"),
                F.pmod(n, F.lit(self.n_lon)).cast("int").alias("lon_idx"),
            )
            .withColumns({
                "cell_id": cell_id(F.col("lat_idx"), F.col("lon_idx")),
                "lat": self.lat(F.col("lat_idx")),
                "lon": self.lon(F.col("lon_idx")),
            })
        )


def cell_id(lat_idx: Column, lon_idx: Column) -> Column:
    """Text id of a cell, indices padded to at least four digits."""

    def padded(idx: Column) -> Column:
        # lpad is much cheaper than formatting but would cut longer numbers.
        short = F.lpad(idx.cast("string"), 4, "0")
        return F.when(idx.between(0, 9999), short).otherwise(F.format_string("%04d", idx))

    return F.concat(F.lit("c_"), padded(lat_idx), F.lit("_"), padded(lon_idx))


# The two study boxes.
REGIONS = {
    "somali": Grid("somali", -2.0, 12.5, 40.5, 52.5),
    "wide": Grid("wide", -10.0, 15.0, 38.0, 60.0),
}
