"""Cells turned into named, ranked fishing zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.functions import (
    coast_band, exact_mean, half_even, nearest_site, rating, reachable,
    safety_class, share, zone_id,
)
from seagrid.grid import Grid
from seagrid.operators.coast import distance_to_coast
from seagrid.operators.tiles import distance_to_coast_tiled
from seagrid.rules import CAUTION, DANGER, RULES, SAFE, UNKNOWN, Rules
from seagrid.session import small_table


def zone_plane(
    cells: DataFrame, grid: Grid, keys: Sequence[str] = ("region",),
    rules: Rules = RULES, tile: int | None = None,
) -> DataFrame:
    """One row per distinct cell: coast distance, nearest site, reach, zone.

    Everything here is fixed in time, so it is worked out per cell and not per
    cell-day. With `tile` the coast distance is found tile by tile, for grids
    whose lines are too long for one task.
    """
    if tile is None:
        plane = distance_to_coast(cells, grid, keys)
    else:
        plane = distance_to_coast_tiled(cells, grid, keys, tile)
    site = nearest_site(
        grid.lat(F.col("lat_idx")), grid.lon(F.col("lon_idx")), rules
    )
    cell = [*keys, "lat_idx", "lon_idx"]
    km, band = F.col("dist_coast_km"), coast_band(F.col("dist_coast_km"), rules)
    return plane.withColumn("_site", site).select(
        *cell, km, F.col("_site.site_id"), F.col("_site.site_km"),
        reachable(km, F.col("_site.site_km"), rules).alias("reachable"),
        *[b.alias(name) for name, b in band.items()],
        zone_id(F.col("_site.site_id"), band["band"]).alias("zone_id"),
    )


def assign_zones(
    df: DataFrame, grid: Grid, per_day: bool = False, rules: Rules = RULES,
    plane: DataFrame | None = None,
) -> DataFrame:
    """Attach coast distance, landing site, reach, band and zone to cell-days.

    Land is any cell never seen in the region; with `per_day` it is any cell
    absent from that day's rows, so a missing reading reads as coast. A stored
    `zone_plane` can be passed in and saves looking for the cells again.
    """
    keys = ["region", "date"] if per_day else ["region"]
    if plane is None:
        plane = zone_plane(df, grid, keys, rules)
    return df.join(plane, [*keys, "lat_idx", "lon_idx"], "left")


def zone_summary(
    df: DataFrame, grid: Grid, score: str = "score", source: str | None = None,
    by: Sequence[str] = ("region", "date"), rules: Rules = RULES,
) -> DataFrame:
    """Reachable cells gathered into zones.

    One hash aggregation over the cell-days computes every figure of a zone;
    there are at most sites x bands zones per day. Names are looked up
    afterwards, so the aggregated rows stay narrow. `source` says where scores
    come from; without it a column `score_source` does, which is the same for
    all cells of a day.
    """
    wave, wind = F.col("wave_height_max"), F.col("wind_speed_max")
    lat, lon = grid.lat(F.col("lat_idx")), grid.lon(F.col("lon_idx"))
    half = grid.res / 2
    columns = set(df.columns)
    usable = df.where(F.col("reachable") & F.col("zone_id").isNotNull())
    usable = usable.withColumns({"_state": safety_class(wave, wind, rules)})
    estimated = (
        half_even(exact_mean(F.col("wave_estimated").cast("double")), 2)
        if "wave_estimated" in columns else F.lit(0.0)
    )

    def mean(name: str, digits: int) -> Column:
        if name not in columns:
            return F.lit(None).cast("double").alias(name)
        return half_even(exact_mean(F.col(name)), digits).alias(name)

    def is_state(code: str) -> Column:
        return share(F.col("_state") == code)

    names = ("id", "so", "en", "lat", "lon")
    sites = small_table(
        df.sparkSession, "site_id site", [(s[0], dict(zip(names, s))) for s in rules.sites]
    )
    bands = small_table(
        df.sparkSession, "band band_so band_en",
        [(f"{low}-{high}", so, en) for low, high, so, en in rules.bands],
    )
    zones = usable.groupBy(*by, "zone_id", "site_id", "band").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.struct(
            half_even(exact_mean(lat), 3).alias("lat"),
            half_even(exact_mean(lon), 3).alias("lon"),
        ).alias("centre"),
        F.struct(
            half_even(F.min(lat) - half, 3).alias("lat_min"),
            half_even(F.max(lat) + half, 3).alias("lat_max"),
            half_even(F.min(lon) - half, 3).alias("lon_min"),
            half_even(F.max(lon) + half, 3).alias("lon_max"),
        ).alias("bounds"),
        exact_mean(F.col("site_km")).alias("_km"),
        half_even(exact_mean(F.col(score)), 1).alias("score"),
        F.struct(
            mean("sst", 1), mean("chl", 3), mean("sst_gradient", 2),
            mean("wave_height_max", 2), mean("wind_speed_max", 0),
        ).alias("conditions"),
        is_state(DANGER).alias("_danger"),
        is_state(SAFE).alias("_safe"),
        is_state(UNKNOWN).alias("_unknown"),
        estimated.alias("wave_estimated_share"),
        (F.max("score_source") if source is None and "score_source" in columns else F.lit(source).cast("string"))
        .alias("score_source"),
    )
    state = (
        F.when(F.col("_danger") >= rules.zone_danger_share, DANGER)
        .when(F.col("_safe") >= rules.zone_safe_share, SAFE)
        .when(F.col("_unknown") > rules.zone_unknown_share, UNKNOWN)
        .otherwise(CAUTION)
    )
    named = zones.join(F.broadcast(sites), "site_id").join(F.broadcast(bands), "band")
    return named.select(
        *by, "zone_id",
        F.concat_ws(" ", "band_so", "site.so").alias("name_so"),
        F.concat_ws(" ", F.col("site.en"), F.lower("band_en")).alias("name_en"),
        "site", F.col("band").alias("band_km"), "n_cells", "centre", "bounds",
        half_even(F.col("_km"), 1).alias("distance_km"),
        half_even(F.col("_km") / rules.boat_speed_kmh, 1).alias("travel_hours"),
        "score",
        "score_source",
        state.alias("safety"),
        half_even(F.col("_danger"), 2).alias("share_dangerous"),
        "conditions", "wave_estimated_share",
    )


def rank_zones(
    zones: DataFrame, top_n: int | None = None,
    by: Sequence[str] = ("region", "date"),
) -> DataFrame:
    """Rank the zones of a day: safer states first, then the higher score.

    A dangerous zone never ranks above a safer one. Zones without a score come
    last within their state; equal ones go by zone id.
    """
    severity = (
        F.when(F.col("safety") == SAFE, 0).when(F.col("safety") == CAUTION, 1)
        .when(F.col("safety") == UNKNOWN, 2).when(F.col("safety") == DANGER, 3)
        .otherwise(9)
    )
    order = Window.partitionBy(*by).orderBy(
        severity, F.col("score").desc_nulls_last(), "zone_id"
    )
    ranked = zones.withColumns({
        "rank": F.row_number().over(order), "rating": rating(F.col("score")),
    })
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)
