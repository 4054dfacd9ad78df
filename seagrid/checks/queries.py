"""The registered queries: (spark, folder) to DataFrame, one per operator."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid import functions as fn
from seagrid import operators as op
from seagrid.checks import views as v
from seagrid.grid import Grid, cell_id
from seagrid.operators.labels import snapped
from seagrid.operators.models import FEATURES, feature_set
from seagrid.plans import build_features, score_days, validate
from seagrid.plans.features import on_grid
from seagrid.plans.incremental import update_features
from seagrid.session import settle, settle_by_day, shared_folder
from seagrid.sources import (
    file_listing, flatten_effort, load_model, read_effort, read_features, save_model,
    source_inventory, write_daily, write_features,
)
from seagrid.sources.readers import surface
from seagrid import sources, streaming
from seagrid.operators import boosting
from seagrid.streaming import daily_updates, read_merged, run_daily

QUERIES: dict = {}
KEY = ["region", "date", "lat_idx", "lon_idx"]
G = v.GRID


def query(f):
    QUERIES[f.__name__] = f
    return f


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can see it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def r6(x):
    return fn.half_even(F.col(x) if isinstance(x, str) else x, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


# ------------------------------------------------------------ grid and scalars

@query
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Grid cells with the number of readings in each."""
    counts = v.table(spark, sf, "lineitem").groupBy(
        (F.col("l_partkey") % 20).cast("int").alias("lat_idx"),
        (F.col("l_suppkey") % 20).cast("int").alias("lon_idx"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return (
        G.cells(spark).drop("region").join(counts, ["lat_idx", "lon_idx"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )


@query
def cell_index(spark, sf):
    lat = (F.col("l_partkey") * 7 % 2600).cast("double") / 1000 + 0.9
    lon = (F.col("l_orderkey") * 13 % 2600).cast("double") / 1000 + 43.9
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", lat.alias("lat"), lon.alias("lon")
    ).withColumns({
        "lat_idx": G.lat_idx(F.col("lat")), "lon_idx": G.lon_idx(F.col("lon")),
        "in_box": G.in_box(F.col("lat"), F.col("lon")),
    }).withColumns({
        "on_grid": G.contains(F.col("lat_idx"), F.col("lon_idx")),
        "cell_id": cell_id(F.col("lat_idx"), F.col("lon_idx")),
    })


@query
def unit_conversion(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate"),
        r6(fn.to_celsius(F.col("l_quantity") + 270)).alias("celsius"),
        r6(fn.to_kmh(F.col("l_quantity"))).alias("kmh"),
        r6(fn.speed(F.col("l_quantity"), F.col("l_discount") * 100)).alias("speed"),
        fn.to_day(F.col("l_shipdate")).alias("day"),
        fn.fished(F.col("l_quantity") / 20).cast("int").alias("fished"),
        fn.to_index(F.col("l_discount") * 12.3456 - 0.1).alias("shown"),
    ).drop("l_shipdate")


@query
def cyclic_month(spark, sf):
    return v.table(spark, sf, "orders").withColumns(
        fn.cyclic_month(F.col("o_orderdate"))
    ).select(
        "o_orderkey", F.col("month").cast("int").alias("month"),
        r6("month_sin").alias("month_sin"), r6("month_cos").alias("month_cos"),
    )


@query
def safety_class(spark, sf):
    return op.classify(v.cell_day(spark, sf)).select(*KEY, "safety")


@query
def coast_band(spark, sf):
    km = F.when(F.col("l_tax") > 0, F.col("l_quantity") * 2 - 2)
    bands = fn.coast_band(km)
    site_km = F.col("l_discount") * 1000
    return v.table(spark, sf, "lineitem").withColumns(bands).select(
        "l_orderkey", "l_linenumber", "band", "band_so", "band_en",
        fn.reachable(km, site_km).alias("reachable"),
        fn.zone_id(F.col("l_returnflag"), F.col("band")).alias("zone_id"),
    )


@query
def zone_rating(spark, sf):
    score = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 5000)
    return v.table(spark, sf, "orders").select(
        "o_orderkey", fn.rating(score).alias("r")
    ).select("o_orderkey", "r.level", "r.so", "r.en")


@query
def navigable(spark, sf):
    return op.navigable_days(v.sea_day(spark, sf)).select(
        *KEY, "wave_height_max", "wind_speed_max"
    )


@query
def snap_effort(spark, sf):
    """Every point inside a cell finds its cell."""
    return snapped(
        v.soundings(spark, sf).select(
            r6("lat").alias("lat"), r6("lon").alias("lon"), "elevation"
        ), G, anchor="any",
    ).groupBy("lat_idx", "lon_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("elevation").alias("elevation")
    )


# ------------------------------------------------------- sources and planning

@query
def missing_sources(spark, sf):
    return op.missing_sources(v.found_sources(spark, sf), op.expected_sources(spark)).select(
        "mode", "source", "dataset_id"
    )


@query
def missing_by_year(spark, sf):
    found = v.found_sources(spark, sf)
    return op.missing_by_year(found, op.expected_sources(spark), F.col("year")).select(
        "mode", "source", "year"
    )


@query
def missing_training_sources(spark, sf):
    found = v.found_sources(spark, sf)
    expected = op.expected_sources(spark, training_only=True)
    return op.missing_by_year(found, expected, F.col("year")).select("mode", "source", "year")


@query
def coverage_check(spark, sf):
    return op.coverage_check(v.found_sources(spark, sf), op.expected_sources(spark)).select(
        "mode", "source", "status",
        F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"),
        F.concat_ws(",", "missing_variables").alias("missing"),
    )


@query
def clamp_windows(spark, sf):
    bounds = v.customer_windows(spark, sf).groupBy("source").agg(
        F.min("start_day").alias("first_day"),
        F.date_sub(F.max("end_day"), 400).alias("last_day"),
    ).where(F.col("source") != "wnd")
    return op.clamp_windows(v.customer_windows(spark, sf), bounds)


@query
def calendar_chunks(spark, sf):
    windows = v.customer_windows(spark, sf).drop("mode", "source")
    return op.calendar_chunks(windows, unit="month").drop("start_day", "end_day")


@query
def calendar_years(spark, sf):
    windows = v.customer_windows(spark, sf).drop("mode", "source")
    return op.calendar_chunks(windows, unit="year").drop("start_day", "end_day")


@query
def load_chunks(spark, sf):
    return op.load_chunks(v.customer_windows(spark, sf)).drop("start_day", "end_day")


@query
def pending_chunks(spark, sf):
    done = v.table(spark, sf, "orders").select(
        "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("chunk")
    )
    return op.pending_chunks(calendar_chunks(spark, sf), done, by=["o_custkey", "chunk"])


def _source_files(spark, sf):
    return v.found_sources(spark, sf).groupBy(
        "year", F.concat_ws("", F.lit("/raw/"), "mode", F.lit("/"), "source", F.lit("/"), "source",
                            F.lit("_"), F.col("year").cast("string"), F.lit(".nc")).alias("path")
    ).agg(F.sum("bytes").alias("bytes"))


@query
def source_inventories(spark, sf):
    return rounded(source_inventory(_source_files(spark, sf).drop("year")), "megabytes")


@query
def source_inventory_unfit(spark, sf):
    """Files of odd years lie elsewhere; they are listed all the same."""
    odd = F.when(F.col("year") % 2 == 0, F.col("path")).otherwise(F.concat(F.col("path"), F.lit("/copy")))
    files = _source_files(spark, sf).select(odd.alias("path"), "bytes")
    return rounded(source_inventory(files), "megabytes")


@query
def bathymetry_inventory(spark, sf):
    """Files of 1995 stand in for the elevation files."""
    files = _source_files(spark, sf)
    moved = F.when(F.col("year") == 1995, F.regexp_replace("path", "^/raw/.*/", "/raw/gebco/")).otherwise(F.col("path"))
    files = files.select(moved.alias("path"), "bytes")
    both = sources.bathymetry_inventory(files).unionByName(sources.bathymetry_inventory(files, "etopo"))
    return rounded(both, "megabytes")


@query
def file_rows(spark, sf):
    return file_listing(v.table(spark, sf, "lineitem")).select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "n_rows"
    )


@query
def flatten_effort_rows(spark, sf):
    """Effort replies as nested JSON, one per order, taken apart again."""
    row = F.struct(
        F.col("l_shipdate").cast("date").cast("string").alias("date"),
        ((F.col("l_partkey") % 22) * 0.1 + 1.0).alias("lat"),
        (F.col("l_quantity") / 10).alias("hours"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").cast("string").alias("geartype"),
        F.lit("not kept").alias("shipName"),
    )
    lines = v.table(spark, sf, "lineitem")
    fleets = lines.groupBy("l_orderkey", "l_linestatus").agg(F.collect_list(row).alias("rows"))
    # An order has seven lines at most.
    replies = fleets.groupBy("l_orderkey").agg(
        F.collect_list(F.create_map("l_linestatus", "rows")).alias("entries")
    ).select(F.to_json(F.struct("entries")).alias("json"))
    return rounded(flatten_effort(replies), "lat", "hours")


@query
def surface_readings(spark, sf):
    """Only the shallowest level of a source with several."""
    levels = v.readings(spark, sf).withColumn("depth", (F.col("v") / 60).cast("double"))
    top = surface(levels).withColumn("date", fn.to_day(F.col("time"))).drop("time")
    return rounded(top, "u", "v", "value")


@query
def effort_round_trip(spark, sf):
    """Effort written by month and read back, all years."""
    path = scratch(spark, "effort")
    rows = v.effort(spark, sf).drop("region").withColumns({
        "vesselType": F.lit(None).cast("string"), "year": F.year("date"), "month": F.month("date"),
        "date": F.col("date").cast("string"),
    })
    rows.write.partitionBy("year", "month").parquet(path)
    return rounded(read_effort(spark, path).drop("vesselType"), "lat", "lon", "hours")


@query
def features_round_trip(spark, sf):
    """Features written by year and read back, all years and measures."""
    path = scratch(spark, "features")
    rows = v.sea_day(spark, sf).withColumn("region", F.concat(F.lit("r"), "region"))
    write_features(rows, path)
    measures = ["sst", "chl", "wave_height_max", "wind_speed_max"]
    back = read_features(spark, path, columns=["date", "lat_idx", "lon_idx", "fished", *measures])
    return rounded(back, *measures)


# ------------------------------------------------------------------- features

@query
def daily_stats(spark, sf):
    daily = op.daily_stats(v.readings(spark, sf), ["value", "u"], ["user_id"])
    return rounded(daily, "value_mean", "value_max", "u_mean", "u_max")


@query
def wind_speed_max_true(spark, sf):
    wind = op.daily_wind(v.readings(spark, sf), "u", "v", "true", ["user_id"])
    return rounded(wind, "wind_speed", "wind_speed_max")


@query
def wind_speed_max_component(spark, sf):
    wind = op.daily_wind(v.readings(spark, sf), "u", "v", "component", ["user_id"])
    return rounded(wind, "wind_speed", "wind_speed_max")


@query
def regrid_bilinear(spark, sf):
    field = v.coarse_field(spark, sf)
    return rounded(op.regrid_bilinear(field, ["v"], v.COARSE_LAT, v.COARSE_LON, G), "v")


@query
def regrid_float32(spark, sf):
    """Coordinates stored in single precision give the same cells."""
    field = v.coarse_field(spark, sf).withColumns({c: F.col(c).cast("float") for c in ("lat", "lon")})
    return rounded(op.regrid_bilinear(field, ["v"], v.COARSE_LAT, v.COARSE_LON, G), "v")


@query
def regrid_unmatched(spark, sf):
    """Readings that are nowhere near a node are counted."""
    i, j = (F.rint((F.col(c) - low) * 5) for c, low in (("lat", 1.0), ("lon", 44.0)))
    field = v.coarse_field(spark, sf).withColumns({
        "lat": F.col("lat") + F.when(i % 3 == 0, 0.07).otherwise(0.0),
        "lon": F.col("lon") + F.when(j == 9, 0.3).otherwise(0.0),
    })
    return op.unmatched_readings(field, v.COARSE_LAT, v.COARSE_LON, ["region"])


@query
def sst_gradient(spark, sf):
    out = op.sst_gradient(v.cell_day(spark, sf), G)
    return rounded(out.select(*KEY, "sst_gradient"), "sst_gradient")


@query
def fill_nearest(spark, sf):
    out = op.fill_nearest(v.cell_day(spark, sf), "wave_height_max", G, flag="wave_estimated")
    return out.select(*KEY, "wave_height_max", F.col("wave_estimated").cast("int").alias("wave_estimated"))


@query
def sst_gradient_tiled(spark, sf):
    out = op.sst_gradient_tiled(v.cell_day(spark, sf), G, size=8)
    return rounded(out.select(*KEY, "sst_gradient"), "sst_gradient")


@query
def fill_nearest_tiled(spark, sf):
    out = op.fill_nearest_tiled(v.cell_day(spark, sf), "wave_height_max", G, flag="wave_estimated", size=8)
    return out.select(*KEY, "wave_height_max", F.col("wave_estimated").cast("int").alias("wave_estimated"))


def _trailing(spark, sf, days, least, **how):
    out = op.trailing_mean(v.pixel_day(spark, sf), "chl", days, least, "mean", **how)
    return rounded(out.select(*KEY, "mean"), "mean")


@query
def trailing_mean_7(spark, sf):
    return _trailing(spark, sf, 7, 3)


@query
def trailing_mean_14(spark, sf):
    return _trailing(spark, sf, 14, 5)


@query
def trailing_mean_gaps(spark, sf):
    """Cells lack rows on days on which the source has others."""
    holed = v.pixel_day(spark, sf).where((F.col("lat_idx") + F.col("lon_idx") + F.day("date")) % 3 != 0)
    out = op.trailing_mean(holed, "chl", 7, 3, "mean")
    return rounded(out.select(*KEY, "mean"), "mean")


@query
def trailing_mean_calendar(spark, sf):
    return _trailing(spark, sf, 7, 3, axis="calendar")


@query
def trailing_mean_per_year(spark, sf):
    items = v.sea_day(spark, sf)
    out = op.trailing_mean(items, "chl", 7, 3, "mean", restart_each_year=True)
    return rounded(out.select(*KEY, "mean"), "mean")


@query
def carry_forward(spark, sf):
    out = op.carry_forward(v.pixel_day(spark, sf), ["plane", "chl"])
    return rounded(out.select(*KEY, "plane", "chl", "chl_age_days"), "plane", "chl")


@query
def carry_forward_per_cell(spark, sf):
    out = op.carry_forward(v.pixel_day(spark, sf), ["plane"], per_cell=True)
    return rounded(out.select(*KEY, "plane", "chl_age_days"), "plane")


@query
def align_sources(spark, sf):
    """Sea temperature, a regridded field and effort on one key."""
    sst = v.cell_day(spark, sf).select(*KEY, "sst")
    field = op.regrid_bilinear(v.coarse_field(spark, sf), ["v"], v.COARSE_LAT, v.COARSE_LON, G)
    hours = op.effort_cells(v.month_effort(spark, sf), G).drop("n_vessels")
    return rounded(op.align_sources([sst, field, hours]), "sst", "v", "fishing_hours")


@query
def land_drop(spark, sf):
    return rounded(v.sea_day(spark, sf).select(*KEY, "sst"), "sst")


@query
def bathymetry(spark, sf):
    return rounded(op.seabed(v.soundings(spark, sf), G), "depth", "seabed_roughness", "land_fraction")


@query
def bathymetry_by_spacing(spark, sf):
    """Regions whose pixels nest in the cells and regions whose pixels do not, in one table."""
    static = op.seabed_by_spacing(v.pixel_grid(spark, sf), G)
    return rounded(static, "depth", "seabed_roughness", "land_fraction")


@query
def bathymetry_interpolated(spark, sf):
    """Elevation nodes coarser than the cells."""
    nodes = v.coarse_field(spark, sf).groupBy("region", "lat", "lon").agg(
        (F.min("v") * 10 - 400).alias("elevation")
    )
    out = op.seabed_interpolated(nodes, v.COARSE_LAT, v.COARSE_LON, G)
    return rounded(out, "depth", "land_fraction")


@query
def depth_report(spark, sf):
    return rounded(
        op.depth_report(op.seabed(v.soundings(spark, sf), G), ["region"]),
        "median_depth", "min_depth", "max_depth",
    )


@query
def join_static(spark, sf):
    plane = op.seabed(v.soundings(spark, sf), G)
    out = op.join_static(v.sea_day(spark, sf), plane)
    return rounded(out.select(*KEY, "depth", "land_fraction"), "depth", "land_fraction")


@query
def distance_to_coast(spark, sf):
    return rounded(op.distance_to_coast(v.sea_day(spark, sf), G), "dist_coast_km")


@query
def distance_to_coast_tiled(spark, sf):
    return rounded(op.distance_to_coast_tiled(v.sea_day(spark, sf), G, size=8), "dist_coast_km")


def _fields(plane: DataFrame) -> dict[str, DataFrame]:
    """Gridded daily fields of every source, from a stored `cell_day`."""
    return {
        "sst": plane.select(*KEY, (F.col("sst") + 273.15).alias("analysed_sst")),
        "chl": plane.select(*KEY, F.col("chl").alias("CHL")),
        "wav": plane.select(*KEY, F.col("wave_height_max").alias("VHM0_mean"),
                            F.col("wave_height_max").alias("VHM0_max")),
        "wnd": plane.select(*KEY, (F.col("wind_speed_max") / 2).alias("wind_speed"), "wind_speed_max"),
    }


@query
def feature_table(spark, sf):
    """The whole feature job on one set of gridded daily fields."""
    fields = _fields(settle(v.cell_day(spark, sf)))
    return _table(build_features(fields, G, effort=v.month_effort(spark, sf), wind_in_ms=False))


@query
def feature_table_by_day(spark, sf):
    """The whole feature job on the same fields, stored by day so that the build moves none of them."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = _fields(settle_by_day(v.cell_day(spark, sf).repartition(n, "region", "date"), n))
    return _table(build_features(fields, G, effort=v.month_effort(spark, sf), wind_in_ms=False, buckets=n))


def _table(out: DataFrame) -> DataFrame:
    numbers = ["sst", "sst_gradient", "chl", "chl_lag7", "wave_height", "wave_height_max",
               "wind_speed", "wind_speed_max", "fishing_hours"]
    ints = ["wave_estimated", "month", "fished"]
    return rounded(out.select(
        *KEY, "cell_id", *numbers, "n_vessels", "chl_age_days",
        *[F.col(c).cast("int").alias(c) for c in ints],
    ), *numbers)


@query
def thinned_build(spark, sf):
    """Positives and negatives that a thinning build keeps in every five days of a
    region's year, with sums over their rows."""
    fields = _fields(settle(v.cell_day(spark, sf)))
    out = build_features(fields, G, effort=v.month_effort(spark, sf), wind_in_ms=False, neg_per_pos=1, thin_days=5)
    month = F.month("date")
    return out.groupBy("region", F.year("date").alias("year"), F.floor((month - 1) / 5).alias("chunk")).agg(
        F.count_if(F.col("fished") == 1).alias("positives"), F.count_if(F.col("fished") == 0).alias("negatives"),
        F.count_if(F.col("sst").isNull()).alias("on_land"), F.sum(F.col("n_vessels") * F.col("fished")).alias("vessels"),
    )


@query
def incremental_build(spark, sf):
    """Features built by day, then updated after days of three sources changed."""
    path = scratch(spark, "by_day")
    before = _fields(settle(v.cell_day(spark, sf)))
    effort = v.month_effort(spark, sf)

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("region", F.concat(F.lit("r"), "region"))

    def changed(name: str, column: str, day: str, value) -> DataFrame:
        here = F.col("date") == F.lit(day).cast("date")
        return named(before[name]).withColumn(column, F.when(here, value).otherwise(F.col(column)))

    built = build_features({n: named(df) for n, df in before.items()}, G, effort=named(effort), wind_in_ms=False)
    write_features(built, path, by_day=True)
    after = {
        "sst": changed("sst", "analysed_sst", "1996-03-01", F.col("analysed_sst") + 1), "chl": changed("chl", "CHL", "1997-02-01", F.col("CHL") * 2),
        "wav": changed("wav", "VHM0_max", "1998-09-01", F.col("VHM0_max") / 2), "wnd": named(before["wnd"]),
    }
    days = [("sst", "1996-03-01"), ("chl", "1997-02-01"), ("wav", "1998-09-01")]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.to_date(F.lit(d)).alias("date")) for n, d in days]))
    moved = named(before["sst"].select("region").distinct()).select("region", each.alias("m")).select("region", "m.*")
    update_features(after, moved, G, path, named(effort), wind_in_ms=False)
    numbers = ["sst", "sst_gradient", "chl", "chl_lag7", "wave_height", "wave_height_max"]
    ints = ["lat_idx", "lon_idx", "wave_estimated", "fished", "chl_age_days"]
    back = read_features(spark, path, columns=["date", *ints, *numbers], schema=built.schema, by_day=True)
    return rounded(back.drop("year"), *numbers)


@query
def features_from_readings(spark, sf):
    """The whole feature job from sub-daily readings: daily fields, axes taken
    from the data, regridding, features, labels and seabed."""
    raw = v.node_readings(spark, sf)
    pixel = ["region", "lat", "lon"]
    # Readings are reduced once for all sources.
    stats = settle(op.daily_stats(raw, ["analysed_sst", "CHL", "uo", "vo", "VHM0"], pixel))

    def daily(*names: str) -> DataFrame:
        return stats.select(*pixel, "date", *[F.col(f"{n}_mean").alias(n) for n in names])

    fields = {
        "sst": daily("analysed_sst"), "chl": daily("CHL"), "cur": daily("uo", "vo"),
        "wav": stats.select(*pixel, "date", "VHM0_mean", "VHM0_max"), "wnd": op.daily_wind_components(raw, "east", "north", pixel),
    }
    axes = (op.Axis.of(raw, "lat"), op.Axis.of(raw, "lon"))
    gridded = on_grid(fields, {name: axes for name in fields}, G)
    out = build_features(gridded, G, v.month_effort(spark, sf), op.seabed(v.soundings(spark, sf), G))
    numbers = [
        "lat", "lon", "sst", "sst_model", "sst_gradient", "chl", "chl_lag7", "chl_lag14", "current_speed", "wave_height",
        "wave_height_max", "wind_speed", "wind_speed_max", "month_sin", "month_cos", "fishing_hours", "depth",
        "seabed_roughness", "land_fraction",
    ]
    ints = ["wave_estimated", "month", "fished"]
    return rounded(out.withColumns({c: F.col(c).cast("int") for c in ints}), *numbers)


# --------------------------------------------------------------------- labels

@query
def effort_cells(spark, sf):
    return rounded(op.effort_cells(v.effort(spark, sf), G), "fishing_hours")


@query
def effort_totals(spark, sf):
    return rounded(op.effort_totals(v.effort(spark, sf), G), "hours")


@query
def effort_report(spark, sf):
    return rounded(op.effort_report(v.effort(spark, sf)), "hours", "share_pct")


@query
def flag_share(spark, sf):
    return rounded(op.flag_share(v.effort(spark, sf), "R"), "share_pct")


@query
def join_labels(spark, sf):
    cells = op.effort_cells(v.month_effort(spark, sf), G)
    out = op.join_labels(v.sea_day(spark, sf).select(*KEY), cells)
    return rounded(out, "fishing_hours").withColumn("fished", F.col("fished").cast("int"))


@query
def label_match_report(spark, sf):
    cells = op.effort_cells(v.month_effort(spark, sf), G)
    return rounded(
        op.label_match_report(v.sea_day(spark, sf), cells, by=["region"]), "match_rate"
    )


@query
def build_report(spark, sf):
    return rounded(op.build_report(v.cell_day(spark, sf)), "positive_rate")


# ------------------------------------------------------ confound and baselines

@query
def fleet_active_months(spark, sf):
    return op.fleet_active_months(v.sea_day(spark, sf))


@query
def fleet_active_months_dormant(spark, sf):
    """Two months without any label are found dormant."""
    quiet = F.month("date").isin(2, 11)
    labels = v.sea_day(spark, sf).withColumn(
        "fished", F.when(quiet, 0).otherwise(F.col("fished"))
    )
    return op.fleet_active_months(labels)


@query
def fleet_active_months_uniform(spark, sf):
    """The same rate all year falls back to the known dormant months."""
    labels = v.sea_day(spark, sf).withColumn("fished", F.lit(1))
    return op.fleet_active_months(labels)


@query
def active_rows(spark, sf):
    quiet = F.month("date").isin(2, 11)
    labels = v.sea_day(spark, sf).withColumn(
        "fished", F.when(quiet, 0).otherwise(F.col("fished"))
    )
    return op.keep_months(labels, op.fleet_active_months(labels)).select(*KEY, "fished")


@query
def seasonal_profile(spark, sf):
    return rounded(
        op.seasonal_profile(v.sea_day(spark, sf)),
        "label_rate", "mean_wave", "mean_chl", "label_chl_corr",
    )


@query
def climatology(spark, sf):
    train, test = op.temporal_split(v.sea_day(spark, sf).select(*KEY, "fished"), 1999)
    return rounded(op.climatology(train, test), "climatology")


# --------------------------------------------------------- sampling and splits

@query
def temporal_split(spark, sf):
    train, test = op.temporal_split(v.sea_day(spark, sf).select(*KEY), 1999)
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


@query
def calibration_split(spark, sf):
    train, _ = op.temporal_split(v.sea_day(spark, sf).select(*KEY, "fished"), 1999)
    core, held = op.calibration_split(train)
    return core.withColumn("part", F.lit("core")).unionByName(
        held.withColumn("part", F.lit("calibration"))
    )


def _with_position(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": G.lat(F.col("lat_idx")), "lon": G.lon(F.col("lon_idx"))})


@query
def exclude_box(spark, sf):
    box = Grid("cut", 1.45, 2.25, 44.5, 45.25)
    return op.exclude_box(_with_position(v.sea_day(spark, sf).select(*KEY)), box)


@query
def holdout_band(spark, sf):
    outside, inside = op.holdout_band(_with_position(v.sea_day(spark, sf).select(*KEY)))
    return outside.withColumn("held", F.lit(False)).unionByName(
        inside.withColumn("held", F.lit(True))
    )


def _label_counts(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(F.col("fished") == 1).alias("pos"),
        F.count_if(F.col("fished") == 0).alias("neg"),
    )


@query
def subsample_negatives(spark, sf):
    """Kept rows per half month of order lines, three negatives a positive."""
    rows = _sampling_rows(spark, sf)
    kept = op.subsample_negatives(
        rows, 3, op.period_chunks(15), label="fished", key=["l_orderkey", "l_linenumber", "l_partkey"]
    )
    return _label_counts(kept, op.period_chunks(15).alias("chunk"))


def _sampling_rows(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_shipdate").cast("date").alias("date"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), 1)
        .otherwise(0).alias("fished"),
    )


@query
def thin_training_years(spark, sf):
    kept = op.thin_training_years(
        _sampling_rows(spark, sf), 20, 1999, key=["l_orderkey", "l_linenumber", "l_partkey"]
    )
    return _label_counts(kept, F.year("date").alias("year"))


@query
def thin_whole(spark, sf):
    """Two negatives a positive over all rows, none without positives."""
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    return _label_counts(op.subsample_negatives(_sampling_rows(spark, sf), 2, floor_one=False, key=key))


@query
def row_cap(spark, sf):
    kept = op.cap_rows(v.sea_day(spark, sf), 10_000)
    return _label_counts(kept)


# ----------------------------------------------------------------- evaluation

@query
def eval_pooled(spark, sf):
    return op.evaluate(v.scored_items(spark, sf), "fished", "score", "price")


@query
def eval_by_region(spark, sf):
    m = op.ranking_metrics(v.scored_items(spark, sf), "fished", "score", ["region"])
    return rounded(m, "base_rate", "roc_auc", "average_precision")


@query
def eval_within_month(spark, sf):
    return op.evaluate_within(v.scored_items(spark, sf), "fished", "score", "price")


@query
def eval_split_ranges(spark, sf):
    """The same metrics with the scores cut into many small ranges."""
    m = op.ranking_metrics(
        v.scored_items(spark, sf), "fished", "score", ["month"], scores_per_range=2_000
    )
    return rounded(m, "base_rate", "roc_auc", "average_precision")


@query
def eval_null_group(spark, sf):
    """Rows without a group are a group; rows without a label do not count."""
    month = F.col("month")
    items = v.scored_items(spark, sf).withColumns({
        "month": F.when(month != 7, month), "fished": F.when(month != 3, F.col("fished")),
    })
    return rounded(op.ranking_metrics(items, "fished", "score", ["month"]), "base_rate", "roc_auc", "average_precision")


@query
def eval_documents(spark, sf):
    """Quality labels ranked by document length, per language."""
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    scored = v.table(spark, sf, "labels").join(docs, "doc_id")
    return op.evaluate_within(scored, "quality", "n_chars", "length", group="lang")


@query
def eval_physics_index(spark, sf):
    scored = v.scored_day(spark, sf).withColumn("month", F.month("date"))
    return op.evaluate(scored, "fished", "score", "physics_index")


@query
def baseline_comparison(spark, sf):
    """Climatology against the physics index on later years, and the gate."""
    train, test = op.temporal_split(v.scored_day(spark, sf).withColumn("month", F.month("date")), 1999)
    scored = op.climatology(train, test.withColumnRenamed("score", "physics_index"))
    metrics = op.compare_models(scored, ["climatology", "physics_index"])
    gate = op.validation_gate(metrics, "climatology", ["physics_index"]).select("beats_baselines")
    return metrics.withColumn("beats_baselines", gate.scalar())


# ------------------------------------------------------------ index and zones

@query
def pct_rank(spark, sf):
    out = v.sea_day(spark, sf).withColumn("pct", op.pct_rank("chl"))
    return rounded(out.select(*KEY, "pct"), "pct")


@query
def pct_rank_ranged(spark, sf):
    out = op.pct_rank_ranged(v.sea_day(spark, sf), "chl", "pct", per_range=1000)
    return rounded(out.select(*KEY, "pct"), "pct")


@query
def pct_rank_whole(spark, sf):
    """All cells and days together are one group."""
    out = op.pct_rank_ranged(v.sea_day(spark, sf), "chl", "pct", by=[], per_range=1000)
    return rounded(out.select(*KEY, "pct"), "pct")


@query
def physics_index_ranged(spark, sf):
    fronts = op.sst_gradient_tiled(v.cell_day(spark, sf), G, size=8)
    out = op.physics_index_ranged(op.drop_land(fronts), out="score", per_range=1000)
    return out.select(*KEY, "score")


@query
def physics_index(spark, sf):
    return v.scored_day(spark, sf).select(*KEY, "score")


@query
def safety_summary(spark, sf):
    return op.with_status_text(op.safety_summary(op.classify(v.sea_day(spark, sf))))


@query
def nearest_site(spark, sf):
    cells = v.sea_day(spark, sf).select("region", "lat_idx", "lon_idx").distinct()
    site = fn.nearest_site(G.lat(F.col("lat_idx")), G.lon(F.col("lon_idx")))
    return cells.withColumn("s", site).select(
        "region", "lat_idx", "lon_idx", "s.site_id", r6("s.site_km").alias("site_km")
    )


ZONED = ["dist_coast_km", "site_id", "site_km", "reachable", "band", "band_so", "zone_id"]


@query
def assign_zones(spark, sf):
    out = op.assign_zones(v.sea_day(spark, sf).select(*KEY), G).select(*KEY, *ZONED)
    return rounded(out, "dist_coast_km", "site_km")


@query
def assign_zones_per_day(spark, sf):
    out = op.assign_zones(v.sea_day(spark, sf).select(*KEY), G, per_day=True).select(*KEY, *ZONED)
    return rounded(out, "dist_coast_km", "site_km")


def _zones(spark, sf):
    zoned = op.assign_zones(v.scored_day(spark, sf), G)
    return op.zone_summary(zoned, G, "score", "physics_index")


@query
def zone_summary(spark, sf):
    return _zones(spark, sf).select(
        "region", "date", "zone_id", "name_so", "name_en", "band_km", "n_cells",
        F.col("site.id").alias("site_id"),
        F.col("centre.lat").alias("centre_lat"), F.col("centre.lon").alias("centre_lon"),
        "bounds.lat_min", "bounds.lat_max", "bounds.lon_min", "bounds.lon_max",
        "distance_km", "travel_hours", "score", "score_source", "safety",
        "share_dangerous", "conditions.*",
    )


@query
def rank_zones(spark, sf):
    return op.rank_zones(_zones(spark, sf)).select(
        "region", "date", "rank", "zone_id", "safety", "score", F.col("rating.level").alias("level")
    )


@query
def top_zones(spark, sf):
    return op.rank_zones(_zones(spark, sf), top_n=3).select("region", "date", "rank", "zone_id")


# -------------------------------------------------------------------- serving

@query
def latest_day(spark, sf):
    day = op.select_days(v.sea_day(spark, sf).select(*KEY, "sst"), by=["region"])
    return rounded(day, "sst")


@query
def given_day(spark, sf):
    return rounded(op.select_days(v.sea_day(spark, sf).select(*KEY, "sst"), "1998-03-01"), "sst")


@query
def latest_or_fallback(spark, sf):
    """No live day after the cut, so the fallback answers, marked stale."""
    days = v.sea_day(spark, sf).select(*KEY)
    live = days.where(F.col("date") > "2030-01-01")
    return op.latest_or_fallback(live, days)


@query
def latest_live(spark, sf):
    days = v.sea_day(spark, sf).select(*KEY)
    return op.latest_or_fallback(days, days.where(F.col("date") < "1996-01-01"))


def _points(spark, sf) -> DataFrame:
    return v.table(spark, sf, "lineitem").select(
        F.expr(f"l_orderkey div {v.BLOCK}").alias("region"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id"),
        (F.col("l_partkey") * 7 % 2600 + 0.31).alias("a"),
        (F.col("l_suppkey") * 11 % 2600 + 0.17).alias("b"),
    ).groupBy("region", "point_id").agg(
        (F.min("a") / 1000 + 0.8).alias("lat"), (F.min("b") / 1000 + 43.8).alias("lon")
    )


@query
def lookup_points(spark, sf):
    """Each order line asks for the sea next to it on the newest day."""
    day = op.select_days(op.classify(v.sea_day(spark, sf)), by=["region"])
    found = op.lookup_points(_points(spark, sf), day, G, carry=["safety", "sst"])
    return rounded(found.drop("cell_lat", "cell_lon"), "distance_deg", "sst")


@query
def point_answers(spark, sf):
    """The whole answer for each order line's point on its region's newest day."""
    day = op.select_days(op.classify(v.scored_day(spark, sf)), by=["region"]).withColumn("score_source", F.lit("physics_index"))
    found = op.point_answers(_points(spark, sf), day, G)
    return found.select(
        "region", "point_id", "date", "lat", "lon", "safety.status", F.col("safety.label.so").alias("label_so"),
        F.col("safety.label.en").alias("label_en"), "safety.label.color", F.col("safety.advice.so").alias("advice_so"),
        F.col("safety.advice.en").alias("advice_en"), "conditions.*", "fishing_potential", "model.trained", "model.score_source",
    )


@query
def catalog_status(spark, sf):
    status = op.catalog_status(v.sea_day(spark, sf), by=["region"])
    return status.withColumn("days", F.concat_ws(",", F.col("days").cast("array<string>")))


def _payload(spark, sf):
    filled = op.fill_nearest(v.cell_day(spark, sf), "wave_height_max", G, flag="wave_estimated")
    return score_days(op.drop_land(op.sst_gradient(filled, G)), G).payload


@query
def daily_payload(spark, sf):
    """The daily documents as written to disk, read back with their schema."""
    payload = _payload(spark, sf)
    text = payload.select(F.to_json(F.struct("*")).alias("document"))
    d = text.select(F.from_json("document", payload.schema.simpleString()).alias("d")).select("d.*")

    def listed(state: str):
        return F.size(F.filter("cells.safety", lambda x: x == state)).cast("long")

    def total(column: str, unit: int):
        add = lambda acc, x: acc + F.coalesce(F.rint(x * unit).cast("long"), F.lit(0).cast("long"))
        return F.aggregate(f"cells.{column}", F.lit(0).cast("long"), add).alias(f"{column}_total")

    return d.select(
        "region", "date", "n_cells", F.size("cells.lat_idx").cast("long").alias("n_listed"),
        "safety.status", "safety.counts.*", "safety.share_dangerous", "safety.total",
        F.col("safety.label.so").alias("label_so"), F.col("safety.label.en").alias("label_en"),
        F.col("safety.advice.so").alias("advice_so"), F.col("safety.advice.en").alias("advice_en"), "safety.label.color",
        listed("KHATAR").alias("listed_danger"), listed("LAMA_OGA").alias("listed_unknown"),
        total("sst", 10), total("chl", 1000), total("wave_height_max", 100), total("score", 10),
        "grid.n_lat", "grid.n_lon", "grid.resolution",
        "thresholds.wave_safe_m", "thresholds.wave_danger_m", "thresholds.wind_safe_kmh", "thresholds.wind_danger_kmh",
        "reach.n_reachable_cells", "reach.n_cells_total", "model.trained", "model.score_source",
        F.size("zones").cast("long").alias("n_zones"),
        F.aggregate("zones", F.lit(0).cast("long"), lambda acc, z: acc + z["n_cells"]).alias("cells_in_zones"),
    )


@query
def daily_payload_cells(spark, sf):
    """The parallel arrays of the daily documents, zipped back into rows."""
    c = "cells"
    names = ["lat_idx", "lon_idx", "lat", "lon", "safety", "sst", "chl", "wave_height_max",
             "wind_speed_max", "wave_estimated", "score", "reachable", "dist_coast_km"]
    zipped = F.arrays_zip(*[F.col(f"{c}.{n}").alias(n) for n in names])
    return _payload(spark, sf).select(
        "region", "date", F.posexplode(zipped).alias("place", "row")
    ).select("region", "date", "place", "row.*")


@query
def daily_payload_headline(spark, sf):
    return _payload(spark, sf).select(
        "region", "date", "n_cells", F.col("safety.status").alias("status"),
        F.col("safety.share_dangerous").alias("share_dangerous"),
        F.size("zones").cast("long").alias("n_zones"),
        F.col("reach.n_reachable_cells").alias("n_reachable"),
        F.col("data_quality.wave_estimated_share").alias("wave_estimated_share"),
        F.col("model.score_source").alias("score_source"),
        F.col("zones")[0]["zone_id"].alias("first_zone"),
    )


@query
def daily_payload_zones(spark, sf):
    """The ranked zones listed in the daily documents."""
    zones = _payload(spark, sf).select("region", "date", F.explode("zones").alias("z"))
    return zones.select(
        "region", "date", "z.rank", "z.zone_id", "z.name_so", "z.name_en", "z.n_cells", "z.score",
        "z.safety", "z.distance_km", "z.wave_estimated_share", F.col("z.rating.level").alias("level"),
    )


@query
def daily_files(spark, sf):
    """Daily documents written out; the newest day of each region read back."""
    path = scratch(spark, "daily")
    write_daily(_payload(spark, sf).withColumn("region", F.concat(F.lit("r"), "region")), path)
    doc = "region string, date string, n_cells long, cells struct<lat_idx: array<int>, sst: array<double>>"
    latest = spark.read.text(f"{path}/latest").select(F.from_json("value", doc).alias("d")).select("d.*")
    return latest.select(
        "region", F.col("date").cast("date").alias("date"), "n_cells",
        F.size("cells.lat_idx").cast("long").alias("n_listed"),
    )


# --------------------------------------------------------------------- models

def _model_table(spark, sf) -> DataFrame:
    """Feature rows for the models, written once and read by every fit."""
    fronts = settle(op.sst_gradient(v.cell_day(spark, sf), G))
    lagged = op.trailing_mean(op.trailing_mean(fronts, "chl", 7, 3, "chl_lag7"), "chl", 14, 5, "chl_lag14")
    ages = op.observed_days(fronts, "chl").select("region", "date", F.col("age_days").alias("chl_age_days"))
    lagged = op.drop_land(lagged).join(ages, ["region", "date"]).withColumn(
        "current_speed", fn.speed(F.col("wind_speed_max") / 20, F.col("wave_height_max") / 4)
    )
    rows = op.join_static(lagged, op.seabed(v.soundings(spark, sf), G))
    # The cells of these rows, without the means and joins in between.
    cells = op.drop_land(fronts).dropna(subset=["region", "date"])
    rows = op.join_static(rows, op.distance_to_coast(cells, G))
    return settle(_with_position(rows).withColumns(fn.cyclic_month(F.col("date"))))


MODEL_FEATURES = FEATURES
ROUNDS = 10


def _fitted(spark, sf):
    train, test = op.temporal_split(_model_table(spark, sf), 1999)
    return op.fit_hotspot(train, MODEL_FEATURES, rounds=ROUNDS, depth=4, step=0.1), train, test


TRAINED = ("hotspot", "depth_only", "transfer", "control")


def _followed(metrics: DataFrame) -> DataFrame:
    """Metrics of the baselines as they are; of trained models, which no SQL can
    follow, whether they lie in their range."""
    shares = [c for c in ("roc_auc", "pr_auc", "pr_auc_within_month") if c in metrics.columns]
    hidden = [c for c in (*shares, "pr_lift", "lift_within_month") if c in metrics.columns]
    ok = F.lit(True)
    for c in shares:
        ok = ok & F.col(c).between(0, 1)
    trained = F.col("model").isin(*TRAINED)
    return metrics.withColumn("in_range", ok).withColumns({c: F.when(~trained, F.col(c)) for c in hidden})


def _gate_agrees(metrics: DataFrame, gate: DataFrame):
    """Do the gate's flags follow from the metric rows?"""
    ap = {
        m: metrics.where(F.col("model") == m).select("pr_auc_within_month").scalar()
        for m in ("hotspot", "depth_only", "climatology")
    }
    beats = {m: F.coalesce(ap["hotspot"] > ap[m], F.lit(False)) for m in ("depth_only", "climatology")}
    agrees = gate.select("beats_baselines").scalar() == (beats["depth_only"] & beats["climatology"])
    for m, flag in beats.items():
        agrees = agrees & (gate.select(f"beats_{m}").scalar() == flag)
    return agrees


@query
def depth_only_baseline(spark, sf):
    """Test rows with their label; a cell's seabed gives it one score all year."""
    train, test = op.temporal_split(_model_table(spark, sf), 1999)
    scored = settle(op.depth_only(train, test, rounds=ROUNDS))
    cells = scored.groupBy("region", "lat_idx", "lon_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fished").alias("positives"),
        (F.min("depth_only") == F.max("depth_only")).alias("one_score"),
        F.bool_and(F.col("depth_only").between(0, 1)).alias("in_range"),
    )
    return cells


@query
def hotspot_gbt(spark, sf):
    """Test rows with their label, and whether the score is a probability."""
    model, _, test = _fitted(spark, sf)
    return op.predict(model, test).select(*KEY, "fished", F.col("probability").between(0, 1).alias("in_range"))


@query
def isotonic_calibration(spark, sf):
    """Per month: rows, positives, and whether the calibrated probability never
    falls as the raw one rises."""
    model, _, test = _fitted(spark, sf)
    raw = vector_to_array("_probability")[1]
    # At most a thousand steps a month are put in order.
    steps = model.transform(test).groupBy(F.month("date").alias("month"), F.floor(raw * 1000).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("fished").alias("positives"),
        F.min("_calibrated").alias("low"), F.max("_calibrated").alias("high"),
    )
    before = F.lag("high").over(Window.partitionBy("month").orderBy("step"))
    steps = steps.withColumn("rises", F.coalesce(before <= F.col("low") + 1e-12, F.lit(True)))
    return steps.groupBy("month").agg(
        F.sum("n").alias("n"), F.sum("positives").alias("positives"), F.bool_and("rises").alias("monotone")
    )


@query
def feature_importance(spark, sf):
    """Every feature with the training rows that know it; shares of the gain
    add up to one."""
    model, train, _ = _fitted(spark, sf)
    shares = op.feature_importance(model, MODEL_FEATURES)
    known = train.agg(*[F.count(f).alias(f) for f in MODEL_FEATURES]).unpivot([], MODEL_FEATURES, "feature", "known")
    total = shares.agg(F.sum("gain_share")).scalar()
    return shares.join(known, "feature").select(
        "feature", "known", F.col("gain_share").between(0, 1).alias("in_range"),
        (F.abs(total - 1) < 0.001).alias("adds_up"),
    )


@query
def validation_gate(spark, sf):
    """Within-month metrics of the baselines, and a gate that follows from all."""
    model, train, test = _fitted(spark, sf)
    scored = op.climatology(train, op.physics_index(op.predict(model, test, "hotspot")))
    scored = settle(op.depth_only(train, scored, rounds=ROUNDS))
    metrics = settle(op.compare_models(scored, ["hotspot", "depth_only", "climatology", "physics_index"]))
    return _followed(metrics).withColumn("gate_agrees", _gate_agrees(metrics, op.validation_gate(metrics)))


@query
def validate_models(spark, sf):
    """The whole validation: months with the fleet present, split, models,
    baselines, metrics and gate. Two months have no labels here."""
    quiet = F.month("date").isin(2, 11)
    rows = _model_table(spark, sf).withColumn("fished", F.when(quiet, 0).otherwise(F.col("fished")))
    out = validate(rows, MODEL_FEATURES, neg_per_pos=None, end_year=1999, rounds=ROUNDS)
    metrics = _followed(out.within.join(out.pooled, "model"))
    return metrics.withColumn("gate_agrees", _gate_agrees(out.within, out.gate))


@query
def gated_score(spark, sf):
    """A model that has not passed validation is not used, nor is any on a day
    that lacks one of its features; both halves come out of one model."""
    model, _, test = _fitted(spark, sf)
    kept = op.score_cells(test, model, MODEL_FEATURES, allow_unvalidated=True)
    gated = op.score_cells(test, model, MODEL_FEATURES, validated=False)
    modelled = F.col("score_source") == "model"

    def shown(df: DataFrame, allowed: bool) -> DataFrame:
        return df.select(
            *KEY, F.lit(allowed).alias("allowed"), "score_source", F.when(~modelled, F.col("score")).alias("score"),
            F.when(modelled, F.coalesce(F.col("score").between(0, 100), F.lit(False))).otherwise(True).alias("in_range"),
        )

    return shown(kept, True).unionByName(shown(gated, False))


@query
def gated_score_absent_source(spark, sf):
    """Without currents no day has all features, so the index scores them all,
    whatever the gate says."""
    model, _, test = _fitted(spark, sf)
    lacking = test.withColumn("current_speed", F.lit(None).cast("double"))
    return op.score_cells(lacking, model, MODEL_FEATURES, validated=True).select(*KEY, "score", "score_source")


@query
def spatial_transfer(spark, sf):
    train, test = op.temporal_split(_model_table(spark, sf), 1999)
    features = feature_set("transfer")
    return _followed(op.spatial_transfer(train, test, features, rounds=5)).drop("beats_climatology", "beats_control")


@query
def box_transfer(spark, sf):
    """Trained on the water around a box, tested inside, with a local control,
    in the months not known as dormant."""
    box = Grid("box", 1.4, 2.4, 44.6, 45.4)
    train, test = op.temporal_split(_model_table(spark, sf), 1999)
    inside = box.in_box(F.col("lat"), F.col("lon"))
    features = feature_set("transfer")
    out = op.spatial_transfer(
        train, test.where(inside), features, box, control=train.where(inside)
    )
    shown = ~F.col("model").isin(*TRAINED)
    return _followed(out.withColumn("beats_climatology", F.when(shown, F.col("beats_climatology")))).drop("beats_control")


# Models small enough for SQL to follow: each tree splits once, on features with few values.

STUMP_FEATURES = ("month_no", "warmth")


def _stumps(spark, sf):
    """Four rounds on all rows and features, cut by average precision, and calibrated."""
    rows = op.drop_land(v.cell_day(spark, sf)).withColumns({
        "month_no": F.month("date").cast("double"), "warmth": F.floor("sst").cast("double"),
    })
    train, test = op.temporal_split(settle(rows.select(*KEY, "fished", *STUMP_FEATURES)), 1999)
    return op.fit_hotspot(train, STUMP_FEATURES, rounds=4, depth=1, step=0.5, sample=1.0, columns=1.0), train, test


@query
def boosted_stumps(spark, sf):
    """The trees kept: what each splits on, what that gains, and both leaves."""
    model, _, _ = _stumps(spark, sf)
    nodes = boosting.node_table(boosting.stored(model.stages[-2]))

    def of(node: int, value: str):
        return F.max(F.when(F.col("node") == node, F.col(value)))

    trees = nodes.groupBy((F.col("tree") + 1).alias("round"), "tree_weight").agg(
        F.element_at(F.lit(list(STUMP_FEATURES)), of(0, "feature") + 1).alias("feature"), of(0, "threshold").alias("threshold"),
        (of(0, "gain") * of(0, "rows")).alias("gain"), of(1, "value").alias("left_value"), of(2, "value").alias("right_value"),
    )
    return rounded(trees, "gain", "left_value", "right_value")


@query
def stump_importance(spark, sf):
    """Share of each feature in the mean gains of its splits."""
    return op.feature_importance(_stumps(spark, sf)[0], STUMP_FEATURES)


@query
def calibrated_stumps(spark, sf):
    """Calibrated probabilities of the test rows, by what the trees see."""
    model, _, test = _stumps(spark, sf)
    scored = op.predict(model, test).groupBy(*STUMP_FEATURES, "probability").agg(F.count(F.lit(1)).alias("n"))
    return rounded(scored, "probability")


@query
def stored_notes(spark, sf):
    """A validated model written with its notes and read back: metrics, gate and
    features as stored, and whether the model read scores like the one written."""
    model, train, test = _stumps(spark, sf)
    scored = settle(op.climatology(train, op.predict(model, test, "hotspot")).withColumn("month", F.month("date")))
    metrics = settle(op.compare_models(scored, ["hotspot", "climatology"]))
    gate = op.validation_gate(metrics, "hotspot", ["climatology"])
    path = scratch(spark, "model")
    save_model(model, gate.withColumn("features", F.lit(list(STUMP_FEATURES))), metrics, path, dt.datetime(2026, 1, 2, 3))
    back = load_model(spark, path)
    again = op.predict(back.model, scored, "again").agg(F.max(F.abs(F.col("again") - F.col("hotspot")))).scalar() < 1e-12
    lines = spark.read.json(f"{path}/notes").select(F.explode("metrics").alias("m"), "beats_climatology", F.array_join("features", ",").alias("features"))
    return lines.select("m.*", "beats_climatology", "features", F.lit(back.validated).alias("validated"), again.alias("scores_alike"))


@query
def isotonic_fit(spark, sf):
    """Share of fished rows as a non-decreasing function of the physics index."""
    rows = settle(v.scored_day(spark, sf).select("score", "fished").where("score is not null"))
    points = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("fished").alias("positives"))
    fitted = op.fit_isotonic(rows, "score", "fished").transform(points)
    return rounded(fitted.withColumnRenamed("prediction", "fitted"), "fitted").select("score", "n", "positives", "fitted")


# ------------------------------------------------------------------ streaming

@query
def stream_daily_stats(spark, sf):
    """The daily reduction of the event stream, all available files."""
    schema = v.table(spark, sf, "events").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .select(F.col("ts").alias("time"), "user_id", "value")
    )
    base = scratch(spark, "stream")
    run_daily(
        daily_updates(stream, ["value"], ["user_id"]), f"{base}/out", f"{base}/state"
    ).awaitTermination()
    daily = read_merged(spark.read.parquet(f"{base}/out"), ["date", "user_id"])
    return rounded(daily, "value_mean", "value_max")


def _late_log(spark, sf) -> streaming.DailyLog:
    """The event stream in three micro-batches, merged in between. The second and
    the third hold readings of all days, most of them days behind the first."""
    base = scratch(spark, "late")
    log = streaming.DailyLog(f"{base}/log", ("value", "u"), ("user_id",))
    readings = v.readings(spark, sf).withColumn("part", F.expr("(user_id + day(time)) % 5"))
    for parts in ((0, 1, 2), (3,), (4,)):
        readings.where(F.col("part").isin(*parts)).drop("part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(readings.drop("part").schema).parquet(f"{base}/in")
        streaming.run_log(stream, log, f"{base}/state").awaitTermination()
        streaming.compact(spark, log, 2)
    return log


@query
def stream_late_readings(spark, sf):
    """Days and pixels from a stream with late readings, which all count."""
    log = _late_log(spark, sf)
    return rounded(streaming.daily(spark, log), "value_mean", "value_max", "u_mean", "u_max")


@query
def stream_lateness(spark, sf):
    """Readings and late readings of each day."""
    return streaming.lateness(spark, _late_log(spark, sf))


@query
def stream_safety(spark, sf):
    """Sea state of the days of a stream: values as waves, components as wind."""
    daily = streaming.daily(spark, _late_log(spark, sf))
    waves = daily.withColumns({"wave": F.when(F.day("date") % 7 != 0, F.col("value_max") / 250), "wind": F.col("u_max") / 8})
    return streaming.safety_updates(waves, "wave", "wind").select("date", "user_id", "safety")
