"""Ocean-shaped views of the supplied tables.

The tables hold no ocean data, so each view reads one as if it did: a part is
a row of the grid, a supplier a column, a month a day, a price a pigment
reading. Every view runs over its whole table, and `region` counts blocks of
15,000 orders, so the number of grids, and with it the work of every operator,
grows with the data while each grid stays densely filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.grid import Grid
from seagrid.operators import Axis, physics_index, sst_gradient
from seagrid.operators.align import drop_land

BLOCK = 15_000
GRID = Grid("block", 1.0, 3.0, 44.0, 46.0)
COARSE_LAT = Axis.regular(1.0, 0.2, 10)
COARSE_LON = Axis.regular(44.0, 0.2, 10)
# Pixels of the event stream: 150 users form a 10 x 15 grid.
PIXEL_GRID = Grid("pixels", 1.0, 2.0, 44.0, 45.5)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def whole(x: Column, unit: int = 1) -> Column:
    """A number with few decimals as a whole number of 1/unit."""
    return F.rint(x * unit).cast("long")


def cell_day(spark: SparkSession, sf: str) -> DataFrame:
    """The dense plane of each block and month, land included (no sst there)."""
    items = table(spark, sf, "lineitem").select(
        F.expr(f"l_orderkey div {BLOCK}").alias("region"),
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("date"),
        (F.col("l_partkey") % 20).cast("int").alias("lat_idx"),
        (F.col("l_suppkey") % 20).cast("int").alias("lon_idx"),
        whole(F.col("l_quantity")).alias("q"),
        whole(F.col("l_extendedprice"), 100).alias("p"),
        whole(F.col("l_discount"), 100).alias("d"),
        whole(F.col("l_tax"), 100).alias("t"),
        F.col("l_returnflag").alias("f"),
    )
    i, j = F.col("lat_idx"), F.col("lon_idx")
    return (
        items.groupBy("region", "date", "lat_idx", "lon_idx")
        .agg(
            F.sum("q").alias("q"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"),
            F.max("d").alias("d"), F.max("t").alias("t"),
            F.max(F.when((F.col("f") == "R") & (F.col("q") > 40), 1).otherwise(0)).alias("fished"),
        )
        .select(
            "region", "date", "lat_idx", "lon_idx",
            F.when(i <= j + 3, F.col("q").cast("double") / (F.col("n") * 5) + 22).alias("sst"),
            F.when(
                (i * 7 + j * 3 + F.month("date")) % 5 != 0,
                F.col("p").cast("double") / (F.col("n") * 10_000_000),
            ).alias("chl"),
            F.when((i + j) % 6 != 0, (F.col("d") * 25).cast("double") / 100).alias("wave_height_max"),
            ((F.col("t") * 45).cast("double") / 10).alias("wind_speed_max"),
            "fished",
        )
    )


def sea_day(spark: SparkSession, sf: str) -> DataFrame:
    """Ocean rows of `cell_day`."""
    return drop_land(cell_day(spark, sf))


def scored_day(spark: SparkSession, sf: str) -> DataFrame:
    """Ocean rows with front strength and the physics index as score."""
    fronts = drop_land(sst_gradient(cell_day(spark, sf), GRID))
    return physics_index(fronts, out="score")


def pixel_day(spark: SparkSession, sf: str) -> DataFrame:
    """Daily pigment series of each pixel. `chl` has scattered gaps, `plane` is
    seen on a few days only."""
    user = F.col("user_id")
    daily = (
        table(spark, sf, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("date"))
        .agg(F.sum(whole(F.col("value"), 100)).alias("v"), F.count(F.lit(1)).alias("n"))
        .select(
            F.expr("user_id div 150").alias("region"),
            "date",
            F.expr("(user_id % 150) div 15").cast("int").alias("lat_idx"),
            (user % 15).cast("int").alias("lon_idx"),
            (F.col("v").cast("double") / (F.col("n") * 100)).alias("value"),
        )
    )
    day = F.day("date")
    gap = (F.col("lat_idx") * 3 + F.col("lon_idx") + day) % 4 == 0
    return daily.withColumns({
        "chl": F.when(~gap, F.col("value")),
        "plane": F.when(~gap & (day.between(3, 6) | (day == 30)), F.col("value")),
    })


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-daily readings with two components."""
    return table(spark, sf, "events").select(
        F.col("ts").alias("time"), "user_id",
        (F.col("value") - 250).alias("u"),
        (F.length("event_type") * 60.0 - F.lit(330.0)).alias("v"),
        "value",
    )


def effort(spark: SparkSession, sf: str) -> DataFrame:
    """Vessel-days at cell edges; two rows of cells lie outside the grid."""
    return table(spark, sf, "lineitem").select(
        F.expr(f"l_orderkey div {BLOCK}").alias("region"),
        F.col("l_shipdate").cast("date").alias("date"),
        ((F.col("l_partkey") % 22) * 0.1 + 1.0).alias("lat"),
        ((F.col("l_suppkey") % 20) * 0.1 + 44.0).alias("lon"),
        (F.col("l_quantity") / 10).alias("hours"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"),
        F.col("l_linestatus").alias("geartype"),
    )


def month_effort(spark: SparkSession, sf: str) -> DataFrame:
    """Effort moved to the first of its month, to meet `cell_day`."""
    return effort(spark, sf).withColumn("date", F.trunc("date", "month"))


def soundings(spark: SparkSession, sf: str) -> DataFrame:
    """Elevation pixels inside the cells, high ground on the land side."""
    i, j = F.col("l_partkey") % 20, F.col("l_suppkey") % 20
    return table(spark, sf, "lineitem").select(
        F.expr(f"l_orderkey div {BLOCK}").alias("region"),
        (i * 0.1 + 1.0 + (F.col("l_linenumber") - 0.5) / 80).alias("lat"),
        (j * 0.1 + 44.0 + (F.col("l_quantity") - 0.5) / 500).alias("lon"),
        (whole(F.col("l_extendedprice") / 25) - 3900
         + F.when(i > j + 3, 4000).otherwise(0)).alias("elevation"),
    )


def pixel_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Elevation on regular axes: pixels of a quarter cell in even regions, which
    nest in the cells, and of seven tenths of a cell in odd ones, which do not."""
    odd = F.col("region") % 2 == 1
    n, step = F.when(odd, 30).otherwise(80), F.when(odd, 0.07).otherwise(0.025)
    i, j = F.col("p") % n, F.col("s") % n
    lines = table(spark, sf, "lineitem").select(
        F.expr(f"2 * (l_orderkey div {BLOCK}) + l_linenumber % 2").alias("region"), F.col("l_partkey").alias("p"), whole(F.col("l_extendedprice")).alias("s"),
        whole(F.col("l_extendedprice") / 25).alias("e"),
    )
    start = F.when(odd, 1.0).otherwise(1.0125)
    return lines.groupBy("region", i.cast("int").alias("i"), j.cast("int").alias("j")).agg((F.min("e") - 1800).alias("elevation")).select(
        "region", "i", "j", F.round(start + F.col("i") * step, 9).alias("lat"), F.round(start + 43 + F.col("j") * step, 9).alias("lon"), "elevation")


def coarse_field(spark: SparkSession, sf: str) -> DataFrame:
    """A field on a 0.2 degree grid with missing nodes, one plane a month."""
    i, j = F.col("o_custkey") % 10, F.col("o_orderkey") % 10
    return (
        table(spark, sf, "orders")
        .groupBy(
            F.expr(f"o_orderkey div {BLOCK}").alias("region"),
            F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"),
            i.alias("i"), j.alias("j"),
        )
        .agg(F.sum(whole(F.col("o_totalprice"), 100)).alias("p"), F.count(F.lit(1)).alias("n"))
        .select(
            "region", "date",
            (F.col("i") * 0.2 + 1.0).alias("lat"), (F.col("j") * 0.2 + 44.0).alias("lon"),
            F.when(
                (F.col("i") + F.col("j") + F.month("date")) % 7 != 0,
                F.col("p").cast("double") / (F.col("n") * 99_991),
            ).alias("v"),
        )
    )


def node_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of every source at the nodes of a 0.2 degree grid, several a day
    and node. Factors of many digits keep results off the ties of rounding."""
    i, j = F.col("l_partkey") % 10, F.col("l_suppkey") % 10
    month = F.trunc(F.col("l_shipdate").cast("date"), "month")
    q, line = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    return table(spark, sf, "lineitem").select(
        F.expr(f"l_orderkey div {BLOCK}").alias("region"),
        (month.cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(l_linenumber as int))")).alias("time"),
        (i * 0.2 + 1.0).alias("lat"), (j * 0.2 + 44.0).alias("lon"),
        F.when(i <= j + 3, q * 0.2718281828 + 290).alias("analysed_sst"),
        F.when((i * 7 + j * 3 + F.month(month)) % 11 != 0, (F.rint("l_extendedprice") % 640) * 0.0157079633).alias("CHL"),
        ((line - 4) * 0.1259921050).alias("uo"), ((q - 25) * 0.0316227766).alias("vo"),
        F.when((i + j) % 6 != 0, whole(F.col("l_discount"), 100) * 0.2414213562).alias("VHM0"),
        ((whole(F.col("l_tax"), 100) - 4) * 2.4494897428).alias("east"), (line * 1.4422495703 - 6).alias("north"),
    )


def scored_items(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled, scored rows: one per order line."""
    return table(spark, sf, "lineitem").select(
        F.expr(f"l_orderkey div {BLOCK}").alias("region"),
        F.month("l_shipdate").alias("month"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("fished"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"),
    )


def found_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What was loaded, read off the orders: each year lacks some source."""
    place = F.substring("o_orderpriority", 1, 1).cast("int")
    year = F.year("o_orderdate")
    live = F.col("o_orderstatus") == "O"
    names = F.when(
        live, F.element_at(F.lit(["sst", "chl", "cur", "thetao", "wav"]), place)
    ).otherwise(F.element_at(F.lit(["sst", "chl", "phy", "wav", "wnd"]), place))
    return table(spark, sf, "orders").select(
        F.when(live, "nrt").otherwise("historical").alias("mode"),
        F.when(year % 5 != place % 5, names).otherwise("other").alias("source"),
        F.element_at(
            F.lit(["analysed_sst", "CHL", "uo", "vo", "thetao", "VHM0", "eastward_wind"]),
            (F.col("o_custkey") % 7 + 1).cast("int"),
        ).alias("variable"),
        F.col("o_orderdate").alias("time"),
        year.alias("year"),
        whole(F.col("o_totalprice"), 100).alias("bytes"),
    )


def customer_windows(spark: SparkSession, sf: str) -> DataFrame:
    """One window of days per customer, from the first order to the last."""
    return (
        table(spark, sf, "orders").groupBy("o_custkey")
        .agg(
            F.min("o_orderdate").cast("date").alias("start_day"),
            F.max("o_orderdate").cast("date").alias("end_day"),
        )
        .withColumns({
            "source": F.element_at(
                F.lit(["sst", "chl", "phy", "wav", "wnd"]), (F.col("o_custkey") % 5 + 1).cast("int")
            ),
            "mode": F.when(F.col("o_custkey") % 3 == 0, "nrt").otherwise("historical"),
        })
    )
