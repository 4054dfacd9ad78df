"""Operators along a cell's time axis."""

import pytest
from pyspark.sql import functions as F

from conftest import day
from seagrid import operators as op

SCHEMA = "region string, date date, lat_idx int, lon_idx int, chl double"


def series(spark, values, cell=(0, 0), days=None, region="r"):
    days = days or range(1, len(values) + 1)
    return spark.createDataFrame(
        [(region, day(d), *cell, v) for d, v in zip(days, values)], SCHEMA
    )


def by_day(df, *names):
    rows = df.orderBy("lat_idx", "lon_idx", "date").collect()
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in rows]


def test_trailing_mean_needs_enough_values(spark):
    df = series(spark, [1.0, None, 2.0, None, None, 3.0, 5.0, 7.0])
    got = by_day(op.trailing_mean(df, "chl", 7, 3, "m"), "m")
    assert got == [None, None, None, None, None, 2.0, 2.75, pytest.approx(17 / 4)]


def test_trailing_mean_counts_positions_not_days(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0], days=[1, 2, 20, 21])
    assert by_day(op.trailing_mean(df, "chl", 3, 3, "m"), "m")[3] == 3.0
    assert by_day(op.trailing_mean(df, "chl", 3, 3, "m", axis="calendar"), "m")[3] is None


def test_trailing_mean_can_restart_each_year(spark):
    df = series(spark, [1.0] * 4, days=[-2, -1, 0, 1])  # 29 December to 1 January
    kept = by_day(op.trailing_mean(df, "chl", 7, 3, "m"), "m")
    cut = by_day(op.trailing_mean(df, "chl", 7, 3, "m", restart_each_year=True), "m")
    assert kept[3] == 1.0 and cut[2] == 1.0 and cut[3] is None


def planes(spark):
    """Two cells; days 3 and 4 observed, the fourth by the second cell only."""
    a = series(spark, [None, None, 1.0, None] + [None] * 24)
    b = series(spark, [None, None, 2.0, 5.0] + [None] * 24, cell=(0, 1))
    return a.unionByName(b)


def test_carry_forward_takes_whole_planes(spark):
    got = by_day(op.carry_forward(planes(spark), ["chl"]), "lon_idx", "chl", "chl_age_days")
    first, second = got[:28], got[28:]
    assert first[:2] == [(0, None, None)] * 2  # before the first observation
    assert first[2] == (0, 1.0, 0)
    # The plane of day 4 has no value in the first cell, and nothing older comes through.
    assert first[3] == (0, None, 0) and first[4] == (0, None, 1)
    assert second[4] == (1, 5.0, 1)
    assert second[3 + 21] == (1, 5.0, 21) and second[3 + 22] == (1, None, 22)


def test_carry_forward_per_cell(spark):
    got = by_day(op.carry_forward(planes(spark), ["chl"], per_cell=True), "lon_idx", "chl", "chl_age_days")
    assert got[3] == (0, 1.0, 1)


def test_carry_planes_equals_carry_forward(spark):
    dense = planes(spark)
    calendar = dense.select("region", "date").distinct()
    # The source itself has rows on its own days only.
    source = dense.where("date between date'2024-01-03' and date'2024-01-04'")
    rows, ages = op.carry_planes(source, ["chl"], calendar)
    want = op.carry_forward(dense, ["chl"])
    got = dense.drop("chl").join(rows, ["region", "date", "lat_idx", "lon_idx"], "left").join(
        ages, ["region", "date"], "left")
    assert by_day(got, "chl", "chl_age_days") == by_day(want, "chl", "chl_age_days")


def test_a_cell_without_a_row_on_the_source_day_carries_nothing(spark):
    a = series(spark, [1.0, None], days=[1, 3])
    b = series(spark, [2.0, 3.0, None], cell=(0, 1))
    got = by_day(op.carry_forward(a.unionByName(b), ["chl"]), "lon_idx", "date", "chl")
    assert (0, day(3), None) in got and (1, day(3), 3.0) in got


def test_daily_wind_keeps_strong_winds_from_any_side(spark):
    rows = [("2024-01-01 03:00:00", 1, -10.0, 0.0), ("2024-01-01 09:00:00", 1, -5.0, 0.0)]
    df = spark.createDataFrame(rows, "time string, pixel int, u double, v double").withColumn(
        "time", F.col("time").cast("timestamp_ntz"))
    true = op.daily_wind(df, "u", "v", "true", ["pixel"]).first()
    component = op.daily_wind(df, "u", "v", "component", ["pixel"]).first()
    assert true["wind_speed_max"] == pytest.approx(36.0)
    assert component["wind_speed_max"] == pytest.approx(18.0)
    assert true["wind_speed"] == component["wind_speed"] == pytest.approx(27.0)


def test_align_sources(spark):
    a = series(spark, [1.0, None], days=[1, 2])
    b = series(spark, [4.0, None], cell=(0, 1), days=[1, 3]).withColumnRenamed("chl", "sst")
    got = {(r["date"], r["lon_idx"]): (r["chl"], r["sst"]) for r in op.align_sources([a, b]).collect()}
    # Days 2 and 3 have no value in any source.
    assert got == {(day(1), 0): (1.0, None), (day(1), 1): (None, 4.0)}


def test_pick_source_is_by_source(spark):
    a, b = series(spark, [None]), series(spark, [1.0])
    assert op.pick_source({"cur": a, "phy": b}, "cur", "phy") is a
    assert op.pick_source({"phy": b}, "cur", "phy") is b
    assert op.pick_source({}, "cur") is None
