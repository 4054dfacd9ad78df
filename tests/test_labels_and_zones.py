import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import day
from seagrid import Grid, REGIONS, operators as op

G = Grid("r", 1.0, 3.0, 44.0, 46.0)
EFFORT = "region string, date date, lat double, lon double, hours double, flag string"


def effort(spark):
    return spark.createDataFrame([
        ("r", day(1), 1.0, 44.0, 0.3, "AAA"), ("r", day(1), 1.0, 44.0, 0.3, "AAA"),
        ("r", day(1), 1.1, 44.0, 0.5, None), ("r", day(2), 9.0, 44.0, 5.0, "BBB"),
    ], EFFORT)


def test_effort_counts_rows_and_drops_the_outside(spark):
    got = {(r["lat_idx"], r["lon_idx"]): (r["fishing_hours"], r["n_vessels"])
           for r in op.effort_cells(effort(spark), G).collect()}
    assert got == {(0, 0): (pytest.approx(0.6), 2), (1, 0): (0.5, 1)}


def test_labels_default_to_true_zeros(spark):
    cells = spark.createDataFrame(
        [("r", day(1), i, 0) for i in range(3)], "region string, date date, lat_idx int, lon_idx int")
    out = op.join_labels(cells, op.effort_cells(effort(spark), G)).orderBy("lat_idx").collect()
    assert [(r["fished"], r["n_vessels"]) for r in out] == [(1, 2), (0, 1), (0, 0)]
    assert out[2]["fishing_hours"] == 0.0


def test_match_report_warns_below_half(spark):
    cells = spark.createDataFrame(
        [("r", day(1), 0, 0)], "region string, date date, lat_idx int, lon_idx int")
    wanted = cells.unionByName(cells.withColumn("lat_idx", F.lit(5))).withColumn("n_vessels", F.lit(1))
    half = op.label_match_report(cells, wanted).first()
    assert (half["effort_cell_days"], half["matched"], half["warn"]) == (2, 1, False)
    less = op.label_match_report(cells, wanted.unionByName(wanted.where("lat_idx = 5"))).first()
    assert less["warn"] is True
    none = op.label_match_report(cells, wanted.where("false")).first()
    assert (none["effort_cell_days"], none["warn"]) == (0, False)


def test_effort_report(spark):
    rows = {r["flag"]: r["share_pct"] for r in op.effort_report(effort(spark)).collect()}
    assert rows["(unknown)"] == pytest.approx(0.5 / 6.1 * 100)
    assert op.effort_report(effort(spark), top=1).first()["flag"] == "BBB"
    assert op.flag_share(effort(spark), "XXX").first()["share_pct"] is None
    total = op.effort_totals(effort(spark), G).first()
    assert (total["n_rows"], total["cell_days"], total["cells"]) == (4, 3, 3)


ZONE = ("region string, date date, lat_idx int, lon_idx int, reachable boolean, zone_id string, "
        "site_id string, band string, site_km double, score double, wave_height_max double, "
        "wind_speed_max double, sst double")


def zone(spark, zid, states, score=50.0, site="hobyo"):
    sea = {"s": (1.0, 10.0), "c": (1.5, 10.0), "d": (3.0, 10.0), "u": (None, 10.0)}
    rows = [("r", day(1), 0, k, True, zid, site, "0-15", 9.0, score, *sea[s], 25.0)
            for k, s in enumerate(states)]
    return spark.createDataFrame(rows, ZONE)


@pytest.mark.parametrize("states,want", [
    ("d" * 34 + "s" * 66, "KHATAR"), ("d" * 33 + "s" * 67, "AMMAAN"), ("s" * 5 + "c" * 5, "AMMAAN"),
    ("s" * 4 + "c" * 6, "TAXADDAR"), ("u" * 51 + "c" * 49, "LAMA_OGA"), ("u" * 5 + "c" * 5, "TAXADDAR"),
])
def test_zone_state_is_the_worst_common_one(spark, states, want):
    row = op.zone_summary(zone(spark, "hobyo_0-15", states), G).first()
    assert row["safety"] == want and row["n_cells"] == len(states)


def test_zone_fields(spark):
    row = op.zone_summary(zone(spark, "hobyo_0-15", "ss"), G, source="physics_index").first()
    assert (row["name_so"], row["name_en"]) == ("Xeebta Hobyo", "Hobyo inshore")
    assert row["travel_hours"] == 0.5 and row["site"]["lat"] == 5.351
    assert row["bounds"].asDict() == {"lat_min": 1.0, "lat_max": 1.1, "lon_min": 44.0, "lon_max": 44.2}
    assert row["conditions"]["sst"] == 25.0 and row["conditions"]["chl"] is None
    assert row["wave_estimated_share"] == 0.0


def test_danger_never_ranks_first(spark):
    zones = op.zone_summary(
        zone(spark, "a_0-15", "d", 99.0).unionByName(zone(spark, "b_0-15", "s", 10.0))
        .unionByName(zone(spark, "c_0-15", "s", None)).unionByName(zone(spark, "d_0-15", "c", 80.0))
        .unionByName(zone(spark, "e_0-15", "s", 10.0)), G)
    ranked = op.rank_zones(zones).orderBy("rank").collect()
    assert [r["zone_id"][0] for r in ranked] == ["b", "e", "c", "d", "a"]
    assert ranked[2]["rating"]["level"] == "unknown"
    assert op.rank_zones(zones, top_n=2).count() == 2


def test_unreachable_cells_form_no_zone(spark):
    df = zone(spark, "hobyo_0-15", "ss").withColumn("reachable", F.lit(False))
    assert op.zone_summary(df, G).count() == 0


def test_land_by_day_or_by_region(spark):
    cells = [("r", day(1), i, j) for i in range(20) for j in range(20)]
    cells += [("r", day(2), i, j) for i in range(20) for j in range(20) if (i, j) != (0, 0)]
    df = spark.createDataFrame(cells, "region string, date date, lat_idx int, lon_idx int")
    ever = op.assign_zones(df, G)
    assert ever.where("dist_coast_km is not null").count() == 0  # every cell was sea once
    daily = op.assign_zones(df, G, per_day=True)
    assert daily.where("date = date'2024-01-02' and dist_coast_km is null").count() == 0
    assert daily.where("date = date'2024-01-01' and dist_coast_km is not null").count() == 0


def monthly(spark, rates, n=1000):
    rows = [(dt.date(2020, m, 1), int(k < r * n)) for m, r in rates.items() for k in range(n)]
    return spark.createDataFrame(rows, "date date, fished int")


@pytest.mark.parametrize("rates,want", [
    ({1: 0.1, 2: 0.05, 7: 0.0, 8: 0.001, 9: 0.002}, [1, 2, 9]),
    ({1: 0.1, 2: 0.1, 7: 0.09}, [1, 2, 3, 4, 5, 6, 9, 10, 11, 12]),
    ({7: 0.1}, [1, 2, 3, 4, 5, 6, 9, 10, 11, 12]),
    ({1: 0.0, 2: 0.0}, [1, 2, 3, 4, 5, 6, 9, 10, 11, 12]),
])
def test_active_months(spark, rates, want):
    df = monthly(spark, rates)
    months = op.fleet_active_months(df)
    assert sorted(r["month"] for r in months.collect()) == want
    kept = {r["date"].month for r in op.keep_months(df, months).select("date").distinct().collect()}
    assert kept == set(rates) & set(want)


def test_navigable_without_columns_keeps_all(spark):
    df = spark.range(3)
    assert op.navigable_days(df).count() == 3


def test_region_exclusion(spark):
    box = REGIONS["somali"]
    df = spark.createDataFrame([(-2.0, 40.5), (12.5, 52.5), (12.6, 45.0), (0.0, 53.0)], "lat double, lon double")
    assert op.exclude_box(df, box).count() == 2
    outside, inside = op.holdout_band(df)
    assert (outside.count(), inside.count()) == (2, 2)
