"""Cases in which readings, rows or groups must not get lost or mixed up."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seagrid import operators as op
from seagrid.grid import Grid
from seagrid.operators.boosting import best_round
from seagrid.plans.features import on_grid
from seagrid.sources import readers

from conftest import day

G = Grid("g", 0.0, 1.0, 0.0, 1.0)


def test_single_precision_coordinates_lose_nothing(spark):
    step = 1 / 12
    nodes = [(day(1), "g", i * step, j * step, float(i + j)) for i in range(13) for j in range(13)]
    df = spark.createDataFrame(nodes, "date date, region string, lat double, lon double, v double")
    single = df.withColumns({c: F.col(c).cast("float") for c in ("lat", "lon")})
    axis = op.Axis.regular(0.0, step, 13)
    want = op.regrid_bilinear(df, ["v"], axis, axis, G).collect()
    got = op.regrid_bilinear(single, ["v"], axis, axis, G).collect()
    assert len(want) == 100 and sorted(want) == sorted(got) and all(r.v is not None for r in got)
    own = op.Axis.of(single, "lat")
    assert len(own.values) == 13 and own.values == pytest.approx(axis.values, abs=1e-6)
    taken = {(r.lat_idx, r.lon_idx): r.v for r in op.regrid_bilinear(single.union(df.where("lat > 2")), ["v"], own, own, G).collect()}
    assert taken == pytest.approx({(r.lat_idx, r.lon_idx): r.v for r in want}, abs=1e-4)
    assert op.unmatched_readings(single, axis, axis).first().unmatched == 0
    off = df.withColumn("lat", F.when(F.col("lon") < 0.01, F.col("lat") + 0.4 * step).otherwise(F.col("lat")))
    assert tuple(op.unmatched_readings(off, axis, axis, ["region"]).first()) == ("g", 169, 13)


def test_irregular_axes(spark):
    lat, lon = op.Axis((0.0, 0.13, 0.55, 0.6, 1.0)), op.Axis((0.0, 0.5, 1.0))
    rows = [(day(1), "g", a + 1e-5, b, 2 * a + b) for a in lat.values for b in lon.values]
    df = spark.createDataFrame(rows, "date date, region string, lat double, lon double, v double")
    got = op.regrid_bilinear(df, ["v"], lat, lon, G).collect()
    assert len(got) == 100
    for r in got:
        assert r.v == pytest.approx(2 * (0.1 * r.lat_idx + 0.05) + 0.1 * r.lon_idx + 0.05)


def test_opposed_winds_cancel(spark):
    rows = [(day(1), "g", lat, lon, 10.0 if lon < 0.5 else -10.0, 0.0, 10.0) for lat in (0.0, 1.0) for lon in (0.0, 1.0)]
    df = spark.createDataFrame(rows, "date date, region string, lat double, lon double, wind_east double, wind_north double, wind_speed_max double")
    axis = op.Axis((0.0, 1.0))
    got = on_grid({"wnd": df}, {"wnd": (axis, axis)}, Grid("g", 0.0, 1.0, 0.0, 1.0, 0.2))["wnd"]
    middle = got.where("lat_idx = 2 and lon_idx = 2").first()
    assert middle.wind_east == pytest.approx(0.0) and middle.wind_speed_max == pytest.approx(10.0)


def test_trailing_mean_reaches_back_by_source_days(spark):
    """The cell has rows on days 1-3 and 28-30, another one on every day."""
    rows = [("g", 0, 0, day(n), float(n)) for n in (1, 2, 3, 28, 29, 30)] + [("g", 0, 1, day(n), 1.0) for n in range(1, 31)]
    df = spark.createDataFrame(rows, "region string, lat_idx int, lon_idx int, date date, chl double")
    got = {r.date: r.m for r in op.trailing_mean(df, "chl", 7, 3, "m").where("lon_idx = 0").collect()}
    assert got[day(28)] is None and got[day(3)] == 2.0 and got[day(30)] == 29.0


def test_metrics_keep_null_groups_and_leave_out_null_labels(spark):
    rows = [(None, 1, 0.9), (None, 0, 0.1), ("a", 1, 0.2), ("a", 0, 0.8), ("a", None, 0.5)]
    df = spark.createDataFrame(rows, "k string, y int, s double")
    got = {r.k: r for r in op.ranking_metrics(df, "y", "s", ["k"]).collect()}
    assert got[None].roc_auc == 1.0 and got[None].n == 2 and got["a"].roc_auc == 0.0 and got["a"].n == 2
    assert op.ranking_metrics(df.limit(0), "y", "s").first().roc_auc is None


def test_lookup_on_a_grid_of_many_lines(spark):
    fine = Grid("f", 0.0, 0.5, 0.0, 80.0, 0.001)
    cells = spark.createDataFrame([("f", 7, 70007), ("f", 499, 79999)], "region string, lat_idx int, lon_idx int")
    points = spark.createDataFrame([(1, 0.0071, 70.0079), (2, 0.4999, 79.9999), (3, 0.2, 5.0)], "point_id long, lat double, lon double")
    found = op.lookup_points(points.withColumn("region", F.lit("f")), cells, fine)
    assert {r.point_id: (r.lat_idx, r.lon_idx) for r in found.collect()} == {1: (7, 70007), 2: (499, 79999)}


def test_unfit_files_are_listed(spark):
    files = spark.createDataFrame([("/raw/nrt/sst/sst_2024.nc", 10), ("/raw/notes.txt", 5)], "path string, bytes long")
    got = {r.mode: (r.source, r.files, r.first_label) for r in readers.source_inventory(files).collect()}
    assert got == {"nrt": ("sst", 1, "2024"), "unmatched": ("unmatched", 1, None)}


def test_historical_windows_are_not_moved(spark):
    rows = [(m, "sst", dt.date(2024, 1, 1), dt.date(2024, 3, 1)) for m in ("nrt", "historical")]
    ask = spark.createDataFrame(rows, "mode string, source string, start_day date, end_day date")
    known = spark.createDataFrame([("sst", dt.date(2020, 1, 1), dt.date(2024, 2, 1))], "source string, first_day date, last_day date")
    got = {r.mode: (r.load_start, r.load_end) for r in op.clamp_windows(ask, known).collect()}
    assert got["historical"] == (dt.date(2024, 1, 1), dt.date(2024, 3, 1)) and got["nrt"][1] == dt.date(2024, 2, 1)


def test_effort_totals_keep_regions_apart(spark):
    rows = [(r, day(1), 0.0, 0.0, 1.0) for r in ("a", "b")]
    df = spark.createDataFrame(rows, "region string, date date, lat double, lon double, hours double")
    got = op.effort_totals(df, G).first()
    assert (got.cells, got.cell_days) == (2, 2)


def test_rows_off_the_grid_do_not_shift_planes(spark):
    rows = [("g", day(1), i, j, float(i * 10 + j)) for i in range(10) for j in range(10)]
    schema = "region string, date date, lat_idx int, lon_idx int, sst double"
    whole = op.align_sources([spark.createDataFrame(rows, schema)], fill_grid=G)
    stray = op.align_sources([spark.createDataFrame([("g", day(1), 0, 12, 99.0), *rows], schema)], fill_grid=G)
    assert stray.count() == 100 and sorted(whole.collect()) == sorted(stray.collect())


def test_boosting_waits_for_gains():
    assert best_round([0.1, 0.2, 0.15, 0.17, 0.3, 0.25]) == 5
    assert best_round([0.4, *[0.2] * 30, 0.9]) == 1 and best_round([0.4, *[0.2] * 29, 0.9]) == 31 and best_round([0.5]) == 1


def test_boosting_keeps_more_than_one_tree(spark):
    """Additive steps in five columns: a tree of depth 2 shows two of them, so three are needed to rank the rows."""
    rng = random.Random(1)  # all combinations, which a few periods would not give
    rows = [(dt.date(2020 + k % 3, 1, 1 + k % 28), *[float(rng.randrange(11)) for _ in "abcde"]) for k in range(1800)]
    df = spark.createDataFrame(rows, "date date, a double, b double, c double, d double, e double")
    sum_ = sum(F.when(F.col(x) > 5, 1).otherwise(0) for x in "abcde")
    df = df.withColumns({"fished": (sum_ >= 4).cast("int"), "year": F.year("date")})
    model = op.fit_hotspot(df, list("abcde"), rounds=30, depth=2, step=0.3)
    assert model.stages[2].getNumTrees >= 3


def test_absent_sources_are_scored_by_the_index(spark):
    rows = [("g", dt.date(2020 + k % 3, 1, 1 + k % 9), k % 10, k // 10 % 10, float(k % 7), float(k % 5), int(k % 7 > 4)) for k in range(600)]
    df = spark.createDataFrame(rows, "region string, date date, lat_idx int, lon_idx int, chl double, sst_gradient double, fished int")
    df = df.withColumn("year", F.year("date"))
    model = op.fit_hotspot(df, ["chl", "sst_gradient"], rounds=3, depth=2)
    holed = df.withColumn("chl", F.when(F.day("date") != 3, F.col("chl")))
    got = op.score_cells(holed, model, ["chl", "sst_gradient"], validated=True).collect()
    assert {(r.date.day == 3, r.score_source) for r in got} == {(True, "physics_index"), (False, "model")}
    assert all(r.score is not None for r in got)


def test_one_level_stored_with_different_precision(spark):
    rows = [(1, 0.49402499198913574), (2, 0.494025), (3, 1.541375), (4, None)]
    df = spark.createDataFrame(rows, "k int, depth double")
    assert sorted(r.k for r in readers.surface(df).collect()) == [1, 2, 4]


def test_alignment_reads_every_source_once(spark, tmp_path):
    frames = []
    for k, name in enumerate(("a", "b", "c")):
        rows = [("g", day(1 + d), 0, j, None if d == 2 else float(k + j)) for d in range(3) for j in range(4)]
        path = str(tmp_path / name)
        spark.createDataFrame(rows, f"region string, date date, lat_idx int, lon_idx int, {name} double").write.parquet(path)
        frames.append(spark.read.parquet(path))
    out = op.align_sources(frames)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 3
    assert {r["date"] for r in out.collect()} == {day(1), day(2)} and out.count() == 8


def test_zones_say_where_each_day_has_its_scores_from(spark):
    schema = ("region string, date date, lat_idx int, lon_idx int, reachable boolean, zone_id string, site_id string, "
              "band string, site_km double, score double, wave_height_max double, wind_speed_max double, score_source string")
    rows = [("r", day(d), 0, j, True, "hobyo_0-15", "hobyo", "0-15", 9.0, 50.0, 1.0, 10.0, source)
            for d, source in ((1, "model"), (2, "physics_index")) for j in range(3)]
    zones = op.zone_summary(spark.createDataFrame(rows, schema), Grid("g", 1.0, 3.0, 44.0, 46.0))
    assert {r["date"]: r["score_source"] for r in zones.collect()} == {day(1): "model", day(2): "physics_index"}


@pytest.mark.parametrize("keys", [[], ["region"]])
def test_median_depth_is_exact_and_keeps_rows_without_a_region(spark, keys):
    rows = [(None if k % 3 == 0 else f"r{k % 3}", float((k * 7919) % 503) if k % 5 else None) for k in range(1200)]
    static = spark.createDataFrame([*rows, ("land", None)], "region string, depth double")
    got = {tuple(r[c] for c in keys): r for r in op.depth_report(static, keys).collect()}
    want = static.groupBy(*keys).agg(F.percentile("depth", F.lit(0.5)).alias("m"), F.min("depth").alias("low"),
                                     F.count_if(F.col("depth").isNull()).alias("dry")).collect()
    assert len(got) == len(want)
    for r in want:
        own = got[tuple(r[c] for c in keys)]
        assert (own["median_depth"], own["min_depth"], own["cells_above_sea"]) == (r["m"], r["low"], r["dry"])
