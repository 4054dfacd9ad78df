"""Planning, sources, daily documents, lookups and streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import day
from seagrid import Grid, operators as op, sources
from seagrid.sources.readers import nan_to_null, surface
from seagrid.streaming import daily_updates, read_merged, run_daily

G = Grid("r", 1.0, 3.0, 44.0, 46.0)


# ------------------------------------------------------------------- planning

def windows(spark, *rows):
    return spark.createDataFrame(
        [(m, s, dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for m, s, a, b in rows],
        "mode string, source string, start_day date, end_day date")


def chunk_list(df):
    return [(r["chunk"], str(r["chunk_start"]), str(r["chunk_end"])) for r in df.orderBy("chunk_start").collect()]


def test_calendar_chunks_are_clipped(spark):
    w = windows(spark, ("historical", "sst", "2019-11-15", "2020-02-10"))
    assert chunk_list(op.calendar_chunks(w, unit="month")) == [
        ("2019-11", "2019-11-15", "2019-11-30"), ("2019-12", "2019-12-01", "2019-12-31"),
        ("2020-01", "2020-01-01", "2020-01-31"), ("2020-02", "2020-02-01", "2020-02-10")]
    assert chunk_list(op.calendar_chunks(w, unit="year")) == [
        ("2019", "2019-11-15", "2019-12-31"), ("2020", "2020-01-01", "2020-02-10")]
    backwards = windows(spark, ("historical", "sst", "2020-02-10", "2020-02-09"))
    assert op.calendar_chunks(backwards).count() == 0


def test_chunks_follow_the_source(spark):
    w = windows(spark, ("historical", "wav", "2020-01-15", "2020-02-10"),
                ("historical", "sst", "2020-01-15", "2020-02-10"), ("nrt", "wav", "2020-01-15", "2020-02-10"))
    got = {(r["mode"], r["source"], r["chunk"]) for r in op.load_chunks(w).collect()}
    assert got == {("historical", "wav", "2020-01"), ("historical", "wav", "2020-02"),
                   ("historical", "sst", "2020"), ("nrt", "wav", "2020-01-15_2020-02-10")}


def test_pending_chunks(spark):
    chunks = op.load_chunks(windows(spark, ("historical", "wav", "2020-01-15", "2020-02-10")))
    done = spark.createDataFrame([("wav", "2020-01")], "source string, chunk string")
    assert [r["chunk"] for r in op.pending_chunks(chunks, done).collect()] == ["2020-02"]
    assert op.pending_chunks(chunks, done, overwrite=True).count() == 2


def test_clamping_windows(spark):
    w = windows(spark, ("nrt", "sst", "2026-08-08", "2026-08-11"), ("nrt", "chl", "2026-08-08", "2026-08-11"),
                ("nrt", "wav", "2026-08-08", "2026-08-11"), ("nrt", "wnd", "2026-08-08", "2026-08-11"))
    bounds = spark.createDataFrame(
        [("sst", dt.date(2026, 1, 1), dt.date(2026, 8, 10)), ("chl", dt.date(2026, 7, 1), dt.date(2026, 8, 3)),
         ("wav", dt.date(2026, 1, 1), dt.date(2026, 8, 20))], "source string, first_day date, last_day date")
    got = {r["source"]: (str(r["load_start"]), str(r["load_end"])) for r in op.clamp_windows(w, bounds).collect()}
    assert got == {
        "sst": ("2026-08-07", "2026-08-10"),  # moved, length kept
        "chl": ("2026-07-01", "2026-08-03"),  # 40 days back, cut at the first day
        "wav": ("2026-08-08", "2026-08-11"), "wnd": ("2026-08-08", "2026-08-11")}


def test_expected_sources(spark):
    assert op.expected_sources(spark).count() == 11
    assert {r["source"] for r in op.expected_sources(spark, training_only=True).collect()} == {"sst", "chl", "phy"}


def test_inventory_reads_paths(spark):
    files = spark.createDataFrame(
        [("file:/d/historical/sst/sst_2019.nc", 2_000_000), ("file:/d/historical/sst/sst_2020.nc", 500_000),
         ("/d/nrt/wav/wav_2026-08-01_2026-08-04.nc", 10), ("/d/notes.txt", 5)], "path string, bytes long")
    got = {(r["mode"], r["source"]): (r["files"], r["megabytes"], r["first_label"], r["last_label"])
           for r in sources.source_inventory(files).collect()}
    assert got == {("historical", "sst"): (2, 2.5, "2019", "2020"),
                   ("nrt", "wav"): (1, 1e-05, "2026-08-01_2026-08-04", "2026-08-01_2026-08-04"),
                   ("unmatched", "unmatched"): (1, 5e-06, None, None)}


# -------------------------------------------------------------------- sources

def test_effort_replies_are_flattened(spark):
    reply = {"entries": [
        {"fleet": [{"date": "2024-01-01", "lat": 1.0, "lon": 44.0, "hours": 2.5, "flag": "SOM", "mmsi": 1}]},
        {"fleet": [{"date": "2024-01-02", "lat": 1.1}], "other": None}]}
    empty = json.dumps({"entries": []})
    raw = spark.createDataFrame([(json.dumps(reply),), (empty,)], "json string")
    rows = sources.flatten_effort(raw).orderBy("date").collect()
    assert len(rows) == 2 and "mmsi" not in rows[0]
    assert (rows[0]["flag"], rows[1]["flag"], rows[1]["lat"], rows[1]["vesselType"]) == ("SOM", None, 1.1, None)


def test_readings_keep_the_surface_and_drop_nan(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1), 1.0, 44.0, d, v, 1.0, 20.0) for d, v in ((0.5, 0.1), (1.5, 0.2), (0.5, float("nan")))]
    df = spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, depth double, uo double, vo double, thetao double")
    df.write.parquet(str(tmp_path / "phy"))
    got = sources.read_readings(spark, str(tmp_path / "phy"), "phy")
    assert "depth" not in got.columns
    assert sorted((r["uo"] is None, r["uo"]) for r in got.collect()) == [(False, 0.1), (True, None)]
    plain = spark.createDataFrame([(1, float("nan"))], "a int, x double")
    assert surface(plain) is plain and nan_to_null(plain).first()["x"] is None


def features(spark, year, extra=()):
    return spark.createDataFrame(
        [("r", dt.date(year, 1, d), i, 0, 25.0, *[1.0 for _ in extra]) for d in (1, 2) for i in (0, 1)],
        "region string, date date, lat_idx int, lon_idx int, sst double" + "".join(f", {e} double" for e in extra))


def test_features_round_trip(spark, tmp_path):
    path = str(tmp_path / "features")
    sources.write_features(features(spark, 2020), path)
    sources.write_features(features(spark, 2021, ["depth"]), path)
    sources.write_features(features(spark, 2021, ["depth"]), path)  # a rerun replaces its year
    df = sources.read_features(spark, path, region="r", years=[2020, 2021], columns=["date", "sst", "depth", "ghost"])
    assert df.count() == 8 and df.columns == ["date", "sst", "depth", "ghost", "region", "year"]
    assert df.where("year = 2020 and depth is not null").count() == 0
    assert df.where("year = 2021 and depth = 1").count() == 4
    one = sources.read_features(spark, path, years=[2021])
    assert one.count() == 4
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan.split("PartitionFilters")[1][:120]


def test_effort_by_year(spark, tmp_path):
    rows = [("2024-01-01", 1.0, 44.0, 1.0, "A", "g", "v", y, 1) for y in (2023, 2024)]
    spark.createDataFrame(
        rows, "date string, lat double, lon double, hours double, flag string, geartype string, vesselType string, year int, month int"
    ).write.partitionBy("year", "month").parquet(str(tmp_path / "effort"))
    assert sources.read_effort(spark, str(tmp_path / "effort"), 2024).count() == 1
    assert sources.read_effort(spark, str(tmp_path / "effort"), 2030).count() == 0


def test_file_listing(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "t"))
    row = sources.file_listing(spark.read.parquet(str(tmp_path / "t"))).first()
    assert row["n_rows"] == 10 and row["bytes"] > 0


# -------------------------------------------------------------------- serving

def sea(spark, days=(1, 2)):
    rows = [("r", day(d), i, j, 20.0 + i, 0.1 * j, 1.0, 10.0, 0, 3)
            for d in days for i in range(20) for j in range(20) if i <= j + 3]
    return spark.createDataFrame(
        rows, "region string, date date, lat_idx int, lon_idx int, sst double, chl double, "
              "wave_height_max double, wind_speed_max double, wave_estimated int, chl_age_days int")


def documents(spark):
    from seagrid.plans import score_days

    return score_days(op.sst_gradient(sea(spark), G), G)


def test_daily_documents(spark, tmp_path):
    out = documents(spark)
    sources.write_daily(out.payload, str(tmp_path))
    days = spark.read.text(f"{tmp_path}/days")
    assert days.count() == 2
    latest = spark.read.text(f"{tmp_path}/latest").collect()
    assert len(latest) == 1
    doc = json.loads(latest[0]["value"])
    assert doc["date"] == "2024-01-02" and doc["n_cells"] == len(doc["cells"]["lat"]) == 264
    assert doc["grid"]["n_lat"] == 20 and doc["thresholds"]["wave_danger_m"] == 2.0
    assert doc["safety"]["status"] == "AMMAAN" and doc["safety"]["label"]["en"] == "Safe"
    assert doc["safety"]["counts"] == {"n_safe": 264, "n_caution": 0, "n_danger": 0, "n_unknown": 0}
    assert doc["model"]["score_source"] == "physics_index" and doc["model"]["trained"] is False
    assert doc["data_freshness"]["chl_age_days"] == 3
    assert doc["data_quality"]["wave_estimated_share"] == 0.0
    assert [z["rank"] for z in doc["zones"]] == list(range(1, len(doc["zones"]) + 1))
    assert doc["reach"]["n_reachable_cells"] == sum(doc["cells"]["reachable"])
    places = list(zip(doc["cells"]["lat_idx"], doc["cells"]["lon_idx"]))
    assert places == sorted(places)


def test_newest_day_and_fallback(spark):
    df = sea(spark)
    assert op.select_days(df).select("date").distinct().collect()[0]["date"] == day(2)
    assert op.select_days(df, "2024-01-01").count() == 264
    live = op.latest_or_fallback(df, sea(spark, [7]))
    assert {(r["date"], r["source"], r["stale"]) for r in live.collect()} == {(day(2), "live", False)}
    spare = op.latest_or_fallback(df.where("false"), sea(spark, [7]))
    assert {(r["date"], r["source"], r["stale"]) for r in spare.collect()} == {(day(7), "demo", True)}


def test_lookup_points(spark):
    points = spark.createDataFrame(
        [(1, "r", 1.05, 44.55), (2, "r", 1.62, 44.12), (3, "r", 2.95, 44.05), (4, "r", 1.10, 44.55), (5, "r", 50.0, 44.0)],
        "point_id long, region string, lat double, lon double")
    day_cells = op.select_days(op.classify(sea(spark)))
    got = {r["point_id"]: r for r in op.lookup_points(points, day_cells, G, carry=["sst", "safety"]).collect()}
    assert (got[1]["lat_idx"], got[1]["lon_idx"], got[1]["sst"]) == (0, 5, 20.0)
    assert got[2]["distance_deg"] == pytest.approx(0.20, abs=1e-9) or got[2]["lat_idx"] <= got[2]["lon_idx"] + 3
    assert 3 not in got and 5 not in got  # land far from any sea cell, and nowhere near the grid
    assert got[4]["lat_idx"] == 0  # half way between two cells: the lower index
    assert got[1]["safety"] == "AMMAAN"


def test_lookup_matches_brute_force(spark):
    cells = op.select_days(sea(spark))
    known = [(r["lat_idx"], r["lon_idx"]) for r in cells.collect()]
    pts = [(k, "r", 0.83 + 0.0517 * (k % 45), 43.79 + 0.0473 * (k // 45)) for k in range(45 * 45)]
    df = spark.createDataFrame(pts, "point_id long, region string, lat double, lon double")
    got = {r["point_id"]: (r["lat_idx"], r["lon_idx"]) for r in op.lookup_points(df, cells, G).collect()}
    for k, _, lat, lon in pts:
        best = min((round(abs(1.05 + 0.1 * i - lat) + abs(44.05 + 0.1 * j - lon), 9), i, j) for i, j in known)
        assert got.get(k) == (best[1:] if best[0] <= 0.2 else None)


def test_catalog(spark):
    gate = spark.createDataFrame([(True,)], "beats_baselines boolean")
    row = op.catalog_status(sea(spark), gate).first()
    assert (row["days_available"], row["newest_day"], row["ranking_source"]) == (2, day(2), "model")
    assert op.catalog_status(sea(spark)).first()["ranking_source"] == "physics_index"


# ------------------------------------------------------------------ streaming

def test_stream_equals_batch_over_several_files(spark, tmp_path):
    schema = "time timestamp_ntz, pixel long, wave double"
    for k in range(3):
        rows = [(dt.datetime(2024, 1, 1 + n % 2, (n + k) % 24), n % 3, float(n * (k + 1) % 7)) for n in range(40)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates = daily_updates(stream, ["wave"], ["pixel"])
    run_daily(updates, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    merged = read_merged(spark.read.parquet(str(tmp_path / "out")), ["date", "pixel"])
    batch = op.daily_stats(spark.read.schema(schema).parquet(str(tmp_path / "in")), ["wave"], ["pixel"])
    names = ["date", "pixel", "wave_mean", "wave_max"]
    a = sorted(tuple(r) for r in merged.select(*names).collect())
    b = sorted(tuple(r) for r in batch.select(*names).collect())
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(x[2] == pytest.approx(y[2]) and x[3] == y[3] for x, y in zip(a, b))
    # Nothing new: a second run changes nothing.
    run_daily(updates, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert read_merged(spark.read.parquet(str(tmp_path / "out")), ["date", "pixel"]).count() == len(a)
