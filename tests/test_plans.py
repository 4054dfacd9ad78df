"""The end-to-end jobs on a small made-up sea."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seagrid import Grid, operators as op
from seagrid.operators.models import FEATURES, feature_set
from seagrid.plans import build_features, score_days, validate
from seagrid.plans.features import on_grid
from seagrid.operators import align_sources
from seagrid.session import settle_by_day
from seagrid.sources import write_metrics

G = Grid("r", 1.0, 2.0, 44.0, 45.0)


def days(n, start=dt.date(2024, 1, 1)):
    return [start + dt.timedelta(days=k) for k in range(n)]


def daily_fields(spark, n=30):
    lat = op.Axis.regular(0.9, 0.2, 7)
    lon = op.Axis.regular(43.9, 0.2, 7)
    land = lambda a, b: a > 1.7 and b < 44.3

    def field(names, value, skip=lambda d: False):
        rows = [
            ("r", d, a, b, *[None if land(a, b) else value(k, a, b) for _ in names])
            for k, d in enumerate(days(n)) if not skip(k) for a in lat.values for b in lon.values
        ]
        return spark.createDataFrame(
            rows, "region string, date date, lat double, lon double, " + ", ".join(f"{c} double" for c in names))

    fields = {
        "sst": field(["analysed_sst"], lambda k, a, b: 298.15 + a),
        "phy": field(["uo", "vo", "thetao"], lambda k, a, b: 3.0),
        "chl": field(["CHL"], lambda k, a, b: 1.0 + k, skip=lambda k: k >= 5),
        "wav": field(["VHM0_mean", "VHM0_max"], lambda k, a, b: None if b > 44.4 and b < 44.6 else 1.5),
        "wnd": field(["wind_east", "wind_speed_max"], lambda k, a, b: 4.0).withColumn("wind_north", F.col("wind_east") * 0),
    }
    return fields, {name: (lat, lon) for name in fields}


@pytest.fixture(scope="module")
def built(spark):
    fields, axes = daily_fields(spark)
    effort = spark.createDataFrame(
        [("r", dt.date(2024, 1, 3), 1.0, 44.5, 2.0)], "region string, date date, lat double, lon double, hours double")
    return build_features(on_grid(fields, axes, G), G, effort).cache()


def test_built_columns(built):
    assert set(built.columns) == {
        "cell_id", "region", "date", "lat", "lon", "lat_idx", "lon_idx", "sst", "sst_model", "sst_gradient",
        "chl", "chl_lag7", "chl_lag14", "chl_age_days", "current_speed", "wave_height", "wave_height_max",
        "wave_estimated", "wind_speed", "wind_speed_max", "month", "month_sin", "month_cos",
        "fishing_hours", "n_vessels", "fished"}


def test_built_values(built):
    row = built.where("date = date'2024-01-05' and lat_idx = 0 and lon_idx = 9").first()
    assert row["sst"] == pytest.approx(25.0 + 1.05)
    assert row["sst_gradient"] == pytest.approx(100 / 111.32)
    assert row["current_speed"] == pytest.approx(math.sqrt(18)) and row["sst_model"] == pytest.approx(3.0)
    assert row["chl"] == pytest.approx(5.0) and row["chl_lag7"] == pytest.approx(3.0)
    assert row["wind_speed_max"] == pytest.approx(14.4)
    assert row["cell_id"] == "c_0000_0009" and row["month"] == 1


def test_chlorophyll_is_carried_for_21_days(built):
    cell = built.where("lat_idx = 0 and lon_idx = 9")
    got = {r["date"].day: (r["chl"], r["chl_age_days"]) for r in cell.collect()}
    assert got[26] == (pytest.approx(5.0), 21) and got[27] == (None, 22) and len(got) == 30


def test_wave_gaps_are_filled_and_flagged(built):
    gaps = built.where("wave_estimated = 1")
    assert gaps.count() > 0 and gaps.where("abs(wave_height_max - 1.5) > 1e-9").count() == 0


def test_land_is_gone_and_labels_join(built):
    assert built.where("sst is null").count() == 0
    assert built.where("fished = 1").select("cell_id").first()["cell_id"] == "c_0000_0005"


def test_missing_sources_leave_null_columns(spark):
    fields, axes = daily_fields(spark, 3)
    gridded = on_grid({"phy": fields["phy"]}, axes, G)
    out = build_features(gridded, G)
    row = out.first()
    assert row["sst"] == pytest.approx(3.0)  # the model stands in for the satellite
    assert row["chl"] is None and row["wave_height_max"] is None and row["chl_age_days"] is None
    with pytest.raises(ValueError):
        build_features({}, G)


def test_the_wide_table_is_moved_once(spark):
    """Regridding, alignment, fronts and filling share one exchange by day."""
    fields, axes = daily_fields(spark, 3)
    gridded = {k: df for k, df in on_grid(fields, axes, G).items() if k in ("sst", "wav")}
    plan = build_features(gridded, G)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in exchanges if "lat_idx" in line]
    # Above the alignment nothing moves any more.
    assert "Exchange" not in plan[: plan.index("HashAggregate")]


def exchanges_above_fields(plan: str) -> list[str]:
    """Exchanges between the result and a scan of a table stored by day."""
    above, path = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|"))
        path = [(d, text) for d, text in path if d < depth] + [(depth, line.strip(" :+-|"))]
        if "seagrid_by_day" in line and "FileScan" in line:
            above += [text for _, text in path if text.startswith("Exchange")]
    return above


def test_fields_stored_by_day_are_not_moved(spark):
    fields, axes = daily_fields(spark, 24)
    effort = spark.createDataFrame(
        [("r", dt.date(2024, 1, 3), 1.0, 44.5, 2.0)], "region string, date date, lat double, lon double, hours double")
    stored, plain = on_grid(fields, axes, G, buckets=5), on_grid(fields, axes, G)
    for name, df in stored.items():
        files = [f.rsplit("/", 1)[1] for f in df.inputFiles()]
        assert 0 < len(files) <= 5 and sorted(map(tuple, df.collect())) == sorted(map(tuple, plain[name].collect()))
    for options in ({}, {"effort": effort, "neg_per_pos": 2}):
        got, want = build_features(stored, G, buckets=5, **options), build_features(plain, G, **options)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
    without = {name: df for name, df in stored.items() if name != "chl"}  # trailing means are laid out by cell
    plan = build_features(without, G, buckets=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet spark_catalog.default.seagrid_by_day") == 5 and not exchanges_above_fields(plan)
    moved = build_features(without, G)._jdf.queryExecution().executedPlan().toString()
    assert exchanges_above_fields(moved)


def test_fields_that_do_not_lie_as_told_give_the_same_rows(spark):
    fields, axes = daily_fields(spark, 6)
    plain, other = on_grid(fields, axes, G), on_grid(fields, axes, G, buckets=3)
    want = sorted(map(str, build_features(plain, G).collect()))
    mixed = {**plain, "sst": other["sst"]}
    assert sorted(map(str, build_features(mixed, G, buckets=5).collect())) == want


def test_alignment_of_stored_frames(spark):
    """Without a grid to fill: days on which no source has a value go, rows without a cell too."""
    day = dt.date(2024, 1, 1)
    rows = [("a", day, 0, 0, 1.0), ("a", day, 0, 1, None), ("b", day, 0, 0, None), ("c", None, 0, 0, 4.0)]
    key = "region string, date date, lat_idx int, lon_idx int, "
    frames = [spark.createDataFrame(rows, key + "x double"), spark.createDataFrame([("a", day, 1, 0, 7.0)], key + "y double")]
    stored = [settle_by_day(df.repartition(4, "region", "date"), 4) for df in frames]
    got = align_sources(stored, buckets=4)
    assert sorted(map(str, got.collect())) == sorted(map(str, align_sources(frames).collect())) and got.count() == 3
    assert align_sources([df.limit(0) for df in stored], buckets=4).count() == 0


def labelled(spark, years=(2019, 2020, 2021, 2022), n_days=24):
    """Boats go where the front is strong; the season sets how many."""
    rows = []
    for y in years:
        for m in range(1, 13):
            for d in range(1, n_days // 12 + 1):
                for i in range(10):
                    for j in range(10):
                        front = ((i * 37 + j * 91 + m * 53 + d * 29 + y * 17) % 100) / 10
                        hit = front > 8 and m not in (7, 8)
                        rows.append(("r", dt.date(y, m, d), i, j, m, 25.0, front, 0.5, float(100 + i * j), 10.0, 1.0 + i / 10,
                                     44.0 + j / 10, int(hit)))
    return spark.createDataFrame(
        rows, "region string, date date, lat_idx int, lon_idx int, month int, sst double, sst_gradient double, "
              "chl double, depth double, seabed_roughness double, lat double, lon double, fished int")


def test_validation_end_to_end(spark, tmp_path):
    df = labelled(spark)
    names = ["sst", "sst_gradient", "depth", "seabed_roughness", "lat", "lon"]
    out = validate(df, names, neg_per_pos=20, end_year=2021, rounds=8, spatial=True)
    within = {r["model"]: r["pr_auc_within_month"] for r in out.within.collect()}
    assert within["hotspot"] > 0.95 > within["climatology"]
    assert out.gate.first()["beats_baselines"] is True
    assert out.importance.first()["feature"] == "sst_gradient"
    assert {r["model"] for r in out.pooled.collect()} == {"hotspot", "depth_only", "climatology", "physics_index"}
    assert {r["model"] for r in out.spatial.collect()} == {"transfer", "physics_index"}
    # The off-season took no part.
    assert out.within.first()["months"] == 10
    write_metrics(out.notes, str(tmp_path / "notes"))
    note = spark.read.json(str(tmp_path / "notes")).first()
    assert note["beats_baselines"] and note["weather_excluded"] and len(note["caveats"]) == 3

    path = str(tmp_path / "model")
    out.model.write().overwrite().save(path)
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(path)
    test = df.where("year(date) = 2022")
    a = op.predict(out.model, test).orderBy("date", "lat_idx", "lon_idx").collect()
    b = op.predict(again, test).orderBy("date", "lat_idx", "lon_idx").collect()
    assert [r["probability"] for r in a] == [r["probability"] for r in b]

    gated = op.score_cells(test, out.model, names, validated=False)
    assert gated.select("score_source").distinct().collect()[0][0] == "physics_index"
    lacking = op.score_cells(test.drop("sst"), out.model, names, validated=True)
    assert lacking.first()["score_source"] == "physics_index"
    used = score_days(
        test.withColumns({"wave_height_max": F.lit(1.0), "wind_speed_max": F.lit(5.0)}), G, out.model, names, True)
    assert used.cells.first()["score_source"] == "model"
    assert used.payload.first()["model"]["trained"] is True


def test_missing_values_do_not_stop_the_model(spark):
    df = labelled(spark, (2020, 2021)).withColumn("sst", F.when(F.col("lat_idx") > 2, F.col("sst")))
    model = op.fit_hotspot(df, ["sst", "sst_gradient"], rounds=3, depth=3)
    assert op.predict(model, df).where("probability is null or probability not between 0 and 1").count() == 0


def test_feature_sets():
    assert len(FEATURES) == 14
    assert feature_set("with_weather")[-2:] == ["wave_height_max", "wind_speed_max"]
    assert not {"lat", "lon"} & set(feature_set("no_position"))
    assert not {"lat", "lon", "depth"} & set(feature_set("transfer"))
    with pytest.raises(ValueError):
        feature_set("all")


def test_labels_do_not_move_the_wide_table(spark):
    """Effort is aligned as one more source, with the rows of a join."""
    fields, axes = daily_fields(spark, 6)
    gridded = {k: df for k, df in on_grid(fields, axes, G).items() if k in ("sst", "wav")}
    rows = [("r", dt.date(2024, 1, d), 1.0 + 0.1 * i, 44.5, 0.5 * d) for d in range(1, 9) for i in range(4) for _ in range(2)]
    rows += [("r", None, 1.0, 44.5, 2.0), (None, dt.date(2024, 1, 3), 1.0, 44.5, 2.0), ("r", dt.date(2024, 1, 3), 1.0, None, 2.0)]
    effort = spark.createDataFrame(rows, "region string, date date, lat double, lon double, hours double")
    got, want = build_features(gridded, G, effort), op.join_labels(build_features(gridded, G), op.effort_cells(effort, G))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("fished = 1").count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("HashAggregate")]
