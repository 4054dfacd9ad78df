"""Options of the jobs: thinning, counted readings, updates of some days, pixels of two kinds, whole answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid import Grid, operators as op, sources
from seagrid.plans import affected_days, build_features, score_days, update_features
from seagrid.plans.features import on_grid
from seagrid.session import settle

from conftest import day

G = Grid("r", 0.0, 0.5, 44.0, 44.5)
KEY = ["region", "date", "lat_idx", "lon_idx"]
SCHEMA = "region string, date date, lat_idx int, lon_idx int, "


def made(spark, n=60, seed=1):
    """Gridded fields of two regions; chlorophyll lacks days, pixels and whole planes."""
    rng = random.Random(seed)
    cells = [(r, day(1 + d), i, j) for r in "ab" for d in range(n) for i in range(5) for j in range(5)]

    def field(names, keep=lambda c: True, some=0.9):
        rows = [(*c, *[rng.random() if rng.random() < some else None for _ in names]) for c in cells if keep(c)]
        return settle(spark.createDataFrame(rows, SCHEMA + ", ".join(f"{x} double" for x in names)))

    gone = {(r, day(1 + d)) for r in "ab" for d in range(n) if rng.random() < 0.3 or 20 < d < 48}
    empty = {(r, day(1 + d)) for r in "ab" for d in range(n) if rng.random() < 0.1}
    chl = field(["CHL"], lambda c: c[:2] not in gone)
    chl = settle(chl.withColumn("CHL", F.when(~F.concat("region", "date").isin(*[f"{r}{d}" for r, d in empty]), F.col("CHL"))))
    return {"sst": field(["analysed_sst"]), "chl": chl, "wav": field(["VHM0_mean", "VHM0_max"], some=0.5),
            "wnd": field(["wind_speed", "wind_speed_max"])}


def effort_of(spark, n=60, seed=2):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), day(1 + rng.randrange(n)), rng.randrange(5) * 0.1, 44 + rng.randrange(5) * 0.1, 3.0) for _ in range(80)]
    return spark.createDataFrame(rows, "region string, date date, lat double, lon double, hours double")


def rows_of(df):
    names = sorted(set(df.columns) - {"mode", "year", "day"})
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=str)


def test_a_thinned_build_equals_thinning_what_was_built(spark):
    fields, effort = made(spark, 24), effort_of(spark, 24)
    whole = build_features(fields, G, effort).cache()
    thin = build_features(fields, G, effort, neg_per_pos=2, thin_days=7, seed=5)
    place = F.dense_rank().over(Window.partitionBy("region", F.year("date")).orderBy("date")) - 1
    chunked = whole.withColumn("chunk", F.floor(place / 7))
    want = op.subsample_negatives(chunked, 2, F.struct("region", F.year("date").alias("year"), "chunk"), 5).drop("chunk")
    assert rows_of(thin) == rows_of(want) and 0 < want.count() < whole.count() / 2
    assert thin.where("fished = 1").count() == whole.where("fished = 1").count() > 0


def test_wide_rows_are_cut_before_labels_move_them(spark):
    fields, effort = made(spark, 12), effort_of(spark, 12)
    thin = build_features(fields, G, effort, neg_per_pos=1)
    plan = thin._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("_stays")  # the label join stands above the cut


def test_readings_off_the_axes_fail_the_job(spark):
    lat, lon = op.Axis.regular(0.0, 0.25, 3), op.Axis.regular(44.0, 0.25, 3)
    rows = [("a", day(1), a + (0.1 if a == b - 44 else 0.0), b, 300.0) for a in lat.values for b in lon.values]
    sst = spark.createDataFrame(rows, "region string, date date, lat double, lon double, analysed_sst double")
    with pytest.raises(ValueError, match="3 of 9 readings of sst"):
        on_grid({"sst": sst}, {"sst": (lat, lon)}, G)
    some = on_grid({"sst": sst}, {"sst": (lat, lon)}, G, most_unmatched=0.34)["sst"]
    right = sst.where(F.abs(F.col("lat") * 4 - F.rint(F.col("lat") * 4)) < 0.1)
    exact = on_grid({"sst": right}, {"sst": (lat, lon)}, G)["sst"]
    assert rows_of(some) == rows_of(exact)
    assert on_grid({"sst": sst.limit(0)}, {"sst": (lat, lon)}, G)["sst"].count() == 0


@pytest.mark.parametrize("changes", [
    [("sst", "a", 5), ("wav", "b", 5), ("wnd", "b", 31)], [("chl", "a", 3)], [("chl", "a", 30), ("chl", "b", 49), ("sst", "b", 60)],
])
def test_an_update_equals_a_full_build(spark, tmp_path, changes):
    before, effort = made(spark), effort_of(spark)
    path = str(tmp_path / "features")
    sources.write_features(build_features(before, G, effort, wind_in_ms=False), path, by_day=True)
    after = dict(before)
    for source, region, n in changes:
        value = [c for c in after[source].columns if c not in KEY][0]
        here = (F.col("region") == region) & (F.col("date") == day(n))
        new = after[source].where(here).withColumn(value, F.lit(7.5) + F.col("lat_idx"))
        if source == "chl":  # the day may have had no rows
            new = spark.createDataFrame([(region, day(n), i, j, 7.5 + i) for i in range(5) for j in range(5)], new.schema)
        after[source] = settle(after[source].where(~here).unionByName(new))
    changed = spark.createDataFrame([(s, r, day(n)) for s, r, n in changes], "source string, region string, date date")
    hit = update_features(after, changed, G, path, effort, wind_in_ms=False)
    assert rows_of(sources.read_features(spark, path)) == rows_of(build_features(after, G, effort, wind_in_ms=False))
    days = {(r.region, r.date) for r in hit.collect()}
    assert {(r, day(n)) for _, r, n in changes} <= days and len(days) < 120
    if all(s != "chl" for s, _, _ in changes):
        assert days == {(r, day(n)) for _, r, n in changes}


def test_reach_of_changed_days(spark):
    chl = spark.createDataFrame([("a", day(n)) for n in range(1, 60, 2)], "region string, date date")
    changed = spark.createDataFrame([("chl", "a", day(5)), ("chl", "a", day(6)), ("wav", "b", day(9)), ("chl", "c", day(4))], "source string, region string, date date")
    got = {(r.region, r["first"]): r["last"] for r in affected_days(changed, chl).collect()}
    add = dt.timedelta(days=21)
    # day 6 is new, so it is one of the 13 that follow day 5
    assert got == {("a", day(5)): day(5 + 24) + add, ("a", day(6)): day(7 + 24) + add, ("b", day(9)): day(9), ("c", day(4)): day(4) + add}


def test_folders_of_days_are_pruned_by_lists_of_days(spark, tmp_path):
    sst = made(spark, 6)["sst"]
    sst.write.partitionBy("region", "date").parquet(str(tmp_path / "sst"))
    stored = spark.read.schema(sst.schema).parquet(str(tmp_path / "sst"))
    near = stored.where(F.col("region").isin("a") & F.col("date").isin(day(5)))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01-05" in plan


def test_pixels_that_nest_and_pixels_that_do_not(spark):
    rng = random.Random(3)
    fine = [("a", 0.0125 + 0.025 * i, 44.0125 + 0.025 * j, float(rng.randrange(-90, 20))) for i in range(20) for j in range(20)]
    coarse = [("b", 0.07 * i, 44 + 0.07 * j, float(rng.randrange(-90, 20))) for i in range(8) for j in range(8)]
    pixels = spark.createDataFrame(fine + coarse, "region string, lat double, lon double, elevation double")
    assert {r.region: r.nests for r in op.pixel_spacing(pixels, G).collect()} == {"a": True, "b": False}
    got = op.seabed_by_spacing(pixels, G).cache()
    a, b = pixels.where("region = 'a'"), pixels.where("region = 'b'")
    axes = op.Axis.regular(0.0, 0.07, 8), op.Axis.regular(44.0, 0.07, 8)
    assert rows_of(got.where("region = 'a'")) == rows_of(op.seabed(a, G))
    assert rows_of(got.where("region = 'b'")) == rows_of(op.seabed_interpolated(b, *axes, G))
    assert op.seabed_by_spacing(pixels.limit(0), G).count() == 0
    one = op.pixel_spacing(pixels.limit(1), G).first()
    assert one.nests is False and one.n_lat == 1


def test_bathymetry_is_present_or_missing(spark):
    files = spark.createDataFrame([("/raw/gebco/gebco_2024.nc", 3_000_000), ("/raw/nrt/sst/sst_2024.nc", 10), ("/raw/gebco/a/b.nc", 5)], "path string, bytes long")
    assert tuple(sources.bathymetry_inventory(files).first()) == ("gebco", True, 1, 3.0)
    assert tuple(sources.bathymetry_inventory(files.where("bytes < 9")).first()) == ("gebco", False, 0, 0.0)


def test_whole_answers(spark):
    cells = spark.createDataFrame(
        [("r", day(1), 0, 0, "KHATAR", 25.04, 0.12345, 2.5, 33.33, 71.5, "physics_index", "live", False),
         ("r", day(1), 0, 4, "AMMAAN", None, 1.0, None, 3.0, None, "model", "live", False)],
        SCHEMA + "safety string, sst double, chl double, wave_height_max double, wind_speed_max double, score double, "
        "score_source string, source string, stale boolean")
    points = spark.createDataFrame([("r", 1, 0.04, 44.06), ("r", 2, 0.2, 44.45), ("r", 3, 3.0, 44.0)], "region string, point_id int, lat double, lon double")
    got = {r.point_id: r for r in op.point_answers(points, cells, G).collect()}
    assert set(got) == {1, 2}
    one, two = got[1], got[2]
    assert (one.date, one.source, one.stale, one.lat, one.lon) == (day(1), "live", False, 0.05, 44.05)
    assert one.safety.status == "KHATAR" and one.safety.label.en and one.safety.advice.so and one.fishing_potential == 71.5
    assert one.conditions.asDict() == {"sst": 25.0, "chl": 0.123, "wave_height_max": 2.5, "wind_speed_max": 33.3}
    assert one.model.trained is False and one.model.score_source == "physics_index" and one.model.weights
    assert two.safety.status == "AMMAAN" and two.fishing_potential is None and two.conditions.sst is None and two.model.trained is True
    bare = op.point_answers(points, cells.select(*KEY, "safety"), G).first()
    assert bare.asDict().keys() == {"point_id", "region", "date", "lat", "lon", "safety"}


def test_documents_state_when_they_were_made(spark):
    features = build_features(made(spark, 4), G, wind_in_ms=False)
    at = dt.datetime(2026, 1, 2, 3, 4, 5)
    made_at = score_days(features, G, generated_at=at).payload
    assert {r.generated_at for r in made_at.select("generated_at").collect()} == {at}
    assert "generated_at" not in score_days(features, G).payload.columns
