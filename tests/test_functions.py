"""Thresholds on, under, over and without a value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seagrid import REGIONS, functions as fn
from seagrid.grid import cell_id
from seagrid.rules import LANDING_SITES


def values(spark, column, rows, names):
    df = spark.createDataFrame(rows, names).withColumn("_out", column)
    return [r["_out"] for r in df.collect()]


def test_grid_sizes(spark):
    assert (REGIONS["somali"].n_lat, REGIONS["somali"].n_lon) == (145, 120)
    assert REGIONS["wide"].n_cells == 55_000
    cells = REGIONS["somali"].cells(spark)
    assert cells.count() == 17_400
    first = cells.where("lat_idx = 0 and lon_idx = 0").first()
    assert (first["lat"], first["lon"], first["cell_id"]) == (-1.95, 40.55, "c_0000_0000")


@pytest.mark.parametrize("region", ["somali", "wide"])
def test_index_undoes_centre(spark, region):
    g = REGIONS[region]
    cells = g.cells(spark)
    back = cells.where(
        (g.lat_idx(F.col("lat")) != F.col("lat_idx")) | (g.lon_idx(F.col("lon")) != F.col("lon_idx"))
    )
    assert back.count() == 0


def test_cell_id_keeps_long_and_negative_numbers(spark):
    ids = values(spark, cell_id(F.col("i"), F.col("j")), [(3, 12345), (-1, 0)], "i int, j int")
    assert ids == ["c_0003_12345", "c_-001_0000"]


def test_safety_thresholds(spark):
    rows = [
        (1.24, 19.9, "AMMAAN"), (1.25, 19.9, "TAXADDAR"), (1.0, 20.0, "TAXADDAR"),
        (2.0, 30.0, "TAXADDAR"), (2.01, 5.0, "KHATAR"), (0.5, 30.1, "KHATAR"),
        (None, 45.0, "LAMA_OGA"), (3.0, None, "LAMA_OGA"),
    ]
    got = values(spark, fn.safety_class(F.col("w"), F.col("v")), rows, "w double, v double, want string")
    assert got == [r[2] for r in rows]


def test_bands_and_reach(spark):
    rows = [(0.0, "0-15"), (14.999, "0-15"), (15.0, "15-35"), (35.0, "35-80"), (80.0, None), (None, None)]
    got = values(spark, fn.coast_band(F.col("km"))["band"], rows, "km double, want string")
    assert got == [r[1] for r in rows]
    reach = [(50.0, 80.0, True), (50.1, 10.0, False), (10.0, 80.1, False), (None, 1.0, False)]
    got = values(spark, fn.reachable(F.col("c"), F.col("s")), reach, "c double, s double, want boolean")
    assert got == [r[2] for r in reach]


def test_navigable_excludes_unknown(spark):
    rows = [(2.0, 30.0, True), (2.1, 1.0, False), (None, 1.0, False), (1.0, None, False)]
    got = values(spark, fn.navigable(F.col("w"), F.col("v")), rows, "w double, v double, want boolean")
    assert got == [r[2] for r in rows]


def test_rating_levels(spark):
    rows = [(70.0, "high"), (69.9, "mid"), (45.0, "mid"), (44.9, "low"), (None, "unknown")]
    got = values(spark, fn.rating(F.col("s"))["level"], rows, "s double, want string")
    assert got == [r[1] for r in rows]


def test_fished_is_strictly_above(spark):
    rows = [(0.5, 0), (0.51, 1), (None, 0)]
    assert values(spark, fn.fished(F.col("h")), rows, "h double, want int") == [0, 1, 0]


def test_half_even_rounds_like_numpy(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate([rng.normal(0, 100, 500), np.arange(-5, 5, 0.05), [0.125, 2.5, 3.5]])
    got = values(spark, fn.half_even(F.col("x"), 1), [(float(x),) for x in xs], "x double")
    assert np.array_equal(np.array(got) + 0.0, np.round(xs, 1) + 0.0)


def test_display_index_is_clipped(spark):
    rows = [(-0.2,), (0.4567,), (1.3,), (None,)]
    assert values(spark, fn.to_index(F.col("p")), rows, "p double") == [0.0, 45.7, 100.0, None]


def test_finite(spark):
    rows = [(float("nan"),), (float("inf"),), (1.5,), (None,)]
    assert values(spark, fn.finite(F.col("x")), rows, "x double") == [None, None, 1.5, None]


def test_snapping_effort(spark):
    rows = [(5.0,), (5.05,), (5.07,), (-1.9,), (-0.1,)]
    edge = values(spark, fn.snap_effort(F.col("x"), 0.1), rows, "x double")
    assert edge == [5.05, 5.05, 5.15, -1.85, -0.05]
    inside = values(spark, fn.snap_effort(F.col("x"), 0.1, "any"), rows, "x double")
    assert inside == [5.05, 5.05, 5.05, -1.85, -0.05]
    with pytest.raises(ValueError):
        fn.snap_effort(F.col("x"), 0.1, "middle")


def test_nearest_site_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-2, 12.5, 200), rng.uniform(40.5, 52.5, 200))]
    got = values(spark, fn.nearest_site(F.col("lat"), F.col("lon")), points, "lat double, lon double")

    def km(lat, lon, site):
        p1, p2 = math.radians(lat), math.radians(site[3])
        a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(
            math.radians(site[4] - lon) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(a))

    for (lat, lon), found in zip(points, got):
        best = min(LANDING_SITES, key=lambda s: km(lat, lon, s))
        assert found["site_id"] == best[0]
        assert found["site_km"] == pytest.approx(km(lat, lon, best), abs=1e-9)


def test_cyclic_month(spark):
    df = spark.sql("select date'2024-01-15' as d union all select date'2024-04-01'")
    rows = df.select(*[c.alias(n) for n, c in fn.cyclic_month(F.col("d")).items()]).collect()
    assert rows[0]["month"] == 1 and rows[0]["month_sin"] == 0.0
    assert rows[1]["month_sin"] == pytest.approx(1.0)
