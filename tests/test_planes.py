"""Operators on one day's plane, against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import day
from seagrid import Grid
from seagrid import operators as op
from seagrid.operators.fill import offsets_within

G = Grid("test", 2.0, 4.5, 45.0, 48.0)  # 25 x 30 cells


def plane(spark, values, date=day(1), region="test", name="sst"):
    """Rows for every cell of a 2-d array; NaN becomes null."""
    rows = [
        (region, date, int(i), int(j), None if math.isnan(v) else float(v))
        for (i, j), v in np.ndenumerate(values)
    ]
    return spark.createDataFrame(rows, f"region string, date date, lat_idx int, lon_idx int, {name} double")


def as_array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("lat_idx", "lon_idx", name).collect():
        if r[name] is not None:
            out[r["lat_idx"], r["lon_idx"]] = r[name]
    return out


def masked(seed, share, shape=(25, 30)):
    rng = np.random.default_rng(seed)
    values = rng.normal(25, 2, shape)
    values[rng.random(shape) < share] = np.nan
    return values


def gradient(values):
    n, m = values.shape
    lat = np.round(G.lat_min + 0.1 * (np.arange(n) + 0.5), 4)
    north = np.gradient(values, 0.1, axis=0) / 111.32
    east = np.gradient(values, 0.1, axis=1) / (111.32 * np.cos(np.radians(lat)))[:, None]
    out = np.sqrt(north**2 + east**2) * 100
    out[np.isnan(values)] = np.nan
    return out


def test_gradient_of_a_tilted_plane(spark):
    i, j = np.meshgrid(np.arange(25), np.arange(30), indexing="ij")
    values = 20 + 0.3 * i + 0.2 * j
    got = as_array(op.sst_gradient(plane(spark, values), G), "sst_gradient", values.shape)
    assert np.allclose(got, gradient(values))


@pytest.mark.parametrize("seed", [1, 2])
def test_gradient_with_gaps(spark, seed):
    values = masked(seed, 0.15)
    got = as_array(op.sst_gradient(plane(spark, values), G), "sst_gradient", values.shape)
    want = gradient(values)
    assert np.array_equal(np.isnan(got), np.isnan(want))
    assert np.allclose(got, want, equal_nan=True)


def test_gradient_does_not_need_land_rows(spark):
    values = masked(3, 0.2)
    dense = plane(spark, values)
    a = as_array(op.sst_gradient(dense, G), "sst_gradient", values.shape)
    b = as_array(op.sst_gradient(op.drop_land(dense), G), "sst_gradient", values.shape)
    assert np.allclose(a, b, equal_nan=True)


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_dense_planes_give_the_same(spark, share):
    values = masked(11, share)
    df = plane(spark, values)
    for name, f in {
        "sst_gradient": lambda d: op.sst_gradient(df, G, dense=d),
        "sst": lambda d: op.fill_nearest(df, "sst", G, 30.0, dense=d),
    }.items():
        a, b = (as_array(f(d), name, values.shape) for d in (False, True))
        assert np.allclose(a, b, equal_nan=True)


def nearest(values, max_km):
    out, flag = values.copy(), np.zeros(values.shape, int)
    near = offsets_within(G, max_km)
    for i, j in zip(*np.nonzero(np.isnan(values))):
        for di, dj in near:
            a, b = i + di, j + dj
            if 0 <= a < values.shape[0] and 0 <= b < values.shape[1] and not np.isnan(values[a, b]):
                out[i, j], flag[i, j] = values[a, b], 1
                break
    return out, flag


def test_search_offsets():
    near = offsets_within(G, 30.0)
    assert len(near) == 20 and (2, 2) not in near and (2, 1) in near
    assert near[0] == (0, -1)  # a column step is shorter than a row step here


@pytest.mark.parametrize("share", [0.3, 0.9, 0.0, 1.0])
def test_fill_nearest(spark, share):
    values = masked(5, share)
    df = op.fill_nearest(plane(spark, values, name="w"), "w", G, 30.0, flag="est")
    want, flag = nearest(values, 30.0)
    assert np.allclose(as_array(df, "w", values.shape), want, equal_nan=True)
    assert np.array_equal(as_array(df, "est", values.shape), flag)


def test_fill_keeps_days_apart(spark):
    empty, full = np.full((25, 30), np.nan), np.full((25, 30), 1.5)
    both = plane(spark, empty, day(1), name="w").unionByName(plane(spark, full, day(2), name="w"))
    filled = op.fill_nearest(both, "w", G, 30.0)
    assert filled.where("date = date'2024-01-01' and w is not null").count() == 0


def coast(ocean):
    land = np.argwhere(~ocean)
    out = np.full(ocean.shape, np.nan)
    for i, j in np.argwhere(ocean):
        if len(land):
            out[i, j] = np.sqrt(
                ((land[:, 0] - i) * G.row_km) ** 2 + ((land[:, 1] - j) * G.col_km) ** 2
            ).min()
    return out


@pytest.mark.parametrize("seed,share", [(1, 0.02), (2, 0.3), (3, 0.8), (4, 0.001)])
def test_distance_to_coast(spark, seed, share):
    rng = np.random.default_rng(seed)
    ocean = rng.random((25, 30)) >= share
    ocean[0, 0] = False
    cells = op.drop_land(plane(spark, np.where(ocean, 1.0, np.nan)))
    got = as_array(op.distance_to_coast(cells, G), "dist_coast_km", ocean.shape)
    assert np.allclose(got, coast(ocean), equal_nan=True)


def test_no_land_means_no_distance(spark):
    got = op.distance_to_coast(plane(spark, np.ones((25, 30))), G)
    assert got.count() == 750 and got.where("dist_coast_km is not null").count() == 0


def test_pct_rank_matches_pandas(spark):
    values = masked(7, 0.2).round(0)  # many ties
    got = as_array(plane(spark, values).withColumn("p", op.pct_rank("sst")), "p", values.shape)
    want = pd.Series(values.ravel()).rank(pct=True).to_numpy().reshape(values.shape) * 100
    assert np.allclose(got, want, equal_nan=True)


def test_pct_rank_small(spark):
    df = spark.createDataFrame(
        [("r", day(1), x) for x in (1.0, 2.0, 2.0, None, 3.0)], "region string, date date, x double"
    ).withColumn("p", op.pct_rank("x"))
    assert sorted((r["x"] or 0, r["p"]) for r in df.collect() if r["p"] is not None) == [
        (1.0, 25.0), (2.0, 62.5), (2.0, 62.5), (3.0, 100.0)
    ]


def test_physics_index_leaves_missing_inputs_out(spark):
    rows = [("r", day(1), 1.0, None), ("r", day(1), None, 4.0), ("r", day(1), 2.0, 2.0), ("r", day(1), None, None)]
    df = op.physics_index(
        spark.createDataFrame(rows, "region string, date date, chl double, sst_gradient double")
    )
    got = {(r["chl"], r["sst_gradient"]): r["physics_index"] for r in df.collect()}
    assert got == {(1.0, None): 50.0, (None, 4.0): 100.0, (2.0, 2.0): 77.5, (None, None): None}


def test_regrid_is_exact_on_bilinear_fields(spark):
    lat, lon = op.Axis.regular(1.9, 0.25, 12), op.Axis.regular(44.9, 0.25, 14)
    rows = [
        ("test", day(1), a, b, 3 + 2 * a - b + 0.5 * a * b) for a in lat.values for b in lon.values
    ]
    field = spark.createDataFrame(rows, "region string, date date, lat double, lon double, v double")
    out = op.regrid_bilinear(field, ["v"], lat, lon, G)
    assert out.count() == G.n_cells
    want = 3 + 2 * G.lat(F.col("lat_idx")) - G.lon(F.col("lon_idx")) + 0.5 * G.lat(
        F.col("lat_idx")) * G.lon(F.col("lon_idx"))
    assert out.where(F.abs(F.col("v") - want) > 1e-9).count() == 0


def test_regrid_edges_and_gaps(spark):
    lat, lon = op.Axis((2.0, 2.2, 2.5)), op.Axis((45.0, 45.3))  # uneven steps
    rows = [("t", day(1), a, b, None if (a, b) == (2.5, 45.3) else 1.0) for a in lat.values for b in lon.values]
    field = spark.createDataFrame(rows, "region string, date date, lat double, lon double, v double")
    got = {(r["lat_idx"], r["lon_idx"]): r["v"] for r in op.regrid_bilinear(field, ["v"], lat, lon, G).collect()}
    assert max(i for i, _ in got) == 4 and max(j for _, j in got) == 2  # nothing outside
    assert got[(1, 1)] == pytest.approx(1.0)
    assert got[(3, 1)] is None  # needs the missing corner


def test_seabed_blocks(spark):
    rng = np.random.default_rng(3)
    n = 24
    rows, want = [], {}
    for i in range(2):
        for j in range(2):
            block = rng.normal(-20, 30, (n, n)).round(2)
            want[(i, j)] = block
            rows += [
                ("test", 2.0 + 0.1 * i + (a + 0.5) / 240, 45.0 + 0.1 * j + (b + 0.5) / 240, float(block[a, b]))
                for a in range(n) for b in range(n)
            ]
    pixels = spark.createDataFrame(rows, "region string, lat double, lon double, elevation double")
    got = {(r["lat_idx"], r["lon_idx"]): r for r in op.seabed(pixels, G).collect()}
    assert set(got) == set(want)
    for key, block in want.items():
        assert got[key]["depth"] == pytest.approx(-block.mean()) if block.mean() < 0 else got[key]["depth"] is None
        assert got[key]["seabed_roughness"] == pytest.approx(block.std())
        assert got[key]["land_fraction"] == pytest.approx((block >= 0).mean())


def test_status_headlines(spark):
    def headline(**counts):
        codes = {"s": "AMMAAN", "c": "TAXADDAR", "d": "KHATAR", "u": "LAMA_OGA"}
        rows = [("r", day(1), codes[k]) for k, n in counts.items() for _ in range(n)]
        df = spark.createDataFrame(rows, "region string, date date, safety string")
        return op.safety_summary(df).first()["status"]

    assert headline(d=15, s=85) == "KHATAR"
    assert headline(d=14, c=16, s=70) == "TAXADDAR"
    assert headline(d=14, c=15, s=71) == "AMMAAN"
    assert headline(u=51, s=49) == "LAMA_OGA"
    assert headline(u=50, s=50) == "AMMAAN"


def test_regridding_keeps_its_partitions(spark):
    """Adaptive execution joins partitions by the size of the readings, which are few; the
    cells they are spread over then met in one task."""
    axis = op.Axis.regular(0.0, 0.5, 4)
    rows = [("a", day(1 + d), 0.5 * i, 0.5 * j, float(d + i * j)) for d in range(40) for i in range(4) for j in range(4)]
    field = spark.createDataFrame(rows, "region string, date date, lat double, lon double, v double")
    out = op.regrid_bilinear(field, ["v"], axis, axis, Grid("r", 0.0, 1.5, 0.0, 1.5))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
    assert out.groupBy(F.spark_partition_id()).count().count() > 1
