"""Planes cut into tiles, and ranks from ranges of values, against whole planes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import day
from seagrid import operators as op
from test_planes import G, as_array, gradient, masked, plane


def rows_of(df):
    return sorted(map(str, (r.asDict() for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("size", [1, 4, 7, 100])
def test_gradient_by_tiles(spark, size):
    values = masked(1, 0.15)
    got = as_array(op.sst_gradient_tiled(plane(spark, values), G, size=size), "sst_gradient", values.shape)
    assert np.allclose(got, gradient(values), equal_nan=True)


@pytest.mark.parametrize("size", [3, 8, 100])
@pytest.mark.parametrize("share", [0.3, 0.97])
def test_filling_by_tiles_is_filling(spark, size, share):
    """Also across tiles without any value, and next to cells of other days."""
    df = plane(spark, masked(5, share), name="w").unionByName(plane(spark, masked(6, 0.5), day(2), name="w"))
    df = df.withColumn("other", F.concat_ws("-", "lat_idx", "lon_idx")).repartition(3)
    want, got = op.fill_nearest(df, "w", G, 30.0), op.fill_nearest_tiled(df, "w", G, 30.0, size=size)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_tiles_keep_every_row_once(spark):
    """Repeated cells, cells off the grid, cells and days without a key, and empty tables."""
    rows = [("r", day(1), i, j, 1.0 if j else None, "x") for i in (-9, 0, 24, 60) for j in (-1, 0, 29, 31)] * 2
    rows += [(None, None, 0, 0, 2.0, None), ("r", day(1), None, 3, 2.0, "n"), ("r", None, 3, None, None, "n")]
    schema = "region string, date date, lat_idx int, lon_idx int, w double, note string"
    df = spark.createDataFrame(rows, schema)
    got = op.fill_nearest_tiled(df, "w", G, 30.0, size=4)
    assert rows_of(got.drop("w", "w_estimated")) == rows_of(df.drop("w"))
    assert got.where("w_estimated = 0 and w is null").count() + got.where("w_estimated = 1").count() == df.where("w is null").count()
    assert op.fill_nearest_tiled(df.limit(0), "w", G, 30.0).collect() == []
    assert op.sst_gradient_tiled(df.limit(0), G, "w").collect() == []


@pytest.mark.parametrize("size, share", [(1, 0.3), (4, 0.02), (4, 0.9), (7, 0.3), (100, 0.02)])
def test_coast_by_tiles_is_the_coast(spark, size, share):
    """On two planes: scattered land, and land in one corner with a tile's width of open sea elsewhere."""
    corner = np.ones(masked(1, 0).shape)
    corner[:9, :5], corner[12, 20] = np.nan, np.nan
    cells = plane(spark, masked(11, share)).unionByName(plane(spark, corner, region=None)).where("sst is not null")
    want = {tuple(r)[:3]: r[3] for r in op.distance_to_coast(cells, G).collect()}
    got = op.distance_to_coast_tiled(cells, G, size=size)
    assert got.columns == ["region", "lat_idx", "lon_idx", "dist_coast_km"]
    rows = got.collect()
    assert len(rows) == len(want) and {tuple(r)[:3]: r[3] for r in rows} == want


def test_coast_by_tiles_of_odd_planes(spark):
    """Land in one column only, seas without land, repeated cells, empty tables, the zones' plane."""
    strait = np.ones((25, 30))
    strait[:, 17] = np.nan
    cells = plane(spark, strait).where("sst is not null")
    twice = cells.union(cells).unionByName(plane(spark, np.ones((25, 30)), region="open"))
    want, got = op.distance_to_coast(twice, G), op.distance_to_coast_tiled(twice, G, size=6)
    assert rows_of(got) == rows_of(want)
    assert got.where("region = 'open' and dist_coast_km is null").count() == 750
    assert op.distance_to_coast_tiled(cells.limit(0), G).collect() == []
    days = twice.unionByName(plane(spark, masked(3, 0.5), day(2)).where("sst is not null"))
    keys = ["region", "date"]
    assert rows_of(op.zone_plane(days, G, keys, tile=6)) == rows_of(op.zone_plane(days, G, keys))


def test_open_sea_sends_few_cells(spark, monkeypatch):
    """Far from land, tiles whose bounds are alike send one another next to nothing."""
    from seagrid.operators import tiles

    sizes = []

    def counted(df):
        if "_own" in df.columns:
            sizes.append(df.select(F.max(F.size("_own"))).first()[0])
        return df

    monkeypatch.setattr(tiles, "settle", counted)
    wide = np.ones((25, 30))
    wide[0] = np.nan
    cells = plane(spark, wide).where("sst is not null")
    got = as_array(op.distance_to_coast_tiled(cells, G, size=5), "dist_coast_km", wide.shape)
    assert np.allclose(got[1:], np.arange(1, 25)[:, None] * G.row_km) and sizes == [5]


def test_a_window_never_holds_more_than_a_tile_and_its_halo(spark):
    seen = []

    def work(cells, keys):
        seen.append(cells.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_own").cast("int")).alias("own")).collect())
        return cells

    op.in_tiles(plane(spark, masked(2, 0.0)), ["sst"], (1, 2), work, size=5)
    assert max(r["n"] for r in seen[0]) == 7 * 9 and max(r["own"] for r in seen[0]) == 25
    assert sum(r["own"] for r in seen[0]) == 25 * 30


@pytest.mark.parametrize("per_range", [3, 10, 10**6])
def test_ranks_by_ranges(spark, per_range):
    values = masked(7, 0.2).round(0)
    df = plane(spark, values).unionByName(plane(spark, masked(8, 0.5), day(2)))
    got = op.pct_rank_ranged(df, "sst", "p", per_range=per_range)
    assert rows_of(got) == rows_of(df.withColumn("p", op.pct_rank("sst")))
    whole = op.pct_rank_ranged(plane(spark, values), "sst", "p", by=[], per_range=per_range)
    want = pd.Series(values.ravel()).rank(pct=True).to_numpy().reshape(values.shape) * 100
    assert np.allclose(as_array(whole, "p", values.shape), want, equal_nan=True)


def test_ranks_of_odd_values(spark):
    rows = [("r", 1.0), ("r", float("nan")), ("r", None), ("r", float("inf")), ("r", -0.0), ("r", 0.0), (None, 5.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "region string, x double")
    got = op.pct_rank_ranged(df, "x", "p", by=["region"], per_range=2)
    ranks = {(r.region, str(r.x)): r.p for r in got.collect()}
    assert got.count() == 8
    assert ranks == {("r", "1.0"): 75.0, ("r", "nan"): None, ("r", "None"): None, ("r", "inf"): 100.0,
                     ("r", "-0.0"): 37.5, ("r", "0.0"): 37.5, (None, "5.0"): 75.0}
    assert op.pct_rank_ranged(df.limit(0), "x", "p", by=["region"]).collect() == []


def test_index_by_ranges(spark):
    rows = [("r", day(d), a, b) for d in (1, 2) for a in (1.0, 2.0, 2.0, None) for b in (None, 4.0, 3.0)]
    df = spark.createDataFrame(rows, "region string, date date, chl double, sst_gradient double")
    assert rows_of(op.physics_index_ranged(df, per_range=2)) == rows_of(op.physics_index(df))
