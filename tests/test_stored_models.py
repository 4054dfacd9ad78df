"""A model is served by what its stored validation says."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seagrid import operators as op
from seagrid.sources.models import load_model, save_model

FEATURES = ["chl", "sst_gradient"]


@pytest.mark.parametrize("passed", [True, False, None])
def test_the_stored_gate_decides(spark, tmp_path, passed):
    rows = [("g", dt.date(2020 + k % 3, 1, 1 + k % 9), k % 10, k // 10 % 10, float(k % 7), float(k % 5), int(k % 7 > 4)) for k in range(300)]
    df = spark.createDataFrame(rows, "region string, date date, lat_idx int, lon_idx int, chl double, sst_gradient double, fished int")
    df = df.withColumn("year", F.year("date"))
    model = op.fit_hotspot(df, FEATURES, rounds=2, depth=2)
    notes = spark.range(1).select(F.lit(passed).cast("boolean").alias("beats_baselines"), F.lit(FEATURES).alias("features"))
    metrics = spark.createDataFrame([("hotspot", 0.2), ("climatology", 0.1)], "model string, pr_auc double")
    save_model(model, notes, metrics, str(tmp_path), dt.datetime(2026, 1, 2, 3))

    stored = load_model(spark, str(tmp_path))
    assert stored.features == FEATURES and stored.validated is (passed is True)
    assert stored.notes.trained_at.startswith("2026-01-02T03") and len(stored.notes.metrics) == 2
    scored = op.score_cells(df, stored.model, stored.features, stored.validated)
    assert {r.score_source for r in scored.collect()} == {"model" if passed else "physics_index"}
