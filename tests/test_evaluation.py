"""Metrics, sampling and baselines."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seagrid import operators as op


def naive(labels, scores):
    """Pair counting and the step sum, straight from their definitions."""
    y, s = np.array(labels), np.array(scores)
    pos, neg = s[y == 1], s[y == 0]
    if not len(pos) or not len(neg):
        return None, None
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap, seen = 0.0, 0
    for t in sorted(set(s), reverse=True):
        hit = y[s >= t].sum()
        ap += (hit - seen) / len(pos) * hit / (s >= t).sum()
        seen = hit
    return auc, ap


def scored(spark, labels, scores, groups=None):
    groups = [1] * len(labels) if groups is None else groups
    return spark.createDataFrame(
        [(int(g), int(y), None if s is None else float(s)) for g, y, s in zip(groups, labels, scores)],
        "month int, fished int, score double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=40), st.integers(1, 5))
def test_metrics_match_definitions(spark, rows, per_range):
    labels, scores = zip(*rows)
    m = op.ranking_metrics(scored(spark, labels, scores), "fished", "score", scores_per_range=per_range).first()
    auc, ap = naive(labels, scores)
    assert m["n"] == len(rows)
    assert m["roc_auc"] == (None if auc is None else pytest.approx(auc))
    assert m["average_precision"] == (None if ap is None else pytest.approx(ap))


def test_one_group_may_hold_most_rows(spark):
    rng = np.random.default_rng(4)
    n = 6_000
    groups = np.where(rng.random(n) < 0.9, 1, rng.integers(2, 5, n))
    labels, scores = rng.integers(0, 2, n), rng.normal(0, 1, n).round(3)
    df = scored(spark, labels, scores, groups)
    got = {r["month"]: r for r in op.ranking_metrics(df, "fished", "score", ["month"], 100).collect()}
    for g in set(groups.tolist()):
        auc, ap = naive(labels[groups == g], scores[groups == g])
        assert got[g]["roc_auc"] == pytest.approx(auc)
        assert got[g]["average_precision"] == pytest.approx(ap)


def test_extremes(spark):
    perfect = op.evaluate(scored(spark, [1, 1, 0, 0], [4, 3, 2, 1]), "fished", "score", "m").first()
    assert (perfect["roc_auc"], perfect["pr_auc"], perfect["pr_lift"]) == (1.0, 1.0, 2.0)
    tied = op.evaluate(scored(spark, [1, 0, 0, 0], [1, 1, 1, 1]), "fished", "score").first()
    assert (tied["roc_auc"], tied["pr_auc"]) == (0.5, 0.25)
    one = op.evaluate(scored(spark, [1, 1], [1, 2]), "fished", "score").first()
    assert one["roc_auc"] is None and one["n"] == 2
    gaps = op.evaluate(scored(spark, [1, 0, 1], [2, 1, None]), "fished", "score").first()
    assert gaps["n"] == 2 and gaps["roc_auc"] == 1.0


def test_within_month_counts_months_equally(spark):
    df = scored(spark, [1, 0, 0, 1, 0, 1], [2, 1, 1, 1, 2, 5], [1, 1, 1, 2, 2, 3])
    got = op.evaluate_within(df, "fished", "score", "m").first()
    assert (got["months"], got["pr_auc_within_month"]) == (2, 0.75)
    assert got["lift_within_month"] == 2.0  # (3 + 1) / 2


KEY = "region string, date date, lat_idx int, lon_idx int, fished int"


def cell_days(spark, n_days=60, positives=(0, 0), n_cells=40):
    rows = []
    for d in range(n_days):
        for c in range(n_cells):
            hit = positives[0] and (d * n_cells + c) % positives[0] == positives[1]
            rows.append(("r", dt.date(2020, 1, 1) + dt.timedelta(days=d), c // 8, c % 8, int(bool(hit))))
    return spark.createDataFrame(rows, KEY)


def counts(df):
    return {r["fished"]: r["count"] for r in df.groupBy("fished").count().collect()}


def test_thinning_takes_the_exact_quota(spark):
    df = cell_days(spark, positives=(31, 3))
    pos = counts(df)[1]
    assert counts(op.subsample_negatives(df, 4)) == {1: pos, 0: 4 * pos}
    assert counts(op.subsample_negatives(df, 10_000)) == counts(df)
    assert counts(op.subsample_negatives(df, 0)) == {1: pos}


def test_thinning_without_positives(spark):
    df = cell_days(spark)
    assert counts(op.subsample_negatives(df, 7)) == {0: 7}
    assert counts(op.subsample_negatives(df, 7, floor_one=False)) == {}


def test_thinning_is_repeatable_whatever_the_layout(spark):
    df = cell_days(spark, positives=(31, 3))
    a = op.subsample_negatives(df, 4, seed=1)
    b = op.subsample_negatives(df.repartition(7, "lon_idx"), 4, seed=1)
    c = op.subsample_negatives(df, 4, seed=2)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert a.exceptAll(c).count() > 0


def test_thinning_per_period(spark):
    df = cell_days(spark, positives=(31, 3))
    chunk = op.period_chunks(15, "2020-01-01")
    kept = op.subsample_negatives(df, 2, chunk).groupBy(chunk.alias("c")).agg(
        F.sum("fished").alias("p"), F.count("*").alias("n"))
    assert all(r["n"] == 3 * r["p"] for r in kept.collect()) and kept.count() == 4


def test_cap_keeps_every_positive(spark):
    df = cell_days(spark, positives=(4, 0))  # 600 of 2400
    assert counts(op.cap_rows(df, 1_000)) == {1: 600, 0: 600}
    assert counts(op.cap_rows(df, 2_000)) == {1: 600, 0: 1_400}
    assert counts(op.cap_rows(df, 5_000)) == counts(df)


def test_test_years_are_never_thinned(spark):
    df = cell_days(spark, n_days=400, positives=(100, 0), n_cells=8)
    kept = op.thin_training_years(df, 1, end_year=2020)
    per_year = {r["y"]: (r["p"], r["n"]) for r in kept.groupBy(F.year("date").alias("y")).agg(
        F.sum("fished").alias("p"), F.count("*").alias("n")).collect()}
    assert per_year[2020][1] == 2 * per_year[2020][0]
    assert per_year[2021][1] == 34 * 8


def test_calibration_split(spark):
    df = cell_days(spark, n_days=400, positives=(50, 0), n_cells=8)
    core, held = op.calibration_split(df)
    assert held.select(F.min(F.year("date"))).first()[0] == 2021
    assert core.count() + held.count() == df.count()
    same, none = op.calibration_split(core)
    assert none is None and same is core


def test_climatology_backs_off(spark):
    rows = [("r", dt.date(2020, 1, 1), 0, 0, 1), ("r", dt.date(2020, 1, 2), 0, 0, 0),
            ("r", dt.date(2020, 2, 1), 0, 0, 0), ("r", dt.date(2020, 3, 1), 0, 1, 1)]
    train = spark.createDataFrame(rows, KEY)
    test = spark.createDataFrame([
        ("r", dt.date(2024, 1, 9), 0, 0, 0),  # cell and month seen: 1/2
        ("r", dt.date(2024, 5, 9), 0, 0, 0),  # cell seen: 1/3
        ("r", dt.date(2024, 3, 9), 5, 5, 0),  # month seen: 1
        ("r", dt.date(2024, 6, 9), 5, 5, 0),  # neither: 2/4
    ], KEY)
    got = {(r["date"].month, r["lat_idx"]): r["climatology"] for r in op.climatology(train, test).collect()}
    assert got == {(1, 0): 0.5, (5, 0): pytest.approx(1 / 3), (3, 5): 1.0, (6, 5): 0.5}


def test_gate_is_strict(spark):
    def gate(hot, depth, clim):
        rows = [("hotspot", hot), ("depth_only", depth), ("climatology", clim), ("physics_index", 0.99)]
        return op.validation_gate(spark.createDataFrame(rows, "model string, pr_auc_within_month double")).first()

    assert gate(0.3, 0.2, 0.29)["beats_baselines"] is True
    assert gate(0.3, 0.3, 0.2)["beats_baselines"] is False
    missing = gate(None, 0.1, 0.1)
    assert missing["beats_baselines"] is False and missing["beats_depth_only"] is False
