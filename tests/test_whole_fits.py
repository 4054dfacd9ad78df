"""The transfer into a box boosts as many rounds as the operators do; rounds that the search does not come to are not fitted."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from seagrid import operators as op
from seagrid.checks import queries
from seagrid.operators import boosting, models


class Taken(Exception):
    pass


def test_transfer_to_a_box_boosts_all_rounds(spark, tmp_path, monkeypatch):
    rows = [(k, k % 23, k % 7, 1 + k % 3, float(1 + k % 50), 900.0 + k, 0.01 * (k % 10), 0.01 * (k % 8), "RAN"[k % 3], "OF"[k % 2],
             dt.datetime(1996 + k % 6, 1 + k % 12, 1)) for k in range(300)]
    kinds = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
             "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    asked = []

    def asks(sample=0.8, **settings):
        asked.append({"sample": sample, **settings})
        raise Taken

    monkeypatch.setattr(models, "_boosting", asks)
    with pytest.raises(Taken):
        queries.box_transfer(spark, str(tmp_path))
    assert (asked[0]["maxIter"], asked[0]["maxDepth"], asked[0]["stepSize"], asked[0]["sample"]) == (400, 6, 0.05, 0.8)


def made(spark, n, seed, signal):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a, b = rng.random(), rng.random()
        rows.append((a, b, float(rng.random() < ((0.8 if a > 0.6 and b < 0.5 else 0.2) if signal else 0.3))))
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3, "a")
    return VectorAssembler(inputCols=["a", "b"], outputCol="_features").transform(df)


@pytest.mark.parametrize("signal", [True, False])
def test_fits_in_steps_keep_the_round_of_a_fit_of_all(spark, signal):
    fitted, held = made(spark, 600, 1, signal), made(spark, 300, 2, signal)
    growing = GBTClassifier(featuresCol="_features", labelCol="y", maxIter=20, maxDepth=2, stepSize=0.3, subsamplingRate=0.8, seed=1)
    growing.setFeatureSubsetStrategy("0.5")
    whole = boosting.read_trees(boosting.stored(growing.fit(fitted)))
    want = boosting.best_round(boosting.precision_by_round(held, whole, "y", 3), 3)
    trees, path, precision = boosting.grown(growing, fitted, held, "y", patience=3, stride=4)
    n = len(trees.treeWeights)
    assert n in (4, 8, 16, 20) and (n == 20 or len(precision) - boosting.best_round(precision, 3) >= 3)
    assert boosting.best_round(precision, 3) == want
    some = boosting.read_trees(path)
    for ours, all_of in zip(some, whole):
        assert np.allclose(ours, all_of[:n, :ours.shape[1]] if ours.ndim == 2 else all_of[:n])


def test_rounds_behind_the_search_are_not_fitted(spark):
    """Noise in place of a signal: an early round is best."""
    rng = random.Random(6)
    rows = [(f"{2018 + k % 3}-0{1 + k % 9}-01", rng.random(), rng.randrange(2)) for k in range(900)]
    train = spark.createDataFrame(rows, "date string, x double, fished int").withColumn("date", F.to_date("date"))
    most, real = [], GBTClassifier.fit

    def fit(self, df, *params):
        most.append(self.getMaxIter())
        return real(self, df, *params)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(GBTClassifier, "fit", fit)
        model = op.fit_hotspot(train, ["x"], depth=1, step=0.5)
    assert most == [50 * 2 ** k for k in range(len(most))] and most[-1] < 400
    assert len(model.stages[-2].trees) <= most[-1] - boosting.PATIENCE


def test_without_a_year_held_out_all_rounds_are_fitted(spark):
    rng = random.Random(6)
    rows = [(dt.date(2020, 1 + k % 9, 1), rng.random(), rng.randrange(2)) for k in range(100)]
    model = op.fit_hotspot(spark.createDataFrame(rows, "date date, x double, fished int"), ["x"], rounds=55, depth=1)
    assert len(model.stages[-1].trees) == 55
