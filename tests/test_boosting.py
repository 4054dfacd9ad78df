"""Boosting looked into, and isotonic fits, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from seagrid import operators as op
from seagrid.operators import boosting


@pytest.fixture(scope="module")
def grown(spark):
    """An ensemble, where it is stored, and rows it was not fitted on."""
    rng = random.Random(3)

    def rows(n):
        out = []
        for _ in range(n):
            a, b, c = rng.randrange(30), rng.random() * 8, rng.choice([-9999.0, 1.0, 2.0])
            out.append((float(a), b, c, float(rng.random() < (0.7 if a > 20 and b < 4 else 0.2))))
        return VectorAssembler(inputCols=["a", "b", "c"], outputCol="_features").transform(
            spark.createDataFrame(out, "a double, b double, c double, y double"))

    trees = GBTClassifier(featuresCol="_features", labelCol="y", maxIter=12, maxDepth=3, stepSize=0.3, subsamplingRate=0.8, seed=1)
    model = trees.fit(rows(1500))
    return model, boosting.stored(model), rows(400)


def walk(node, x):
    """A row's way through a tree of the library, node by node."""
    while node.subtreeDepth() > 0:
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def plain_precision(pairs):
    pos, seen, hits, total = sum(y for _, y in pairs), 0, 0, 0.0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        own = [y for t, y in pairs if t == s]
        seen, hits = seen + len(own), hits + sum(own)
        total += sum(own) * hits / seen
    return total / pos


def test_scores_after_every_round(grown):
    model, path, df = grown
    trees = boosting.read_trees(path)
    rows = df.select("y", vector_to_array("_features").alias("x")).collect()
    roots = [t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode") for t in model.trees]
    want = np.cumsum([[w * walk(t, r.x) for t, w in zip(roots, model.treeWeights)] for r in rows[:60]], 1)
    assert np.allclose(boosting.margins(trees, np.array([r.x for r in rows[:60]]), 12), want)
    some = boosting.staged_scores(df, trees, "y", 5, 9)
    assert {r["round"] for r in some.collect()} == {5, 6, 7, 8, 9} and some.count() == 5 * 400
    probability = model.transform(df).select(vector_to_array("probability")[1].alias("p")).collect()
    assert np.allclose([1 / (1 + math.exp(-2 * m)) for m in boosting.margins(trees, np.array([r.x for r in rows]), 12)[:, -1]], [r.p for r in probability])


def test_kept_round_equals_a_plain_loop(grown):
    _, path, df = grown
    trees = boosting.read_trees(path)
    rows = df.select("y", vector_to_array("_features").alias("x")).collect()
    scores = boosting.margins(trees, np.array([r.x for r in rows]), 12)
    want = [plain_precision([(s, r.y) for s, r in zip(scores[:, k], rows)]) for k in range(12)]
    for stride in (5, 50):
        assert boosting.precision_by_round(df, trees, "y", stride=stride) == pytest.approx(want)
    kept = boosting.best_round(want)
    assert kept == 1 + max(range(12), key=lambda k: want[k])
    # with little patience it looks no further than it must
    short = boosting.precision_by_round(df, trees, "y", patience=1, stride=1)
    assert boosting.best_round(short, 1) == boosting.best_round(want, 1) and len(short) <= boosting.best_round(want, 1) + 1


def test_best_round():
    assert boosting.best_round([0.1, 0.2, 0.15, 0.3, 0.25]) == 4
    assert boosting.best_round([0.5, *[0.4] * 30, 0.9]) == 1 and boosting.best_round([0.5, *[0.4] * 29, 0.9]) == 31
    assert boosting.best_round([0.5, 0.5, 0.5 + 1e-15]) == 1 and boosting.best_round([0.3]) == 1
    assert boosting.best_round([None, None]) == 2 and boosting.best_round([None, 0.1, 0.2]) == 3


def test_a_cut_ensemble_is_its_first_trees(grown):
    model, path, df = grown
    trees = boosting.read_trees(path)
    x = np.array([r.x for r in df.select(vector_to_array("_features").alias("x")).collect()])
    for kept in (1, 7):
        cut = boosting.cut_to(path, kept)
        assert len(cut.trees) == kept and cut.treeWeights == model.treeWeights[:kept] and cut.getMaxIter() == kept
        got = cut.transform(df).select(vector_to_array("probability")[1].alias("p")).collect()
        assert np.allclose([r.p for r in got], 1 / (1 + np.exp(-2 * boosting.margins(trees, x, kept)[:, -1])))


def test_gains_equal_a_walk_over_all_splits(grown):
    model, path, _ = grown
    gains = {}

    def visit(node):
        if node.subtreeDepth() > 0:
            gains.setdefault(node.split().featureIndex(), []).append(node.gain() * node.impurityStats().stats()[0])
            visit(node.leftChild())
            visit(node.rightChild())

    for t in model.trees:
        visit(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"))
    means = {k: sum(g) / len(g) for k, g in gains.items()}
    names = ["a", "b", "c", "never"]
    want = {n: round(means.get(k, 0.0) / sum(means.values()), 4) for k, n in enumerate(names)}
    got = boosting.split_gains(path, names).collect()
    assert {r.feature: r.gain_share for r in got} == pytest.approx(want, abs=1e-4) and got[-1].feature == "never"
    assert [r.gain_share for r in got] == sorted((r.gain_share for r in got), reverse=True)


def test_the_model_kept_is_the_one_served(spark):
    """Noise in place of a signal: the first rounds are best, later ones are cut, and the calibrator fits the cut model."""
    rng = random.Random(6)
    rows = [(f"{2018 + k % 3}-0{1 + k % 9}-01", rng.random(), rng.randrange(2)) for k in range(900)]
    train = spark.createDataFrame(rows, "date string, x double, fished int").withColumn("date", F.to_date("date"))
    model = op.fit_hotspot(train, ["x"], rounds=8, depth=2, step=0.5)
    trees, calibrator = model.stages[-2], model.stages[-1]
    held = train.where(F.year("date") == 2020)
    whole = model.transform(held).select("fished", vector_to_array("_probability")[1].alias("p"), "_calibrated").collect()
    blocks = {}
    for r in whole:
        blocks.setdefault(r._calibrated, []).append(r.fished)
    assert len(trees.trees) <= 8 and calibrator.boundaries.size > 0
    assert all(sum(b) / len(b) == pytest.approx(c) for c, b in blocks.items())


# ------------------------------------------------------------ isotonic


def made(spark, n, ties, seed):
    rng = random.Random(seed)
    rows = [(float(rng.randrange(ties)) if ties else rng.random(), float(rng.random() < 0.5), rng.choice([0.5, 1.0, 3.0])) for _ in range(n)]
    return spark.createDataFrame(rows, "s double, y double, w double").repartition(5)


@pytest.mark.parametrize("n,ties,weighted", [(1, 0, False), (300, 0, False), (300, 25, True), (200, 0, True), (300, 1, True)])
def test_fit_equals_the_library_on_all_scores(spark, n, ties, weighted):
    df = made(spark, n, ties, n + ties)
    weight = "w" if weighted else None
    theirs = IsotonicRegression(featuresCol="s", labelCol="y", **({"weightCol": "w"} if weighted else {})).fit(df)
    ours = op.fit_isotonic(df, "s", "y", weight)
    at = df.select("s").union(spark.createDataFrame([(x / 7,) for x in range(-5, 190)], "s double"))
    want = {r.s: r.prediction for r in theirs.transform(at).collect()}
    got = {r.s: r.prediction for r in ours.transform(at).collect()}
    assert want.keys() == got.keys() and all(got[s] == pytest.approx(p) for s, p in want.items())


def test_blocks_do_not_depend_on_the_ranges(spark):
    df = made(spark, 400, 90, 2)
    blocks = [sorted(tuple(r) for r in op.isotonic_blocks(df, "s", "y", "w", ranges).collect()) for ranges in (1, 3, 40)]
    for other in blocks[1:]:
        assert len(other) == len(blocks[0]) and np.allclose(other, blocks[0])
    means = [t / w for _, _, t, w in blocks[0]]
    assert means == sorted(means) and len(set(means)) == len(means) > 1


def test_rows_that_say_nothing_are_left_out(spark):
    rows = [(None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, 0.0), (2.0, 0.0, None), (3.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "s double, y double, w double")
    assert [tuple(r) for r in op.isotonic_blocks(df, "s", "y", "w").collect()] == [(3.0, 3.0, 2.0, 2.0)]
    assert op.isotonic_blocks(df.where("false"), "s", "y").count() == 0
