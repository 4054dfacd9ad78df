"""Boosted trees looked into: scores after every round, the best round, gains per split.

A stored ensemble is a table of nodes, bounded by rounds and depth. Scores after every
round come from one pass over the rows with that table, and an ensemble is cut to a
round by rewriting what is stored; nothing is fitted again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.functions import half_even
from seagrid.operators.evaluate import ranking_metrics
from seagrid.session import shared_folder

# Rounds without gain on the calibration year before the search ends.
PATIENCE = 30
#: Rounds scored and ranked at a time.
STRIDE = 50
#: Average precision counts as better by more than what orders of adding differ in.
BETTER = 1e-12


class Trees(NamedTuple):
    """Nodes of all trees, one row per tree: the feature of a split (-1 in a leaf), its
    threshold, its children, the value of a leaf; and the weight of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray


def stored(trees: GBTClassificationModel) -> str:
    """Write an ensemble to the shared folder; returns where."""
    path = f"{shared_folder(SparkSession.active())}/trees-{uuid.uuid4().hex}"
    trees.write().overwrite().save(path)
    return path


def node_table(path: str) -> DataFrame:
    """One row per node of a stored ensemble, with its tree's weight."""
    spark = SparkSession.active()
    weights = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("tree_weight"))
    split = F.col("nodeData.split")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), split["featureIndex"].alias("feature"),
        F.get(split["leftCategoriesOrThreshold"], 0).alias("threshold"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.prediction").alias("value"), F.col("nodeData.gain").alias("gain"),
        F.get(F.col("nodeData.impurityStats"), 0).alias("rows"),
    )
    return nodes.join(weights, "tree")


def read_trees(path: str) -> Trees:
    """The nodes as arrays: rounds times 2**(depth + 1) rows at most."""
    rows = node_table(path).orderBy("tree", "node").collect()
    n, width = 1 + max(r.tree for r in rows), 1 + max(r.node for r in rows)
    out = Trees(*(np.full((n, width), -1, np.int64) if kind == "i" else np.zeros((n, width)) for kind in "ifiif"), np.zeros(n))
    for r in rows:
        at = (r.tree, r.node)
        inner = r.left >= 0
        out.feature[at], out.threshold[at] = (r.feature, r.threshold) if inner else (-1, 0.0)
        out.left[at], out.right[at], out.value[at] = r.left, r.right, r.value
        out.weight[r.tree] = r.tree_weight
    return out


def margins(trees: Trees, x: np.ndarray, rounds: int) -> np.ndarray:
    """Sums of the trees' weighted values after each of the first rounds: (rows, rounds)."""
    out = np.zeros((len(x), rounds))
    every = np.arange(len(x))
    for t in range(rounds):
        at = np.zeros(len(x), np.int64)
        while (inner := trees.feature[t, at] >= 0).any():
            here, node = every[inner], at[inner]
            low = x[here, trees.feature[t, node]] <= trees.threshold[t, node]
            at[inner] = np.where(low, trees.left[t, node], trees.right[t, node])
        out[:, t] = trees.value[t, at] * trees.weight[t]
    return np.cumsum(out, 1)


def staged_scores(df: DataFrame, trees: Trees, label: str, first: int, last: int) -> DataFrame:
    """(round, y, score) of every row after each of the rounds first..last (from 1);
    `df` has the vector `_features`."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            found = margins(trees, x, last)[:, first - 1:] if n else np.zeros((0, last - first + 1))
            ends = np.arange(n + 1, dtype=np.int32) * (last - first + 1)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["y", "scores"])

    rows = df.select(F.col(label).cast("double").alias("y"), vector_to_array("_features").alias("x"))
    scored = rows.mapInArrow(score, "y double, scores array<double>")
    return scored.select("y", F.posexplode("scores").alias("round", "score")).withColumn("round", F.col("round") + first)


def precision_by_round(df: DataFrame, trees: Trees, label: str, patience: int = PATIENCE, stride: int = STRIDE) -> list[float | None]:
    """Average precision on `df` after each round, as far as the search looks."""
    total, found = len(trees.weight), []
    while len(found) < total and not _over(found, patience):
        first, last = len(found) + 1, min(total, len(found) + stride)
        ranked = ranking_metrics(staged_scores(df, trees, label, first, last), "y", "score", ["round"])
        of = {r["round"]: r["average_precision"] for r in ranked.collect()}
        found += [of.get(k) for k in range(first, last + 1)]
    return found


def grown(
    growing: GBTClassifier, rows: DataFrame, held: DataFrame, label: str, patience: int = PATIENCE, stride: int = STRIDE,
) -> tuple[GBTClassificationModel, str, list[float | None]]:
    """An ensemble fitted on `rows` as far as the search on `held` looks, where it is
    stored, and its average precision on `held` after each round.

    A round depends on those before it and on the seed alone, so fewer rounds are the
    first of more, and the round kept is the one of a fit of all. The library cannot go
    on from an ensemble: where the search is not over, it is fitted anew with twice the rounds.
    """
    most = growing.getMaxIter()
    n = min(most, stride)
    while True:
        trees = growing.copy({growing.maxIter: n}).fit(rows)
        path = stored(trees)
        precision = precision_by_round(held, read_trees(path), label, patience, stride)
        if n == most or _over(precision, patience):
            return trees, path, precision
        n = min(most, 2 * n)


def best_round(precision: Sequence[float | None], patience: int = PATIENCE) -> int:
    """How many rounds to keep: up to the first with the best average precision, giving
    up after `patience` rounds without gain. Without any precision all are kept."""
    best = None
    for k, value in enumerate(precision):
        if value is None:
            continue
        if best is None or value > precision[best] + BETTER:
            best = k
        elif k - best >= patience:
            break
    return len(precision) if best is None else best + 1


def _over(precision: Sequence[float | None], patience: int) -> bool:
    return any(v is not None for v in precision) and len(precision) - best_round(precision, patience) >= patience


def cut_to(path: str, rounds: int) -> GBTClassificationModel:
    """The first `rounds` trees of a stored ensemble, as an ensemble."""
    spark = SparkSession.active()
    new = f"{path}-{rounds}"
    spark.read.parquet(f"{path}/data").where(F.col("treeID") < rounds).write.parquet(f"{new}/data")
    spark.read.parquet(f"{path}/treesMetadata").where(F.col("_1") < rounds).write.parquet(f"{new}/treesMetadata")
    about = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    about["numTrees"] = about["paramMap"]["maxIter"] = rounds
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{new}/metadata")
    return GBTClassificationModel.load(new)


def split_gains(path: str, features: Sequence[str]) -> DataFrame:
    """Share of every feature in the gains, highest first, where a feature's gain is the
    mean over all splits on it of the squared error that the split removes."""
    spark = SparkSession.active()
    names = spark.createDataFrame(list(enumerate(features)), "feature_no int, feature string")
    splits = node_table(path).where("left >= 0").groupBy(F.col("feature").alias("feature_no")).agg(
        F.avg(F.col("gain") * F.col("rows")).alias("gain"))
    known = names.join(splits, "feature_no", "left").fillna(0.0, ["gain"])
    total = known.agg(F.sum("gain")).scalar()
    share = F.when(total > 0, F.col("gain") / total).otherwise(0.0)
    return known.select("feature", half_even(share, 4).alias("gain_share")).orderBy(F.desc("gain_share"), "feature")
