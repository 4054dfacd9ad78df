"""Isotonic regression by pooling ranges of scores in tasks.

Pooling adjacent violators inside a range and then pooling the ranges' blocks gives
the same blocks as pooling all scores at once. So each task pools one range of the
sorted scores, and ranges are merged a few at a time; what travels on is blocks, and
only the finished ones, which are the model, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.session import settle

BLOCK = "low double, high double, total double, weight double"
#: Ranges merged by one task.
MERGED = 16


def _pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's sorted blocks; holds what has been pooled so far."""
    done: list[list[float]] = []
    for batch in batches:
        for low, high, total, weight in zip(*(c.to_pylist() for c in batch.columns)):
            while done and done[-1][2] * weight >= total * done[-1][3]:
                before = done.pop()
                low, total, weight = before[0], before[2] + total, before[3] + weight
            done.append([low, high, total, weight])
    columns = list(zip(*done)) or [()] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], ["low", "high", "total", "weight"])


def isotonic_blocks(df: DataFrame, score: str, label: str, weight: str | None = None, ranges: int | None = None) -> DataFrame:
    """(low, high, total, weight) of the blocks on which the non-decreasing least-squares
    fit of `label` over `score` is constant, at total / weight.

    Rows with a null score or label, or a weight that is not above 0, are left out. Equal
    scores are one point. `ranges` is how many tasks pool at first, the session's shuffle
    partitions by default.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    s, y = F.col(score).cast("double"), F.col(label).cast("double")
    points = (
        df.select(s.alias("low"), (y * w).alias("total"), w.alias("weight"))
        .where("low is not null and total is not null and weight > 0")
        .groupBy("low").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))
        .select("low", F.col("low").alias("high"), "total", "weight")
    )
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        dealt = points.repartitionByRange(ranges, "low").sortWithinPartitions("low")
        points = settle(dealt.mapInArrow(_pool, BLOCK))
        if ranges == 1:
            return points
        ranges = -(-ranges // MERGED)


def fit_isotonic(df: DataFrame, score: str, label: str, weight: str | None = None) -> IsotonicRegressionModel:
    """The fit as a model with one boundary at each end of every block. It reads a
    column `score` of plain numbers until told otherwise."""
    blocks = isotonic_blocks(df, score, label, weight)
    ends = F.array_distinct(F.array("low", "high"))
    points = blocks.select(F.explode(ends).alias(score), (F.col("total") / F.col("weight")).alias("_mean"))
    return IsotonicRegression(featuresCol=score, labelCol="_mean").fit(points)
