"""Exact ranking metrics over any number of scored rows.

ROC-AUC and average precision need running counts in score order. Rows are
first reduced to one per distinct score and then cut into score ranges; the
running counts are formed inside each range and completed with the totals of
the ranges above. So no task ever sees a whole group, even when a single group
holds most rows, and the metrics stay exact wherever the cuts fall.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.functions import finite, half_even
from seagrid.session import settle

SCORES_PER_RANGE = 1_000_000
LEAST_RANGES = 8


def ranking_metrics(
    df: DataFrame, label: str, score: str, by: Sequence[str] = (),
    scores_per_range: int = SCORES_PER_RANGE,
) -> DataFrame:
    """Per group: n, positives, roc_auc and average_precision, unrounded.

    Rows with a null or infinite score or without a label are left out. Metrics
    are null where only one class is present. Rows without a group are a group.
    """
    by = list(by)
    counts = settle(
        df.select(*by, F.col(label).cast("long").alias("_y"), finite(F.col(score)).alias("_s"))
        .where(F.col("_s").isNotNull() & F.col("_y").isNotNull())
        .groupBy(*by, "_s")
        .agg(F.sum("_y").alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    counts = in_ranges(counts, scores_per_range)

    # At most (groups x ranges) rows; higher ranges come first.
    totals = counts.groupBy(*by, "_range").agg(
        F.sum("pos").alias("range_pos"), F.sum("n").alias("range_n")
    )
    group = Window.partitionBy(*by)
    above = group.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_range",
        F.coalesce(F.sum("range_pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("range_n").over(above), F.lit(0)).alias("n_above"),
    )
    inside = (
        Window.partitionBy(*by, "_range").orderBy(F.desc("_s"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    totals = totals.withColumnsRenamed({c: f"_at_{c}" for c in (*by, "_range")})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in (*by, "_range")])
    running = counts.join(totals, same).withColumns({
        "cpos": F.sum("pos").over(inside) + F.col("pos_above"),
        "cn": F.sum("n").over(inside) + F.col("n_above"),
    })
    neg = F.col("n") - F.col("pos")
    metrics = running.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("positives"),
        F.sum(F.col("pos") * F.col("cpos") / F.col("cn")).alias("_ap"),
        F.sum(neg * (F.col("cpos") - F.col("pos") / 2)).alias("_pairs"),
    )
    negatives = F.col("n") - F.col("positives")
    both = (F.col("positives") > 0) & (negatives > 0)
    return metrics.select(
        *by, "n", "positives",
        (F.col("positives") / F.col("n")).alias("base_rate"),
        F.when(both, F.col("_pairs") / (F.col("positives").cast("double") * negatives)).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("positives")).alias("average_precision"),
    )


def evaluate(
    df: DataFrame, label: str, score: str, name: str | None = None,
    by: Sequence[str] = (), scores_per_range: int = SCORES_PER_RANGE,
) -> DataFrame:
    """Pooled metrics as reported: base rate, ROC-AUC, average precision, lift."""
    m = ranking_metrics(df, label, score, by, scores_per_range)
    ap, base = F.col("average_precision"), F.col("base_rate")
    named = [] if "model" in by else [F.lit(name or score).alias("model")]
    return m.select(
        *named, *by, "n",
        half_even(base, 5).alias("base_rate"),
        half_even(F.col("roc_auc"), 4).alias("roc_auc"),
        half_even(ap, 4).alias("pr_auc"),
        half_even(ap / base, 2).alias("pr_lift"),
    )


def evaluate_within(
    df: DataFrame, label: str, score: str, name: str | None = None,
    group: str = "month", scores_per_range: int = SCORES_PER_RANGE, by: Sequence[str] = (),
) -> DataFrame:
    """Average precision inside each group, then averaged over the groups, for
    each combination of `by` on its own.

    Strips out skill that is only about knowing which groups are busy. Groups
    with one class are left out; each of the others counts the same.
    """
    m = ranking_metrics(df, label, score, [*by, group], scores_per_range).where(
        F.col("average_precision").isNotNull()
    )
    ap = F.col("average_precision")
    named = [] if "model" in by else [F.lit(name or score).alias("model")]
    return m.groupBy(*by).agg(
        F.count(F.lit(1)).alias("months"),
        half_even(F.avg(ap), 4).alias("pr_auc_within_month"),
        half_even(F.avg(ap / F.col("base_rate")), 2).alias("lift_within_month"),
    ).select(*named, "*")


def in_ranges(counts: DataFrame, per_range: int) -> DataFrame:
    """Add `_range`, rising with `_s`, with about `per_range` rows each.

    Any cuts give the same results, so approximate quantiles will do; one number
    per `per_range` distinct scores reaches the driver.
    """
    ranges = max(LEAST_RANGES, math.ceil(counts.count() / per_range))
    at = [k / ranges for k in range(1, ranges)]
    cuts = sorted({c for c in counts.approxQuantile("_s", at, 0.25 / ranges) if math.isfinite(c)}) or [0.0]
    splits = [-math.inf, *cuts, math.inf]
    return Bucketizer(splits=splits, inputCol="_s", outputCol="_range").transform(counts)
