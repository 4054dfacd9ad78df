"""Percentile ranks and the physics index built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.functions import half_even
from seagrid.operators.neighbours import DAY_KEYS
from seagrid.rules import RULES, Rules


def pct_rank(col: str, by: Sequence[str] = DAY_KEYS) -> Column:
    """Percentile rank 0-100 among the non-null values of a group.

    Ties share the mean of their ranks. Groups are one day of one region, so a
    window partition holds at most one row per grid cell.
    """
    group = Window.partitionBy(*by)
    upto = group.orderBy(F.col(col).asc_nulls_last())
    # rank() is the first place of a tie, the running count its last.
    place = (F.rank().over(upto) + F.count(col).over(upto)) / F.lit(2.0)
    return F.when(F.col(col).isNotNull(), place / F.count(col).over(group) * 100)


def physics_index(
    df: DataFrame, by: Sequence[str] = DAY_KEYS, rules: Rules = RULES,
    chl: str = "chl", front: str = "sst_gradient", out: str = "physics_index",
) -> DataFrame:
    """Weighted mean of the day's chlorophyll and front ranks, 0-100.

    A missing input leaves its weight out; with neither the index is null.
    """
    ranked = df.withColumns({"_chl": pct_rank(chl, by), "_front": pct_rank(front, by)})
    parts = (("_chl", rules.chl_weight), ("_front", rules.front_weight))
    total = sum(F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in parts)
    weight = sum(F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts)
    index = F.when(weight > 0, half_even(total / weight, 1))
    return ranked.withColumn(out, index).drop("_chl", "_front")
