"""Separating weather and season from fishing choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.functions import navigable
from seagrid.rules import RULES, Rules


def navigable_days(
    df: DataFrame, wave: str = "wave_height_max", wind: str = "wind_speed_max",
    rules: Rules = RULES,
) -> DataFrame:
    """Rows with workable sea; without wave or wind columns all rows stay."""
    if wave not in df.columns or wind not in df.columns:
        return df
    return df.where(navigable(F.col(wave), F.col(wind), rules))


def fleet_active_months(
    df: DataFrame, label: str = "fished", rules: Rules = RULES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Months in which the fleet was present, one row each.

    A month counts when its label rate reaches the rules' minimum. If all
    months have nearly the same rate the labels look balanced by sampling, and
    every month but the known dormant ones counts instead. Works on the twelve
    monthly rates alone.
    """
    rates = df.groupBy(*by, F.month("date").alias("month")).agg(
        F.avg(label).alias("rate")
    )
    year = rates.groupBy(*by).agg(
        F.collect_list(F.struct("month", "rate")).alias("months"),
        (F.max("rate") - F.min("rate")).alias("spread"),
        F.avg("rate").alias("mean"),
    )
    # A mean of zero is taken as one, so all-zero labels read as uniform.
    mean = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    known = F.lit([m for m in range(1, 13) if m not in rules.dormant_months])
    seen = F.transform(
        F.filter("months", lambda m: m["rate"] >= rules.active_min_rate),
        lambda m: m["month"],
    )
    uniform = F.col("spread") < mean * rules.uniform_spread
    return year.select(*by, F.explode(F.when(uniform, known).otherwise(seen)).alias("month"))


def keep_months(df: DataFrame, months: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose month is listed; the list has twelve rows per group."""
    keyed = df.withColumn("_month", F.month("date"))
    listed = months.withColumnRenamed("month", "_month")
    return keyed.join(listed, [*by, "_month"], "left_semi").drop("_month")


def seasonal_profile(df: DataFrame, label: str = "fished") -> DataFrame:
    """Per month: label rate, mean wave, mean chlorophyll and how chlorophyll
    goes with the label."""
    return df.groupBy(F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(label).alias("label_rate"),
        F.avg("wave_height_max").alias("mean_wave"),
        F.avg("chl").alias("mean_chl"),
        F.corr(F.col(label).cast("double"), F.col("chl")).alias("label_chl_corr"),
    )
