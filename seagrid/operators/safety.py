"""Sea safety per area and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.functions import half_even, safety_class
from seagrid.rules import CAUTION, DANGER, RULES, SAFE, STATUS_TEXT, UNKNOWN, Rules
from seagrid.session import small_table


def classify(df: DataFrame, rules: Rules = RULES, out: str = "safety") -> DataFrame:
    return df.withColumn(
        out, safety_class(F.col("wave_height_max"), F.col("wind_speed_max"), rules)
    )


def state_counts(status: str = "safety") -> list[Column]:
    """Aggregates n_safe, n_caution, n_danger, n_unknown and total."""
    named = (
        (SAFE, "n_safe"), (CAUTION, "n_caution"), (DANGER, "n_danger"), (UNKNOWN, "n_unknown"),
    )
    counts = [F.count_if(F.col(status) == code).alias(name) for code, name in named]
    return [*counts, F.count(status).alias("total")]


def with_headline(counted: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Add the headline `status` and `share_dangerous` to state counts."""
    total = F.col("total")
    danger = F.col("n_danger") / total
    # Both shares are divided first and then added, as the rule is stated.
    uneasy = danger + F.col("n_caution") / total
    unknown = F.col("n_unknown") / total
    headline = (
        F.when(total == 0, UNKNOWN)
        .when(danger >= rules.area_danger_share, DANGER)
        .when(uneasy >= rules.area_caution_share, CAUTION)
        .when(unknown > rules.area_unknown_share, UNKNOWN)
        .otherwise(SAFE)
    )
    return counted.withColumns({
        "status": headline,
        "share_dangerous": F.when(total > 0, half_even(danger, 3)),
    })


def safety_summary(
    df: DataFrame, by: Sequence[str] = ("region", "date"), rules: Rules = RULES,
    status: str = "safety",
) -> DataFrame:
    """Counts per state and the headline: the worst widespread condition."""
    return with_headline(df.groupBy(*by).agg(*state_counts(status)), rules)


def with_status_text(df: DataFrame, status: str = "status") -> DataFrame:
    """Attach labels, colour and advice of a state (a four-row dimension)."""
    text = small_table(
        df.sparkSession, f"{status} label_so label_en color advice_so advice_en", list(STATUS_TEXT)
    )
    return df.join(F.broadcast(text), status, "left")
