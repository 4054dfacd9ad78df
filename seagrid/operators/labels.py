"""Fishing-effort labels and the reports on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.functions import fished, snap_effort, to_day
from seagrid.grid import Grid
from seagrid.operators.align import KEYS
from seagrid.rules import RULES, Rules


def snapped(effort: DataFrame, grid: Grid, anchor: str = "edge") -> DataFrame:
    """Effort rows with the indices of the cell they belong to."""
    return effort.withColumns({
        "lat_idx": grid.lat_idx(snap_effort(F.col("lat"), grid.res, anchor)),
        "lon_idx": grid.lon_idx(snap_effort(F.col("lon"), grid.res, anchor)),
    })


def effort_cells(
    effort: DataFrame, grid: Grid, anchor: str = "edge",
    keys: Sequence[str] = ("region",),
) -> DataFrame:
    """Fishing hours and number of effort rows per cell-day of the grid.

    `n_vessels` counts rows (one per vessel and day in the reports): vessel
    identities are dropped on load. A crowded cell costs nothing extra, since
    tasks combine their own rows before the shuffle.
    """
    return (
        snapped(effort, grid, anchor)
        .where(grid.contains(F.col("lat_idx"), F.col("lon_idx")))
        .groupBy(*keys, to_day(F.col("date")).alias("date"), "lat_idx", "lon_idx")
        .agg(
            F.sum("hours").alias("fishing_hours"),
            F.count(F.lit(1)).cast("int").alias("n_vessels"),
        )
    )


def join_labels(
    features: DataFrame, effort: DataFrame, keys: Sequence[str] = KEYS,
    rules: Rules = RULES,
) -> DataFrame:
    """Attach effort to cell-days; a cell-day without effort is a true zero.

    Both sides hold one row per key, so no key can be hot.
    """
    return labelled(features.join(effort.select(*keys, "fishing_hours", "n_vessels"), list(keys), "left"), rules)


def labelled(df: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Cell-days that already have their effort, null where there was none, with labels
    as `join_labels` gives them."""
    hours = F.coalesce("fishing_hours", F.lit(0.0))
    return df.withColumns({
        "fished": fished(hours, rules),
        "fishing_hours": hours,
        "n_vessels": F.coalesce("n_vessels", F.lit(0)),
    })


def label_match_report(
    features: DataFrame, effort: DataFrame, keys: Sequence[str] = KEYS,
    by: Sequence[str] = (),
) -> DataFrame:
    """How many effort cell-days meet a feature row; warns below one half."""
    known = features.select(*keys).withColumn("hit", F.lit(True))
    return (
        effort.join(known, list(keys), "left")
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("effort_cell_days"),
            F.count("hit").alias("matched"),
        )
        .withColumn("match_rate", F.try_divide("matched", "effort_cell_days"))
        .withColumn("warn", F.coalesce(F.col("match_rate") < 0.5, F.lit(False)))
    )


def effort_totals(
    effort: DataFrame, grid: Grid, anchor: str = "edge",
) -> DataFrame:
    """One row: effort rows, hours, first and last day, cell-days, cells.

    Distinct counts are taken stepwise (rows to cell-days to cells), each step
    a partial aggregate, rather than by expanding every row per distinct.
    """
    per_cell = (
        snapped(effort, grid, anchor)
        .groupBy("region", to_day(F.col("date")).alias("date"), "lat_idx", "lon_idx")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("hours").alias("hours"))
        .groupBy("region", "lat_idx", "lon_idx")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("hours").alias("hours"),
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
            F.count(F.lit(1)).alias("cell_days"),
        )
    )
    return per_cell.agg(
        F.sum("rows").alias("n_rows"),
        F.sum("hours").alias("hours"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.sum("cell_days").alias("cell_days"),
        F.count(F.lit(1)).alias("cells"),
    )


def effort_shares(effort: DataFrame, by: str = "flag") -> DataFrame:
    """Hours and percentage of all hours per flag; unnamed ones kept apart."""
    hours = effort.groupBy(
        F.coalesce(F.col(by), F.lit("(unknown)")).alias(by)
    ).agg(F.sum("hours").alias("hours"))
    total = hours.agg(F.sum("hours")).scalar()
    return hours.withColumn("share_pct", F.col("hours") / total * 100)


def effort_report(effort: DataFrame, by: str = "flag", top: int = 10) -> DataFrame:
    """The `top` flags by hours."""
    shares = effort_shares(effort, by)
    return shares.orderBy(F.desc("hours"), F.asc(by)).limit(top)


def flag_share(effort: DataFrame, flag: str, by: str = "flag") -> DataFrame:
    """One row: percentage of all hours under one flag; null if it is absent."""
    of_flag = F.sum(F.when(F.col(by) == flag, F.col("hours")))
    return effort.agg((of_flag / F.sum("hours") * 100).alias("share_pct")).withColumn(
        by, F.lit(flag)
    )


def build_report(df: DataFrame, sst: str = "sst") -> DataFrame:
    """Per region and year: rows kept and dropped as land, positives, days.

    Takes the aligned table before land is dropped, with labels attached.
    """
    at_sea = F.col(sst).isNotNull()
    kept_day = F.when(at_sea, F.col("date"))
    return (
        df.groupBy("region", F.year("date").alias("year"))
        .agg(
            F.count_if(at_sea).alias("kept"),
            F.count_if(~at_sea).alias("dropped_land"),
            F.count_if(at_sea & (F.col("fished") == 1)).alias("positives"),
            F.min(kept_day).alias("first_day"),
            F.max(kept_day).alias("last_day"),
        )
        .withColumn("positive_rate", F.try_divide("positives", "kept"))
    )


