"""Exact, repeatable thinning and the honest splits.

Which rows stay is decided by a seeded hash of the row key: the k smallest
hashes of a group are kept. Finding the k-th smallest never sorts a group.
Rows are counted per group and hash slice (the top bits), which names the one
slice the quota ends in; only that slice, a small fraction of the group since
hashes spread evenly, is put in order. The result is one cut-off per group and
the final pass is a plain filter against it. The same seed keeps the same rows
however the data is laid out, also after a lost executor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seagrid.grid import Grid
from seagrid.operators.align import KEYS
from seagrid.rules import RULES

SLICE_BITS = 16


def subsample_negatives(
    df: DataFrame, k: int, group: Column | None = None, seed: int = 42,
    floor_one: bool = True, label: str = "fished", key: Sequence[str] = KEYS,
) -> DataFrame:
    """All positives, and up to `k` negatives for each positive of a group.

    `floor_one` treats a group without positives as having one; otherwise it
    keeps no negatives. `group` names a part of the calendar (its cut-offs are
    broadcast, one row each); without it the whole set is one group, and rows
    with a null group are one too. `key` must identify a row.
    """
    pos = F.greatest(F.col("_pos"), F.lit(1)) if floor_one else F.col("_pos")
    return _keep_smallest(df, group, pos * k, seed, label, key)


def cap_rows(
    df: DataFrame, max_rows: int, seed: int = 42, label: str = "fished",
    key: Sequence[str] = KEYS,
) -> DataFrame:
    """At most about `max_rows` rows with every positive kept: negatives get
    the room left over, but never less than the number of positives."""
    pos = F.col("_pos")
    over = pos + F.col("_neg") > max_rows
    room = F.greatest(F.lit(max_rows) - pos, pos)
    return _keep_smallest(df, None, F.when(over, room).otherwise(F.col("_neg")), seed, label, key)


def _keep_smallest(
    df: DataFrame, group: Column | None, quota: Column, seed: int, label: str,
    key: Sequence[str],
) -> DataFrame:
    tagged = df.withColumns({
        "_group": F.lit(0) if group is None else group,
        "_hash": F.xxhash64(F.lit(seed), *key),
    }).withColumn("_slice", F.shiftright("_hash", 64 - SLICE_BITS))
    positive = F.col(label) == 1
    slices = tagged.groupBy("_group", "_slice").agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    whole = Window.partitionBy("_group")
    upto = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    # At most 2**SLICE_BITS rows per group.
    ends = (
        slices.withColumns({
            "_pos": F.sum("pos").over(whole),
            "_neg": F.sum("neg").over(whole),
            "_upto": F.sum("neg").over(upto),
        })
        .withColumn("_quota", quota)
        # The slice in which the quota runs out; none if all negatives fit.
        .where((F.col("_upto") > F.col("_quota")) & (F.col("_upto") - F.col("neg") <= F.col("_quota")))
        .where(F.col("neg") > 0)
        .select("_group", "_slice", (F.col("_quota") - F.col("_upto") + F.col("neg")).alias("_take"))
    )
    order = Window.partitionBy("_group", "_slice").orderBy("_hash", *key)
    # First negative that no longer fits: rows before it in order stay.
    ends = ends.withColumnsRenamed({"_group": "_of", "_slice": "_at"})
    cut = (
        tagged.where(~positive)
        .select("_group", "_slice", "_hash", *key)
        .join(ends, F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_at")))
        .withColumn("_nth", F.row_number().over(order))
        .where(F.col("_nth") == F.col("_take") + 1)
        .select(F.col("_group").alias("_of"), F.struct("_hash", *key).alias("_cut"))
    )
    # One row per group. Groups are parts of the calendar (years, 15-day
    # chunks) or the whole set, so their number does not grow with the rows.
    kept = tagged.join(F.broadcast(cut), F.col("_group").eqNullSafe(F.col("_of")), "left").where(
        positive | F.col("_cut").isNull() | (F.struct("_hash", *key) < F.col("_cut"))
    )
    return kept.select(*df.columns)


def period_chunks(days: int = 15, start: str = "1970-01-01") -> Column:
    """Group number of a row's date in chunks of `days` days."""
    return F.floor(F.datediff(F.col("date"), F.lit(start).cast("date")) / days)


def thin_training_years(
    df: DataFrame, k: int, end_year: int = RULES.train_end_year, seed: int = 42,
    label: str = "fished", key: Sequence[str] = KEYS,
) -> DataFrame:
    """Thin negatives within each training year; test years stay whole, so
    their base rate is the true one."""
    train, test = temporal_split(df, end_year)
    thinned = subsample_negatives(
        train, k, F.year("date"), seed, floor_one=False, label=label, key=key
    )
    return thinned.unionByName(test)


def temporal_split(
    df: DataFrame, end_year: int = RULES.train_end_year,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): years up to `end_year`, and the years after it."""
    year = F.year("date")
    return df.where(year <= end_year), df.where(year > end_year)


def calibration_split(
    train: DataFrame, label: str = "fished",
) -> tuple[DataFrame, DataFrame | None]:
    """(core, calibration): the last training year is set aside.

    Without an earlier year holding both classes everything is core and there
    is no calibration part.
    """
    years = (
        train.groupBy(F.year("date").alias("year"))
        .agg(F.min(label).alias("low"), F.max(label).alias("high"))
        .collect()  # one row per year
    )
    if not years:
        return train, None
    last = max(r["year"] for r in years)
    before = [r for r in years if r["year"] < last]
    if not before or min(r["low"] for r in before) == max(r["high"] for r in before):
        return train, None
    return train.where(F.year("date") < last), train.where(F.year("date") == last)


def exclude_box(df: DataFrame, box: Grid) -> DataFrame:
    """Rows outside a box (its edges count as inside)."""
    return df.where(~box.in_box(F.col("lat"), F.col("lon")))


def holdout_band(
    df: DataFrame, band: tuple[float, float] = RULES.holdout_lat,
) -> tuple[DataFrame, DataFrame]:
    """(outside, inside) a latitude band, edges inside."""
    within = F.col("lat").between(*band)
    return df.where(~within), df.where(within)
