"""The 'where boats usually go in this month' baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("region", "lat_idx", "lon_idx")


def climatology(
    train: DataFrame, test: DataFrame, label: str = "fished",
    cell: Sequence[str] = CELL, out: str = "climatology",
) -> DataFrame:
    """Score test rows with the label rate of their cell and month in training.

    Backs off to the cell, the month and the whole set where a combination was
    never seen. Training rows are read once: the coarser rates are sums of the
    finer ones. A cell's twelve months travel as one small map, so the test
    side is joined once, on the cell; months and the total are single values.
    """
    fine = train.groupBy(*cell, F.month("date").alias("month")).agg(
        F.sum(F.col(label).cast("long")).alias("hits"),
        F.count(label).alias("n"),
    )

    def rate_map(hits: str, n: str):
        pairs = F.collect_list(F.struct("month", (F.col(hits) / F.col(n)).alias("rate")))
        return F.map_from_entries(pairs)

    per_cell = fine.groupBy(*cell).agg(
        rate_map("hits", "n").alias("_months"),
        (F.sum("hits") / F.sum("n")).alias("_cell"),
    )
    per_month = fine.groupBy("month").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    overall = per_month.agg(
        F.struct(
            rate_map("hits", "n").alias("months"),
            (F.sum("hits") / F.sum("n")).alias("rate"),
        ).alias("all")
    ).scalar()
    month = F.month("date")
    return (
        test.join(per_cell, list(cell), "left")
        .withColumn("_all", overall)
        .withColumn(out, F.coalesce(
            F.try_element_at("_months", month),
            F.col("_cell"),
            F.try_element_at("_all.months", month),
            F.col("_all.rate"),
        ))
        .drop("_months", "_cell", "_all")
    )
