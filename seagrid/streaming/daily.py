"""The daily reduction kept up to date from a stream of readings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seagrid.operators.safety import classify


def daily_updates(
    readings: DataFrame, variables: Sequence[str], pixel: Sequence[str] = ("lat", "lon"),
    time: str = "time", late: str = "2 days",
) -> DataFrame:
    """Streaming twin of `daily_stats`, to be run in update mode.

    State is one row per open day and pixel and is dropped once the watermark
    has passed the day. Update mode emits a day as soon as it has readings;
    append mode would hold it back until it closes. Readings later than the
    watermark are dropped; `seagrid.streaming.log` keeps them.
    """
    aggs = []
    for v in variables:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.max(v).alias(f"{v}_max")]
    return (
        # Watermarks need a zoned timestamp; the session runs in UTC.
        readings.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, "1 day").alias("_day"), *pixel)
        .agg(*aggs)
        .select(F.col("_day.start").cast("date").alias("date"), *pixel,
                *[f"{v}_{k}" for v in variables for k in ("mean", "max")])
    )


def safety_updates(daily: DataFrame, wave: str, wind: str) -> DataFrame:
    """Sea state of the updated days."""
    return classify(daily.withColumnsRenamed({wave: "wave_height_max", wind: "wind_speed_max"}))


def run_daily(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available into versioned daily files, to be read
    with `read_merged`."""
    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(batch_writer(path))
        .start()
    )


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that is safe to repeat: every batch has a folder of its
    own, and the newest batch that holds a key counts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch").parquet(path)
        )

    return write


def read_merged(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Newest version of each key among the files `batch_writer` wrote."""
    values = [c for c in df.columns if c not in (*key, "batch")]
    return df.groupBy(*key).agg(
        F.max_by(F.struct(*values), "batch").alias("_v")
    ).select(*key, "_v.*")
