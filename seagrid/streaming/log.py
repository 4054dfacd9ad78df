"""The daily reduction as a log of mergeable partial sums.

A watermark has to drop what comes too late, and state has to hold every open day.
The log needs neither: each micro-batch is reduced to one row per day and pixel with
counts, sums and maxima, and appended. Reading adds the rows of a key up, so a reading
counts whenever it arrives. Late readings are counted per day, not lost.

An entry is a folder `first=<a>/last=<b>` that covers micro-batches a to b; it counts
once its `_SUCCESS` file is there. Repeating a batch writes the same entry again.
Compaction writes a wider entry beside those it covers, which readers then pass over,
and `vacuum` deletes them. Entries of one level are merged a few at a time, so a row is
rewritten once per level and not with every batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seagrid.functions import to_day


class DailyLog(NamedTuple):
    """Where a log lies and what it reduces. Readings more than `late` days behind
    the newest day of earlier batches count as late."""

    path: str
    variables: tuple[str, ...]
    pixel: tuple[str, ...] = ("lat", "lon")
    time: str = "time"
    late: int = 2

    @property
    def keys(self) -> list[str]:
        return ["date", *self.pixel]


class Entry(NamedTuple):
    first: int
    last: int

    def folder(self, log: DailyLog) -> str:
        return f"{log.path}/first={self.first}/last={self.last}"

    def covers(self, other: Entry) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last


def _files(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _written_entries(spark: SparkSession, log: DailyLog) -> list[Entry]:
    pattern, fs = _files(spark, f"{log.path}/first=*/last=*/_SUCCESS")
    folders = [f.getPath().getParent() for f in fs.globStatus(pattern) or []]
    return sorted(
        Entry(int(f.getParent().getName().split("=")[1]), int(f.getName().split("=")[1])) for f in folders
    )


def entries(spark: SparkSession, log: DailyLog) -> list[Entry]:
    """The entries that count, oldest first: those no wider one covers."""
    found = _written_entries(spark, log)
    return [e for e in found if not any(o.covers(e) for o in found)]


def _sums(log: DailyLog) -> list[Column]:
    """The same additions over readings' partials and over partials of partials."""
    out = [F.sum("n").alias("n"), F.sum("n_late").alias("n_late")]
    for v in log.variables:
        out += [F.sum(f"{v}_n").alias(f"{v}_n"), F.sum(f"{v}_sum").alias(f"{v}_sum"), F.max(f"{v}_max").alias(f"{v}_max")]
    return out


def _merged(df: DataFrame, log: DailyLog) -> DataFrame:
    return df.groupBy(*log.keys).agg(*_sums(log))


def _read(spark: SparkSession, log: DailyLog, chosen: Sequence[Entry]) -> DataFrame:
    return spark.read.parquet(*(e.folder(log) for e in chosen))


def partials(readings: DataFrame, log: DailyLog, newest=None) -> DataFrame:
    """One row per day and pixel: readings, late ones, and count, sum and maximum
    of every variable. Readings without a time stay together as a day of their own."""
    day = to_day(F.col(log.time))
    is_late = F.lit(False) if newest is None else F.coalesce(day < F.date_sub(F.lit(newest), log.late), F.lit(False))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(is_late).alias("n_late")]
    for v in log.variables:
        aggs += [F.count(v).alias(f"{v}_n"), F.sum(F.col(v).cast("double")).alias(f"{v}_sum"), F.max(v).alias(f"{v}_max")]
    return readings.groupBy(day.alias("date"), *log.pixel).agg(*aggs)


def append(batch: DataFrame, batch_id: int, log: DailyLog) -> None:
    """Add one micro-batch; adding it again replaces it."""
    spark = batch.sparkSession
    before = [e for e in entries(spark, log) if e.last < batch_id]
    newest = _read(spark, log, before).agg(F.max("date")).first()[0] if before else None
    rows = partials(batch, log, newest).sortWithinPartitions("date")
    rows.write.mode("overwrite").parquet(Entry(batch_id, batch_id).folder(log))


def run_log(readings: DataFrame, log: DailyLog, checkpoint: str) -> StreamingQuery:
    """Append everything available from a stream of readings. No state is kept,
    and after a failure the last batch is written again."""
    return (
        readings.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: append(batch, batch_id, log))
        .start()
    )


def daily(spark: SparkSession, log: DailyLog) -> DataFrame:
    """`daily_stats` over all readings so far: `<v>_mean` and `<v>_max` per day and pixel."""
    values = []
    for v in log.variables:
        values += [F.try_divide(f"{v}_sum", f"{v}_n").alias(f"{v}_mean"), f"{v}_max"]
    return _merged(_read(spark, log, entries(spark, log)), log).select(*log.keys, *values)


def lateness(spark: SparkSession, log: DailyLog) -> DataFrame:
    """Readings and late readings of each day."""
    rows = _read(spark, log, entries(spark, log))
    return rows.groupBy("date").agg(F.sum("n").alias("n_readings"), F.sum("n_late").alias("n_late"))


def changed_days(spark: SparkSession, log: DailyLog, since: int) -> DataFrame:
    """Days that have readings in a batch after `since`: what to work out again.
    Compaction past `since` widens the answer, never narrows it."""
    new = [e for e in entries(spark, log) if e.last > since]
    if not new:
        return _read(spark, log, entries(spark, log)).select("date").where("false")
    return _read(spark, log, new).select("date").distinct()


def compact(spark: SparkSession, log: DailyLog, width: int = 8) -> None:
    """Merge `width` neighbouring entries of a level into one of the next, as long
    as there are any. A level's entries cover up to `width` times as many batches as
    those of the level below."""
    def level(e: Entry) -> int:
        n, size = 0, width
        while e.last - e.first + 1 >= size:
            n, size = n + 1, size * width
        return n

    while True:
        found = entries(spark, log)
        same = next((found[k:k + width] for k in range(len(found) - width + 1)
                     if len({level(e) for e in found[k:k + width]}) == 1), None)
        if same is None:
            return
        whole = Entry(same[0].first, same[-1].last)
        rows = _merged(_read(spark, log, same), log).sortWithinPartitions("date")
        rows.write.mode("overwrite").parquet(whole.folder(log))


def vacuum(spark: SparkSession, log: DailyLog) -> int:
    """Delete entries that a wider one covers, once no reader uses them any more."""
    kept = set(entries(spark, log))
    gone = [e for e in _written_entries(spark, log) if e not in kept]
    for e in gone:
        path, fs = _files(spark, e.folder(log))
        fs.delete(path, True)
    return len(gone)
