"""Results as files. Every write is safe to repeat."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterable, Sequence
from contextlib import suppress
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from seagrid.operators.serving import select_days
from seagrid.session import settle
from seagrid.sources.readers import NO_VALUE

# Fixed value: leading column order of the feature table.
LEAD_COLUMNS = ("cell_id", "date", "lat", "lon", "lat_idx", "lon_idx")
# Fixed value: what Spark escapes in the folder of a partition value.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
# Where Spark keeps the schema of a file, and how Arrow names codecs that Spark calls otherwise.
SCHEMA_KEY = "org.apache.spark.sql.parquet.row.metadata"
CODECS = {"uncompressed": "none", "lz4_raw": "lz4", "lz4raw": "lz4"}
#: Rows of a folder that a task holds before it writes them.
ROWS_HELD = 100_000


def _lead_first(df: DataFrame) -> DataFrame:
    lead = [c for c in LEAD_COLUMNS if c in df.columns]
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def write_features(df: DataFrame, path: str, mode: str = "historical", by_day: bool = False) -> None:
    """Feature rows by region, mode and year; a rerun replaces the years it
    holds and leaves the others. With `by_day` each day has a folder of its own,
    and a rerun replaces days.

    Rows are gathered by month of a region, and adaptive execution splits
    months above its advisory partition size and joins small ones, so files are
    of bounded size however large a region is. Rows are sorted by day and cell
    within them, so a reader of some days skips most row groups. Files of days are
    written as `_write_tables` says.
    """
    out = _lead_first(df).withColumns({"mode": F.lit(mode), "year": F.year("date"), "_month": F.month("date")})
    folders = ["region", "mode", "year"]
    if by_day:
        out, folders = out.withColumn("day", F.col("date").cast("string")), [*folders, "day"]
    out = out.hint("rebalance", "region", "year", "_month").drop("_month")
    order = ["region", "year", "date", "lat_idx", "lon_idx"]
    root = _mounted(out.sparkSession, path) if by_day else None
    if root is not None:
        _write_tables(out, root, folders, order)
        out.sparkSession.catalog.refreshByPath(path)
        return
    (
        out.sortWithinPartitions(*order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )


def write_daily(payload: DataFrame, path: str) -> None:
    """One compact JSON document per region and day, and the newest day of each
    region again under `latest`. Documents are worked out once."""
    body = F.to_json(F.struct(*[c for c in payload.columns])).alias("value")
    days = settle(payload.select("region", "date", body))
    _write_texts(days, f"{path}/days", ["region", "date"])
    newest = select_days(days, by=["region"])
    _write_texts(newest.drop("date"), f"{path}/latest", ["region"])


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as tasks see it, where it is a mounted one."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _write_texts(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """The lines in `value`, in a folder per combination of `keys` as Spark's writer
    names it; a rerun replaces the folders it holds and leaves the others.

    On mounted folders Hadoop may start a process, chmod, for each folder, file and
    checksum it makes: most of the time of a write into many folders. There tasks
    write the files by themselves, into a hidden folder, and a second pass moves
    them once all are written, so what fails before changes nothing. For other
    stores Spark's writer is used.
    """
    spark, root, run = df.sparkSession, _mounted(df.sparkSession, path), uuid.uuid4().hex
    if root is None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).text(path)
        return
    staged = f"{root}/.staging-{run}"
    os.makedirs(staged)
    rows = df.withColumns({k: F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys})
    texts = rows.select(*keys, F.col("value").cast("binary").alias("value")).sortWithinPartitions(*keys)
    try:
        texts.foreachPartition(_stage(staged, run, keys))
        _publish_all(rows.select(*keys), staged, root, run)
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    spark.catalog.refreshByPath(path)


def _write_tables(df: DataFrame, root: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """Rows as Parquet files in a folder per combination of `keys`, written and moved as
    `_write_texts` does: a rerun replaces the folders it holds and leaves the others.

    Rows stay in their partitions and are sorted there by `order`, by which those of a
    folder must come together. They are worked out once: folders that got files are
    told by the tasks that wrote them.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    columns = [c for c in df.columns if c not in keys]
    named = df.withColumns({k: F.nullif(F.col(k).cast("string"), F.lit("")) for k in keys})
    rows = named.sortWithinPartitions(*order).select(*keys, *columns)
    codec = spark.conf.get("spark.sql.parquet.compression.codec").lower()
    staged = f"{root}/.staging-{run}"
    os.makedirs(staged)
    try:
        stage = _stage_tables(staged, run, len(keys), CODECS.get(codec, codec), df.select(*columns).schema.json())
        _publish_all(settle(rows.mapInArrow(stage, rows.select(*keys).schema)), staged, root, run)
        with open(f"{root}/_SUCCESS", "w"):
            pass
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def _folder(row: Row | dict, keys: Sequence[str]) -> str:
    def shown(value: str | None) -> str:
        return NO_VALUE if value is None else ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", value)

    return "/".join(f"{k}={shown(row[k])}" for k in keys)


def _stage(staged: str, run: str, keys: Sequence[str]) -> Callable[[Iterable[Row]], None]:
    """Rows come sorted by `keys`, so a task has one file per folder, whose name a
    repeated task gives again. Files get that name when they are whole."""
    def write(rows: Iterable[Row]) -> None:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{run}.txt"
        for folder, lines in groupby(rows, lambda row: _folder(row, keys)):
            place = f"{staged}/{folder}"
            unfinished = f"{place}/.{task.taskAttemptId()}-{name}"
            os.makedirs(place, exist_ok=True)
            with open(unfinished, "wb") as file:
                file.writelines((row["value"] or b"") + b"\n" for row in lines)
            os.replace(unfinished, f"{place}/{name}")

    return write


def _stage_tables(staged: str, run: str, n_keys: int, codec: str, about: str) -> Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """As `_stage`; the first `n_keys` columns name the folder. Returns the keys of each
    file once it is whole."""
    def write(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{run}.parquet"
        here, keys, held, n, file = None, None, [], 0, None

        def flush() -> None:
            nonlocal held, n, file
            if file is None:
                os.makedirs(f"{staged}/{here}", exist_ok=True)
                schema = held[0].schema.with_metadata({SCHEMA_KEY: about})
                file = pq.ParquetWriter(f"{staged}/{here}/.{task.taskAttemptId()}-{name}", schema, compression=codec, store_schema=False)
            file.write_table(pa.Table.from_batches(held).replace_schema_metadata({SCHEMA_KEY: about}))
            held, n = [], 0

        def done() -> pa.RecordBatch:
            nonlocal file
            if held:
                flush()
            file.close()
            file = None
            os.replace(f"{staged}/{here}/.{task.taskAttemptId()}-{name}", f"{staged}/{here}/{name}")
            return keys

        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.select(range(n_keys))
            rest = batch.select(range(n_keys, batch.num_columns))
            for first, end in _runs(named):
                own = named.slice(first, 1)
                folder = _folder(own.to_pylist()[0], own.schema.names)
                if folder != here:
                    if here is not None:
                        yield done()
                    here, keys = folder, own
                held.append(rest.slice(first, end - first))
                n += end - first
                if n >= ROWS_HELD:
                    flush()
        if here is not None:
            yield done()

    return write


def _runs(keys: pa.RecordBatch) -> list[tuple[int, int]]:
    """Where rows of the same keys begin and end; empty keys have become null."""
    n, starts = keys.num_rows, np.zeros(keys.num_rows, bool)
    starts[0] = True
    for column in keys.columns:
        text = pc.fill_null(column, "")
        starts[1:] |= pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(starts).tolist()
    return [*zip(at, [*at[1:], n])]


def _publish_all(keys: DataFrame, staged: str, root: str, run: str) -> None:
    # A fixed number, since keys are small and would be joined into one task.
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = keys.columns
    keys.repartition(tasks, *names).distinct().foreachPartition(_publish(staged, root, run, names))


def _publish(staged: str, root: str, run: str, keys: Sequence[str]) -> Callable[[Iterable[Row]], None]:
    """Files of this run, told by their name, take the place of a folder's others.
    A repeated task finds nothing left to move."""
    def move(rows: Iterable[Row]) -> None:
        for row in rows:
            folder = _folder(row, keys)
            source, target = f"{staged}/{folder}", f"{root}/{folder}"
            os.makedirs(target, exist_ok=True)
            for old in [entry for entry in os.scandir(target) if run not in entry.name]:
                with suppress(FileNotFoundError):
                    shutil.rmtree(old.path) if old.is_dir(follow_symlinks=False) else os.remove(old.path)
            with suppress(FileNotFoundError):
                for new in os.listdir(source):
                    if new.startswith("part-"):
                        with suppress(FileNotFoundError):
                            os.replace(f"{source}/{new}", f"{target}/{new}")
            shutil.rmtree(source, ignore_errors=True)

    return move


def write_metrics(df: DataFrame, path: str) -> None:
    """Metrics and model notes as JSON lines."""
    df.write.mode("overwrite").json(path)
