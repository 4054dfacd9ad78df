"""Session helper and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "seagrid", cores: str = "*") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording a Python call site per column makes building plans slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def small_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A fixed short table (a dimension, a set of weights) as a local relation,
    so its size is known to the planner. `columns` are names in order."""
    names = columns.replace(",", " ").split()
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r)) for r in rows]))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate files. Only a local
    session without one gets a temporary folder instead."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="seagrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write `df` once as Parquet to the shared checkpoint folder and read it from there.

    Used where a table is read by several later steps: its upstream then runs
    once, a lost executor costs a re-read and not a rerun, and readers prune
    columns and skip row groups. The folder is the cluster's to clean.
    """
    path = f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_by_day(df: DataFrame, buckets: int) -> DataFrame:
    """As `settle`, stored so that all rows of a (region, date) lie in one of `buckets` buckets.

    What works by day on tables of equally many buckets reads them as they lie, without
    an exchange. Only a catalog knows about buckets, so the table gets a name there
    (`seagrid_by_day_...`), and dropping it leaves the files to whoever owns the folder.
    `df` should come laid out by `repartition(buckets, "region", "date")`: then every
    bucket is one file.
    """
    name = f"seagrid_by_day_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.format("parquet").bucketBy(buckets, "region", "date").option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)
