"""Inputs as DataFrames. Paths may be globs; files are combined in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seagrid.functions import finite
from seagrid.sources.schemas import READINGS, effort_payload_schema, effort_schema


# Depths closer than this, in metres, are one level.
LEVEL_M = 0.001
# Fixed value: how Spark names the folder of no value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks missing values in gridded files; Spark sums and orders need
    null instead."""
    floats = [
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: finite(F.col(c)) for c in floats}) if floats else df


def read_readings(
    spark: SparkSession, path: str | Sequence[str], source: str,
    schema: T.StructType | None = None,
) -> DataFrame:
    """All readings of a source, its first depth level only."""
    df = spark.read.schema(schema or READINGS[source]).parquet(
        *([path] if isinstance(path, str) else path)
    )
    return surface(nan_to_null(df))


def surface(df: DataFrame, depth: str = "depth") -> DataFrame:
    """Only the shallowest level; the column goes with it. Files may store the
    same level with different precision: a millimetre is no other level."""
    if depth not in df.columns:
        return df
    top = df.agg(F.min(depth)).scalar()
    return df.where(F.col(depth).isNull() | (F.col(depth) <= top + LEVEL_M)).drop(depth)


def flatten_effort(raw: DataFrame, column: str = "json") -> DataFrame:
    """Effort rows out of raw JSON replies, one column each; absent fields are
    null. Rows come out one by one, so a long reply never has to be regrouped."""
    parsed = raw.select(F.from_json(F.col(column), effort_payload_schema()).alias("p"))
    lists = parsed.select(F.explode("p.entries").alias("entry")).select(
        F.explode(F.map_values("entry")).alias("rows")
    )
    return lists.select(F.inline("rows"))


def read_effort(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """Effort rows written under `year=/month=` folders; a year with none gives
    no rows and hence no labels."""
    schema = effort_schema().add("year", T.IntegerType()).add("month", T.IntegerType())
    df = nan_to_null(spark.read.schema(schema).parquet(path))
    return df if year is None else df.where(F.col("year") == year)


def read_features(
    spark: SparkSession, path: str, region: str | None = None,
    years: Sequence[int] | None = None, columns: Sequence[str] | None = None,
    mode: str | None = None, schema: T.StructType | None = None, by_day: bool = False,
) -> DataFrame:
    """Feature rows of some years with only the columns asked for.

    Region, mode and year are folders, so unwanted ones are not read. Columns
    that older files lack are null. With `schema` (folders included) no footer
    is read to find the columns; without it all of them are. With `by_day` the
    folders are those of `write_features(..., by_day=True)`, however many.
    """
    if by_day:
        df = _day_folders(spark, path, schema)
    else:
        read = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
        df = read.parquet(path)
    for name, wanted in (("region", region), ("mode", mode)):
        if wanted is not None:
            df = df.where(F.col(name) == wanted)
    if years is not None:
        df = df.where(F.col("year").isin([int(y) for y in years]))
    if columns is None:
        return df
    keep = dict.fromkeys([*columns, "region", "year"])
    return df.select(*[
        F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in keep
    ])


def _day_folders(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """All files below `path`, with the values that their folders' names stand for.

    Finding folders of a table takes Spark a time that grows with the square of their
    number, all of it on the driver, so here the names are read off the files' paths.
    A region is a string where `schema` says nothing else.
    """
    kinds = {"region": T.StringType(), "mode": T.StringType(), "year": T.IntegerType(), "day": T.DateType()}
    if schema is not None:
        kinds |= {f.name: f.dataType for f in schema if f.name in kinds}
        read = spark.read.schema(T.StructType([f for f in schema if f.name not in kinds]))
    else:
        read = spark.read.option("mergeSchema", "true")
    df = read.option("recursiveFileLookup", "true").parquet(path)

    def named(folder: str) -> Column:
        text = F.substring_index(F.substring_index("_metadata.file_path", f"/{folder}=", -1), "/", 1)
        # Escaped as a folder and then as part of an address, in which a plus is no blank.
        plain = text
        for _ in range(2):
            plain = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
        return F.nullif(F.when(F.contains(text, F.lit("%")), plain).otherwise(text), F.lit(NO_VALUE)).cast(kinds[folder])

    return df.withColumns({folder: named(folder) for folder in kinds})


def file_listing(df: DataFrame) -> DataFrame:
    """The files behind a file-based DataFrame: path, bytes and rows."""
    return df.groupBy(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")
    ).agg(F.count(F.lit(1)).alias("n_rows"))


def source_inventory(files: DataFrame) -> DataFrame:
    """Per mode and source: number of files, megabytes, first and last label.

    `files` has (path, bytes); a path ends in `<mode>/<source>/<source>_<label>.<ext>`.
    Files with any other path are counted under mode and source `unmatched`.
    """
    shape = r"([^/]+)/([^/]+)/\2_([^/]+?)(?:\.daily)?\.[a-z0-9]+$"
    parts = files.select(
        *[
            F.coalesce(F.nullif(F.regexp_extract("path", shape, k), F.lit("")), F.lit(other)).alias(name)
            for k, name, other in ((1, "mode", "unmatched"), (2, "source", "unmatched"), (3, "label", None))
        ],
        "bytes",
    )
    return parts.groupBy("mode", "source").agg(
        F.count(F.lit(1)).alias("files"),
        (F.sum("bytes") / 1e6).alias("megabytes"),
        F.min("label").alias("first_label"),
        F.max("label").alias("last_label"),
    )


def bathymetry_inventory(files: DataFrame, folder: str = "gebco") -> DataFrame:
    """One row: whether any elevation file lies in `folder`, how many do and how large
    they are. `files` has (path, bytes). Nothing downloads these files, so their absence
    has to be told."""
    own = F.col("path").rlike(rf"(^|/){folder}/[^/]+\.[a-z0-9]+$")
    return files.agg(F.count_if(own).alias("files"), (F.coalesce(F.sum(F.when(own, F.col("bytes"))), F.lit(0)) / 1e6).alias("megabytes")).select(
        F.lit(folder).alias("source"), (F.col("files") > 0).alias("present"), "files", "megabytes")
