"""What is there, what is missing and what to load next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.rules import EXPECTED_SOURCES, RULES, SUBDAILY_SOURCES, TRAINING_SOURCES
from seagrid.session import small_table


def expected_sources(spark: SparkSession, training_only: bool = False) -> DataFrame:
    """The sources each mode should have; `training_only` for regions that are
    never served and need no waves or wind."""
    rows = [
        r for r in EXPECTED_SOURCES if not training_only or r[1] in TRAINING_SOURCES
    ]
    return small_table(spark, "mode source dataset_id variables cadence", rows)


def missing_sources(
    readings: DataFrame, expected: DataFrame, by: Sequence[str] = ("mode", "source"),
) -> DataFrame:
    """Expected sources for which no reading exists."""
    return expected.join(readings.select(*by).distinct(), list(by), "left_anti")


def missing_by_year(
    readings: DataFrame, expected: DataFrame, year: Column | None = None,
) -> DataFrame:
    """Expected (mode, source) pairs absent in a year that has any data."""
    year = F.year("time") if year is None else year
    found = readings.select("mode", "source", year.alias("year")).distinct()
    wanted = found.select("mode", "year").distinct().join(expected, "mode")
    return wanted.join(found, ["mode", "source", "year"], "left_anti")


def coverage_check(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected source: missing variables, observed time span and status.

    `observed` has (mode, source, variable, time); the wanted variables are a
    short list, so the set kept per source is bounded by it.
    """
    wanted = expected.select("mode", "source", F.explode("variables").alias("variable"))
    seen = observed.groupBy("mode", "source", "variable").agg(
        F.min("time").alias("first"), F.max("time").alias("last")
    )
    spans = seen.groupBy("mode", "source").agg(
        F.min("first").alias("first"), F.max("last").alias("last")
    )
    absent = (
        wanted.join(seen, ["mode", "source", "variable"], "left_anti")
        .groupBy("mode", "source")
        .agg(F.sort_array(F.collect_set("variable")).alias("missing_variables"))
    )
    status = (
        F.when(F.col("first").isNull(), "MISSING")
        .when(F.size("missing_variables") > 0, "VARS?")
        .otherwise("OK")
    )
    return (
        expected.select("mode", "source")
        .join(spans, ["mode", "source"], "left")
        .join(absent, ["mode", "source"], "left")
        .withColumn("missing_variables", F.coalesce("missing_variables", F.array().cast("array<string>")))
        .withColumn("status", status)
    )


def clamp_windows(
    requests: DataFrame, bounds: DataFrame, lookback: int = RULES.chl_lookback_days,
    by: Sequence[str] = ("source",), chl: str = "chl",
) -> DataFrame:
    """Fit requested windows (start_day, end_day) into what is published.

    A window that ends after the last published day is moved to end on it,
    keeping its length; it never starts before the first. Chlorophyll windows
    are first stretched back to `lookback` days for its trailing means. Sources
    without known bounds keep their request, and so do historical windows;
    requests without a `mode` are near real time.
    """
    live = F.col("mode") != "historical" if "mode" in requests.columns else F.lit(True)
    span = F.datediff("end_day", "start_day")
    is_chl = live & (F.col("source") == chl) & F.col("first_day").isNotNull()
    joined = requests.join(bounds, list(by), "left").withColumn(
        "_span", F.when(is_chl, F.greatest(span, F.lit(lookback))).otherwise(span)
    ).withColumn(
        "_start", F.when(is_chl, F.date_sub("end_day", F.col("_span"))).otherwise(F.col("start_day"))
    )
    late = live & (F.col("end_day") > F.col("last_day"))
    return joined.select(
        *requests.columns,
        F.when(late, F.greatest("first_day", F.date_sub("last_day", F.col("_span"))))
        .otherwise(F.col("_start")).alias("load_start"),
        F.when(late, F.col("last_day")).otherwise(F.col("end_day")).alias("load_end"),
    )


def calendar_chunks(
    df: DataFrame, start: str = "start_day", end: str = "end_day", unit: str = "month",
) -> DataFrame:
    """Cut windows into calendar years or months, clipped to the window.

    Adds chunk (its label), chunk_start and chunk_end; a window that ends before
    it starts gives nothing.
    """
    if unit == "month":
        step, label = F.expr("interval 1 month"), "yyyy-MM"
        close = F.last_day("_first")
    elif unit == "year":
        step, label = F.expr("interval 1 year"), "yyyy"
        close = F.date_sub(F.add_months("_first", 12), 1)
    else:
        raise ValueError(f"unknown unit {unit!r}")
    opens = F.sequence(F.trunc(start, unit), F.col(end), step)
    return (
        df.where(F.col(start) <= F.col(end))
        .withColumn("_first", F.explode(opens))
        .withColumns({
            "chunk": F.date_format("_first", label),
            "chunk_start": F.greatest(F.col(start), F.col("_first")),
            "chunk_end": F.least(F.col(end), close),
        })
        .drop("_first")
    )


def load_chunks(windows: DataFrame) -> DataFrame:
    """Chunks as each source is loaded: sub-daily sources by month, the others
    by year, and near-real-time windows whole under a label of their own."""
    live = F.col("mode") == "nrt"
    fine = F.col("source").isin(*SUBDAILY_SOURCES)
    whole = windows.where(live).withColumns({
        "chunk": F.concat_ws("_", "start_day", "end_day"),
        "chunk_start": F.col("start_day"), "chunk_end": F.col("end_day"),
    })
    months = calendar_chunks(windows.where(~live & fine), unit="month")
    years = calendar_chunks(windows.where(~live & ~fine), unit="year")
    return whole.unionByName(months).unionByName(years)


def pending_chunks(
    chunks: DataFrame, done: DataFrame, overwrite: bool = False,
    by: Sequence[str] = ("source", "chunk"),
) -> DataFrame:
    """Chunks still to load; all of them when overwriting."""
    if overwrite:
        return chunks
    return chunks.join(done.select(*by).distinct(), list(by), "left_anti")
