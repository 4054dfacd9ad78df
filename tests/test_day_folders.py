"""Features by day: folders and rows as Spark's writer has them, reruns, failures, reading without finding folders."""

import datetime as dt
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import day
from seagrid import sources
from seagrid.sources import writers

KINDS = ("region string, date date, lat_idx int, lon_idx int, cell_id long, sst double, fished boolean, seen timestamp, "
         "at timestamp_ntz, share decimal(9,3), note string, few array<int>, small short")
STAMP = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)


def row(region, date, i, j, sst=1.5, note="é"):
    from decimal import Decimal

    return (region, date, i, j, 10 * i + j, sst, i % 2 == 0, STAMP.replace(tzinfo=dt.timezone.utc), STAMP, Decimal("1.250"), note, [i, None], j)


def folders(root) -> list[str]:
    return sorted({os.path.relpath(at, root) for at, _, names in os.walk(root) if any(n.endswith(".parquet") for n in names)})


def cells(df):
    return sorted(map(str, df.select("region", "date", "lat_idx", "lon_idx", "sst").collect()))


def processes() -> int:
    with open("/proc/stat") as f:
        return int(next(line for line in f if line.startswith("processes")).split()[1])


def test_day_folders_start_no_processes(spark, tmp_path):
    """Hadoop's writer starts some for each folder and file, and leaves checksums beside them."""
    days = spark.range(300).select(
        F.concat(F.lit("r"), F.col("id") % 3).alias("region"), F.date_add(F.lit(day(1)), (F.col("id") / 3).cast("int")).alias("date"),
        F.lit(1).alias("lat_idx"), F.lit(2).alias("lon_idx"), F.rand(1).alias("sst"))
    sources.write_features(days.limit(3), str(tmp_path / "warm"), by_day=True)
    before = processes()
    sources.write_features(days, str(tmp_path / "all"), by_day=True)
    started = processes() - before
    assert len(folders(tmp_path / "all")) == 300 and started < 600
    assert not [n for _, _, names in os.walk(tmp_path / "all") for n in names if n.endswith(".crc") and "part-" in n]


def test_rows_and_folders_are_those_of_sparks_writer(spark, tmp_path, monkeypatch):
    names = [None, "", "a/b", "x=1%", "süd 語", "b c", "a+b", "{[^]}", "q'\"#*:?\\", "A", "a", "."]
    rows = [row(n, d, i, 0, None if i else 2.5) for n in names for d in (None, day(1), day(40)) for i in range(3)]
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    sources.write_features(df, f"{tmp_path}/own", by_day=True)
    monkeypatch.setattr(writers, "_mounted", lambda *_: None)
    sources.write_features(df, f"{tmp_path}/plain", by_day=True)
    assert folders(tmp_path / "own") == folders(tmp_path / "plain")
    own, plain = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("own", "plain"))
    assert own.schema == plain.schema
    assert sorted(map(str, own.collect())) == sorted(map(str, plain.collect()))
    # Read without finding folders: the same rows, of either writer.
    for at in ("own", "plain"):
        for schema in (None, df.schema):
            found = sources.read_features(spark, f"{tmp_path}/{at}", schema=schema, by_day=True).select(plain.columns)
            assert found.schema["region"].dataType == plain.schema["region"].dataType
            assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    some = sources.read_features(spark, f"{tmp_path}/own", region="x=1%", years=[2024], mode="historical", schema=df.schema, by_day=True)
    assert some.count() == 6 and sources.read_features(spark, f"{tmp_path}/own", years=[2023], by_day=True).count() == 0


def test_rerun_replaces_days_and_leaves_others(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/f"
    with monkeypatch.context() as patch:  # days of Spark's writer are replaced too
        patch.setattr(writers, "_mounted", lambda *_: None)
        sources.write_features(spark.createDataFrame([row("a", day(1), 1, 1), row("a", day(2), 1, 1), row("b", day(1), 1, 1)], KINDS), path, by_day=True)
    again = spark.createDataFrame([row("a", day(2), 3, 3, 9.0), row("c", day(5), 1, 1, 8.0)], KINDS)
    for _ in range(2):
        sources.write_features(again, path, by_day=True)
    want = spark.createDataFrame([row("a", day(1), 1, 1), row("b", day(1), 1, 1), row("a", day(2), 3, 3, 9.0), row("c", day(5), 1, 1, 8.0)], KINDS)
    assert cells(spark.read.parquet(path)) == cells(want) == cells(sources.read_features(spark, path, by_day=True))
    assert not [x for x in os.listdir(path) if x.startswith(".staging")]
    sources.write_features(again, path, mode="nrt", by_day=True)
    assert spark.read.parquet(path).groupBy("mode").count().orderBy("mode").collect() == [("historical", 4), ("nrt", 2)]


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/f"
    good = spark.createDataFrame([row(f"r{k}", day(1), 1, 1) for k in range(8)], KINDS)
    sources.write_features(good, path, by_day=True)
    before = cells(spark.read.parquet(path))
    bad = good.withColumn("sst", F.when(F.col("region") == "r7", F.raise_error(F.lit("no")).cast("double")).otherwise(F.lit(0.0)))
    with pytest.raises(Exception, match="no"):
        sources.write_features(bad, path, by_day=True)
    assert cells(spark.read.parquet(path)) == before and not [x for x in os.listdir(path) if x.startswith(".staging")]


def test_long_days_are_written_in_parts_and_stay_sorted(spark, tmp_path, monkeypatch):
    rows = [row("a", day(1 + k % 2), k // 50, k % 50, float(k)) for k in range(2500)]
    df = spark.createDataFrame(rows, KINDS).coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    monkeypatch.setattr(writers, "ROWS_HELD", 450)
    try:
        stage = writers._stage_tables(f"{tmp_path}/staged", "run", 1, "snappy", df.drop("region").schema.json())
        os.makedirs(f"{tmp_path}/staged")
        batches = df.orderBy("date", "lat_idx", "lon_idx").select(F.col("date").cast("string").alias("day"), "lat_idx", "lon_idx").toArrow().to_batches(100)

        class Here:
            partitionId = taskAttemptId = staticmethod(lambda: 0)

        monkeypatch.setattr(writers.TaskContext, "get", staticmethod(lambda: Here))
        assert [b.to_pylist() for b in stage(iter(batches))] == [[{"day": "2024-01-01"}], [{"day": "2024-01-02"}]]
        file = pq.ParquetFile(f"{tmp_path}/staged/day=2024-01-01/part-00000-run.parquet")
        assert file.num_row_groups == 3 and file.metadata.num_rows == 1250
        read = file.read().to_pylist()
        assert read == sorted(read, key=lambda r: (r["lat_idx"], r["lon_idx"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_no_rows_and_other_stores(spark, tmp_path):
    sources.write_features(spark.createDataFrame([], KINDS), f"{tmp_path}/none", by_day=True)
    assert sources.read_features(spark, f"{tmp_path}/none", schema=spark.createDataFrame([], KINDS).schema, by_day=True).count() == 0
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.features.link./out", f"file://{tmp_path}/mounted")
    os.makedirs(tmp_path / "mounted")
    sources.write_features(spark.createDataFrame([row("a", day(1), 1, 1)], KINDS), "viewfs://features/out/f", by_day=True)
    assert folders(tmp_path / "mounted" / "f") == ["region=a/mode=historical/year=2024/day=2024-01-01"]
    assert sources.read_features(spark, "viewfs://features/out/f", by_day=True).count() == 1
