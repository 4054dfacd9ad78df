"""Daily documents as files: folders, reruns, odd keys, failures, other stores."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import day
from seagrid import sources
from seagrid.sources.writers import _write_texts

PAYLOAD = "region string, date date, n_cells long"


def files(root) -> dict[str, list[bytes]]:
    """Folder to the contents of its files, hidden ones included."""
    found = {}
    for folder, _, names in os.walk(root):
        for name in sorted(names):
            with open(os.path.join(folder, name), "rb") as f:
                found.setdefault(os.path.relpath(folder, root), []).append(f.read())
    return found


def processes() -> int:
    with open("/proc/stat") as f:
        return int(next(line for line in f if line.startswith("processes")).split()[1])


def test_documents_start_no_processes(spark, tmp_path):
    """Hadoop's writer starts three per document, each counted twice, and leaves a checksum beside it."""
    payload = spark.range(300).select(
        F.concat(F.lit("r"), F.col("id") % 3).alias("region"),
        F.date_add(F.lit(day(1)), (F.col("id") / 3).cast("int")).alias("date"), F.col("id").alias("n_cells"),
    )
    sources.write_daily(payload.limit(3), str(tmp_path / "warm"))
    before = processes()
    sources.write_daily(payload, str(tmp_path / "all"))
    started = processes() - before
    found = files(tmp_path / "all" / "days")
    assert len(found) == 300 and all(len(inside) == 1 for inside in found.values())
    assert sorted(files(tmp_path / "all" / "latest")) == ["region=r0", "region=r1", "region=r2"]
    assert started < 600


def test_rerun_replaces_its_days(spark, tmp_path):
    first = spark.createDataFrame([("a", day(1), 1), ("a", day(2), 2), ("b", day(1), 3)], PAYLOAD)
    second = spark.createDataFrame([("a", day(2), 20), ("c", day(5), 30)], PAYLOAD)
    for payload in (first, second, second):
        sources.write_daily(payload, str(tmp_path))
    days = spark.read.text(f"{tmp_path}/days").select("region", "date", F.get_json_object("value", "$.n_cells").cast("int"))
    assert sorted(map(tuple, days.collect())) == [
        ("a", day(1), 1), ("a", day(2), 20), ("b", day(1), 3), ("c", day(5), 30)]
    latest = spark.read.text(f"{tmp_path}/latest").select("region", F.get_json_object("value", "$.n_cells").cast("int"))
    assert sorted(map(tuple, latest.collect())) == [("a", 20), ("b", 3), ("c", 30)]
    assert sorted(os.listdir(tmp_path / "days")) == ["region=a", "region=b", "region=c"]


def test_files_of_sparks_writer_are_replaced(spark, tmp_path):
    path = f"{tmp_path}/days"
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "region string, value string")
    old.write.partitionBy("region").text(path)
    _write_texts(old.where("region = 'a'").withColumn("value", F.lit("z")), path, ["region"])
    assert sorted(map(tuple, spark.read.text(path).collect())) == [("y", "b"), ("z", "a")]
    assert files(path)["region=a"] == [b"z\n"]


def test_folders_and_lines_are_those_of_sparks_writer(spark, tmp_path):
    names = [None, "", "a/b", "x=1%", "süd 語", "b c", "{[^]}", "q'\"#*:?\\", "tab\tend", "A", "a", "."]
    rows = [(n, d, f"{n} {d} {k} é") for n in names for d in (None, day(1), day(2)) for k in range(2)]
    rows.append(("lone", day(3), None))
    texts = spark.createDataFrame(rows, "region string, date date, value string").repartition(5)
    keys = ["region", "date"]
    texts.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*keys).text(f"{tmp_path}/plain")
    _write_texts(texts, f"{tmp_path}/own", keys)

    def lines(root):
        return {
            folder: sorted(b"".join(inside).splitlines())
            for folder, inside in files(root).items()
        }

    for folder, _, inside in os.walk(tmp_path / "plain"):
        for name in inside:
            if name.endswith(".crc"):
                os.remove(os.path.join(folder, name))
    assert lines(tmp_path / "own") == lines(tmp_path / "plain")
    assert spark.read.text(f"{tmp_path}/own").count() == len(rows)


def test_failed_write_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/days"
    good = spark.createDataFrame([(f"r{k}", "old") for k in range(8)], "region string, value string")
    _write_texts(good, path, ["region"])
    bad = good.withColumn("value", F.when(F.col("region") == "r7", F.raise_error(F.lit("no"))).otherwise(F.lit("new")))
    with pytest.raises(Exception, match="no"):
        _write_texts(bad, path, ["region"])
    assert {r["value"] for r in spark.read.text(path).collect()} == {"old"}
    assert sorted(os.listdir(path)) == [f"region=r{k}" for k in range(8)]


def test_no_documents(spark, tmp_path):
    sources.write_daily(spark.createDataFrame([], PAYLOAD), str(tmp_path))
    assert spark.read.text(f"{tmp_path}/days").count() == 0 and spark.read.text(f"{tmp_path}/latest").count() == 0


def test_paths_with_a_scheme(spark, tmp_path):
    payload = spark.createDataFrame([("a", day(1), 1), ("a", day(2), 2)], PAYLOAD)
    sources.write_daily(payload, f"file://{tmp_path}/with space")
    assert spark.read.text(f"{tmp_path}/with space/days").count() == 2
    # A store that only Hadoop can open gets the same folders from Spark's writer.
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.daily.link./out", f"file://{tmp_path}/mounted")
    os.makedirs(tmp_path / "mounted")
    sources.write_daily(payload, "viewfs://daily/out/docs")
    assert spark.read.text("viewfs://daily/out/docs/days").count() == 2
    assert os.path.isdir(tmp_path / "mounted" / "docs" / "days" / "region=a" / "date=2024-01-02")
