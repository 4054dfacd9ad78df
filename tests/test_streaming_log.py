"""The log of partial sums: late readings, repeated batches, compaction."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seagrid import operators as op
from seagrid import streaming
from seagrid.streaming import log as lg

SCHEMA = "time timestamp_ntz, pixel long, wave double"


def made(rng, days, n=60):
    return [(dt.datetime(2024, 1, 1, rng.randrange(24)) + dt.timedelta(days=rng.choice(days)), rng.randrange(3),
             rng.choice([None, 0.5, 1.5, 2.5])) for _ in range(n)]


def the_log(tmp_path):
    return streaming.DailyLog(str(tmp_path / "log"), ("wave",), ("pixel",))


def rows_of(df):
    names = ["date", "pixel", "wave_mean", "wave_max"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def same(a, b):
    assert [(x[0], x[1], x[3]) for x in a] == [(y[0], y[1], y[3]) for y in b]
    assert all(x[2] == pytest.approx(y[2]) for x, y in zip(a, b))


def test_late_readings_count(spark, tmp_path):
    """The case that a watermark loses: day 1 and day 2 after day 10 has been seen."""
    log, day = the_log(tmp_path), lambda n, h=0: dt.datetime(2024, 1, n, h)
    streams = ([(day(1), 0, 1.0), (day(10), 0, 1.0)], [(day(1, 5), 0, 9.0), (day(2), 0, 4.0), (day(11), 0, 2.0), (day(9), 0, 3.0)])
    for rows in streams:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        streaming.run_log(stream, log, str(tmp_path / "state")).awaitTermination()
    got = {r.date.day: (r.wave_mean, r.wave_max) for r in streaming.daily(spark, log).collect()}
    assert got == {1: (5.0, 9.0), 2: (4.0, 4.0), 9: (3.0, 3.0), 10: (1.0, 1.0), 11: (2.0, 2.0)}
    late = {r.date.day: (r.n_readings, r.n_late) for r in streaming.lateness(spark, log).collect()}
    assert late == {1: (2, 1), 2: (1, 1), 9: (1, 0), 10: (1, 0), 11: (1, 0)}
    assert {r.date.day for r in streaming.changed_days(spark, log, 0).collect()} == {1, 2, 9, 11}
    assert streaming.changed_days(spark, log, 1).count() == 0


def test_any_batches_in_any_order_equal_one_batch(spark, tmp_path):
    rng, log = random.Random(4), the_log(tmp_path)
    batches = [made(rng, range(k % 3, 9)) for k in range(7)] + [[(None, 1, 2.0), (None, 1, None)]]
    for k, rows in enumerate(batches):
        lg.append(spark.createDataFrame(rows, SCHEMA), k, log)
        if k % 3 == 2:
            streaming.compact(spark, log, 2)
            lg.append(spark.createDataFrame(rows, SCHEMA), k, log)  # a batch repeated after a failure
    whole = op.daily_stats(spark.createDataFrame(sum(batches, []), SCHEMA), ["wave"], ["pixel"])
    same(rows_of(streaming.daily(spark, log)), rows_of(whole))
    before = {(r.date, r.n_readings, r.n_late) for r in streaming.lateness(spark, log).collect()}
    assert sum(n for _, n, _ in before) == sum(map(len, batches))
    streaming.compact(spark, log, 2)
    assert lg.entries(spark, log) == [lg.Entry(0, 7)]
    assert streaming.vacuum(spark, log) > 0 and lg._written_entries(spark, log) == [lg.Entry(0, 7)]
    same(rows_of(streaming.daily(spark, log)), rows_of(whole))
    assert {(r.date, r.n_readings, r.n_late) for r in streaming.lateness(spark, log).collect()} == before


def test_unfinished_entries_do_not_count(spark, tmp_path):
    rng, log = random.Random(5), the_log(tmp_path)
    for k in range(2):
        lg.append(spark.createDataFrame(made(rng, range(4)), SCHEMA), k, log)
    want = rows_of(streaming.daily(spark, log))
    streaming.compact(spark, log, 2)
    path, fs = lg._files(spark, lg.Entry(0, 1).folder(log) + "/_SUCCESS")
    fs.delete(path, False)  # as if the writer had died before it was done
    assert lg.entries(spark, log) == [lg.Entry(0, 0), lg.Entry(1, 1)]
    same(rows_of(streaming.daily(spark, log)), want)
    streaming.compact(spark, log, 2)
    assert lg.entries(spark, log) == [lg.Entry(0, 1)]


def test_levels_bound_how_often_a_row_is_written(spark, tmp_path):
    log = the_log(tmp_path)
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), 0, 1.0)], SCHEMA)
    for k in range(9):
        lg.append(rows, k, log)
        streaming.compact(spark, log, 3)
    assert lg.entries(spark, log) == [lg.Entry(0, 8)]
    assert len(lg._written_entries(spark, log)) == 9 + 3 + 1
    assert streaming.daily(spark, log).agg(F.sum("wave_mean")).first()[0] == 1.0


def test_sea_state_of_updated_days(spark, tmp_path):
    log = streaming.DailyLog(str(tmp_path / "log"), ("wave", "wind"), ("pixel",))
    rows = [(dt.datetime(2024, 1, 1), 0, 0.5, 5.0), (dt.datetime(2024, 1, 1), 1, 0.5, None), (dt.datetime(2024, 1, 1, 3), 0, 2.5, 5.0)]
    lg.append(spark.createDataFrame(rows, SCHEMA + ", wind double"), 0, log)
    states = streaming.safety_updates(streaming.daily(spark, log), "wave_max", "wind_max").collect()
    assert {r.pixel: r.safety for r in states} == {0: "KHATAR", 1: "LAMA_OGA"}
