"""Queries read the tables given once, not once per field or step."""

import datetime as dt

import pytest

from seagrid.checks import queries


@pytest.fixture
def lines(spark, tmp_path):
    """A folder with a few order lines."""
    rows = [(k, k % 23, k % 7, 1 + k % 3, float(1 + k % 50), 900.0 + k, 0.01 * (k % 10), 0.01 * (k % 8), "RAN"[k % 3], "OF"[k % 2],
             dt.datetime(1996 + k % 3, 1 + k % 12, 1)) for k in range(300)]
    kinds = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
             "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def reads(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


def test_model_rows_come_from_stored_planes(spark, lines, monkeypatch):
    found, real = [], queries.settle
    monkeypatch.setattr(queries, "settle", lambda df: found.append(reads(df)) or real(df))
    assert queries._model_table(spark, lines).count() > 0
    assert found == [1, 1]  # the planes; the seabed


class Taken(Exception):
    pass


@pytest.mark.parametrize("name", ["feature_table", "feature_table_by_day", "thinned_build", "incremental_build"])
def test_fields_come_from_one_stored_plane(spark, lines, monkeypatch, name):
    taken, stored, real = {}, [], {k: getattr(queries, k) for k in ("settle", "settle_by_day")}
    monkeypatch.setattr(queries, "settle", lambda df: stored.append(reads(df)) or real["settle"](df))
    monkeypatch.setattr(queries, "settle_by_day", lambda df, n: stored.append(reads(df)) or real["settle_by_day"](df, n))

    def build(fields, *_, **__):
        taken.update(fields)
        raise Taken

    monkeypatch.setattr(queries, "build_features", build)
    with pytest.raises(Taken):
        queries.QUERIES[name](spark, lines)
    assert stored == [1] and len(taken) == 4 and not any(map(reads, taken.values()))
