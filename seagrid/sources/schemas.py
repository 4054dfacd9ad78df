"""Explicit schemas: nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

_POINT = [("time", T.TimestampNTZType()), ("lat", T.DoubleType()), ("lon", T.DoubleType())]
_DEPTH = [("depth", T.DoubleType())]


def _schema(variables: tuple[str, ...], depth: bool = False) -> T.StructType:
    fields = _POINT + (_DEPTH if depth else []) + [(v, T.DoubleType()) for v in variables]
    return T.StructType([T.StructField(n, t) for n, t in fields])


# Columns of each source's readings.
READINGS = {
    "sst": _schema(("analysed_sst",)),
    "chl": _schema(("CHL",)),
    "phy": _schema(("uo", "vo", "thetao"), depth=True),
    "cur": _schema(("uo", "vo"), depth=True),
    "thetao": _schema(("thetao",), depth=True),
    "wav": _schema(("VHM0",)),
    "wnd": _schema(("eastward_wind", "northward_wind")),
}

# The effort columns that are kept.
EFFORT_FIELDS = ("date", "lat", "lon", "hours", "flag", "geartype", "vesselType")
_NUMBERS = ("lat", "lon", "hours")


def effort_schema() -> T.StructType:
    return T.StructType([
        T.StructField(n, T.DoubleType() if n in _NUMBERS else T.StringType())
        for n in EFFORT_FIELDS
    ])


def effort_payload_schema() -> T.StructType:
    """A reply: entries, each mapping a dataset name to a list of rows. Fields
    outside the kept ones (vessel identity) are not even parsed."""
    rows = T.MapType(T.StringType(), T.ArrayType(effort_schema()))
    return T.StructType([T.StructField("entries", T.ArrayType(rows))])
