"""Explicit schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

from metframe import vocab as v


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_TEXT, _LONG, _INT, _DOUBLE, _DATE, _TIME = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DateType(), T.TimestampType(),
)
_TEXTS = T.ArrayType(T.StringType())

DOCUMENTS = _struct(("source_file", _TEXT), ("paragraphs", _TEXTS), ("error", _TEXT))
EXTRACTION = _struct(*[(name, _TEXT) for name in v.EXTRACTION_COLUMNS])
ENRICHED = _struct(*[(name, _TEXT) for name in v.ENRICHED_COLUMNS])
ENTRIES = _struct(
    ("id", _LONG), ("entry_date", _DATE), ("weather_system", _TEXT), ("subdivisions", _TEXT),
    ("pressure_level", _TEXT), ("created_at", _TIME), ("updated_at", _TIME),
)
GAZETTEER = _struct(("name", _TEXT), ("lat", _DOUBLE), ("lon", _DOUBLE))
SYSTEM_PART = _struct(("system", _TEXT), ("levels", _TEXTS), ("subdivisions", _TEXTS))
SUBMISSION = _struct(("entry_date", _DATE), ("systems", T.ArrayType(SYSTEM_PART)), ("created_at", _TEXT))
