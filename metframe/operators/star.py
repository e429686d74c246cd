"""Enriched rows to the star schema: three dimensions, systems and two junctions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import rx, text
from metframe.operators import scans

def supported(rows: DataFrame) -> DataFrame:
    return rows.filter(rx.strip(F.col("weather_system")).isin(v.SUPPORTED_SYSTEMS))


def _ids(values: DataFrame, *order: Column) -> DataFrame:
    """Ids 1..n over distinct dimension values, whatever their number."""
    return scans.number_sorted(values, "id", *order).select("id", *values.columns)


def _items(rows: DataFrame, column: str, delimiter: str, name: str) -> DataFrame:
    return rows.select(F.explode(text.split_list(F.col(column), delimiter)).alias(name))


def dim_date(rows: DataFrame) -> DataFrame:
    return _ids(rows.select(F.col("date").alias("entry_date")).distinct(), F.col("entry_date"))


def dim_subdivision(rows: DataFrame, delimiter: str = ";") -> DataFrame:
    return _ids(_items(rows, "subdivisions", delimiter, "name").distinct(), F.col("name"))


def dim_level(rows: DataFrame, delimiter: str = ";") -> DataFrame:
    """Levels by rising hPa; `Surface` has none and comes last."""
    labels = _items(rows, "pressure_level", delimiter, "label").distinct()
    known = labels.withColumn("hpa", text.level_hpa(F.col("label")))
    return _ids(known, F.col("hpa").asc_nulls_last(), F.col("label"))


def fact_system(numbered: DataFrame, dates: DataFrame) -> DataFrame:
    named = dates.select(F.col("id").alias("entry_id"), F.col("entry_date").alias("date"))
    return numbered.join(named, "date").select(
        F.col("system_id").alias("id"), "entry_id", "system_seq", "weather_system"
    )


def _junction(numbered: DataFrame, column: str, delimiter: str, dim: DataFrame, name: str, out: str) -> DataFrame:
    """(system_id, out): listed values looked up in their dimension, duplicates kept."""
    listed = numbered.select("system_id", F.explode(text.split_list(F.col(column), delimiter)).alias(name))
    return listed.join(dim.select(F.col("id").alias(out), name), name).select("system_id", out)


def numbered_rows(rows: DataFrame, position: str) -> DataFrame:
    """Supported rows with system id 1..n in file order and sequence 1..n within their date."""
    kept = supported(rows).select(position, "date", "weather_system", "subdivisions", "pressure_level")
    return scans.number_both(kept, "system_id", "system_seq", ["date"], F.col(f"`{position}`"))


class Star:
    """The six tables of the analytic model from rows (date, weather_system, pressure_level, subdivisions, position).

    Each is worked out when it is first asked for; ids are BIGINT.
    """

    TABLES = ("dim_date", "dim_subdivision", "dim_level", "fact_system", "system_subdivision", "system_level")

    def __init__(self, rows: DataFrame, position: str, delimiter: str = ";") -> None:
        self._rows, self._position, self._delimiter = rows, position, delimiter

    @cached_property
    def numbered(self) -> DataFrame:
        return numbered_rows(self._rows, self._position)  # reads written stages, whichever table asks

    @cached_property
    def dim_date(self) -> DataFrame:
        return dim_date(supported(self._rows))

    @cached_property
    def dim_subdivision(self) -> DataFrame:
        return dim_subdivision(supported(self._rows), self._delimiter)

    @cached_property
    def dim_level(self) -> DataFrame:
        return dim_level(supported(self._rows), self._delimiter)

    @cached_property
    def fact_system(self) -> DataFrame:
        return fact_system(self.numbered, self.dim_date)

    @cached_property
    def system_subdivision(self) -> DataFrame:
        return _junction(self.numbered, "subdivisions", self._delimiter, self.dim_subdivision, "name", "subdivision_id")

    @cached_property
    def system_level(self) -> DataFrame:
        return _junction(self.numbered, "pressure_level", self._delimiter, self.dim_level, "label", "pressure_level_id")

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.TABLES}


def build_star(rows: DataFrame, position: str, delimiter: str = ";") -> Star:
    return Star(rows, position, delimiter)
