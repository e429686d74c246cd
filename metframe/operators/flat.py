"""The flat entries table: reload, append, update and delete as DataFrame steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metframe.functions import levels, rx, text
from metframe.operators import scans

EDITABLE = ["entry_date", "weather_system", "subdivisions", "pressure_level"]


ENTRY = ["id", "entry_date", "weather_system", "subdivisions", "pressure_level", "created_at", "updated_at"]


def _inserted(rows: DataFrame, position: str, above: Column, at: Column | None) -> DataFrame:
    """Rows as the table takes them in: ids that go on from `above` in order of position, and both times."""
    made = F.current_timestamp() if at is None else at
    numbered = scans.number_rows(rows, "id", position)
    return numbered.withColumns({"id": F.col("id") + above, "created_at": made, "updated_at": made}).select(*ENTRY)


def reload_strict(rows: DataFrame, position: str, at: Column | None = None) -> DataFrame:
    """Rows of the reloaded table: unknown dates end the job, blank systems are left out,
    blank texts become NULL, ids run from 1 in file order, `at` (now) is when they were made."""
    dated = rows.withColumn("entry_date", text.strict_date(F.col("date")))
    kept = dated.select(
        position, "entry_date", rx.strip(F.coalesce("weather_system", F.lit(""))).alias("weather_system"),
        text.blank_to_null(F.col("pressure_level")).alias("pressure_level"),
        text.blank_to_null(F.col("subdivisions")).alias("subdivisions"),
    ).filter(F.col("weather_system") != "")
    return _inserted(kept, position, F.lit(0), at)


def read_lenient(rows: DataFrame, position: str) -> DataFrame:
    """Imported rows with `outcome`: skipped (no date by form), failed (no such day), inserted."""
    shape = text.lenient_date_text(F.col("date"))
    blank = F.lit("")
    level = levels.surface_default(
        text.php_trim(F.coalesce("pressure_level", blank)), text.php_trim(F.coalesce("height_km", blank))
    )

    def given(value):
        return F.when(~value.isin("", "0"), value)

    day = shape.try_cast("date")
    return rows.select(
        position, day.alias("entry_date"),
        text.php_trim(F.coalesce("weather_system", blank)).alias("weather_system"),
        given(text.php_trim(F.coalesce("subdivisions", blank))).alias("subdivisions"),
        given(level).alias("pressure_level"),
        F.when(shape.isNull(), F.lit("skipped")).when(day.isNull(), F.lit("failed")).otherwise(F.lit("inserted")).alias("outcome"),
    )


def reload_lenient(rows: DataFrame, position: str, at: Column | None = None) -> DataFrame:
    """Rows of the reloaded table; rows without a readable date are left out."""
    kept = read_lenient(rows, position).filter(F.col("outcome") == "inserted")
    return _inserted(kept, position, F.lit(0), at)


def import_counts(rows: DataFrame, position: str) -> DataFrame:
    """One row: how many rows were inserted, failed and skipped."""
    outcome = F.col("outcome")
    return read_lenient(rows, position).agg(
        *[F.count_if(outcome == name).alias(name) for name in ("inserted", "failed", "skipped")]
    )


def by_id(entries: DataFrame, row_id: int) -> DataFrame:
    return entries.filter(F.col("id") == row_id)


def update_by_id(entries: DataFrame, changes: DataFrame, order: str | None = None, at: Column | None = None) -> DataFrame:
    """Entries with the editable columns replaced where `changes` holds their id.

    Of several changes of one id the last counts, by column `order` or else as they are read. A value in `changes` replaces the
    old one even when it is NULL. An `updated_at` column takes the time of the update.
    """
    place = F.monotonically_increasing_id() if order is None else F.col(order)
    last = changes.select("id", place.alias("_at"), F.struct(*EDITABLE).alias("_new"))
    new = last.groupBy("id").agg(F.max_by("_new", "_at").alias("_new"))
    joined = entries.join(new, "id", "left")
    hit = F.col("_new").isNotNull()
    new_values = {c: F.col(f"_new.{c}") for c in EDITABLE}
    new_values["updated_at"] = F.current_timestamp() if at is None else at
    return joined.select(
        *[
            F.when(hit, new_values[c]).otherwise(F.col(c)).alias(c) if c in new_values else F.col(c)
            for c in entries.columns
        ]
    )


def delete_by_id(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id"), "id", "left_anti").select(*entries.columns)


def append_rows(entries: DataFrame, rows: DataFrame, position: str, at: Column | None = None) -> DataFrame:
    """The entries and the rows with ids after the largest one, in order of their unique position."""
    return entries.unionByName(new_rows(entries, rows, position, at), allowMissingColumns=True)


def new_rows(entries: DataFrame, rows: DataFrame, position: str, at: Column | None = None) -> DataFrame:
    """Rows as they are appended; the largest id is one number from an aggregate."""
    return new_rows_above(rows, position, entries.agg(F.max("id")).first()[0] or 0, at)


def new_rows_above(rows: DataFrame, position: str, largest: int, at: Column | None = None) -> DataFrame:
    """Rows as they are appended after a known largest id."""
    return _inserted(rows, position, F.lit(largest), at)
