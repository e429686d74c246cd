"""CSV, JSON and Parquet outputs and upkeep of the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import levels, places, text
from metframe.functions.pairs import FilterPair
from metframe.operators import flat, views
from metframe.operators.star import Star
from metframe.session import materialize
from metframe.sources.tables import MONTH



# --- extraction rows ----------------------------------------------------------------------


def _rows_to_write(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed columns of rows that are not less marked, level `Surface` where height is 0."""
    level = levels.surface_default(F.col("pressure_level"), F.col("height_km"))
    kept = rows.filter(~text.is_less_marked(F.col("status"))).withColumn("pressure_level", level)
    return kept.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def extraction_rows(rows: DataFrame) -> DataFrame:
    return _rows_to_write(rows, v.EXTRACTION_COLUMNS)


def enriched_rows(rows: DataFrame) -> DataFrame:
    named = places.entity_subdivisions(F.col("region"), F.col("region_original"))
    return _rows_to_write(rows.withColumn("subdivisions", text.format_regions(named)), v.ENRICHED_COLUMNS)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def _in_file_order(rows: DataFrame) -> DataFrame:
    """Rows by their position, or by file and entity, spread over part files whose names follow that order."""
    for order in (["row_pos"], ["source_file", "entity_ord"]):
        if set(order) <= set(rows.columns):
            return rows.orderBy(*order)
    return rows


def write_extraction_csv(rows: DataFrame, path: str) -> None:
    write_csv(extraction_rows(_in_file_order(rows)), path)


def write_enriched_csv(rows: DataFrame, path: str) -> None:
    write_csv(enriched_rows(_in_file_order(rows)), path)


def write_export(
    entries: DataFrame, path: str, pairs: Sequence[FilterPair] = (), date: str = "", delimiter: str = ","
) -> None:
    """The grouped export as CSV in view order: its part files, one after another by name, hold the rows as the view shows them.

    The rows are sorted by date and the number they have within it, and nothing is shuffled after that sort.
    """
    day, number = (F.col(f"`{name}`") for name in v.EXPORT_HEADER[:2])
    write_csv(views.export_rows(entries, pairs, date, delimiter).orderBy(day.desc(), number), path)


def enrich(rows: DataFrame, path: str) -> int:
    """Map the regions of existing extraction rows, write them, return how many were read."""
    seen = Observation("enrich")
    # observed behind the sort, whose sampling reads the rows once more
    ordered = _in_file_order(rows).observe(seen, F.count(F.lit(1)).alias("rows"))
    write_csv(enriched_rows(ordered), path)
    return seen.get["rows"]


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


# --- flat table ---------------------------------------------------------------------------


def _by_month(entries: DataFrame) -> DataFrame:
    return entries.withColumn(MONTH, F.date_format("entry_date", "yyyy-MM"))


def write_entries(entries: DataFrame, path: str, max_rows_per_file: int = 0) -> int:
    """Replace the flat table, partitioned by month of entry; returns the rows written."""
    seen = Observation("entries")
    counted = entries.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = _by_month(counted).write.mode("overwrite").partitionBy(MONTH)
    writer.option("maxRecordsPerFile", max_rows_per_file).parquet(path)
    return seen.get["rows"]


def append_entries(rows: DataFrame, path: str) -> None:
    _by_month(rows).write.mode("append").partitionBy(MONTH).parquet(path)


def _months(rows: DataFrame) -> list[str]:
    """Months of some rows; bounded by the calendar, and used to prune partitions."""
    return [month for (month,) in rows.select(MONTH).distinct().collect()]


def _rewrite_months(path: str, changed: DataFrame, months: list[str]) -> None:
    """Overwrite only the given months; a month left without rows becomes an empty folder.

    The new rows are staged in the shared folder first, since they are read from the very
    table they replace.
    """
    staged = materialize(changed, "entries")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    for month in set(months) - set(_months(staged)):
        staged.filter(F.lit(False)).drop(MONTH).write.mode("overwrite").parquet(f"{path}/{MONTH}={month}")


def update_entries(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Update rows by id, rewriting the months they leave and the months they enter."""
    table = spark.read.parquet(path)
    old = table.join(changes.select("id"), "id", "left_semi").select(MONTH)
    new = _by_month(changes.join(table.select("id"), "id", "left_semi")).select(MONTH)
    months = _months(old.union(new))
    touched = table.filter(F.col(MONTH).isin(months)).drop(MONTH)
    _rewrite_months(path, _by_month(flat.update_by_id(touched, changes)), months)


def delete_entries(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Delete rows by id, rewriting only the months that hold them."""
    table = spark.read.parquet(path)
    months = _months(table.join(ids.select("id"), "id", "left_semi"))
    touched = table.filter(F.col(MONTH).isin(months)).drop(MONTH)
    _rewrite_months(path, _by_month(flat.delete_by_id(touched, ids)), months)


def write_entries_jdbc(entries: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows to a database in batches of the usual statement size."""
    writer = entries.write.format("jdbc").mode(mode)
    writer.options(url=url, dbtable=table, batchsize=v.WRITE_BATCH_ROWS, **options).save()


# --- star schema --------------------------------------------------------------------------


def write_star(star: Star, folder: str) -> None:
    """Replace all six tables."""
    for name, table in star.tables().items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
