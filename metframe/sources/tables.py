"""CSV, JSON, Parquet and JDBC sources of rows, gazetteers and entries."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metframe import schemas
from metframe import vocab as v
from metframe.operators import scans

ENTRY_COLUMNS = ["id", "entry_date", "weather_system", "pressure_level", "subdivisions"]
TIMES = ["created_at", "updated_at"]
MONTH = "entry_month"


def read_csv_rows(spark: SparkSession, path: str, wanted: Sequence[str] = v.ENRICHED_COLUMNS) -> DataFrame:
    """Rows of extraction CSV files by each file's own header, all texts, with `row_pos` in file order.

    Files are grouped by their header line, so columns may be in any order, missing or more in any of them. Header names are trimmed
    and freed of a byte order mark; wanted columns that a file does not have are NULL. Rows of a wrong
    length land in `bad_row` and are NULL elsewhere. A folder without files gives no rows.
    """
    parts = [_csv_of_header(spark, names, files, wanted) for names, files in _csv_headers(spark, path)]
    if not parts:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (*wanted, "bad_row")) + ", row_pos bigint")
    return scans.in_file_order(
        reduce(DataFrame.unionByName, parts), "row_pos", F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    ).drop("_metadata")


def _csv_headers(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """Every header line with the files that begin with it: one row a file on the driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    placed = lines.where("at = 0").withColumn("place", F.monotonically_increasing_id())
    first = placed.groupBy("file").agg(F.min_by("value", "place").alias("header"))
    by_header: dict[str, list[str]] = {}
    for row in first.orderBy("file").collect():
        by_header.setdefault(row["header"].rstrip("\r"), []).append(row["file"])
    return [([name.strip().lstrip("\ufeff").strip() for name in next(csv.reader([line], skipinitialspace=True), [])], files) for line, files in by_header.items()]


def _csv_of_header(spark: SparkSession, names: list[str], files: list[str], wanted: Sequence[str]) -> DataFrame:
    """Rows of files that share a header; of columns with one name the first counts."""
    own = [name if name and name not in names[:i] else f"_column{i}" for i, name in enumerate(names)]
    schema = ", ".join(f"`{name}` STRING" for name in own) + ", bad_row STRING"
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("enforceSchema", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "bad_row").schema(schema).csv(files)
    )
    columns = [F.col(f"`{c}`") if c in own else F.lit(None).cast("string").alias(c) for c in wanted]
    # Naming every column keeps the reader from pruning any: a row is only known to be of a
    # wrong length when it is read whole.
    whole = F.length(F.concat_ws("", *[F.col(f"`{name}`") for name in own])) >= 0
    bad_row = F.when(whole, F.col("bad_row")).alias("bad_row")
    return rows.select(*columns, bad_row, "_metadata")


def bad_rows(rows: DataFrame) -> DataFrame:
    """Rows of a wrong length, whole, with their position."""
    return rows.filter(F.col("bad_row").isNotNull()).select("row_pos", "bad_row")


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("bad_row").isNull()).drop("bad_row")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name, lat, lon) of a JSON list of points, in list order."""
    rows = spark.read.option("multiLine", True).schema(schemas.GAZETTEER).json(path)
    numbered = rows.withColumn("_id", F.monotonically_increasing_id())
    return numbered.select(
        (F.row_number().over(Window.orderBy("_id")) - 1).alias("pos"), "name", "lat", "lon"
    )


def read_entries(
    spark: SparkSession, path: str, columns: Sequence[str] = ENTRY_COLUMNS, date: str = ""
) -> DataFrame:
    """Flat entries with only the wanted columns; filters reach the Parquet scan.

    For one date only the folder of its month is read.
    """
    stored = spark.read.parquet(path)
    if date:
        day = F.lit(date).cast("date")
        month = F.lit(date[:7]).cast(stored.schema[MONTH].dataType)
        stored = stored.filter((F.col(MONTH) == month) & (F.col("entry_date") == day))
    return stored.select(*columns)


def read_entries_jdbc(
    spark: SparkSession, url: str, table: str, low: int, high: int, parts: int,
    columns: Sequence[str] = ENTRY_COLUMNS, **options: str,
) -> DataFrame:
    """Flat entries from a database, read in parallel over ranges of the id."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn="id", lowerBound=low, upperBound=high, numPartitions=parts, **options
    )
    return reader.load().select(*columns)
