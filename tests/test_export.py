"""The written export against the view: part files one after another hold its rows in its order."""

from __future__ import annotations

import csv
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from metframe import FilterPair
from metframe.operators import views
from metframe.sinks import writers


@pytest.fixture(scope="module")
def entries(spark):
    rng = random.Random(11)
    data = []
    for i in rng.sample(range(5000), 900):
        day = rng.choice(["2025-06-08", "2025-06-08", "2025-06-08", "2025-06-09", "2024-01-31", None])
        level = rng.choice([None, "850 hPa", "500 hPa, 700 hPa", "Surface"])
        data.append((i, day, rng.choice(["WD", "CYCIR", "Trough"]), level, rng.choice([None, "Assam", 'Goa, "Bihar"'])))
    rows = spark.createDataFrame(data, "id bigint, day string, weather_system string, pressure_level string, subdivisions string")
    made = F.lit("2025-06-10 08:30:00").cast("timestamp")
    return rows.select("id", F.col("day").cast("date").alias("entry_date"), *rows.columns[2:], made.alias("created_at")).repartition(7)


def written(folder: pathlib.Path) -> list[list[str]]:
    parts = sorted(folder.glob("part-*.csv"))
    assert parts
    return [row for part in parts for row in list(csv.reader(part.open(encoding="utf-8", newline=""), escapechar=None))[1:]]


@pytest.mark.parametrize("pairs", [(), (FilterPair(system="WD"),)])
def test_part_files_are_in_view_order(spark, entries, tmp_path, pairs):
    writers.write_export(entries, str(tmp_path / "out"), pairs)
    view = views.filter_entries(entries, pairs, "", ",").orderBy(*views.view_order()).collect()
    found = written(tmp_path / "out")
    assert [(row[0], row[2]) for row in found] == [(str(r["entry_date"] or ""), r["weather_system"]) for r in view]
    assert [row[3] for row in found] == [r["pressure_level"] or "" for r in view]
    numbers, last = [], object()
    for r in view:
        numbers.append(1 if r["entry_date"] != last else numbers[-1] + 1)
        last = r["entry_date"]
    assert [row[1] for row in found] == list(map(str, numbers))


def test_an_export_spreads_over_part_files(spark, entries, tmp_path):
    """Order doesn't need one task: with many range partitions there are many parts, still in order."""
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_export(entries, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(list((tmp_path / "out").glob("part-*.csv"))) > 1
    days = [row[0] for row in written(tmp_path / "out")]
    assert days == sorted(days, reverse=True) and len(days) == 900


def test_an_empty_export(entries, tmp_path):
    writers.write_export(entries.limit(0), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*.csv"))
    assert [row for part in parts for row in list(csv.reader(part.open()))[1:]] == []
