"""Plans: what is pushed into the scan, what is shuffled, and that work stays in the JVM."""

from __future__ import annotations

import pytest

from metframe.catalog import all_queries
from metframe.functions.pairs import FilterPair
from metframe.operators import bulletins, mentions, views
from metframe.plans import models
from metframe.sinks import writers
from metframe.sources import tables

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_and_columns_reach_the_scan(spark, tmp_path):
    rows = models.entries(spark, SF_DIR).drop("c", "user_id")
    writers.write_entries(rows, f"{tmp_path}/e")
    stored = tables.read_entries(spark, f"{tmp_path}/e")
    text = plan(views.filter_entries(stored, [], "2024-01-15").select("id", "weather_system"))
    assert "PushedFilters: [IsNotNull(entry_date), EqualTo(entry_date,2024-01-15)]" in text
    assert "ReadSchema: struct<id:bigint,entry_date:date,weather_system:string>" in text


def test_one_date_reads_one_month(spark, tmp_path):
    rows = spark.sql("SELECT id, date_add(DATE '2024-01-01', CAST(id AS INT)) AS entry_date FROM range(90)")
    writers.write_entries(rows, f"{tmp_path}/e")
    one = tables.read_entries(spark, f"{tmp_path}/e", ["id"], "2024-02-03")
    assert [r["id"] for r in one.collect()] == [33]
    assert "PartitionFilters: [isnotnull(entry_month" in plan(one)


def test_one_pair_needs_no_shuffle(spark):
    rows = views.filter_entries(models.entries(spark, SF_DIR), [FilterPair(system="CYCIR", pressure_operator=">", pressure_value="700")])
    assert "Exchange" not in plan(rows)


def test_documents_become_mentions_without_a_shuffle(spark):
    found = bulletins.bulletins(models.documents(spark, SF_DIR).coalesce(1))
    rows = mentions.mentions(bulletins.sentences(found), keep=("source_file", "bulletin_date"))
    text = plan(rows)
    assert "Exchange" not in text[text.index("Generate"):text.index("Coalesce")] and "Aggregate" not in text


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_pairs_of_everything_and_no_python(spark, name):
    text = plan(all_queries()[name].run(spark, SF_DIR))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas"):
        assert unwanted not in text
