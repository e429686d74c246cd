"""Chunked scans against plain windows, with chunks of a few rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from metframe.operators import scans
from metframe.session import materialize, spread


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [
        (rng.choice(["hot", "hot", "a", "b"]), i, rng.choice(["x", "y", None]), rng.choice([None, None, "v" + str(i)]))
        for i in rng.sample(range(2000), 600)
    ]
    return spark.createDataFrame(data, "g string, pos bigint, m string, v string").cache()


def same(left, right):
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect()))


def test_number_rows(rows):
    plain = Window.partitionBy("g").orderBy(F.col("m").asc_nulls_first(), "pos")
    ours = scans.number_rows(rows, "n", "pos", ["g"], [F.col("m")])
    same(ours, rows.withColumn("n", F.row_number().over(plain).cast("bigint")))


def test_number_all_rows(rows):
    ours = scans.number_rows(rows, "n", "pos")
    same(ours, rows.withColumn("n", F.row_number().over(Window.orderBy("pos")).cast("bigint")))


def test_numbers_of_null_groups_and_odd_names(spark):
    data = spark.createDataFrame([(None, 5, "a"), ("x", 9, "b"), (None, 1, "c"), ("x", 2, "d")], "`the group` string, pos bigint, v string")
    found = {r["v"]: r["n"] for r in scans.number_rows(data, "n", "pos", ["the group"]).collect()}
    assert found == {"c": 1, "a": 2, "d": 1, "b": 2}


def test_a_summary_has_a_row_for_each_block_and_group(spark):
    """Ids scattered over a wide range, and one group of nearly all rows."""
    data = spark.range(20_000).select((F.col("id") * 1_000_003).alias("pos"), F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("g"))
    stored = materialize(data.repartitionByRange(8, "g", "pos").sortWithinPartitions("g", "pos"), "t")
    starts = scans.block_starts(scans._placed(stored), ["g"])
    assert starts.count() <= 8 + 8
    plain = Window.partitionBy("g").orderBy("pos")
    same(scans.number_rows(data, "n", "pos", ["g"]), data.withColumn("n", F.row_number().over(plain).cast("bigint")))


@pytest.mark.parametrize("chunk", [1, 7, 100_000, None])
@pytest.mark.parametrize("current", [True, False])
def test_carry_last(rows, chunk, current):
    end = 0 if current else -1
    plain = Window.partitionBy("g").orderBy("pos").rowsBetween(Window.unboundedPreceding, end)
    ours = scans.carry_last(rows, ["g"], "pos", {"lv": F.col("v"), "lm": F.col("m")}, current, chunk)
    same(ours, rows.select("*", *[F.last(c, ignorenulls=True).over(plain).alias(n) for c, n in (("v", "lv"), ("m", "lm"))]))


def test_number_sorted(rows):
    order = [F.col("m").desc_nulls_last(), F.col("pos")]
    ours = scans.number_sorted(rows, "n", *order)
    same(ours, rows.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("bigint")))


def test_number_both(rows):
    order = Window.orderBy("pos")
    ours = scans.number_both(rows, "n", "k", ["g"], F.col("pos"))
    want = rows.withColumn("n", F.row_number().over(order).cast("bigint"))
    same(ours, want.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("pos")).cast("bigint")))


def test_number_both_over_many_files_and_null_groups(spark):
    data = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("pos"), F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("the group"))
    data = data.repartition(13)
    spread = scans.number_both(data, "n", "k", ["the group"], F.col("pos"))
    plain = data.withColumn("n", F.row_number().over(Window.orderBy("pos")).cast("bigint"))
    same(spread, plain.withColumn("k", F.row_number().over(Window.partitionBy("the group").orderBy("pos")).cast("bigint")))
    assert scans.number_both(data.limit(0), "n", "k", ["the group"], F.col("pos")).count() == 0


def test_rows_are_not_shuffled_for_numbers(rows):
    """Written counts are small, so they are joined in place; the one exchange lies before the write."""
    plan = scans.number_rows(rows, "n", "pos", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_text_work_is_dealt_out_by_rows(spark):
    rows = spark.range(0, 1000, 1, 1)
    pieces = spread(rows, task_rows=10)
    assert 100 <= pieces.rdd.getNumPartitions() < 100 + spark.sparkContext.defaultParallelism
    same(pieces, rows)
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(0, 0, 1, 1)).isEmpty()


def test_a_cut_is_needed_beyond_the_first_chunk_only(spark):
    def needed(*rows):
        return scans.needed_cut(spark.createDataFrame([*rows], "g string, pos long"), ["g"], "pos", 4)

    assert [needed(("a", 0), ("a", 3), ("b", 0), (None, 0)), needed(("a", 0), ("a", 4)), needed(("a", -1)), needed()] == [None, 4, 4, None]
    assert [needed(("a", 0), ("a", 0)), needed((None, 1), (None, 1))] == [4, 4]
    assert scans.needed_cut(spark.range(9), [], "id", None) is None
