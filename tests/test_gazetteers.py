"""Joined gazetteers and name tables answer as the literals do, whatever lies in rows and tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import places, text
from metframe.operators import gazetteers
from metframe.plans import models

SF_DIR = "/root/testdata/sf0.001"
POINTS = "pos long, name string, lat double, lon double"


def points(spark, listed):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(listed)], POINTS)


@pytest.fixture(scope="module")
def officials(spark):
    listed = spark.createDataFrame(list(enumerate(v.OFFICIAL_SUBDIVISIONS)), "pos long, name string")
    return gazetteers.officials_of(listed, points(spark, []))


@pytest.fixture(scope="module")
def aliases(spark):
    listed = [(i, k, list(n)) for i, (k, n) in enumerate(v.REGION_ALIASES.items())]
    return spark.createDataFrame(listed, "pos long, key string, names array<string>")


@pytest.fixture(scope="module")
def rows(spark):
    given = ["", "along Long. 89°E to the north of Lat. 22°N", "along long. 74.5°e", "bay", "gangetic west bengal", "the long. 60°E"]
    more = [(-i, t, "x") for i, t in enumerate([None, *given, *[given[1]] * 40], 1)]
    extra = spark.createDataFrame(more, "id long, region string, pos string")
    return models.regions(spark, SF_DIR).withColumn("pos", F.lit("y")).unionByName(extra)


def as_list(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_coordinates_equal_the_literal_gazetteers(rows, officials, spark):
    region = F.col("region")
    found = gazetteers.imd_subdivisions(rows, region, points(spark, v.IMD_POINTS))
    assert found.columns == [*rows.columns, "names"]
    assert as_list(found) == as_list(rows.withColumn("names", places.imd_subdivisions(region)))
    found = gazetteers.form_subdivisions(rows, region, points(spark, v.FORM_POINTS), officials)
    assert as_list(found) == as_list(rows.withColumn("names", places.form_subdivisions(region)))


def test_names_equal_the_literal_tables(rows, officials, aliases):
    key = text.subdivision_key(F.col("region"))
    keyed = rows.withColumn("key", key)
    for found, literal in (
        (gazetteers.alias_exact(keyed, aliases), places.alias_exact(key)),
        (gazetteers.alias_longest(keyed, aliases), places.alias_longest(key)),
        (gazetteers.official_fuzzy(keyed, officials), F.nullif(places.official_fuzzy(key), F.array())),
        (gazetteers.token_containment(keyed, officials, aliases), F.nullif(places.token_containment(key), F.array())),
    ):
        got = gazetteers.with_names(keyed, "key", found)
        assert as_list(got) == as_list(keyed.withColumn("names", literal))


def test_points_at_the_tolerance_ties_and_repeats(spark):
    listed = [("far", 10.0, 76.6), ("edge", 10.0, 76.5), ("edge", 10.0, 76.5), ("low", 7.4, 80.0), ("slack", 7.5, 80.0), ("nowhere", 9.0, None)]
    listed += [("no latitude", None, 80.5), ("west", 30.0, 83.5), *[("same", 20.0, 80.25)] * 3]
    axes = spark.createDataFrame([(80.0, 8.0), (80.0, None), (None, 8.0), (80.0, 8.0)], "lon double, lat double")
    found = {(r["lon"], r["lat"]): r["names"] for r in gazetteers.nearest_points(axes, points(spark, listed), 3.5).collect()}
    assert found == {(80.0, 8.0): ["same"] * 3 + ["slack", "no latitude"], (80.0, None): ["low", "slack", "same", "same", "same"]}


def test_empty_tables_and_the_list_that_falls_back(rows, spark, aliases):
    none, region = points(spark, []), F.col("region")
    assert gazetteers.imd_subdivisions(rows, region, none).where("size(names) > 0").isEmpty()
    assert gazetteers.imd_subdivisions(rows.limit(0), region, points(spark, v.IMD_POINTS)).isEmpty()
    nobody = spark.createDataFrame([], "pos long, name string")
    fallen = gazetteers.officials_of(nobody, points(spark, v.FORM_POINTS))
    assert [r["name"] for r in fallen.orderBy("pos").collect()] == [p[0] for p in v.FORM_POINTS]
    keyed = rows.withColumn("key", text.subdivision_key(region))
    without = gazetteers.officials_of(nobody, none)
    for found in (
        gazetteers.alias_exact(keyed, aliases.limit(0)), gazetteers.alias_longest(keyed, aliases.limit(0)),
        gazetteers.official_fuzzy(keyed, without), gazetteers.token_containment(keyed, without, aliases),
    ):
        assert found.isEmpty()


def test_only_the_best_of_a_task_are_shuffled(spark):
    axes = spark.createDataFrame([(80.0, 8.0)], "lon double, lat double")
    plan = gazetteers.nearest_points(axes, models.gazetteer(spark, SF_DIR), 3.5)._jdf.queryExecution().executedPlan().toString()
    window = plan.index("Window ")
    partial = plan.index("Partial", window)
    assert "WindowGroupLimit" in plan[window:partial] and "Exchange" in plan[window:partial]
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_parts_are_not_sent_through_the_driver(spark, rows, aliases):
    keyed = rows.withColumn("key", text.subdivision_key(F.col("region")))
    officials = gazetteers.officials_of(spark.createDataFrame([(1, "Kerala"), (2, "Kerala 7")], "pos long, name string"), points(spark, []))
    plan = gazetteers.official_fuzzy(keyed, officials)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_points_beyond_the_fifth_are_left_out_before_the_sort(spark):
    listed = [(f"p{i}", 20.0, 80.0 + (i * 37 % 500) / 100) for i in range(500)]
    axes = spark.createDataFrame([(82.0, 8.0)], "lon double, lat double")
    found = gazetteers.nearest_points(axes, points(spark, listed), 3.5)
    nearest = sorted(range(500), key=lambda i: (abs(80.0 + (i * 37 % 500) / 100 - 82.0), i))[:5]
    assert found.first()["names"] == [f"p{i}" for i in nearest]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "<= bound" in re.sub(r"#\d+L?", "", plan)
