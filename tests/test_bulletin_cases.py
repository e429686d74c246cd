"""Whole bulletins: what a short one says and which rows must come out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from metframe.functions import levels, places
from metframe.plans import extraction

DEG = "\N{DEGREE SIGN}"


@pytest.fixture(scope="module")
def extract(spark):
    """Rows of bulletins by file name; all bulletins of the module's cases run as one job."""

    def run(bulletins):
        rows = [(name, i, text) for name, texts in bulletins.items() for i, text in enumerate(texts)]
        paragraphs = spark.createDataFrame(rows, "source_file string, para_idx int, text string")
        found: dict[str, list[dict]] = {name: [] for name in bulletins}
        for row in extraction.extract_paragraphs(paragraphs).orderBy("source_file", "entity_ord").collect():
            found[row["source_file"]].append(row.asDict())
        return found

    return run


def circulation(place, rest):
    return f"A cyclonic circulation lay over {place} {rest}."


# name -> (sentences of the summary, expected (system, region, height, levels, status))
BULLETINS = {
    "grows and is kept.docx": (
        [circulation("Odisha", "at 4.5 km above mean sea level"), "It persisted at 2.1 km above mean sea level."],
        [("CYCIR", "odisha", "2.1", "850 hPa", "persisted")],
    ),
    "two of a kind.docx": (
        [circulation("West Rajasthan", "at 0.9 km above msl"), circulation("Gujarat", "at 0.9 km above msl")],
        [("CYCIR", "west rajasthan", "0.9", "925 hPa", "lay over"), ("CYCIR", "gujarat", "0.9", "925 hPa", "lay over")],
    ),
    "ended by name.docx": (
        [circulation("Punjab", "at 5.8 km above msl"), "The cyclonic circulation over Punjab has become less marked."], [],
    ),
    "ended by part of a name.docx": (
        [circulation("east Uttar Pradesh & adjoining Bihar", "at 3.1 km above msl"), circulation("Goa", "at 3.1 km above msl"),
         "The cyclonic circulation over east Uttar Pradesh became less marked."],
        [("CYCIR", "goa", "3.1", "700 hPa", "lay over")],
    ),
    "ended by a pronoun.docx": (["The trough from Telangana to Vidarbha at 1.5 km above msl persisted.", "It became less marked."], []),
    "back again.docx": (
        [circulation("Assam", "at 1.5 km above msl"), "The cyclonic circulation over Assam became less marked.", "It then persisted at 3.1 km above msl."],
        [("CYCIR", "assam", "3.1", "700 hPa", "persisted")],
    ),
    "both at once.docx": (
        ["The cyclonic circulation over Tripura at 7.6 km above msl persisted and became less marked."],
        [("CYCIR", "tripura", "7.6", "400 hPa", "persisted")],
    ),
    "nothing before it.docx": (["It persisted at 9.6 km above msl.", "Rain fell at most places."], []),
    "between levels.docx": (
        ["The cyclonic circulation over Sikkim between 6.0 & 6.4 km above msl persisted."], [("CYCIR", "sikkim", "6.0-6.4", None, "persisted")],
    ),
}


def test_bulletins(extract):
    found = extract({name: [" ".join(texts)] for name, (texts, _) in BULLETINS.items()})
    got = {
        name: [(r["weather_system"], r["region"], r["height_km"], r["pressure_level"], r["status"]) for r in rows]
        for name, rows in found.items()
    }
    assert got == {name: expected for name, (_, expected) in BULLETINS.items()}


def test_dates_come_from_heading_or_file_name(extract):
    line = "Summary of observations recorded today: " + circulation("Kerala", "at 1.5 km above msl")
    found = extract({
        "AIWS 20240229.docx": [line], "AIWS 20240301.docx": ["Friday, 5th April 2024", line], "undated.docx": [line],
    })
    assert {name: rows[0]["date"] for name, rows in found.items()} == {
        "AIWS 20240229.docx": "2024-02-29", "AIWS 20240301.docx": "2024-04-05", "undated.docx": None,
    }


def test_no_height_is_the_surface(spark):
    none = F.lit(None).cast("string")
    zero, high = (
        spark.range(1).select(levels.level_and_height(F.lit(low), F.lit(None).cast("double"), none, none).alias("x")).first()["x"]
        for low in (0.0, 12.0)
    )
    assert zero["pressure_level"] == "Surface" and high["pressure_level"] != "Surface"


@pytest.mark.parametrize(
    "region, expected",
    [
        ("comorin", ["Comorin Area"]),
        ("vidarbha ; the ; west rajasthan", ["Vidarbha", "West Rajasthan"]),
        ("", []),
        # a key without any letters is held by every alias, so the longest one answers
        (DEG * 2, ["North pakistan", "Jammu & Kashmir", "Punjab"]),
    ],
)
def test_region_mapping(spark, region, expected):
    assert spark.range(1).select(places.region_subdivisions(F.lit(region)).alias("n")).first()["n"] == expected
