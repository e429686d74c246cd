"""Files in, files out: bulletins, CSV, gazetteers, and the stored tables."""

from __future__ import annotations

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import text
from metframe.operators import flat, star, views
from metframe.plans import extraction
from metframe.sinks import writers
from metframe.sources import bulletin_files, tables

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def write_docx(path, paragraphs):
    body = "".join(
        "<w:p>" + "".join(f"<w:r><w:t>{run}</w:t></w:r>" for run in runs) + "</w:p>" for runs in paragraphs
    )
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


@pytest.fixture
def folder(tmp_path):
    folder = tmp_path / "bulletins"
    folder.mkdir()
    summary = "Summary of observations recorded at 0830 hours IST: The upper air cyclonic circulation over Kerala at 1.5 km above m. s. l. persisted."
    write_docx(folder / "AIWS 20250608.docx", [["Title"], [], ["Sunday,08th ", "June 2025"], [summary]])
    write_docx(folder / "B 20250609.docx", [["The trough from Bihar to Odisha at 0.9 km above m. s. l. persisted."]])
    write_docx(folder / "~$lock.docx", [["x"]])
    write_docx(folder / "AIWS_copy 1.docx", [["x"]])
    (folder / "broken.docx").write_bytes(b"not a zip")
    (folder / "notes.txt").write_text("x")
    return str(folder)


def test_folder_listing(spark, folder):
    names = [r["source_file"] for r in bulletin_files.list_files(spark, folder).collect()]
    assert names == ["AIWS 20250608.docx", "B 20250609.docx", "broken.docx"]


def test_paragraphs_and_unreadable_files(spark, folder):
    rows = bulletin_files.read_paragraphs(spark, folder)
    good = bulletin_files.readable(rows).filter(F.col("source_file").startswith("AIWS")).orderBy("para_idx").collect()
    assert [r["text"] for r in good][:2] == ["Title", "Sunday,08th June 2025"]
    assert [r["source_file"] for r in bulletin_files.unreadable(rows).collect()] == ["broken.docx"]


def test_folder_to_rows_and_files(spark, folder, tmp_path):
    rows = extraction.extract_folder(spark, folder)
    found = {(r["date"], r["weather_system"], r["region"], r["height_km"], r["pressure_level"]) for r in rows.collect()}
    assert found == {
        ("2025-06-08", "CYCIR", "kerala", "1.5", "850 hPa"),
        ("2025-06-09", "Trough", "bihar ; odisha", "0.9", "925 hPa"),
    }
    writers.write_extraction_csv(rows, f"{tmp_path}/out")
    writers.write_json(rows, f"{tmp_path}/json")
    back = tables.good_rows(tables.read_csv_rows(spark, f"{tmp_path}/out", v.EXTRACTION_COLUMNS))
    assert back.count() == 2
    assert writers.enrich(back, f"{tmp_path}/enriched") == 2
    enriched = tables.read_csv_rows(spark, f"{tmp_path}/enriched")
    assert {r["subdivisions"] for r in enriched.collect()} == {"Kerala", "Bihar ; Odisha"}


def test_csv_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        '﻿date , weather_system,subdivisions,extra\n2025-06-01,CYCIR,"Haryana, Chandigarh & Delhi",1\n'
        '01-06-2025,WD,"two\nlines",2\nshort,row\n2025-06-03,Trough,"a ""quoted"" name",3\n',
        encoding="utf-8",
    )
    (tmp_path / "b.csv").write_text("date , weather_system,subdivisions,extra\n2025-07-01,WD,,\n", encoding="utf-8")
    rows = tables.read_csv_rows(spark, str(tmp_path))
    good = tables.good_rows(rows).orderBy("row_pos").collect()
    assert [r["date"] for r in good] == ["2025-06-01", "01-06-2025", "2025-06-03", "2025-07-01"]
    assert good[1]["subdivisions"] == "two\nlines" and good[2]["subdivisions"] == 'a "quoted" name'
    assert good[0]["status"] is None
    assert [r["bad_row"] for r in tables.bad_rows(rows).collect()] == ["short,row"]
    assert [r["row_pos"] for r in rows.orderBy("row_pos").collect()] == [0, 1, 2, 3, 4]


def test_csv_columns_follow_each_file(spark, tmp_path):
    """Permuted, extra, repeated and missing columns; an empty file; only a header."""
    (tmp_path / "1.csv").write_text("date,weather_system,region\n2025-06-01,CYCIR,bihar\n")
    (tmp_path / "2.csv").write_text("region,date,weather_system\nkerala,2025-06-02,WD\n")
    (tmp_path / "3.csv").write_text('more, "region" ,date,date\n1,goa,2025-06-03,never\n1,short\n')
    (tmp_path / "4.csv").write_text("date,weather_system,region\r\n2025-06-04,Trough,odisha\r\n")
    (tmp_path / "5.csv").write_text("")
    (tmp_path / "6.csv").write_text("region,date\n")
    rows = tables.read_csv_rows(spark, str(tmp_path), ["date", "weather_system", "region"])
    good = tables.good_rows(rows).orderBy("row_pos").select("date", "weather_system", "region").collect()
    assert [tuple(r) for r in good] == [
        ("2025-06-01", "CYCIR", "bihar"), ("2025-06-02", "WD", "kerala"), ("2025-06-03", None, "goa"), ("2025-06-04", "Trough", "odisha"),
    ]
    assert [r["bad_row"] for r in tables.bad_rows(rows).collect()] == ["1,short"]


def test_rows_keep_their_order_through_files(spark, tmp_path):
    """File, then entity: what the star tables number by."""
    made = [(f"f{i % 7}", i // 7, "WD" if i % 2 else "CYCIR", f"2025-06-0{i % 7 + 1}") for i in range(70)]
    rows = spark.createDataFrame(made, "source_file string, entity_ord bigint, weather_system string, date string")
    texts = ("region", "region_original", "height_km", "pressure_level", "status")
    rows = rows.select("*", *[F.lit("x").alias(c) for c in texts]).repartition(5)
    writers.write_extraction_csv(rows, f"{tmp_path}/out")
    back = tables.good_rows(tables.read_csv_rows(spark, f"{tmp_path}/out", [*v.EXTRACTION_COLUMNS, "subdivisions"]))
    ordered = [(r["source_file"], r["weather_system"]) for r in back.orderBy("row_pos").collect()]
    assert ordered == [(f, s) for f, _, s, _ in sorted(made)]
    facts = star.build_star(back, "row_pos").fact_system.orderBy("id").collect()
    assert [r["system_seq"] for r in facts] == [i % 10 + 1 for i in range(70)]


def test_stored_table_from_reload_to_export(spark, tmp_path):
    """Reload, append, update twice and export, with ids and times as the table gives them."""
    at, later = F.lit("2025-06-09 08:30:00").cast("timestamp"), F.lit("2025-06-10 08:30:00").cast("timestamp")
    texts = spark.createDataFrame(
        [(7, "2025-06-01", "CYCIR", "850 hPa", "Bihar"), (3, "2025-06-01", "WD", " ", ""), (9, "2025-06-02", " ", None, None)],
        "row_pos bigint, date string, weather_system string, pressure_level string, subdivisions string",
    )
    path = f"{tmp_path}/table"
    assert writers.write_entries(flat.reload_strict(texts, "row_pos", at), path) == 2
    columns = [*tables.ENTRY_COLUMNS, *tables.TIMES]
    form = spark.createDataFrame(
        [(20, datetime.date(2025, 6, 1), "Trough", None, None), (10, datetime.date(2025, 7, 1), "WD", None, "700 hPa")],
        "place int, entry_date date, weather_system string, subdivisions string, pressure_level string",
    )
    writers.append_entries(flat.new_rows(tables.read_entries(spark, path, columns), form, "place", later), path)
    changes = spark.createDataFrame(
        [(2, 2, datetime.date(2025, 6, 1), "Last", None, None), (2, 1, datetime.date(2025, 6, 1), "First", None, None)],
        "id bigint, nth int, entry_date date, weather_system string, subdivisions string, pressure_level string",
    )
    table = flat.update_by_id(tables.read_entries(spark, path, columns), changes, "nth", later)
    rows = [(r["id"], r["weather_system"], str(r["created_at"]), str(r["updated_at"])) for r in table.orderBy("id").collect()]
    first, second = "2025-06-09 08:30:00", "2025-06-10 08:30:00"
    assert rows == [(1, "WD", first, first), (2, "Last", first, second), (3, "WD", second, second), (4, "Trough", second, second)]
    exported = views.export_rows(table).collect()
    assert len(exported) == 4 and {str(r["Created At"]) for r in exported} == {first, second}


def test_texts_that_hold_the_mark(spark):
    odd = "a\ufdd0b ; c"
    row = spark.range(1).select(text.split_list(F.lit(odd), ";").alias("x"), text.split_list(F.lit(odd), " ; ").alias("y")).first()
    assert row["x"] == ["a\ufdd0b", "c"] and row["y"] == ["a\ufdd0b", "c"]


def test_a_damaged_document_is_an_error_row(spark, folder):
    import pathlib

    whole = pathlib.Path(folder, "AIWS 20250608.docx").read_bytes()
    pathlib.Path(folder, "cut.docx").write_bytes(whole[: len(whole) // 2])
    with zipfile.ZipFile(pathlib.Path(folder, "flipped.docx"), "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", "<w/>" * 500)
    data = bytearray(pathlib.Path(folder, "flipped.docx").read_bytes())
    data[50:60] = bytes(10)
    pathlib.Path(folder, "flipped.docx").write_bytes(bytes(data))
    rows = bulletin_files.read_paragraphs(spark, folder)
    assert {r["source_file"] for r in bulletin_files.unreadable(rows).collect()} == {"broken.docx", "cut.docx", "flipped.docx"}


def test_gazetteer(spark, tmp_path):
    path = tmp_path / "points.json"
    path.write_text(json.dumps([{"name": n, "lat": a, "lon": o} for n, a, o in v.IMD_POINTS]))
    points = tables.read_gazetteer(spark, str(path))
    assert [(r["name"], r["lat"], r["lon"]) for r in points.orderBy("pos").collect()] == [tuple(p) for p in v.IMD_POINTS]


def entries(spark):
    day = datetime.date
    rows = [
        (1, day(2025, 6, 1), "CYCIR", "Bihar", "850 hPa"), (2, day(2025, 6, 2), "WD", None, None),
        (3, day(2025, 7, 1), "WD", "Kerala", "Surface"), (4, day(2025, 8, 1), "Trough", "Odisha", None),
    ]
    return spark.createDataFrame(rows, "id bigint, entry_date date, weather_system string, subdivisions string, pressure_level string")


def stored(spark, path):
    rows = tables.read_entries(spark, path).orderBy("id").collect()
    return [(r["id"], str(r["entry_date"]), r["weather_system"]) for r in rows]


def test_flat_table_upkeep(spark, tmp_path):
    path = f"{tmp_path}/entries"
    assert writers.write_entries(entries(spark), path, max_rows_per_file=1000) == 4
    day = datetime.date
    changes = spark.createDataFrame(
        [(3, day(2025, 9, 9), "Edited", None, "700 hPa"), (99, day(2025, 1, 1), "None", None, None)], entries(spark).schema
    )
    writers.update_entries(spark, path, changes)
    assert stored(spark, path) == [
        (1, "2025-06-01", "CYCIR"), (2, "2025-06-02", "WD"), (3, "2025-09-09", "Edited"), (4, "2025-08-01", "Trough"),
    ]
    writers.delete_entries(spark, path, spark.createDataFrame([(1,), (4,)], "id bigint"))
    assert [r[0] for r in stored(spark, path)] == [2, 3]
    writers.append_entries(entries(spark).filter("id = 4"), path)
    assert [r[0] for r in stored(spark, path)] == [2, 3, 4]
    assert flat.by_id(tables.read_entries(spark, path), 3).first()["weather_system"] == "Edited"


def test_strict_reload_refuses_an_unknown_date(spark):
    rows = spark.createDataFrame(
        [(0, "June 1", "CYCIR", None, None)], "row_pos bigint, date string, weather_system string, pressure_level string, subdivisions string"
    )
    with pytest.raises(Exception, match="Unrecognized date format"):
        flat.reload_strict(rows, "row_pos").collect()


def test_star_tables_are_written(spark, tmp_path):
    rows = spark.createDataFrame(
        [
            (0, "2025-06-02", "CYCIR", "850 hPa ; Surface", "Bihar ; Bihar"), (1, "2025-06-01", "WD", "700 hPa", ""),
            (2, "2025-06-02", "Trough", "", "Kerala"), (3, "2025-06-02", "Depression", "500 hPa", "Iran"),
        ],
        "row_pos bigint, date string, weather_system string, pressure_level string, subdivisions string",
    )
    writers.write_star(star.build_star(rows, "row_pos"), f"{tmp_path}/star")

    def read(name):
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/star/{name}").collect()))

    assert read("dim_date") == [(1, "2025-06-01"), (2, "2025-06-02")]
    assert read("dim_level") == [(1, "700 hPa", 700), (2, "850 hPa", 850), (3, "Surface", None)]
    assert read("fact_system") == [(1, 2, 1, "CYCIR"), (2, 1, 1, "WD"), (3, 2, 2, "Trough")]
    assert read("system_subdivision") == [(1, 1), (1, 1), (3, 2)]
    assert read("system_level") == [(1, 2), (1, 3), (2, 1)]
