"""Atomic commits of stored tables and the stream that fills one, with writers that fail or race."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from metframe.catalog import all_queries
from metframe.operators import star
from metframe.plans import extraction
from metframe.sinks import entry_log, versions
from metframe.sources import bulletin_files
from metframe.streaming import ingest
from tests.test_sources_and_sinks import write_docx

DAY = datetime.date
ENTRIES = "entry_date date, weather_system string, subdivisions string, pressure_level string, row_pos long"


def new_rows(spark, *rows):
    return spark.createDataFrame([(DAY(2025, month, 1), system, None, None, i) for i, (month, system) in enumerate(rows)], ENTRIES)


def stored(log, **how):
    return [(r["id"], str(r["entry_date"])[:7], r["weather_system"]) for r in log.read(**how).orderBy("id").collect()]


@pytest.fixture
def log(spark, tmp_path):
    log = entry_log.EntryLog(spark, f"{tmp_path}/entries")
    assert stored(log) == []
    assert log.append(new_rows(spark, (6, "CYCIR"), (6, "WD"), (7, "WD"), (8, "Trough")), "row_pos") == 4
    return log


def files_read(df):
    return {f.split("/data/")[1].rsplit("/", 1)[0] for f in df.inputFiles()}


def test_changes_rewrite_only_the_folders_they_touch(spark, log):
    before = log._tables.read_commit()
    changes = spark.createDataFrame([(3, DAY(2025, 9, 9), "Edited", None, "700 hPa"), (99, DAY(2025, 1, 1), "None", None, None)], f"id long, {ENTRIES.rsplit(',', 1)[0]}")
    log.update(changes)
    assert stored(log) == [(1, "2025-06", "CYCIR"), (2, "2025-06", "WD"), (3, "2025-09", "Edited"), (4, "2025-08", "Trough")]
    after = log._tables.read_commit()
    kept = {p.folder for p in before.parts["entries"]} & {p.folder for p in after.parts["entries"]}
    assert len(kept) == 2 and after.number == before.number + 1
    log.delete(spark.createDataFrame([(1,), (4,)], "id long"))
    assert [r[0] for r in stored(log)] == [2, 3]
    assert stored(log, number=before.number)[0] == (1, "2025-06", "CYCIR")  # an older version is whole
    assert log.append(new_rows(spark, (6, "WD")), "row_pos") == 1
    assert [r[0] for r in stored(log)] == [2, 3, 5]  # the id of a deleted entry is not given again
    assert log.append(new_rows(spark).limit(0), "row_pos") == 0


def test_dates_and_ids_open_the_folders_that_may_hold_them(log):
    assert stored(log, date="2025-07-01") == [(3, "2025-07", "WD")]
    assert len(files_read(log.read("2025-07-01"))) == 1
    assert log.by_id(4).first()["weather_system"] == "Trough" and len(files_read(log.by_id(4))) == 1
    assert log.by_id(77).collect() == []


def test_rows_without_a_date_are_kept(spark, log):
    rows = new_rows(spark, (6, "Odd")).withColumn("entry_date", F.lit(None).cast("date"))
    assert log.append(rows, "row_pos") == 1
    assert stored(log)[-1] == (5, "None", "Odd")


def test_a_write_that_fails_leaves_the_old_version(spark, log, monkeypatch):
    old = stored(log)

    def broken(self, new):
        raise OSError("the disk is gone")

    with monkeypatch.context() as patched:
        patched.setattr(versions.VersionedTables, "commit", broken)
        with pytest.raises(OSError):
            log.delete(spark.createDataFrame([(1,)], "id long"))
    assert stored(log) == old
    bad = new_rows(spark, (6, "CYCIR")).withColumn("weather_system", F.raise_error(F.lit("half-way")).cast("string"))
    with pytest.raises(Exception, match="half-way"):
        log.append(bad, "row_pos")
    assert stored(log) == old and log.append(new_rows(spark, (6, "WD")), "row_pos") == 1


def test_two_appends_never_share_an_id(spark, log, monkeypatch):
    """A second writer commits between the first one's reading and its commit."""
    other = entry_log.EntryLog(spark, log._tables.folder)
    commit, raced = versions.VersionedTables.commit, []

    def slow(self, new):
        if self is log._tables and not raced:
            raced.append(other.append(new_rows(spark, (7, "First"), (7, "Second")), "row_pos"))
        commit(self, new)

    monkeypatch.setattr(versions.VersionedTables, "commit", slow)
    assert log.append(new_rows(spark, (6, "Third")), "row_pos") == 1 and raced == [2]
    assert [(r[0], r[2]) for r in stored(log)][4:] == [(5, "First"), (6, "Second"), (7, "Third")]
    with pytest.raises(versions.Conflict):
        commit(log._tables, versions.Commit(number=1))


def test_six_star_tables_change_together(spark, tmp_path, monkeypatch):
    def load(*systems):
        rows = [(i, "2025-06-02", s, "850 hPa ; Surface", "Bihar") for i, s in enumerate(systems)]
        return star.build_star(spark.createDataFrame(rows, "row_pos long, date string, weather_system string, pressure_level string, subdivisions string"), "row_pos")

    tables = versions.VersionedTables(spark, f"{tmp_path}/star")
    first = load("CYCIR", "WD")
    entry_log.commit_star(first, spark, tables.folder)

    def read():
        return {name: tables.read(name, table.schema).count() for name, table in first.tables().items()}

    old = read()
    assert old["fact_system"] == 2 and old["system_level"] == 4
    written = []

    def breaks(self, rows, name, *how):
        written.append(name)
        if len(written) == 4:
            raise OSError("lost")
        return write(self, rows, name, *how)

    write = versions.VersionedTables.write_parts
    with monkeypatch.context() as patched:
        patched.setattr(versions.VersionedTables, "write_parts", breaks)
        with pytest.raises(OSError):
            entry_log.commit_star(load("Trough"), spark, tables.folder)
    assert read() == old
    entry_log.commit_star(load("Trough"), spark, tables.folder)
    assert read()["fact_system"] == 1 and tables.read("fact_system", first.fact_system.schema, 1).count() == 2


def summary(system, height):
    return f"Summary of observations recorded at 0830 hours IST: The {system} at {height} km above m. s. l. persisted."


def test_a_stream_of_bulletins_ends_in_the_rows_of_the_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table = ingest.BulletinTable(spark, f"{tmp_path}/table", buckets=4)

    def run():
        ingest.ingest_folder(spark, str(folder), table, f"{tmp_path}/checkpoint", files_per_batch=2).awaitTermination()

    def compare():
        got = sorted(map(tuple, table.rows().drop("entity_ord").collect()), key=str)
        assert got == sorted(map(tuple, extraction.extract_folder(spark, str(folder)).drop("entity_ord").collect()), key=str)
        return got

    write_docx(folder / "AIWS 20250608.docx", [["Sunday,08th June 2025"], [summary("upper air cyclonic circulation over Kerala", 1.5)]])
    write_docx(folder / "B 20250609.docx", [[summary("trough from Bihar to Odisha", 0.9)]])
    write_docx(folder / "~$lock.docx", [["x"]])
    (folder / "broken.docx").write_bytes(b"not a zip")
    run()
    first, commits = compare(), table.commits()
    assert len(first) >= 2 and [r["source_file"] for r in table.errors().collect()] == ["broken.docx"] and commits >= 2
    run()
    assert table.commits() == commits  # nothing new, nothing written

    # corrected bulletins, one of which could not be read before, come under new paths of the same name
    more = folder.parent / "more"
    more.mkdir()
    write_docx(more / "B 20250609.docx", [["Forecast only."]])
    write_docx(more / "broken.docx", [[summary("upper air cyclonic circulation over Assam", 3.1)]])
    ingest.ingest_folder(spark, str(more), table, f"{tmp_path}/checkpoint-more").awaitTermination()
    assert {r["source_file"] for r in table.rows().collect()} == {"AIWS 20250608.docx", "broken.docx"} and table.errors().count() == 0

    # a batch that is run again changes nothing
    again = bulletin_files.read_documents(spark, str(folder))
    last = table.commits()
    table.upsert(again, str(folder), 0)
    assert table.commits() == last


def test_the_newest_copy_of_a_bulletin_counts_and_lone_ones_are_not_shuffled(spark):
    columns = "source_file string, paragraphs array<string>, modified timestamp, path string"
    times = [datetime.datetime(2025, 6, day) for day in (1, 2)]
    copies = [("a", ["old"], times[0], "x"), ("a", ["new"], times[1], "x"), (None, ["p"], times[1], "x"), (None, ["q"], times[1], "y"), ("b", ["only"], times[0], "x")]
    newest = ingest._newest(spark.createDataFrame(copies, columns))
    assert newest.columns == ["source_file", "paragraphs"]
    assert sorted(map(str, map(tuple, newest.collect()))) == ["('a', ['new'])", "('b', ['only'])", "(None, ['q'])"]
    lone = ingest._newest(spark.createDataFrame(copies[1:3] + copies[4:], columns))
    assert lone.count() == 3 and "Exchange" not in lone._jdf.queryExecution().executedPlan().toString()


def test_drops_of_the_stream_are_written_by_more_than_one_task(spark, tmp_path, monkeypatch):
    rows = [(i, i % 7, DAY(2025, 1 + i % 12, 1), "2-HIGH") for i in range(300)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    files = []

    class Ended(Exception):
        pass

    def first_drop(spark, folder, *rest):
        files.extend(spark.read.parquet(folder).inputFiles())
        raise Ended

    monkeypatch.setattr(ingest, "ingest_documents", first_drop)
    with pytest.raises(Ended):
        all_queries()["stream_ingest"].run(spark, str(tmp_path))
    assert len(files) > 1
