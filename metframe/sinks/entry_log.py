"""The flat entries table and the star under atomic commits: appends, updates and deletes that touch only the folders they must."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metframe import schemas
from metframe.operators import flat
from metframe.operators.star import Star
from metframe.session import materialize
from metframe.sinks.versions import Commit, Part, VersionedTables
from metframe.sources.tables import MONTH

_NAME = "entries"


class EntryLog:
    """Entries by month. Every change is one commit; readers keep the version they began with."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._tables = VersionedTables(spark, folder)

    def _written(self, rows: DataFrame) -> list[Part]:
        by_month = rows.select(*flat.ENTRY, F.date_format("entry_date", "yyyy-MM").alias(MONTH))
        return self._tables.write_parts(by_month, _NAME, MONTH, "id")

    def _rows(self, parts: list[Part]) -> DataFrame:
        return self._tables.read_parts(parts, schemas.ENTRIES)

    def read(self, date: str = "", number: int | None = None) -> DataFrame:
        """All entries, or those of one date, for which only the folders of its month are opened."""
        parts = self._tables.read_commit(number).parts.get(_NAME, [])
        if not date:
            return self._rows(parts)
        return self._rows([p for p in parts if p.division == date[:7]]).where(F.col("entry_date") == F.lit(date).cast("date"))

    def by_id(self, row_id: int) -> DataFrame:
        """The entry of an id, from the folders that may hold it."""
        return flat.by_id(self._rows([p for p in self._tables.read_commit().parts.get(_NAME, []) if p.low <= row_id <= p.high]), row_id)

    def replace(self, rows: DataFrame) -> int:
        """Replace all entries by rows with ids; returns the rows written."""
        parts = self._written(rows)

        def step(old: Commit) -> Commit:
            largest = max([old.largest_id, *(p.high for p in parts)])
            return replace(old, number=old.number + 1, parts=old.parts | {_NAME: parts}, largest_id=largest)

        self._tables.change(step)
        return sum(p.rows for p in parts)

    def append(self, rows: DataFrame, position: str) -> int:
        """Add rows in order of their position, and return how many; their ids go on from the largest that was ever given, which no other append
        can take too."""
        numbered = materialize(flat.new_rows_above(rows, position, 0), "new-entries")
        added = 0

        def step(old: Commit) -> Commit | None:
            nonlocal added
            parts = self._written(numbered.withColumn("id", F.col("id") + F.lit(old.largest_id)))
            added = sum(p.rows for p in parts)
            if not parts:
                return None
            mine = [*old.parts.get(_NAME, []), *parts]
            return replace(old, number=old.number + 1, parts=old.parts | {_NAME: mine}, largest_id=max(p.high for p in parts))

        self._tables.change(step)
        return added

    def update(self, changes: DataFrame, order: str | None = None) -> None:
        """Replace editable columns by id; of several changes of an id the last by `order` counts."""
        changes = materialize(changes, "changes")
        self._rewritten(changes, lambda rows: flat.update_by_id(rows, changes, order))

    def delete(self, ids: DataFrame) -> None:
        ids = materialize(ids.select("id"), "ids")
        self._rewritten(ids, lambda rows: flat.delete_by_id(rows, ids))

    def _rewritten(self, ids: DataFrame, change) -> None:
        """Commit folders anew that hold some of the ids; the others stay listed as they are."""

        def step(old: Commit) -> Commit | None:
            hit = self._hit(old.parts.get(_NAME, []), ids)
            if not hit:
                return None
            kept = [p for p in old.parts[_NAME] if p not in hit]
            parts = [*kept, *self._written(change(self._rows(hit)))]
            return replace(old, number=old.number + 1, parts=old.parts | {_NAME: parts})

        self._tables.change(step)

    def _hit(self, parts: list[Part], ids: DataFrame) -> list[Part]:
        """Folders whose range holds one of the ids; the ids are met with the ranges in Spark, only folders come back."""
        if not parts:
            return []
        spark = ids.sparkSession
        ranges = spark.createDataFrame([(i, p.low, p.high) for i, p in enumerate(parts)], "part int, low long, high long")
        found = F.broadcast(ranges).join(ids.select("id"), F.col("id").between(F.col("low"), F.col("high"))).select("part").distinct()
        return [parts[r["part"]] for r in found.collect()]


def commit_star(star: Star, spark: SparkSession, folder: str) -> None:
    """Replace all six tables by one commit: readers see the six of one load."""
    tables = VersionedTables(spark, folder)
    parts = {name: tables.write_parts(table, name) for name, table in star.tables().items()}
    tables.change(lambda old: replace(old, number=old.number + 1, parts=old.parts | parts))
