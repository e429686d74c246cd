"""Queries over the flat entries table: filters, grouped views, facets, exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import pairs as fp
from metframe.functions import text
from metframe.functions.pairs import FilterPair
from metframe.operators import scans


# --- filters ----------------------------------------------------------------------------


def candidate_rows(entries: DataFrame, pairs: Sequence[FilterPair] = (), date: str = "") -> DataFrame:
    """Rows of one date (if given) that pass the OR of the pairs' LIKE conditions."""
    rows = entries
    if date:
        rows = rows.filter(F.col("entry_date") == F.lit(date).cast("date"))
    condition = fp.prefilter(pairs, F.col("weather_system"), F.col("subdivisions"))
    return rows if condition is None else rows.filter(condition)


def _match_columns(active: Sequence[FilterPair], delimiter: str) -> list[Column]:
    return [
        fp.row_matches(p, F.col("weather_system"), F.col("subdivisions"), F.col("pressure_level"), delimiter).alias(
            f"_match{i}"
        )
        for i, p in enumerate(active)
    ]


def matching_rows(
    entries: DataFrame, pairs: Sequence[FilterPair] = (), date: str = "", delimiter: str = ","
) -> DataFrame:
    """Candidate rows that satisfy at least one active pair; the facets look at these."""
    rows = candidate_rows(entries, pairs, date)
    active = fp.active_pairs(pairs)
    if not active:
        return rows
    matched = rows.select("*", *_match_columns(active, delimiter))
    hit = reduce(lambda a, b: a | b, [F.col(f"_match{i}") for i in range(len(active))])
    return matched.filter(hit).select(*entries.columns)


def filter_entries(
    entries: DataFrame, pairs: Sequence[FilterPair] = (), date: str = "", delimiter: str = ","
) -> DataFrame:
    """Matching rows of the dates on which every active pair is met by some row.

    The division is an aggregate per date with map-side combine, then a semi join: a date
    that holds a third of all rows is never gathered into one task. With a single pair every
    matching row already proves its date, so nothing is shuffled at all.
    """
    active = fp.active_pairs(pairs)
    rows = matching_rows(entries, pairs, date, delimiter)
    if len(active) < 2:
        return rows
    names = [f"_match{i}" for i in range(len(active))]
    flags = candidate_rows(entries, pairs, date).select("entry_date", *_match_columns(active, delimiter))
    full = flags.groupBy("entry_date").agg(*[F.bool_or(n).alias(n) for n in names])
    met = full.filter(reduce(lambda a, b: a & b, [F.col(n) for n in names])).select("entry_date")
    return rows.join(met, "entry_date", "left_semi").select(*entries.columns)


def viewer_filter(entries: DataFrame, date: str = "", subdivision: str = "", delimiter: str = ";") -> DataFrame:
    listed = text.split_list(F.col("subdivisions"), delimiter)
    return entries.filter(fp.viewer_matches(F.col("entry_date"), listed, date, subdivision))


def view_order() -> list[Column]:
    """Newest date first, then system and level text, blank levels first; id breaks ties."""
    return [
        F.col("entry_date").desc(), F.col("weather_system").asc_nulls_first(),
        F.col("pressure_level").asc_nulls_first(), F.col("id").asc(),
    ]


# --- grouped views ------------------------------------------------------------------------


def _distinct_items(column: str, delimiter: str) -> Column:
    return F.array_distinct(text.split_form_list(F.col(column), delimiter))


def grouped_view(entries: DataFrame, pairs: Sequence[FilterPair] = (), date: str = "", delimiter: str = ",") -> DataFrame:
    """(entry_date, system_id, system, pressures, subdivisions): one row per date and system.

    The id is unique, so a group is a row and the view needs no grouping; the sort is a
    range exchange that spreads even a single date.
    """
    rows = filter_entries(entries, pairs, date, delimiter).orderBy(*view_order())
    return rows.select(
        "entry_date", F.col("id").alias("system_id"), F.col("weather_system").alias("system"),
        _distinct_items("pressure_level", delimiter).alias("pressures"),
        _distinct_items("subdivisions", delimiter).alias("subdivisions"),
    )


def display_numbers(rows: DataFrame) -> DataFrame:
    """Number rows from 1 within each date in view order."""
    return scans.number_rows(
        rows, "system_number", "id", groups=["entry_date"],
        major=[F.col("weather_system"), F.col("pressure_level")],
    )


def export_rows(
    entries: DataFrame, pairs: Sequence[FilterPair] = (), date: str = "", delimiter: str = ","
) -> DataFrame:
    """Rows of the grouped export under its own header names."""
    numbered = display_numbers(filter_entries(entries, pairs, date, delimiter))
    values = [
        F.col("entry_date"), F.col("system_number"), F.col("weather_system"),
        F.array_join(_distinct_items("pressure_level", delimiter), v.FORM_DELIMITER),
        F.array_join(_distinct_items("subdivisions", delimiter), v.FORM_DELIMITER),
        F.col("created_at"),
    ]
    return numbered.select(*[c.alias(name) for c, name in zip(values, v.EXPORT_HEADER)])


# --- facets -------------------------------------------------------------------------------


def facet_systems(matched: DataFrame) -> DataFrame:
    return matched.select(F.col("weather_system").alias("system")).distinct()


def facet_system_subdivisions(matched: DataFrame, delimiter: str = ",") -> DataFrame:
    """Distinct (system, subdivision) pairs; combined map-side before the shuffle."""
    items = F.explode(text.split_form_list(F.col("subdivisions"), delimiter)).alias("subdivision")
    return matched.select(F.col("weather_system").alias("system"), items).distinct()


def facet_subdivisions(matched: DataFrame, delimiter: str = ",") -> DataFrame:
    return facet_system_subdivisions(matched, delimiter).select("subdivision").distinct()


def facet_documents(matched: DataFrame, delimiter: str = ",") -> DataFrame:
    """(facet, json): the systems and the subdivisions as one array each, and one map from system to its subdivisions.

    Facets are drawn from vocabularies, and their distinct values are gathered after a map-side distinct.
    """
    pairs = facet_system_subdivisions(matched, delimiter)
    systems = facet_systems(matched).agg(F.to_json(F.sort_array(F.collect_list("system"))).alias("json"))
    names = pairs.select("subdivision").distinct().agg(F.to_json(F.sort_array(F.collect_list("subdivision"))).alias("json"))
    listed = pairs.groupBy("system").agg(F.sort_array(F.collect_list("subdivision")).alias("names"))
    by_system = listed.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("system", "names"))))).alias("json"))
    parts = {"systems": systems, "subdivisions": names, "system_subdivisions": by_system}
    labelled = [part.select(F.lit(name).alias("facet"), "json") for name, part in parts.items()]
    return reduce(DataFrame.unionByName, labelled)


def system_level_subdivisions(entries: DataFrame, delimiter: str = ";") -> DataFrame:
    """Distinct (system, level, subdivision), keeping systems without levels and levels
    without subdivisions as rows with NULLs."""
    levels = F.explode_outer(text.split_list(F.col("pressure_level"), delimiter))
    subs = F.explode_outer(text.split_list(F.col("subdivisions"), delimiter))
    rows = (
        entries.select(F.col("weather_system").alias("system"), "subdivisions", levels.alias("level"))
        .select("system", "level", F.when(F.col("level").isNotNull(), F.col("subdivisions")).alias("subdivisions"))
        .select("system", "level", subs.alias("subdivision"))
        .distinct()
    )
    known = rows.withColumns(
        {
            "_subs": F.count("subdivision").over(Window.partitionBy("system", "level")),
            "_levels": F.count("level").over(Window.partitionBy("system")),
        }
    )
    needed = (F.col("subdivision").isNotNull() | (F.col("_subs") == 0)) & (
        F.col("level").isNotNull() | (F.col("_levels") == 0)
    )
    return known.filter(needed).select("system", "level", "subdivision")


# --- legacy model ---------------------------------------------------------------------------


def newest_first(entries: DataFrame) -> DataFrame:
    return entries.orderBy(F.col("entry_date").desc(), F.col("id").asc())


def _joined_names(rows: DataFrame, name: str, out: str) -> DataFrame:
    """Distinct names of each system as one sorted text; duplicates go before gathering."""
    distinct = rows.select("system_id", name).distinct()
    return distinct.groupBy("system_id").agg(F.array_join(F.sort_array(F.collect_set(name)), ",").alias(out))


def with_systems(entries: DataFrame, systems: DataFrame, levels: DataFrame, subdivisions: DataFrame) -> DataFrame:
    """Entries with their systems, distinct levels and distinct subdivisions.

    Each child table is reduced to one row per system before the joins, so the two lists
    never multiply.
    """
    level_names = _joined_names(levels, "level_name", "pressure_levels")
    sub_names = _joined_names(subdivisions, "subdivision_name", "subdivisions")
    named = (
        systems.withColumnRenamed("id", "system_id")
        .join(level_names, "system_id", "left")
        .join(sub_names, "system_id", "left")
    )
    return entries.join(named.withColumnRenamed("entry_id", "id"), "id", "left").select(
        "id", "entry_date", "system_number", "weather_system", "pressure_levels", "subdivisions"
    )


# --- submissions ----------------------------------------------------------------------------


def filled_systems(systems: Column) -> Column:
    """Systems of a submission with at least one part given."""

    def given(s: Column) -> Column:
        listed = (F.size(s["levels"]) > 0) | (F.size(s["subdivisions"]) > 0)
        return ~F.coalesce(s["system"], F.lit("")).isin("", "0") | F.coalesce(listed, F.lit(False))

    return F.filter(systems, given)


def unpack_submissions(submissions: DataFrame, part: str | None = None) -> DataFrame:
    """One flat row per filled system, lists joined as the form writes them; `part` names a column for its place among them."""

    def joined(items: str) -> Column:
        return F.when(F.size(items) > 0, F.array_join(items, v.FORM_DELIMITER))

    kept = [c for c in submissions.columns if c != "systems"]
    rows = submissions.select(*kept, F.posexplode(filled_systems(F.col("systems"))).alias("_part", "_s"))
    return rows.select(
        *kept, *([F.col("_part").alias(part)] if part else []), F.coalesce("_s.system", F.lit("")).alias("weather_system"),
        joined("_s.subdivisions").alias("subdivisions"), joined("_s.levels").alias("pressure_level"),
    )


def max_systems(submissions: DataFrame) -> DataFrame:
    return submissions.agg(F.coalesce(F.max(F.size("systems")), F.lit(0)).alias("max_systems"))


def wide_export(submissions: DataFrame, width: int | None = None) -> DataFrame:
    """One row per submission with System, Levels and Subdivisions 1..n, blank padded.

    The width is one number from an aggregate when it is not given.
    """
    if width is None:
        width = max_systems(submissions).first()["max_systems"]

    def text_of(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    columns = [F.col("entry_date").cast("string").alias("Date")]
    for i in range(width):
        one = F.get("systems", F.lit(i))
        columns += [
            text_of(one["system"]).alias(f"System {i + 1}"),
            text_of(F.array_join(one["levels"], ";")).alias(f"Levels {i + 1}"),
            text_of(F.array_join(one["subdivisions"], ";")).alias(f"Subdivisions {i + 1}"),
        ]
    return submissions.select(*columns, F.col("created_at").alias("Created At"))
