"""Dedup-merge, output rows, the star schema and upkeep of the flat table."""

from __future__ import annotations

from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.catalog import places
from metframe.catalog.base import Query, list_sql
from metframe.operators import flat, merge, star, views
from metframe.plans import models as m
from metframe.session import spread
from metframe.sinks import writers

_POSITION = "row_pos"

# --- dedup-merge ---------------------------------------------------------------------------

_height = """CASE WHEN contains(coalesce(height_km, ''), '-') THEN coalesce(TRY_CAST(string_split(height_km, '-')[-1] AS DOUBLE), 0)
  ELSE coalesce(TRY_CAST(height_km AS DOUBLE), 0) END"""
_group = "date, source_file, weather_system, region_key"
DEDUP_SQL = f"""{m.rows_sql()},
dk AS (SELECT *, regexp_replace(lower(trim(region)), '\\s+', ' ', 'g') AS region_key, {_height} AS hv FROM rows_
  WHERE NOT coalesce(contains(lower(status), '{v.LESS_MARKED_PHRASE}'), false)),
dt AS (SELECT *, coalesce(min(row_pos) FILTER (WHERE hv > 0) OVER g, min(row_pos) OVER g) AS src, min(row_pos) FILTER (WHERE hv > 0) OVER g AS high_at
  FROM dk WINDOW g AS (PARTITION BY {_group})),
merged AS (SELECT date, source_file, weather_system, min(row_pos) AS row_pos, arg_min(region, row_pos) AS region, arg_min(struct_pack(s := subdivisions), row_pos).s AS subdivisions,
  max(height_km) FILTER (WHERE row_pos = src) AS height_km,
  arg_min(pressure_level, row_pos) FILTER (WHERE pressure_level <> '' AND (high_at IS NULL OR row_pos >= high_at)) AS pressure_level,
  max_by(status, row_pos) FILTER (WHERE status <> '') AS status FROM dt GROUP BY {_group})"""


def _merged(spark, sf_dir):
    rows = merge.dedup_merge(m.rows(spark, sf_dir), _POSITION)
    return rows.select(
        "date", "source_file", "weather_system", "row_pos", "region", "subdivisions", "height_km", "pressure_level", "status"
    )


def _form_rows(spark, sf_dir):
    """Unpacked submissions as extraction rows, in another order of columns."""
    parts = views.unpack_submissions(m.submissions(spark, sf_dir))
    given = {"date": F.col("entry_date").cast("string"), "row_pos": F.col("submission_id"), "source_file": F.lit("form")}
    kept = {c: F.col(c) for c in ("weather_system", "subdivisions", "pressure_level")}
    blank = F.lit(None).cast("string")
    return parts.select(*[(given | kept).get(c, blank).alias(c) for c in _UNION])


_UNION = ["status", "date", "row_pos", "source_file", "weather_system", "subdivisions", "region", "region_original", "height_km", "pressure_level"]


def _union(spark, sf_dir):
    return merge.union_rows(m.rows(spark, sf_dir).drop("c"), _form_rows(spark, sf_dir))


# --- output rows -----------------------------------------------------------------------------

_surface = "CASE WHEN coalesce(pressure_level, '') = '' AND trim(height_km) IN ('0', '0.0') THEN 'Surface' ELSE coalesce(pressure_level, '') END"
_unmarked = f"NOT coalesce(contains(lower(status), '{v.LESS_MARKED_PHRASE}'), false)"
_out = f"""date, source_file, weather_system, region, coalesce(region_original, '') AS region_original, height_km,
  {_surface} AS pressure_level, coalesce(status, '') AS status"""


def _plain(spark, sf_dir):
    return spread(m.rows(spark, sf_dir).drop("subdivisions"))


# --- star ------------------------------------------------------------------------------------


def _star(pick):
    return lambda spark, sf_dir: pick(star.build_star(m.rows(spark, sf_dir), _POSITION))


STAR_SQL = f"""WITH {m.rows_sql()},
sy AS (SELECT *, row_number() OVER (ORDER BY row_pos) AS system_id, row_number() OVER (PARTITION BY date ORDER BY row_pos) AS system_seq
  FROM rows_ WHERE trim(weather_system) IN ('WD', 'CYCIR', 'Trough')),
dd AS (SELECT row_number() OVER (ORDER BY date) AS id, date AS entry_date FROM (SELECT DISTINCT date FROM sy)),
ss AS (SELECT system_id, unnest({list_sql('subdivisions')}) AS name FROM sy),
ds AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT name FROM ss)),
ll AS (SELECT system_id, unnest({list_sql('pressure_level')}) AS label FROM sy),
dl AS (SELECT row_number() OVER (ORDER BY hpa NULLS LAST, label) AS id, label, hpa FROM
  (SELECT DISTINCT label, TRY_CAST(string_split(label, ' ')[1] AS INTEGER) AS hpa FROM ll))
"""

# --- flat table ------------------------------------------------------------------------------


def _strict(spark, sf_dir):
    return flat.reload_strict(m.dated_texts(spark, sf_dir, False), _POSITION).select(*_ENTRY)


def _lenient(spark, sf_dir):
    return flat.reload_lenient(m.dated_texts(spark, sf_dir, True), _POSITION).select(*_ENTRY)


def _counts(spark, sf_dir):
    return flat.import_counts(m.dated_texts(spark, sf_dir, True), _POSITION)


_SHAPE = """CASE WHEN regexp_full_match(trim(date), '\\d{4}-\\d{2}-\\d{2}') THEN trim(date)
  WHEN regexp_full_match(trim(date), '\\d{2}-\\d{2}-\\d{4}') THEN regexp_replace(trim(date), '(\\d{2})-(\\d{2})-(\\d{4})', '\\3-\\2-\\1') END"""
LENIENT_SQL = f"""WITH {m.dated_texts_sql(True)},
sh AS (SELECT *, {_SHAPE} AS shape FROM dated),
oc AS (SELECT *, TRY_CAST(shape AS DATE) AS entry_date, CASE WHEN shape IS NULL THEN 'skipped' WHEN TRY_CAST(shape AS DATE) IS NULL THEN 'failed' ELSE 'inserted' END AS outcome FROM sh)
"""
_FORM_LISTS = """CASE WHEN len(subs) > 0 THEN array_to_string(subs, ', ') END AS subdivisions,
  CASE WHEN len(levels) > 0 THEN array_to_string(levels, ', ') END AS pressure_level"""
_FILLED = "(system <> '' OR len(subs) > 0 OR len(levels) > 0)"


def _append(spark, sf_dir):
    """All unpacked submissions after the entries; a submission's systems are in the order of the form."""
    parts = views.unpack_submissions(m.submissions(spark, sf_dir), "part")
    placed = parts.withColumn("place", F.col("submission_id") * 16 + F.col("part"))
    return flat.append_rows(_entries(spark, sf_dir), placed, "place").select(*_ENTRY)


_ENTRY = ["id", "entry_date", "weather_system", "subdivisions", "pressure_level"]
_entry_sql = ", ".join(_ENTRY)


def _changes(spark, sf_dir):
    """Form rows that replace the entry with the id of their submission."""
    o = m.table(spark, sf_dir, "orders")
    return o.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("entry_date"),
        F.lit("Edited").alias("weather_system"), F.col("o_orderpriority").alias("subdivisions"),
        F.lit(None).cast("string").alias("pressure_level"),
    )


_CHANGES_SQL = """ch AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS entry_date, 'Edited' AS weather_system, o_orderpriority AS subdivisions,
  CAST(NULL AS VARCHAR) AS pressure_level FROM orders WHERE o_orderstatus = 'F')"""


def _entries(spark, sf_dir):
    return m.entries(spark, sf_dir).select(*_ENTRY)


QUERIES = [
    Query("dedup_merge", _merged, f"WITH {DEDUP_SQL} SELECT * FROM merged"),
    Query(
        "union_rows", _union,
        f"""WITH {m.rows_sql()}, {m.submissions_sql()} SELECT {', '.join(sorted(_UNION))} FROM rows_ UNION ALL BY NAME
        SELECT CAST(entry_date AS VARCHAR) AS date, submission_id AS row_pos, 'form' AS source_file, system AS weather_system, {_FORM_LISTS}
        FROM parts WHERE {_FILLED}""",
    ),
    Query(
        "extraction_rows", lambda s, d: writers.extraction_rows(_plain(s, d)),
        f"WITH {m.rows_sql()} SELECT {_out} FROM rows_ WHERE {_unmarked}",
    ),
    Query(
        "enriched_rows", lambda s, d: writers.enriched_rows(_plain(s, d)),
        f"""WITH {m.rows_sql()}, {places.ALIAS_SQL}, {places.OFFICIAL_SQL}, {places.FORM_SQL}, {places.subdivisions_sql('rows_')}
        SELECT {_out}, array_to_string(subs, ' ; ') AS subdivisions FROM rows_ JOIN mapped ON text = region WHERE {_unmarked}""",
    ),
    Query("star_dates", _star(lambda t: t.dim_date), STAR_SQL + "SELECT * FROM dd"),
    Query("star_subdivisions", _star(lambda t: t.dim_subdivision), STAR_SQL + "SELECT * FROM ds"),
    Query("star_levels", _star(lambda t: t.dim_level), STAR_SQL + "SELECT * FROM dl"),
    Query(
        "star_systems", _star(lambda t: t.fact_system),
        STAR_SQL + "SELECT system_id AS id, dd.id AS entry_id, system_seq, weather_system FROM sy JOIN dd ON dd.entry_date = sy.date",
    ),
    Query(
        "star_system_subdivisions", _star(lambda t: t.system_subdivision),
        STAR_SQL + "SELECT system_id, ds.id AS subdivision_id FROM ss JOIN ds USING (name)",
    ),
    Query(
        "star_system_levels", _star(lambda t: t.system_level),
        STAR_SQL + "SELECT system_id, dl.id AS pressure_level_id FROM ll JOIN dl USING (label)",
    ),
    Query(
        "flat_reload_strict", _strict,
        f"""WITH {m.dated_texts_sql(False)} SELECT row_number() OVER (ORDER BY row_pos) AS id,
        CAST(coalesce(try_strptime(trim(date), '%Y-%m-%d'), try_strptime(trim(date), '%d-%m-%Y'), try_strptime(trim(date), '%d/%m/%Y'), try_strptime(trim(date), '%Y/%m/%d')) AS DATE) AS entry_date,
        trim(weather_system) AS weather_system, nullif(trim(pressure_level), '') AS pressure_level, nullif(trim(subdivisions), '') AS subdivisions
        FROM dated WHERE trim(weather_system) <> ''""",
    ),
    Query(
        "flat_reload_lenient", _lenient,
        LENIENT_SQL + f"""SELECT row_number() OVER (ORDER BY row_pos) AS id, entry_date, trim(weather_system) AS weather_system,
        nullif(trim(subdivisions), '') AS subdivisions, nullif({_surface}, '') AS pressure_level FROM oc WHERE outcome = 'inserted'""",
    ),
    Query(
        "import_counts", _counts,
        LENIENT_SQL + ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in ("inserted", "failed", "skipped")).join(["SELECT ", " FROM oc"]),
    ),
    Query(
        "append_rows", _append,
        f"""WITH {m.entries_sql()}, {m.submissions_sql()} SELECT {_entry_sql} FROM entries UNION ALL BY NAME
        SELECT (SELECT max(id) FROM entries) + row_number() OVER (ORDER BY submission_id, i) AS id, entry_date, system AS weather_system, {_FORM_LISTS}
        FROM parts WHERE {_FILLED}""",
    ),
    Query(
        "update_by_id", lambda s, d: flat.update_by_id(_entries(s, d), _changes(s, d)),
        f"""WITH {m.entries_sql()}, {_CHANGES_SQL} SELECT e.id, {", ".join(f"CASE WHEN ch.id IS NOT NULL THEN ch.{c} ELSE e.{c} END AS {c}" for c in _ENTRY[1:])}
        FROM entries e LEFT JOIN ch ON ch.id = e.id""",
    ),
    Query(
        "delete_by_id", lambda s, d: flat.delete_by_id(_entries(s, d), _changes(s, d)),
        f"WITH {m.entries_sql()}, {_CHANGES_SQL} SELECT {_entry_sql} FROM entries WHERE id NOT IN (SELECT id FROM ch)",
    ),
]
