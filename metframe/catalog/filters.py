"""Pair filters, grouped views, facets and exports over the flat entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.catalog.base import Query, distinct_sql, form_list_sql, joined, list_sql
from metframe.functions.pairs import FilterPair
from metframe.operators import flat, views
from metframe.plans import models as m
from metframe.sources import tables

# The filter pairs the queries ask for, one list per query.
SINGLE = [FilterPair(system="cycir")]
TWO_SYSTEMS = [FilterPair(system="CYCIR", subdivision="Bihar, Odisha"), FilterPair(system="Trough", subdivision="Punjab")]
SYSTEM_PRESSURE = [FilterPair(system="CYCIR", pressure_operator=">", pressure_value="800"), FilterPair(system="WD")]
PRESSURE_EQ = [FilterPair(system="Trough", pressure_operator="=", pressure_value="850")]
PRESSURE_LT = [FilterPair(pressure_operator="<", pressure_value="800")]
PRESSURE_TEXT = [FilterPair(subdivision="Bay", pressure_operator="=", pressure_value="surface")]
MIXED = [FilterPair(system="WD", subdivision="Kerala"), FilterPair(pressure_operator=">", pressure_value="700")]
MANY_SUBDIVISIONS = [FilterPair(), FilterPair(subdivision="Bihar, Odisha , Chandigarh & Delhi")]
UNKNOWN_OPERATOR = [FilterPair(system="WD"), FilterPair(system="CYCIR", pressure_operator=">=", pressure_value="700")]
VIEW_DATE = "2024-01-15"


def _system_sql(text: str) -> str:
    return f"contains(lower(weather_system), '{text.lower()}')"


def _subs_sql(*wanted: str) -> str:
    like = " OR ".join(f"subdivisions ILIKE '%{w}%'" for w in wanted)
    hold = " OR ".join(f"contains(lower(x), '{w.lower()}')" for w in wanted)
    return f"(({like}) AND len(list_filter({form_list_sql('subdivisions')}, lambda x: {hold})) > 0)"


_NUMBER = r"TRY_CAST(nullif(regexp_extract(x, '-?[0-9]+(?:\.[0-9]+)?'), '') AS DOUBLE)"


def _level_sql(condition: str) -> str:
    return f"len(list_filter({form_list_sql('pressure_level')}, lambda x: coalesce({condition}, false))) > 0"


def _pairs_sql(prefilter: str, *matches: str) -> str:
    """CTEs ending in `kept`: rows meeting some pair on dates that meet every pair."""
    flags = ", ".join(f"coalesce({match}, false) AS m{i}" for i, match in enumerate(matches))
    any_of = " OR ".join(f"m{i}" for i in range(len(matches)))
    all_of = " AND ".join(f"bool_or(m{i})" for i in range(len(matches)))
    return f"""WITH {m.entries_sql()},
flagged AS (SELECT *, {flags} FROM entries WHERE {prefilter}),
matched AS (SELECT * FROM flagged WHERE {any_of}),
kept AS (SELECT * FROM matched WHERE entry_date IN (SELECT entry_date FROM flagged GROUP BY entry_date HAVING {all_of}))
"""


_ROW = "id, entry_date, weather_system, pressure_level, subdivisions"


def _filtered(pairs, date=""):
    def run(spark, sf_dir):
        rows = views.filter_entries(m.entries(spark, sf_dir), pairs, date)
        return rows.select(*tables.ENTRY_COLUMNS).orderBy(*views.view_order())

    return run


_two = _pairs_sql(
    f"({_system_sql('CYCIR')} AND {_subs_sql('Bihar', 'Odisha')}) OR ({_system_sql('Trough')} AND {_subs_sql('Punjab')})",
    f"{_system_sql('CYCIR')} AND {_subs_sql('Bihar', 'Odisha')}",
    f"{_system_sql('Trough')} AND {_subs_sql('Punjab')}",
)
_pressure = _pairs_sql(
    f"{_system_sql('CYCIR')} OR {_system_sql('WD')}",
    f"{_system_sql('CYCIR')} AND {_level_sql(_NUMBER + ' > 800')}",
    _system_sql("WD"),
)
_levels = distinct_sql(form_list_sql("pressure_level"))
_subs = distinct_sql(form_list_sql("subdivisions"))
_numbered = """numbered AS (SELECT *, row_number() OVER (PARTITION BY entry_date
  ORDER BY weather_system NULLS FIRST, pressure_level NULLS FIRST, id) AS system_number FROM kept)"""


def _grouped(spark, sf_dir):
    rows = views.grouped_view(m.entries(spark, sf_dir), SYSTEM_PRESSURE)
    return rows.select("entry_date", "system_id", "system", joined(F.col("pressures"), "pressures"), joined(F.col("subdivisions"), "subdivisions"))


def _numbers(spark, sf_dir):
    kept = views.filter_entries(m.entries(spark, sf_dir), SYSTEM_PRESSURE)
    return views.display_numbers(kept).select("id", "entry_date", "system_number")


def _facet(build):
    return lambda spark, sf_dir: build(views.matching_rows(m.entries(spark, sf_dir), TWO_SYSTEMS))


def _legacy(spark, sf_dir):
    t = m.legacy(spark, sf_dir)
    return views.with_systems(t["entries"], t["systems"], t["levels"], t["subdivisions"])


def _unpack(spark, sf_dir):
    return views.unpack_submissions(m.submissions(spark, sf_dir))


_width = 4
_wide_sql = ", ".join(
    f"max(CASE WHEN i = {i} THEN system ELSE '' END) AS \"System {i + 1}\", "
    f"max(CASE WHEN i = {i} THEN array_to_string(levels, ';') ELSE '' END) AS \"Levels {i + 1}\", "
    f"max(CASE WHEN i = {i} THEN array_to_string(subs, ';') ELSE '' END) AS \"Subdivisions {i + 1}\""
    for i in range(_width)
)


def _wide(spark, sf_dir):
    return views.wide_export(m.submissions(spark, sf_dir))


QUERIES = [
    Query("pair_filter_all", _filtered(TWO_SYSTEMS), _two + f"SELECT {_ROW} FROM kept"),
    Query("pair_filter_single", _filtered(SINGLE), _pairs_sql(_system_sql("cycir"), _system_sql("cycir")) + f"SELECT {_ROW} FROM kept"),
    Query("pair_filter_pressure_gt", _filtered(SYSTEM_PRESSURE), _pressure + f"SELECT {_ROW} FROM kept"),
    Query(
        "pair_filter_pressure_eq", _filtered(PRESSURE_EQ),
        _pairs_sql(_system_sql("Trough"), f"{_system_sql('Trough')} AND {_level_sql(_NUMBER + ' = 850 OR contains(lower(x), ' + chr(39) + '850' + chr(39) + ')')}")
        + f"SELECT {_ROW} FROM kept",
    ),
    Query(
        "pair_filter_pressure_lt", _filtered(PRESSURE_LT),
        _pairs_sql("true", _level_sql(_NUMBER + " < 800")) + f"SELECT {_ROW} FROM kept",
    ),
    Query(
        "pair_filter_pressure_text", _filtered(PRESSURE_TEXT),
        _pairs_sql(_subs_sql("Bay"), f"{_subs_sql('Bay')} AND {_level_sql('contains(lower(x), ' + chr(39) + 'surface' + chr(39) + ')')}")
        + f"SELECT {_ROW} FROM kept",
    ),
    Query(
        "pair_filter_mixed", _filtered(MIXED),
        _pairs_sql(
            f"{_system_sql('WD')} AND {_subs_sql('Kerala')}", f"{_system_sql('WD')} AND {_subs_sql('Kerala')}",
            _level_sql(_NUMBER + " > 700"),
        ) + f"SELECT {_ROW} FROM kept",
    ),
    Query(
        "pair_filter_subdivisions", _filtered(MANY_SUBDIVISIONS),
        _pairs_sql("true", _subs_sql("Bihar", "Odisha", "Chandigarh & Delhi")) + f"SELECT {_ROW} FROM kept",
    ),
    Query(
        "pair_filter_unknown_operator", _filtered(UNKNOWN_OPERATOR),
        _pairs_sql(f"{_system_sql('WD')} OR {_system_sql('CYCIR')}", _system_sql("WD"), "false") + f"SELECT {_ROW} FROM kept",
    ),
    Query(
        "date_filter", _filtered([], VIEW_DATE),
        f"WITH {m.entries_sql()} SELECT {_ROW} FROM entries WHERE entry_date = DATE '{VIEW_DATE}'",
    ),
    Query(
        "viewer_filter",
        lambda spark, sf_dir: views.viewer_filter(
            m.entries(spark, sf_dir, v.EXTRACT_DELIMITER), VIEW_DATE, "pradesh"
        ).select(*tables.ENTRY_COLUMNS),
        f"WITH {m.entries_sql(v.EXTRACT_DELIMITER)} SELECT {_ROW} FROM entries WHERE entry_date = DATE '{VIEW_DATE}' "
        f"AND len(list_filter({list_sql('subdivisions')}, lambda x: contains(lower(x), 'pradesh'))) > 0",
    ),
    Query(
        "point_lookup",
        lambda spark, sf_dir: flat.by_id(m.entries(spark, sf_dir), 77).select(*tables.ENTRY_COLUMNS),
        f"WITH {m.entries_sql()} SELECT {_ROW} FROM entries WHERE id = 77",
    ),
    Query(
        "grouped_view", _grouped,
        _pressure + f"SELECT entry_date, id AS system_id, weather_system AS system, array_to_string({_levels}, '|') AS pressures, "
        f"array_to_string({_subs}, '|') AS subdivisions FROM kept",
    ),
    Query(
        "display_numbers", _numbers,
        _pressure.rstrip() + f", {_numbered} SELECT id, entry_date, system_number FROM numbered",
    ),
    Query(
        "export_grouped",
        lambda spark, sf_dir: views.export_rows(m.entries(spark, sf_dir), SYSTEM_PRESSURE),
        _pressure.rstrip() + f""", {_numbered} SELECT entry_date AS "Date", system_number AS "System Number",
        weather_system AS "Weather System", array_to_string({_levels}, ', ') AS "Pressure Levels",
        array_to_string({_subs}, ', ') AS "Subdivisions", created_at AS "Created At" FROM numbered""",
    ),
    Query("facet_systems", _facet(views.facet_systems), _two + "SELECT DISTINCT weather_system AS system FROM matched"),
    Query(
        "facet_subdivisions", _facet(views.facet_subdivisions),
        _two + f"SELECT DISTINCT unnest({form_list_sql('subdivisions')}) AS subdivision FROM matched",
    ),
    Query(
        "facet_system_subdivisions", _facet(views.facet_system_subdivisions),
        _two + f"SELECT DISTINCT weather_system AS system, unnest({form_list_sql('subdivisions')}) AS subdivision FROM matched",
    ),
    Query(
        "facet_json", _facet(views.facet_documents),
        _two + f"""SELECT 'systems' AS facet, CAST(to_json(list(system ORDER BY system)) AS VARCHAR) AS json FROM (SELECT DISTINCT weather_system AS system FROM matched)
        UNION ALL SELECT 'subdivisions', CAST(to_json(list(name ORDER BY name)) AS VARCHAR) FROM (SELECT DISTINCT unnest({form_list_sql('subdivisions')}) AS name FROM matched)
        UNION ALL SELECT 'system_subdivisions', '{{' || string_agg(CAST(to_json(system) AS VARCHAR) || ':' || names, ',' ORDER BY system) || '}}' FROM (
          SELECT system, CAST(to_json(list(name ORDER BY name)) AS VARCHAR) AS names
          FROM (SELECT DISTINCT weather_system AS system, unnest({form_list_sql('subdivisions')}) AS name FROM matched) GROUP BY 1)""",
    ),
    Query(
        "system_level_subdivisions",
        lambda spark, sf_dir: views.system_level_subdivisions(m.entries(spark, sf_dir, v.EXTRACT_DELIMITER)),
        f"""WITH {m.entries_sql(v.EXTRACT_DELIMITER)},
        l AS (SELECT id, weather_system AS system, subdivisions, unnest({list_sql('pressure_level')}) AS level FROM entries),
        s AS (SELECT DISTINCT system, level, unnest({list_sql('subdivisions')}) AS subdivision FROM l)
        SELECT * FROM s
        UNION ALL SELECT DISTINCT system, level, NULL FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.system = l.system AND s.level = l.level)
        UNION ALL SELECT DISTINCT weather_system, NULL, NULL FROM entries WHERE weather_system NOT IN (SELECT system FROM l)""",
    ),
    Query(
        "legacy_with_systems", _legacy,
        f"""WITH {m.legacy_sql()},
        lv AS (SELECT system_id, string_agg(DISTINCT level_name, ',' ORDER BY level_name) AS pressure_levels FROM l_levels GROUP BY 1),
        sb AS (SELECT system_id, string_agg(DISTINCT subdivision_name, ',' ORDER BY subdivision_name) AS subdivisions FROM l_subs GROUP BY 1)
        SELECT e.id, e.entry_date, s.system_number, s.weather_system, lv.pressure_levels, sb.subdivisions
        FROM l_entries e LEFT JOIN l_systems s ON s.entry_id = e.id LEFT JOIN lv ON lv.system_id = s.id LEFT JOIN sb ON sb.system_id = s.id""",
    ),
    Query(
        "legacy_newest_first",
        lambda spark, sf_dir: views.newest_first(m.legacy(spark, sf_dir)["entries"]),
        f"WITH {m.legacy_sql()} SELECT id, entry_date FROM l_entries ORDER BY entry_date DESC, id",
    ),
    Query(
        "unpack_submission", _unpack,
        f"""WITH {m.submissions_sql()} SELECT submission_id, entry_date, created_at, system AS weather_system,
        CASE WHEN len(subs) > 0 THEN array_to_string(subs, ', ') END AS subdivisions,
        CASE WHEN len(levels) > 0 THEN array_to_string(levels, ', ') END AS pressure_level
        FROM parts WHERE system <> '' OR len(subs) > 0 OR len(levels) > 0""",
    ),
    Query(
        "max_systems",
        lambda spark, sf_dir: views.max_systems(m.submissions(spark, sf_dir)),
        f"WITH {m.submissions_sql()} SELECT CAST(max(n) AS INTEGER) AS max_systems FROM (SELECT count(*) AS n FROM parts GROUP BY submission_id)",
    ),
    Query(
        "export_wide", _wide,
        f"""WITH {m.submissions_sql()}, wide AS (SELECT submission_id, CAST(entry_date AS VARCHAR) AS "Date", {_wide_sql}, created_at AS "Created At"
        FROM parts GROUP BY submission_id, entry_date, created_at) SELECT * EXCLUDE (submission_id) FROM wide""",
    ),
]
