"""Field extraction over bulletin sentences, and the context carry between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.catalog.base import Query, clean_sql
from metframe.functions import fields, text
from metframe.operators import entities
from metframe.plans import models as m
from metframe.session import materialize

_KEYS = ["source_file", "sent_idx"]
_S = "sentences_ AS (SELECT source_file, sent_idx, sentence, lower(sentence) AS s FROM sentences)"
_FROM = f"WITH {m.sentences_sql()}, {_S} SELECT source_file, sent_idx, "


def _on(*columns):
    def run(spark, sf_dir):
        rows = m.sentences(spark, sf_dir).withColumn("s", F.lower(text.normalize_text(F.col("sentence"))))
        return rows.select(*_KEYS, *[build(F.col("s")).alias(name) for name, build in columns])

    return run


def label_sql(rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN '{label}'" for p, label in rules) + " END"


def number_sql(pattern: str, index: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract(s, '{pattern}', {index}), '') AS DOUBLE)"


PRIMARY_SQL = f"CASE WHEN regexp_matches(s, '{v.CONTINUATION}') THEN NULL ELSE {label_sql(v.SUBJECT_SYSTEMS)} END"
STATUS_SQL = label_sql(v.STATUSES)
PRESSURE_SQL = (
    f"CASE WHEN contains(s, 'surface') THEN 'surface' WHEN regexp_matches(s, '{v.PRESSURE_TEXT}') "
    f"THEN regexp_extract(s, '{v.PRESSURE_TEXT}', 1) || ' hPa' END"
)
LOW_SQL = f"coalesce({number_sql(v.HEIGHT_BETWEEN)}, {', '.join(number_sql(p) for p in v.HEIGHT_SINGLE)}, 0.0)"
HIGH_SQL = number_sql(v.HEIGHT_BETWEEN, 2)
HEIGHT_SQL = f"CASE WHEN {HIGH_SQL} > 0 THEN {HIGH_SQL} ELSE greatest({LOW_SQL}, 0.0) END"


def _axis_text(start: str) -> str:
    head = f"trim(regexp_extract(substr(s, instr(s, '{start}')), '^(.*?)(?:{v.COORDINATE_STOP}|$)', 1), ' ,.;')"
    return f"CASE WHEN length({head}) > {v.COORDINATE_MIN_CHARS} THEN {head} END"


FALLBACK_SQL = f"CASE WHEN contains(s, 'along') AND (contains(s, 'long') OR contains(s, 'lat')) THEN {_axis_text('along')} END"
CYCIR_SQL = clean_sql("coalesce(" + ", ".join(f"nullif(regexp_extract(s, '{p}', 1), '')" for p in v.CYCIR_REGIONS) + ")")


def _path(pattern: str) -> str:
    found = f"regexp_extract(s, '{pattern}', ['a', 'b', 'c'])"
    raw = f"list_filter([{found}.a, {found}.b, {found}.c], lambda x: x <> '')"
    return f"CASE WHEN regexp_matches(s, '{pattern}') THEN list_transform({raw}, lambda x: {clean_sql('x')}) END"


PATH_SQL = f"coalesce({', '.join(_path(p) for p in v.PATH_REGIONS)}, CAST([] AS VARCHAR[]))"


def _phrase(keyword: str) -> str:
    return f"nullif(regexp_extract(s, '\\b{keyword}{v.KEYWORD_REGION}', 1), '')"


def _bare(region: str) -> str:
    return f"{region} IN ({', '.join(m.sql_text(w) for w in v.BARE_COORDINATE_WORDS)})"


_off_path = ", ".join(
    f"CASE WHEN {clean_sql(_phrase(k))} <> '' AND NOT {_bare(clean_sql(_phrase(k)))} THEN {clean_sql(_phrase(k))} END"
    for k in v.REGION_KEYWORDS
)
OFF_PATH_SQL = f"coalesce({clean_sql(FALLBACK_SQL)}, {_off_path})"
TROUGH_REGION_SQL = (
    f"CASE WHEN len({PATH_SQL}) > 0 THEN array_to_string(list_filter(list_transform({PATH_SQL}, lambda x: {clean_sql('x')}), "
    f"lambda x: x <> ''), ' ; ') ELSE {OFF_PATH_SQL} END"
)
_over = v.WD_OVER.replace("(?=", "(?:")
_chunk = f"regexp_extract(s, '{v.WD_START}')"
_named = f"list_filter(list_transform(regexp_extract_all({_chunk}, '{_over}', 1), lambda x: {clean_sql('x')}), lambda x: x <> '')"
_axis = clean_sql(f"regexp_replace({FALLBACK_SQL}, '{v.OBSERVATION_HOUR}', '', 'gi')")
WD_SQL = f"""CASE WHEN NOT contains(s, 'western disturbance') THEN '' WHEN len({_named}) > 0 THEN array_to_string({_named}, '|')
  ELSE coalesce({_axis}, '') END"""
_additional = f"regexp_matches(s, '{v.ADDITIONAL_TROUGH}')"
ALOFT_REGION_SQL = f"CASE WHEN {_additional} AND contains(s, 'along long') THEN coalesce({clean_sql(FALLBACK_SQL)}, '') ELSE '' END"
ALOFT_HEIGHT_SQL = f"CASE WHEN {_additional} THEN coalesce({number_sql(v.ALOFT_HEIGHT)}, 0.0) ELSE 0.0 END"


def _generic() -> str:
    whens = [
        f"WHEN contains(s, 'along long') AND {_axis_text('along long')} IS NOT NULL THEN {_axis_text('along long')}",
        f"WHEN contains(s, 'along lat') AND {_axis_text('along lat')} IS NOT NULL THEN {_axis_text('along lat')}",
    ]
    for keyword in v.REGION_KEYWORDS:
        region = f"trim({_phrase(keyword)})"
        whens.append(
            f"WHEN {region} IS NOT NULL AND NOT {_bare(region)} THEN "
            f"CASE WHEN regexp_matches({region}, '{v.SAME_REGION}') THEN NULL ELSE {region} END"
        )
    found = f"regexp_extract(s, '{v.GENERIC_PATH}', ['a', 'b', 'c'])"
    ends = f"list_filter([trim({found}.a), trim({found}.b), trim({found}.c)], lambda x: x <> '')"
    whens.append(f"WHEN regexp_matches(s, '{v.GENERIC_PATH}') THEN array_to_string({ends}, ' ; ')")
    return "CASE " + " ".join(whens) + " END"


GENERIC_SQL = _generic()
PARSED_SQL = f"""{PRIMARY_SQL} AS weather_system, {GENERIC_SQL} AS region, {HEIGHT_SQL} AS height_km,
  {PRESSURE_SQL} AS pressure_level, {STATUS_SQL} AS status"""


def _parsed(spark, sf_dir):
    return entities.parsed_sentences(m.sentences(spark, sf_dir))


def _carried(spark, sf_dir):
    parsed = materialize(_parsed(spark, sf_dir), "parsed")
    return entities.resolve_context(parsed).drop("bulletin_date", "sentence")


_w = "OVER (PARTITION BY source_file ORDER BY sent_idx"
CONTEXT_SQL = f"""WITH {m.sentences_sql()}, {_S},
parsed AS (SELECT source_file, sent_idx, s, {PARSED_SQL} FROM sentences_),
looked AS (SELECT *,
  last_value(CASE WHEN weather_system IS NOT NULL THEN nullif(region, '') END IGNORE NULLS) {_w} ROWS UNBOUNDED PRECEDING) AS last_region,
  last_value(weather_system IGNORE NULLS) {_w} ROWS UNBOUNDED PRECEDING) AS last_system,
  lead(weather_system) {_w}) AS next_system, lead(height_km) {_w}) AS next_height FROM parsed),
filled AS (SELECT *, CASE WHEN weather_system IS NULL AND regexp_matches(s, '{v.SYSTEM_CARRY}') THEN last_system ELSE weather_system END AS system,
  CASE WHEN nullif(region, '') IS NULL AND regexp_matches(s, '{v.SAME_REGION_CARRY}') THEN last_region ELSE region END AS place FROM looked)
SELECT source_file, sent_idx, system AS weather_system, place AS region,
  CASE WHEN system IS NOT NULL AND height_km = 0 AND next_system IS NULL AND next_height > 0 THEN next_height ELSE height_km END AS height_km,
  pressure_level, status FROM filled"""


def _parse_query(spark, sf_dir):
    return _parsed(spark, sf_dir).drop("bulletin_date", "sentence")


def _ends(s):
    return fields.height_range(s)


QUERIES = [
    Query(
        "sentence_filters",
        _on(
            ("monsoon_limit", text.is_monsoon_limit), ("forecast", text.is_forecast), ("continuation", text.is_continuation),
            ("additional_trough", text.has_additional_trough), ("less_marked", lambda s: text.is_less_marked(fields.status(s))),
        ),
        _FROM + f"""contains(s, '{v.MONSOON_LIMIT_PHRASE}') AS monsoon_limit, regexp_matches(s, '{v.FORECAST}') AS forecast,
        regexp_matches(s, '{v.CONTINUATION}') AS continuation, {_additional} AS additional_trough,
        coalesce(contains({STATUS_SQL}, '{v.LESS_MARKED_PHRASE}'), false) AS less_marked FROM sentences_""",
    ),
    Query("primary_system", _on(("system", fields.primary_system)), _FROM + f"{PRIMARY_SQL} AS system FROM sentences_"),
    Query(
        "trough_by_verb", _on(("by_verb", fields.trough_by_verb), ("by_word", fields.trough_by_word)),
        _FROM + f"""CASE WHEN regexp_matches(s, '{v.TROUGH_VERB}') THEN 'Trough' END AS by_verb,
        CASE WHEN regexp_matches(s, '{v.TROUGH_WORD}') THEN 'Trough' END AS by_word FROM sentences_""",
    ),
    Query("detailed_system", _on(("system", fields.detailed_system)), _FROM + f"{label_sql(v.DETAILED_SYSTEMS)} AS system FROM sentences_"),
    Query(
        "associated_system", _on(("system", fields.associated_system)),
        _FROM + f"{label_sql(v.ASSOCIATED_SYSTEMS)} AS system FROM sentences_",
    ),
    Query("status_extract", _on(("status", fields.status)), _FROM + f"{STATUS_SQL} AS status FROM sentences_"),
    Query(
        "pressure_extract",
        lambda s, d: m.entries(s, d).select("id", fields.pressure_text(F.lower("pressure_level")).alias("level")),
        f"WITH {m.entries_sql()} SELECT id, {PRESSURE_SQL} AS level FROM (SELECT id, lower(pressure_level) AS s FROM entries)",
    ),
    Query(
        "height_range_extract",
        _on(("low", lambda s: _ends(s)["low"]), ("high", lambda s: _ends(s)["high"]), ("height", fields.height)),
        _FROM + f"{LOW_SQL} AS low, {HIGH_SQL} AS high, {HEIGHT_SQL} AS height FROM sentences_",
    ),
    Query("cycir_region", _on(("region", fields.cycir_region)), _FROM + f"{CYCIR_SQL} AS region FROM sentences_"),
    Query(
        "trough_path", lambda s, d: _on(("regions", lambda x: F.array_join(fields.path_regions(x), "|")))(s, d),
        _FROM + f"array_to_string({PATH_SQL}, '|') AS regions FROM sentences_",
    ),
    Query("trough_region", _on(("region", fields.trough_region)), _FROM + f"{TROUGH_REGION_SQL} AS region FROM sentences_"),
    Query(
        "coordinate_fallback", _on(("region", fields.coordinate_fallback)), _FROM + f"{FALLBACK_SQL} AS region FROM sentences_"
    ),
    Query(
        "wd_regions", _on(("regions", lambda s: F.array_join(fields.wd_regions(s), "|"))),
        _FROM + f"{WD_SQL} AS regions FROM sentences_",
    ),
    Query(
        "aloft_trough",
        _on(
            ("regions", lambda s: F.array_join(fields.aloft_trough(s)["regions"], "|")),
            ("height", lambda s: fields.aloft_trough(s)["height"]),
        ),
        _FROM + f"{ALOFT_REGION_SQL} AS regions, {ALOFT_HEIGHT_SQL} AS height FROM sentences_",
    ),
    Query("generic_region", _on(("region", fields.generic_region)), _FROM + f"{GENERIC_SQL} AS region FROM sentences_"),
    Query("parse_sentence", _parse_query, _FROM + f"{PARSED_SQL} FROM sentences_"),
    Query("context_carry", _carried, CONTEXT_SQL),
]
