"""Dates, sentences, region texts, lists and levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.catalog.base import Query, clean_sql, form_list_sql, joined, key_sql, list_sql
from metframe.functions import levels, text
from metframe.operators import bulletins
from metframe.plans import models as m


def _exploded(spark, sf_dir, split):
    return m.prose(spark, sf_dir).select("doc_id", F.posexplode(split(F.col("text"))).alias("sent_idx", "sentence"))


# --- the sentence splitter in steps, for the comparison engine ---------------------------

_protect = "replace(text, chr(10), ' ')"
for _pattern, _by in v.ABBREVIATIONS:
    _protect = f"regexp_replace({_protect}, '{_pattern}', '{_by}', 'gi')"
_marked = f"regexp_replace({_protect}, '([.!?])\\s+', '\\1' || chr(1), 'g')"
_glued = f"regexp_replace({_marked}, chr(1) || '({v.FRAGMENT_STARTS})', ' \\1', 'gi')"


def _pieces_sql(marked: str) -> str:
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), lambda x: trim(replace(x, '<prd>', '.'))), "
        "lambda x: x <> '')"
    )


def _clauses_sql(pieces: str) -> str:
    cut = f"regexp_replace(x, '\\.\\s+({v.CLAUSE_STARTS})', '.' || chr(2) || '\\1', 'gi')"
    parts = f"flatten(list_transform({pieces}, lambda x: string_split({cut}, chr(2))))"
    headless = f"trim(regexp_replace(y, '{v.SUMMARY_PREFIX}', '', 'gi'))"
    return f"list_filter(list_transform({parts}, lambda y: {headless}), lambda z: z <> '')"


def sentence_rows_sql(source: str, key: str, pieces: str) -> str:
    return (
        f"SELECT {key}, CAST(i - 1 AS INTEGER) AS sent_idx, s[i] AS sentence FROM "
        f"(SELECT {key}, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT {key}, {pieces} AS s FROM {source}))"
    )


def _prose(pieces: str) -> str:
    return f"WITH {m.prose_sql()} " + sentence_rows_sql("prose", "doc_id", pieces)


# --- dates ---------------------------------------------------------------------------------

_heading_parts = f"regexp_extract(text, '(?i){v.HEADING_DATE}', ['d', 'm', 'y'])"
HEADING_SQL = f"CAST(try_strptime({_heading_parts}.d || ' ' || {_heading_parts}.m || ' ' || {_heading_parts}.y, '%d %B %Y') AS DATE)"
_file_parts = f"regexp_extract(source_file, '{v.FILE_NAME_DATE}', ['y', 'm', 'd'])"
FILE_DATE_SQL = f"CAST(try_strptime({_file_parts}.y || {_file_parts}.m || {_file_parts}.d, '%Y%m%d') AS DATE)"

BULLETINS_SQL = f"""{m.paragraphs_sql()},
heads AS (SELECT source_file, arg_min(d, para_idx) AS heading_date FROM
  (SELECT source_file, para_idx, {HEADING_SQL} AS d FROM paragraphs WHERE para_idx < 10) WHERE d IS NOT NULL GROUP BY 1),
sums AS (SELECT source_file, coalesce(arg_min(text, rk * 1000 + para_idx), '') AS summary FROM
  (SELECT *, CASE WHEN contains(lower(text), '{v.SUMMARY_PHRASE}') THEN 0 ELSE 1 END AS rk FROM paragraphs WHERE trim(text) <> '') GROUP BY 1),
found AS (SELECT source_file, coalesce(heading_date, {FILE_DATE_SQL}) AS bulletin_date, summary
  FROM sums LEFT JOIN heads USING (source_file))"""


def _dates(with_bad, column):
    def run(spark, sf_dir):
        rows = m.dated_texts(spark, sf_dir, with_bad)
        return rows.select("row_pos", column(F.col("date")).alias("entry_date"))

    return run


# --- heights -------------------------------------------------------------------------------


def _heights(spark, sf_dir):
    """(id, low, high) from every event, a third of them ranges, some reversed."""
    e = m.entries(spark, sf_dir)
    c = F.col("c")
    high = F.when(c % 3 == 1, ((c * 7) % 170).cast("double") / 10)
    return e.select("id", ((c % 171).cast("double") / 10).alias("low"), high.alias("high"), "height_km", "pressure_level")


_HEIGHTS = f"""heights AS (SELECT id, CAST(c % 171 AS DOUBLE) / 10 AS low,
  CASE WHEN c % 3 = 1 THEN CAST((c * 7) % 170 AS DOUBLE) / 10 END AS high, height_km, pressure_level FROM entries)"""
_CHART = "chart(pos, hpa, km) AS (VALUES " + ", ".join(
    f"({i}, {hpa}, CAST({km} AS DOUBLE))" for i, (hpa, km) in enumerate(v.HEIGHT_CHART)
) + ")"
_TOL = v.HEIGHT_TOLERANCE_KM
_SINGLE = f"""single AS (SELECT id, hpa FROM (SELECT id, hpa, row_number() OVER (PARTITION BY id
  ORDER BY CASE WHEN abs(km - t) <= {_TOL} THEN 0 ELSE abs(km - t) END, pos) AS n
  FROM (SELECT id, CASE WHEN high > 0 THEN high ELSE low END AS t FROM heights), chart WHERE t > 0) WHERE n = 1)"""
_RANGE = f"""ranged AS (SELECT id, array_to_string(list_filter(hs, lambda x, i: list_position(hs, x) = i), '|') AS levels FROM (
  SELECT id, coalesce(list(hpa ORDER BY pos) FILTER (WHERE least(low, high) - {_TOL} <= km AND km <= greatest(low, high) + {_TOL}), []) AS hs
  FROM heights, chart WHERE high IS NOT NULL GROUP BY id))"""
HEIGHT_TEXT_SQL = f"""CASE WHEN high > 0 AND abs(high - low) > {_TOL} THEN CAST(least(low, high) AS VARCHAR) || '-' || CAST(greatest(low, high) AS VARCHAR)
  WHEN low > 0 THEN CAST(low AS VARCHAR) WHEN high > 0 THEN CAST(high AS VARCHAR) ELSE '0.0' END"""


def _single(spark, sf_dir):
    rows = _heights(spark, sf_dir)
    target = F.when(F.col("high") > 0, F.col("high")).otherwise(F.col("low"))
    return rows.select("id", levels.single_level(target).alias("hpa")).filter(F.col("hpa").isNotNull())


def _ranges(spark, sf_dir):
    rows = _heights(spark, sf_dir).filter(F.col("high").isNotNull())
    return rows.select("id", joined(levels.range_levels(F.col("low"), F.col("high")).cast("array<string>"), "levels"))


def _applied(spark, sf_dir):
    rows = _heights(spark, sf_dir)
    both = levels.level_and_height(F.col("low"), F.col("high"), F.col("height_km"), F.col("pressure_level"))
    return rows.select("id", both.alias("b")).select("id", "b.pressure_level", "b.height_km")


_APPLIED = f"""WITH {m.entries_sql()}, {_HEIGHTS}, {_CHART}, {_SINGLE}, {_RANGE},
lv AS (SELECT h.*, CASE WHEN low <= 0 AND coalesce(high, 0) <= 0 THEN '' WHEN high > 0 AND high <> low THEN r.levels ELSE CAST(s.hpa AS VARCHAR) END AS ls
  FROM heights h LEFT JOIN single s USING (id) LEFT JOIN ranged r USING (id))
SELECT id, CASE WHEN ls <> '' THEN replace(ls, '|', ' hPa ; ') || ' hPa'
  WHEN low = 0 AND coalesce(high, 0) = 0 AND coalesce(pressure_level, '') = '' THEN 'Surface' ELSE pressure_level END AS pressure_level,
  {HEIGHT_TEXT_SQL} AS height_km FROM lv"""


def _compare_text():
    """A height text as a merge sees it: plain, a range, blank or unreadable."""
    c = F.col("c")
    return F.when(c % 4 == 0, F.col("height_km")).when(
        c % 4 == 1, F.concat(F.col("height_km"), F.lit("-"), (c % 17).cast("string"))
    ).when(c % 4 == 2, F.lit("n/a"))


def _regions(spark, sf_dir, *columns):
    return m.regions(spark, sf_dir).select("id", *columns)


def _fragments_sql(text_: str) -> str:
    parts = f"list_transform(regexp_split_to_array({text_}, '\\s*;\\s*'), lambda x: {clean_sql('x')})"
    stops = ", ".join(m.sql_text(s) for s in v.FRAGMENT_STOP_PHRASES)
    return f"list_filter({parts}, lambda x: x <> '' AND lower(x) NOT IN ({stops}))"


FRAGMENTS_SQL = _fragments_sql
_coordinate = v.COORDINATE_PHRASE
PHRASES_SQL = f"regexp_extract_all(region, '(?i){_coordinate}')"
WITHOUT_PHRASES_SQL = f"regexp_replace(region, '{_coordinate}', ' ', 'gi')"


def number_sql(pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(lower(region), '{pattern}', 1), '') AS DOUBLE)"


def _half(pattern: str) -> str:
    whole = f"regexp_extract(region, '(?i){pattern}', ['n', 's'])"
    return f"CASE WHEN {whole}.n <> '' THEN {whole}.n || '°' || upper({whole}.s) END"


QUERIES = [
    Query("sentence_split", lambda s, d: _exploded(s, d, text.split_plain_sentences), _prose(_pieces_sql(_marked))),
    Query("fragment_merge", lambda s, d: _exploded(s, d, text.split_glued_sentences), _prose(_pieces_sql(_glued))),
    Query("clause_split", lambda s, d: _exploded(s, d, text.split_sentences), _prose(_clauses_sql(_pieces_sql(_glued)))),
    Query(
        "conversation_sentences",
        lambda s, d: bulletins.sentences(m.text_table(s, d, "conversations").select("conv_id", "turn", "text"), "text"),
        sentence_rows_sql("conversations", "conv_id, turn", _clauses_sql(_pieces_sql(_glued))),
    ),
    Query(
        "page_sentences",
        lambda s, d: bulletins.sentences(m.text_table(s, d, "pages").select("page_id", F.col("html").alias("text")), "text"),
        sentence_rows_sql("(SELECT page_id, html AS text FROM pages)", "page_id", _clauses_sql(_pieces_sql(_glued))),
    ),
    Query(
        "bulletin_sentences",
        lambda s, d: bulletins.sentences(bulletins.bulletins(m.documents(s, d))).drop("bulletin_date"),
        f"WITH {BULLETINS_SQL} " + sentence_rows_sql("(SELECT source_file, summary AS text FROM found)", "source_file", _clauses_sql(_pieces_sql(_glued))),
    ),
    Query(
        "normalize_text",
        lambda s, d: m.text_table(s, d, "documents").select(
            "doc_id", text.normalize_text(F.replace("text", F.lit(", "), F.lit(" – "))).alias("normalized")
        ),
        "SELECT doc_id, trim(regexp_replace(replace(replace(replace(text, ', ', ' – '), '–', '-'), '—', '-'), '\\s+', ' ', 'g')) AS normalized FROM documents",
    ),
    Query(
        "heading_date", lambda s, d: bulletins.heading_dates(m.documents(s, d)),
        f"WITH {BULLETINS_SQL} SELECT source_file, heading_date FROM heads",
    ),
    Query(
        "filename_date",
        lambda s, d: m.rows(s, d).select("row_pos", text.file_name_date(F.col("source_file")).alias("file_date")),
        f"WITH {m.rows_sql()} SELECT row_pos, {FILE_DATE_SQL} AS file_date FROM rows_",
    ),
    Query(
        "bulletin_dates", lambda s, d: bulletins.bulletins(m.documents(s, d)).select("source_file", "bulletin_date"),
        f"WITH {BULLETINS_SQL} SELECT source_file, bulletin_date FROM found",
    ),
    Query(
        "summary_paragraph", lambda s, d: bulletins.summary_paragraphs(m.documents(s, d)),
        f"WITH {BULLETINS_SQL} SELECT source_file, summary FROM found",
    ),
    Query(
        "date_normalize_strict", _dates(False, text.strict_date),
        f"""WITH {m.dated_texts_sql(False)} SELECT row_pos, CAST(coalesce(try_strptime(trim(date), '%Y-%m-%d'), try_strptime(trim(date), '%d-%m-%Y'),
        try_strptime(trim(date), '%d/%m/%Y'), try_strptime(trim(date), '%Y/%m/%d')) AS DATE) AS entry_date FROM dated""",
    ),
    Query(
        "date_normalize_lenient", _dates(True, text.lenient_date_text),
        f"""WITH {m.dated_texts_sql(True)} SELECT row_pos, CASE WHEN regexp_full_match(trim(date), '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN trim(date)
        WHEN regexp_full_match(trim(date), '\\d{{2}}-\\d{{2}}-\\d{{4}}') THEN regexp_replace(trim(date), '(\\d{{2}})-(\\d{{2}})-(\\d{{4}})', '\\3-\\2-\\1') END AS entry_date FROM dated""",
    ),
    Query(
        "subdivision_key", lambda s, d: _regions(s, d, text.subdivision_key(F.col("region")).alias("key")),
        f"WITH {m.regions_sql()} SELECT id, {key_sql('region')} AS key FROM regions_",
    ),
    Query(
        "clean_region",
        lambda s, d: _regions(s, d, text.clean_region(F.col("region")).alias("cleaned"), text.region_key(F.col("region")).alias("key")),
        f"WITH {m.regions_sql()} SELECT id, {clean_sql('region')} AS cleaned, regexp_replace(lower({clean_sql('region')}), '\\s+', ' ', 'g') AS key FROM regions_",
    ),
    Query(
        "format_regions", lambda s, d: _regions(s, d, text.format_regions(F.split("region", ";")).alias("formatted")),
        f"""WITH {m.regions_sql()} SELECT id, array_to_string(list_filter(list_transform(string_split(region, ';'), lambda x: {clean_sql('x')}),
        lambda x: x <> ''), ' ; ') AS formatted FROM regions_""",
    ),
    Query(
        "split_fragments", lambda s, d: _regions(s, d, joined(text.split_fragments(F.col("region")), "fragments")),
        f"WITH {m.regions_sql()} SELECT id, array_to_string({_fragments_sql('region')}, '|') AS fragments FROM regions_",
    ),
    Query(
        "coordinate_phrases",
        lambda s, d: _regions(
            s, d, joined(text.coordinate_phrases(F.col("region")), "phrases"),
            text.without_coordinate_phrases(F.col("region")).alias("remaining"),
            text.is_coordinate_region(F.col("region")).alias("is_axis"),
        ),
        f"""WITH {m.regions_sql()} SELECT id, array_to_string(list_transform({PHRASES_SQL}, lambda x: trim(x)), '|') AS phrases,
        {WITHOUT_PHRASES_SQL} AS remaining, regexp_matches(lower(region), '{v.COORDINATE_REGION}') AS is_axis FROM regions_""",
    ),
    Query(
        "coordinate_parse",
        lambda s, d: _regions(
            s, d, text.longitude(F.col("region")).alias("longitude"), text.min_latitude(F.col("region")).alias("min_latitude")
        ),
        f"WITH {m.regions_sql()} SELECT id, {number_sql(v.LONGITUDE)} AS longitude, {number_sql(v.LATITUDE)} AS min_latitude FROM regions_",
    ),
    Query(
        "hemisphere_point",
        lambda s, d: _regions(s, d, text.hemisphere_point(F.col("region")).alias("p")).select("id", "p.latitude", "p.longitude"),
        f"WITH {m.regions_sql()} SELECT id, {_half(v.LATITUDE_HEMISPHERE)} AS latitude, {_half(v.LONGITUDE_HEMISPHERE)} AS longitude FROM regions_",
    ),
    Query(
        "list_split",
        lambda s, d: m.entries(s, d).select(
            "id", joined(text.split_list(F.col("subdivisions"), ";"), "by_semicolon"),
            joined(text.split_form_list(F.col("subdivisions"), ","), "by_comma"),
        ),
        f"""WITH {m.entries_sql()} SELECT id, array_to_string({list_sql('subdivisions')}, '|') AS by_semicolon,
        array_to_string({form_list_sql('subdivisions')}, '|') AS by_comma FROM entries""",
    ),
    Query(
        "blank_to_null",
        lambda s, d: m.entries(s, d).select("id", text.blank_to_null(F.concat("weather_system", F.lit("  "))).alias("weather_system")),
        f"WITH {m.entries_sql()} SELECT id, nullif(trim(weather_system || '  '), '') AS weather_system FROM entries",
    ),
    Query(
        "level_hpa",
        lambda s, d: m.entries(s, d).select("id", text.level_hpa(F.col("pressure_level")).alias("hpa")),
        f"WITH {m.entries_sql()} SELECT id, TRY_CAST(string_split(pressure_level, ' ')[1] AS INTEGER) AS hpa FROM entries",
    ),
    Query(
        "height_single_level", _single,
        f"WITH {m.entries_sql()}, {_HEIGHTS}, {_CHART}, {_SINGLE} SELECT id, hpa FROM single",
    ),
    Query(
        "height_range_levels", _ranges,
        f"WITH {m.entries_sql()}, {_HEIGHTS}, {_CHART}, {_RANGE} SELECT id, levels FROM ranged",
    ),
    Query(
        "height_format",
        lambda s, d: _heights(s, d).select("id", levels.format_height(F.col("low"), F.col("high")).alias("height_text")),
        f"WITH {m.entries_sql()}, {_HEIGHTS} SELECT id, {HEIGHT_TEXT_SQL} AS height_text FROM heights",
    ),
    Query(
        "height_compare",
        lambda s, d: m.entries(s, d).select("id", levels.height_value(_compare_text()).alias("height")),
        f"""WITH {m.entries_sql()} SELECT id, coalesce(CASE c % 4 WHEN 0 THEN TRY_CAST(height_km AS DOUBLE) WHEN 1 THEN CAST(c % 17 AS DOUBLE) END, 0.0) AS height FROM entries""",
    ),
    Query("levels_and_heights", _applied, _APPLIED),
    Query(
        "surface_default",
        lambda s, d: m.entries(s, d).select("id", levels.surface_default(F.col("pressure_level"), F.col("height_km")).alias("pressure_level")),
        f"WITH {m.entries_sql()} SELECT id, CASE WHEN coalesce(pressure_level, '') = '' AND height_km IN ('0', '0.0') THEN 'Surface' ELSE pressure_level END AS pressure_level FROM entries",
    ),
]
