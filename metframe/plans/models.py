"""The domain tables derived from the driver's tables, once for Spark and once as SQL.

The driver's tables hold no bulletins. Each model turns every row of one of them into a
row of a bulletin-domain table by fixed arithmetic, so its size grows with the input. The
`*_sql` twin of a model is the same rule for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions.literals import text_array
from metframe.functions.text import subdivision_key
from metframe.session import spread

N = len(v.OFFICIAL_SUBDIVISIONS)

# What the event types stand for.
SYSTEM_OF_EVENT = {"view": "CYCIR", "click": "Trough", "purchase": "WD", "signup": "Depression (D)"}
ENTRY_LEVELS = ["Surface", "850 hPa", "850 hPa{d}700 hPa"]
RANGE_LOWS = ["0.9", "1.5", "3.1"]
RANGE_HIGHS = ["4.5", "5.8", "7.6"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table about to go through text work, dealt out over the cores when it is one piece."""
    return spread(table(spark, sf_dir, name))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(x) for x in values) + "]"


NAMES_SQL = sql_list(v.OFFICIAL_SUBDIVISIONS)


def _names() -> Column:
    return text_array(v.OFFICIAL_SUBDIVISIONS)


def _name_at(index: Column) -> Column:
    return F.get(_names(), (index % N).cast("int"))


def cents() -> Column:
    return F.floor(F.col("value") * 100 + 0.5).cast("bigint")


CENTS_SQL = "CAST(floor(value * 100 + 0.5) AS BIGINT)"


def case_sql(subject: str, values: dict, default: str) -> str:
    whens = " ".join(f"WHEN {sql_text(k) if isinstance(k, str) else k} THEN {x}" for k, x in values.items())
    return f"CASE {subject} {whens} ELSE {default} END"


# --- entries -------------------------------------------------------------------------------


def entries(spark: SparkSession, sf_dir: str, delimiter: str = v.FORM_DELIMITER) -> DataFrame:
    """Flat entries, one per event, with lists joined by `delimiter`."""
    e = table(spark, sf_dir, "events").withColumn("c", cents())
    event = F.col("event_type")
    system = F.coalesce(*[F.when(event == k, F.lit(s)) for k, s in SYSTEM_OF_EVENT.items()], F.lit(""))
    level = F.coalesce(*[F.when(F.col("c") % 4 == i + 1, F.lit(t.format(d=delimiter))) for i, t in enumerate(ENTRY_LEVELS)])
    subs = F.when(
        F.col("user_id") % 5 != 0,
        F.concat(_name_at(F.col("user_id")), F.lit(delimiter), _name_at(F.col("event_id"))),
    )
    whole = F.floor(F.col("c") / 3000).cast("string")
    height = F.when(F.col("c") % 3 == 0, F.lit("0.0")).otherwise(
        F.concat(whole, F.lit("."), (F.col("c") % 10).cast("string"))
    )
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("date").alias("entry_date"), system.alias("weather_system"),
        subs.alias("subdivisions"), level.alias("pressure_level"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"), height.alias("height_km"),
        "c", "user_id",
    )


def entries_sql(delimiter: str = v.FORM_DELIMITER) -> str:
    system = case_sql("event_type", {k: sql_text(s) for k, s in SYSTEM_OF_EVENT.items()}, "''")
    level = case_sql("c % 4", {i + 1: sql_text(t.format(d=delimiter)) for i, t in enumerate(ENTRY_LEVELS)}, "NULL")
    return f"""entries AS (
  SELECT event_id AS id, CAST(ts AS DATE) AS entry_date, {system} AS weather_system,
    CASE WHEN user_id % 5 <> 0 THEN {NAMES_SQL}[user_id % {N} + 1] || {sql_text(delimiter)} || {NAMES_SQL}[event_id % {N} + 1] END AS subdivisions,
    {level} AS pressure_level, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at,
    CASE WHEN c % 3 = 0 THEN '0.0' ELSE CAST(c // 3000 AS VARCHAR) || '.' || CAST(c % 10 AS VARCHAR) END AS height_km,
    c, user_id
  FROM (SELECT *, {CENTS_SQL} AS c FROM events))"""


# --- enriched rows ----------------------------------------------------------------------------


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched extraction rows (all texts, `;` lists) with their position in the file."""
    e = entries(spark, sf_dir, v.EXTRACT_DELIMITER)
    user, c = F.col("user_id"), F.col("c")
    region = F.concat(F.lit("north "), F.lower(_name_at(user % 7)), F.when(c % 2 == 0, F.lit("  & Area")).otherwise(F.lit("")))
    status = F.when(c % 11 == 0, F.lit("became less marked")).when(c % 3 == 0, F.lit("persisted")).when(
        c % 3 == 1, F.lit("lay over")
    )
    return e.select(
        F.col("id").alias("row_pos"), F.col("entry_date").cast("string").alias("date"),
        F.concat(F.lit("AIWS "), F.date_format("entry_date", "yyyyMMdd"), F.lit(".docx")).alias("source_file"),
        "weather_system", "subdivisions", region.alias("region"), F.lit(None).cast("string").alias("region_original"),
        "height_km", "pressure_level", status.alias("status"), "c",
    )


def rows_sql() -> str:
    return entries_sql(v.EXTRACT_DELIMITER) + f""",
rows_ AS (
  SELECT id AS row_pos, CAST(entry_date AS VARCHAR) AS date, 'AIWS ' || strftime(entry_date, '%Y%m%d') || '.docx' AS source_file,
    weather_system, subdivisions,
    'north ' || lower({NAMES_SQL}[(user_id % 7) + 1]) || CASE WHEN c % 2 = 0 THEN '  & Area' ELSE '' END AS region,
    CAST(NULL AS VARCHAR) AS region_original, height_km, pressure_level,
    CASE WHEN c % 11 = 0 THEN 'became less marked' WHEN c % 3 = 0 THEN 'persisted' WHEN c % 3 = 1 THEN 'lay over' END AS status, c
  FROM entries)"""


def dated_texts(spark: SparkSession, sf_dir: str, with_bad: bool) -> DataFrame:
    """Rows whose date is written in one of several shapes, some unreadable when wanted."""
    e = rows(spark, sf_dir)
    day = F.col("date").cast("date")
    shapes = ["yyyy-MM-dd", "dd-MM-yyyy"] + ([] if with_bad else ["dd/MM/yyyy", "yyyy/MM/dd"])
    n = 4
    pick = F.col("c") % n
    written = F.coalesce(*[F.when(pick == i, F.date_format(day, s)) for i, s in enumerate(shapes)])
    if with_bad:
        written = F.when(pick == 2, F.lit("31-02-2024")).when(pick == 3, F.date_format(day, "d MMM yyyy")).otherwise(written)
    return e.withColumn("date", F.concat(F.lit(" "), written))


def dated_texts_sql(with_bad: bool) -> str:
    third = "'31-02-2024'" if with_bad else "strftime(CAST(date AS DATE), '%d/%m/%Y')"
    fourth = "strftime(CAST(date AS DATE), '%-d %b %Y')" if with_bad else "strftime(CAST(date AS DATE), '%Y/%m/%d')"
    return rows_sql() + f""",
dated AS (
  SELECT * REPLACE (' ' || CASE c % 4 WHEN 0 THEN strftime(CAST(date AS DATE), '%Y-%m-%d')
    WHEN 1 THEN strftime(CAST(date AS DATE), '%d-%m-%Y') WHEN 2 THEN {third} ELSE {fourth} END AS date)
  FROM rows_)"""


# --- bulletin sentences -------------------------------------------------------------------------


def _templates() -> dict[tuple[str, int], str]:
    """Sentence by (event type, variant); {r1} {r2} {r3} {h} {lo} {hi} {lon} {lat} are filled in."""
    # Sentences in the wording of the bulletins.
    return {
        ("view", 0): "The upper air cyclonic circulation over {r1} & neighbourhood at {h} km above msl persisted.",
        ("view", 1): "An upper air cyclonic circulation lay over {r1} between {lo} & {hi} km above msl.",
        ("view", 2): "The upper air cyclonic circulation over {r1} became less marked.",
        ("view", 3): "A cyclonic circulation lay over {r1} & neighbourhood between 1.5 & 4.5 km above msl "
        "with the trough aloft with its axis at 9.6 km above msl along Long. {lon}°E to the north of Lat. {lat}°N.",
        ("click", 0): "The trough from {r1} to {r2} across {r3} at {h} km above msl persisted.",
        ("click", 1): "The trough from {r1} to {r2} became less marked.",
        ("click", 2): "The trough from {r1} to {r2} at {h} km above msl persisted.",
        ("click", 3): "The trough ran roughly along Long. {lon}°E to the north of Lat. {lat}°N at {h} km above msl.",
        ("purchase", 0): "Another Western Disturbance seen as a trough in middle tropospheric westerlies with its axis "
        "at {h} km above msl ran roughly along Long. {lon}°E to the north of Lat. {lat}°N.",
        ("purchase", 1): "The western disturbance over {r1} at {h} km above msl persisted.",
        ("purchase", 2): "The western disturbance over {r1} became less marked.",
        ("purchase", 3): "A fresh western disturbance lay over {r1} with a trough aloft at {h} km above msl.",
        ("signup", 0): "It persisted at {h} km above msl.",
        ("signup", 1): "It became less marked.",
        ("signup", 2): "It then extended upto {h} km.",
        ("signup", 3): "It continued with a trough aloft at {h} km above msl.",
        ("error", 0): "Northern limit of monsoon passes through {r1}.",
        ("error", 1): "It is likely to affect {r1}.",
        ("error", 2): "Rain remained over the same region at {h} km above msl.",
        ("error", 3): "Has become less marked.",
    }


def _facts(events: DataFrame) -> DataFrame:
    """What a sentence says, as columns, from the numbers of an event row."""
    e = events.withColumn("c", cents())
    user, event, c = F.col("user_id") % 10, F.col("event_id"), F.col("c")
    return e.select(
        F.concat(F.lit("AIWS "), F.date_format("ts", "yyyyMMdd"), F.lit("_"), user.cast("string"), F.lit(".docx")).alias("source_file"),
        F.col("ts").cast("date").alias("bulletin_date"), event.alias("sent_idx"), "event_type", (c % 4).alias("variant"),
        _name_at(user * 5 + event % 4).alias("r1"), _name_at(user * 5 + event % 3 + 7).alias("r2"),
        _name_at(user * 5 + 11).alias("r3"),
        F.concat((F.floor(c / 100) % 9).cast("string"), F.lit("."), (c % 10).cast("string")).alias("h"),
        F.get(text_array(RANGE_LOWS), (event % 3).cast("int")).alias("lo"),
        F.get(text_array(RANGE_HIGHS), (event % 3).cast("int")).alias("hi"),
        (F.lit(50) + event % 3 * 15).cast("string").alias("lon"), (F.lit(20) + user % 2 * 11).cast("string").alias("lat"),
    )


_FACTS_SQL = f"""facts AS (
  SELECT 'AIWS ' || strftime(ts, '%Y%m%d') || '_' || CAST(user_id % 10 AS VARCHAR) || '.docx' AS source_file,
    CAST(ts AS DATE) AS bulletin_date, event_id AS sent_idx, event_type, c % 4 AS variant,
    {NAMES_SQL}[((user_id % 10) * 5 + event_id % 4) % {N} + 1] AS r1,
    {NAMES_SQL}[((user_id % 10) * 5 + event_id % 3 + 7) % {N} + 1] AS r2,
    {NAMES_SQL}[((user_id % 10) * 5 + 11) % {N} + 1] AS r3,
    CAST((c // 100) % 9 AS VARCHAR) || '.' || CAST(c % 10 AS VARCHAR) AS h,
    {sql_list(RANGE_LOWS)}[event_id % 3 + 1] AS lo, {sql_list(RANGE_HIGHS)}[event_id % 3 + 1] AS hi,
    CAST(50 + event_id % 3 * 15 AS VARCHAR) AS lon, CAST(20 + (user_id % 10) % 2 * 11 AS VARCHAR) AS lat
  FROM (SELECT *, {CENTS_SQL} AS c FROM events))"""


def _fill_sql(template: str) -> str:
    pieces = template.replace("{", "\0{").replace("}", "}\0").split("\0")
    return " || ".join(p[1:-1] if p.startswith("{") else sql_text(p) for p in pieces if p)


def _sentence_sql() -> str:
    whens = (
        f"WHEN event_type = {sql_text(e)} AND variant = {i} THEN {_fill_sql(t)}" for (e, i), t in _templates().items()
    )
    return f"CASE {' '.join(whens)} END"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, bulletin_date, sent_idx, sentence), one sentence per event."""
    f = _facts(text_table(spark, sf_dir, "events"))
    return f.select("source_file", "bulletin_date", "sent_idx", F.expr(_sentence_sql()).alias("sentence"))


def sentences_sql() -> str:
    return _FACTS_SQL + f""",
sentences AS (SELECT *, {_sentence_sql()} AS sentence FROM facts)"""


# --- bulletin paragraphs --------------------------------------------------------------------------

# The other paragraphs of a bulletin.
TITLE = "India Meteorological Department"
SUMMARY_OPENING = "Summary of observations recorded at 0830 hours IST: "


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, paragraphs): one bulletin per order with five paragraphs.

    The heading carries a real date, an impossible one or none; the summary paragraph is
    missing from urgent orders, whose first paragraph then stands in.
    """
    o = text_table(spark, sf_dir, "orders")
    key, user = F.col("o_orderkey"), F.col("o_custkey")
    r1, r2 = _name_at(key), _name_at(user)
    height = F.concat((key % 9).cast("string"), F.lit("."), (user % 10).cast("string"))
    heading = (
        F.when(key % 5 == 0, F.lit("Bulletin"))
        .when(key % 5 == 1, F.lit("Sunday,31st June 2025 (Evening)"))
        .otherwise(F.concat(F.lit("Monday , "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" (Morning)")))
    )
    summary = F.concat(
        F.lit(SUMMARY_OPENING), F.lit("The upper air cyclonic circulation over "), r1,
        F.lit(" & neighbourhood at "), height, F.lit(" km above m. s. l.  The trough from "), r1, F.lit(" to "), r2,
        F.lit(" at 0.9 km above m. s. l. persisted. It then persisted at "), height,
        F.lit(" km above m. s. l. A fresh western disturbance seen as a trough ran roughly along Long. 55°E to the north of Lat. 31°N. "),
        F.lit("with a trough aloft at 7.6 km above m. s. l. persisted.\nThe upper air cyclonic circulation over "), r2,
        F.when(key % 3 == 0, F.lit(" became less marked.")).otherwise(F.lit(" between 3.1 & 5.8 km above m. s. l. persisted.")),
    )
    urgent = F.col("o_orderpriority") == "1-URGENT"
    texts = F.array(
        F.lit(TITLE), heading, F.lit("   "),
        F.when(urgent, F.lit("No observations.")).otherwise(summary), F.lit("Forecast and warnings follow."),
    )
    name = F.concat(F.lit("AIWS "), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" "), key.cast("string"), F.lit(".docx"))
    return o.select(name.alias("source_file"), texts.alias("paragraphs"))


def paragraphs_sql() -> str:
    h = "CAST(o_orderkey % 9 AS VARCHAR) || '.' || CAST(o_custkey % 10 AS VARCHAR)"
    r1, r2 = (f"{NAMES_SQL}[{k} % {N} + 1]" for k in ("o_orderkey", "o_custkey"))
    return f"""bulletin AS (
  SELECT o_orderkey, 'AIWS ' || strftime(o_orderdate, '%Y%m%d') || ' ' || CAST(o_orderkey AS VARCHAR) || '.docx' AS source_file,
    CAST(o_orderdate AS DATE) AS order_date, {r1} AS r1, {r2} AS r2, {h} AS h, o_orderpriority = '1-URGENT' AS urgent,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Bulletin' WHEN o_orderkey % 5 = 1 THEN 'Sunday,31st June 2025 (Evening)'
      ELSE 'Monday , ' || strftime(o_orderdate, '%-d %B %Y') || ' (Morning)' END AS heading
  FROM orders),
paragraphs AS (
  SELECT source_file, p.para_idx, p.text FROM (
    SELECT source_file, unnest([
      {{'para_idx': 0, 'text': {sql_text(TITLE)}}}, {{'para_idx': 1, 'text': heading}}, {{'para_idx': 2, 'text': '   '}},
      {{'para_idx': 3, 'text': CASE WHEN urgent THEN 'No observations.' ELSE {sql_text(SUMMARY_OPENING)} || 'The upper air cyclonic circulation over ' || r1
        || ' & neighbourhood at ' || h || ' km above m. s. l.  The trough from ' || r1 || ' to ' || r2
        || ' at 0.9 km above m. s. l. persisted. It then persisted at ' || h
        || ' km above m. s. l. A fresh western disturbance seen as a trough ran roughly along Long. 55°E to the north of Lat. 31°N. '
        || 'with a trough aloft at 7.6 km above m. s. l. persisted.' || chr(10) || 'The upper air cyclonic circulation over ' || r2
        || CASE WHEN o_orderkey % 3 = 0 THEN ' became less marked.' ELSE ' between 3.1 & 5.8 km above m. s. l. persisted.' END END}},
      {{'para_idx': 4, 'text': 'Forecast and warnings follow.'}}]) AS p FROM bulletin))"""


# --- prose ------------------------------------------------------------------------------------------

# Word swaps that put bulletin wording into the prose of `documents`.
PROSE_SWAPS = [
    (". The ", " at 1.5 km above m. s. l. The trough "),
    ("In ", "In upper "),
    ("Of ", "With a trough "),
    (" that ", " Long. "),
]


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): whole documents with bulletin wording swapped in."""
    text = F.col("text")
    for old, new in PROSE_SWAPS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text_table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def prose_sql() -> str:
    text = "text"
    for old, new in PROSE_SWAPS:
        text = f"replace({text}, {sql_text(old)}, {sql_text(new)})"
    return f"prose AS (SELECT doc_id, {text} AS text FROM documents)"


# --- region texts -------------------------------------------------------------------------------------


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, region): free region texts with directions, pairs, noise and coordinates."""
    e = text_table(spark, sf_dir, "events").withColumn("c", cents())
    user, event, c = F.col("user_id"), F.col("event_id"), F.col("c")
    first, second = F.lower(_name_at(user)), F.lower(_name_at(event))
    axis = F.concat(
        F.lit("along Long. "), (F.lit(54) + c % 42).cast("string"), F.lit("°E to the north of Lat. "),
        (F.lit(8) + event % 27).cast("string"), F.lit("°N"),
    )
    half_axis = F.concat(F.lit("along long. "), (F.lit(54) + c % 42).cast("string"), F.lit(".5°e"))
    text = (
        F.when(c % 8 == 0, first)
        .when(c % 8 == 1, F.concat(F.lit("south "), first, F.lit(" & neighbourhood of today morning.")))
        .when(c % 8 == 2, F.concat(first, F.lit(" ; "), second, F.lit(" also")))
        .when(c % 8 == 3, axis)
        .when(c % 8 == 4, half_axis)
        .when(c % 8 == 5, F.concat(axis, F.lit(" ; "), first))
        .when(c % 8 == 6, F.concat(F.element_at(F.split(first, " "), -1), F.lit(" ; the ; interior "), F.element_at(F.split(second, " "), -1)))
        .otherwise(F.lit("middle tropospheric westerlies"))
    )
    return e.select(F.col("event_id").alias("id"), text.alias("region"))


def regions_sql() -> str:
    axis = "'along Long. ' || CAST(54 + c % 42 AS VARCHAR) || '°E to the north of Lat. ' || CAST(8 + event_id % 27 AS VARCHAR) || '°N'"
    return f"""regions_ AS (
  SELECT event_id AS id, CASE c % 8 WHEN 0 THEN n1 WHEN 1 THEN 'south ' || n1 || ' & neighbourhood of today morning.'
    WHEN 2 THEN n1 || ' ; ' || n2 || ' also' WHEN 3 THEN {axis}
    WHEN 4 THEN 'along long. ' || CAST(54 + c % 42 AS VARCHAR) || '.5°e' WHEN 5 THEN {axis} || ' ; ' || n1
    WHEN 6 THEN string_split(n1, ' ')[-1] || ' ; the ; interior ' || string_split(n2, ' ')[-1]
    ELSE 'middle tropospheric westerlies' END AS region
  FROM (SELECT *, {CENTS_SQL} AS c, lower({NAMES_SQL}[user_id % {N} + 1]) AS n1, lower({NAMES_SQL}[event_id % {N} + 1]) AS n2 FROM events))"""


# --- gazetteers and name tables of a row for each event ---------------------------------------------------


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, name, lat, lon): a point for each event, with names and coordinates that repeat; a third lie in a tenth of the longitudes."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    event = F.col("event_id")
    east = F.when(event % 3 == 0, F.lit(8000) + (event * 13) % 400).otherwise(F.lit(5400) + (event * 7919) % 4200)
    return e.select(
        event.alias("pos"), F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("name"),
        ((F.lit(500) + (event * 271) % 3300).cast("double") / F.lit(100.0)).alias("lat"), (east.cast("double") / F.lit(100.0)).alias("lon"),
    )


def gazetteer_sql() -> str:
    east = "CASE WHEN event_id % 3 = 0 THEN 8000 + (event_id * 13) % 400 ELSE 5400 + (event_id * 7919) % 4200 END"
    return f"""gazetteer AS (SELECT event_id AS pos, event_type || '-' || CAST(user_id AS VARCHAR) AS name,
  CAST(500 + (event_id * 271) % 3300 AS DOUBLE) / CAST(100 AS DOUBLE) AS lat, CAST({east} AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM events)"""


def _name_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    event = F.col("event_id")
    size = F.lit(6) + event % 17
    whole = _name_at(event)
    piece = F.substr(whole, (F.lit(1) + event % 5).cast("int"), size.cast("int"))
    numbered = F.concat_ws(" ", F.substr(whole, F.lit(1), size.cast("int")), (event % 977).cast("string"))
    return e.select("event_id", "user_id", F.when(event % 3 == 0, piece).otherwise(numbered).alias("name"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, key, names): pieces of subdivision names, some with a number, and two subdivisions each."""
    pieces = _name_pieces(spark, sf_dir).where("event_id % 2 = 0")
    names = F.array(_name_at(F.col("user_id")), _name_at(F.col("event_id") + 1))
    return pieces.select(F.col("event_id").alias("pos"), subdivision_key(F.col("name")).alias("key"), names.alias("names"))


def officials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, name): the other pieces, each name once."""
    return _name_pieces(spark, sf_dir).where("event_id % 2 = 1").groupBy("name").agg(F.min("event_id").alias("pos")).select("pos", "name")


def name_tables_sql() -> str:
    whole = f"{NAMES_SQL}[event_id % {N} + 1]"
    key = "trim(regexp_replace(replace(lower(name), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
    return f"""pieces AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN substr({whole}, 1 + event_id % 5, 6 + event_id % 17)
  ELSE substr({whole}, 1, 6 + event_id % 17) || ' ' || CAST(event_id % 977 AS VARCHAR) END AS name FROM events),
alias AS (SELECT event_id AS apos, {key} AS akey, [{NAMES_SQL}[user_id % {N} + 1], {NAMES_SQL}[(event_id + 1) % {N} + 1]] AS names FROM pieces WHERE event_id % 2 = 0),
official AS (SELECT min(event_id) AS opos, {key} AS okey, name FROM pieces WHERE event_id % 2 = 1 GROUP BY name)"""


# --- submissions and the legacy tables ------------------------------------------------------------------


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_date, systems, created_at): one form submission per order, up to four systems."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kinds = F.array(F.lit("CYCIR"), F.lit("Trough"), F.lit("WD"), F.lit(""))
    level_names = text_array(v.PRESSURE_LEVELS)

    def part(i: Column) -> Column:
        x = key + i
        levels = F.slice(level_names, (x % 7 + 1).cast("int"), (x % 3).cast("int"))
        subs = F.when(x % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(_name_at(x), _name_at(x * 3 + 1)))
        return F.struct(F.get(kinds, (x % 4).cast("int")).alias("system"), levels.alias("levels"), subs.alias("subdivisions"))

    return o.select(
        key.alias("submission_id"), F.col("o_orderdate").cast("date").alias("entry_date"),
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("o_custkey") % 4), part).alias("systems"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def submissions_sql() -> str:
    return f"""parts AS (
  SELECT submission_id, entry_date, created_at, i, x, ['CYCIR', 'Trough', 'WD', ''][x % 4 + 1] AS system,
    list_slice({sql_list(v.PRESSURE_LEVELS)}, x % 7 + 1, x % 7 + x % 3) AS levels,
    CASE WHEN x % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [{NAMES_SQL}[x % {N} + 1], {NAMES_SQL}[(x * 3 + 1) % {N} + 1]] END AS subs
  FROM (SELECT o_orderkey AS submission_id, CAST(o_orderdate AS DATE) AS entry_date, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
      i, o_orderkey + i AS x
    FROM (SELECT *, unnest(range(0, o_custkey % 4 + 1)) AS i FROM orders)))"""


def legacy(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four older tables: entries, systems, levels and subdivisions."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    system_id = F.col("l_orderkey") * 2 + F.col("l_linenumber") % 2
    return {
        "entries": o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("entry_date")),
        "systems": o.select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("i")).select(
            (F.col("o_orderkey") * 2 + F.col("i")).alias("id"), F.col("o_orderkey").alias("entry_id"),
            (F.col("i") + 1).alias("system_number"), F.when(F.col("i") == 0, F.lit("CYCIR")).otherwise(F.lit("WD")).alias("weather_system"),
        ),
        "levels": li.select(
            system_id.alias("system_id"),
            F.get(text_array(v.PRESSURE_LEVELS), (F.col("l_partkey") % 10).cast("int")).alias("level_name"),
        ),
        "subdivisions": li.select(
            system_id.alias("system_id"), _name_at(F.col("l_suppkey")).alias("subdivision_name")
        ),
    }


def legacy_sql() -> str:
    return f"""l_entries AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS entry_date FROM orders),
l_systems AS (SELECT o_orderkey * 2 + i AS id, o_orderkey AS entry_id, CAST(i + 1 AS INTEGER) AS system_number,
    CASE i WHEN 0 THEN 'CYCIR' ELSE 'WD' END AS weather_system
  FROM orders, (VALUES (0), (1)) t(i)),
l_levels AS (SELECT l_orderkey * 2 + l_linenumber % 2 AS system_id, {sql_list(v.PRESSURE_LEVELS)}[l_partkey % 10 + 1] AS level_name
  FROM lineitem),
l_subs AS (SELECT l_orderkey * 2 + l_linenumber % 2 AS system_id, {NAMES_SQL}[l_suppkey % {N} + 1] AS subdivision_name
  FROM lineitem)"""
