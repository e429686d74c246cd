"""Coordinates and region texts to subdivisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.catalog import texts
from metframe.catalog.base import Query, clean_sql, distinct_sql, joined, key_sql
from metframe.functions import places, text
from metframe.operators import gazetteers
from metframe.plans import models as m

ALIAS_SQL = "alias(apos, akey, names) AS (VALUES " + ", ".join(
    f"({i}, {m.sql_text(k)}, {m.sql_list(n)})" for i, (k, n) in enumerate(v.REGION_ALIASES.items())
) + ")"


def _core(name: str) -> list[str]:
    return [w for w in places.key_of(name).split() if len(w) > 2 and w not in v.TOKEN_STOP_WORDS]


OFFICIAL_SQL = "official(opos, name, okey, core) AS (VALUES " + ", ".join(
    f"({i}, {m.sql_text(n)}, {m.sql_text(places.key_of(n))}, CAST({m.sql_list(_core(n))} AS VARCHAR[]))"
    for i, n in enumerate(v.OFFICIAL_SUBDIVISIONS)
) + ")"


def points_sql(name: str, points) -> str:
    values = ", ".join(
        f"({i}, {m.sql_text(n)}, CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for i, (n, lat, lon) in enumerate(points)
    )
    return f"{name}(pos, name, lat, lon) AS (VALUES {values})"


IMD_SQL, FORM_SQL = points_sql("imd", v.IMD_POINTS), points_sql("form", v.FORM_POINTS)
_DISTANCE = "abs(lon - x) + greatest(0.0, coalesce(y - lat, 0.0))"


def nearest_sql(source: str, key: str, points: str, tolerance: float, need_lat: bool, official: bool) -> str:
    """(key, names): the five nearest points of each (key, x, y), nearest first."""
    extra = (" AND y IS NOT NULL" if need_lat else "") + (" AND name IN (SELECT name FROM official)" if official else "")
    return f"""SELECT {key}, list(name ORDER BY rn) AS names FROM (
      SELECT {key}, name, row_number() OVER (PARTITION BY {key} ORDER BY {_DISTANCE}, pos) AS rn FROM {source}, {points}
      WHERE x IS NOT NULL{extra} AND abs(lon - x) <= {tolerance} AND (y IS NULL OR lat >= y - {v.LAT_SLACK})) WHERE rn <= {v.COORDINATE_TOP} GROUP BY 1"""


def axis_sql(column: str) -> str:
    lon = texts.number_sql(v.LONGITUDE).replace("lower(region)", f"lower({column})")
    lat = texts.number_sql(v.LATITUDE).replace("lower(region)", f"lower({column})")
    return f"{lon} AS x, {lat} AS y"


def resolve_sql(source: str) -> str:
    """CTEs ending in `resolved(text, region, region_original)` for the texts of `source`."""
    clean = clean_sql("part")
    return f"""r_texts AS (SELECT DISTINCT region AS text FROM {source}),
r_parts AS (SELECT text, i, trim(ps[i]) AS part FROM (SELECT text, string_split(text, ';') AS ps, unnest(range(1, len(string_split(text, ';')) + 1)) AS i FROM r_texts) WHERE trim(ps[i]) <> ''),
r_axes AS (SELECT DISTINCT part, {axis_sql('part')} FROM r_parts WHERE regexp_matches(lower(part), '{v.COORDINATE_REGION}')),
r_hits AS ({nearest_sql('r_axes', 'part', 'imd', v.IMD_LON_TOLERANCE, False, False)}),
r_done AS (SELECT text, i, part, a.part IS NOT NULL AS axis, h.names AS hit,
  CASE WHEN a.part IS NULL THEN [{clean}] WHEN h.names IS NULL THEN [part] ELSE h.names END AS names
  FROM r_parts LEFT JOIN r_axes a USING (part) LEFT JOIN r_hits h USING (part)),
r_lists AS (SELECT text, list_filter(flatten(list(names ORDER BY i)), lambda x: x <> '') AS ns,
  array_to_string(list({clean} ORDER BY i) FILTER (WHERE hit IS NOT NULL), ' ; ') AS region_original FROM r_done GROUP BY text),
resolved AS (SELECT t.text, coalesce(array_to_string(list_transform({distinct_sql('ns')}, lambda z: {clean_sql('z')}), ' ; '), '') AS region, region_original
  FROM r_texts t LEFT JOIN r_lists USING (text))"""


def subdivisions_sql(source: str) -> str:
    """CTEs ending in `mapped(text, subs)` for the region texts of `source`."""
    fragments = texts.FRAGMENTS_SQL(texts.WITHOUT_PHRASES_SQL.replace("region", "text"))
    phrases = texts.PHRASES_SQL.replace("region", "text")
    return f"""s_texts AS (SELECT DISTINCT region AS text FROM {source}),
s_phrases AS (SELECT text, i, trim(ps[i]) AS part FROM (SELECT text, {phrases} AS ps, unnest(range(1, len({phrases}) + 1)) AS i FROM s_texts)),
s_axes AS (SELECT DISTINCT part, {axis_sql('part')} FROM s_phrases),
s_hits AS ({nearest_sql('s_axes', 'part', 'form', v.FORM_LON_TOLERANCE, True, True)}),
s_fragments AS (SELECT text, i, fs[i] AS part FROM (SELECT text, fs, unnest(range(1, len(fs) + 1)) AS i FROM (SELECT text, {fragments} AS fs FROM s_texts))),
s_keys AS (SELECT DISTINCT part, {key_sql('part')} AS key FROM s_fragments),
s_tiers AS (SELECT part, key,
  (SELECT names FROM alias WHERE akey = key) AS t1,
  (SELECT arg_max(names, length(akey) * 1000 - apos) FROM alias WHERE contains(akey, key) OR contains(key, akey)) AS t2,
  (SELECT list(name ORDER BY length(name) DESC, opos) FROM official WHERE key <> '' AND (contains(okey, key) OR contains(key, okey))) AS t4,
  (SELECT list(name ORDER BY opos) FROM official WHERE len(core) > 0 AND okey NOT IN (SELECT akey FROM alias)
    AND len(list_filter(core, lambda w: NOT list_contains(string_split(key, ' '), w))) = 0) AS t5 FROM s_keys),
s_names AS (SELECT text, 0 AS kind, i, names FROM s_phrases JOIN s_hits USING (part)
  UNION ALL SELECT text, 1, i, coalesce(t1, t2, t4, t5) FROM s_fragments JOIN s_tiers USING (part)),
s_lists AS (SELECT text, flatten(list(names ORDER BY kind, i)) AS ns FROM s_names WHERE names IS NOT NULL GROUP BY text),
mapped AS (SELECT t.text, coalesce({distinct_sql('ns')}, CAST([] AS VARCHAR[])) AS subs FROM s_texts t LEFT JOIN s_lists USING (text))"""






def _keyed(build):
    def run(spark, sf_dir):
        key = text.subdivision_key(F.col("region"))
        return m.regions(spark, sf_dir).select("id", build(key).alias("n")).select("id", joined(F.col("n"), "names"))

    return run


def _coordinates(build):
    def run(spark, sf_dir):
        return m.regions(spark, sf_dir).select("id", joined(build(F.col("region")), "names"))

    return run


_AXES = f"axes AS (SELECT id, {axis_sql('region')} FROM regions_)"
_KEYS = f"keys AS (SELECT id, {key_sql('region')} AS key FROM regions_), ks AS (SELECT DISTINCT key FROM keys)"


def _tier(expression: str) -> str:
    return (
        f"WITH {m.regions_sql()}, {ALIAS_SQL}, {OFFICIAL_SQL}, {_KEYS}, tier AS (SELECT key, {expression} AS names FROM ks) "
        "SELECT id, array_to_string(names, '|') AS names FROM keys JOIN tier USING (key)"
    )


def _resolved(spark, sf_dir):
    rows = m.regions(spark, sf_dir).select("id", places.resolve_region(F.col("region")).alias("r"))
    return rows.select("id", "r.region", "r.region_original")


def _gazetteer_query(build):
    """Coordinates looked up in a gazetteer of as many points as there are events."""

    def run(spark, sf_dir):
        found = build(m.regions(spark, sf_dir), m.gazetteer(spark, sf_dir), m.aliases(spark, sf_dir))
        return found.select("id", joined(F.col("names"), "names"))

    return run


def _name_query(build):
    """Keys of region texts looked up in name tables of as many rows as there are events."""

    def run(spark, sf_dir):
        keyed = m.regions(spark, sf_dir).select("id", text.subdivision_key(F.col("region")).alias("key"))
        found = build(keyed, m.aliases(spark, sf_dir), gazetteers.officials_of(m.officials(spark, sf_dir), m.gazetteer(spark, sf_dir)))
        return gazetteers.with_names(keyed, "key", found).select("id", joined(F.col("names"), "names"))

    return run


def _imd_table(rows, points, _):
    return gazetteers.imd_subdivisions(rows, F.col("region"), points)


def _form_table(rows, points, _):
    """The official list holds every third name."""
    listed = points.where("pos % 3 = 0").select("pos", "name")
    return gazetteers.form_subdivisions(rows, F.col("region"), points, gazetteers.officials_of(listed, points))


def _form_fallback(rows, points, _):
    """The official list is empty, so all names of the gazetteer are official."""
    return gazetteers.form_subdivisions(rows, F.col("region"), points, gazetteers.officials_of(points.where("pos < 0"), points))


def _near_table(need_lat: bool, listed: str, tolerance: float) -> str:
    near = nearest_sql("(SELECT DISTINCT k, x, y FROM keyed)", "k", "gazetteer", tolerance, need_lat, need_lat)
    return f"""WITH {m.regions_sql()}, {m.gazetteer_sql()}, official AS (SELECT DISTINCT name FROM gazetteer WHERE {listed}), {_AXES},
    keyed AS (SELECT *, concat_ws(' ', coalesce(CAST(x AS VARCHAR), '-'), CAST(y AS VARCHAR)) AS k FROM axes), near AS ({near})
    SELECT id, coalesce(array_to_string(names, '|'), '') AS names FROM keyed LEFT JOIN near USING (k)"""


def _tier_table(expression: str) -> str:
    return (
        f"WITH {m.regions_sql()}, {m.name_tables_sql()}, {_KEYS}, tier AS (SELECT key, {expression} AS names FROM ks) "
        "SELECT id, array_to_string(names, '|') AS names FROM keys JOIN tier USING (key)"
    )


_STOP_SQL = m.sql_list(v.TOKEN_STOP_WORDS)
TABLE_QUERIES = [
    Query("coord_imd_table", _gazetteer_query(_imd_table), _near_table(False, "true", v.IMD_LON_TOLERANCE)),
    Query("coord_form_table", _gazetteer_query(_form_table), _near_table(True, "pos % 3 = 0", v.FORM_LON_TOLERANCE)),
    Query("coord_form_fallback", _gazetteer_query(_form_fallback), _near_table(True, "true", v.FORM_LON_TOLERANCE)),
    Query(
        "alias_exact_table", _name_query(lambda keys, aliases, officials: gazetteers.alias_exact(keys, aliases)),
        _tier_table("(SELECT arg_min(names, apos) FROM alias WHERE akey = key)"),
    ),
    Query(
        "alias_longest_table", _name_query(lambda keys, aliases, officials: gazetteers.alias_longest(keys, aliases)),
        _tier_table("(SELECT arg_max(names, length(akey) * 100000000 - apos) FROM alias WHERE contains(akey, key) OR contains(key, akey))"),
    ),
    Query(
        "official_fuzzy_table", _name_query(lambda keys, aliases, officials: gazetteers.official_fuzzy(keys, officials)),
        _tier_table("(SELECT list(name ORDER BY length(name) DESC, opos) FROM official WHERE key <> '' AND (contains(okey, key) OR contains(key, okey)))"),
    ),
    Query(
        "token_containment_table", _name_query(lambda keys, aliases, officials: gazetteers.token_containment(keys, officials, aliases)),
        _tier_table(
            "(SELECT list(name ORDER BY opos) FROM (SELECT *, list_filter(string_split(okey, ' '), "
            f"lambda w: length(w) > 2 AND NOT list_contains({_STOP_SQL}, w)) AS core FROM official) WHERE len(core) > 0 "
            "AND okey NOT IN (SELECT akey FROM alias) AND len(list_filter(core, lambda w: NOT list_contains(string_split(key, ' '), w))) = 0)"
        ),
    ),
]


QUERIES = [
    *TABLE_QUERIES,
    Query(
        "coord_imd_top5", _coordinates(places.imd_subdivisions),
        f"""WITH {m.regions_sql()}, {_AXES}, {IMD_SQL}, near AS ({nearest_sql('axes', 'id', 'imd', v.IMD_LON_TOLERANCE, False, False)})
        SELECT id, coalesce(array_to_string(names, '|'), '') AS names FROM regions_ LEFT JOIN near USING (id)""",
    ),
    Query(
        "coord_form_top5", _coordinates(places.form_subdivisions),
        f"""WITH {m.regions_sql()}, {_AXES}, {FORM_SQL}, {OFFICIAL_SQL}, near AS ({nearest_sql('axes', 'id', 'form', v.FORM_LON_TOLERANCE, True, True)})
        SELECT id, coalesce(array_to_string(names, '|'), '') AS names FROM regions_ LEFT JOIN near USING (id)""",
    ),
    Query("alias_exact", _keyed(places.alias_exact), _tier("(SELECT names FROM alias WHERE akey = key)")),
    Query(
        "alias_longest", _keyed(places.alias_longest),
        _tier("(SELECT arg_max(names, length(akey) * 1000 - apos) FROM alias WHERE contains(akey, key) OR contains(key, akey))"),
    ),
    Query(
        "official_fuzzy", _keyed(places.official_fuzzy),
        _tier("coalesce((SELECT list(name ORDER BY length(name) DESC, opos) FROM official WHERE contains(okey, key) OR contains(key, okey)), CAST([] AS VARCHAR[]))"),
    ),
    Query(
        "token_containment", _keyed(places.token_containment),
        _tier(
            "coalesce((SELECT list(name ORDER BY opos) FROM official WHERE len(core) > 0 AND okey NOT IN (SELECT akey FROM alias) "
            "AND len(list_filter(core, lambda w: NOT list_contains(string_split(key, ' '), w))) = 0), CAST([] AS VARCHAR[]))"
        ),
    ),
    Query(
        "region_to_subdivisions", _coordinates(places.region_subdivisions),
        f"""WITH {m.regions_sql()}, {ALIAS_SQL}, {OFFICIAL_SQL}, {FORM_SQL}, {subdivisions_sql('regions_')}
        SELECT id, array_to_string(subs, '|') AS names FROM regions_ JOIN mapped ON text = region""",
    ),
    Query(
        "resolve_regions", _resolved,
        f"""WITH {m.regions_sql()}, {IMD_SQL}, {resolve_sql('regions_')}
        SELECT id, r.region, r.region_original FROM regions_ g JOIN resolved r ON r.text = g.region""",
    ),
]
