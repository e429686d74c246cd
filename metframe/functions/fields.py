"""Field extraction: one normalised sentence -> system, region, height, status, level.

Each function takes the lower-cased, normalised sentence and gives a Column, so a whole
extraction is one projection without any Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import rx, text

_NO_REGIONS = "array<string>"


def no_regions() -> Column:
    return F.array().cast(_NO_REGIONS)


def primary_system(s: Column) -> Column:
    """WD, Trough or CYCIR by the subject of the sentence; NULL for `It ...`."""
    return F.when(~text.is_continuation(s), rx.first_label(F.trim(s), v.SUBJECT_SYSTEMS))


def trough_by_verb(s: Column) -> Column:
    return F.when(rx.matches(s, v.TROUGH_VERB), F.lit("Trough"))


def trough_by_word(s: Column) -> Column:
    return F.when(rx.matches(s, v.TROUGH_WORD), F.lit("Trough"))


def detailed_system(s: Column) -> Column:
    return rx.first_label(s, v.DETAILED_SYSTEMS)


def associated_system(s: Column) -> Column:
    return rx.first_label(s, v.ASSOCIATED_SYSTEMS)


def status(s: Column) -> Column:
    return rx.first_label(s, v.STATUSES)


def pressure_text(s: Column) -> Column:
    """`surface` when named, else the first `nnn hPa`."""
    number = rx.group(F.when(s.contains("hpa"), s), v.PRESSURE_TEXT)
    return F.when(s.contains("surface"), F.lit("surface")).otherwise(F.concat(number, F.lit(" hPa")))


# --- heights --------------------------------------------------------------------------


def height_range(s: Column) -> Column:
    """STRUCT(low, high): `between a & b`, else one height and no upper end, else (0, NULL)."""
    ends = rx.parts(F.when(s.contains("between"), s), v.HEIGHT_BETWEEN, (1, 2))
    with_unit = F.when(s.contains("km"), s)
    single = F.coalesce(*[rx.group(with_unit, p).try_cast("double") for p in v.HEIGHT_SINGLE], F.lit(0.0))
    return rx.bind(
        ends,
        lambda e: F.struct(
            F.coalesce(e[0].try_cast("double"), single).alias("low"), e[1].try_cast("double").alias("high")
        ),
    )


def height(s: Column) -> Column:
    """The upper end when positive, else the single height."""

    def chosen(ends: Column) -> Column:
        low, high = ends["low"], ends["high"]
        return F.when(high > 0, high).when(high.isNotNull() | (low > 0), low).otherwise(F.lit(0.0))

    return rx.bind(height_range(s), chosen)


# --- regions --------------------------------------------------------------------------


def _cut(text_column: Column, width: int | None) -> Column:
    """At most `width` characters of a region text; all of it without a width."""
    return text_column if width is None else F.substring(text_column, 1, width)


def _coordinate_text(s: Column, start: str, width: int | None = None) -> Column:
    """Text from the first `start` up to a stop word; NULL when hardly anything is left."""
    tail = F.substr(s, F.instr(s, start))
    head = F.btrim(rx.replace(tail, rf"{v.COORDINATE_STOP}[\s\S]*", ""), F.lit(v.REGION_EDGE_CHARS))
    long_enough = rx.keep_if(head, lambda h: F.length(h) > v.COORDINATE_MIN_CHARS)
    return F.when(s.contains(start), _cut(long_enough, width))


def coordinate_fallback(s: Column, width: int | None = None) -> Column:
    """The coordinate phrase of a sentence, of at most `width` characters if one is given."""
    return F.when(s.contains("long") | s.contains("lat"), _coordinate_text(s, "along", width))


def wd_regions(s: Column) -> Column:
    """Every `over X` of a western disturbance, else its coordinate phrase."""
    chunk = F.regexp_extract(s, rx.rx(v.WD_START), 0)
    named = F.array_distinct(rx.no_blanks(F.transform(rx.groups(chunk, v.WD_OVER), lambda r: text.clean_region(r))))
    axis = text.clean_region(rx.replace(coordinate_fallback(s), v.OBSERVATION_HOUR, "", ignore_case=True))
    by_axis = F.array_compact(F.array(rx.not_blank(axis)))
    found = rx.bind(named, lambda n: F.when(F.size(n) > 0, n).otherwise(by_axis))
    return F.when(s.contains("western disturbance"), found).otherwise(no_regions())


def cycir_region(s: Column) -> Column:
    """Region of a circulation by the first of two shapes; NULL when none fits."""
    subject = F.when(s.contains("cyclonic circulation"), s)
    return text.clean_region(F.coalesce(*[rx.group(subject, p) for p in v.CYCIR_REGIONS]))


def path_regions(s: Column) -> Column:
    """Ends and waypoint of `from X to Y [across Z]`; empty when there is no path."""
    subject = F.when(s.contains("from"), s)
    found = F.coalesce(*[rx.parts(subject, p, (1, 2, 3)) for p in v.PATH_REGIONS], no_regions())
    return F.transform(rx.no_blanks(found), lambda r: text.clean_region(r))


def _by_keyword(s: Column, keyword: str) -> Column:
    return rx.group(F.when(s.contains(keyword), s), rf"\b{keyword}{v.KEYWORD_REGION}")


def _off_path_region(s: Column) -> Column:
    """Region of a trough without a path: coordinates, else the first preposition phrase."""

    def phrase(keyword: str) -> Column:
        region = text.clean_region(_by_keyword(s, keyword))
        return rx.keep_if(region, lambda r: (r != "") & ~r.isin(v.BARE_COORDINATE_WORDS))

    return F.coalesce(text.clean_region(coordinate_fallback(s)), *[phrase(k) for k in v.REGION_KEYWORDS])


def trough_region(s: Column) -> Column:
    """One text: path regions joined, else coordinates, else a preposition phrase."""
    return rx.bind(
        path_regions(s),
        lambda path: F.when(F.size(path) > 0, text.format_regions(path)).otherwise(_off_path_region(s)),
    )


def trough_regions(s: Column) -> Column:
    """Regions of a trough mention: the path parts, else at most one region."""
    single = F.array_compact(F.array(rx.not_blank(_off_path_region(s))))
    return rx.bind(path_regions(s), lambda path: F.when(F.size(path) > 0, path).otherwise(single))


def aloft_trough(s: Column) -> Column:
    """STRUCT(regions, height) of a trough named as `with a trough aloft`."""
    level = F.coalesce(rx.group(s, v.ALOFT_HEIGHT).try_cast("double"), F.lit(0.0))
    axis = text.clean_region(F.when(s.contains("along long"), coordinate_fallback(s)))
    there = F.struct(F.array_compact(F.array(axis)).alias("regions"), level.alias("height"))
    none = F.struct(no_regions().alias("regions"), F.lit(0.0).alias("height"))
    return F.when(s.contains("trough") & text.has_additional_trough(s), there).otherwise(none)


def generic_region(s: Column, width: int | None = None) -> Column:
    """Region of any sentence: coordinates, then prepositions in order, then a path.

    A preposition phrase that points back (`over the same region`) settles the answer as
    NULL; STRUCT wrapping keeps that apart from `not found`.
    """

    def found(value: Column) -> Column:
        return rx.bind(value, lambda x: F.when(x.isNotNull(), F.struct(x.alias("region"))))

    def on_longitude(point: Column) -> Column:
        lat, lon = F.lower(point["latitude"]), F.lower(point["longitude"])
        return F.coalesce(
            F.concat(F.lit("along long. "), lon, F.lit(" to the north of lat. "), lat),
            F.concat(F.lit("along long. "), lon),
        )

    def on_latitude(point: Column) -> Column:
        return F.concat(F.lit("along lat. "), F.lower(point["latitude"]))

    def axis(start: str, by_point) -> Column:
        by_text = _coordinate_text(s, start, width)
        return F.when(s.contains(start), found(F.coalesce(by_text, rx.bind(text.hemisphere_point(s), by_point))))

    def phrase(keyword: str) -> Column:
        region = _cut(rx.strip(_by_keyword(s, keyword)), width)

        def settled(r: Column) -> Column:
            answer = F.struct(F.when(~rx.matches(r, v.SAME_REGION), r).alias("region"))
            return F.when(r.isNotNull() & ~r.isin(v.BARE_COORDINATE_WORDS), answer)

        return rx.bind(region, settled)

    def path(ends: Column) -> Column:
        joined = F.array_join(rx.no_blanks(F.transform(ends, lambda e: rx.strip(e))), v.EXTRACT_DELIMITER)
        return _cut(joined, width)

    candidates = [
        axis("along long", on_longitude),
        axis("along lat", on_latitude),
        *[phrase(k) for k in v.REGION_KEYWORDS],
        found(path(rx.parts(F.when(s.contains("from"), s), v.GENERIC_PATH, (1, 2, 3)))),
    ]
    return F.coalesce(*candidates)["region"]


def parse_sentence(sentence: Column) -> list[Column]:
    """The five fields of a sentence as aliased columns."""
    s = F.lower(text.normalize_text(sentence))
    return [
        primary_system(s).alias("weather_system"),
        generic_region(s).alias("region"),
        height(s).alias("height_km"),
        pressure_text(s).alias("pressure_level"),
        status(s).alias("status"),
    ]

