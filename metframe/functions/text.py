"""Text projections: dates, sentences, region text and delimited lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import rx
from metframe.functions.literals import text_array


# --- dates ----------------------------------------------------------------------------


def _real_date(iso: Column) -> Column:
    """DATE of a Y-M-D text, NULL when the text is NULL or the day does not exist."""
    return rx.keep_if(iso, lambda t: ~t.startswith("0000")).try_cast("date")


def heading_date(paragraph: Column) -> Column:
    """Date of a heading such as `Sunday, 08th June 2025`."""

    def date(parts: Column) -> Column:
        month = F.array_position(text_array(v.MONTH_NAMES), parts[1])
        return F.when(month > 0, F.concat_ws("-", parts[2], month.cast("string"), parts[0]))

    def heading(lowered: Column) -> Column:
        found = rx.parts(F.when(lowered.contains("day"), lowered), v.HEADING_DATE, (1, 2, 3))
        return rx.bind(found, date)

    return _real_date(rx.bind(F.lower(paragraph), heading))


def file_name_date(name: Column) -> Column:
    """Date from the first 20YYMMDD in the stem of a file name."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    return _real_date(F.array_join(rx.parts(stem, v.FILE_NAME_DATE, (1, 2, 3)), "-"))


def strict_date(text: Column) -> Column:
    """Y-M-D, D-M-Y, D/M/Y or Y/M/D; anything else ends the job with an error."""
    message = F.concat(F.lit("Unrecognized date format: "), F.coalesce(text, F.lit("")))
    return F.coalesce(parse_date(text), F.raise_error(message).cast("date"))


def parse_date(text: Column) -> Column:
    """The four accepted shapes, NULL for anything else."""
    year_first = r"^[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}\z"
    year_last = r"^([0-9]{1,2})([-/])([0-9]{1,2})\2([0-9]{4})\z"

    def iso(t: Column) -> Column:
        return F.when(t.rlike(year_first), F.translate(t, "/", "-")).when(
            t.rlike(year_last), F.regexp_replace(t, year_last, "$4-$3-$1")
        )

    return _real_date(rx.bind(rx.strip(text), iso))


def lenient_date_text(text: Column) -> Column:
    """Two shapes by form only: YYYY-MM-DD kept, DD-MM-YYYY turned around, else NULL."""
    t = php_trim(text)
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t).when(
        t.rlike(r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$"),
        F.regexp_replace(t, r"^([0-9]{2})-([0-9]{2})-([0-9]{4})$", "$3-$2-$1"),
    )


# --- sentences ------------------------------------------------------------------------


def normalize_text(text: Column) -> Column:
    """Long dashes to hyphens, white space collapsed and trimmed; case is kept."""
    uneven = text.rlike(rx.rx(r"[\s&&[^ ]]|[\x1c-\x1f–—]|  |\A | \z"))
    even = F.trim(rx.replace(F.translate(text, "–—", "--"), rx.WHITE_RUN, " "))
    return F.when(uneven, even).otherwise(text)


def _protected(text: Column) -> Column:
    """Newlines to blanks, domain abbreviations hidden from the sentence splitter."""

    def hidden(t: Column) -> Column:
        out = t
        for pattern, by in v.ABBREVIATIONS:
            out = rx.replace(out, pattern, by, ignore_case=True)
        return F.when(rx.matches(t, v.ANY_ABBREVIATION), out).otherwise(t)

    return rx.bind(F.replace(text, F.lit("\n"), F.lit(" ")), hidden)


def _cleaned(parts: Column) -> Column:
    return rx.no_blanks(F.transform(parts, lambda s: rx.strip(F.replace(s, F.lit("<prd>"), F.lit(".")))))


def split_plain_sentences(text: Column) -> Column:
    """Sentences by punctuation only, before fragments are glued."""
    return _cleaned(rx.split(_protected(text), r"(?<=[.!?])\s+"))


def split_glued_sentences(text: Column) -> Column:
    """Sentences with leading fragments glued to the sentence before them.

    A boundary followed by a fragment start is not a boundary: its white space becomes one
    blank, and the possessive split passes over it. No grouping is needed for the merge.
    """
    glued = rx.replace(_protected(text), rf"(?<=[.!?])\s+(?={v.FRAGMENT_STARTS})", " ", ignore_case=True)
    return _cleaned(rx.split(glued, rf"(?<=[.!?])\s++(?!{v.FRAGMENT_STARTS})", ignore_case=True))


def split_clauses(sentences: Column) -> Column:
    """Clauses that share a sentence, with the summary heading taken off."""
    boundary = rf"(?<=\.)\s+(?={v.CLAUSE_STARTS})"

    def clauses(s: Column) -> Column:
        return F.when(rx.matches(s, r"\.\s"), rx.split(s, boundary, ignore_case=True)).otherwise(F.array(s))

    parts = F.flatten(F.transform(sentences, clauses))
    return rx.no_blanks(
        F.transform(parts, lambda p: rx.strip(rx.replace(p, v.SUMMARY_PREFIX, "", ignore_case=True)))
    )


def split_sentences(text: Column) -> Column:
    """ARRAY of final sentences of one text; row-local, so no shuffle whatever the length."""
    return split_clauses(split_glued_sentences(text))


# --- sentence filters -----------------------------------------------------------------


def is_monsoon_limit(lowered: Column) -> Column:
    return lowered.contains(v.MONSOON_LIMIT_PHRASE)


def is_forecast(lowered: Column) -> Column:
    return rx.matches(lowered, v.FORECAST)


def is_continuation(lowered: Column) -> Column:
    return rx.matches(lowered, v.CONTINUATION)


def is_less_marked(status: Column) -> Column:
    """True only for a present status that says so; NULL counts as no."""
    return F.coalesce(F.lower(status).contains(v.LESS_MARKED_PHRASE), F.lit(False))


def has_additional_trough(lowered: Column) -> Column:
    return rx.matches(lowered, v.ADDITIONAL_TROUGH)


# --- region text ----------------------------------------------------------------------


def clean_region(text: Column) -> Column:
    """Region text without edge characters and trailing remarks.

    One test finds the few texts that carry a remark; only those go through the removals.
    """

    def cleaned(t: Column) -> Column:
        out = t
        for noise in v.REGION_NOISE:
            out = rx.replace(out, noise, "", ignore_case=True)
        return F.when(rx.matches(t, v.ANY_REGION_NOISE, ignore_case=True), out).otherwise(t)

    return rx.strip(rx.bind(F.btrim(text, F.lit(v.REGION_EDGE_CHARS)), cleaned))


def region_key(text: Column) -> Column:
    return rx.replace(F.lower(clean_region(text)), rx.WHITE_RUN, " ")


def subdivision_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), r"[^a-z0-9]+", " "))


def format_regions(regions: Column) -> Column:
    return F.array_join(rx.no_blanks(F.transform(F.array_compact(regions), clean_region)), v.EXTRACT_DELIMITER)


def split_fragments(region_text: Column) -> Column:
    """`;` separated fragments, cleaned, without blanks and bare system names."""
    parts = rx.no_blanks(F.transform(rx.split(region_text, r"\s*;\s*"), lambda p: clean_region(p)))
    return F.filter(parts, lambda p: ~F.lower(p).isin(v.FRAGMENT_STOP_PHRASES))


def coordinate_phrases(region_text: Column) -> Column:
    return F.transform(rx.groups(region_text, v.COORDINATE_PHRASE, 0, ignore_case=True), rx.strip)


def without_coordinate_phrases(region_text: Column) -> Column:
    return rx.replace(region_text, v.COORDINATE_PHRASE, " ", ignore_case=True)


def is_coordinate_region(text: Column) -> Column:
    return rx.matches(F.lower(text), v.COORDINATE_REGION)


def longitude(text: Column) -> Column:
    return rx.group(F.lower(text), v.LONGITUDE).try_cast("double")


def min_latitude(text: Column) -> Column:
    return rx.group(F.lower(text), v.LATITUDE).try_cast("double")


def hemisphere_point(text: Column) -> Column:
    """STRUCT(latitude, longitude) as `22°N`, `89°E`; a missing part is NULL."""

    def part(pattern: str) -> Column:
        return F.upper(F.array_join(rx.parts(text, pattern, (1, 2), ignore_case=True), "°"))

    return F.struct(
        part(v.LATITUDE_HEMISPHERE).alias("latitude"), part(v.LONGITUDE_HEMISPHERE).alias("longitude")
    )


# --- delimited lists and blanks -------------------------------------------------------


def php_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\0\x0b"))


def split_list(text: Column, delimiter: str = ";") -> Column:
    """Trimmed, non-blank parts; a NULL text gives an empty list."""
    return rx.no_blanks(F.transform(rx.split_at(F.coalesce(text, F.lit("")), delimiter), lambda p: rx.strip(p)))


def split_form_list(text: Column, delimiter: str = ",") -> Column:
    """As the viewer reads a list: blanks and a bare `0` are dropped."""
    parts = F.transform(rx.split_at(F.coalesce(text, F.lit("")), delimiter), lambda p: php_trim(p))
    return F.filter(parts, lambda p: ~p.isin("", "0"))


def blank_to_null(text: Column) -> Column:
    return rx.not_blank(rx.strip(text))


def level_hpa(label: Column) -> Column:
    """`700 hPa` -> 700; NULL for `Surface`, which therefore sorts last."""
    return rx.group(label, r"^\s*(\S+)").try_cast("int")
