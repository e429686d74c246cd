"""Coordinates and region texts to named subdivisions.

The gazetteers and the alias map are fixed tables of fewer than 100 rows. They go into the
plan as array literals, so every lookup is row-local: no join, no shuffle, and a region
text that fills a third of the data costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import rx, text
from metframe.functions.literals import struct_array

Point = tuple[str, float, float]


def key_of(name: str) -> str:
    """Plan-time form of `text.subdivision_key` for the fixed names."""
    spaced = name.lower().replace("&", " and ")
    return " ".join("".join(ch if ch.isascii() and ch.isalnum() else " " for ch in spaced).split())


def _points(points: Sequence[Point]) -> Column:
    return struct_array(
        [{"pos": i, "name": name, "lat": float(lat), "lon": float(lon)} for i, (name, lat, lon) in enumerate(points)]
    )


def coordinate_distance(lat: Column, lon: Column, longitude: Column, min_latitude: Column) -> Column:
    """Degrees off in longitude plus degrees short in latitude."""
    short = F.greatest(F.lit(0.0), min_latitude - lat)
    return F.abs(lon - longitude) + F.coalesce(short, F.lit(0.0))


def _nearest(points: Sequence[Point], longitude: Column, min_latitude: Column, tolerance: float) -> Column:
    def names(axis: Column) -> Column:
        lon, lat = axis["lon"], axis["lat"]
        near = F.filter(
            _points(points),
            lambda p: (F.abs(p["lon"] - lon) <= tolerance) & F.coalesce(p["lat"] >= lat - v.LAT_SLACK, F.lit(True)),
        )
        ranked = F.array_sort(
            F.transform(
                near,
                lambda p: F.struct(
                    coordinate_distance(p["lat"], p["lon"], lon, lat).alias("distance"),
                    p["pos"].alias("pos"),
                    p["name"].alias("name"),
                ),
            )
        )
        top = F.transform(F.slice(ranked, 1, v.COORDINATE_TOP), lambda p: p["name"])
        return F.when(lon.isNotNull(), top).otherwise(F.array().cast("array<string>"))

    return rx.bind(F.struct(longitude.alias("lon"), min_latitude.alias("lat")), names)


def imd_subdivisions(
    region: Column, points: Sequence[Point] = v.IMD_POINTS, tolerance: float = v.IMD_LON_TOLERANCE
) -> Column:
    """Up to five centroids near a coordinate phrase; the latitude may be missing."""
    return _nearest(points, text.longitude(region), text.min_latitude(region), tolerance)


def form_subdivisions(
    region: Column,
    points: Sequence[Point] = v.FORM_POINTS,
    official: Sequence[str] = v.OFFICIAL_SUBDIVISIONS,
    tolerance: float = v.FORM_LON_TOLERANCE,
) -> Column:
    """As above among official names only, and only with both coordinates given."""
    allowed = [p for p in points if p[0] in set(official)]
    lon, lat = text.longitude(region), text.min_latitude(region)
    return _nearest(allowed, F.when(lat.isNotNull(), lon), lat, tolerance)


# --- region text resolution -----------------------------------------------------------


def resolve_region(region_text: Column) -> Column:
    """STRUCT(region, region_original): coordinate parts replaced by the centroids they hit.

    The original is NULL unless some coordinate part was replaced.
    """
    parts = rx.no_blanks(F.transform(F.split(F.coalesce(region_text, F.lit("")), ";"), lambda p: rx.strip(p)))

    def hit(part: Column) -> Column:
        names = F.when(text.is_coordinate_region(part), imd_subdivisions(part))
        return F.struct(part.alias("part"), names.alias("names"))

    def named(h: Column) -> Column:
        return (
            F.when(h["names"].isNull(), F.array(text.clean_region(h["part"])))
            .when(F.size(h["names"]) > 0, h["names"])
            .otherwise(F.array(h["part"]))
        )

    def resolved(hits: Column) -> Column:
        names = F.array_distinct(rx.no_blanks(F.flatten(F.transform(hits, named))))
        replaced = F.transform(F.filter(hits, lambda h: F.size(h["names"]) > 0), lambda h: h["part"])
        return F.struct(
            text.format_regions(names).alias("region"),
            rx.not_blank(text.format_regions(replaced)).alias("region_original"),
        )

    return rx.bind(F.transform(parts, hit), resolved)


# --- fragment lookups -----------------------------------------------------------------


def _aliases() -> Column:
    """Aliases, longest first and by list order within one length."""
    ranked = sorted(v.REGION_ALIASES.items(), key=lambda item: -len(item[0]))
    return struct_array([{"key": key, "names": names} for key, names in ranked])


def _officials(names: Sequence[str]) -> Column:
    return struct_array([{"key": key_of(n), "name": n} for n in names])


def _either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def alias_exact(key: Column) -> Column:
    """Subdivisions of the alias equal to the key, else NULL."""
    return rx.bind(key, lambda k: F.get(F.filter(_aliases(), lambda a: a["key"] == k), F.lit(0))["names"])


def alias_longest(key: Column) -> Column:
    """Subdivisions of the longest alias that holds, or is held by, the key, else NULL."""
    return rx.bind(
        key, lambda k: F.get(F.filter(_aliases(), lambda a: _either_contains(a["key"], k)), F.lit(0))["names"]
    )


def official_fuzzy(key: Column, official: Sequence[str] = v.OFFICIAL_SUBDIVISIONS) -> Column:
    """All official names that hold, or are held by, the key, longest name first."""
    ranked = _officials(sorted(official, key=lambda n: -len(n)))

    def names(k: Column) -> Column:
        hits = F.filter(ranked, lambda o: (k != "") & _either_contains(o["key"], k))
        return F.transform(hits, lambda o: o["name"])

    return rx.bind(key, names)


def token_containment(key: Column, official: Sequence[str] = v.OFFICIAL_SUBDIVISIONS) -> Column:
    """Official names, alias names apart, whose core words all occur in the key."""
    rows = []
    for name in official:
        words = key_of(name).split()
        core = [w for w in words if len(w) > 2 and w not in v.TOKEN_STOP_WORDS]
        if core and key_of(name) not in v.REGION_ALIASES:
            rows.append({"name": name, "core": core})

    def names(words: Column) -> Column:
        fitting = F.filter(struct_array(rows), lambda o: F.size(F.array_except(o["core"], words)) == 0)
        return F.transform(fitting, lambda o: o["name"])

    return rx.bind(F.split(key, " "), names)


def fragment_subdivisions(fragment: Column) -> Column:
    """First tier that answers: exact alias, longest alias, coordinates, names, words."""

    def tiers(k: Column) -> Column:
        names = official_fuzzy(k)
        by_name = rx.bind(names, lambda n: F.when(F.size(n) > 0, n).otherwise(token_containment(k)))
        on_axis = F.when(text.is_coordinate_region(fragment), form_subdivisions(fragment))
        return F.coalesce(alias_exact(k), alias_longest(k), on_axis, by_name)

    return rx.bind(text.subdivision_key(fragment), tiers)


def region_subdivisions(region_text: Column) -> Column:
    """Ordered distinct official subdivisions of a free region text."""
    source = F.coalesce(region_text, F.lit(""))
    axes = F.flatten(F.transform(text.coordinate_phrases(source), lambda p: form_subdivisions(p)))
    fragments = text.split_fragments(text.without_coordinate_phrases(source))
    named = F.flatten(F.transform(fragments, lambda f: fragment_subdivisions(f)))
    return F.array_distinct(F.concat(axes, named))


def entity_subdivisions(region: Column, original: Column) -> Column:
    """Subdivisions of a row: of its region and, where kept, its original coordinates."""
    parts = F.array(text.blank_to_null(region), text.blank_to_null(original))
    return region_subdivisions(F.array_join(F.array_compact(parts), v.EXTRACT_DELIMITER))


