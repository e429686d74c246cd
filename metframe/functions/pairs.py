"""Filter pairs: one (system, subdivision, pressure) condition compiled to Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from metframe import vocab as v
from metframe.functions import text


@dataclass(frozen=True)
class FilterPair:
    """One row of the query form; blank fields do not restrict."""

    system: str = ""
    subdivision: str = ""
    pressure_operator: str = ""
    pressure_value: str = ""

    @property
    def is_blank(self) -> bool:
        fields = (self.system, self.subdivision, self.pressure_operator, self.pressure_value)
        return not any(field.strip() for field in fields)


def active_pairs(pairs: Sequence[FilterPair]) -> list[FilterPair]:
    return [pair for pair in pairs if not pair.is_blank]


def _is_set(value: str) -> bool:
    """A form value counts as given unless empty or a bare `0`."""
    return value not in ("", "0")


def _number(value: str) -> float | None:
    ok = re.fullmatch(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?", value)
    return float(value) if ok else None


def prefilter(pairs: Sequence[FilterPair], system: Column, subdivisions: Column) -> Column | None:
    """OR over pairs of the LIKE conditions; pairs with only a pressure take no part."""
    choices = []
    for pair in pairs:
        conditions = []
        if _is_set(pair.system):
            conditions.append(system.ilike(f"%{pair.system.strip()}%"))
        if _is_set(pair.subdivision):
            wanted = [part.strip() for part in pair.subdivision.split(",")]
            conditions.append(reduce(lambda a, b: a | b, [subdivisions.ilike(f"%{w}%") for w in wanted]))
        if conditions:
            choices.append(reduce(lambda a, b: a & b, conditions))
    return reduce(lambda a, b: a | b, choices) if choices else None


def _holds(item: Column, needle: str) -> Column:
    return F.lower(item).contains(needle.lower())


def system_matches(system: Column, wanted: str) -> Column:
    return _holds(F.coalesce(system, F.lit("")), wanted.strip())


def subdivisions_match(items: Column, wanted: str) -> Column:
    """Any listed subdivision holds any wanted one (a comma list)."""
    needles = [w.strip() for w in wanted.split(",") if _is_set(w.strip())]
    if not needles:
        return F.lit(False)
    return F.exists(items, lambda item: reduce(lambda a, b: a | b, [_holds(item, n) for n in needles]))


def pressure_matches(levels: Column, operator: str, value: str) -> Column:
    """Any listed level satisfies the comparison by its first number.

    `=` also accepts a level whose text holds the value; an operator other than `=`, `<`
    and `>` is never satisfied; a missing operator or value always is.
    """
    if operator == "" or value == "":
        return F.lit(True)
    wanted = _number(value)

    def first_number(level: Column) -> Column:
        return F.regexp_extract(level, v.FIRST_NUMBER, 0).try_cast("double")

    def satisfied(level: Column) -> Column:
        if operator == "=":
            same = F.lit(False) if wanted is None else F.coalesce(first_number(level) == wanted, F.lit(False))
            return same | _holds(level, value)
        if wanted is None or operator not in ("<", ">"):
            return F.lit(False)
        number = first_number(level)
        compared = number < wanted if operator == "<" else number > wanted
        return F.coalesce(compared, F.lit(False))

    return F.exists(levels, satisfied)


def row_matches(
    pair: FilterPair, system: Column, subdivisions: Column, pressure: Column, delimiter: str = ","
) -> Column:
    """Does a row satisfy every part of one pair? A pair without any usable part never fits."""
    conditions = []
    usable = False
    if pair.system.strip():
        usable = True
        conditions.append(system_matches(system, pair.system))
    if pair.subdivision.strip():
        usable = True
        if _is_set(pair.subdivision.strip()):
            conditions.append(
                subdivisions_match(text.split_form_list(subdivisions, delimiter), pair.subdivision)
            )
    operator, value = pair.pressure_operator.strip(), pair.pressure_value.strip()
    if operator and value:
        usable = True
        conditions.append(pressure_matches(text.split_form_list(pressure, delimiter), operator, value))
    if not usable:
        return F.lit(False)
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def viewer_matches(
    entry_date: Column, subdivisions: Column, date: str = "", subdivision: str = ""
) -> Column:
    """The viewer's own filter: date equal and any subdivision holding the text."""
    conditions = [F.lit(True)]
    if date:
        conditions.append(entry_date == F.lit(date).cast("date"))
    if subdivision:
        conditions.append(F.exists(subdivisions, lambda s: _holds(s, subdivision)))
    return reduce(lambda a, b: a & b, conditions)


