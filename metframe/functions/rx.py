"""Regex helpers: one place that fixes the flavour of every pattern.

`U` makes classes and word boundaries Unicode aware, `d` lets only a newline end a line,
`i` ignores case. All helpers stay JVM-side and evaluate their argument once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITE_RUN = r"[\s\x1c-\x1f]+"
# Fixed value: a noncharacter for marks inside a program; texts that hold it all the same take the slower way.
_MARK = "\ufdd0"


def rx(pattern: str, ignore_case: bool = False) -> str:
    return ("(?iUd)" if ignore_case else "(?Ud)") + pattern


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once per row.

    A lambda body, or several uses in one expression, would evaluate an inlined value again
    and again; passing it through a one-element array makes it a lambda variable.
    """
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def keep_if(value: Column, condition: Callable[[Column], Column]) -> Column:
    """The value where the condition on it holds, else NULL; evaluated once."""
    return F.get(F.filter(F.array(value), lambda x: condition(x)), F.lit(0))


def not_blank(value: Column) -> Column:
    return keep_if(value, lambda x: x != "")


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Does the pattern occur? A pattern of plain words is a substring test."""
    if not ignore_case and re.fullmatch(r"[A-Za-z0-9 -]+", pattern):
        return text.contains(pattern)
    return text.rlike(rx(pattern, ignore_case))


def group(text: Column, pattern: str, index: int = 1, ignore_case: bool = False) -> Column:
    """One group of the first match; NULL when there is no match or the group is empty."""
    return not_blank(F.regexp_extract(text, rx(pattern, ignore_case), index))


def parts(text: Column, pattern: str, indexes: Sequence[int], ignore_case: bool = False) -> Column:
    """ARRAY of several groups of the first match, NULL when there is none.

    The match is cut out once and rewritten as its groups with marks between them; a match that holds the mark itself is taken
    apart group by group.
    """
    found = F.regexp_extract(text, rx(pattern, ignore_case), 0)

    def taken(match: Column) -> Column:
        marked = F.regexp_replace(match, rx(pattern, ignore_case), _MARK.join(f"${i}" for i in indexes))
        singly = F.array(*[F.regexp_extract(match, rx(pattern, ignore_case), i) for i in indexes])
        return F.when(match.contains(_MARK), singly).otherwise(F.split(not_blank(marked), _MARK))

    return bind(found, taken)


def groups(text: Column, pattern: str, index: int = 1, ignore_case: bool = False) -> Column:
    """One group of every match, in order."""
    return F.regexp_extract_all(text, F.lit(rx(pattern, ignore_case)), F.lit(index))


def replace(text: Column, pattern: str, by: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(text, rx(pattern, ignore_case), by)


def split(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Parts between the matches of a pattern.

    Matches become one mark and the text is cut at the marks: replacing keeps the compiled
    pattern from row to row, while splitting by a pattern compiles it for every row. That is
    left to texts which hold the mark themselves. The text is worked out once.
    """

    def cut(t: Column) -> Column:
        marked = F.split(F.regexp_replace(t, rx(pattern, ignore_case), _MARK), _MARK)
        return F.when(t.contains(_MARK), F.split(t, rx(pattern, ignore_case))).otherwise(marked)

    return bind(text, cut)


def split_at(text: Column, delimiter: str) -> Column:
    """Parts between plain delimiters; one character needs no pattern at all."""
    if len(delimiter) == 1:
        return F.split(text, "\\" + delimiter if delimiter in ".$|()[{^?*+\\" else delimiter)
    marked = F.split(F.replace(text, F.lit(delimiter), F.lit(_MARK)), _MARK)
    return F.when(text.contains(_MARK), F.split(text, re.escape(delimiter))).otherwise(marked)


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def first_label(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first rule whose pattern occurs in the text, else NULL."""
    return F.coalesce(*[F.when(matches(text, pattern), F.lit(label)) for pattern, label in rules])


def no_blanks(items: Column) -> Column:
    return F.filter(items, lambda item: item != "")
