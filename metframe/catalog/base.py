"""What a registered query is, and SQL snippets the comparison queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metframe import vocab as v


@dataclass(frozen=True)
class Query:
    """`run(spark, sf_dir)` over the driver's tables; `sql` asks the same of another engine."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def joined(items: Column, name: str, delimiter: str = "|") -> Column:
    """A list as text, so that both engines compare the same value."""
    return F.array_join(items, delimiter).alias(name)


def form_list_sql(column: str, delimiter: str = ",") -> str:
    return (
        f"list_filter(list_transform(string_split(coalesce({column}, ''), '{delimiter}'), lambda x: trim(x)), "
        "lambda x: x NOT IN ('', '0'))"
    )


def list_sql(column: str, delimiter: str = ";") -> str:
    return (
        f"list_filter(list_transform(string_split(coalesce({column}, ''), '{delimiter}'), lambda x: trim(x)), "
        "lambda x: x <> '')"
    )


def distinct_sql(items: str) -> str:
    """First occurrences of a list, in order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def clean_sql(text: str) -> str:
    """Region text without edge characters and trailing remarks."""
    out = f"trim({text}, ' ,.;')"
    for noise in v.REGION_NOISE:
        out = f"regexp_replace({out}, '{noise}', '', 'gi')"
    return f"trim({out})"


def key_sql(text: str) -> str:
    return f"trim(regexp_replace(replace(lower({text}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
