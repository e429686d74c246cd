"""Fixed tables as array literals, each parsed by Spark in one go and folded at plan time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(value) -> str:
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(_literal, value))})"
    return str(value)


def text_array(values: Sequence[str]) -> Column:
    return F.expr(_literal(list(values)))


def struct_array(rows: Sequence[Mapping]) -> Column:
    """ARRAY<STRUCT> of rows with the same keys."""
    structs = (
        "named_struct(" + ", ".join(f"'{name}', {_literal(value)}" for name, value in row.items()) + ")" for row in rows
    )
    return F.expr(f"array({', '.join(structs)})")
