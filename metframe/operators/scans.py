"""Ordered scans within groups of any size.

A plain window over a group puts the whole group into one task. Carries cut every group into chunks of its order column; rows
are only ever ordered within (group, chunk), and what one chunk owes the next is worked out on one summary row per chunk. Numbers
come from a sorted write: a summary has a row for each block of it and each group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metframe.session import materialize

CHUNK_ROWS = 1 << 16


def chunk_of(order: Column, rows: int | None = CHUNK_ROWS) -> Column:
    """Chunk number of a row from its whole-number order column; 0 when nothing is cut."""
    if rows is None:
        return F.lit(0).cast("bigint")
    return F.floor(order / F.lit(rows)).cast("bigint")


def needed_cut(rows: DataFrame, groups: Sequence[str], order: str, chunk_rows: int | None = CHUNK_ROWS) -> int | None:
    """`chunk_rows`, or None where all orders lie in the first chunk: groups are then not cut anyway, and steps that cut them are left out.

    Where a group holds an order twice the cut stays, so that ties fall as they always did. Rows are told apart by a 64-bit hash. Reads these columns of
    a table or materialised stage.
    """
    if chunk_rows is None:
        return None
    places = rows.groupBy(F.xxhash64(*groups, order).alias("_place")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_at"), F.max(order).alias("_to"))
    most, low, high = places.agg(F.max("_n"), F.min("_at"), F.max("_to")).first()
    if most is None:
        return None
    alone = most == 1 and low is not None and low >= 0 and high < chunk_rows
    return None if alone else chunk_rows


def in_file_order(rows: DataFrame, name: str, file: Column, block: Column) -> DataFrame:
    """Add `name` = 0, 1, ... through each file and on from file to file, by file name.

    `rows` come straight from a file scan; `file` and `block` are its metadata columns.
    Inside one block `monotonically_increasing_id` rises with the rows, so only one summary
    row per block is ever sorted.
    """
    where = ["_file", "_block"]
    raw = rows.select("*", file.alias("_file"), block.alias("_block"), F.monotonically_increasing_id().alias("_id"))
    sizes = raw.groupBy(*where).agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy(*where).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*where, "_low", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    position = (F.col("_start") + F.col("_id") - F.col("_low")).alias(name)
    return raw.join(starts, where).select(*rows.columns, position)


def number_rows(
    df: DataFrame, name: str, position: str, groups: Sequence[str] = (), major: Sequence[Column] = ()
) -> DataFrame:
    """Add `name` = 1, 2, ... within `groups`, ordered by `major` and then by the unique `position`.

    `major` are sort expressions. Rows are range-partitioned by (groups, major, position) and written once in that order, so a group of
    any size spreads; numbers follow from the counts of a group in each file block.
    """
    majors = [f"_major{i}" for i in range(len(major))]
    cut = df.select("*", *[m.alias(a) for m, a in zip(major, majors)])
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (*groups, *majors, position)]
    return number_sorted(cut, name, *order, groups=groups).select(*df.columns, name)


def number_sorted(df: DataFrame, name: str, *order: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Add `name` = 1, 2, ... in any order, from 1 again in each of the `groups`, which the order begins with.

    The sorted rows are written once; the order of the written files is the order of the
    rows, so numbers follow from counts per block without a window over the rows.
    """
    placed = _placed(materialize(df.orderBy(*order), "sorted"))
    numbered = _with_starts(placed, groups)
    number = F.col("_start") + F.col("_id") - F.col("_low") + 1
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], number.cast("bigint").alias(name))


def number_both(df: DataFrame, name: str, inner: str, groups: Sequence[str], *order: Column) -> DataFrame:
    """Add `name` = 1, 2, ... over all rows and `inner` = 1, 2, ... within `groups`, both in one order, from one sorted write.

    A row's place among those of its group is found within its block of a file, so a group of any size is cut; what comes before
    a block is a sum over blocks.
    """
    placed = _placed(materialize(df.orderBy(*order), "sorted"))
    number = F.col("_start") + F.col("_id") - F.col("_low") + 1
    whole = _with_starts(placed, ()).withColumn(name, number.cast("bigint")).drop("_start", "_low")
    within = Window.partitionBy(*[F.col(f"`{g}`") for g in groups], "_file", "_block").orderBy("_id")
    ranked = whole.withColumn("_rank", F.row_number().over(within))
    starts = _with_starts(ranked, groups, placed)
    return starts.select(
        *[F.col(f"`{c}`") for c in df.columns], name, (F.col("_start") + F.col("_rank")).cast("bigint").alias(inner)
    )


def _with_starts(rows: DataFrame, groups: Sequence[str], placed: DataFrame | None = None) -> DataFrame:
    """`rows` with `_start` and `_low` of their block and group, which are counted over `placed` (the rows themselves).

    The counts are written, so that the join is planned by their real size.
    """
    keys = [*groups, "_file", "_block"]
    starts = materialize(block_starts(rows if placed is None else placed, groups), "starts")
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in keys]
    return rows.alias("r").join(starts.alias("s"), same).select("r.*", "s._start", "s._low")


def _placed(stored: DataFrame) -> DataFrame:
    """Rows of a stored stage with their file (longer names carry larger part numbers), block and place within it."""
    file = F.col("_metadata.file_name")
    return stored.select(
        "*", F.struct(F.length(file), file).alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )


def block_starts(placed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """How many rows of a group come before each block, and where the group begins in it: at most blocks + groups rows."""
    own = [F.col(f"`{g}`") for g in groups]
    where = [*own, "_file", "_block"]
    sizes = placed.groupBy(*where).agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*own).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*where, "_low", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))


def look_around(
    df: DataFrame,
    groups: Sequence[str],
    order: str,
    last: Mapping[str, Column],
    ahead: Mapping[str, Column],
    with_current: bool,
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Add what earlier rows left behind and what the next row holds.

    `last` columns take the last non-NULL of an expression among earlier rows (and the row
    itself, with `with_current`), `ahead` columns an expression of the following row. Rows
    shuffle once; one summary row per chunk carries values across. `df` is read twice and
    should be a table or a materialised stage; once when no group needs cutting.
    """
    keys = [*groups, "_chunk"]
    end = Window.currentRow if with_current else -1
    packed = F.struct(*[e.alias(n) for n, e in ahead.items()]) if ahead else F.lit(None).cast("string")
    cut = df.withColumn("_chunk", chunk_of(F.col(order), chunk_rows))
    sorted_rows = Window.partitionBy(*keys).orderBy(order)
    passed = sorted_rows.rowsBetween(Window.unboundedPreceding, end)
    rows = cut.select(
        "*", *[F.last(e, ignorenulls=True).over(passed).alias(f"_last_{n}") for n, e in last.items()],
        F.lead(packed).over(sorted_rows).alias("_next"),
    )
    found = {n: F.col(f"_last_{n}") for n in last}
    if chunk_rows is None:
        following = F.col("_next")
    else:
        ends = cut.groupBy(*keys).agg(
            *[F.max_by(e, F.when(e.isNotNull(), F.col(order))).alias(n) for n, e in last.items()],
            F.min_by(packed, F.col(order)).alias("_head"),
        )
        by_chunk = Window.partitionBy(*groups).orderBy("_chunk")
        earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
        handed = ends.select(
            *keys, *[F.last(n, ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in last],
            F.lead("_head").over(by_chunk).alias("_after"),
        )
        carries = [f"_carry_{n}" for n in last] + ["_after"]
        useful = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in carries])
        rows = rows.join(handed.filter(useful), keys, "left")
        found = {n: F.coalesce(column, F.col(f"_carry_{n}")) for n, column in found.items()}
        following = F.coalesce("_next", "_after")
    return rows.select(
        *df.columns, *[column.alias(n) for n, column in found.items()], *[following[n].alias(n) for n in ahead]
    )


def carry_last(
    df: DataFrame, groups: Sequence[str], order: str, values: Mapping[str, Column], with_current: bool,
    chunk_rows: int | None = CHUNK_ROWS,
) -> DataFrame:
    """Add columns holding the last non-NULL of each expression among earlier rows."""
    return look_around(df, groups, order, values, {}, with_current, chunk_rows)
