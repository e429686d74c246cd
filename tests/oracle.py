"""Compare a registered query with its SQL twin: columns, row count and all values.

Run `python -m tests.oracle [name ...]` for a report of all or some queries.
"""

from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SF_DIR = os.environ.get("METFRAME_SF_DIR", "/root/testdata/sf0.01")

KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "hugeint": "int", "integer": "int", "double": "float",
    "float": "float", "string": "text", "varchar": "text", "date": "date", "boolean": "bool",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def mismatch(result: DataFrame, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs first."""
    names = sorted(result.columns)
    kinds = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in result.schema.fields}
    ours = _sorted([tuple(_plain(x) for x in row) for row in result.select(*[f"`{n}`" for n in names]).collect()])
    with connect(sf_dir) as connection:
        cursor = connection.execute(sql)
        described = [(d[0], str(d[1]).lower()) for d in cursor.description]
        index = {name: i for i, (name, _) in enumerate(described)}
        if sorted(index) != names:
            return f"columns {names} against {sorted(index)}"
        their_kinds = {name: KINDS.get(kind, kind) for name, kind in described}
        theirs = _sorted([tuple(_plain(row[index[n]]) for n in names) for row in cursor.fetchall()])
    wrong = {n: (kinds[n], their_kinds[n]) for n in names if kinds[n] != their_kinds[n]}
    if wrong:
        return f"types {wrong}"
    if ours == theirs:
        return None
    left, right = set(ours), set(theirs)
    only_ours = [r for r in ours if r not in right][:2]
    only_theirs = [r for r in theirs if r not in left][:2]
    return f"rows {len(ours)} against {len(theirs)}; {names}; only ours {only_ours}; only theirs {only_theirs}"


def main() -> None:
    from tests.conftest import session

    from metframe.catalog import all_queries
    from metframe.session import drop_stages

    spark = session()
    wanted = sys.argv[1:]
    failed = 0
    for name, query in all_queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            result = query.run(spark, SF_DIR)
            problem = mismatch(result, query.sql, SF_DIR) if query.sql else f"no sql, {result.count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print(f"{failed} not matched")
    drop_stages(spark)


if __name__ == "__main__":
    main()
