"""Pair filters against a row-by-row reading of the same rules, on random pairs and rows."""

from __future__ import annotations

import random
import re

import pytest

from metframe.functions.pairs import FilterPair
from metframe.operators import views

ROW = "id bigint, entry_date date, weather_system string, subdivisions string, pressure_level string"
SYSTEMS = ["CYCIR", "Trough", "WD", ""]
SUBS = [None, "Bihar, Odisha", "Kerala", "0, Bihar", " Haryana, Chandigarh & Delhi ", ""]
LEVELS = [None, "Surface", "850 hPa", "850 hPa, 700 hPa", "925", "-5.5 x", "0"]


def listed(text):
    return [p.strip() for p in (text or "").split(",") if p.strip() not in ("", "0")]


def number(text):
    found = re.search(r"-?[0-9]+(?:\.[0-9]+)?", text)
    return float(found.group()) if found else None


def level_fits(level, operator, value):
    wanted = float(value) if re.fullmatch(r"[+-]?\d+(\.\d*)?", value) else None
    given = number(level)
    if operator == "=":
        return (wanted is not None and given == wanted) or value.lower() in level.lower()
    if wanted is None or given is None:
        return False
    return {"<": given < wanted, ">": given > wanted}.get(operator, False)


def row_fits(row, pair):
    _, _, system, subs, levels = row
    operator, value = pair.pressure_operator.strip(), pair.pressure_value.strip()
    pressure = bool(operator and value)
    if not (pair.system.strip() or pair.subdivision.strip() or pressure):
        return False
    wanted = listed(pair.subdivision)
    return (
        pair.system.strip().lower() in system.lower()
        and (pair.subdivision.strip() in ("", "0") or any(w.lower() in s.lower() for w in wanted for s in listed(subs)))
        and (not pressure or any(level_fits(x, operator, value) for x in listed(levels)))
    )


def like_fits(row, pair):
    system = pair.system in ("", "0") or pair.system.strip().lower() in row[2].lower()
    subs = pair.subdivision in ("", "0") or any(
        row[3] is not None and w.strip().lower() in row[3].lower() for w in pair.subdivision.split(",")
    )
    return system and subs


def expected(rows, pairs):
    named = [p for p in pairs if p.system not in ("", "0") or p.subdivision not in ("", "0")]
    active = [p for p in pairs if not p.is_blank]
    rows = [r for r in rows if not named or any(like_fits(r, p) for p in named)]
    if not active:
        return {r[0] for r in rows}
    fits = {r[0]: [row_fits(r, p) for p in active] for r in rows}
    dates = {}
    for r in rows:
        dates.setdefault(r[1], []).append(fits[r[0]])
    good = {d for d, flags in dates.items() if all(any(f[i] for f in flags) for i in range(len(active)))}
    return {r[0] for r in rows if any(fits[r[0]]) and r[1] in good}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    import datetime

    return [
        (i, datetime.date(2025, 6, 1 + rng.randint(0, 14)), rng.choice(SYSTEMS), rng.choice(SUBS), rng.choice(LEVELS))
        for i in range(90)
    ]


@pytest.mark.parametrize("seed", range(14))
def test_random_pairs(spark, rows, seed):
    rng = random.Random(seed)
    pairs = [
        FilterPair(
            rng.choice(["", "", "cycir", "WD ", "trough"]), rng.choice(["", "", "bihar", "Kerala, odisha", ",", "0"]),
            rng.choice(["", "=", "<", ">", ">="]), rng.choice(["", "850", " 700 ", "surface", "-5.5", "0"]),
        )
        for _ in range(rng.randint(0, 3))
    ]
    found = views.filter_entries(spark.createDataFrame(rows, ROW), pairs)
    assert {r["id"] for r in found.collect()} == expected(rows, pairs)
