"""Spelling variants against edit distances of all pairs of words."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np

from metframe.llm import spelling


def plain_counts(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_counts(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    forms = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, n, len(near[w]), forms[w], words.get(forms[w]), root))
    return out


def corpus(seed):
    """Words of few letters, so that many are near each other, some with accents, of very unequal counts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcéÉ÷") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    words += [w[:i] + w[i + 1 :] for w in words for i in (0, 3)] + ["Strange", "stränge", "strange", "ab" * 40, "ab" * 40 + "a"]
    rows = [(d, " ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=400)).title()) for d in range(60)]
    return rows + [(7, "strange1strange,STRANGE"), (None, "strange strange"), (8, None), (9, ""), (9, "12 œ Ābcdef")]


def test_variants_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LEAF_WORDS", 40)
    monkeypatch.setattr(spelling, "_HELD_WORDS", 100)
    rows = corpus(1)
    frame = spark.createDataFrame([(d, t, 1, "w", "r") for d, t in rows], "doc_id long, text string, n int, word string, root string")
    want = plain_variants(rows)
    assert sum(r[3] is not None for r in want) > 30 and any(r[3] != r[5] for r in want if r[3])
    found = spelling.variants(frame).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_empty_tables_and_long_texts(spark):
    frame = spark.createDataFrame([(1, "longword " * 60_000 + "longwerd " * 4)], "doc_id long, text string")
    found = {r["word"]: tuple(r)[1:] for r in spelling.variants(frame).collect()}
    assert found == {"longword": (60_000, 1, None, None, "longword"), "longwerd": (4, 1, "longword", 60_000, "longword")}
    assert spelling.variants(frame.limit(0)).collect() == []


def test_boxes_hold_all_that_is_near():
    rng = np.random.default_rng(2)
    for size, longer in ((6, 0), (6, 1)):
        points = rng.integers(0, 5, (500, size + longer)).astype(np.int8)
        queries = rng.integers(0, 5, (300, size)).astype(np.int8)
        tree = spelling.Tree.of(spelling.counts_of(points), 8)
        found = set(zip(*(x.tolist() for x in spelling.search(queries, points, tree, 64))))
        text = lambda rows: ["".join(map(str, r)) for r in rows.tolist()]
        assert found == {(i, j) for i, a in enumerate(text(queries)) for j, b in enumerate(text(points)) if one_edit(a, b)}
