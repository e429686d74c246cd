"""Tiles of a text against plain greedy string tiling, and bounded memory on repeated words."""

from __future__ import annotations

import random
import time
import tracemalloc

from metframe.llm.common import plain_words
from metframe.llm.decontaminate import Tiling


def plain_tiles(item: str, text: str, least: int) -> list[tuple[int, int, int]]:
    """The longest match of unmarked words again and again, the first place in item and text among equals."""
    a, b = plain_words(item), plain_words(text)
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return tiles
        for k in range(best[2]):
            free_a[best[0] + k] = free_b[best[1] + k] = False
        tiles.append(best)


def test_tiles_equal_plain_ones():
    rng = random.Random(5)
    for _ in range(600):
        letters, least = "abcdefghijklmnop"[: rng.choice([1, 2, 3, 6, 12])], rng.choice([2, 3, 5])

        def words(low: int, high: int) -> str:
            return " ".join(rng.choice(letters) for _ in range(rng.randint(low, high)))

        items, text = [words(least, 25) for _ in range(rng.randint(1, 4))], words(least, 40)
        if rng.random() < 0.5:  # a passage in another order
            text += " " + " ".join(items[0].split()[4:12] + ["zz"] + items[0].split()[:5])
        for coverage in (0.0, 0.5):
            want = {i: plain_tiles(item, text, least) for i, item in enumerate(items)}
            want = {i: t for i, t in want.items() if t and sum(n for *_, n in t) >= coverage * len(items[i].split())}
            found = {leak.item: leak.tiles for leak in Tiling(items, least, coverage).leaks(text)}
            assert {i: t for i, t in found.items() if t} == want, (items, text, least)


def test_repeated_words_are_not_multiplied():
    began = time.perf_counter()
    tiling = Tiling(["x " * 2000] * 20)
    tracemalloc.start()
    found = tiling.leaks("x " * 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [leak.tiles for leak in found] == [[(0, 0, 2000)]] * 20
    assert peak < 200 << 20 and time.perf_counter() - began < 10


def test_a_common_passage_of_many_items():
    items = [f"p q r s t u{i} v{i} w{i} x{i} y{i} z{i}" for i in range(2000)]
    text = " ".join(f"p q r s t m{i}" for i in range(300))
    assert Tiling(items).leaks(text) == []
    assert [leak.tiles for leak in Tiling(items).leaks(text + " " + items[7])] == [[(0, 1800, 11)]]
