"""Windows of the packing operator against a plain BM25 search over all documents of a shard."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from metframe.llm import packing


def plain_scores(documents: list[list[int]], query: list[int]) -> list[float]:
    count, mean = len(documents), max(sum(map(len, documents)) / len(documents), 1)
    df = Counter(t for d in documents for t in set(d))
    out = []
    for d in documents:
        tf, norm = Counter(d), packing.K1 * (1 - packing.B + packing.B * len(d) / mean)
        out.append(sum(
            math.log1p((count - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (packing.K1 + 1) / (tf[t] + norm)
            for t in sorted(set(query)) if tf[t]
        ))
    return out


def plain_windows(documents: list[list[int]], window: int) -> list[tuple[int, int, int]]:
    """(document, start, length) in order: the best unused neighbour follows, until a rest opens a window of its own."""
    terms, unused, out, used = [d[:-1] for d in documents], set(range(len(documents))), [], 0
    order: list[int] = []
    while unused:
        order = [d for d in order if d in unused]
        seed = order.pop(0) if order else min(unused)
        unused.discard(seed)
        start, opened, size = 0, False, len(documents[seed])
        while start < size:
            opened, taken = not used, min(window - used, size - start)
            out.append((seed, start, taken))
            start, used = start + taken, (used + taken) % window
            opened = opened and used > 0
        if opened or not [d for d in order if d in unused]:
            query = documents[seed][-out[-1][2] :] if opened else documents[seed]
            scores = plain_scores(terms, query)
            order = sorted((d for d in unused if scores[d] > 0), key=lambda d: (-scores[d], d))
    return out


def random_documents(rng: random.Random, count: int, longest: int, kinds: int) -> list[list[int]]:
    """Documents of few topics, with very common terms, copies and empty ones; all end with id 1."""
    out = []
    for _ in range(count):
        topic = rng.randrange(4) * kinds
        body = [rng.choice([rng.randint(2, 5), 10 + topic + rng.randrange(kinds), 10 + rng.randrange(4 * kinds)]) for _ in range(rng.randint(0, longest))]
        out.append([*body, 1])
        if rng.random() < 0.1:
            out.append(out[rng.randrange(len(out))])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_ranking_equals_plain_bm25(seed):
    rng = random.Random(seed)
    documents = [d[:-1] for d in random_documents(rng, 120, 40, 30)]
    index, unused = packing.Index([np.array(d, np.uint32) for d in documents]), np.ones(len(documents), bool)
    for step in range(60):  # the index leaves used documents out as it goes
        query = documents[rng.randrange(len(documents))]
        found, want = index.neighbours(np.array(query, np.uint32), unused), plain_scores(documents, query)
        assert set(found) == {d for d, s in enumerate(want) if s > 0 and unused[d]}
        assert all(want[a] >= want[b] * (1 - 1e-5) for a, b in zip(found, found[1:]))
        unused[rng.sample(range(len(documents)), 2)] = False


@pytest.mark.parametrize("seed", range(6))
def test_windows_equal_plain_filling(seed):
    rng = random.Random(100 + seed)
    documents = random_documents(rng, 80, 60, 25)
    packer = packing.Packer(0, window=64)
    packer.shard(list(range(len(documents))), [np.array(d, np.uint32) for d in documents])
    done = [(key, start, len(ids)) for key, start, ids, *_ in packer.pieces] + [(key, start, len(ids)) for key, start, ids, _ in packer._open]
    assert done == plain_windows(documents, 64)
    packer.finish()
    by_document: dict[int, list[int]] = {}
    for key, start, ids, *_ in sorted(packer.pieces, key=lambda p: p[:2]):
        assert len(by_document.setdefault(key, [])) == start
        by_document[key] += ids.tolist()
    assert by_document == dict(enumerate(documents))


def test_empty_shards():
    packer = packing.Packer(0)
    packer.shard([], [])
    packer.shard(["a", "b"], [np.array([1], np.uint32)] * 2)
    packer.finish()
    assert [(p[0], p[1], p[4], p[5]) for p in packer.pieces] == [("a", 0, 0, 0), ("b", 0, 0, 1)]
