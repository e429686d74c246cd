"""The Jaccard join against all pairs, and its R-tree against plain bounds."""

from __future__ import annotations

import random

import numpy as np
import pytest

from metframe.llm import rtree
from tests.llm.test_corpus_operators import copies, frame, linked, plain_shingles, prose


def classes(found):
    return {r["doc_id"]: r["component_id"] for r in found.collect()}


@pytest.mark.parametrize("words", [2, 5])
def test_classes_are_those_of_all_pairs(spark, words):
    texts = copies(random.Random(words))
    found = rtree.near_classes(frame(spark, texts), words=words)
    sets = {i: plain_shingles(t, words) for i, t in enumerate(texts)}
    assert classes(found) == linked(sets, 80)
    assert {r["doc_id"]: r["n_shingles"] for r in found.collect()} == {i: len(s) for i, s in sets.items()}


def test_large_groups_pass_through_heads_and_blocks(spark, monkeypatch):
    """Copies of copies, so that many are near each other and not their head, in blocks of a few nodes."""
    monkeypatch.setattr(rtree, "BLOCK_NODES", 7)
    monkeypatch.setattr(rtree, "HOT_NODES", 4)
    rng = random.Random(8)
    texts, word = [], prose(rng, 90, 5000).split()
    for i in range(120):
        base = texts[rng.randrange(len(texts))].split() if texts and rng.random() < 0.8 else word
        base = list(base)
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(base))
    shared = " ".join(f"s{i}" for i in range(40))  # a passage that unlike texts share
    texts += [f"{shared} {prose(rng, 60, 90000)}" for _ in range(60)]
    sets = {i: plain_shingles(t, 5) for i, t in enumerate(texts)}
    want = linked(sets, 80)
    assert 5 < len(set(want.values())) - 60 < 100
    assert classes(rtree.near_classes(frame(spark, texts))) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "one two"), (None, "one two"), (4, "ONE\ttwo"), (5, long), (6, long + " more"), (7, "a b c d e f"), (7, long), (7, long), (8, "a b c d e f")]
    found = rtree.near_classes(spark.createDataFrame([(d, t, 5, "n") for d, t in rows], "doc_id int, text string, node int, n string"))
    assert sorted((r[0] or 0, r[1], r[2] or 0) for r in found.collect()) == [
        (0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 29_996, 5), (6, 29_997, 5), (7, 2, 5), (7, 29_996, 5), (7, 29_996, 5), (8, 2, 5),
    ]
    assert rtree.near_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tree_leaves_what_the_bound_leaves():
    rng = np.random.default_rng(4)
    points = rng.poisson(2, (400, 16))
    points[200:] = np.maximum(points[:200] + rng.integers(-1, 2, (200, 16)) * (rng.random((200, 16)) < 0.1), 0)
    sizes, comps = points.sum(axis=1), rng.integers(0, 40, 400)
    one, two = rtree.RTree(points, sizes, comps).reach(points, sizes, comps, 80)
    common = np.minimum(points[:, None], points[None]).sum(axis=2)
    allowed = 100 * common >= 80 * (sizes[:, None] + sizes[None] - common)
    allowed &= comps[:, None] != comps[None]
    assert set(zip(one.tolist(), two.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(allowed))))


def test_sets_of_any_size_have_a_point():
    assert [len(rtree.point_of(np.arange(n, dtype=np.uint64))) for n in (1, 2, 31, 32, 64)] == [16, 16, 16, 32, 64]


def test_bound_is_never_below_what_sets_share():
    rng = np.random.default_rng(6)
    for _ in range(50):
        one = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        two = np.unique(np.r_[one[rng.random(len(one)) < 0.9], rng.integers(0, 2**63, 20).astype(np.uint64)])
        a, b = rtree.point_of(one), rtree.point_of(two)
        count = min(len(a), len(b))
        assert np.minimum(rtree.folded(a, count), rtree.folded(b, count)).sum() >= len(np.intersect1d(one, two))


@pytest.mark.parametrize("percent", [50, 80])
def test_rows_with_a_partner_are_those_of_all_pairs(percent):
    rng = np.random.default_rng(percent)
    tokens = np.sort(rng.integers(0, 150, 600))
    sizes = rng.integers(1, 60, 600)
    order = np.lexsort((sizes, tokens))
    tokens, sizes = tokens[order], sizes[order]
    places = (rng.random(600) * (sizes - -(-sizes * percent // 100) + 1)).astype(np.int64)
    left = sizes - places
    may = 100 * np.minimum(left[:, None], left) + percent * np.minimum(left[:, None], left) >= percent * (sizes[:, None] + sizes)
    may &= (tokens[:, None] == tokens) & ~np.eye(600, dtype=bool)
    assert rtree.partnered(tokens, sizes, places, percent).tolist() == may.any(axis=1).tolist()
    assert 100 < may.any(axis=1).sum() < 600


def test_pairs_come_out_of_their_first_shard():
    lists = [[], [5], [5, 7], [7, 9], [9], [1, 2, 5]]
    starts, earlier = np.cumsum([0, *map(len, lists)]), np.array([x for row in lists for x in row])
    one, two = (np.ravel(x) for x in np.meshgrid(range(6), range(6)))
    assert rtree.unseen(one, two, starts, earlier).tolist() == [not set(lists[a]) & set(lists[b]) for a, b in zip(one, two)]


def test_a_pair_that_meets_in_many_shards_is_asked_for_once(spark, monkeypatch):
    """Copies of one text with words of their own; texts that share a passage but are of unlike sizes are left out before the trees."""
    rng = random.Random(3)
    base = prose(rng, 120, 5000).split()
    texts = []
    for _ in range(40):
        mine = list(base)
        for at in rng.sample(range(120), rng.randint(1, 2)):
            mine[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(mine))
    passage = " ".join(f"s{i}" for i in range(40))
    texts += [f"{passage} {prose(rng, 90 * 2**i, 90000)}" for i in range(4)]
    seen, dealt, plain = [], [], rtree._joined

    def joined(rows, percent):
        dealt.extend(r["n"] for r in rows.select("n").collect())
        seen.append([tuple(r) for r in plain(rows, percent).collect()])
        return plain(rows, percent)

    monkeypatch.setattr(rtree, "_joined", joined)
    monkeypatch.setattr(rtree, "HOT_NODES", 10**6)  # no heads: all pairs are left to the trees
    monkeypatch.setattr(rtree, "HELD_ROWS", 8)
    sets = {i: plain_shingles(t, 5) for i, t in enumerate(texts)}
    assert classes(rtree.near_classes(frame(spark, texts))) == linked(sets, 80)
    assert len(seen[0]) == len(set(seen[0])) <= 40 * 39 // 2
    assert max(dealt) <= 120
    near = sum(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in range(40) for b in range(a))
    assert len(seen[0]) >= near > 0
