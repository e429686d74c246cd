"""Operators over whole corpora against brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import collections
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metframe.llm import ann, common, decontaminate, lm, minmax, packing, toxicity
from metframe.llm.tokens import ByteBpe

DOCUMENTS = "doc_id long, text string, n int, component string, score double, item string"


def frame(spark, texts, ids=None):
    """Documents with columns whose names operators use themselves."""
    rows = [(ids[i] if ids else i, t, 1, "x", 0.5, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.triangular(0, vocabulary, 0))}" for _ in range(n))


# near duplicates


def linked(sets, percent):
    """Components by comparing all pairs."""
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            one, two = sets[a], sets[b]
            if one and two and 100 * len(one & two) >= percent * len(one | two):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def plain_shingles(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def copies(rng):
    """Texts with groups of exact, near and chained copies, short texts and texts whose centre isn't the first."""
    texts = [None, "", " \n", "one", "One", "one two", "one two three", "é a", "É a"]
    for group in range(6):
        words = prose(rng, 120, 5000).split()
        for _ in range(12):
            some = list(words)
            for _ in range(rng.randint(0, 9)):
                some[rng.randrange(len(some))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(some))
        texts += [texts[-1], " ".join(words)]
    step = prose(rng, 80, 5000).split()
    for i in range(12):  # a chain: neighbours are linked, ends are not
        step = [*step[4:], *(f"c{i}-{j}" for j in range(4))]
        texts.append(" ".join(step))
    return texts + [prose(rng, 60) for _ in range(60)]


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_are_those_of_all_pairs(spark, n):
    rng = random.Random(n)
    texts = copies(rng)
    rng.shuffle(texts)
    found = minmax.near_duplicates(frame(spark, texts), words=n).collect()
    sets = {i: plain_shingles(t, n) for i, t in enumerate(texts)}
    want = linked(sets, 80)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in found)


def test_near_duplicates_of_odd_tables(spark):
    assert minmax.near_duplicates(frame(spark, []).limit(0)).count() == 0
    rows = frame(spark, ["a b c", "a b c", "a b c", None, "a b c"], [5, None, 5, 7, 9])
    found = sorted(map(str, (tuple(r) for r in minmax.near_duplicates(rows, words=2).collect())))
    assert found == sorted(map(str, [(5, 2, 5, True), (5, 2, 5, True), (None, 2, None, True), (7, 0, 7, True), (9, 2, 5, False)]))


def test_texts_of_one_id_are_judged_one_by_one(spark):
    one, two, other = "a b c d e f g", "t u v w x y z", "k l m n o p q"
    rows = frame(spark, [one, one, two, two, two, other, None, other], [3, 5, 5, 5, 9, 9, 5, 11])
    found = sorted(map(str, (tuple(r) for r in minmax.near_duplicates(rows, words=2).collect())))
    want = [(3, 6, 3, True), (5, 6, 3, False), (5, 6, 3, True), (5, 6, 3, True), (9, 6, 3, False), (9, 6, 3, True), (5, 0, 3, True), (11, 6, 3, False)]
    assert found == sorted(map(str, want))
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(3, one), (5, two), (5, None), (9, other)]))
    alone = frame(spark, [one, two, one], [5, 5, None])
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, alone, "").collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(5, one), (5, two), (None, one)]))


def test_lower_thresholds_have_their_own_bands_and_sketch_limit(spark):
    assert (minmax.rows_of_band(80), minmax.sketch_limit(80)) == (minmax.ROWS, minmax.SKETCH_LIMIT)
    texts = []
    for i in range(60):
        words = [f"v{i}x{j}" for j in range(160)]
        texts += [" ".join(words[:120]), " ".join(words[:80] + words[120:])]
    found = minmax.near_duplicates(frame(spark, texts), words=1, percent=50).collect()
    assert sum(not r["kept"] for r in found) == 60 and {r["component_id"] for r in found} == set(range(0, 120, 2))
    with pytest.raises(ValueError, match="too low"):
        minmax.near_duplicates(frame(spark, texts), percent=1)


def test_what_star_rounds_leave_is_compared(spark, monkeypatch):
    monkeypatch.setattr(minmax, "STAR_ROUNDS", 1)
    texts = copies(random.Random(9))
    found = minmax.near_duplicates(frame(spark, texts), words=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == linked({i: plain_shingles(t, 2) for i, t in enumerate(texts)}, 80)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    a, b = minmax.signature(np.r_[both, one]), minmax.signature(np.r_[both, two])
    assert abs((a == b).mean() - 0.8) < 0.1


# decontamination


def test_tiles_find_exact_partial_and_reordered_items(spark):
    rng = random.Random(4)
    items = [prose(rng, 40, 9000) for _ in range(30)] + ["too short", None, ""]
    words = [i.split() for i in items[:30]]
    clean = [prose(rng, 300, 9000) for _ in range(40)]
    planted = {
        0: clean[0] + " " + items[0] + " " + clean[1], 1: items[1].upper() + ".", 2: " ".join(words[2][20:] + clean[2].split()[:5] + words[2][:20]),
        3: " ".join(words[3][:25]), 4: " ".join(words[4][:10] + clean[3].split()[:50]), 5: (items[5] + " \n") * 400,
    }
    docs = frame(spark, [*planted.values(), *clean, None, "", planted[0]])
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 5), (len(planted) + 42, 0)}
    assert found[2, 2]["covered_words"] == 40 and len(found[2, 2]["tiles"]) == 2 and found[3, 3]["covered_words"] == 25
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench, block_bytes=500).collect()}
    assert blocks == set(found)
    kept = decontaminate.without_leaks(docs, bench, block_bytes=500)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, *range(6, 48)]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_leak_into_texts_of_the_same_words(spark):
    bench = spark.createDataFrame([(0, "Who is it?"), (1, "yes"), (2, None), (3, ""), (4, "who is it"), (5, "one two three four five")], "item_id long, text string")
    docs = frame(spark, ["who is it", "who is it now", "Yes.", "yes yes", None, "", "is it who", "one two three four five", "one two three four"])
    for some in (bench, bench.where("item_id < 5")):
        found = {(r["doc_id"], r["item_id"]): (r["item_words"], r["coverage"], [tuple(t) for t in r["tiles"]]) for r in decontaminate.leaks(docs, some).collect()}
        long_one = {(7, 5): (5, 1.0, [(0, 0, 5)])} if some is bench else {}
        assert found == {(0, 0): (3, 1.0, [(0, 0, 3)]), (0, 4): (3, 1.0, [(0, 0, 3)]), (2, 1): (1, 1.0, [(0, 0, 1)])} | long_one
        left = {1, 3, 4, 5, 6, 8} | (set() if long_one else {7})
        assert {r["doc_id"] for r in decontaminate.without_leaks(docs, some).collect()} == left


def test_tiles_are_longest_first_and_do_not_overlap():
    tiling = decontaminate.Tiling(["a b c d e f g h i j k l"], min_tile=3, coverage=0.1)
    leak = tiling.leaks("x a b c d e y d e f g h i j k l z")[0]
    assert leak.tiles == [(3, 7, 9), (0, 1, 3)] and leak.coverage == 1.0


# nearest neighbours


def test_neighbours_reach_the_recall_and_exact_scores(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(4000, 24)) * rng.uniform(0.5, 2, size=(4000, 1))
    points[100:900] = points[100]  # a third of all rows is nearly one vector
    rows = [(i, v.tolist(), 1) for i, v in enumerate(points)]
    rows += [(5000, None, 1), (5020, [0.0] * 24, 1), (5040, [float("nan")] * 24, 1), (5060, [1.0, None] * 12, 1), (5080, [1.0] * 5, 1), (None, [1.0] * 24, 1), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = ann.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    by_query = collections.defaultdict(dict)
    for r in found:
        by_query[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert set(by_query) == set(range(0, 4000, 20))
    hits = 0
    for query, got in by_query.items():
        assert sorted(got) == list(range(1, 21))
        order = [got[i] for i in range(1, 21)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0])) and len({v for v, _ in order}) == 20
        scores = points @ points[query]
        assert all(abs(scores[v] - s) < 1e-9 for v, s in order)
        scores[query] = -np.inf
        kth = np.sort(scores)[-20]
        hits += sum(scores[v] >= kth - 1e-9 for v, _ in order)
    assert hits >= 0.9 * 20 * len(by_query)
    small = ann.search(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in sorted(small, key=lambda r: r["rank"])] == [1, 2]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_queries_in_blocks_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(500, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    once = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect()))
    monkeypatch.setattr(ann, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect())) == once


# packing and tokens


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "Bé", "ß", "1", ".", "'s", "<|endoftext|>", "　", "\xa0", "日", "😀", "\r\n", " the", " \n", "\n "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + [None, ""]
    ids, bounds = ByteBpe().batch(pa.array(texts, pa.string()))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing_holds_each_id_once_without_padding(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 20, 300, 6000])) for _ in range(120)] + [None, ""]
    df = frame(spark, texts).unionByName(frame(spark, ["again", "again"], [999, 999])).repartition(3)
    pieces = packing.pack(df, shard_tokens=50_000).collect()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        mine = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in mine]).tolist()
        assert ids == [*own.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(p["doc_tokens"] == len(ids) and p["length"] * 4 == len(p["ids"]) for p in mine)
        assert [p["start"] for p in mine] == [0, *np.cumsum([p["length"] for p in mine])[:-1].tolist()]
    assert sum(p["doc_id"] == 999 for p in pieces) >= 2
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1].tolist()]
        assert sum(n for _, n in held) in {1 << i for i in range(12)}
    assert packing.pack(df.limit(0)).count() == 0


def test_neighbours_share_rare_terms():
    index = packing.Index([np.array(x) for x in ([1, 2, 3, 9], [1, 5, 6], [2, 3, 9, 9], [1, 7, 7], [4])])
    unused = np.ones(5, bool)
    unused[[0, 4]] = False
    assert index.neighbours(np.array([1, 2, 3, 9]), unused)[0] == 2
    assert index.neighbours(np.array([4]), unused) == []


# language model


def test_base_scores_are_exact_and_the_filter_never_undercounts(spark, monkeypatch):
    rng = random.Random(3)
    phrases = [prose(rng, 6) for _ in range(60)]
    texts = [None, "", "A a b", "\u3000x"] + [" ".join(rng.choices(phrases, k=rng.randint(1, 30))) for _ in range(150)]
    texts += [texts[9], texts[9]] + [prose(rng, 900, 100_000) for _ in range(120)]
    df = frame(spark, texts)
    train = df.where("doc_id % 3 != 0")
    tokens = [[w.decode() for w in common.spaced_words(t)] + [""] for t in texts]
    held = collections.Counter(w for i, ws in enumerate(tokens) if i % 3 for w in ws)
    n, v = sum(held.values()), len(held)
    model = lm.fit(train)
    assert (model.tokens, model.vocabulary) == (n, v)
    found = {r["doc_id"]: r for r in lm.score(df, model).collect()}
    for i, words in enumerate(tokens):
        got = found[i]
        assert (got["n_tokens"], got["n_known"]) == (len(words), sum(held[w] > 0 for w in words))
        assert math.isclose(got["base_score"], sum(math.log10((held[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
    unseen = [found[i] for i in range(0, 150, 3)]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)
    monkeypatch.setattr(lm, "SEGMENT_BYTES", 1 << 16)
    many = lm.fit(train)
    assert many.count // many.per_segment > 1
    again = {r["doc_id"]: r for r in lm.score(df, many).collect()}
    assert len(again) == len(texts)
    assert all(math.isclose(again[i]["base_score"], found[i]["base_score"], rel_tol=1e-9) and again[i]["n_known"] == found[i]["n_known"] for i in found)
    empty = lm.fit(df.limit(0))
    assert all(r["score"] == 0 and r["base_score"] == 0 for r in lm.score(df, empty).collect()) and lm.score(df.limit(0), model).count() == 0


def plain_scores(texts: list[str | None], train: list[str | None], order: int) -> list[float]:
    """Scores token by token, from counts that are quantised but not looked up in a filter."""
    def tokens_of(text):
        return [w.decode() for w in common.spaced_words(text)] + ["<end>"]

    held = collections.Counter()
    for text in train:
        row = ["<end>", *tokens_of(text)]
        held.update(row[1:])
        held.update(tuple(row[i - n + 1 : i + 1]) for i in range(1, len(row)) for n in range(2, order + 1) if i >= n - 1)
    total, words = sum(c for k, c in held.items() if isinstance(k, str)), sum(isinstance(k, str) for k in held)

    def count(gram):
        key = gram[0] if len(gram) == 1 else tuple(gram)
        own = lm.VALUES[int(lm.levels_of(np.array([held[key]]))[0])] if held[key] else 0.0
        return own if len(gram) == 1 else min(own, count(gram[1:]), count(gram[:-1]))

    def p(gram):
        if len(gram) == 1:
            return (count(gram) + 1) / (total + words + 1)
        return (count(gram) + lm.MU * p(gram[1:])) / (count(gram[:-1]) + lm.MU)

    rows = [["<end>", *tokens_of(text)] for text in texts]
    return [sum(math.log10(p(row[max(0, i - order + 1) : i + 1])) for i in range(1, len(row))) for row in rows]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_ones_at_every_order_and_over_several_segments(spark, monkeypatch, order):
    rng = random.Random(order)
    phrases = [prose(rng, 5) for _ in range(12)]
    texts = [None, "", "a", "A b", " ".join(["x"] * 4000)] + [" ".join(rng.choices(phrases, k=rng.randint(1, 12))) for _ in range(60)]
    texts += [prose(rng, 300) for _ in range(20)] + [texts[8], texts[8]]
    df = frame(spark, texts)
    expected = plain_scores(texts, [t for i, t in enumerate(texts) if i % 3], order)
    # so many bits that no n-gram is found by chance
    monkeypatch.setattr(lm, "BITS", 1000)
    for size in (lm.SEGMENT_BYTES, 1 << 18):
        monkeypatch.setattr(lm, "SEGMENT_BYTES", size)
        model = lm.fit(df.where("doc_id % 3 != 0"), order=order)
        found = {r["doc_id"]: r["score"] for r in lm.score(df, model).collect()}
        assert len(found) == len(texts)
        assert all(math.isclose(found[i], e, rel_tol=1e-9) for i, e in enumerate(expected))
    assert order == 1 or len([*model.segments()]) > 1


def test_counts_need_one_shuffle(spark):
    plan = lm.counts(frame(spark, ["a b", None]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1


def test_levels_come_back_from_the_filter(spark):
    rng = np.random.default_rng(5)
    counts = np.minimum(rng.zipf(1.5, 20000), 10**6)
    gram = np.sort(rng.integers(-(2**63), 2**63 - 1, 20000))
    counted = spark.createDataFrame(list(zip(gram.tolist(), counts.tolist())), "gram long, n long").coalesce(1).sortWithinPartitions("gram")
    slices = -(-int(lm.levels_of(counts).sum()) * lm.BITS // (1 << lm.SLICE_BITS))
    model = lm.Model(lm.filter_slices(counted, slices).cache(), slices, slices, 0, 0)
    pieces = [*model.pieces(0, slices)]
    found = np.sort(gram.view(np.uint64))
    counts = counts[np.argsort(gram.view(np.uint64), kind="stable")]
    levels, true = lm._looked_up(found, pieces, lm.Piece.levels, np.uint8), lm.levels_of(counts)
    assert (levels >= true).all() and (levels == true).mean() > 0.9
    absent = lm._looked_up(np.sort(rng.integers(0, 2**63, 20000).astype(np.uint64)), pieces, lm.Piece.levels, np.uint8)
    assert (absent > 0).mean() < 0.06


# toxicity


def labelled(rng, n):
    rude = ["grubnok", "vilsnert", "drozzle", "fopwit"]
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(20, 150), 3000).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "s", "ish"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxic_texts_are_told_apart(spark):
    rows = labelled(random.Random(6), 1500)
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, rows[0][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 5), (2, None), (None, 1)], "doc_id long, toxic int")
    seen = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = toxicity.fit(df, seen)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [(found[i] >= toxicity.THRESHOLD, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == y for p, y in held]) > 0.97 and found[9000] == found[9001] < 0.3 and all(0 <= s <= 1 for s in found.values())
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(s < toxicity.THRESHOLD for s in found.values())
    nothing = toxicity.fit(df, labels.limit(0))
    assert {r["score"] for r in toxicity.score(df, nothing).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0


@pytest.mark.parametrize(("toxic", "ordinary"), [(40, 0), (100, 3), (3, 1)])
def test_too_few_texts_of_a_class_reject_nothing(spark, toxic, ordinary):
    texts = [prose(random.Random(i), 20) for i in range(toxic + ordinary)] + [None, ""]
    df = frame(spark, texts)
    model = toxicity.fit(df, spark.createDataFrame([(i, int(i < toxic)) for i in range(toxic + ordinary)], "doc_id long, toxic int"))
    assert toxicity.without_toxic(df, model).count() == toxicity.without_toxic(df, model, threshold=0.1).count() == len(texts)
    assert all(0 <= r["score"] < toxicity.THRESHOLD for r in toxicity.score(df, model).collect())


def test_samples_are_drawn_from_labels_with_usable_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda toxic, ordinary: (len(toxic), len(ordinary)))
    usable = [(i, "some words") for i in range(40)]
    df = spark.createDataFrame([*usable, *((i, None if i % 3 else "long " * 50) for i in range(40, 400))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    assert toxicity.fit(df, labels, sample_rows=15, sample_chars=100) == (15, 15)
    assert toxicity.fit(df, labels, sample_rows=50, sample_chars=100) == (20, 20)


def test_one_row_stays_of_each_id(spark):
    df = spark.createDataFrame([(1, "b", {"k": 1}), (1, "a", {"k": 2}), (2, "c", None), (None, "d", None), (None, "d", None)], "id long, t string, m map<string, int>")
    kept = common.one_row_per_id(df, "id")
    assert kept.columns == df.columns
    assert sorted(((r["id"] or 0), r["t"]) for r in kept.collect()) == [(0, "d"), (0, "d"), (1, "a"), (2, "c")]
