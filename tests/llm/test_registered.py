"""Registered queries against their SQL twins, the pipeline against its parts, and what the checks of all of them need."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from metframe.llm import common, decontaminate, minmax, toxicity
from metframe.llm.queries import QUERIES
from tests.llm.test_corpus_operators import linked, plain_shingles
from tests.oracle import mismatch

SF_DIR = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return spark.read.parquet(f"{SF_DIR}/{name}.parquet").collect()


def run(spark, name):
    return entry_point.queries()[name](spark, SF_DIR)


@pytest.mark.parametrize("query", [q for q in QUERIES if q.sql], ids=lambda q: q.name)
def test_query_matches_sql(spark, query):
    assert mismatch(query.run(spark, SF_DIR), query.sql, SF_DIR) is None


def test_every_operator_is_registered():
    names = [*entry_point.queries()]
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_op3_finds_the_items_that_lie_in_texts(spark):
    items = {r["item_id"]: b" ".join(common.plain_words(r["text"])) for r in rows_of(spark, "benchmark")}
    found = {(r["doc_id"], r["item_id"]) for r in run(spark, "op3_decontaminate").collect()}
    whole = {
        (d["doc_id"], item) for d in rows_of(spark, "documents") for item, words in items.items()
        if b" " + words + b" " in b" " + b" ".join(common.plain_words(d["text"])) + b" "
    }
    assert whole and whole <= found


def test_op4_reaches_the_recall(spark):
    rows = sorted(rows_of(spark, "embeddings"), key=lambda r: r["vec_id"])
    points, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    found = run(spark, "op4_ann").collect()
    hits, queries = 0, np.flatnonzero(ids % 20 == 0)
    for at in queries:
        scores = points @ points[at]
        scores[at] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits += len(best & {r["vec_id"] for r in found if r["query_id"] == ids[at]})
    assert len(found) == 20 * len(queries) and hits >= 0.9 * len(found)


def test_op5_is_that_of_all_pairs(spark):
    sets = {r["doc_id"]: plain_shingles(r["text"], 2) for r in rows_of(spark, "documents")}
    assert {r["doc_id"]: r["component_id"] for r in run(spark, "op5_minmax").collect()} == linked(sets, 80)


def test_op6_pads_nothing(spark):
    pieces = run(spark, "op6_packing").collect()
    lengths: dict[int, int] = {}
    for p in pieces:
        lengths[p["sequence_id"]] = lengths.get(p["sequence_id"], 0) + p["length"]
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in rows_of(spark, "documents")}
    assert all(n & (n - 1) == 0 and n <= 2048 for n in lengths.values())


def test_op7_base_scores(spark):
    texts = {r["doc_id"]: [*common.spaced_words(r["text"]), b""] for r in rows_of(spark, "documents")}
    held_out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    counts: dict[bytes, int] = {}
    for d, words in texts.items():
        for word in words if not held_out[d] else ():
            counts[word] = counts.get(word, 0) + 1
    total = sum(counts.values())
    for r in run(spark, "op7_lm").collect():
        words = texts[r["doc_id"]]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in words)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["train_tokens"] == total and r["held_out"] == held_out[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(w in counts for w in words)) and r["score"] < 0


def test_op8_scores_every_document(spark):
    found = run(spark, "op8_toxicity").collect()
    assert {r["doc_id"] for r in found} == {r["doc_id"] for r in rows_of(spark, "documents")}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)


def test_op9_turns_come_back(spark):
    turns: dict[int, list] = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows_of(spark, "conversations"):
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    found = {r["conv_id"]: r for r in run(spark, "op9_chat").collect()}
    assert set(found) == set(turns)
    for conv, held in turns.items():
        held.sort()
        said = "".join(t for _, r, t in held if r == "assistant")
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in held).encode()).hexdigest()
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_pipeline_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = spark.createDataFrame([(900001, None), (900002, ""), (None, None), (900003, "one one one"), (900003, "one one one")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near_duplicates", "decontamination", "packing"]

    calm = stages["toxicity"](spark, docs, SF_DIR).cache()
    assert calm.columns == docs.columns and calm.where("doc_id > 900000 OR doc_id IS NULL").count() == 5
    labels = {r["doc_id"]: r["toxic"] for r in rows_of(spark, "labels")}
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in calm.collect()}
    assert sum(labels.get(d) == 0 for d in gone) <= 0.1 * len(labels)

    single = stages["near_duplicates"](spark, calm, SF_DIR).cache()
    sets = {r["doc_id"]: plain_shingles(r["text"], 5) for r in calm.collect() if r["doc_id"] is not None}
    want = sorted(d for d, c in linked(sets, 80).items() if d == c)
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.where("doc_id IS NOT NULL").collect()) == want
    assert single.where("doc_id IS NULL").count() == 1

    clean = stages["decontamination"](spark, single, SF_DIR).cache()
    tiling = decontaminate.Tiling([r["text"] for r in rows_of(spark, "benchmark")])
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not tiling.leaks(r["text"])}

    pieces = stages["packing"](spark, clean, SF_DIR).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in clean.collect()}
    assert all(f(spark, docs.limit(0), SF_DIR).count() == 0 for _, f in corpus_pipeline.STAGES)


def test_pipeline_runs_its_stages_in_order(spark):
    assert run(spark, "pipeline").columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]


def test_limits_are_those_of_the_contracts():
    assert (toxicity.THRESHOLD, decontaminate.MIN_TILE) == (0.3, 5)
    assert (1 - 0.8**minmax.ROWS) ** minmax.BANDS < 1e-6
