"""Alignment of two tokenizers against a plain version that walks their own libraries' tokens."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from metframe.llm import alignment
from metframe.llm.tokens import ByteBpe

ODD = "ab c  é\xa0\t\n▁日本語 ,.'s0179<|endoftext|></s> \x1c​𝒳ﬁ\x00\x85"


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_letters():
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranges(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends], ends))


def plain(texts, one, two):
    """What the operator returns, token by token."""
    letters, counts, kept = byte_letters(), collections.Counter(), []
    for text in texts:
        a, b = one.encode(f" {text or ''}", add_special_tokens=False).ids, two.encode(text or "")
        spelt_a = [bytes(letters[c] for c in one.id_to_token(i)) for i in a]
        pieces = [two.id_to_piece(i) for i in b]
        spelt_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        said = f" {text or ''}".encode()
        if not text or b"".join(spelt_a) != said or b"".join(spelt_b) != said:
            kept.append(None)
            continue
        at_a, at_b = ranges(spelt_a), ranges(spelt_b)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(at_a) for j, (t, f) in enumerate(at_b) if s < f and t < e]
        groups, start = [], 0
        for cut in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            sides = [",".join(str(x) for x, (_, e) in zip(ids, at) if start < e <= cut) for ids, at in ((a, at_a), (b, at_b))]
            groups.append("|".join(sides))
            start = cut
        counts.update(links)
        kept.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if k is None
        else (*k[:3], len(k[3]), sum(counts[x] == best[x[1]] for x in k[3]), sum(counts[x] for x in k[3]), k[4]) for k in kept
    ]


def test_alignment_is_that_of_all_tokens(spark, libraries):
    rng = random.Random(5)
    texts = [None, "", " ", "▁", " a", "a ", "a  b", "</s> <0x41> <|endoftext|>", "word" * 300, "a b", "a b"]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts += [" ".join("".join(rng.choice("abcdeéü日.") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(40)]
    rows = [(i, t, 1, 2, "x") for i, t in enumerate(texts)]
    found = alignment.align(spark.createDataFrame(rows, "doc_id long, text string, n_a int, block int, pair string")).collect()
    assert [tuple(r)[1:] for r in sorted(found)] == plain(texts, *libraries)


def test_long_texts_ids_and_empty_tables(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 1000)
    long = " ".join(f"word{i * i}" for i in range(5000))
    texts = [long, long, "one two", "x" * 5000]
    frame = spark.createDataFrame([("b", long), (None, long), ("a", "one two"), ("c", "x" * 5000)], "name string, said string")
    found = {r["name"]: tuple(r)[1:] for r in alignment.align(frame, "name", "said").collect()}
    assert [found[k] for k in ("b", None, "a", "c")] == plain(texts, *libraries)
    assert alignment.align(frame.limit(0), "name", "said").collect() == []
    with pytest.raises(ValueError):
        alignment.align(frame)


def test_cuts_are_found_in_any_interval():
    rng = np.random.default_rng(3)
    for _ in range(300):
        size = rng.integers(1, 60)
        one, two = (np.unique(np.r_[rng.choice(size, rng.integers(0, size)), size]) for _ in range(2))
        cut = alignment.shared_cuts(one, two, np.array([0]), np.array([len(one) - 1]))
        assert one[cut].tolist() == sorted(set(one.tolist()) & set(two.tolist()))


def test_byte_ids_with_any_white_space(libraries):
    """Ids of texts of all kinds of white space equal the tokenizer's own, with and without special tokens."""
    rng = random.Random(9)
    spaces = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0        　​"
    texts = ["a \xa0 \xa0", "", "<|endoftext|>", "a <|endoftext|> b"]
    texts += ["".join(rng.choice(spaces + "ab 1.") for _ in range(rng.randint(1, 12))) for _ in range(100_000)]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for special, library in ((True, own), (False, libraries[0])):
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        ids, of = ByteBpe(special=special).batch(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(of[:-1], of[1:])] == want


def test_rows_hold_one_text_or_a_run_of_pairs(spark, libraries):
    """No row grows with its block; counts of a block that come in several runs reach its texts."""
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(40)) for _ in range(60)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").coalesce(1)
    found = alignment.blocks(rows).collect()
    sides = [r for r in found if r["run"] is None]
    assert sorted(r["doc"] for r in sides) == [*range(62)] and len({r["block"] for r in found}) == 1
    pairs = [r for r in found if r["run"] is not None]
    assert len(pairs) > 1 and [r["run"] for r in pairs] == [*range(len(pairs))]
    assert {len(r["pair"]) for r in pairs[:-1]} == {alignment.RUN} and len(pairs[-1]["pair"]) <= alignment.RUN
    out = alignment.align(rows, "doc").collect()
    assert [tuple(r)[1:] for r in sorted(out)] == plain(texts, *libraries)
