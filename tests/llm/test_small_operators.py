"""Operators whose rules are checked against plain statements of them: urls, chats, licences, archives."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from metframe.llm import chat, licenses, urls, warc
from metframe.session import materialize

RULES = [
    urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"),
    urls.Rule("block", "net", "/es/"),
]


def test_url_rules_and_vocabulary(spark):
    rows = {
        1: ("http://a.example.com/en/x", "block", "example.com/en/"), 2: ("http://www.example.com/en/x", "allow", "www.example.com/en/"),
        3: ("HTTP://A.COM/q?casino", "allow", "com/"), 4: ("http://a.net/es/", "block", "net/es/"), 5: ("http://a.net/ES/", "allow", None),
        6: ("http://casino.org/", "block", None), 7: ("http://casinoville.org/", "allow", None), 8: ("http://free.org/cheap", "block", None),
        9: ("http://free.org/free", "allow", None), 10: (None, "allow", None), 11: ("no scheme, xxx", "block", None), 12: ("http://com", "allow", None),
        13: ("http://notexample.com/en/", "allow", "com/"), 14: ("", "allow", None), 15: ("http://é-sex-é.org", "block", None),
    }
    df = spark.createDataFrame([(k, u, "x") for k, (u, _, _) in rows.items()], "page_id long, url string, host string")
    found = {r["page_id"]: r for r in urls.judge_urls(df, RULES).collect()}
    assert {k: (r["verdict"], r["rule"]) for k, r in found.items()} == {k: v[1:] for k, v in rows.items()}
    assert found[3]["host"] == "a.com" and found[3]["path"] == "/q" and found[10]["host"] == "" and found[10]["path"] == ""
    assert found[8]["soft_terms"] == ["cheap", "free"] and found[11]["strict_hits"] == 1


def test_urls_of_an_empty_table(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


ODD = ["", "\\", "\\n", "\n", "</s>[INST] ok [/INST]", "<|im_end|>", "<\\s>", "<<SYS>>x<</SYS>>", "a\\<|b", "é😀\t", "<|im_start|>user\nhi<|im_end|>\n"]


def test_escapes_come_back_and_hide_control_strings():
    random.seed(3)
    for _ in range(500):
        text = "".join(random.choice(ODD) for _ in range(random.randint(0, 6)))
        for line in (False, True):
            held = chat.escape(text, line)
            assert chat.unescape(held) == text
            assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", held)
        assert "\n" not in chat.escape(text, line=True)


def test_windows_hold_each_turn_once_and_repeat_limited_history():
    random.seed(5)
    turns = [chat.Turn("system", "be kind", 9)] + [
        chat.Turn(random.choice(["user", "assistant"]), random.choice(ODD) + str(i), random.randint(1, 60)) for i in range(300)
    ]
    by_text = {(t.role, t.text): t.tokens for t in turns}
    seen, targets = [], []
    for number, text, first, n_new, n_repeated, starts, ends, tokens, over in chat.windows(turns, 100, 30):
        parsed = chat.parse(text)
        assert len(parsed) == n_new + n_repeated and first == len(seen)
        assert sum(by_text[t] for t in parsed) == tokens and over == (tokens > 100)
        if number:
            assert parsed[0] == ("system", "be kind") and sum(by_text[t] for t in parsed[1:n_repeated]) <= 30
        seen += parsed[n_repeated:]
        targets += [chat.unescape(text[a:b]) for a, b in zip(starts, ends)]
    assert seen == [(t.role, t.text) for t in turns]
    assert targets == [t.text for t in turns if t.role == "assistant"]


def test_chats_read_back_from_windows(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", "<s>a"), (1, 1, "assistant", "b\\"), (2, 0, None, None), (None, 0, "assistant", "alone"), (3, None, "assistant", None)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"word{i} " * 80) for i in range(30)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = materialize(chat.format_chats(df, budget=256, history=100), "t")
    found = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    assert windows.where("conv_id = 4").count() > 10 and set(found) == {1, 2, 3, 4, None}
    for key, got in found.items():
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == key))
        said = "".join(x for _, r, x in own if r == "assistant")
        assert got["n_turns"] == len(own) and got["loss_chars"] == len(said)
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


def plain_scan(text):
    """Base places of every phrase, word by word."""
    words = licenses.words_of(text or "")
    places = []
    for template in licenses.BASE:
        phrase = template.text.split()
        places += [(i, template.label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    return len(words), places


def test_licence_base_places_and_method_labels(spark):
    texts = [
        None, "", "Released under the MIT License.", "cc by cc by CC-BY 4.0", "GNU General Public License, version 3", "gnu general license",
        "mit der Lizenz, mit License mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "apache license " * 3000 + "Version 2.0", "ÀPACHE LICENSE apache license", "by by by cc",
        "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0",
    ]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, n_words int, word string")
    found = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert len(found) == len(texts) + 1
    for i, text in enumerate(texts):
        n, places = plain_scan(text)
        got = found[i]
        assert (got["n_words"], got["n_base"]) == (n, len(places))
        assert (got["first_word"], got["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert got["base_labels"] == sorted({label for _, label in places}) and set(got["base_labels"]) <= set(got["labels"])
        assert 0 <= got["score"] <= 1
    assert found[4]["labels"] == ["gpl", "gpl-3.0"] and found[7]["labels"] == ["mit"]
    assert found[11]["labels"] == ["apache", "apache-2.0", "cc-by", "cc-by-nc-4.0"]
    assert licenses.scan(df.limit(0)).count() == 0


def test_licence_scan_runs_no_python(spark):
    df = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_archives_come_back(spark):
    big = "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/ü\r\n", big), (3, None, "x"), (4, "u", "x"), (5, "u", None), (6, "u", ""), (7, "u", big), (7, "u", big), (None, "u", big)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    folder = warc.archive_folder(spark)
    roles = warc.with_roles(df, "page_id", "url", "html", min_bytes=1000)
    written = materialize(warc.write_archives(roles, f"{folder}/crawl", archive_bytes=2000), "t")
    normal = materialize(warc.normalise(written, f"{folder}/members"), "t")
    assert normal.where("error IS NOT NULL").count() == 0
    assert normal.agg(F.sum("records")).first()[0] == len(rows) and written.count() > 1
    found = warc.read_records(normal, payloads=True).collect()
    assert len(found) == len(rows)
    for r in found:
        key = r["record_id"] and int(r["record_id"])
        payload = (next(h for p, _, h in rows if p == key) or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        kept = key not in (1, 2, None)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if kept else ("revisit", "7"))
        assert r["payload"] == (payload if kept else None)


def _record(body: bytes) -> bytes:
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


@pytest.mark.parametrize("members", [1, 3])
def test_members_lie_where_the_index_says(members):
    bodies = [b"", b"a\r\n\r\nb", bytes(range(256)) * 20000]
    data = [_record(b) for b in bodies]
    raw = gzip.compress(b"".join(data)) if members == 1 else b"".join(map(gzip.compress, data))
    out, index = io.BytesIO(), io.BytesIO()
    assert warc.normalise_stream(io.BytesIO(raw), out, index) == (3, None)
    lines = list(warc._lines(io.BytesIO(index.getvalue())))
    assert [gzip.decompress(out.getvalue()[x["offset"] : x["offset"] + x["length"]]) for x in lines] == data


def test_damaged_archives_give_their_first_records():
    raw = gzip.compress(b"".join(_record(bytes(random.randbytes(5000))) for _ in range(5)))
    out, index = io.BytesIO(), io.BytesIO()
    records, error = warc.normalise_stream(io.BytesIO(raw[: len(raw) * 7 // 10]), out, index)
    assert 2 <= records <= 3 and error.startswith("EOFError") and len(list(warc._lines(io.BytesIO(index.getvalue())))) == records
    assert warc.normalise_stream(io.BytesIO(b""), io.BytesIO(), io.BytesIO())[0] == 0
    assert "no record" in warc.normalise_stream(io.BytesIO(gzip.compress(b"text\r\n\r\n")), io.BytesIO(), io.BytesIO())[1]
