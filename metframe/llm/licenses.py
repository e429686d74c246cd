"""License scan by a positional index of rare words, in built-in functions only.

Templates are texts of known label; a short phrase is a template too. Each template is looked up by its anchors, the rarest third
of its words (one at least) by document frequency over the whole corpus. Files without an anchor hold no template.
In the others every place of an anchor or of a mandatory word votes for (template, place where it would begin); votes of one
template and place are the intersection of its postings by relative position. A place counts if all words of the template's mandatory
phrase are where the template has them, so phrases are verified word by word, and at least `MIN_COVERAGE` of the template's indexed
weight (inverse document frequency) agrees.

The index is a literal of the template library, some hundred rows, which is joined with the places of indexed words. Words of a
file are read once; a file's votes are summed in the task that reads it, before the two small shuffles by file.

Defined cases: a null text is empty. Every row gets one result row, repeated rows and null ids too. An empty table gives no rows.
Only the named columns are read. Overlapping places all count.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metframe.llm.common import column_names

#: What a word is, in the patterns of Java and RE2 alike.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_COVERAGE = 0.5
#: A match of n words has the score coverage * n / (n + SCORE_WORDS).
SCORE_WORDS = 2


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class Template:
    """`key` is the mandatory phrase, which occurs in `text`; without one, the whole text is."""

    label: str
    text: str
    key: str = ""

    @property
    def mandatory(self) -> range:
        """Places of the mandatory words."""
        words, key = words_of(self.text), words_of(self.key or self.text)
        begins = [i for i in range(len(words)) if words[i : i + len(key)] == key]
        if not begins:
            raise ValueError(f"{self.key!r} is not in the text of {self.label}")
        return range(begins[0], begins[0] + len(key))


# The base phrases, and wordings of licences and their notices.
BASE = (
    Template("gpl", "gnu general public license"), Template("apache", "apache license"),
    Template("cc-by", "cc by"), Template("mit", "mit license"),
)
LIBRARY = (
    Template("agpl-3.0", "GNU Affero General Public License version 3", "gnu affero general public license"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0", "except in compliance with the license",
    ),
    Template(
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met", "redistribution and use in source and binary forms",
    ),
    Template("cc-by-4.0", "CC BY 4.0"), Template("cc-by-nc-4.0", "CC BY-NC 4.0"), Template("cc-by-nd-4.0", "CC BY-ND 4.0"),
    Template("cc-by-sa-4.0", "CC BY-SA 4.0"),
    Template("cc0-1.0", "CC0 1.0 Universal", "cc0 1 0"),
    Template("gpl-2.0", "GNU General Public License, version 2"), Template("gpl-3.0", "GNU General Public License, version 3"),
    Template(
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation", "under the terms of the gnu general public license",
    ),
    Template(
        "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "with or without fee is hereby granted",
    ),
    Template("lgpl", "GNU Lesser General Public License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "permission is hereby granted free of charge",
    ),
    Template("mpl-2.0", "Mozilla Public License, v. 2.0", "mozilla public license"),
    Template(
        "unlicense", "This is free and unencumbered software released into the public domain", "unencumbered software released into the public domain",
    ),
)


@dataclass(frozen=True)
class Posting:
    template: int
    label: str
    base: bool
    word: str
    place: int
    mandatory: bool


def postings(templates: Sequence[Template], n_base: int) -> list[Posting]:
    """All words of the templates with their places; the first `n_base` templates are the base ones."""
    return [
        Posting(t, template.label, t < n_base, word, place, place in template.mandatory)
        for t, template in enumerate(templates) for place, word in enumerate(words_of(template.text))
    ]


def words_column(text: str) -> Column:
    lowered = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def _index(found: list[Posting], frequency: dict[str, int], documents: int) -> list[tuple]:
    """Postings of anchors and mandatory words with weights and what their template has in all."""
    from math import log

    weight = {p.word: log((documents + 1) / (frequency.get(p.word, 0) + 1)) + 1 for p in found}
    out = []
    for template in sorted({p.template for p in found}):
        mine = [p for p in found if p.template == template]
        rare = sorted({p.word for p in mine}, key=lambda w: (frequency.get(w, 0), w))
        anchors = set(rare[: -(-len(rare) // 3)])
        kept = [p for p in mine if p.mandatory or p.word in anchors]
        total = sum(weight[p.word] for p in kept)
        needed = sum(p.mandatory for p in kept)
        out += [
            (p.word, template, p.label, p.base, p.place, p.mandatory, p.word in anchors, weight[p.word], total, needed, len(mine)) for p in kept
        ]
    return out


_INDEX = (
    "word string, template int, label string, base boolean, place int, mandatory boolean, anchor boolean, weight double, "
    "total double, needed int, length int"
)


def scan(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", base: Sequence[Template] = BASE, library: Sequence[Template] = LIBRARY
) -> DataFrame:
    """`doc`, n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays) and score of every row."""
    column_names(documents, doc, text)
    spark = documents.sparkSession
    found = postings([*base, *library], len(base))
    # an array of one array is exploded so that the words are computed once and not in every use
    rows = documents.select(F.col(f"`{doc}`").alias("doc"), F.explode(F.array(words_column(text))).alias("words"))
    vocabulary = F.array(*map(F.lit, sorted({p.word for p in found})))
    counts = rows.select(F.explode(F.array_intersect("words", vocabulary)).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}  # a row for each word of the library at most
    index = _index(found, frequency, documents.count())
    anchors = F.array(*map(F.lit, sorted({row[0] for row in index if row[6]})))
    indexed = F.array(*map(F.lit, sorted({row[0] for row in index})))

    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda x: F.array_contains(indexed, x["word"]))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc", F.size("words").cast("long").alias("n_words"),
        F.when(F.size(F.array_intersect("words", anchors)) > 0, places).alias("places"),
    )
    votes = rows.select("row", "doc", "n_words", F.explode_outer("places").alias("hit")).select("row", "doc", "n_words", "hit.at", "hit.word")
    votes = votes.join(F.broadcast(spark.createDataFrame(index, _INDEX)), "word", "left")
    begun = votes.withColumn("start", F.col("at").cast("long") - F.col("place"))
    matched = begun.groupBy("row", "doc", "n_words", "template", "start", "label", "base", "total", "needed", "length").agg(
        F.count_if("mandatory").alias("mandatory"), F.count_if("anchor").alias("anchors"), F.sum("weight").alias("weight"),
    )
    coverage = F.col("weight") / F.col("total")
    holds = (F.col("mandatory") == F.col("needed")) & (F.col("anchors") > 0) & (coverage >= MIN_COVERAGE)
    holds = F.coalesce(holds, F.lit(False))
    of_base = holds & F.col("base")
    return (
        matched.withColumns({"holds": holds, "of_base": of_base, "score": coverage * F.col("length") / (F.col("length") + SCORE_WORDS)})
        .groupBy("row", "doc", "n_words").agg(
            F.count_if("of_base").alias("n_base"),
            F.min(F.when(F.col("of_base"), F.col("start"))).alias("first_word"),
            F.max(F.when(F.col("of_base"), F.col("start"))).alias("last_word"),
            F.sort_array(F.collect_set(F.when(F.col("of_base"), F.col("label")))).alias("base_labels"),
            F.sort_array(F.collect_set(F.when(F.col("holds"), F.col("label")))).alias("labels"),
            F.coalesce(F.max(F.when(F.col("holds"), F.col("score"))), F.lit(0.0)).alias("score"),
        ).drop("row").withColumnRenamed("doc", doc)
    )
