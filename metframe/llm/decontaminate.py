"""Benchmark decontamination by greedy string tiling.

Texts and test items are sequences of words (runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased). Runs of `min_tile` words
are the seeds: their Karp-Rabin hashes, rolled over every text, are joined with those of the items. Where a text shares
seeds with an item, the longest match of unmarked words is marked as a tile, again and again, until none of
`min_tile` words is left. Tiles don't overlap and may stand in any order, so reordered passages are found too. Items are tiled one at a
time and from maximal matches only, so repeated words and common seeds are not multiplied. An item whose tiles cover at least
`coverage` of its words has leaked into the text. An item of fewer than `min_tile` words has no seed; it has
leaked into a text that has the same words and no others, as one tile.

The items are the stated query set. They go to the workers in blocks of about `block_bytes` of text, one pass over the documents for
each, so neither the driver nor a worker holds more than a block. Nothing is shuffled, and a text is compared in the
task that reads it, so hot sources and common passages are spread like the input.

Defined cases: null or empty texts match nothing, nor do items without words. Within longer texts, items of fewer than `min_tile` words are no evidence.
Repeated documents give a row each; repeated items (or items with equal text) a row for each item. Null ids are passed through.
Empty tables give no rows. Only the named columns are read by `leaks`; `without_leaks` returns all columns of the documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from metframe.llm.common import column_names, mix, plain_words, slices

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_BYTES = 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 20
#: Matches of an item that are listed at a time, or those of one place of it.
_PIECE_PAIRS = 1 << 18


@dataclass(frozen=True)
class Leak:
    item: int
    item_words: int
    covered: int
    tiles: list[tuple[int, int, int]]  # start in the item, start in the text, words

    @property
    def coverage(self) -> float:
        return self.covered / self.item_words


def _rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `n` word numbers."""
    count = max(len(ids) - n + 1, 0)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * _BASE + ids[i : i + count]
    return out ^ (out >> np.uint64(29))


class Tiling:
    """Seeds of a block of items, and the tiling of texts against them."""

    def __init__(self, texts: list[str | None], min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> None:
        self.min_tile, self.coverage = min_tile, coverage
        words = [plain_words(t) for t in texts]
        self._number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for item in words for w in item))}
        self._span = len(self._number) + 3
        self._items = [self._ids(item) for item in words]
        seeds = [_rolled(item, min_tile) for item in self._items]
        counts = [len(s) for s in seeds]
        codes = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self._item = np.repeat(np.arange(len(seeds)), counts)[order]
        self._at = np.concatenate([np.arange(c) for c in counts])[order] if seeds else np.zeros(0, np.int64)
        self._codes, first = np.unique(codes[order], return_index=True)
        self._first = np.append(first, len(codes))
        self._sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self._sieve[self._slot(self._codes)] = True
        self._short: dict[tuple[bytes, ...], list[int]] = {}
        for i, item in enumerate(words):
            if 0 < len(item) < min_tile:
                self._short.setdefault(tuple(item), []).append(i)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._number.get, words, repeat(0)), np.uint64, len(words))

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)

    def leaks(self, text: str | None) -> list[Leak]:
        """Items that leaked into a text, in their order."""
        if not text or not (len(self._codes) or self._short):
            return []
        words = plain_words(text)
        if len(words) < self.min_tile:
            return [Leak(i, len(words), len(words), [(0, 0, len(words))]) for i in self._short.get(tuple(words), [])]
        if not len(self._codes):
            return []
        ids = self._ids(words)
        codes = _rolled(ids, self.min_tile)
        place = np.flatnonzero(self._sieve[self._slot(codes)])
        if not len(place):
            return []
        found = np.searchsorted(self._codes, codes[place])
        hit = found < len(self._codes)
        hit[hit] = self._codes[found[hit]] == codes[place[hit]]
        place, found = place[hit], found[hit]
        if not len(place):
            return []
        # places of the text by seed and by the word before them
        before = np.where(place > 0, ids[place - 1].astype(np.int64), -1)
        order = np.lexsort((place, before, found))
        seeds, first, size = np.unique(found[order], return_index=True, return_counts=True)
        number = np.repeat(np.arange(len(seeds)), size)
        key = number * self._span + before[order] + 2
        text_side = _TextSeeds(place[order], key, first, first + size, self._span)
        # postings of these seeds, item by item
        count = self._first[seeds + 1] - self._first[seeds]
        ends = np.cumsum(count)
        posting = np.arange(ends[-1]) + np.repeat(self._first[seeds] - (ends - count), count)
        seed, item, in_item = np.repeat(np.arange(len(seeds)), count), self._item[posting], self._at[posting]
        by_item = np.lexsort((in_item, item))
        seed, item, in_item = seed[by_item], item[by_item], in_item[by_item]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        runs: list[np.ndarray] = [ids]
        out = []
        for start, stop in zip(starts, np.append(starts[1:], len(item))):
            one, at = int(item[start]), in_item[start:stop]
            covered = np.zeros(len(self._items[one]) + 1, np.int64)
            np.add.at(covered, at, 1)
            np.add.at(covered, np.minimum(at + self.min_tile, len(covered) - 1), -1)
            if (np.cumsum(covered[:-1]) > 0).sum() < self.coverage * len(self._items[one]):
                continue  # not even all seeds together cover enough
            leak = self._tiled(one, ids, *self._matches(one, runs, at, seed[start:stop], text_side))
            if leak.coverage >= self.coverage:
                out.append(leak)
        return out

    def _matches(
        self, item: int, runs: list[np.ndarray], at: np.ndarray, seed: np.ndarray, side: _TextSeeds
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, item start and text start of the maximal matches, longest first, then by place.

        Only places whose words before differ begin a match, so a repeated word gives one match a diagonal. Of matches of one start
        and length in the item only the first `most` are kept: all tiles together have at most as many words as the item, and
        meet fewer text places than that, so an earlier match that no tile meets always comes before the rest.
        """
        words = self._items[item]
        before = np.where(at > 0, words[at - 1].astype(np.int64), -2)
        low, high = side.first[seed], side.stop[seed]
        key = seed * side.span + before + 2
        same_low, same_high = np.searchsorted(side.key, key), np.searchsorted(side.key, key, side="right")
        same_low, same_high = np.clip(same_low, low, high), np.clip(same_high, low, high)
        size = high - low - (same_high - same_low)
        own = [words]
        kept = []
        begin = 0
        ends = np.cumsum(size)
        while begin < len(at):
            done = ends[begin - 1] if begin else 0
            stop = max(int(np.searchsorted(ends, done + _PIECE_PAIRS, side="right")), begin + 1)
            take = slice(begin, stop)
            begin = stop
            n = size[take]
            rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            head = np.repeat(same_low[take] - low[take], n)
            skip = np.repeat(same_high[take] - same_low[take], n)
            b = side.place[np.repeat(low[take], n) + rank + np.where(rank >= head, skip, 0)]
            a = np.repeat(at[take], n)
            length = _common(own, runs, a, b)
            real = length >= self.min_tile
            a, b, length = a[real], b[real], length[real]
            order = np.lexsort((b, a, -length))
            a, b, length = a[order], b[order], length[order]
            if len(a):
                group = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (length[1:] != length[:-1])])
                place = np.arange(len(a)) - np.repeat(group, np.diff(np.append(group, len(a))))
                most = len(words) + len(words) // self.min_tile * (length - 1) + 1
                few = place < most
                kept.append((length[few], a[few], b[few]))
        if not kept:
            return (np.zeros(0, np.int64),) * 3
        length, a, b = (np.concatenate(column) for column in zip(*kept))
        order = np.lexsort((b, a, -length))
        return length[order], a[order], b[order]

    def _tiled(self, item: int, ids: np.ndarray, lengths: np.ndarray, in_item: np.ndarray, in_text: np.ndarray) -> Leak:
        """Mark the longest match of unmarked words while there is one of `min_tile` words.

        Matches come sorted by length, then place. One that meets marked words is cut into its unmarked runs, which
        wait their turn on a heap.
        """
        words, least = self._items[item], self.min_tile
        free_item, free_text = np.ones(len(words), bool), np.ones(len(ids), bool)
        heap: list[tuple[int, int, int]] = []
        tiles, left, at, idle = [], len(words), 0, 0
        while left >= least and (heap or at < len(lengths)):
            listed = (-int(lengths[at]), int(in_item[at]), int(in_text[at])) if at < len(lengths) else None
            if listed is None or (heap and heap[0] < listed):
                n, a, b = heapq.heappop(heap)
            else:
                n, a, b = listed
                at += 1
            n = -n
            free = free_item[a : a + n] & free_text[b : b + n] & (words[a : a + n] == ids[b : b + n])
            if free.all():
                free_item[a : a + n] = free_text[b : b + n] = False
                tiles.append((a, b, n))
                left, idle = left - n, 0
                continue
            edges = np.flatnonzero(np.diff(np.r_[False, free, False]))
            for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if stop - start >= least:
                    heapq.heappush(heap, (start - stop, a + start, b + start))
            idle += 1
            if idle % 256 == 0:  # what lies in marked words of the item alone needs no turn
                sums = np.r_[0, np.cumsum(free_item)]
                useful = sums[in_item[at:] + lengths[at:]] - sums[in_item[at:]] >= least
                lengths, in_item, in_text, at = lengths[at:][useful], in_item[at:][useful], in_text[at:][useful], 0
        return Leak(item, len(words), len(words) - left, tiles)


@dataclass(frozen=True)
class _TextSeeds:
    """Places of a text's seeds, sorted by seed, word before and place; `first` and `stop` are each seed's bounds."""

    place: np.ndarray
    key: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    span: int


def _common(own: list[np.ndarray], runs: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words match from each `a` of an item and `b` of a text on, by hashes of runs of 1, 2, 4, ... words.

    `own` and `runs` hold those of the item and the text, and are extended as needed.
    """
    top = max(min(len(own[0]), len(runs[0])).bit_length() - 1, 0)
    for levels in (own, runs):
        while len(levels) <= top:
            half, last = 1 << (len(levels) - 1), levels[-1]
            levels.append(mix(last[: len(last) - half] * _BASE + last[half:]))
    n = np.zeros(len(a), np.int64)
    for level in range(top, -1, -1):
        x, y = own[level], runs[level]
        i, j = a + n, b + n
        inside = (i < len(x)) & (j < len(y))
        n += np.where(inside & (x[np.minimum(i, len(x) - 1)] == y[np.minimum(j, len(y) - 1)]), 1 << level, 0)
    return n


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, a block at a time; blocks are dealt by a hash of the item."""
    items = benchmark.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text"))
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    count = -(-size // block_bytes) or 1
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block).orderBy("item", "text").collect()
        yield [r["item"] for r in rows], [r["text"] for r in rows]


def leaks(
    documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """A row for each document and item that leaked into it: the ids, item_words, covered_words, coverage, tiles (an array
    of item_start, text_start, words, in words from 0)."""
    column_names(documents, doc, text)
    column_names(benchmark, item, item_text)
    spark = documents.sparkSession
    kinds = [documents.schema[doc].dataType, benchmark.schema[item].dataType]
    schema = (
        f"doc {kinds[0].simpleString()}, item {kinds[1].simpleString()}, item_words int, covered_words int, coverage double, "
        "tiles array<struct<item_start: int, text_start: int, words: int>>"
    )
    tile = pa.struct([("item_start", pa.int32()), ("text_start", pa.int32()), ("words", pa.int32())])
    types = [to_arrow_type(kinds[0]), to_arrow_type(kinds[1]), pa.int32(), pa.int32(), pa.float64(), pa.list_(tile)]
    arrow = pa.schema(list(zip(("doc", "item", "item_words", "covered_words", "coverage", "tiles"), types)))
    rows = documents.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    out = None
    for ids, texts in _blocks(benchmark, item, item_text, block_bytes):
        sent = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, tiling = sent.value[0], Tiling(sent.value[1], min_tile, coverage)
            for batch in slices(batches):
                found = [
                    (key, names[x.item], x.item_words, x.covered, x.coverage, [dict(zip(("item_start", "text_start", "words"), t)) for t in x.tiles])
                    for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in tiling.leaks(body)
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], schema=arrow)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"doc": doc, "item": item})


def without_leaks(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    min_tile: int = MIN_TILE, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, with all their columns, into which no item leaked."""
    column_names(documents, text)
    column_names(benchmark, item, item_text)
    spark, at = documents.sparkSession, documents.columns.index(text)
    for _, texts in _blocks(benchmark, item, item_text, block_bytes):
        sent = spark.sparkContext.broadcast(texts)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tiling = Tiling(sent.value, min_tile, coverage)
            for batch in slices(batches):
                clean = [not tiling.leaks(body) for body in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
