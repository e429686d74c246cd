"""Alignment of the tokens of two tokenizers, with the counts of linked id pairs over a corpus.

Both tokenizers spell the same bytes, a space and the text. Offsets where a token of each ends are shared cuts; they are found by divide and conquer:
the end nearest to the middle of an interval that the other tokenizer has too (by bisection of its ends) cuts it in two, and both halves are
searched in the same way; an interval without a shared end inside is a group. All intervals of a block of texts are searched at once,
round by round. Two tokens are linked if their byte ranges overlap. What lies between single spaces is encoded and aligned once for each block, as both
tokenizers cut there.

Texts are cut into blocks of about `BLOCK_BYTES`. A block holds each different id pair once, and texts refer to it by its place in the block, so
what is shuffled to count pairs over the corpus, and to give the counts back, is a row for each pair of a block and not for each link. A row
holds one text or a run of `RUN` pairs, never a block, and a task holds one block of counts at a time, so memory doesn't grow with the
rows of a task.

Defined cases: texts that are null or empty, or that one of the tokenizers doesn't spell, have no tokens: counts of 0 and an empty digest. Special
tokens' strings are plain text. Repeated rows count as often as they occur; ids, null ones too, are passed through. An empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from metframe.llm.common import column_names, slices, utf8
from metframe.llm.tokens import UNCUT, WHITE, ByteBpe
from metframe.session import materialize

#: A sentencepiece model with byte fallback.
PIECES = "piece_bpe_32k.model"
BLOCK_BYTES = 1 << 20
#: Pairs of a block that one row holds at most.
RUN = 1024
_SPACE = "▁"


class PieceBpe:
    """Encoder of one worker for a sentencepiece BPE model, which marks spaces and adds one before the text."""

    def __init__(self, model: str | None = None) -> None:
        self._model = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path(PIECES))
        pieces = [self._model.id_to_piece(i) for i in range(len(self._model))]
        self._bytes = [
            bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.lengths = np.fromiter(map(len, self._bytes), np.int64, len(pieces))
        #: Whether no piece holds a mark after another character, so that merges never cross into a mark.
        self.cuts = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's ids begin, with the end, and whether they spell a space and the text."""
        ids = self._model.encode(texts)
        of = np.r_[0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]
        flat = np.fromiter(chain.from_iterable(ids), np.int64, of[-1])
        size = np.fromiter((len(t) + 1 for t in map(utf8, texts)), np.int64, len(texts))
        size[[not t for t in texts]] = 0
        alike = np.array_equal(np.diff(np.r_[0, np.cumsum(self.lengths[flat])][of]), size)
        if alike and b"".join(map(self._bytes.__getitem__, flat.tolist())) == b"".join(b" " + utf8(t) for t in texts if t):
            return flat, of, np.ones(len(texts), bool)
        good = [b"".join(map(self._bytes.__getitem__, x)) == (b" " + utf8(t) if t else b"") for x, t in zip(ids, texts)]
        return flat, of, np.array(good, bool)


def shared_cuts(one: np.ndarray, two: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the ends `one` are shared with the ends `two` and so cut groups; both ascend.

    Intervals of `one` go from `first` to `last`; their last end is a shared one. Each round asks the end of an interval that
    is next to its middle and not yet asked; a shared one halves the interval, and one without any is a group.
    """
    cut = np.zeros(len(one), bool)
    cut[last] = True
    low, high, asked = first, last, np.zeros(len(first), np.int64)
    while True:
        inner = low < high
        low, high, asked = low[inner], high[inner], asked[inner]
        if not len(low):
            return cut
        middle = (low + high - 1) >> 1
        away = (asked + 1) >> 1
        at = np.where(asked & 1, middle + away, middle - away)
        inside = (at >= low) & (at < high)
        at = np.clip(at, low, high - 1)
        hit = inside & (two[np.searchsorted(two, one[at])] == one[at])
        cut[at[hit]] = True
        left = ~hit & (away <= high - low)
        low, high, asked = (
            np.r_[low[hit], at[hit] + 1, low[left]], np.r_[at[hit], high[hit], high[left]],
            np.r_[np.zeros(2 * hit.sum(), np.int64), asked[left] + 1],
        )


class Aligned:
    """Groups and links of texts, given their ids by both tokenizers and where each text's ids begin, with the end."""

    def __init__(self, a: np.ndarray, of_a: np.ndarray, bytes_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, bytes_b: np.ndarray) -> None:
        self.a, self.b, self.of_a, self.of_b = a, b, of_a, of_b
        size_a, end_a, end_b = bytes_a[a], np.cumsum(bytes_a[a]), np.cumsum(bytes_b[b])
        held = np.diff(of_a) > 0
        cut_a = shared_cuts(end_a, end_b, of_a[:-1][held], of_a[1:][held] - 1)
        #: Where groups stop among the tokens of each side.
        self.stop_a = np.flatnonzero(cut_a) + 1
        self.stop_b = np.searchsorted(end_b, end_a[cut_a]) + 1
        self.groups = np.searchsorted(self.stop_a, of_a, side="right")
        begin = np.searchsorted(end_b, end_a - size_a, side="right")
        many = np.searchsorted(end_b, end_a) - begin + 1
        links = np.r_[0, np.cumsum(many)]
        other = np.arange(links[-1]) + np.repeat(begin - links[:-1], many)
        #: Id pairs of all links, and where each text's links begin.
        self.pairs = (b[other].astype(np.int64) << 32) | np.repeat(a, many).astype(np.int64)
        self.of_links = links[of_a]

    def spelled(self, table: list[str], shift: int) -> Iterator[str]:
        """`a1,a2|b1;a3|b2,b3` of each text; the table has both forms of every id, from `shift` on those of the second tokenizer."""
        group_a = np.repeat(np.arange(len(self.stop_a)), np.diff(np.r_[0, self.stop_a]))
        group_b = np.repeat(np.arange(len(self.stop_b)), np.diff(np.r_[0, self.stop_b]))
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.stop_a - 1], last_b[self.stop_b - 1] = 1, 1
        codes[np.arange(len(self.a)) + np.r_[0, self.stop_b][group_a]] = 2 * self.a + last_a
        codes[np.arange(len(self.b)) + self.stop_a[group_b]] = shift + 2 * self.b + last_b
        bounds, codes = (self.of_a + self.of_b).tolist(), codes.tolist()
        for start, stop in zip(bounds[:-1], bounds[1:]):
            yield "".join(map(table.__getitem__, codes[start:stop]))[:-1]


def _table(count_a: int, count_b: int) -> list[str]:
    return [f"{i}{end}" for i in range(count_a) for end in ",|"] + [f"{i}{end}" for i in range(count_b) for end in ",;"]


_FACTS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(rows: DataFrame, bytes_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    """Rows (doc, text) aligned, in blocks: rows with a `run` hold the next of the block's different id pairs with their links, the others a text's
    facts, and its pairs by their places in the block."""
    kind = rows.schema["doc"].dataType
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    fields = [("doc", to_arrow_type(kind)), *((c, pa.int64()) for c in _FACTS), ("digest", pa.string()), ("code", ints), ("many", ints)]
    schema = pa.schema([("block", pa.int64()), ("run", pa.int32()), ("pair", longs), ("times", longs), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = ByteBpe(bytes_model, special=False), PieceBpe(piece_model)
        table, shift = _table(len(one.lengths), len(two.lengths)), 2 * len(one.lengths)
        number = TaskContext.get().partitionId() << 32
        for batch in _blocks_of(batches):
            docs, texts = batch.column(0), batch.column(1)
            told = np.flatnonzero(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False))
            unit, bounds, encoded, good = _encoded(texts.take(pa.array(told)), one, two)
            spelt = np.logical_and.reduceat(good[unit], bounds[:-1]) if len(told) else np.zeros(0, bool)
            unit, bounds = _kept(unit, bounds, spelt)
            rows_of = told[spelt]
            facts = np.zeros((4, len(docs)), np.int64)
            digests = np.full(len(docs), "", object)
            many_pairs = np.zeros(len(docs), np.int64)
            pair = times = code = many = np.zeros(0, np.int64)
            if len(rows_of):
                found = Aligned(*encoded[0], one.lengths, *encoded[1], two.lengths)
                sizes = [np.diff(x) for x in (found.of_a, found.of_b, found.groups, found.of_links)]
                facts[:, rows_of] = [np.add.reduceat(x[unit], bounds[:-1]) for x in sizes]
                spelled, units = [*found.spelled(table, shift)], unit.tolist()
                for row, start, stop in zip(rows_of.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    digests[row] = hashlib.sha256(";".join(map(spelled.__getitem__, units[start:stop])).encode()).hexdigest()
                pair, place = np.unique(found.pairs, return_inverse=True)
                links = sizes[3][unit]
                ends = np.r_[0, np.cumsum(links)]
                place = place[np.arange(ends[-1]) + np.repeat(found.of_links[:-1][unit] - ends[:-1], links)]
                times = np.bincount(place, minlength=len(pair))
                text = np.repeat(np.arange(len(rows_of)), np.diff(ends[bounds]))
                held, many = np.unique(text * len(pair) + place, return_counts=True)
                code = held % len(pair)
                many_pairs[rows_of] = np.bincount(held // len(pair), minlength=len(rows_of))
                yield _rows(schema, block=number, run=np.arange(-(-len(pair) // RUN)), pair=_runs(pair), times=_runs(times))
            of = np.r_[0, np.cumsum(many_pairs)]
            columns = {"doc": docs, **dict(zip(_FACTS, facts)), "digest": digests, "code": _lists(code, of, pa.int32()), "many": _lists(many, of, pa.int32())}
            yield _rows(schema, block=number, **columns)
            number += 1

    told = ", ".join(f"{c} long" for c in _FACTS)
    return rows.mapInArrow(
        run, "block long, run int, pair array<long>, times array<long>, "
        f"doc {kind.simpleString()}, {told}, digest string, code array<int>, many array<int>",
    )


def _lists(values: np.ndarray, of: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(values, kind))


def _runs(values: np.ndarray) -> pa.ListArray:
    """Values in runs of `RUN`."""
    return _lists(values, np.r_[np.arange(0, len(values), RUN), len(values)], pa.int64())


def _rows(schema: pa.Schema, block: int, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    """Rows of a block with some of the columns; the others are null."""
    count = len(next(iter(columns.values())))
    columns["block"] = np.full(count, block)
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_Ids = tuple[np.ndarray, np.ndarray]


def _encoded(texts: pa.Array, one: ByteBpe, two: PieceBpe) -> tuple[np.ndarray, np.ndarray, tuple[_Ids, _Ids], np.ndarray]:
    """Texts as units that both tokenizers encode by themselves: the unit at each place, where texts begin, with the end, ids of the units by both
    tokenizers, and whether these spell a unit. Units are what lies between single spaces; other texts are one unit each. Units that are not spelt
    have no ids."""
    texts = texts.cast(pa.large_string())
    uncut = pc.match_substring_regex(texts, f"^[{WHITE}]|{UNCUT}|{_SPACE}").to_numpy(zero_copy_only=False) if two.cuts else np.ones(len(texts), bool)
    split = pc.split_pattern(pc.if_else(pa.array(uncut), "", texts), " ")
    bounds = split.offsets.to_numpy()
    pieces = split.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    coded = pieces.dictionary_encode()
    unit = coded.indices.to_numpy().astype(np.int64)
    words, whole = coded.dictionary, texts.filter(pa.array(uncut)).to_pylist()
    unit[bounds[:-1][uncut]] = len(words) + np.arange(len(whole))
    flat, of = one.spaced(words)
    alone = [one.ids(f" {t}") for t in whole]
    flat = np.concatenate([flat, *alone]).astype(np.int64)
    of = np.r_[of, of[-1] + np.cumsum(np.fromiter(map(len, alone), np.int64, len(alone)))]
    units = words.to_pylist() + whole
    other, of_other, good = two.encode(units)
    good &= np.diff(np.r_[0, np.cumsum(one.lengths[flat])][of]) == np.diff(np.r_[0, np.cumsum(two.lengths[other])][of_other])
    return unit, bounds, (_kept(flat, of, good, True), _kept(other, of_other, good, True)), good


def _kept(ids: np.ndarray, of: np.ndarray, keep: np.ndarray, empty: bool = False) -> _Ids:
    """Ids of the texts to keep, and where each begins, with the end; `empty`: the others stay, without ids."""
    size = np.diff(of)
    return ids[np.repeat(keep, size)], np.r_[0, np.cumsum(np.where(keep, size, 0) if empty else size[keep])]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about `BLOCK_BYTES` of text; a longer text is one by itself."""
    held, size = [], 0
    for batch in slices(batches, 256):
        bytes_of = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        start = 0
        for i, mine in enumerate(bytes_of.tolist()):
            if size and size + mine > BLOCK_BYTES:
                held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, start = [], 0, i
            size += mine
        held.append(batch.slice(start))
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, count (links over the corpus) and best (whether it is the highest of its second id) of all id pairs of the blocks."""
    pairs = found.where("run is not null").select(F.explode(F.arrays_zip("pair", "times")).alias("x"))
    totals = materialize(pairs.groupBy("x.pair").agg(F.sum("x.times").alias("count")), "pair-counts")
    second = F.shiftright("pair", 32).alias("second")
    highest = totals.groupBy(second).agg(F.max("count").alias("highest"))
    return totals.select("pair", "count", second).join(highest, "second").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def align(documents: DataFrame, doc: str = "doc_id", text: str = "text", bytes_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    """`doc`, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    column_names(documents, doc, text)
    kind = documents.schema[doc].dataType
    rows = documents.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    found = materialize(blocks(rows, bytes_model, piece_model), "aligned")
    counts = materialize(pair_counts(found), "ranked-pairs")
    told = found.where("run is not null").select("block", "run", F.posexplode("pair").alias("at", "pair")).join(counts, "pair")
    told = told.groupBy("block", "run").agg(F.array_sort(F.collect_list(F.struct("at", "count", "best"))).alias("told"))
    told = told.select("block", "run", F.col("told.count").alias("count"), F.col("told.best").alias("best"))
    sides = found.where("run is null").select("block", "doc", *_FACTS, "digest", "code", "many")
    both = told.unionByName(sides, allowMissingColumns=True).select("block", "run", "count", "best", "doc", *_FACTS, "digest", "code", "many")
    # the counts of a block come before its texts
    both = both.repartition("block").sortWithinPartitions("block", F.col("run").asc_nulls_last())
    names = (doc, *_FACTS, "n_best", "count_sum", "groups_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, best = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in slices(batches):
            block, told = batch.column(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (np.diff(block) != 0) | (np.diff(told) != 0)])
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(block)]):
                piece = batch.slice(start, stop - start)
                if block[start] != now:
                    now, count, best = block[start], count[:0], best[:0]
                if told[start]:
                    count = np.r_[count, piece.column(2).flatten().to_numpy()]
                    best = np.r_[best, piece.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)]
                    continue
                docs, *facts, digest, code, many = piece.columns[4:]
                bounds = np.r_[0, np.cumsum(pc.list_value_length(code).to_numpy())]
                at, many = code.flatten().to_numpy(), many.flatten().to_numpy().astype(np.int64)
                sums = [np.diff(np.r_[0, np.cumsum(many * x[at])][bounds]) for x in (best, count)] if len(at) else [np.zeros(len(docs), np.int64)] * 2
                yield pa.RecordBatch.from_arrays([docs, *facts, *map(pa.array, sums), digest], names=[*names])

    schema = ", ".join([f"`{doc}` {kind.simpleString()}", *(f"{c} long" for c in names[1:-1]), f"{names[-1]} string"])
    return both.mapInArrow(run, schema)
