"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Tokens are words between ASCII white space, A-Z lower-cased, and one end per text. N-grams of up to `order` tokens, 2 unless said
otherwise, are known by 64-bit hashes; a text stands after one end, so its first bigram is (end, word) and its first trigram (end, word, word). A count c is quantised to level 1 + floor(log_1.5 c), and the filter holds (n-gram, 1) to (n-gram, level);
probing level by level until one is missing gives the level back, never too low. The filter is cut into slices
of 64 KiB by n-gram, so each is built by the task that has its n-grams, at `BITS` bits an entry whatever the corpus size.

The probability of w after h is (c(h w) + MU p(w after h less its first token)) / (c(h) + MU), down to p(w) = (c(w) + 1) / (N + V + 1), with
counts from the filter, none above that of a part. The base score uses exact unigram counts, N and V.

Filter and exact unigram counts are broadcast in segments of at most about `SEGMENT_BYTES`, one pass over the texts for each. The
driver gathers a segment piece by piece and holds one piece; a worker holds one segment, and its broadcasts are destroyed after the pass.
The pass over a single segment gives scores at once; of several, each leaves a byte per n-gram of a text, and what they leave
is put together by text. Counts are summed per batch before the shuffle; its keys are hashes, so frequent words don't concentrate
anywhere. Texts are handled in slices of about `TEXT_BYTES`, or one by one if longer.

Defined cases: a null text is empty and has the end alone. Repeated rows are learnt and scored as often as they
occur, and null ids are passed through. Without training rows all probabilities are 1. An empty table gives no rows. Only the named
columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from metframe.llm.common import WordHashes, column_names, mix, slices, spaced_words
from metframe.session import materialize

BASE, PROBES, BITS, MU, ORDER = 1.5, 3, 8, 5.0, 2
SLICE_BITS = 19
SEGMENT_BYTES = 128 << 20
#: Slices that are gathered and broadcast at once, 4 MiB of filter.
PIECE_SLICES = 64
#: Bytes a unigram takes in a segment beside the filter, and tokens counted before they are given on.
_EXACT_BYTES, _BATCH_TOKENS = 12, 1_000_000
#: Text a worker takes up at a time.
TEXT_BYTES = 2 << 20
_UNIGRAM = np.uint64(1)
_END = np.uint64(0x5851F42D4C957F2D)
_MAX_LEVEL = 110


def _values() -> np.ndarray:
    """The count a level stands for: the mean of those it holds."""
    out = np.zeros(_MAX_LEVEL + 1)
    for level in range(1, _MAX_LEVEL + 1):
        low, high = BASE ** (level - 1), BASE**level
        whole = np.arange(np.ceil(low - 1e-9), min(np.ceil(high - 1e-9), low + 1e6))
        out[level] = whole.mean() if len(whole) and high < 1e6 else (low * high) ** 0.5
    return out


VALUES = _values()


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def grams(text_words: list[list[bytes]], hashes: WordHashes, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each token, by length; where each text begins; the place of each token in its text.

    A token at place i has no n-gram of more than i + 2 tokens: its hash for such a length means nothing.
    The lowest bit tells unigrams from others; the highest bits choose slice and segment.
    """
    sizes = np.fromiter((len(w) + 1 for w in text_words), np.int64, len(text_words))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    tokens = np.full(bounds[-1], _END, np.uint64)
    is_end = np.zeros(bounds[-1], bool)
    is_end[bounds[1:] - 1] = True
    tokens[~is_end] = hashes([w for words in text_words for w in words])
    before = np.roll(tokens, 1)
    before[bounds[:-1]] = _END
    out = [mix(tokens) | _UNIGRAM]
    for _ in range(2, order + 1):
        longer = mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + tokens)
        out.append(longer & ~_UNIGRAM)
        before = np.roll(longer, 1)
    return out, bounds, np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)


def counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """gram and n of every n-gram of (text), in order of the grams within each partition."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0

        def emptied() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in slices(batches, size=TEXT_BYTES):
            found, _, place = grams([spaced_words(t) for t in batch.column(0).to_pylist()], hashes, order)
            held += [gram[place >= length - 2] for length, gram in enumerate(found, 1)]
            size += len(place)
            if size >= _BATCH_TOKENS:
                yield emptied()
                held, size = [], 0
        if held:
            yield emptied()

    partial = rows.select("text").mapInArrow(counted, "gram long, n long")
    # ranges of grams, some for each partition, so that few slices are shared by two tasks
    ranges = (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length()
    range_of = F.shiftrightunsigned("gram", 64 - ranges)
    summed = partial.repartition(range_of).groupBy(range_of.alias("range"), "gram").agg(F.sum("n").alias("n"))
    return summed.select("gram", "n").sortWithinPartitions("gram")


def _slice_of(gram: np.ndarray, count: int) -> np.ndarray:
    return (((gram >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


def _bits_of(gram: np.ndarray, level: int) -> Iterator[np.ndarray]:
    """Places in a slice that stand for a level of n-grams."""
    drawn = mix(gram + np.uint64(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    for probe in range(PROBES):
        yield ((drawn >> np.uint64(SLICE_BITS * probe)) & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64)


def filter_slices(counted: DataFrame, count: int) -> DataFrame:
    """slice, bits, and the grams and counts of its unigrams; a slice that two tasks share has two rows."""
    schema = pa.schema([("slice", pa.int64()), ("bits", pa.binary()), ("grams", pa.binary()), ("n", pa.binary())])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits, exact = -1, None, []

        def done() -> pa.RecordBatch:
            gram, n = (np.concatenate(x) for x in zip(*exact)) if exact else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            packed = np.packbits(bits, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((at, packed, gram.tobytes(), n.tobytes()), schema.types)], schema=schema
            )

        for batch in batches:
            gram, n = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            of, level = _slice_of(gram, count), levels_of(n)
            cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else [0]
            for start, stop in zip(cuts[:-1], cuts[1:]):
                if of[start] != at:
                    if at >= 0:
                        yield done()
                    at, bits, exact = int(of[start]), np.zeros(1 << SLICE_BITS, bool), []
                mine, top = gram[start:stop], level[start:stop]
                for j in range(1, int(top.max()) + 1):
                    mine, top = mine[top >= j], top[top >= j]
                    for place in _bits_of(mine, j):
                        bits[place] = True
                one = (gram[start:stop] & _UNIGRAM) == 1
                exact.append((gram[start:stop][one], n[start:stop][one]))
        if at >= 0:
            yield done()

    return counted.mapInArrow(built, "slice long, bits binary, grams binary, n binary")


@dataclass
class Piece:
    """Slices `first` to `stop` of `slices`, and the exact counts of their unigrams, by gram. What is broadcast at once."""

    first: int
    stop: int
    slices: int
    bits: np.ndarray
    grams: np.ndarray
    n: np.ndarray

    def levels(self, gram: np.ndarray) -> np.ndarray:
        """Levels of n-grams of this piece: membership is probed upwards until a level is missing."""
        base = (_slice_of(gram, self.slices) - self.first) << SLICE_BITS
        out = np.zeros(len(gram), np.uint8)
        left = np.arange(len(gram))
        for level in range(1, _MAX_LEVEL + 1):
            held = np.ones(len(left), bool)
            for place in _bits_of(gram[left], level):
                place += base[left]
                held &= (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
            left = left[held]
            if not len(left):
                break
            out[left] = level
        return out

    def exact(self, gram: np.ndarray) -> np.ndarray:
        """Counts of unigrams of this piece in training tokens; 0 if unknown."""
        if not len(self.grams):
            return np.zeros(len(gram), np.int64)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        return np.where(self.grams[at] == gram, self.n[at], 0)


@dataclass(frozen=True)
class Model:
    """A fitted model: where its slices are, and the facts of its training tokens."""

    slices: DataFrame
    count: int
    per_segment: int
    tokens: int
    vocabulary: int
    order: int = ORDER

    def pieces(self, first: int, stop: int) -> Iterator[Piece]:
        """Slices `first` to `stop`, `PIECE_SLICES` at a time, as the driver gathers them."""
        for low in range(first, stop, PIECE_SLICES):
            high = min(low + PIECE_SLICES, stop)
            rows = self.slices.where(F.col("slice").between(low, high - 1)).collect()
            bits = np.zeros((high - low) << (SLICE_BITS - 3), np.uint8)
            for row in rows:
                at = (row["slice"] - low) << (SLICE_BITS - 3)
                bits[at : at + (1 << (SLICE_BITS - 3))] |= np.frombuffer(row["bits"], np.uint8)
            gram = np.frombuffer(b"".join(row["grams"] for row in rows), np.uint64)
            n = np.frombuffer(b"".join(row["n"] for row in rows), np.int64)
            order = np.argsort(gram, kind="stable")
            yield Piece(low, high, self.count, bits, gram[order], n[order])

    def segments(self) -> Iterator[tuple[int, int]]:
        """First slice and end of each segment."""
        for first in range(0, self.count, self.per_segment):
            yield first, min(first + self.per_segment, self.count)


def fit(rows: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count the n-grams of up to `order` tokens of all rows and build the filter; everything stays in the shared folder."""
    column_names(rows, text)
    counted = materialize(counts(rows.select(F.col(f"`{text}`").alias("text")), order), "ngrams")
    unigram = F.col("gram").bitwiseAND(F.lit(1)) == 1
    level = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BASE)) + 1e-9) + 1
    facts = counted.agg(
        F.sum(F.when(unigram, F.col("n"))).alias("tokens"), F.count_if(unigram).alias("vocabulary"), F.sum(level).alias("entries")
    ).first()
    count = max(1, -(-(facts["entries"] or 0) * BITS // (1 << SLICE_BITS)))
    total = (count << (SLICE_BITS - 3)) + facts["vocabulary"] * _EXACT_BYTES
    parts = -(-total // SEGMENT_BYTES)
    built = materialize(filter_slices(counted, count), "filter")
    return Model(built, count, -(-count // parts), facts["tokens"] or 0, facts["vocabulary"], order)


def _log_sums(levels: list[np.ndarray], bounds: np.ndarray, place: np.ndarray, end: int, tokens: int, vocabulary: int) -> np.ndarray:
    """Log10 probabilities of texts from the levels of their n-grams, by length; `end` is the level of the end."""
    shorter = VALUES[levels[0]]
    before = np.roll(shorter, 1)
    before[bounds[:-1]] = VALUES[end]
    p = (shorter + 1) / (tokens + vocabulary + 1)
    for length, level in enumerate(levels[1:], 2):
        count = np.minimum(VALUES[level], np.minimum(shorter, before))
        p = np.where(place >= length - 2, (count + MU * p) / (before + MU), p)
        shorter, before = count, np.roll(count, 1)
    return np.add.reduceat(np.log10(p), bounds[:-1])


def _looked_up(gram: np.ndarray, pieces: list[Piece], what: Callable[[Piece, np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """What the pieces say of sorted different n-grams, 0 where none has them; a piece's n-grams are next to each other."""
    out = np.zeros(len(gram), kind)
    for piece in pieces:
        low, high = np.searchsorted(_slice_of(gram, piece.slices), (piece.first, piece.stop))
        if low < high:
            out[low:high] = what(piece, gram[low:high])
    return out


@dataclass
class _Probed:
    """What pieces say of some texts: levels by length of the n-grams, and for each text its known tokens and sum of log10(c + 1)."""

    levels: list[np.ndarray]
    bounds: np.ndarray
    place: np.ndarray
    known: np.ndarray
    base: np.ndarray

    @property
    def end(self) -> int:
        """Level of the end, the last token of every text."""
        return int(self.levels[0][self.bounds[1] - 1])


def _probed(texts: list[str | None], hashes: WordHashes, pieces: list[Piece], order: int) -> _Probed:
    found, bounds, place = grams([spaced_words(t) for t in texts], hashes, order)
    levels, n = [], None
    for gram in found:
        different, back = np.unique(gram, return_inverse=True)
        levels.append(_looked_up(different, pieces, Piece.levels, np.uint8)[back])
        if n is None:
            n = _looked_up(different, pieces, Piece.exact, np.int64)[back]
    known = np.add.reduceat((n > 0).astype(np.int64), bounds[:-1])
    return _Probed(levels, bounds, place, known, np.add.reduceat(np.log10(n + 1.0), bounds[:-1]))


_SCORES = "doc {kind}, n_tokens long, n_known long, base_score double, score double"
_PARTS = "doc {kind}, print binary, segment int, end_level int, n_known long, base double, levels binary"


def _scored(rows: DataFrame, kind: DataType, model: Model, sent: list[Broadcast]) -> DataFrame:
    """Scores of every text, where the filter is one segment."""
    order, tokens, vocabulary = model.order, model.tokens, model.vocabulary
    log_all = float(np.log10(tokens + vocabulary + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pieces = WordHashes(), [piece.value for piece in sent]
        for batch in slices(batches, size=TEXT_BYTES):
            got = _probed(batch.column(1).to_pylist(), hashes, pieces, order)
            sizes = np.diff(got.bounds)
            total = _log_sums(got.levels, got.bounds, got.place, got.end, tokens, vocabulary)
            columns = [batch.column(0), *map(pa.array, (sizes, got.known, got.base - sizes * log_all, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, _SCORES.format(kind=kind.simpleString()))


def _passed(rows: DataFrame, kind: DataType, order: int, number: int, sent: list[Broadcast]) -> DataFrame:
    """What one of several segments says of every text: known tokens, its part of the base score, and levels (0 outside of it)."""
    types = [to_arrow_type(kind), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, pieces = WordHashes(), [piece.value for piece in sent]
        for batch in slices(batches, size=TEXT_BYTES):
            texts = batch.column(1).to_pylist()
            got = _probed(texts, hashes, pieces, order)
            prints = [hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
            cut = [b"".join(x[a:b].tobytes() for x in got.levels) for a, b in zip(got.bounds[:-1], got.bounds[1:])]
            columns = [prints, [number] * len(texts), [got.end] * len(texts), got.known, got.base, cut]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:]))],
                names=["doc", "print", "segment", "end_level", "n_known", "base", "levels"],
            )

    return rows.mapInArrow(run, _PARTS.format(kind=kind.simpleString()))


def _joined(parts: DataFrame, kind: DataType, model: Model) -> DataFrame:
    """Scores from what the passes over several segments left."""
    order, tokens, vocabulary = model.order, model.tokens, model.vocabulary
    log_all = float(np.log10(tokens + vocabulary + 1))
    names = ("doc", "n_tokens", "n_known", "base_score", "score")
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        read = (row for batch in slices(batches, size=TEXT_BYTES) for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (_, doc), same in groupby(read, key=lambda row: (row[1], row[0])):
            found, copies = {}, 0
            for row in same:
                found[row[2]] = row
                copies += row[2] == 0
            levels = np.max([np.frombuffer(row[6], np.uint8) for row in found.values()], axis=0).reshape(order, -1)
            size = levels.shape[1]
            end = max(row[3] for row in found.values())
            total = _log_sums([*levels], np.array([0, size]), np.arange(size), end, tokens, vocabulary)[0]
            base = sum(row[5] for row in found.values()) - size * log_all
            out += [(doc, size, sum(row[4] for row in found.values()), base, float(total))] * copies
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    together = parts.repartition("print").sortWithinPartitions("print", "doc", "segment")
    return together.mapInArrow(run, _SCORES.format(kind=kind.simpleString()))


def score(documents: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc`, n_tokens, n_known, base_score and score of every row, written to the shared folder."""
    column_names(documents, doc, text)
    kind = documents.schema[doc].dataType
    rows = documents.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    context = documents.sparkSession.sparkContext
    segments = [*model.segments()]
    parts = []
    for number, (first, stop) in enumerate(segments):
        sent = [context.broadcast(piece) for piece in model.pieces(first, stop)]
        alone = len(segments) == 1
        passed = _scored(rows, kind, model, sent) if alone else _passed(rows, kind, model.order, number, sent)
        parts.append(materialize(passed, "scores" if alone else "levels"))
        for piece in sent:
            piece.destroy()
    out = parts[0] if len(parts) == 1 else _joined(reduce(DataFrame.unionByName, parts), kind, model)
    return out.withColumnRenamed("doc", doc)
