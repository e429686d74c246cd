"""Lexical retrieval packing: documents that share rare terms go into the same training sequences.

A task reads its documents in shards of about `shard_tokens` ids and builds a BM25 inverted index of each. A seed document opens
a window of `window` ids; the index returns its unused neighbours, by all terms of its part in the window, best first, which
fill it. A document that doesn't fit is cut, and its rest opens the next window, as the seed. Without neighbours the next unused document is taken. The open
window passes on to the next shard; what is left at a task's end is cut into sequences whose lengths are powers
of two, which need no padding. So all sequences are full, and each id lies in exactly one piece.

Nothing is shuffled and no group is formed, so common words, copies and hot sources don't concentrate; a task holds one
shard, however many rows its partition has. Shards follow the partitions of the input: what shares one is packed together.

Defined cases: null or empty texts are the end id alone. Rows are packed one by one, so repeated rows and null ids are kept. Neighbours
of equal score are taken in input order. An empty table gives no pieces. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from metframe.llm.common import column_names, slices
from metframe.llm.tokens import ByteBpe

WINDOW = 2048
SHARD_TOKENS = 2_000_000
#: BM25: term saturation and length normalisation.
K1, B = 1.2, 0.75
#: A term of one in so many documents of a shard is kept as a row of weights.
COMMON = 16


class Index:
    """BM25 inverted index of one shard, over token ids as terms.

    Terms of at least one in `COMMON` documents are rows of a matrix, the others posting lists; both lose the documents that are used.
    """

    def __init__(self, documents: list[np.ndarray]) -> None:
        count = len(documents)
        lengths = np.fromiter(map(len, documents), np.int64, count)
        owner = np.repeat(np.arange(count), lengths)
        flat = np.concatenate(documents).astype(np.int64) if documents else np.zeros(0, np.int64)
        pairs, tf = np.unique(flat * count + owner, return_counts=True)
        terms, doc = np.divmod(pairs, max(count, 1))
        self._terms, df = np.unique(terms, return_counts=True)
        idf = np.log1p((count - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean(), 1)) if count else lengths
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[doc])
        number = np.repeat(np.arange(len(df)), df)
        common = df * COMMON >= count
        self._row = np.where(common, np.cumsum(common) - 1, -1)
        self._matrix = np.zeros((int(common.sum()), count), np.float32)
        of_matrix = common[number]
        self._matrix[self._row[number[of_matrix]], doc[of_matrix]] = weight[of_matrix]
        self._number, self._doc, self._weight = number[~of_matrix], doc[~of_matrix], weight[~of_matrix]
        self._live = np.arange(count)
        self._bounds()

    def _bounds(self) -> None:
        self._first = np.searchsorted(self._number, np.arange(len(self._terms) + 1))

    def _without(self, unused: np.ndarray) -> None:
        """Leave the used documents out."""
        stays = unused[self._live]
        self._matrix = self._matrix[:, stays]
        listed = stays[self._doc]
        self._doc = (np.cumsum(stays) - 1)[self._doc[listed]]
        self._number, self._weight = self._number[listed], self._weight[listed]
        self._live = self._live[stays]
        self._bounds()

    def neighbours(self, ids: np.ndarray, unused: np.ndarray) -> list[int]:
        """Unused documents that share a term with the ids of a window, best first."""
        if unused.sum() * 4 < len(self._live) * 3:
            self._without(unused)
        wanted = np.unique(ids)
        term = np.searchsorted(self._terms, wanted)
        term = term[self._terms[np.minimum(term, len(self._terms) - 1)] == wanted] if len(self._terms) else term[:0]
        row = self._row[term]
        rare = term[row < 0]
        start, size = self._first[rare], self._first[rare + 1] - self._first[rare]
        posting = np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)
        scores = self._matrix[row[row >= 0]].sum(axis=0) + np.bincount(self._doc[posting], self._weight[posting], len(self._live))
        scores[~unused[self._live]] = 0
        found = np.flatnonzero(scores)
        return self._live[found[np.argsort(-scores[found], kind="stable")]].tolist()


class Packer:
    """Windows of one task; `pieces` collects (document, start, ids, document's ids, sequence, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW) -> None:
        self.window, self.sequence = window, first_sequence
        self._open: list[tuple] = []
        self._used = 0
        self.pieces: list[tuple] = []

    def shard(self, keys: list, documents: list[np.ndarray]) -> None:
        index = Index([ids[:-1] for ids in documents])  # all have the end id
        unused = np.ones(len(documents), bool)
        queue: list[int] = []
        for first in range(len(documents)):
            if not unused[first]:
                continue
            seed = first
            while seed is not None:
                unused[seed] = False
                opened = self._add(keys[seed], documents[seed])
                if opened or not queue:
                    queue = index.neighbours(self._open[-1][2] if opened else documents[seed], unused)[::-1]
                seed = None
                while queue and seed is None:
                    seed = queue.pop()
                    if not unused[seed]:
                        seed = None

    def _add(self, key: object, ids: np.ndarray) -> bool:
        """Put a document into the open window and further ones; whether its rest has opened a window."""
        start, opened = 0, False
        while start < len(ids):
            opened = not self._used
            taken = min(self.window - self._used, len(ids) - start)
            self._open.append((key, start, ids[start : start + taken], len(ids)))
            self._used += taken
            start += taken
            if self._used == self.window:
                self._close(self.window)
                opened = False
        return opened

    def _close(self, length: int) -> None:
        """Move the first `length` ids of the open window to a sequence."""
        offset, rest = 0, []
        for key, start, ids, total in self._open:
            taken = min(length - offset, len(ids))
            if taken:
                self.pieces.append((key, start, ids[:taken], total, self.sequence, offset))
                offset += taken
            if taken < len(ids):
                rest.append((key, start + taken, ids[taken:], total))
        self._open, self._used = rest, self._used - length
        self.sequence += 1

    def finish(self) -> None:
        while self._used:
            self._close(1 << (self._used.bit_length() - 1))

    def taken(self) -> list[tuple]:
        out, self.pieces = self.pieces, []
        return out


def pack(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1,
    vocabulary: str | None = None, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pieces of all documents: `doc`, start, length, ids (little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset."""
    column_names(documents, doc, text)
    kind = documents.schema[doc].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(("doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"), types)))

    def batches_of(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pieces), 2048):
            key, start, ids, total, sequence, offset = zip(*pieces[at : at + 2048])
            columns = (key, start, list(map(len, ids)), [x.astype("<u4").tobytes() for x in ids], total, sequence, offset)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = ByteBpe(vocabulary), Packer(TaskContext.get().partitionId() << 33, window)
        keys, shard, size = [], [], 0
        for batch in slices(batches, 2048):
            ids, bounds = bpe.batch(batch.column(1))
            for i, key in enumerate(batch.column(0).to_pylist()):
                keys.append(key)
                shard.append(np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)))
                size += len(shard[-1])
                if size >= shard_tokens:
                    packer.shard(keys, shard)
                    keys, shard, size = [], [], 0
                    yield from batches_of(packer.taken())
        packer.shard(keys, shard)
        packer.finish()
        yield from batches_of(packer.taken())

    rows = documents.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    out = rows.mapInArrow(
        run, f"doc {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return out.withColumnRenamed("doc", doc)
