"""Near duplicates by min-max hashing: banded signatures find pairs, full shingle sets confirm them.

Every permutation gives two signature values, the minimum and the maximum over a document's shingles, so `BANDS` x `ROWS` values
cost half as many hash evaluations. Bands of `ROWS` values are the buckets, of fewer where `percent` is below 80. At a similarity of
0.8 a pair shares no bucket with a probability of 5e-7, at that of a lower threshold of 1e-6 at most; every link that is reported is confirmed on the full sets.

1. Documents with equal sets are one node, named by the smallest id; only nodes go on.
2. Star rounds: in every bucket all nodes are compared with its head, the node that meets most others, so a bucket of copies costs one
   comparison per copy, not one per pair of copies. Heads are then done with; buckets whose other nodes are one component are too.
3. What is left are nodes of different components in one bucket. They are joined on the bucket under conditions that a pair of the
   threshold meets: on sizes, on a sketch, and on what both share with the first head, h, of the bucket: |x & y| is at most
   min(|x & h|, |y & h|) and what x - h and y - h share, which bitmaps of them bound. Pairs that pass are confirmed on the full sets.
4. Components by repeated minima of labels with pointer jumping, on tables in the shared folder.

All shuffles are of small rows (bucket, node, sizes) or of the sets of nodes that are compared. Joins are plain equi-joins whose
skewed partitions Spark splits; buckets are streamed, never collected.

Defined cases: a document without words has an empty set, is linked with nothing and is its own component. One with fewer words than a shingle has
the whole sequence as its only shingle. Rows that repeat an id and its text are one document. Different texts of an id are documents of
their own, named by a 64-bit hash while they are compared: each is kept unless it is a copy, of groups of copies the one of the smallest id, then
hash. As they share an id, they and what is linked with any of them have one component_id. A null id is no node: its component
is null and it is kept. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metframe.llm.common import WordHashes, chain, column_names, mix, slices, spaced_words
from metframe.session import materialize

BANDS, ROWS = 48, 6
PERMUTATIONS = BANDS * ROWS // 2
#: Bits of the sketch, and how many may differ: at a similarity of 0.8 a bit differs with a probability of 0.1, so 62 of 288 are
#: six and a half standard deviations above the 29 expected.
SKETCH_BITS, SKETCH_LIMIT = BANDS * ROWS, 62
#: Bits of the bitmap of what a node has and its head has not.
MAP_BITS = 512
STAR_ROUNDS = 2
#: The probability, at most, with which a pair of the threshold may share no bucket.
MAX_MISS = 1e-6
#: Ids sent to all tasks to pick the texts whose sets are needed; beyond, they are joined.
SENT_IDS = 1_000_000
_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 2**64, PERMUTATIONS, np.uint64)
_FACTOR = _RNG.integers(0, 2**64, PERMUTATIONS, np.uint64) | np.uint64(1)


def shingles(words: list[bytes], hashes: WordHashes, n: int) -> np.ndarray:
    """The set of a document: sorted different 64-bit hashes of its runs of `n` words."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(chain(hashes(words), min(n, len(words))))


def signature(found: np.ndarray) -> np.ndarray:
    """Minima and maxima under all permutations; the set is not empty."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for start in range(0, len(found), 512):
        part = (found[start : start + 512, None] ^ _XOR) * _FACTOR
        np.minimum(low, part.min(axis=0), out=low)
        np.maximum(high, part.max(axis=0), out=high)
    return np.concatenate([low, high])


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


_SIGNED_TYPES = pa.schema([
    ("doc", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("buckets", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())),
])


def rows_of_band(percent: int) -> int:
    """Values of a bucket, `ROWS` or as many fewer as a lower threshold needs; all values are dealt to bands of so many."""
    for rows in range(ROWS, 0, -1):
        if BANDS * ROWS % rows == 0 and (1 - (percent / 100) ** rows) ** (BANDS * ROWS // rows) <= MAX_MISS:
            return rows
    raise ValueError(f"{percent} percent is too low for {BANDS * ROWS} signature values")


def sketch_limit(percent: int) -> int:
    """Bits of the sketch that may differ: six and a half standard deviations above what a pair of the threshold has, `SKETCH_LIMIT` at least."""
    differ = (1 - percent / 100) / 2
    return max(SKETCH_LIMIT, math.ceil(SKETCH_BITS * differ + 6.5 * math.sqrt(SKETCH_BITS * differ * (1 - differ))))


def signatures(rows: DataFrame, n: int, percent: int = 80) -> DataFrame:
    """doc, n (set size), print (of the whole set; null if empty), buckets, sketch of every row (doc, text)."""
    band = rows_of_band(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(spaced_words(text), hashes, n)
                if not len(found):
                    out.append((doc, 0, None, None, None))
                    continue
                values = signature(found)
                bands = values.reshape(-1, band)
                bucket = np.arange(1, len(bands) + 1, dtype=np.uint64)
                for row in range(band):
                    bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + bands[:, row])
                bits = np.packbits((mix(values) & np.uint64(1)).astype(np.uint8))
                sketch = np.pad(bits, (0, -len(bits) % 8)).view(np.int64)
                out.append((doc, len(found), hashlib.md5(found.tobytes()).digest(), _signed(bucket), sketch))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SIGNED_TYPES.types)], schema=_SIGNED_TYPES)

    return rows.mapInArrow(run, "doc long, n long, print binary, buckets array<long>, sketch array<long>")


def sets(rows: DataFrame, n: int) -> DataFrame:
    """doc and its set as packed sorted 64-bit hashes."""
    schema = pa.schema([("doc", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            packed = [shingles(spaced_words(t), hashes, n).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc long, shingles binary")


_FACTS = "a long, b long, near boolean, shared long, more long, hidden long, bitmap array<long>"


def _compared(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """For pairs (a, b): whether their full sets meet the threshold, how many shingles they share, how many more b has, a bitmap
    of those and how many of them it hides, as they fell on a bit that was set."""
    left = found.withColumnsRenamed({"doc": "a", "shingles": "set_a"})
    right = found.withColumnsRenamed({"doc": "b", "shingles": "set_b"})
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(("a", "b", "near", "shared", "more", "hidden", "bitmap"), types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                new = two[~np.isin(two, one, assume_unique=True)]
                shared = len(two) - len(new)
                bits = np.zeros(MAP_BITS, np.uint8)
                bits[(new >> np.uint64(20)).astype(np.int64) % MAP_BITS] = 1
                near = 100 * shared >= percent * (len(one) + len(two) - shared)
                out.append((near, shared, len(new), len(new) - int(bits.sum()), np.packbits(bits).view(np.int64)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=schema)

    return both.mapInArrow(run, _FACTS)


def _stars(rows: DataFrame) -> DataFrame:
    """(bucket, a, b, n_a, n_b) for every row (bucket, comp, doc, n) but the head a of its bucket; `same` if they are connected.

    The head is the node that meets most others over all buckets, as what many copies were made from does. Rows come sorted by
    bucket, head first; a task keeps the head of the last bucket and nothing else.
    """
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"))
    met = rows.join(sizes, "bucket").groupBy("doc").agg((-F.sum("size")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = np.zeros((4, 1), np.int64), False  # bucket, comp, doc, n of the last head
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = np.array([batch.column(i).to_numpy() for i in range(4)])
            bucket = columns[0]
            new = np.r_[not known or last[0, 0] != bucket[0], bucket[1:] != bucket[:-1]]
            at = np.cumsum(new)
            heads = np.concatenate([last, columns[:, new]], axis=1)
            _, comp, doc, n = heads[:, at]
            last, known = heads[:, at[-1:]], True
            rest = columns[2] != doc
            out = (bucket, doc, columns[2], n, columns[3], columns[1] == comp)
            yield pa.RecordBatch.from_arrays([pa.array(x[rest]) for x in out], names=["bucket", "a", "b", "n_a", "n_b", "same"])

    dealt = rows.join(met, "doc").select("bucket", "comp", "doc", "n", "rank")
    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket", "rank", "doc")
    return dealt.mapInArrow(run, "bucket long, a long, b long, n_a long, n_b long, same boolean")


def _sizes_allow(a: str, b: str, percent: int) -> Column:
    """Sets of these sizes can meet the threshold."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def components(links: DataFrame) -> DataFrame:
    """doc and component (its smallest reachable doc) for every linked node; others are left out.

    Every round takes the smallest label of the neighbours, then the label of that label.
    """
    both = links.select(F.col("a").alias("doc"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("doc"), F.col("a").alias("to")))
    both = materialize(both.distinct(), "links")
    labels = materialize(both.groupBy("doc").agg(F.least(F.col("doc"), F.min("to")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("doc", "to"), "to").groupBy("doc").agg(F.min("component").alias("near"))
        next_labels = labels.join(near, "doc").select("doc", F.least("component", "near").alias("low"), "component")
        jump = labels.select(F.col("doc").alias("low"), F.col("component").alias("far"))
        next_labels = next_labels.join(jump, "low", "left").select(
            "doc", F.least("low", "far").alias("component"), (F.least("low", "far") != F.col("component")).alias("changed")
        )
        next_labels = materialize(next_labels, "labels")
        changed = not next_labels.where("changed").isEmpty()
        labels = next_labels.drop("changed")
        if not changed:
            return labels


def near_duplicates(documents: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """`doc`, n_shingles, component_id and kept of every row; `doc` is an integer."""
    return judged(documents, doc, text, words, percent).drop("text_hash")


def judged(documents: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """As `near_duplicates`, and text_hash, xxhash64 of the text, for rows whose id has different texts; null for the others."""
    column_names(documents, doc, text)
    rows = documents.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    texts = rows.where("doc IS NOT NULL").groupBy("doc").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    several = materialize(texts.where("low < high").select("doc"), "several-texts")
    if several.isEmpty():
        found = _components_of_rows(rows, words, percent)
        kept = F.coalesce(F.col("doc") == F.col("component"), F.lit(True))
        out = found.select("doc", "n", "component", kept.alias("kept"), F.lit(None).cast("long").alias("text_hash"))
    else:
        out = _of_several(rows, several, words, percent)
    return out.withColumnsRenamed({"doc": doc, "n": "n_shingles", "component": "component_id"})


def _of_several(rows: DataFrame, several: DataFrame, words: int, percent: int) -> DataFrame:
    """doc, n, component, kept, text_hash of rows (doc, text) where the ids `several` have different texts, each a document of its own."""
    mine = several.withColumn("split", F.lit(True))
    keyed = rows.join(mine, "doc", "left").select(
        F.when(F.col("split"), F.xxhash64("doc", "text")).otherwise(F.col("doc")).alias("key"), "doc", "text", "split"
    )
    names = keyed.where("split").select("key", F.col("doc").alias("id"), F.xxhash64("text").alias("text_hash")).distinct()
    found = _components_of_rows(keyed.select(F.col("key").alias("doc"), "text"), words, percent).withColumnRenamed("doc", "key")
    found = found.join(names, "key", "left").select("key", F.coalesce("id", "key").alias("doc"), "n", "component", "text_hash")
    found = materialize(found, "texts")
    groups = found.where("doc IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc", "key")).alias("first"))

    # groups that share an id have one component
    of_ids = found.where("text_hash IS NOT NULL").select("doc", "component").distinct()
    links = of_ids.join(of_ids.groupBy("doc").agg(F.min("component").alias("a")), "doc")
    links = links.select("a", F.col("component").alias("b")).where("a <> b").distinct()
    joined = components(links).select(F.col("doc").alias("component"), F.col("component").alias("whole"))
    groups = groups.join(joined, "component", "left").withColumn("whole", F.coalesce("whole", "component"))
    groups = materialize(groups, "groups")
    groups = groups.join(groups.groupBy("whole").agg(F.min("first.doc").alias("smallest")), "whole")
    kept = F.coalesce(F.col("key") == F.col("first.key"), F.lit(True))
    return found.join(groups, "component", "left").select("doc", "n", F.col("smallest").alias("component"), kept.alias("kept"), "text_hash")


def _components_of_rows(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """doc, n, component of every row (doc, text); all rows of a doc have one text."""
    signed = materialize(signatures(rows, words, percent), "signatures")

    # documents of equal sets are one node
    prints = signed.where("doc IS NOT NULL AND print IS NOT NULL").groupBy("print").agg(F.min("doc").alias("node"))
    prints = materialize(prints, "prints")
    node = F.when(F.col("doc").isNotNull(), F.coalesce("node", "doc"))
    member = signed.select("doc", "n", "print").join(prints, "print", "left").select("doc", "n", node.alias("node"))
    node_rows = prints.select("print", F.col("node").alias("doc"))
    nodes = signed.join(node_rows, ["print", "doc"], "left_semi").select("doc", "n", "buckets", "sketch")

    # rows of buckets that hold more than one node
    by_bucket = nodes.select(F.explode("buckets").alias("bucket"), "doc", "n").withColumn("comp", F.col("doc"))
    collisions = materialize(_shared(by_bucket), "collisions")
    wanted = materialize(collisions.select("doc").distinct(), "wanted")
    few = wanted.count() <= SENT_IDS
    texts = rows.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi")
    found = materialize(sets(texts, words), "sets")

    sketches = nodes.join(F.broadcast(wanted) if few else wanted, "doc", "left_semi").select("doc", "sketch")
    sketches = materialize(sketches, "sketches")
    heads = materialize(_stars(collisions), "stars")
    stars, first, links, comps = heads, None, None, None
    for number in range(STAR_ROUNDS):
        pairs = stars.where(~F.col("same") & _sizes_allow("n_a", "n_b", percent)).select("a", "b").distinct()
        facts = materialize(_compared(_sketched(pairs, sketches, percent), found, percent), "compared")
        first = facts if first is None else first
        fresh = facts.where("near").select("a", "b")
        new = not fresh.isEmpty()
        if new:
            links = fresh if links is None else links.unionByName(fresh)
            comps = components(links)
        # heads have been compared with all others of their bucket
        rest = materialize(_others(stars, comps), "open")
        if not new or number == STAR_ROUNDS - 1 or rest.isEmpty():
            break
        stars = materialize(_stars(rest), "stars")
    if not rest.isEmpty():
        bounds = heads.select("bucket", "a", F.col("b").alias("doc")).join(first.withColumnRenamed("b", "doc"), ["a", "doc"])
        rest = rest.join(bounds.select("bucket", "doc", "shared", "more", "hidden", "bitmap"), ["bucket", "doc"], "left").join(sketches, "doc")
        facts = _compared(_cross_pairs(materialize(rest, "rest"), percent), found, percent)
        fresh = materialize(facts.where("near").select("a", "b"), "cross-links")
        if not fresh.isEmpty():
            links = fresh if links is None else links.unionByName(fresh)
            comps = components(links)
    out = member.select("doc", "n", "node")
    if links is None:
        out = out.withColumn("component", F.col("node"))
    else:
        out = out.join(comps.withColumnRenamed("doc", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return out.select("doc", "n", "component")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (bucket, comp, doc, n) of buckets with more than one row; one shuffle, streamed with one row of look-back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_shares = None, False  # the last row so far, and whether the one before it is of its bucket
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            bucket = batch.column(0).to_numpy()
            same = bucket[1:] == bucket[:-1]
            like_last, like_next = np.r_[held_shares, same], np.r_[same, False]
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array((like_last | like_next)[:-1]))
            held, held_shares = batch.slice(batch.num_rows - 1), bool(like_last[-1])
        if held_shares:
            yield held

    rows = rows.select("bucket", "comp", "doc", "n").repartition("bucket").sortWithinPartitions("bucket", "doc")
    return rows.mapInArrow(run, rows.schema)


def _others(stars: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows (bucket, comp, doc, n) of all nodes but the heads, of buckets in which these are of more than one component."""
    rows = stars.select("bucket", F.col("b").alias("doc"), F.col("n_b").alias("n"))
    if comps is None:
        rows = rows.withColumn("comp", F.col("doc"))
    else:
        rows = rows.join(comps, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return rows.join(mixed.select("bucket"), "bucket", "left_semi")


def _bits(one: Column, two: Column, count: int, join: Callable[[Column, Column], Column]) -> Column:
    """Bits that are set in what `join` makes of two arrays of 64-bit numbers."""
    return sum((F.bit_count(join(one[i], two[i])) for i in range(1, -(-count // 64))), F.bit_count(join(one[0], two[0])))


def _alike(one: Column, two: Column, percent: int) -> Column:
    """Sketches differ as little as those of a pair that meets the threshold."""
    return _bits(one, two, SKETCH_BITS, lambda x, y: x.bitwiseXOR(y)) <= sketch_limit(percent)


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    left = sketches.withColumnsRenamed({"doc": "a", "sketch": "sketch_a"})
    right = sketches.withColumnsRenamed({"doc": "b", "sketch": "sketch_b"})
    return pairs.join(left, "a").join(right, "b").where(_alike(F.col("sketch_a"), F.col("sketch_b"), percent)).select("a", "b").distinct()


def _cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different components in a bucket that can meet the threshold.

    `shared` and `more` count what a node has in common with the bucket's head and beyond it, `bitmap` marks what is beyond. What two nodes
    share beyond the head is at most the bits both have, and those of one that fell on a bit twice.
    """
    names = ("doc", "comp", "n", "sketch", "shared", "more", "hidden", "bitmap")
    one, two = (rows.select("bucket", *(F.col(c).alias(f"{c}_{side}") for c in names)) for side in "ab")

    def reaches(beyond: Column) -> Column:
        most = F.least(F.least("shared_a", "shared_b") + beyond, F.least("n_a", "n_b"))
        return F.coalesce((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")), F.lit(True))

    common = _bits(F.col("bitmap_a"), F.col("bitmap_b"), MAP_BITS, lambda x, y: x.bitwiseAND(y))
    near = (F.col("comp_a") != F.col("comp_b")) & (F.col("doc_a") < F.col("doc_b")) & _sizes_allow("n_a", "n_b", percent)
    near &= reaches(F.least("more_a", "more_b")) & reaches(common + F.least("hidden_a", "hidden_b"))
    near &= _alike(F.col("sketch_a"), F.col("sketch_b"), percent)
    return one.join(two, "bucket").where(near).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).distinct()
