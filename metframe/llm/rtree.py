"""A Jaccard join of documents by R-trees over count vectors of their shingles.

A document's shingles are hashed into groups, and the counts of its groups are its point. Two sets share at most the sum of the smaller counts of every group,
so a box, of which the largest counts and the least and largest set sizes are known, is left out for a point if that sum, taken with the
box's largest counts, is less than the threshold asks of the sizes. Points that pass are verified on the full sets.

1. Equal sets are one node, named by a 64-bit hash of the set. Only nodes go on.
2. The join is dealt out by shared shingles. Each set is put in order by how often the groups of its shingles occur in the corpus (`LOAD_BITS`
   counters, whatever the corpus size), rarest first; two sets that reach the threshold share one of the first n - ceil(n p / 100) + 1 of
   each. Nodes that share such a shingle are a shard. What two sets share from their first common shingle on is at most what either has from there
   on, so a node stays in a shard only if, by sizes and places of the shingle, another one of it may be near. Of shards with
   equal members the one of the earliest shingle is left, so that a near pair still meets in its first common one.
3. Shards of more than `HOT_NODES` nodes hold groups of copies; there the nodes whose points allow it are first compared with the shard's
   head, the node that meets most others. Shards whose nodes are then of one component are done.
4. The nodes of all other shards are joined by an R-tree built over their points. Boxes whose points are all of the asking point's
   component are left out too, so a group of copies is not compared pair by pair. A shard of more than `BLOCK_NODES` nodes, or `BLOCK_BYTES` of points, is cut into
   blocks by hash, and each pair of blocks is a task's work; all rows take part at every size. Rows bring along the earlier shards of their node, so a pair
   that meets in many shards comes out of the first one only.
5. Pairs that pass are verified on the full sets, and components are found by repeated minima.

Defined cases: a document without words or text has an empty set and is its own component. One with fewer words than a shingle has the whole
sequence as its only shingle. Every row is judged by its own set; rows of one id are linked with each other through that id. A null id is in no
component and links nothing. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metframe.llm.common import WordHashes, column_names, one_row_per_id, slices, spaced_words
from metframe.llm.minmax import components, shingles
from metframe.session import materialize

#: Counters of how often the groups of shingles occur, and how many are sent in a row.
LOAD_BITS, _LOAD_SLICE = 18, 4096
#: Shingles a group of a point should have at least, and the groups of the smallest point.
GROUP_SHINGLES, LEAST_GROUPS = 1, 16
HOT_NODES, HEAD_ROUNDS = 16, 2
BLOCK_NODES, BLOCK_BYTES = 8192, 16 << 20
#: Bits that tell which texts or nodes are wanted, 4 MiB.
WANTED_BITS = 25
#: Rows of a shingle that are held to find out which of them may be near; of a shingle with more all rows stay.
HELD_ROWS = 1 << 18
#: Earlier shards of pairs that are compared at a time.
_EARLIER = 1 << 22
#: Entries of a box of the R-tree, and queries compared at a time.
FAN_OUT, _QUERIES = 16, 256


def node_of(found: np.ndarray) -> int:
    """The name of a set."""
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def _loads(rows: DataFrame, words: int) -> np.ndarray:
    """How many texts have a shingle of each group; summed in tasks, so that the driver gets the counters once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = WordHashes(), np.zeros(1 << LOAD_BITS, np.int64)
        for batch in slices(batches):
            found = np.concatenate([shingles(spaced_words(text), hashes, words) for text in batch.column(0).to_pylist()])
            held += np.bincount((found >> np.uint64(64 - LOAD_BITS)).astype(np.int64), minlength=len(held))
        parts = np.minimum(held, np.iinfo(np.int32).max).astype(np.int32).reshape(-1, _LOAD_SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["slice", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[at] = held.get(at, 0) + np.frombuffer(part.as_buffer(), np.int32).astype(np.int64)
        columns = [pa.array(held.keys(), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["slice", "n"])

    sums = rows.select("text").mapInArrow(counted, "slice int, n binary").repartition("slice").mapInArrow(summed, "slice int, n binary")
    out = np.zeros((1 << LOAD_BITS, ), np.int64).reshape(-1, _LOAD_SLICE)
    for row in sums.collect():
        out[row["slice"]] = np.frombuffer(row["n"], np.int64)
    return out.reshape(-1)


def _prefixes(rows: DataFrame, loads: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc, n, node (null if the set is empty), the rarest shingles of every row, enough that near sets share one, and its point."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("rarest", pa.list_(pa.int64())), ("point", pa.binary())])
    sent = rows.sparkSession.sparkContext.broadcast(loads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, load = WordHashes(), sent.value
        for batch in slices(batches):
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(spaced_words(text), hashes, words)
                n = len(found)
                if not n:
                    out.append((doc, 0, None, None, None))
                    continue
                often = load[(found >> np.uint64(64 - LOAD_BITS)).astype(np.int64)]
                order = np.argsort(often, kind="stable")  # `found` is sorted, so ties go by hash
                taken = found[order[: n + (-n * percent) // 100 + 1]]
                out.append((doc, n, node_of(found), taken.view(np.int64), point_of(found).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return rows.mapInArrow(run, "doc long, n long, node long, rarest array<long>, point binary")


def groups_of(n: int) -> int:
    """Groups of the point of a set of `n` shingles: a power of two, so that points of unlike sets can be folded to the smaller."""
    return max(LEAST_GROUPS, 1 << max(1, n // GROUP_SHINGLES).bit_length() - 1)


def point_of(found: np.ndarray) -> np.ndarray:
    """Counts of a set's groups, which are told by the lowest bits."""
    count = groups_of(len(found))
    counts = np.bincount((found & np.uint64(count - 1)).astype(np.int64), minlength=count)
    return counts.astype(np.min_scalar_type(counts.max()))


def read_point(packed: pa.Buffer, n: int) -> np.ndarray:
    """The point of a set of `n` shingles from its bytes; their number tells how wide a count is."""
    return np.frombuffer(packed, f"u{packed.size // groups_of(n)}")


def folded(point: np.ndarray, count: int) -> np.ndarray:
    return point.reshape(-1, count).sum(axis=0)


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """node and its set as packed sorted hashes."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 256):
            found = [x for x in (shingles(spaced_words(t), hashes, words) for t in batch.column(1).to_pylist()) if len(x)]
            columns = ([node_of(x) for x in found], [x.tobytes() for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return rows.mapInArrow(run, "node long, shingles binary")


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose points allow the threshold."""
    nodes = _picked(nodes.select("node", "n", "point"), "node", pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("point_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("point_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for n, x, m, y in zip(batch["n_a"].to_pylist(), batch["point_a"], batch["n_b"].to_pylist(), batch["point_b"]):
                one, two = read_point(x.as_buffer(), n), read_point(y.as_buffer(), m)
                count = min(len(one), len(two))
                good.append((100 + percent) * int(np.minimum(folded(one, count), folded(two, count)).sum()) >= percent * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in range(2)], schema=schema)

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "point_a", "n_b", "point_b")
    return both.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets meet the threshold."""
    left = found.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = found.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(one) + len(two) - len(np.union1d(one, two))
                good.append((100 + percent) * shared >= percent * (len(one) + len(two)))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in range(2)], schema=schema)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


class RTree:
    """Points in order of component and size, and boxes over `FAN_OUT` neighbours, level by level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> None:
        self.order = np.lexsort((sizes, comps))
        #: For each level, from the points up: largest counts, least and largest size, the component of all or none, which `one` tells.
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order], comps[self.order], np.ones(len(points), bool))]
        while len(self.levels[-1][0]) > FAN_OUT:
            most, low, high, comp, one = self.levels[-1]
            starts = np.arange(0, len(most), FAN_OUT)
            same = np.logical_and.reduceat(one & (comp == comp[np.arange(len(comp)) // FAN_OUT * FAN_OUT]), starts)
            box = (np.maximum.reduceat(most, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), comp[starts], same)
            self.levels.append(box)

    def reach(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (asking point, point of the tree) of different components that the bound leaves."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start in range(0, len(points), _QUERIES):
            stop = min(start + _QUERIES, len(points))
            top = len(self.levels) - 1
            open_boxes = [(top, 0, len(self.levels[top][0]), np.arange(start, stop))]
            while open_boxes:
                level, first, end, rows = open_boxes.pop()
                most, low, high, comp, one = (x[first:end] for x in self.levels[level])
                asked = sizes[rows][:, None]
                left = (100 * high >= percent * asked) & (percent * low <= 100 * asked) & ~(one & (comp == comps[rows][:, None]))
                at, box = np.nonzero(left)
                if not len(at):
                    continue
                common = np.empty(len(at), np.int64)
                step = max(1, (1 << 22) // points.shape[1])
                for i in range(0, len(at), step):
                    common[i : i + step] = np.minimum(points[rows[at[i : i + step]]], most[box[i : i + step]]).sum(axis=1)
                mine = sizes[rows[at]]
                least = np.maximum(low[box], -(-mine * percent // 100))
                good = (100 + percent) * common >= percent * (mine + least)
                at, box = at[good], box[good]
                if level == 0:
                    found.append((rows[at], self.order[first + box]))
                    continue
                below = len(self.levels[level - 1][0])
                for child in np.unique(box):
                    begin = (first + int(child)) * FAN_OUT
                    open_boxes.append((level - 1, begin, min(begin + FAN_OUT, below), rows[at[box == child]]))
        return tuple(np.concatenate(x) for x in zip(*found))


def unseen(one: np.ndarray, two: np.ndarray, starts: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Which pairs of rows have no earlier shard in common; row i has `earlier[starts[i] : starts[i + 1]]`, all different."""
    counts, out = np.diff(starts), np.ones(len(one), bool)
    ends = np.cumsum(counts[one] + counts[two])
    first = 0
    while first < len(one):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + _EARLIER, "right")))
        rows, pair = np.concatenate([one[first:last], two[first:last]]), np.tile(np.arange(first, last), 2)
        size = counts[rows]
        at = np.arange(size.sum()) + np.repeat(starts[rows] - np.cumsum(size) + size, size)
        shard, pair = earlier[at], np.repeat(pair, size)
        order = np.lexsort((shard, pair))
        shard, pair = shard[order], pair[order]
        out[pair[1:][(shard[1:] == shard[:-1]) & (pair[1:] == pair[:-1])]] = False
        first = last
    return out


def reached(table: pa.Table, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller node, larger node) of the rows `left` with the rows `right` that the R-tree over `right` leaves, that may be near by the
    places of the shard's shingle, and that share no earlier shard."""
    nodes, sizes, comps, places = (table[c].to_numpy() for c in ("node", "n", "comp", "place"))
    points = [read_point(p.as_buffer(), n) for p, n in zip(table["point"], sizes.tolist())]
    count = min(map(len, points))
    flat = np.array([folded(p, count) for p in points], np.int32)
    tree = RTree(flat[right], sizes[right], comps[right])
    one, two = tree.reach(flat[left], sizes[left], comps[left], percent)
    one, two = left[one], right[two]
    most = most_size(sizes, places, percent)
    good = (sizes[one] <= most[two]) & (sizes[two] <= most[one])
    one, two = one[good], two[good]
    lists = table["earlier"].combine_chunks()
    starts = lists.offsets.to_numpy().astype(np.int64)
    good = unseen(one, two, starts, lists.values.to_numpy())
    a, b = nodes[one[good]], nodes[two[good]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return tuple(pairs[:, pairs[0] != pairs[1]])


def _joined(rows: DataFrame, percent: int) -> DataFrame:
    """Different pairs (a, b) that the R-trees of the shards leave, of rows (token, one, two, side, node, n, comp, place, earlier, point): a tree over side 1,
    asked by side 0, or by itself where blocks one and two are the same."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            side = table["side"].to_numpy()
            right = np.flatnonzero(side == 1)
            left = np.flatnonzero(side == 0) if key[1] != key[2] else right
            a, b = reached(table, left, right, percent) if len(left) and len(right) else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(3)]
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            cuts = np.flatnonzero(np.r_[True, new, True])
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                mine = tuple(int(c[start]) for c in columns)
                if mine != key and held:
                    yield done()
                    held = []
                key = mine
                held.append(batch.slice(start, stop - start))
        if held:
            yield done()

    dealt = rows.select("token", "one", "two", "side", "node", "n", "comp", "place", "earlier", "point").repartition("token", "one", "two")
    return dealt.sortWithinPartitions("token", "one", "two").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (token, node, n, place, comp) with their points and the earlier shards of their nodes, dealt to pairs of blocks of their shard: (one, two), and
    their side."""
    size = F.greatest("n", F.lit(LEAST_GROUPS))  # a point has about a byte for a shingle, at most
    sizes = rows.groupBy("token").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum(size) / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    cut = materialize(sizes.where("blocks > 1"), "cut-shards")
    shards = F.array_sort(F.collect_list(F.struct("place", "token"))).alias("shards")  # of a node, so no more than its set has shingles
    held = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), shards)
    points = _picked(nodes.select("node", "point"), "node", rows.select("node"))
    rows = held.join(points, "node").select("*", F.posexplode("shards").alias("at", "mine"))
    rows = rows.select("node", "n", "comp", "point", "mine.*", F.slice(F.col("shards.token"), F.lit(1), F.col("at")).alias("earlier"))
    rows = rows.join(cut, "token", "left")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    side = lambda x: F.struct(F.least(block, x).alias("one"), F.greatest(block, x).alias("two"), (block >= x).cast("int").alias("side"))
    whole = F.array(F.struct(F.lit(0).alias("one"), F.lit(0).alias("two"), F.lit(1).alias("side")))
    pairs = F.when(F.col("blocks").isNull(), whole).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), side))
    return rows.withColumn("dealt", F.explode(pairs)).select("token", "dealt.*", "node", "n", "comp", "place", "earlier", "point")


def most_size(sizes: np.ndarray, places: np.ndarray, percent: int) -> np.ndarray:
    """The size that a set near these may have at most, if the shingle at this place is the first they share; a pair must meet that of both."""
    return (100 + percent) * (sizes - places) // percent - sizes


def partnered(tokens: np.ndarray, sizes: np.ndarray, places: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have another one of their token that meets `most_size` with them; rows are in order of token and size."""
    group = np.cumsum(np.r_[False, tokens[1:] != tokens[:-1]])
    most = most_size(sizes, places, percent)
    base = group * (int(max(sizes.max(), most.max())) + 2)  # so that values of a later group are larger
    # the largest of `most` in a group so far, and the second largest; what is of a group before is below `base`
    value = base + most
    top = np.maximum.accumulate(value)
    second = np.maximum.accumulate(np.r_[np.int64(-1), np.minimum(value[1:], top[:-1])])
    # rows of the group that are small enough come before `end`
    end = np.searchsorted(base + sizes, value, "right") - 1
    at = np.arange(len(tokens))
    best = np.where((at <= end) & (value == top[end]), second[end], top[end])
    return (end >= 0) & (best >= base + sizes)


def _shared(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, node, n, place) but those that can't be near another one of their token; one shuffle, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, np.nan  # rows of the last token so far; the token of which all rows stay
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            token, n, place = (batch.column(i).to_numpy() for i in (0, 2, 3))
            last, whole = int(np.searchsorted(token, token[-1])), token == large
            if len(token) - last > HELD_ROWS:
                large = token[-1]
            stop = len(token) if token[-1] == large else last
            if stop:
                whole |= token == large
                yield batch.slice(0, stop).filter(pa.array(partnered(token[:stop], n[:stop], place[:stop], percent) | whole[:stop]))
            held = batch.slice(stop) if stop < len(token) else None
        if held is not None:
            yield held.filter(pa.array(partnered(*(held.column(i).to_numpy() for i in (0, 2, 3)), percent)))

    rows = rows.select("token", "node", "n", F.col("place").cast("long").alias("place")).repartition("token").sortWithinPartitions("token", "n")
    return rows.mapInArrow(run, "token long, node long, n long, place long")


def _shards(nodes: DataFrame, percent: int) -> DataFrame:
    """token, node, n, place and size of the shards: nodes that share one of their rarest shingles and may be near another by its places; of shards with
    equal members the one of the earliest shingle, whose places are the smallest."""
    rows = nodes.select("node", "n", F.posexplode("rarest").alias("place", "token"))
    rows = materialize(_shared(rows, percent), "shared-shingles")
    low = F.sum(F.shiftrightunsigned(F.xxhash64("node"), 24))
    members = rows.groupBy("token").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("mixed"), low.alias("low"), F.sum("place").alias("places")
    )
    chosen = members.groupBy("size", "mixed", "low").agg(F.min(F.struct("places", "token")).alias("first")).select("size", F.col("first.token").alias("token"))
    return materialize(rows.join(chosen, "token"), "shards")


def _headed(rows: DataFrame) -> DataFrame:
    """Rows (token, node, n, place, size) but the head of each shard, with the head: the node that meets most others."""
    met = rows.groupBy("node").agg((-F.sum("size")).alias("met"))
    heads = rows.join(met, "node").groupBy("token").agg(F.min(F.struct("met", "node")).alias("head"))
    rows = rows.join(heads, "token").select("token", "node", "n", "place", "size", F.col("head.node").alias("head"))
    return rows.where(F.col("node") != F.col("head"))


def _with_components(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comps.withColumnsRenamed({"doc": "node", "component": "found"}), "node", "left").withColumn("comp", F.coalesce("found", "node")).drop("found")


def _open(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows of shards whose nodes are of more than one component, with these."""
    rows = _with_components(rows, comps)
    mixed = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return rows.join(mixed.select("token"), "token", "left_semi")


def _marked(rows: DataFrame, key: str, wanted: DataFrame, how: str = "left") -> DataFrame:
    """The rows, with `marked`: whether their key is in the column of `wanted`, or one of few others: keys are told by bits of a field of
    `WANTED_BITS`, so what is broadcast has the same bound at every size, and the rows are not shuffled."""
    bit = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << WANTED_BITS))
    marks = wanted.select(bit(wanted.columns[0]).alias("bit"))
    words = marks.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("marks"))
    words = materialize(words, "wanted-bits")
    placed = rows.withColumn("bit", bit(key)).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(words), "word", how)
    marked = F.expr("coalesce(shiftright(marks, CAST(bit % 64 AS INT)) & 1, 0L) = 1")
    return placed.withColumn("marked", marked).drop("bit", "word", "marks")


def _picked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key is wanted, and few others."""
    return _marked(rows, key, wanted, "inner").where("marked").drop("marked")


def _sets_of(chosen: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The sets of chosen nodes, and of few others; a node has one row at least."""
    docs = nodes.select("node", "doc").join(chosen.distinct(), "node", "left_semi")
    return materialize(_sets(_picked(texts, "doc", docs.select("doc")), words), "sets")


def _one_row_per_node(named: DataFrame) -> DataFrame:
    """node, n, doc (its smallest), rarest and point; only rows of nodes that have several, and few others, are shuffled."""
    several = materialize(named.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1").select("node"), "repeated-nodes")
    marked = _marked(named.select("node", "n", "doc", "rarest", "point"), "node", several)
    facts = [F.any_value(c).alias(c) for c in ("n", "rarest", "point")]
    folded = marked.where("marked").groupBy("node").agg(F.min("doc").alias("doc"), *facts)
    return materialize(marked.where("NOT marked").drop("marked").unionByName(folded), "nodes")


def links(nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of near nodes, enough of them that nodes linked by all near pairs are linked by these; `nodes` is (node, n, doc, rarest, point),
    `texts` (doc, text)."""
    shards = _shards(nodes, percent)
    hot, small = shards.where(F.col("size") > HOT_NODES), shards.where(F.col("size") <= HOT_NODES)
    linked, comps = None, None
    for _ in range(HEAD_ROUNDS):
        if hot.isEmpty():
            break
        hot = materialize(_headed(hot), "headed")
        asked = hot.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
        if comps is not None:
            asked = _with_components(asked.withColumnRenamed("a", "node"), comps).withColumnsRenamed({"node": "a", "comp": "of_a"})
            asked = _with_components(asked.withColumnRenamed("b", "node"), comps).withColumnRenamed("node", "b").where("comp <> of_a")
        asked = materialize(_bounded(asked.select("a", "b"), nodes, percent), "asked")
        found = _sets_of(asked.select(F.explode(F.array("a", "b")).alias("node")), nodes, texts, words)
        fresh = materialize(_verified(asked, found, percent).distinct(), "head-links")
        if not fresh.isEmpty():
            linked = fresh if linked is None else linked.unionByName(fresh)
            comps = components(linked)
        # the head has been compared with all others of its shard
        hot = materialize(_open(hot.drop("head"), comps).drop("comp"), "open-shards")

    rest = materialize(_open(small.unionByName(hot), comps), "rest")
    pairs = materialize(_joined(_blocks(rest, nodes), percent), "pairs")
    found = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes, texts, words)
    fresh = _verified(pairs, found, percent)
    return materialize(fresh if linked is None else linked.unionByName(fresh), "near-nodes")


def near_classes(documents: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """`doc`, n_shingles and component_id of every row; `doc` is an integer."""
    column_names(documents, doc, text)
    rows = documents.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    signed = materialize(_prefixes(rows, _loads(rows, words), words, percent), "prefixes")
    named = signed.where("doc IS NOT NULL AND node IS NOT NULL")
    nodes = _one_row_per_node(named)
    texts = one_row_per_id(rows.where("doc IS NOT NULL"), "doc", "text")
    pairs = links(nodes, texts, words, percent)

    # rows of one id are linked through it
    several = named.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("high")).where("a < high").select("doc", "a")
    own = named.select("doc", F.col("node").alias("b")).join(several, "doc").where("a < b").select("a", "b").distinct()
    comps = components(pairs.unionByName(own)).select(F.col("doc").alias("node"), "component")
    placed = comps.join(nodes.select("node", "doc"), "node")
    placed = materialize(placed, "placed")
    placed = placed.join(placed.groupBy("component").agg(F.min("doc").alias("smallest")), "component").select("node", "smallest")
    alone = nodes.select("node", F.col("doc").alias("first"))
    out = signed.select("doc", "n", "node").join(alone, "node", "left").join(placed, "node", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("smallest", "first", "doc"))
    return out.select(F.col("doc").alias(doc), F.col("n").alias("n_shingles"), component.alias("component_id"))
