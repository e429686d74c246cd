"""Spelling variants of a corpus, grouped by k-d trees over letter counts.

Words are runs of ASCII and Latin-1 letters, A-Z lower-cased. Two words are near if one inserted, deleted or replaced code point makes one
of the other. Such an edit moves a word's letter counts by an L1 distance of at most two: a replaced letter takes one from a count and adds
one to another, an inserted one adds one. So for each pair of lengths (L, L) and (L, L + 1), the near words of a word are found by a range
search in the k-d tree over the count vectors of the longer length: a box is left out as soon as it lies more than `up` above or `down` below
the counts, and what is found is verified letter by letter.

The trees are cut at the top. A bounded sample (`SAMPLE_WORDS`, smallest hashes) decides where; every word is then dealt to
the leaf of its counts, and as a query to each leaf that its range meets, and a task builds the rest of the tree over a leaf of about `LEAF_WORDS`
words. The cuts decide where work is done, never what is found. Searches give folded rows, a count and the best neighbour for each
query and leaf, so pairs are never shuffled.

Defined cases: a null text has no words; a null id is written as the empty text before the colon of the perturbation. Rows that repeat an id and a text
count as often as they occur. Words that tie as neighbours of largest count go by code points. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metframe.llm.common import column_names
from metframe.session import materialize

MIN_LENGTH, MIN_COUNT = 5, 3
#: One of so many (document, word) pairs loses a letter.
ERROR_PARTS = 97
#: A neighbour is the form of a word if it is at least so many times as frequent.
FORM_RATIO = 2
#: Words that decide the cuts at the top of the trees, and words that a leaf of these should hold.
SAMPLE_WORDS, LEAF_WORDS = 200_000, 4_000
#: Points of a leaf within a task, and words whose counts are held at a time.
_TREE_LEAF, _HELD_WORDS = 64, 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64


def word_counts(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of all runs, after the perturbation."""
    column_names(documents, doc, text)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for key, said in zip(batch.column(0), batch.column(1)):
                said = said.as_py()
                if not said:
                    continue
                start = zlib.crc32(f"{key.as_py() or ''}:".encode())
                for word, n in Counter(_RUN.findall(said.translate(_LOWER))).items():
                    drawn = zlib.crc32(word.encode(), start)
                    if drawn % ERROR_PARTS == 0:
                        at = drawn % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) >= _HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values())], schema=schema)
                    held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values())], schema=schema)

    rows = documents.select(F.col(f"`{doc}`").cast("string").alias("doc"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letter numbers."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.int16)
    return np.where(code < 0xC0, code - ord("a"), code - 0xC0 + 26).astype(np.int8)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts of rows of letter numbers."""
    out = np.zeros((len(letters), LETTERS), np.int16 if letters.shape[1] < 1 << 15 else np.int64)
    np.add.at(out, (np.arange(len(letters))[:, None], letters), 1)
    return out


@dataclass
class Tree:
    """A k-d tree: node i is a leaf if `dim[i]` is -1, else its points with a count up to `cut[i]` are below `left[i]`, the others below
    `left[i] + 1`. Leaves are numbered by their nodes."""

    dim: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    #: Rows of each leaf among the points the tree was built of.
    rows: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, points: np.ndarray, size: int) -> Tree:
        """Cut at the letter whose counts vary most, near the median, until a leaf has at most `size` points or equal ones only."""
        tree = cls()
        open_nodes = [(0, np.arange(len(points)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            if len(rows) > size:
                mine = points[rows]
                at = int(np.argmax(mine.var(axis=0)))
                column = mine[:, at]
                low, high = int(column.min()), int(column.max())
                if low < high:
                    cut = min(int(np.median(column)), high - 1)
                    cut = cut - 1 if cut - 1 >= low and abs(2 * (column < cut).sum() - len(rows)) < abs(2 * (column <= cut).sum() - len(rows)) else cut
                    below = column <= cut
                    tree.dim[node], tree.cut[node], tree.left[node] = at, cut, len(tree.dim)
                    tree.dim += [-1, -1]
                    tree.cut += [0, 0]
                    tree.left += [0, 0]
                    open_nodes += [(tree.left[node], rows[below]), (tree.left[node] + 1, rows[~below])]
                    continue
            tree.rows[node] = rows
        return tree

    def meets(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of `points`) for leaves whose box has counts that add at most `up` letters in all and take away at most `down`."""
        top = np.iinfo(np.int32).max
        start = np.zeros(len(points), np.int32)
        open_nodes = [(0, np.arange(len(points)), start, start, {})]
        while open_nodes:
            node, rows, added, taken, box = open_nodes.pop()
            at = self.dim[node]
            if at < 0:
                yield node, rows
                continue
            mine = points[rows, at].astype(np.int32)
            low, high = box.get(at, (0, top))
            cut = self.cut[node]
            # each side moves one face of the box; what the face asked for before is replaced
            less = taken + np.maximum(mine - cut, 0) - np.maximum(mine - high, 0)
            more = added + np.maximum(cut + 1 - mine, 0) - np.maximum(low - mine, 0)
            left = less <= down
            if left.any():
                open_nodes.append((self.left[node], rows[left], added[left], less[left], box | {at: (low, cut)}))
            right = more <= up
            if right.any():
                open_nodes.append((self.left[node] + 1, rows[right], more[right], taken[right], box | {at: (cut + 1, high)}))


def near(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether rows of letters, of equal length or `two` longer by one, differ by one replaced or inserted letter."""
    if one.shape[1] == two.shape[1]:
        return (one != two).sum(axis=1) == 1
    head = np.logical_and.accumulate(one == two[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((one == two[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= one.shape[1]


def _marks(counts: np.ndarray, letter: np.ndarray, least: np.ndarray) -> np.ndarray:
    """One bit for each (letter, least): whether a word has the letter so often; rows of 64-bit numbers."""
    packed = np.packbits(counts[:, letter] >= least, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def search(queries: np.ndarray, points: np.ndarray, tree: Tree, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of `queries`, of `points`) that are near: the tree's boxes are pruned, then counts of points compared, then letters.

    A count is written as so many set bits, so what two words have in common is the number of bits that both have.
    """
    longer = points.shape[1] - queries.shape[1]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    point_counts = counts_of(points)
    most = point_counts.max(axis=0)
    letter = np.repeat(np.arange(LETTERS), most)
    least = np.concatenate([np.arange(1, m + 1) for m in most])
    point_marks = _marks(point_counts, letter, least)
    for start in range(0, len(queries), block):
        mine = queries[start : start + block]
        mine_counts = counts_of(mine)
        marks = _marks(mine_counts, letter, least)
        for leaf, rows in tree.meets(mine_counts, 1, 1 - longer):
            inside = tree.rows[leaf]
            common = np.zeros((len(rows), len(inside)), np.uint16 if points.shape[1] < 1 << 16 else np.int64)
            for k in range(marks.shape[1]):
                common += np.bitwise_count(marks[rows, k][:, None] & point_marks[inside, k])
            at, to = np.nonzero(common >= points.shape[1] - 1)
            at, to = rows[at], inside[to]
            good = near(mine[at], points[to])
            found.append((start + at[good], to[good]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _best(words: np.ndarray, n: np.ndarray, of: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each word in `of`: its row, how many of `to` it has, and the row of that of largest n, ties by code points."""
    if not len(of):
        return of, of, of
    different, rank = np.unique(words[to], return_inverse=True)
    order = np.lexsort((rank, -n[to], of))
    of, to = of[order], to[order]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return of[first], np.diff(np.r_[first, len(of)]), to[first]


_FOUND = "word string, n_near long, best_n long, best string"


def _leaf_found(length: int, words: list[str], n: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
    """Folded finds of one leaf: rows of role 0 are its words, of role 1 visitors of their length, of role 2 those one letter shorter."""
    own = np.flatnonzero(role == 0)
    names = np.array(words, object)
    points = letters_of([words[i] for i in own], length)
    tree = Tree.of(counts_of(points), _TREE_LEAF)
    of, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for which, size in ((role <= 1, length), (role == 2, length - 1)):
        asked = np.flatnonzero(which)
        if not len(asked) or not len(own):
            continue
        query, point = search(letters_of([words[i] for i in asked], size), points, tree)
        of.append(asked[query])
        to.append(own[point])
        if size < length:  # pairs of two lengths are met once and count for both words
            of.append(own[point])
            to.append(asked[query])
    at, many, best = _best(names, n, np.concatenate(of), np.concatenate(to))
    columns = [names[at], many, n[best], names[best]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"]
    )


def top_trees(words: DataFrame) -> dict[int, Tree]:
    """For each length of more than `LEAF_WORDS` words, the top of its tree, cut by a sample."""
    sizes = {r["length"]: r["count"] for r in words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > LEAF_WORDS).collect()}
    total = sum(sizes.values())
    if not total:
        return {}
    taken = words.where(F.length("word").isin([*sizes])).orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS)
    by_length: dict[int, list[str]] = {}
    for row in taken.select("word").collect():
        by_length.setdefault(len(row["word"]), []).append(row["word"])
    share = min(1.0, SAMPLE_WORDS / total)
    return {length: Tree.of(counts_of(letters_of(held, length)), max(8, int(LEAF_WORDS * share))) for length, held in by_length.items()}


def dealt(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(length, leaf, role, word, n): every word in its own leaf, and as a visitor in those its range meets."""
    schema = pa.schema([("length", pa.int32()), ("leaf", pa.int32()), ("role", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    plain = Tree()
    for tree in trees.values():
        tree.rows.clear()
    sent = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            n = batch.column(1).to_numpy()
            sizes = np.fromiter(map(len, names), np.int64, len(names))
            for length in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == length)
                points = counts_of(letters_of(names[mine].tolist(), length))
                tree = sent.value.get(length, plain)
                home = np.zeros(len(mine), np.int32)
                for leaf, rows in tree.meets(points, 0, 0):
                    home[rows] = leaf
                    yield pa.RecordBatch.from_arrays(_dealt(length, leaf, 0, names[mine[rows]], n[mine[rows]]), schema=schema)
                for leaf, rows in tree.meets(points, 1, 1):
                    rows = rows[home[rows] != leaf]
                    yield pa.RecordBatch.from_arrays(_dealt(length, leaf, 1, names[mine[rows]], n[mine[rows]]), schema=schema)
                for leaf, rows in sent.value.get(length + 1, plain).meets(points, 1, 0):
                    yield pa.RecordBatch.from_arrays(_dealt(length + 1, leaf, 2, names[mine[rows]], n[mine[rows]]), schema=schema)

    return words.select("word", "n").mapInArrow(run, "length int, leaf int, role int, word string, n long")


def _dealt(length: int, leaf: int, role: int, words: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    facts = [pa.array(np.full(len(words), x, np.int32)) for x in (length, leaf, role)]
    return [*facts, pa.array(words, pa.string()), pa.array(n, pa.int64())]


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best_n and best (the neighbour of largest n) of every word that has neighbours, among different words (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            return _leaf_found(key[0], table["word"].to_pylist(), table["n"].to_numpy(), table["role"].to_numpy())

        for batch in batches:
            lengths, leaves = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (lengths[1:] != lengths[:-1]) | (leaves[1:] != leaves[:-1]), True]) if len(lengths) else [0]
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                mine = (int(lengths[start]), int(leaves[start]))
                if mine != key and held:
                    yield done()
                    held = []
                key = mine
                held.append(batch.slice(start, stop - start))
        if held:
            yield done()

    rows = dealt(words, top_trees(words)).repartition("length", "leaf").sortWithinPartitions("length", "leaf")
    found = rows.mapInArrow(run, _FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first")
    folded = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return folded.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): forms are followed to the last. A form is twice as frequent, so chains are short; each round doubles
    the steps taken."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved, "roots")
        if moved.where("moved").isEmpty():
            return at
        at = moved.drop("moved")


def variants(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of at least `MIN_COUNT` occurrences."""
    words = materialize(word_counts(documents, doc, text).where(F.col("n") >= MIN_COUNT), "words")
    is_form = F.col("best_n") >= FORM_RATIO * F.col("n")
    found = words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    found = materialize(found, "near-words")
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
