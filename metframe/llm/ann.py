"""Approximate nearest neighbours by inner product: balanced posting lists behind a graph of centroids.

Fitting: a sample of at most `SAMPLE_BYTES` is cut in two at the median, again and again, into lists of equal size; their means are
the centroids. Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm. Centroids
are searched by a best-first walk over a graph of near centroids, which fits into memory.

Index: every row goes to the list of its nearest centroid, and a boundary vector to up to `REPLICAS` lists whose centroids
are at most `BOUNDARY` times as far, unless one that was taken is nearer to that centroid than the vector is.

Search: a query reads the lists whose distance is at most a ratio times that of its nearest one. The ratio is calibrated on the
sample: queries from it are compared with brute force over it, and the ratio is what `TARGET` of their true neighbours need.
Queries go to the workers in blocks of `BLOCK_BYTES`; each block streams once through the posting lists, which are dealt by
(list, id), so that a list of a third of all rows is split. A task keeps the best `k` of each query so far.

Scores are computed in double precision on the original vectors; equal scores are ordered by the smaller id.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors of
another length than the most frequent one. Of rows that repeat an id one is used, that with the smallest vector. Empty tables give no rows, and fewer
than `k` candidates all of them. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metframe.llm.common import SLICE_ROWS, column_names, one_row_per_id, slices
from metframe.session import materialize

SAMPLE_BYTES, BLOCK_BYTES = 4 << 20, 32 << 20
#: Rows of the sample in a list, links of a centroid in the graph, and centroids that a walk keeps at least.
LIST_SAMPLE, LINKS, KEPT = 8, 24, 16
REPLICAS, BOUNDARY = 4, 1.1
TARGET, CALIBRATED = 0.97, 256
_CELLS = 4_000_000  # scores held at a time
_CLOSE = 1e-9  # scores that rounding may have moved past each other


@dataclass
class Centroids:
    """Centroids, their graph and the pruning ratio; at most an eighth of the sample."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    norm: float
    ratio: float = 1.0

    def lift(self, vectors: np.ndarray, queries: bool = False) -> np.ndarray:
        """Vectors with the coordinate that turns inner products into distances."""
        more = np.zeros(len(vectors)) if queries else np.sqrt(np.maximum(self.norm**2 - (vectors**2).sum(axis=1), 0))
        return np.c_[vectors, more]

    def walk(self, lifted: np.ndarray, ratio: float = 1.0) -> np.ndarray:
        """Distances to the centroids that a best-first walk meets, infinite for others.

        A walk goes on while its nearest open centroid is among the `KEPT` nearest or within `ratio` of the nearest.
        """
        rows = np.arange(len(lifted))
        seen = np.full((len(lifted), len(self.points)), np.inf)
        opened = np.zeros(seen.shape, bool)
        seen[:, self.entries] = _distances(lifted, self.points[self.entries])
        kept = min(KEPT, len(self.points)) - 1
        active = rows
        while len(active):
            now = seen[active]
            waiting = np.where(opened[active], np.inf, now)
            best = waiting.argmin(axis=1)
            far = waiting[np.arange(len(active)), best]
            bound = np.maximum(now.min(axis=1) * ratio, np.partition(now, kept, axis=1)[:, kept])
            go = np.isfinite(far) & (far <= bound)
            active, best = active[go], best[go]
            if not len(active):
                break
            opened[active, best] = True
            near = self.links[best]
            gap = self.points[near] - lifted[active][:, None, :]
            seen[active[:, None], near] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        return seen

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and lists, the nearest and those of boundary vectors."""
        lifted = self.lift(vectors)
        seen = self.walk(lifted, BOUNDARY)
        order = np.argsort(seen, axis=1, kind="stable")[:, : 4 * REPLICAS]
        far = np.take_along_axis(seen, order, axis=1)
        taken = np.zeros(order.shape, bool)
        taken[:, 0] = True
        for j in range(1, order.shape[1]):
            gap = self.points[order[:, j]][:, None, :] - self.points[order[:, :j]]
            between = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
            shadowed = (taken[:, :j] & (between < far[:, j : j + 1])).any(axis=1)
            near = (far[:, j] <= BOUNDARY * far[:, 0]) & np.isfinite(far[:, j])
            taken[:, j] = near & ~shadowed & (taken.sum(axis=1) < REPLICAS)
        row, place = np.nonzero(taken)
        return row, order[row, place]

    def probes(self, queries: np.ndarray) -> np.ndarray:
        """For each query whether it reads a list."""
        seen = self.walk(self.lift(queries, queries=True), self.ratio)
        return seen <= seen.min(axis=1, keepdims=True) * self.ratio


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


def _balanced(points: np.ndarray, lists: int) -> np.ndarray:
    """Means of about `lists` parts of equal size, each cut at the median between two means."""
    parts = [np.arange(len(points))]
    while 2 * len(parts) <= lists and min(map(len, parts)) > 1:
        halves = []
        for part in parts:
            rows = points[part]
            ends = rows[[0, len(rows) // 2]]
            for _ in range(6):
                d = _distances(rows, ends)
                side = (d[:, 0] - d[:, 1]).argsort(kind="stable")
                low, high = np.split(side, [len(side) // 2])
                ends = np.array([rows[low].mean(axis=0), rows[high].mean(axis=0)])
            halves += [part[low], part[high]]
        parts = halves
    return np.unique(np.array([points[part].mean(axis=0) for part in parts]), axis=0)


def fit_centroids(sample: np.ndarray, norm: float, lists: int, k: int) -> Centroids:
    """Centroids, graph and ratio from a sample of original vectors."""
    out = Centroids(np.zeros((0, 0)), np.zeros((0, 0), np.int64), np.zeros(0, np.int64), norm)
    lifted = out.lift(sample)
    out.points = _balanced(lifted, lists)
    count = len(out.points)
    near = np.array([np.argsort(row, kind="stable")[1 : LINKS + 1] for row in _distances(out.points, out.points)]).reshape(count, -1)
    ring = (np.arange(count) + 1) % count  # so that every centroid can be reached
    out.links = np.c_[near, ring]
    out.entries = np.unique(np.linspace(0, count - 1, max(int(count**0.5), 1)).astype(np.int64))
    picked = np.linspace(0, len(sample) - 1, min(CALIBRATED, len(sample))).astype(np.int64)
    holds = np.zeros((len(sample), count), bool)
    for start in range(0, len(sample), SLICE_ROWS):
        row, lists_of = out.assign(sample[start : start + SLICE_ROWS])
        holds[start + row, lists_of] = True
    far = _distances(out.lift(sample[picked], queries=True), out.points)
    needed = []
    for i, query in enumerate(picked if len(sample) > 1 else []):
        scores = sample @ sample[query]
        scores[query] = -np.inf
        found = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        needed.append(np.where(holds[found], far[i], np.inf).min(axis=1) / max(far[i].min(), 1e-12))
    out.ratio = float(np.quantile(np.concatenate(needed), TARGET)) * (1 + 1e-9) if needed else 1.0
    return out


class Best:
    """The best `k` candidates of each query, exact over what was offered."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.queries, self.ids, self.k = queries, ids, k
        self.low = np.full(len(ids), -np.inf)
        self._held: list[tuple[np.ndarray, ...]] = []
        self._size = 0

    def offer(self, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Vectors of a list to the queries (by number) that read it."""
        step = max(1, _CELLS // max(len(vectors), 1))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            scores = self.queries[part] @ vectors.T
            scores[self.ids[part][:, None] == ids] = -np.inf
            low = self.low[part]
            if len(ids) > self.k:
                low = np.maximum(low, np.partition(scores, -self.k, axis=1)[:, -self.k])
            q, v = np.nonzero((scores >= low[:, None] - _CLOSE * np.maximum(np.abs(low[:, None]), 1)) & np.isfinite(scores))
            exact = np.einsum("ij,ij->i", self.queries[part[q]], vectors[v])
            self._held.append((part[q], ids[v], exact))
            self._size += len(q)
            if self._size > _CELLS:
                self.fold()

    def fold(self) -> tuple[np.ndarray, ...]:
        """Query numbers, ids and scores of the best so far, in order."""
        if not self._held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, v, s = map(np.concatenate, zip(*self._held))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        same = np.r_[False, (q[1:] == q[:-1]) & (v[1:] == v[:-1]) & (s[1:] == s[:-1])]
        q, v, s = q[~same], v[~same], s[~same]
        first = np.r_[True, q[1:] != q[:-1]]
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
        keep = rank < self.k
        q, v, s, rank = q[keep], v[keep], s[keep], rank[keep]
        self.low[q[rank == self.k - 1]] = s[rank == self.k - 1]
        self._held, self._size = [(q, v, s)], 0
        return q, v, s


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def usable(df: DataFrame, key: str, vector: str, is_query: Column) -> DataFrame:
    """id, vec (doubles) and asks (meets `is_query`) of the rows that take part."""
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("vec")))
    size = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    rows = rows.where(F.size("vec") == (size["dim"] if size else 0))
    return one_row_per_id(rows, "id")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def search(
    candidates: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, lists: int | None = None
) -> DataFrame:
    """query_id, rank, `key`, score: of each row that meets `is_query` the `k` nearest others found."""
    column_names(candidates, key, vector)
    spark = candidates.sparkSession
    taking_part = usable(candidates, key, vector, is_query)
    rows, chosen = taking_part.drop("asks"), taking_part.where("asks").drop("asks")
    squared = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x * x)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.sqrt(squared)).alias("norm"), F.max(F.size("vec")).alias("dim")).first()
    result = f"query_id long, {key} long, score double"
    if not facts["n"]:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    sample_rows = max(2, min(SAMPLE_BYTES // (8 * facts["dim"]), facts["n"]))
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()])
    count = lists or min(round(facts["n"] ** 0.5), max(sample_rows // LIST_SAMPLE, 1))
    sent = spark.sparkContext.broadcast(fit_centroids(sample, facts["norm"], max(count, 1), k))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, lists_of = sent.value.assign(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists_of, pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                names=["list", "id", "vec"],
            )

    postings = materialize(rows.mapInArrow(assigned, "list int, id long, vec array<double>"), "postings")
    postings = postings.repartitionByRange("list", "id").sortWithinPartitions("list", "id")

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bits = [row.tobytes() for row in np.packbits(sent.value.probes(_matrix(batch.column(1))), axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits, pa.binary())], names=["id", "vec", "lists"])

    queries = materialize(chosen.mapInArrow(probed, "id long, vec array<double>, lists binary"), "queries")
    blocks = -(-queries.count() * 8 * facts["dim"] // BLOCK_BYTES) or 1
    found = None
    for block in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id").collect()
        if not asked:
            continue
        held = spark.sparkContext.broadcast((
            np.array([r["id"] for r in asked]), np.array([r["vec"] for r in asked]),
            np.array([np.frombuffer(r["lists"], np.uint8) for r in asked]),
        ))

        def searched(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, vectors, bits = held.value
            best = Best(vectors, ids, k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                of = batch.column(0).to_numpy()
                cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
                names, points = batch.column(1).to_numpy(), _matrix(batch.column(2))
                for start, stop in zip(cuts[:-1], cuts[1:]):
                    reading = np.flatnonzero(bits[:, of[start] >> 3] >> (7 - (of[start] & 7)) & 1)
                    best.offer(reading, points[start:stop], names[start:stop])
            q, v, s = best.fold()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(v, pa.int64()), pa.array(s)], names=["query_id", key, "score"])

        part = postings.mapInArrow(searched, result)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    # replicas of one vector come from several tasks, with equal scores
    once = found.repartition("query_id").groupBy("query_id", key).agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
