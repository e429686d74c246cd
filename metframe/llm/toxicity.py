"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is a word (at most `WINDOW_BYTES` of it) before a fixed carrier that both dictionaries hold, so that even a
short window is compressed rather than stored. Its gain is the length under the ordinary dictionary less that under the toxic one. A
text's score is a logistic function of how many of its windows gain at least 2 and 3 bytes and of the largest gain; its
weights, and so the thresholds in bytes, are calibrated on labelled texts under dictionaries that haven't seen them (`FOLDS` folds).

Dictionaries are trained in rounds: raw text of each class first; then the toxic one from windows that gain under the last pair
and recur in toxic texts far more than in ordinary ones, the ordinary one from the most common ordinary windows and
from those that the last pair mistook for toxic.

The model is fitted on the driver from at most `sample_rows` labelled texts of each class, of at most `sample_chars` characters
each, chosen by a hash of the id among the labels that have such a text. Scoring reads whole texts, all of them, in the tasks
that read them.

Defined cases: null and empty texts have no windows and get the score of a text without hits. With fewer than `FOLDS` texts of a class
nothing is learnt: all scores are the share of toxic texts, held below `THRESHOLD`, and `without_toxic` keeps every row. Labels
other than 0 and 1, and labels that contradict each other for one id, are not learnt. Rows are
scored one by one, so repeated rows and null ids are kept; an empty table gives no rows. Only the named columns are read, and
`without_toxic` returns all columns of the documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from metframe.llm.common import column_names, plain_words, slices
from metframe.session import materialize

THRESHOLD = 0.3
SAMPLE_ROWS, SAMPLE_CHARS = 4000, 20_000
WINDOW_BYTES = 32
#: What follows each window and ends both dictionaries.
CARRIER = bytes(range(48, 58)) + bytes(range(65, 91))
RAW_BYTES, ORDINARY_WINDOWS, ROUNDS, FOLDS = 400_000, 10_000, 3, 4
#: A window trains the toxic dictionary if it gains so many bytes, in so many toxic texts, at so many times the ordinary rate.
MIN_GAIN, MIN_TEXTS, MIN_RATIO = 2, 3, 8
_CACHED_WINDOWS = 150_000
_SOME = 20  # windows added to a text's length, so that one hit in a short text doesn't count for all


def windows(text: str | None) -> list[bytes]:
    """Words of a text, each between spaces; longer ones in pieces."""
    out = []
    for word in plain_words(text):
        if len(word) <= WINDOW_BYTES:
            out.append(b" " + word + b" ")
        else:
            out += [b" " + word[i : i + WINDOW_BYTES] + b" " for i in range(0, len(word), WINDOW_BYTES)]
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        window_log=20, chain_log=17, hash_log=17, search_log=6, min_match=3, target_length=48,
        strategy=zstandard.STRATEGY_BTLAZY2,
    )
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


@dataclass
class Distance:
    """Gains of windows under a pair of dictionaries."""

    toxic: bytes
    ordinary: bytes
    _known: dict[bytes, int] = field(default_factory=dict)
    _pair: tuple | None = None

    def __getstate__(self) -> dict:
        return {"toxic": self.toxic, "ordinary": self.ordinary, "_known": {}, "_pair": None}

    def gains(self, found: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > _CACHED_WINDOWS:
            known.clear()
        new = list(set(found).difference(known))
        if new:
            if self._pair is None:
                self._pair = (_compressor(self.toxic), _compressor(self.ordinary))
            carried = [w + CARRIER for w in new]
            toxic, ordinary = (c.multi_compress_to_buffer(carried, threads=0) for c in self._pair)
            known.update((w, len(ordinary[i]) - len(toxic[i])) for i, w in enumerate(new))
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def features(self, text: str | None) -> np.ndarray:
        gains = self.gains(windows(text))
        size = len(gains) + _SOME
        return np.array([
            1.0, np.log(0.001 + (gains >= 3).sum() / size), np.log(0.001 + (gains >= 2).sum() / size),
            min(max(gains, default=0), 8), np.log(size),
        ])


@dataclass
class Model:
    """What is sent to the workers: some hundred kilobytes of dictionary and five weights."""

    distance: Distance | None
    weights: np.ndarray
    constant: float = 0.0

    def score(self, text: str | None) -> float:
        if self.distance is None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.distance.features(text) @ self.weights, -30, 30))))


def train(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from all texts, weights from texts under dictionaries of the other folds."""
    if len(toxic) < FOLDS or len(ordinary) < FOLDS:
        share = len(toxic) / max(len(toxic) + len(ordinary), 1)
        return Model(None, np.zeros(5), min(share, float(np.nextafter(THRESHOLD, 0))))
    x, y = [], []
    for fold in range(FOLDS):
        (some_toxic, toxic_rest), (some_ordinary, ordinary_rest) = (
            ([t for i, t in enumerate(texts) if i % FOLDS != fold], texts[fold::FOLDS]) for texts in (toxic, ordinary)
        )
        distance = dictionaries(some_toxic, some_ordinary)
        x += [distance.features(t) for t in (*toxic_rest, *ordinary_rest)]
        y += [1.0] * len(toxic_rest) + [0.0] * len(ordinary_rest)
    return Model(dictionaries(toxic, ordinary), _logistic(np.array(x), np.array(y)))


def dictionaries(toxic: list[str], ordinary: list[str]) -> Distance:
    """A pair of dictionaries, trained in rounds."""
    in_toxic, in_ordinary = (Counter(w for t in texts for w in set(windows(t))) for texts in (toxic, ordinary))
    common = sorted(in_ordinary, key=lambda w: (-in_ordinary[w], w))[:ORDINARY_WINDOWS]
    known = sorted(w for w, n in in_toxic.items() if n >= MIN_TEXTS)
    recurring = sorted(w for w, n in in_ordinary.items() if n > 1)
    distance = Distance(_raw(toxic, RAW_BYTES), _raw(ordinary, 4 * RAW_BYTES))
    mistaken: list[bytes] = []
    for _ in range(ROUNDS):
        rate = len(toxic) / len(ordinary)
        gains = distance.gains(known)
        chosen = [w for w, g in zip(known, gains) if g >= MIN_GAIN and in_toxic[w] >= MIN_RATIO * rate * (in_ordinary[w] + 0.5)]
        if not chosen:
            break
        chosen.sort(key=lambda w: (in_toxic[w], w))
        distance = Distance(b"".join(chosen), b"".join([*reversed(common), *mistaken]))
        of_toxic = set(chosen)
        mistaken += [w for w, g in zip(recurring, distance.gains(recurring)) if g > MIN_GAIN and w not in of_toxic]
    return distance


def _raw(texts: list[str], size: int) -> bytes:
    out, left = [], size
    for text in texts:
        out.append(b"".join(w[:-1] for w in windows(text))[:left])
        left -= len(out[-1])
        if left <= 0:
            break
    return b"".join(out)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    weights = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - y) + ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def fit(
    documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
) -> Model:
    """Learn from the labels given, of which the caller has left out those to hold back."""
    column_names(documents, doc, text)
    column_names(labels, doc, label)
    ids = labels.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    ids = ids.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    texts = documents.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("text"))
    texts = texts.where((F.length("text") > 0) & (F.length("text") <= sample_chars))
    ids = materialize(ids.join(texts.select("id"), "id", "left_semi"), "labelled")
    samples = []
    for value in (1, 0):
        chosen = ids.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("id")
        rows = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "text").limit(sample_rows).collect()
        samples.append([r["text"] for r in rows])
    return train(*samples)


def score(documents: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc` and score of every row."""
    column_names(documents, doc, text)
    kind = documents.schema[doc].dataType
    rows = documents.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=schema)

    schema = pa.schema([("doc", to_arrow_type(kind)), ("score", pa.float64())])
    return rows.mapInArrow(run, f"doc {kind.simpleString()}, score double").withColumnRenamed("doc", doc)


def without_toxic(documents: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold; all of them if nothing was learnt."""
    column_names(documents, text)
    if model.distance is None:
        return documents
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
