"""What the operators share: text to words, 64-bit hashes of words, files in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metframe.session import materialize

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A-Z to a-z, all else kept; on UTF-8 bytes, so that other letters stay as they are.
LOWER = bytes.maketrans(_UPPER, _LOWER)
#: The same, and every ASCII character that is no letter or digit to a space.
PLAIN = bytes(
    LOWER[i] if i > 127 or chr(i).isalnum() else 32 for i in range(256)
)
#: Rows that Python code handles at a time, whatever the size of an Arrow batch.
SLICE_ROWS = 1024
_CACHED_WORDS = 150_000


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased: `[^\\x20\\x09-\\x0D]+` of the text."""
    return utf8(text).translate(LOWER).split()


def plain_words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased first."""
    return utf8(text).translate(PLAIN).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of bounded length, and of at most `size` bytes or one row where that is given."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            piece = batch.slice(start, rows)
            while size is not None and piece.num_rows > 1 and piece.nbytes > size:
                piece = piece.slice(0, piece.num_rows // 2)
            yield piece
            start += piece.num_rows


class WordHashes:
    """64-bit hashes of words, each computed once while it is in the bounded cache."""

    def __init__(self) -> None:
        self._known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > _CACHED_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other one."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of `n` word hashes; as many as there are runs."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = mix(hashes[:count] + np.uint64(n))
    for i in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + count])
    return out


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of a folder that every executor can reach."""
    return fs.FileSystem.from_uri(uri)


def column_names(df: DataFrame, *names: str) -> None:
    """Refuse a frame that lacks a named column before any job starts."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not among {df.columns}")


def one_row_per_id(df: DataFrame, key: str, text: str | None = None) -> DataFrame:
    """Rows with a key of their own, and of those that repeat a key the smallest one; rows without a key all stay.

    With `text` named, only rows that repeat a key and its text are folded; texts are told apart by a 64-bit hash. Only keys are shuffled to find repeats; without any, the frame is returned as it is. Maps and variants have no order and
    don't count for what is smallest.
    """
    column = F.col(f"`{key}`")
    part = F.xxhash64(F.col(f"`{text}`")) if text else F.lit(0).cast("long")
    keys = df.where(column.isNotNull()).groupBy(column.alias("__key"), part.alias("__part")).agg(F.count("*").alias("__n")).where("__n > 1")
    repeated = materialize(keys.select("__key", "__part"), "repeated-keys")
    if repeated.isEmpty():
        return df
    same = (column == F.col("__key")) & (part == F.col("__part"))
    alone = df.join(repeated, same, "left_anti")
    ordered = [f"`{name}`" for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    smallest = F.min_by(F.struct(*[f"`{c}`" for c in df.columns]), F.struct(*ordered)).alias("__row")
    folded = df.join(repeated, same, "left_semi").groupBy(column, part).agg(smallest)
    return alone.unionByName(folded.select("__row.*"))
