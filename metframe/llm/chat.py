"""Chat formatting: conversations as windows of a token budget, with a loss mask.

Turns of a conversation are read in order. Prefix sums of their tokens choose the longest turn-aligned span
that fits the budget beside what is repeated: the system turn, if it is the first turn, and the last earlier
turns of at most `history` tokens. Targets are the texts of assistant turns; in repeated turns they are masked, so
each is a target once.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn. In roles and texts a backslash is doubled, and one is put behind
the first character of every control string (of this template and of other common ones), so formatted text
holds control strings only where the template puts them and the original comes back exactly.

Defined cases: null role or text is empty. Rows are ordered by turn (null first), then role, then text, and repeated rows are
turns of their own. A null conv_id is one conversation. A turn over the budget is a window of its own, longer
than the budget, uncut and marked `over_budget`. An empty table gives no windows. Only the named columns are read.

Turns are tokenised before the shuffle. A conversation is then streamed in order through one task, which holds
one window of it, so its length is not bounded by memory.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metframe.llm.common import column_names, slices
from metframe.llm.tokens import ByteBpe

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates; `<|` opens those of several.
CONTROL = re.compile(r"\\|\n|<\||</?s>|\[/?INST\]|<</?SYS>>|</?(?:start|end)_of_turn>")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\([\\n]?)")

WINDOW_TYPES = {
    "window": pa.int64(), "text": pa.string(), "first_turn": pa.int64(), "n_new": pa.int32(), "n_repeated": pa.int32(),
    "loss_starts": pa.list_(pa.int64()), "loss_ends": pa.list_(pa.int64()), "n_tokens": pa.int64(), "over_budget": pa.bool_(),
}
_WINDOWS = (
    "window long, text string, first_turn long, n_new int, n_repeated int, loss_starts array<long>, "
    "loss_ends array<long>, n_tokens long, over_budget boolean"
)


def escape(text: str, line: bool = False) -> str:
    """Text that holds no control string; with `line`, no line break either."""

    def put(found: re.Match[str]) -> str:
        if found[0] == "\\":
            return "\\\\"
        if found[0] == "\n":
            return "\\n" if line else "\n"
        return f"{found[0][0]}\\{found[0][1:]}"

    return CONTROL.sub(put, text)


def unescape(text: str) -> str:
    """The inverse: a doubled backslash is one, `\\n` a line break, and any other backslash was put in."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


@dataclass(frozen=True)
class Turn:
    role: str
    text: str
    tokens: int

    @property
    def head(self) -> str:
        return f"{START}{escape(self.role, line=True)}\n"


def formatted(role: str, text: str) -> str:
    return f"{Turn(role, text, 0).head}{escape(text)}{END}\n"


def windows(turns: Iterable[Turn], budget: int, history: int) -> Iterator[tuple]:
    """The windows of one conversation; holds one window and the repeatable history."""
    system: Turn | None = None
    past: deque[Turn] = deque()
    repeated: list[Turn] = []
    new: list[Turn] = []
    sums = [0]  # prefix sums of the tokens of `new`
    base = number = begun = 0
    for at, turn in enumerate(turns):
        if new and base + sums[-1] + turn.tokens > budget:
            yield _window(number, repeated, new, begun, base + sums[-1], budget)
            past.extend(t for t in new if t is not system)
            while past and sum(t.tokens for t in past) > history:
                past.popleft()
            number, begun, new, sums = number + 1, at, [], [0]
            fixed = system.tokens if system else 0
            kept = list(past)
            while kept and fixed + sum(t.tokens for t in kept) + turn.tokens > budget:
                kept.pop(0)
            repeated = [*([system] if system else []), *kept]
            base = sum(t.tokens for t in repeated)
        if at == 0 and turn.role == "system":
            system = turn
        new.append(turn)
        sums.append(sums[-1] + turn.tokens)
    if new:
        yield _window(number, repeated, new, begun, base + sums[-1], budget)


def _window(number: int, repeated: list[Turn], new: list[Turn], begun: int, tokens: int, budget: int) -> tuple:
    parts, starts, ends, length = [], [], [], 0
    for i, turn in enumerate([*repeated, *new]):
        head, body = turn.head, escape(turn.text)
        if turn.role == "assistant" and i >= len(repeated):
            starts.append(length + len(head))
            ends.append(length + len(head) + len(body))
        parts += [head, body, END, "\n"]
        length += len(head) + len(body) + len(END) + 1
    return number, "".join(parts), begun, len(new), len(repeated), starts, ends, tokens, tokens > budget


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted window, repeated ones included."""
    return [
        (unescape(role), unescape(body))
        for role, _, body in (m[1].partition("\n") for m in _TURN.finditer(text))
    ]


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = 1024, history: int = 256, vocabulary: str | None = None,
) -> DataFrame:
    """Windows of all conversations: `conv`, window, text, first_turn, n_new, n_repeated, loss_starts, loss_ends
    (code points of `text`), n_tokens, over_budget."""
    column_names(df, conv, turn, role, text)

    @F.pandas_udf("long")
    def counted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bpe = ByteBpe(vocabulary)
        for roles, texts in parts:
            yield pd.Series(np.diff(bpe.batch(pa.array(map(formatted, roles, texts), pa.large_string()))[1]))

    kind = df.schema[conv].dataType.simpleString()
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tokens", counted("role", "text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, found in groupby(_rows(batches, "conv", "role", "text", "tokens"), key=lambda r: r[0]):
            for window in windows((Turn(*r[1:]) for r in found), budget, history):
                out.append((key, *window))
                if len(out) >= 256:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    schema = _conv_schema(rows, WINDOW_TYPES)
    return rows.mapInArrow(run, f"conv {kind}, {_WINDOWS}").withColumnRenamed("conv", conv)


def _conv_schema(rows: DataFrame, types: dict[str, pa.DataType]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([("conv", to_arrow_type(rows.schema["conv"].dataType)), *types.items()])


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in slices(batches):
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


DIGEST_TYPES = {
    "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(),
    "formatted_chars": pa.int64(), "n_windows": pa.int64(),
}


def read_back(formatted_windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the windows of each conversation hold, read from their texts and masks alone.

    Every conversation is streamed window by window; repeated turns are passed over.
    """
    kind = formatted_windows.schema[conv].dataType.simpleString()
    rows = formatted_windows.withColumnRenamed(conv, "conv").repartition("conv").sortWithinPartitions("conv", "window")
    schema = _conv_schema(rows, DIGEST_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        names = ("conv", "text", "n_repeated", "loss_starts", "loss_ends")
        for key, found in groupby(_rows(batches, *names), key=lambda r: r[0]):
            out.append((key, *_digest(found)))
            if len(out) >= 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    types = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    return rows.mapInArrow(run, f"conv {kind}, {types}").withColumnRenamed("conv", conv)


def _digest(found: Iterable[tuple]) -> tuple[int, str, int, str, int, int]:
    turns, loss = hashlib.sha256(), hashlib.sha256()
    n_turns = loss_chars = chars = n_windows = 0
    for _, text, n_repeated, starts, ends in found:
        for role, body in parse(text)[n_repeated:]:
            turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            n_turns += 1
        for start, end in zip(starts, ends):
            target = unescape(text[start:end])
            loss.update(target.encode("utf-8", "surrogatepass"))
            loss_chars += len(target)
        chars += len(text)
        n_windows += 1
    return n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows
