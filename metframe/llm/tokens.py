"""Token ids of a public byte-level BPE vocabulary, as its own library gives them, at a fraction of the time.

The pattern of the vocabulary always starts a new token at a space between two characters that are no white space. Texts of a batch are
therefore cut there, each different piece is encoded once, and the ids are gathered again. Texts that have a space beside other white
space, or a special token, are encoded as a whole. Ids equal `Tokenizer.from_file(...).encode(text,
add_special_tokens=False).ids`; `tests/llm` holds them against it.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: Ranks of the vocabulary byte_bpe_50k.json.
VOCABULARY = "byte_bpe_50k.tiktoken"
_SPECIAL = "<|endoftext|>"
#: White space of Unicode; no piece may be cut at a space beside it.
WHITE = "\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
UNCUT = f"(^|[{WHITE}]) | ($|[{WHITE}])"


class ByteBpe:
    """Encoder of one worker; `vocabulary` is the path of a rank file. Without `special`, special tokens in texts are plain text."""

    def __init__(self, vocabulary: str | None = None, special: bool = True) -> None:
        path = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(os.fspath(path), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        end = max(ranks.values()) + 1
        self._encoding = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: end}
        )
        self._special = special
        #: Bytes of each id's token.
        self.lengths = np.zeros(end + 1, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one text."""
        if not self._special:
            return self._plain(text or "")
        return np.array(self._encoding.encode(text or "", allowed_special="all"), np.uint32)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin, with the end; null: no ids."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        uncut = pc.match_substring_regex(texts, UNCUT)
        if self._special:
            uncut = pc.or_(uncut, pc.match_substring(texts, _SPECIAL))
        whole = np.asarray(uncut.to_numpy(zero_copy_only=False))
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        bounds = split.offsets.to_numpy()
        pieces = split.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        coded = pieces.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        flat, start = self.spaced(coded.dictionary)
        size = np.diff(start)
        taken = size[code]
        taken[bounds[:-1]] = 0  # a text's first piece has no space before it
        ends = np.concatenate(([0], np.cumsum(taken)))
        gather = np.arange(ends[-1]) + np.repeat(start[code] - ends[:-1], taken)
        rest = flat[gather]
        rest_bounds = ends[bounds]
        firsts = [
            self.ids(text.as_py()) if alone else self._plain(pieces[at].as_py())
            for text, alone, at in zip(texts, whole.tolist(), bounds[:-1].tolist())
        ]
        lengths = np.fromiter(map(len, firsts), np.int64, len(firsts)) + np.diff(rest_bounds)
        out_bounds = np.concatenate(([0], np.cumsum(lengths)))
        out = np.empty(out_bounds[-1], np.uint32)
        for i, first in enumerate(firsts):
            at = out_bounds[i] + len(first)
            out[out_bounds[i] : at] = first
            out[at : out_bounds[i + 1]] = rest[rest_bounds[i] : rest_bounds[i + 1]]
        return out, out_bounds

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self._encoding.encode_ordinary(text), np.uint32)

    def spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every piece with one space before it, all in one call, and where each begins."""
        empty = pc.equal(pieces, "").to_numpy(zero_copy_only=False)
        kept = pieces.filter(pa.array(~empty))
        flat = self._plain(" " + " ".join(kept.to_pylist())) if len(kept) else np.zeros(0, np.uint32)
        ends = np.cumsum(self.lengths[flat])
        size = np.zeros(len(pieces), np.int64)
        size[~empty] = pc.binary_length(kept).to_numpy().astype(np.int64) + 1
        at = np.cumsum(size)
        stop = np.searchsorted(ends, at, side="right")
        return flat, np.concatenate(([0], stop))
