"""URL filter: allow and block rules by host and path, and a weighted vocabulary found by Aho-Corasick.

One automaton finds all terms in one pass over a url. A hit counts if no ASCII letter or digit stands
next to it. One strict term rejects a url, and so do `soft_limit` different soft terms. A rule that fits
decides instead of the vocabulary.

Defined cases: a null url, or one without `://`, has empty host and path, meets no rule and is judged
by its text (null: empty, allowed). Rows are never merged or dropped, so repeated rows give repeated
results, and an empty table an empty one. Only the named columns are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Terms of pages that text corpora leave out, in alphabetical order.
STRICT_TERMS = ("casino", "hentai", "nude", "nudes", "porn", "porno", "sex", "slots", "spam", "viagra", "xxx")
SOFT_TERMS = (
    "ads", "adult", "bet", "bets", "betting", "bonus", "cheap", "dating", "escort", "farm", "free", "gambling",
    "hot", "jackpot", "loan", "lottery", "pills", "poker", "track", "win", "winner",
)


@dataclass(frozen=True)
class Rule:
    """`action` is allow or block, for `host` and its subdomains where the path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


class Judge:
    """Rules and vocabulary of one filter, usable on any worker."""

    def __init__(self, rules: Sequence[Rule], strict: Sequence[str], soft: Sequence[str], soft_limit: int) -> None:
        self.soft_limit = soft_limit
        self.by_host: dict[str, list[Rule]] = {}
        for rule in rules:
            self.by_host.setdefault(rule.host.lower(), []).append(rule)
        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, (term, term in strict))
        if len(self.automaton):
            self.automaton.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        """The longest fitting rule; of equally long ones that with the longer host, then a block."""
        found = []
        start = 0
        while host and start >= 0:
            found += [r for r in self.by_host.get(host[start:], ()) if path.startswith(r.path)]
            dot = host.find(".", start)
            start = dot + 1 if dot >= 0 else -1
        return max(found, key=lambda r: (len(r.text), len(r.host), r.action == "block"), default=None)

    def hits(self, url: str) -> tuple[int, list[str]]:
        """Bounded strict hits, and the different soft terms that occur."""
        strict, soft = 0, set()
        if len(self.automaton):
            for end, (term, is_strict) in self.automaton.iter(url):
                start = end - len(term) + 1
                if not _in_word(url, start - 1) and not _in_word(url, end + 1):
                    if is_strict:
                        strict += 1
                    else:
                        soft.add(term)
        return strict, sorted(soft)


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def judge_urls(
    df: DataFrame, rules: Sequence[Rule], url: str = "url", keep: Sequence[str] = ("page_id",),
    strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_limit: int = 2,
) -> DataFrame:
    """Columns `keep`, and host, path, rule, verdict, strict_hits, soft_terms for every row."""

    @F.pandas_udf("rule string, verdict string, strict_hits int, soft_terms array<string>")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        judge = Judge(rules, strict, soft, soft_limit)
        for urls, hosts, paths in parts:
            rows = []
            for text, host, path in zip(urls, hosts, paths):
                rule = judge.rule(host, path)
                n_strict, softs = judge.hits(text)
                by_words = "block" if n_strict or len(softs) >= judge.soft_limit else "allow"
                rows.append((rule and rule.text, rule.action if rule else by_words, n_strict, softs))
            yield pd.DataFrame(rows, columns=["rule", "verdict", "strict_hits", "soft_terms"])

    lowered = F.translate(F.coalesce(F.col(url), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = [F.col(f"`{c}`") for c in keep]
    parts = df.select(
        F.struct(*kept).alias("kept"), lowered.alias("lowered"),
        F.regexp_extract(lowered, r"://([^/?#]*)", 1).alias("host"),
        F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
    )
    found = parts.select("kept", "host", "path", judged("lowered", "host", "path").alias("found"))
    return found.select("kept.*", "host", "path", "found.*")
