"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic programming carries, for each position, only the
best score and its number of tokens. Exact rules: a character that no piece of its own covers has one unknown edge, at the lowest
score less 10; of equal scores the path that was found first stays, where starts are visited from left to right; runs of unknown
characters become the bytes of their UTF-8 form, one token each.

Defined results: a null text has a null count, an empty one 0; every whole text counts, whatever its length; repeated rows get the
same count; an empty table gives an empty table; other columns pass through, but one named as the count is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import DEFAULT_MODEL, units, vocabulary

#: Units whose counts a worker remembers; then it starts anew.
REMEMBERED = 400_000


class Counter(dict):
    """Tokens of a unit, worked out when it is first asked for."""

    def __init__(self, path: str):
        import ahocorasick

        self.vocabulary = vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def __missing__(self, unit: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.count(unit)
        if len(unit) <= 64:
            self[unit] = n
        return n

    def count(self, unit: str) -> int:
        if len(unit) == 1 and unit not in self.vocabulary.ids:
            return len(unit.encode("utf-8", "surrogatepass"))
        best: list[float | None] = [None] * (len(unit) + 1)
        tokens = [0] * (len(unit) + 1)
        best[0] = 0.0
        at, unknown = 0, self.vocabulary.unknown
        # matches come by end, longest first: starts from left to right, so that on equal scores the first found stays
        for end, (size, score) in self.automaton.iter(unit):
            while at < end:  # characters before this end at which nothing of one character ended
                at = self._step(unit, best, tokens, at, unknown)
            start = end + 1 - size
            if size == 1:
                at = self._alone(best, tokens, end, score)
            elif best[start] is not None and (best[end + 1] is None or best[start] + score > best[end + 1]):
                best[end + 1], tokens[end + 1] = best[start] + score, tokens[start] + 1
        while at < len(unit):
            at = self._step(unit, best, tokens, at, unknown)
        return tokens[len(unit)]

    @staticmethod
    def _alone(best: list, tokens: list, at: int, score: float) -> int:
        if best[at + 1] is None or best[at] + score > best[at + 1]:
            best[at + 1], tokens[at + 1] = best[at] + score, tokens[at] + 1
        return at + 1

    @staticmethod
    def _step(unit: str, best: list, tokens: list, at: int, unknown: float) -> int:
        if best[at + 1] is None or best[at] + unknown > best[at + 1]:
            best[at + 1], tokens[at + 1] = best[at] + unknown, tokens[at] + len(unit[at].encode("utf-8", "surrogatepass"))
        return at + 1


@lru_cache(maxsize=2)
def counter(path: str = DEFAULT_MODEL) -> Counter:
    return Counter(path)


def count_tokens(text: str | None, path: str = DEFAULT_MODEL) -> int | None:
    if text is None:
        return None
    return sum(map(counter(path).__getitem__, units(text)))


def token_counts(docs: DataFrame, text: str = "text", n_tokens: str = "n_tokens", path: str = DEFAULT_MODEL) -> DataFrame:
    """docs with n_tokens (long); one Arrow pass, no shuffle."""

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, path) for t in texts], dtype="Int64")

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != n_tokens], counted(F.col(text)).alias(n_tokens))
