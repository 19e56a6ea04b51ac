"""Quality rules: base statistics and a learned decision list, with DataFrame functions only.

``statistics`` computes a text's numbers inside one row, over the whole text. ``learn`` grows rules on a bounded sample of labelled
rows by sequential covering and prunes each on a third of the sample; ``DecisionList.verdict`` is an ordered Spark conditional.

Defined results: a null text has no words and all counts 0; empty texts too; without labels of both classes the list is empty and
its verdict is true, and so it is on an empty table; of equal gains the first feature, the lowest threshold and "<=" win; repeated rows
each get their own numbers; texts of any length are read whole; other columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, labelled_ids, let, nested, unnested

SYMBOLS = "[#*$%&|<>]"

#: What rules may test, each a ratio or count made from the statistics.
FEATURES = ("n_words", "mean_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "stutter_ratio", "words_per_line")


def _repeat_words(words: Column) -> Column:
    """Words covered by a 3-word window that the text holds twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("k"), i.alias("p")))
    again = lambda s: F.filter(s, lambda x, j: (x["k"] == F.get(s, j - 1)["k"]) | (x["k"] == F.get(s, j + 1)["k"]))
    covered = lambda s: F.size(F.array_distinct(F.flatten(F.transform(again(s), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))
    twice = lambda w: F.when(F.size(F.array_distinct(F.transform(w, lambda x: x["k"]))) == F.size(w), F.lit(0)).otherwise(let(F.sort_array(w), covered))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, twice))


def statistics(docs: DataFrame, text: str = "text", stats: str = "__stats") -> DataFrame:
    """docs with a column of the name stats: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_stutters, n_lines (long)."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    by_words = let(
        F.regexp_extract_all(whole, F.lit(f"({WORD})"), 1),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_stutters"), _repeat_words(w).cast("long").alias("n_repeat_words")
        ),
    )
    lines = let(F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = nested(docs, (stats,), words=by_words, lines=lines, symbols=F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"), upper=F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long"))
    parts = [F.col(f"words.{c}").alias(c) for c in ("n_words", "word_chars", "n_stutters", "n_repeat_words")] + [F.col(f"lines.{c}").alias(c) for c in ("n_lines", "n_dup_lines")]
    parts += [F.col("symbols").alias("n_symbols"), F.col("upper").alias("n_upper")]
    return out.select(*unnested(docs.columns, (stats,)), F.struct(*parts).alias(stats))


def feature(name: str, stats: str = "__stats") -> Column:
    """A feature of FEATURES from a column of statistics; 0 where there are no words."""
    s = lambda c: F.col(f"{stats}.{c}").cast("double")
    per = lambda a, b: F.when(s(b) > 0, s(a) / s(b)).otherwise(0.0)
    made = {
        "n_words": s("n_words"), "mean_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "repeat_ratio": per("n_repeat_words", "n_words"), "upper_ratio": per("n_upper", "word_chars"), "stutter_ratio": per("n_stutters", "n_words"), "words_per_line": per("n_words", "n_lines"),
    }
    return made[name]


@dataclass
class Rule:
    """Thresholds that all must hold, as (feature, '<=' or '>', value)."""

    tests: list[tuple[str, str, float]] = field(default_factory=list)

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {v:.6g}" for f, op, v in self.tests)

    def holds(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for f, op, v in self.tests:
            at = x[:, FEATURES.index(f)]
            hit &= at <= v if op == "<=" else at > v
        return hit

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for f, op, v in self.tests:
            out = out & (feature(f, stats) <= F.lit(v) if op == "<=" else feature(f, stats) > F.lit(v))
        return out


@dataclass
class DecisionList:
    """The first rule that holds rejects; without one the text is kept."""

    rules: list[Rule]

    def verdict(self, stats: str = "__stats") -> Column:
        if not self.rules:
            return F.lit(True)
        out = F.when(self.rules[0].column(stats), F.lit(False))
        for rule in self.rules[1:]:
            out = out.when(rule.column(stats), F.lit(False))
        return out.otherwise(F.lit(True))


def _thresholds(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def _grow(x: np.ndarray, y: np.ndarray, max_tests: int, bins: int, barred: frozenset) -> Rule:
    """Add the test of most FOIL gain until no kept text is covered; a rule does not begin with a barred feature."""
    rule, here = Rule(), np.ones(len(x), bool)
    for _ in range(max_tests):
        p, n = (here & y).sum(), (here & ~y).sum()
        if not p or not n:
            break
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for i, cuts in enumerate(_thresholds(x[here], bins)):
            for v in () if not rule.tests and FEATURES[i] in barred else cuts:
                low = here & (x[:, i] <= v)
                for op, hit in (("<=", low), (">", here & ~low)):
                    if (pp := (hit & y).sum()) and (gain := pp * (np.log2(pp / hit.sum()) - base)) > best[0]:
                        best = (gain, (FEATURES[i], op, float(v)))
        if best[1] is None:
            break
        rule.tests.append(best[1])
        here &= Rule([best[1]]).holds(x)
    return rule


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray) -> float:
    hit = rule.holds(x)
    return ((hit & y).sum() - (hit & ~y).sum()) / max(1, hit.sum())


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is worth most on rows it wasn't grown on."""
    heads = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
    return max(heads, key=lambda r: (_worth(r, x, y), -len(r.tests))) if heads else rule


def cover(x: np.ndarray, bad: np.ndarray, max_rules: int = 12, max_tests: int = 4, bins: int = 24, least: float = 0.97, seed: int = 3) -> DecisionList:
    """Sequential covering of the bad rows: grow, prune, keep if precise on rows held back, take the covered rows out, again.

    A rule that isn't precise is given up, and so is its first feature as a beginning until another rule has been found.
    """
    order = np.random.default_rng(seed).permutation(len(x))
    x, bad = x[order], bad[order]
    rules: list[Rule] = []
    barred: frozenset = frozenset()
    while len(rules) < max_rules and len(barred) < len(FEATURES) and bad.sum() >= 5 and not bad.all():
        back = np.arange(len(x)) % 3 == 0
        rule = _prune(_grow(x[~back], bad[~back], max_tests, bins, barred), x[back], bad[back])
        if not rule.tests:
            break
        hit = rule.holds(x)
        if (hit & bad).sum() < 4 or (hit & bad).sum() < least * hit.sum() or _worth(rule, x[back], bad[back]) < 2 * least - 1:
            barred |= {rule.tests[0][0]}
            continue
        rules.append(rule)
        barred = frozenset()
        x, bad = x[~hit], bad[~hit]
    return DecisionList(rules)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", max_rows: int = 6000, **params) -> DecisionList:
    """A decision list against label 0, from at most max_rows labelled rows (documented bound; they alone come to the driver, as numbers)."""
    chosen = F.broadcast(labelled_ids(labels, label, max_rows))
    rows = statistics(docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(chosen, "doc_id"), "text")
    numbers = F.struct(*[feature(f).alias(f) for f in FEATURES])
    # of texts under one id that with the smallest numbers counts, so that the list is the same on every run
    found = rows.groupBy("doc_id").agg(F.min(F.struct("label", numbers.alias("x"))).alias("row")).orderBy("doc_id").select("row.label", "row.x.*").collect()
    if not found:
        return DecisionList([])
    x = np.array([[r[f] for f in FEATURES] for r in found], float)
    return cover(x, np.array([r["label"] == 0 for r in found]), **params)


def quality_rules(docs: DataFrame, rules: DecisionList, text: str = "text", min_words: int = 50, max_repeat: int = 50, stats: str = "__stats", base_failed: str = "base_failed", kept: str = "kept") -> DataFrame:
    """docs with three columns, named by stats, base_failed and kept; columns of docs that have these names already are replaced."""
    out = nested(statistics(docs, text, stats), (base_failed, kept))
    s = lambda c: F.col("row").getField(stats).getField(c)
    failed = (s("n_words") < min_words) | (100 * s("n_repeat_words") > max_repeat * s("n_words"))
    columns = [c for c in docs.columns if c != stats] + [stats]
    return out.select("row", failed.alias("failed"), F.col("row").getField(stats).alias("__stats")).select(
        *unnested(columns, (base_failed, kept)), F.col("failed").alias(base_failed), F.when(F.col("failed"), F.lit(False)).otherwise(rules.verdict()).alias(kept)
    )
