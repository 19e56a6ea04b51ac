"""Constrained assignment of pages to splits: sequential by nature, on a page table of bounded size; seeds run in parallel.

Larger tables are dealt to strata of bounded size, each solved whole: quotas and the cover of types then hold in each stratum, and so in all.

The order of work: lock pages into train until it has every token type; deal the rest label by label, rarest unmet label first; then swap
pages between splits while the label deviations improve and no type leaves train. Counts, not sets, track the vocabulary.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.splits import RATIOS


def largest_remainder(n: int, ratios: dict[str, float]) -> dict[str, int]:
    exact = {s: round(n * r, 9) for s, r in ratios.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(ratios, key=lambda s: (-(exact[s] - out[s]), list(ratios).index(s)))[: n - sum(out.values())]:
        out[s] += 1
    return out


class Assignment:
    """Pages' splits with label counts by split and, for train, token counts."""

    def __init__(self, labels: dict[str, list[str]], tokens: dict[str, list[str]], ratios: dict[str, float]):
        self.labels, self.tokens, self.ratios = labels, tokens, ratios
        self.split: dict[str, str] = {}
        self.room = largest_remainder(len(labels), ratios)
        support = Counter(x for v in labels.values() for x in v)
        self.target = {x: largest_remainder(n, ratios) for x, n in support.items()}
        self.have = {s: Counter() for s in ratios}
        self.types = Counter()

    def put(self, page: str, split: str) -> None:
        self.take(page)
        self.split[page] = split
        self.room[split] -= 1
        self.have[split].update(self.labels[page])
        if split == "train":
            self.types.update(set(self.tokens[page]))

    def take(self, page: str) -> None:
        if (old := self.split.pop(page, None)) is not None:
            self.room[old] += 1
            self.have[old].subtract(self.labels[page])
            if old == "train":
                self.types.subtract(set(self.tokens[page]))

    def off(self, label: str, split: str) -> float:
        t = self.target[label][split]
        return abs(self.have[split][label] - t) / max(1, t)

    def gain(self, page: str, a: str, b: str) -> float:
        """How much the deviations fall if a page's labels go from a to b."""
        out = 0.0
        for x in self.labels[page]:
            for s, step in ((a, -1), (b, 1)):
                t = self.target[x][s]
                out += self.off(x, s) - abs(self.have[s][x] + step - t) / max(1, t)
        return out

    def needed(self, page: str) -> bool:
        """Whether train would lose a type without the page."""
        return any(self.types[t] == 1 for t in set(self.tokens[page]))


def solve(labels: dict[str, list[str]], tokens: dict[str, list[str]], seed: int, ratios: dict[str, float] = RATIOS, rounds: int = 100) -> dict[str, str]:
    """The split of each page."""
    a = Assignment(labels, tokens, ratios)
    order = {p: hashlib.sha256(f"{seed}:{p}".encode()).hexdigest() for p in labels}
    carriers = defaultdict(list)
    for p in sorted(labels, key=order.__getitem__):
        for t in set(tokens[p]):
            carriers[t].append(p)
    for t in sorted(carriers, key=lambda t: (len(carriers[t]), t)):
        if a.types[t] <= 0 and a.room["train"] > 0:
            page = max(carriers[t], key=lambda p: (sum(a.types[x] <= 0 for x in set(tokens[p])), order[p]))
            a.put(page, "train")
    free = [p for p in sorted(labels, key=order.__getitem__) if p not in a.split]
    holders = defaultdict(list)
    for p in free:
        for x in labels[p]:
            holders[x].append(p)
    for x in sorted(holders, key=lambda x: (len(holders[x]), x)):
        for p in holders[x]:
            if p not in a.split:
                open_ = [s for s in ratios if a.room[s] > 0]
                a.put(p, max(open_, key=lambda s: (a.target[x][s] - a.have[s][x], a.room[s])))
    for p in free:
        if p not in a.split:
            a.put(p, max(ratios, key=lambda s: a.room[s]))
    for _ in range(rounds):
        worst = sorted(((a.off(x, s), x, s) for x in a.target for s in ratios), reverse=True)[:12]
        best, pick = 1e-9, None
        for _, x, s in worst:
            over = a.have[s][x] > a.target[x][s]
            here = [p for p in labels if a.split[p] == s and (x in labels[p]) == over][:40]
            there = [p for p in labels if a.split[p] != s and (x in labels[p]) != over][:40]
            for p in here:
                for q in there:
                    if (a.split[p] == "train" and a.needed(p)) or (a.split[q] == "train" and a.needed(q)):
                        continue
                    g = a.gain(p, s, a.split[q]) + a.gain(q, a.split[q], s)
                    if g > best:
                        best, pick = g, (p, q)
        if pick is None:
            break
        p, q = pick
        s, t = a.split[p], a.split[q]
        a.take(p)
        a.put(q, s)
        a.put(p, t)
    return a.split


def objective(labels: dict[str, list[str]], split: dict[str, str], ratios: dict[str, float]) -> tuple[float, float]:
    """Largest and mean deviation of label counts from their quotas."""
    support, have = Counter(x for v in labels.values() for x in v), Counter((x, split[p]) for p, v in labels.items() for x in v)
    off = [abs(have[x, s] - t) / max(1, t) for x, n in support.items() for s, t in largest_remainder(n, ratios).items()]
    return max(off, default=0.0), sum(off) / max(1, len(off))


def constrained_split(pages: DataFrame, key: str, seeds: tuple[int, ...] = (42, 43, 44), ratios: dict[str, float] = RATIOS, max_pages: int = 50_000) -> DataFrame:
    """(seed, key, split, worst, mean) of the best seed; pages has key, labels and tokens as arrays.

    Each seed is solved whole in one task, which bounds the page table: more than max_pages rows fail.
    """
    if (n := pages.count()) > max_pages:
        raise ValueError(f"{n} pages; the solver takes at most {max_pages}, deal strata with splits.assign instead")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        labels, tokens = dict(zip(frame[key], map(list, frame["labels"]))), dict(zip(frame[key], map(list, frame["tokens"])))
        split = solve(labels, tokens, int(frame["seed"].iloc[0]), ratios)
        worst, mean = objective(labels, split, ratios)
        return pd.DataFrame({"seed": frame["seed"], key: frame[key], "split": frame[key].map(split), "worst": worst, "mean": mean})

    runs = pages.select(key, "labels", "tokens", F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    solved = runs.groupBy("seed").applyInPandas(one, f"seed int, {key} {dict(pages.dtypes)[key]}, split string, worst double, mean double")
    best = solved.groupBy("seed").agg(F.first("worst").alias("worst"), F.first("mean").alias("mean")).orderBy("worst", "mean", "seed").limit(1).select("seed")
    return solved.join(F.broadcast(best), "seed")


def split_by_strata(pages: DataFrame, key: str, seeds: tuple[int, ...] = (42, 43, 44), ratios: dict[str, float] = RATIOS, stratum_pages: int = 10_000) -> DataFrame:
    """(seed, key, split, worst, mean) of the best seed, for any number of pages: one stratum up to stratum_pages, else several of about half of that.

    Strata are dealt by a hash of the key. In each, train gets every type that the stratum's pages have, as far as it has room; worst and mean
    are of the label counts of all pages. One stratum is left to constrained_split.
    """
    if (n := pages.count()) <= stratum_pages:
        return constrained_split(pages, key, seeds, ratios)
    strata = -(-2 * n // stratum_pages)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)  # so that a task that runs again solves alike
        labels, tokens = dict(zip(frame[key], map(list, frame["labels"]))), dict(zip(frame[key], map(list, frame["tokens"])))
        split = solve(labels, tokens, int(frame["seed"].iloc[0]), ratios)
        return pd.DataFrame({"seed": frame["seed"], key: frame[key], "split": frame[key].map(split), "labels": frame["labels"]})

    stratum = F.pmod(F.xxhash64(F.lit(29), key), F.lit(strata)).alias("stratum")
    runs = pages.select(key, "labels", "tokens", stratum, F.explode(F.array(*map(F.lit, seeds))).alias("seed"))
    # a task for each stratum and seed
    runs = runs.repartition(strata * len(seeds), "seed", "stratum")
    solved = runs.groupBy("seed", "stratum").applyInPandas(one, f"seed int, {key} {dict(pages.dtypes)[key]}, split string, labels array<string>").persist()
    counts = solved.select("seed", "split", F.explode("labels").alias("label")).groupBy("seed", "label", "split").agg(F.count(F.lit(1)).alias("c")).collect()
    marks = []
    for seed in seeds:
        have = Counter({(r["label"], r["split"]): r["c"] for r in counts if r["seed"] == seed})
        support = Counter()
        for (label, _), c in have.items():
            support[label] += c
        off = [abs(have[x, s] - t) / max(1, t) for x, m in support.items() for s, t in largest_remainder(m, ratios).items()]
        marks.append((max(off, default=0.0), sum(off) / max(1, len(off)), seed))
    worst, mean, best = min(marks)
    return solved.where(F.col("seed") == best).select("seed", key, "split", F.lit(float(worst)).alias("worst"), F.lit(float(mean)).alias("mean"))
