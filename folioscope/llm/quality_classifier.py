"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance shrinks towards the pooled one and that towards a sphere. A score is the difference of the
two log densities (Mahalanobis terms by the cached inverse Cholesky factors) put through a logistic link fitted on the same sample.

Defined results: null and empty texts have statistics of zero and are scored by the same formula; repeated rows get the same score;
without labels of both classes every score is the share of label 1 (0.5 without labels); texts of any length are read whole; an empty
table gives an empty table; other columns pass through, but one named as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_ids

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_MARK = b"#*$%&|<>"
_POINT = b".,;:!?"

#: Names of the transformed statistics, in order.
STATISTICS = ("log_words", "mean_chars", "upper", "digits", "marks", "points", "bars", "distinct", "new_pairs", "stutter", "dup_lines", "log_line_words")


def measure(text: str | None) -> list[float]:
    """The transformed statistics of one whole text; ratios by the arcsine root, counts by the logarithm."""
    if not text or not (words := text.split()):
        return [0.0] * len(STATISTICS)
    raw, n = text.encode("utf-8", "surrogatepass"), len(words)
    size = max(1, len(text) - text.count(" "))
    count = lambda kind: len(raw) - len(raw.translate(None, kind))
    root = lambda part, of: float(np.arcsin(np.sqrt(min(1.0, part / of))))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    pairs = set(zip(words, words[1:])) if n > 1 else set()
    stutter = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(n), size / n, root(count(_UPPER), size), root(count(_DIGIT), size), root(count(_MARK), size), root(count(_POINT), size), root(raw.count(b"|"), n), root(len(set(words)), n),
        root(len(pairs), max(1, n - 1)), root(stutter, n), root(len(lines) - len(set(lines)), max(1, len(lines))), np.log1p(n / max(1, len(lines))),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the classes 0 and 1, and the link's two numbers."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    log_terms: np.ndarray
    link: tuple[float, float]
    base: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, in units of the dimensions."""
        z = (x - self.center) / self.scale
        logs = [self.log_terms[c] - 0.5 * (((z - self.means[c]) @ self.inverse[c].T) ** 2).sum(1) for c in (0, 1)]
        return (logs[1] - logs[0]) / len(self.center)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        # the margin's tails are compressed, so that scores keep their order short of rounding
        m = self.margin(x)
        return 1 / (1 + np.exp(-np.clip(self.link[0] * np.arcsinh(m) + self.link[1], -36, 36)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.2, sphere: float = 0.1) -> Discriminant:
    """Fit on statistics x and labels y (0 or 1); shrink mixes in the pooled covariance, sphere its mean variance."""
    d = len(STATISTICS)
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(np.zeros(d), np.ones(d), np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), (1, 0), 0.5 if len(y) == 0 else float(np.mean(y)))
    center, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - center) / scale
    means = np.stack([z[y == c].mean(0) for c in (0, 1)])
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = sum(own[c] * (y == c).mean() for c in (0, 1))
    pooled = (1 - sphere) * pooled + sphere * np.trace(pooled) / d * np.eye(d)
    factors = [np.linalg.cholesky((1 - shrink) * own[c] + shrink * pooled) for c in (0, 1)]
    model = Discriminant(center, scale, means, np.stack([np.linalg.inv(f) for f in factors]), np.array([np.log((y == c).mean()) - np.log(np.diag(factors[c])).sum() for c in (0, 1)]), (1.0, 0.0))
    m, w = np.arcsinh(model.margin(x)), np.array([1.0, 0.0])
    design, target = np.stack([m, np.ones(len(m))], 1), np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(50):  # Newton steps of a logistic regression with a weak prior
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        w = w - np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (p - target) + 1e-3 * w)
    model.link = (float(max(w[0], 1e-3)), float(w[1]))
    return model


def _measured(texts: pd.Series) -> np.ndarray:
    return np.array([measure(t) for t in texts], float).reshape(-1, len(STATISTICS))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", max_rows: int = 12_000, **params) -> Discriminant:
    """Fit on at most max_rows labelled rows outside the held-out fifth (documented bound); only their statistics come to the driver."""
    chosen = F.broadcast(labelled_ids(labels, label, max_rows))

    def statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": list(_measured(b["text"]))})

    rows = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(chosen, "doc_id").select("doc_id", "label", "text")
    # of texts under one id that with the smallest statistics counts, so that the model is the same on every run
    found = rows.mapInPandas(statistics, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).orderBy("doc_id").collect()
    return fit(np.array([r["x"] for r in found], float).reshape(-1, len(STATISTICS)), np.array([r["label"] for r in found], int), **params)


def classify(docs: DataFrame, model: Discriminant, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score (double, 0 to 1); one Arrow pass, no shuffle."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_measured(texts)))

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != score], scored(F.col(text)).alias(score))
