"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the graph of its vectors' nearest neighbours is cut into parts of equal size, moving vertices to where most of their
neighbours are while parts have room; a small network learns the part from the vector. Every vector is indexed under its most probable
part, a query is routed to its most probable ones, and their vectors are ranked by exact distance. How many parts a query probes is set on
the sample, so that they hold nearly all of its true neighbours there.

Parts are dealt in blocks of bounded size, and a part's queries in blocks too, so a part of any size (a vector repeated a million times)
is work for many tasks; each sends back a query's nearest few.

Defined results: null vectors, vectors of zeros, with a null or non-finite component or of another length than most take no part; nor do
null ids; a query's own id is no candidate of it; rows that repeat an id are candidates each, as a query the smallest vector counts;
an empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

RESULT = "query_id long, vec_id long, score double"


@dataclass
class Router:
    """A network with one hidden layer: probabilities of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    center: np.ndarray
    scale: float
    probes: int

    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.center) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest other rows."""
    k = min(k, len(x) - 1)
    norms = (x**2).sum(1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        far = norms[None, :] - 2 * x[a : a + 1024] @ x.T
        far[np.arange(len(far)), np.arange(a, a + len(far))] = np.inf
        out[a : a + 1024] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """A part for each row: median splits along principal directions, then moves that cut fewer edges while no part exceeds its room."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = first
            continue
        z = x[rows] - x[rows].mean(0)
        order = np.argsort(z @ np.linalg.eigh(z.T @ z)[1][:, -1], kind="stable")
        cut = len(rows) * (n // 2) // n
        todo += [(rows[order[:cut]], first, n // 2), (rows[order[cut:]], first + n // 2, n - n // 2)]
    rng, most = np.random.default_rng(seed), int(np.ceil((1 + slack) * len(x) / parts))
    least = int((1 - slack) * len(x) / parts)
    sizes = np.bincount(label, minlength=parts)
    back = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    back = back[np.argsort(back[:, 0], kind="stable")]
    edges = np.searchsorted(back[:, 0], np.arange(len(x) + 1))
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(len(x)):
            votes = np.bincount(label[back[edges[v] : edges[v + 1], 1]], minlength=parts)
            to = int(votes.argmax())
            if votes[to] > votes[label[v]] and sizes[to] < most and sizes[label[v]] > least:
                sizes[label[v]] -= 1
                sizes[to] += 1
                label[v] = to
                moved += 1
        if moved < len(x) // 200:
            break
    return label


def fit(x: np.ndarray, parts: int, k: int = 10, hidden: int = 96, steps: int = 400, reach: float = 0.98, seed: int = 5) -> Router:
    """Cut the sample's graph, train the router (Adam on soft targets: the parts of a row and its neighbours) and set the probes."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    x = np.unique(x, axis=0)
    x = x[rng.permutation(len(x))]
    parts = max(1, min(parts, len(x) // 16))
    center, scale = x.mean(0), float(x.std()) + 1e-12
    if parts == 1:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), center, scale, 1)
    graph = neighbour_graph(x, k)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 0.5 / graph.shape[1])
    target[np.arange(len(x)), label] += 0.5
    z = (x - center) / scale
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        rows = rng.integers(0, len(z), min(512, len(z)))
        h = np.maximum(z[rows] @ p[0] + p[1], 0)
        out = h @ p[2] + p[3]
        out = np.exp(out - out.max(1, keepdims=True))
        err = (out / out.sum(1, keepdims=True) - target[rows]) / len(rows)
        back = (err @ p[2].T) * (h > 0)
        for i, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ err, err.sum(0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] -= 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(*p, center, scale, parts)
    # the index follows the router, so the probes are set against its own assignment
    logits = router.logits(x)
    home, order = logits.argmax(1), np.argsort(-logits, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    depth = np.sort(np.take_along_axis(place, home[graph], 1).ravel())
    router.probes = int(depth[min(len(depth) - 1, int(np.ceil(reach * len(depth))))]) + 1
    return router


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, sample_rows: int = 8192, block_rows: int = 16384, query_rows: int = 16384, parts: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest, by Euclidean distance in double precision, ties to the smaller vec_id.

    The router is fitted on at most sample_rows vectors (documented bound), chosen by seeded hash; every vector is indexed. The parts, half
    the root of the rows unless given, grow with the table up to one for 16 sampled rows; beyond, parts grow in blocks of their own tasks.
    """
    spark = vectors.sparkSession
    all_rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).where("vec_id is not null").where(usable(F.col("v")))
    sample = all_rows.select("vec_id", "v").orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(sample_rows).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = pd.Series([len(r["v"]) for r in sample])
    dims = int(lengths.mode().iloc[0])
    total = all_rows.count()
    router = fit(np.array([r["v"] for r in sample if len(r["v"]) == dims]), parts or max(2, round(total**0.5 / 2)))
    parts = router.parts()

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(part=router.logits(np.stack(b["v"].to_numpy())).argmax(1).astype(np.int32))

    index = stash(all_rows.where(F.size("v") == dims).select("vec_id", "v", F.coalesce("q", F.lit(False)).alias("q")).mapInPandas(placed, "vec_id long, v array<double>, q boolean, part int"), "index")
    held = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([held.get(p, 0) for p in range(parts)])
    blocks = np.maximum(1, -(-sizes // block_rows))
    queries = index.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    slices = max(1, -(-queries.count() * router.probes // (parts * query_rows)))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            order = np.argsort(-router.logits(np.stack(b["v"].to_numpy())), axis=1, kind="stable")
            enough = np.cumsum(sizes[order], axis=1) > k  # with the query itself
            probes = np.maximum(router.probes, np.where(enough.any(1), enough.argmax(1) + 1, parts))
            rows = [(q, v, int(p), s) for q, v, o, n in zip(b["vec_id"], b["v"], order, probes) for p in o[:n] for s in range(blocks[p])]
            yield pd.DataFrame(rows, columns=["query_id", "v", "part", "block"])

    def ranked(here: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(asked):
            x, ids = np.stack(here["v"].to_numpy()), here["vec_id"].to_numpy()
            for q, v in zip(asked["query_id"], asked["v"]):
                far = np.sqrt(((x - v) ** 2).sum(1))
                own = ids == q
                top = np.arange(len(ids)) if len(ids) <= k + own.sum() else np.flatnonzero(far <= np.partition(far, k + own.sum() - 1)[k + own.sum() - 1])
                top = top[ids[top] != q]
                top = top[np.lexsort((ids[top], far[top]))][:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[top], "score": far[top]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    counts = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("part") + 1)
    slice_of = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    here = index.select("vec_id", "v", "part", F.pmod(F.xxhash64(F.lit(2), "vec_id"), counts).cast("int").alias("block")).withColumn("slice", slice_of)
    asked = queries.mapInPandas(routed, "query_id long, v array<double>, part int, block int").withColumn("slice", F.pmod(F.xxhash64(F.lit(3), "query_id"), F.lit(slices)).cast("int"))
    keys = ["part", "block", "slice"]
    near = here.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(ranked, RESULT)
    by = W.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
