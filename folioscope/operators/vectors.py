"""Embedding vectors as array<double> columns: products, neighbours, clusters and their quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; zeros stay. The length is bound once: a column would be worked out again for each component."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0)))[0]


def normalized(rows: DataFrame, vector: str) -> DataFrame:
    """rows with vector scaled to length 1."""
    return rows.withColumn(vector, unit(F.col(vector)))


def fused(a: Column, b: Column) -> Column:
    """Two unit vectors side by side with equal weight, of length 1 again."""
    return F.transform(F.concat(a, b), lambda x: x / F.sqrt(F.lit(2.0)))


def knn(rows: DataFrame, key: str, vector: str, queries: Column, k: int, block_rows: int = 4096, max_blocks: int = 4096) -> DataFrame:
    """(query, rank, neighbour, cosine): the k nearest rows by cosine of those rows where queries holds, ties by key.

    Exact and in blocks: candidates and queries are dealt in blocks, each pair of blocks is one matrix product in one task that keeps k rows a
    query. The stated query set against all rows is the operator's meaning; its blocks bound what a task holds.
    """
    unit_rows = normalized(rows.select(key, vector, queries.alias("__q")), vector)
    sizes = unit_rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("__q"), 1)).alias("q")).first()
    blocks, parts = (max(1, min(max_blocks, -(-sizes[c] // block_rows))) for c in ("n", "q"))
    here = unit_rows.select(key, vector, F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = unit_rows.where("__q").select(F.col(key).alias("query"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query": [], "neighbour": [], "cosine": []}).astype({"query": "int64", "neighbour": "int64"})
        x, ids, asked_ids, v, out = np.stack(a[vector].to_numpy()), a[key].to_numpy(), b["query"].to_numpy(), np.stack(b["v"].to_numpy()), []
        for s in range(0, len(v), 256):
            q = asked_ids[s : s + 256]
            c = np.round(v[s : s + 256] @ x.T, 9)
            c[(q[:, None] == ids) | ~np.isfinite(c)] = -np.inf
            least = np.partition(c, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            r, j = np.nonzero((c >= least[:, None]) & np.isfinite(c))
            by = np.lexsort((ids[j], -c[r, j], r))
            r, j = r[by], j[by]
            top = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pd.DataFrame({"query": q[r[top]], "neighbour": ids[j[top]], "cosine": c[r[top], j[top]]}))
        return pd.concat(out, ignore_index=True)

    near = here.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(best, "query long, neighbour long, cosine double")
    w = W.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "cosine")


def centroids(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, n, mean array<double>): sums by dimension, partially aggregated before the shuffle."""
    dims = rows.select(cluster, F.posexplode(vector).alias("d", "x")).groupBy(cluster, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("c"))
    return dims.groupBy(cluster).agg(F.max("c").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda x: x["m"]).alias("mean"))


def cosine_to_centroid(rows: DataFrame, cluster: str, vector: str) -> DataFrame:
    """rows with the cosine to their cluster's mean; the means are broadcast where Spark finds them small enough."""
    scaled = normalized(rows, vector)
    mean = centroids(scaled, cluster, vector)
    return scaled.join(mean, cluster).withColumn("cosine", dot(F.col(vector), F.col("mean")) / norm(F.col("mean")))


def medoids(rows: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """Size, medoid and its cosine of each cluster; ties by the smaller key."""
    near = cosine_to_centroid(rows, cluster, vector).withColumn("cosine", F.round("cosine", 9))
    return near.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), F.max(F.struct(F.col("cosine"), (-F.col(key)).alias("k"))).alias("x")).select(cluster, "size", (-F.col("x.k")).alias("medoid"), F.col("x.cosine").alias("cosine"))


def silhouette(rows: DataFrame, key: str, cluster: str, vector: str) -> DataFrame:
    """(key, cluster, silhouette) by cosine distance, exact from cluster sums: a mean of cosines is the product with a mean.

    Each row meets each cluster once, not each other row; the table of clusters is broadcast, its size is the number of clusters.
    """
    scaled = normalized(rows.select(key, cluster, vector), vector)
    sums = centroids(scaled, cluster, vector).select(F.col(cluster).alias("__c"), F.col("n").alias("__n"), F.col("mean").alias("__m"))
    far = scaled.crossJoin(F.broadcast(sums)).select(key, cluster, "__c", "__n", (1 - dot(F.col(vector), F.col("__m"))).alias("__d"))
    own = F.max(F.when(F.col("__c") == F.col(cluster), F.when(F.col("__n") > 1, F.col("__d") * F.col("__n") / (F.col("__n") - 1))))
    other = F.min(F.when(F.col("__c") != F.col(cluster), F.col("__d")))
    ab = far.groupBy(key, cluster).agg(own.alias("a"), other.alias("b"))
    return ab.select(key, cluster, F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information of two labelings, from their contingency table."""
    table = rows.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("c"))
    pairs = lambda c: c * (c - 1) / 2
    cells = table.agg(F.sum(pairs(F.col("c"))).alias("ij"), F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("hij"))
    side = lambda k: table.groupBy(k).agg(F.sum("c").alias("c")).agg(F.sum(pairs(F.col("c"))).alias(f"p{k}"), F.sum(F.col("c") * F.log("c")).alias(f"h{k}"))
    all_ = cells.crossJoin(side(a)).crossJoin(side(b))
    n, pa, pb = F.col("n"), F.col(f"p{a}"), F.col(f"p{b}")
    expected = pa * pb / pairs(n)
    ha, hb = F.log(n) - F.col(f"h{a}") / n, F.log(n) - F.col(f"h{b}") / n
    mutual = ha + hb - (F.log(n) - F.col("hij") / n)
    return all_.select(((F.col("ij") - expected) / ((pa + pb) / 2 - expected)).alias("ari"), (mutual / ((ha + hb) / 2)).alias("nmi"))


def diverse_pair(rows: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """Of each group the pair with the smallest cosine, ties by the keys; each group is a question's few dozen samples."""
    scaled = normalized(rows.select(key, group, vector), vector)
    a = scaled.select(group, F.col(key).alias("a"), F.col(vector).alias("va"))
    b = scaled.select(group, F.col(key).alias("b"), F.col(vector).alias("vb"))
    pairs = a.join(b, group).where("a < b").select(group, "a", "b", F.round(dot(F.col("va"), F.col("vb")), 9).alias("cosine"))
    return pairs.groupBy(group).agg(F.min(F.struct("cosine", "a", "b")).alias("x")).select(group, "x.a", "x.b", "x.cosine")


#: Centers that are broadcast at once.
CENTER_BLOCK = 10_000


def coverage(rows: DataFrame, centers: DataFrame, vector: str, limits: list[float]) -> DataFrame:
    """Share of rows whose best cosine with a center reaches each limit.

    Centers are counted and broadcast in blocks of about CENTER_BLOCK, one after the other; the rows stay where they are.
    """
    unit = normalized(centers.select(F.col(vector).alias("__v")), "__v")
    blocks = max(1, -(-centers.count() // CENTER_BLOCK))
    best = normalized(rows.select(vector), vector).withColumn("best", F.lit(None).cast("double"))
    for i in range(blocks):
        part = unit.where(F.pmod(F.xxhash64("__v"), F.lit(blocks)) == i).agg(F.collect_list("__v").alias("__all"))
        best = best.crossJoin(F.broadcast(part)).select(vector, F.greatest("best", F.array_max(F.transform("__all", lambda c: dot(F.col(vector), c)))).alias("best"))
    shares = best.agg(*[F.avg((F.round("best", 9) >= t).cast("double")).alias(f"t{i}") for i, t in enumerate(limits)])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(t).alias("limit"), F.col(f"t{i}").alias("covered")) for i, t in enumerate(limits)])).alias("x")).select("x.*")


def vector_quality(rows: DataFrame, vector: str, dims: int, low: float = 1e-6, high: float = 1e6) -> Column:
    """Reasons why a vector isn't usable, joined by |; empty if it is."""
    v = F.col(vector)
    size, bad = F.coalesce(F.size(v), F.lit(0)), F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")))
    length = norm(v)
    return F.array_join(F.array_compact(F.array(F.when(v.isNull(), "missing"), F.when(size != dims, "dims"), F.when(bad, "not_finite"), F.when(~bad & ~length.between(low, high), "norm"))), "|")


def spherical_kmeans(rows: DataFrame, group: str, key: str, vector: str, k: int, seed: int = 0, iterations: int = 300, restarts: int = 30, tolerance: float = 1e-6) -> DataFrame:
    """(group, key, cluster): spherical k-means in each group, a question's bounded set of samples, with deterministic seeds.

    Seeds are drawn by the square of the distance to those drawn before; an empty cluster gets the row that is furthest from its own centre
    among clusters of several; clusters are numbered by the key of the row nearest to their centre, compared as text.
    """

    def centres(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        new = np.zeros((n, x.shape[1]))
        np.add.at(new, at, x)
        for j in np.flatnonzero(np.bincount(at, minlength=n) == 0):
            loose = np.where(np.bincount(at, minlength=n)[at] > 1, (x * new[at]).sum(1) / np.maximum(np.linalg.norm(new[at], axis=1), 1e-12), np.inf)
            far = int(loose.argmin())
            new[at[far]] -= x[far]
            new[j], at[far] = x[far], j
        return new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key)
        x = np.stack(frame[vector].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        n, best, label, middle = min(k, len(x)), -np.inf, np.zeros(len(x), int), x[:1]
        for r in range(restarts):
            rng = np.random.default_rng(seed + r)
            c = [x[rng.integers(len(x))]]
            while len(c) < n:
                far = np.clip(1 - (x @ np.array(c).T).max(1), 0, 2) ** 2
                c.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
            c, at, score = np.array(c), np.full(len(x), -1), -np.inf
            for _ in range(iterations):
                near = x @ c.T
                new, total = near.argmax(1), near.max(1).sum()
                c = centres(x, new.copy(), n)
                done, at = (new == at).all() or abs(total - score) < tolerance, new
                score = total
                if done:
                    break
            near = x @ c.T
            if near.max(1).sum() > best + 1e-12:
                best, label, middle = near.max(1).sum(), near.argmax(1), c
        names = frame[key].astype(str).to_numpy()
        first = [names[np.flatnonzero(label == j)[(x[label == j] @ middle[j]).argmax()]] if (label == j).any() else None for j in range(len(middle))]
        place = {j: i for i, j in enumerate(sorted(range(len(middle)), key=lambda j: (first[j] is None, first[j] or "")))}
        return pd.DataFrame({group: frame[group], key: frame[key], "cluster": np.array([place[j] for j in label], np.int32)})

    schema = f"{group} {dict(rows.dtypes)[group]}, {key} {dict(rows.dtypes)[key]}, cluster int"
    return rows.select(group, key, vector).groupBy(group).applyInPandas(solve, schema)


def principal_components(rows: DataFrame, group: str, key: str, vector: str, dims: int) -> DataFrame:
    """(group, key, reduced array<double>): PCA of each group's vectors, signs fixed by the largest loading."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame[vector].to_numpy()).astype(float)
        x -= x.mean(0)
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        axes = axes[:dims] * np.sign(axes[:dims][np.arange(len(axes[:dims])), np.abs(axes[:dims]).argmax(1)])[:, None]
        return pd.DataFrame({group: frame[group], key: frame[key], "reduced": list(x @ axes.T)})

    schema = f"{group} {dict(rows.dtypes)[group]}, {key} {dict(rows.dtypes)[key]}, reduced array<double>"
    return rows.select(group, key, vector).groupBy(group).applyInPandas(solve, schema)


def elbow(curve: DataFrame, k: str, value: str) -> DataFrame:
    """One row: the point of a curve furthest from the line between its ends, both axes scaled to 0..1; ties by smaller k."""
    w = W.partitionBy()
    s = curve.select(F.col(k), ((F.col(k) - F.min(k).over(w)) / (F.max(k).over(w) - F.min(k).over(w))).alias("x"), ((F.col(value) - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w))).alias("y"))
    ends = s.agg(F.min_by("y", "x").alias("y0"), F.max_by("y", "x").alias("y1"))
    far = F.abs(F.col("y") - (F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("x"))) / F.sqrt(1 + F.pow(F.col("y1") - F.col("y0"), 2))
    return s.crossJoin(F.broadcast(ends)).select(F.col(k), F.round(far, 9).alias("distance")).orderBy(F.desc("distance"), k).limit(1)
