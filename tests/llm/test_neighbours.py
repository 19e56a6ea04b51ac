"""Approximate neighbours: recall against brute force, and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import neighbours, queries


def brute(x, ids, q, k=10):
    far = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
    far[ids == q] = np.inf
    order = np.lexsort((ids, far))[:k]
    return [(int(ids[i]), far[i]) for i in order if np.isfinite(far[i])]


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (30, 16))
    x = (centers[rng.integers(0, 30, 3000)] + rng.normal(0, 0.4, (3000, 16))).astype(np.float32)
    x[:900] = x[0]  # a vector that a third of the rows share
    return x.astype(float), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_recall(clustered):
    x, df = clustered
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, parts=15, block_rows=128).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    recall = []
    for q in range(0, 3000, 50):
        want = brute(x, np.arange(3000), q)
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        recall.append(len({v for v, _ in got[q]} & {v for v, _ in want}) / 10)
        assert all(abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-9 for v, s in got[q])
    assert np.mean(recall) >= 0.9
    assert [v for v, _ in got[0]] == list(range(1, 11))  # ties to smaller ids


def test_recall_of_the_query(spark):
    """The registered query over whole tables, in several parts, which it probes in part."""
    for sf, least in (("sf0.01", 0.9), ("sf0.1", 0.9)):
        path = f"/root/testdata/{sf}"
        rows = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").collect()
        x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
        got = {}
        for r in queries.op7_nearest_neighbours(spark, path).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        asked = [int(i) for i in ids if i % 100 == 0]
        assert sorted(got) == asked and all(len(v) == 10 for v in got.values())
        assert np.mean([len(set(got[q]) & {v for v, _ in brute(x, ids, q)}) / 10 for q in asked]) >= least


def test_parts_are_balanced(clustered):
    x, _ = clustered
    x = np.unique(x, axis=0)
    label = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 10), 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() <= 1.15 * len(x) / 8 and sizes.min() >= 0.85 * len(x) / 8


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (1, [1.0, 0.5]), (9, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("x"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") < 9).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 9, 2.0)]
    assert [g[2] for g in got[3:]] == [0, 9]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
