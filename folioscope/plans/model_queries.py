"""Queries of models; iterative, so without SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import models as M
from folioscope.operators import vectors as V
from folioscope.plans.common import Catalogue, table

Q = Catalogue()


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


@Q.add()
def kmeans_sweep(spark, sf_dir):
    return M.kmeans_sweep(_vectors(spark, sf_dir), "vec_id", "embedding", (2, 4))


@Q.add()
def explained_variance(spark, sf_dir):
    return M.explained_variance(_vectors(spark, sf_dir), "embedding", 16)


@Q.add()
def vector_communities(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    near = V.knn(rows, "vec_id", "embedding", F.lit(True), 5)
    edges = near.select(F.col("query").alias("src"), F.col("neighbour").alias("dst"), (1 / (1e-6 + 1 - F.col("cosine"))).alias("weight"))
    return M.communities(edges)
