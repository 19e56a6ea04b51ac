"""Models over all vectors with Spark's own library: k-means sweeps, principal components, communities of a graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import vectors as V


def with_features(rows: DataFrame, vector: str) -> DataFrame:
    """rows with features, the vector scaled to length 1 as Spark's vector type."""
    return V.normalized(rows, vector).withColumn("features", array_to_vector(vector))


def kmeans(rows: DataFrame, vector: str, k: int, seed: int = 0, iterations: int = 20) -> DataFrame:
    """rows with cluster, by k-means on cosine distance over the whole table."""
    data = with_features(rows, vector)
    model = KMeans(k=k, seed=seed, maxIter=iterations, distanceMeasure="cosine", featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).drop("features")


def kmeans_sweep(rows: DataFrame, key: str, vector: str, ks: tuple[int, ...], seed: int = 0) -> DataFrame:
    """(k, silhouette, smallest): mean exact silhouette and the smallest cluster's share for each k."""
    out = None
    for k in ks:
        placed = kmeans(rows, vector, k, seed).select(key, vector, "cluster")
        mean = V.silhouette(placed, key, "cluster", vector).agg(F.avg("silhouette").alias("silhouette"))
        least = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).agg((F.min("n") / F.sum("n")).alias("smallest"))
        one = mean.crossJoin(F.broadcast(least)).select(F.lit(k).alias("k"), "silhouette", "smallest")
        out = one if out is None else out.unionByName(one)
    return out


def explained_variance(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """(component, share, cumulative) of the first principal components of all rows."""
    data = with_features(rows, vector)
    model = PCA(k=dims, inputCol="features", outputCol="reduced").fit(data)
    shares, run, out = model.explainedVariance.toArray().tolist(), 0.0, []
    for i, s in enumerate(shares, 1):
        run += s
        out.append((i, float(s), run))
    return rows.sparkSession.createDataFrame(out, "component int, share double, cumulative double")


def reduced(rows: DataFrame, vector: str, dims: int) -> DataFrame:
    """rows with reduced, the first principal components of the scaled vectors."""
    data = with_features(rows, vector)
    model = PCA(k=dims, inputCol="features", outputCol="__r").fit(data)
    return model.transform(data).withColumn("reduced", vector_to_array("__r")).drop("features", "__r")


def _written(rows: DataFrame) -> DataFrame:
    """rows written to the folder of spark.checkpoint.dir, or a local one where it is unset, and read back."""
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="folioscope-")
    path = f"{folder.rstrip('/')}/communities-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def communities(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, community) by weighted label propagation over edges (src, dst, weight), until no label changes; ties go to the smaller label.

    Synchronous rounds that keep a node's own label as one more vote, so that two labels do not swap for ever; votes are compared to six
    decimals, as the order of a sum is not fixed. The labels are written out each round; labels that still change after max_rounds fail.
    """
    both = edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    both = _written(both)
    top = both.groupBy("src").agg(F.max("weight").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
    both = _written(both.union(top))
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(max_rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.max(F.struct("w", (-F.col("community")).alias("c"))).alias("b")).select("node", (-F.col("b.c")).alias("community"))
        new = _written(best)
        changed = new.join(labels.withColumnRenamed("community", "old"), "node").where("community != old").count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"{changed} labels still change after {max_rounds} rounds")
