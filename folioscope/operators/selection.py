"""Selecting samples: hard, diverse and random picks, cluster coverage, dedupe by cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.relations import seeded_order


def hard_pick(rows: DataFrame, by: str, key: str, first: list[Column], second: list[Column]) -> DataFrame:
    """Two rows a group: the first by one order, and of the others the first by another."""
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*first, key)))
    rest = ranked.withColumn("__s", F.row_number().over(W.partitionBy(by, (F.col("__r") == 1)).orderBy(*second, key)))
    return rest.where("__r = 1 or (__r > 1 and __s = 1)").withColumn("pick", F.when(F.col("__r") == 1, 1).otherwise(2)).drop("__r", "__s")


def random_pick(rows: DataFrame, by: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows a group in seeded digest order."""
    order = W.partitionBy(by).orderBy(seeded_order(F.col(key), seed), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def dedupe_by_cluster(rows: DataFrame, cluster: str, key: str, score: str, only: Column) -> DataFrame:
    """rows with reason: of those where only holds, the best of each cluster is kept (ties by smaller key), the rest removed; all others are kept."""
    best = rows.where(only).groupBy(cluster).agg(F.max(F.struct(F.col(score), (-F.col(key)).alias("k"))).alias("b")).select(cluster, (-F.col("b.k")).alias("__best"))
    joined = rows.join(best, cluster, "left")
    reason = F.when(~only, "not_random").when(F.col(key) == F.col("__best"), "best_of_cluster").otherwise("removed")
    return joined.withColumn("reason", reason).drop("__best")


def cover_clusters(rows: DataFrame, by: str, cluster: str, key: str, score: str, chosen: Column) -> DataFrame:
    """Replacements: of each cluster without a chosen row its best row, largest clusters first, as many as the group has chosen rows too many.

    Chosen rows beyond the first of a cluster are surplus, worst score first; the i-th surplus row is replaced by the i-th uncovered cluster's best.
    """
    sized = rows.withColumn("__size", F.count(F.lit(1)).over(W.partitionBy(by, cluster))).withColumn("__has", F.max(chosen.cast("int")).over(W.partitionBy(by, cluster)))
    best = sized.where("__has = 0").withColumn("__r", F.row_number().over(W.partitionBy(by, cluster).orderBy(F.desc(score), key))).where("__r = 1")
    added = best.withColumn("i", F.row_number().over(W.partitionBy(by).orderBy(F.desc("__size"), cluster))).select(by, "i", F.col(key).alias("added"), F.col(cluster).alias("added_cluster"))
    spare = sized.where(chosen).withColumn("__r", F.row_number().over(W.partitionBy(by, cluster).orderBy(F.desc(score), key))).where("__r > 1")
    removed = spare.withColumn("i", F.row_number().over(W.partitionBy(by).orderBy(score, key))).select(by, "i", F.col(key).alias("removed"))
    return removed.join(added, [by, "i"])
