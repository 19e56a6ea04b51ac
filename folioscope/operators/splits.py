"""Stratified splits: quotas, deviations, audits, and the constrained assignment of pages.

Quotas, hash order and audits are relational. The assignment is sequential by nature; it works on a table of stratum counts, not of rows:
pages with the same labels are alike, so each stratum is dealt as a whole and its pages follow in seeded order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.operators.relations import seeded_order

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def quotas(labels: DataFrame, label: str, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(label, split, n, quota) by largest remainder; ties go to the earlier split."""
    spark = labels.sparkSession
    parts = spark.createDataFrame([(s, r, i) for i, (s, r) in enumerate(ratios.items())], "split string, ratio double, place int")
    n = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(parts))
    exact = n.withColumn("exact", F.round(F.col("n") * F.col("ratio"), 9)).withColumn("whole", F.floor("exact"))
    left = exact.withColumn("left", F.col("n") - F.sum("whole").over(W.partitionBy(label))).withColumn("r", F.row_number().over(W.partitionBy(label).orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 9)), "place")))
    return left.select(label, "split", "n", (F.col("whole") + F.when(F.col("r") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def assign(rows: DataFrame, key: str, strata: str, seed: int, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(key, strata, split): each stratum's rows in seeded order, cut by its quotas."""
    q = quotas(rows, strata, ratios)
    order = F.create_map(*[x for i, s in enumerate(ratios) for x in (F.lit(s), F.lit(i))])
    ends = q.withColumn("end", F.sum("quota").over(W.partitionBy(strata).orderBy(order[F.col("split")]))).groupBy(strata).agg(F.array_sort(F.collect_list(F.struct(order[F.col("split")].alias("i"), "end", "split"))).alias("ends"))
    placed = rows.select(key, strata, F.row_number().over(W.partitionBy(strata).orderBy(seeded_order(F.col(key), seed), key)).alias("r"))
    joined = placed.join(ends, strata)
    return joined.select(key, strata, F.element_at(F.filter("ends", lambda e: e["end"] >= F.col("r")), 1)["split"].alias("split"))


def deviations(assigned: DataFrame, label: str, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """(label, split, count, share, target, deviation) for every label and split, zeros kept."""
    spark = assigned.sparkSession
    parts = spark.createDataFrame(list(ratios.items()), "split string, target double")
    n = assigned.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    got = assigned.groupBy(label, "split").agg(F.count(F.lit(1)).alias("count"))
    full = n.crossJoin(F.broadcast(parts)).join(got, [label, "split"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    share = F.col("count") / F.col("n")
    return full.select(label, "split", "count", share.alias("share"), "target", F.abs(share - F.col("target")).alias("deviation"))


def total_variation(assigned: DataFrame, label: str) -> DataFrame:
    """(split, tv): half the summed absolute difference of a split's label distribution from the whole."""
    all_ = assigned.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy()))
    got = assigned.groupBy("split", label).agg(F.count(F.lit(1)).alias("c"))
    splits = got.groupBy("split").agg(F.sum("c").alias("t"))
    grid = all_.select(label, "p").crossJoin(splits).join(got, ["split", label], "left")
    return grid.groupBy("split").agg((F.sum(F.abs(F.coalesce(F.col("c"), F.lit(0)) / F.col("t") - F.col("p"))) / 2).alias("tv"))


def vocabulary_audit(tokens: DataFrame) -> DataFrame:
    """One row: types in train, held out, and held out only; tokens has split and token."""
    by = tokens.groupBy("token").agg(F.max((F.col("split") == "train").cast("int")).alias("t"), F.max((F.col("split") != "train").cast("int")).alias("h"))
    return by.agg(F.sum("t").alias("train_types"), F.sum("h").alias("held_types"), F.count(F.when((F.col("t") == 0) & (F.col("h") == 1), 1)).alias("held_only"))


def move_for_coverage(assigned: DataFrame, key: str, tokens: DataFrame) -> DataFrame:
    """assigned with rows moved to train so that train has every type: of each type that train lacks, its first row by key moves."""
    held = tokens.join(assigned.select(key, "split"), key)
    missing = held.groupBy("token").agg(F.max((F.col("split") == "train").cast("int")).alias("t"), F.min(key).alias("first")).where("t = 0")
    moved = missing.select(F.col("first").alias(key), F.lit(1).alias("__m")).distinct()
    out = assigned.join(moved, key, "left")
    return out.withColumn("moved", F.col("__m").isNotNull()).withColumn("split", F.when(F.col("__m") == 1, "train").otherwise(F.col("split"))).drop("__m")
