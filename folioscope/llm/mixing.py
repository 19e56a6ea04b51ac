"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

The tree has one level for each of ``levels`` (domain, language, source, ...). A token budget flows from the root to the leaves: each
node deals its budget among its children by weight; a child takes no more than it can supply (its tokens times ``max_epochs``) and
what it leaves over goes to its siblings first, since it stays within the parent's budget, and only what a whole subtree cannot take
reaches the subtree's siblings. Each level is solved in closed form with windows over the table of nodes.

A leaf then takes whole epochs of its documents, and of one more epoch the longest prefix, in the order of a seeded digest of the
document's id, whose tokens fit what is left.

Defined results: null levels are nodes named ""; a null or empty text has no tokens and comes with every epoch that is whole, or
within the prefix; null ids are ordered as ""; rows with the same id are taken together; a leaf without weight gets the default
weight; texts of any length are counted whole; an empty table gives an empty table; other columns pass through, whatever their
names, but one named as the copies is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, nested, stash, unnested

#: Leading hex digits of the order key by which a leaf's tokens are summed before its boundary bucket is looked into.
BUCKET_DIGITS = 3


def tokens_in(text: Column) -> Column:
    """Words of a text, as long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: int) -> Column:
    """The place of a document in its leaf's epochs."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Give each node (w, cap) its part of its parent's budget: min(cap, level * w), the level chosen so that the parts add up.

    In order of cap / w the first children are filled; the k-th is, if dealing what the earlier ones leave to it and all later ones
    by weight would exceed its cap. The level is that of the first child that isn't filled, the largest of those that aren't.
    """
    by = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = by.orderBy("__fill", *[c for c in nodes.columns if c.startswith("__l")])
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    dealt = (
        nodes.withColumn("__fill", F.col("__cap") / F.col("__w"))
        .withColumn("__taken", F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
        .withColumn("__rest", F.sum("__w").over(rest))
        .withColumn("__level", (F.col("__budget") - F.col("__taken")) / F.col("__rest"))
        .withColumn("__full", F.col("__fill") <= F.col("__level"))
        .withColumn("__open", F.max(F.when(~F.col("__full"), F.col("__level"))).over(by))
    )
    part = F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__open") * F.col("__w"))
    return dealt.withColumn("__part", F.least(F.greatest(part, F.lit(0.0)), F.col("__cap")))


def budgets(leaves: DataFrame, weights: list[dict[str, float]], total: Column, max_epochs: int, default_weight: float) -> DataFrame:
    """leaves (__l0.., __tokens) with __part, the tokens that each leaf is to give."""
    n = len(weights)
    keys = [f"__l{i}" for i in range(n)]
    supply = F.col("__tokens").cast("double") * max_epochs
    leaves = leaves.withColumn("__cap0", supply)
    budget: DataFrame | None = None
    for i, table in enumerate(weights):
        weight = F.lit(float(default_weight))
        for name, w in sorted(table.items()):
            weight = F.when(F.col(keys[i]) == name, F.lit(float(w))).otherwise(weight)
        nodes = leaves.groupBy(*keys[: i + 1]).agg(F.sum("__cap0").alias("__cap")).withColumn("__w", weight)
        above = keys[:i]
        if budget is None:
            nodes = nodes.withColumn("__budget", total)
        else:
            nodes = nodes.join(budget, above)
        budget = _deal(nodes, above).select(*keys[: i + 1], F.col("__part").alias("__budget"))
    return leaves.join(budget.withColumnRenamed("__budget", "__part"), keys)


def mix(docs: DataFrame, levels: list[Column], weights: list[dict[str, float]], doc_id: str = "doc_id", text: str = "text", share: float = 0.5, max_epochs: int = 1, default_weight: float = 1.0, seed: int = 11, n_copies: str = "n_copies") -> DataFrame:
    """docs with n_copies (long), how often the mixture takes each row; the budget is share of all tokens.

    The texts are not shuffled: of each leaf two numbers and the key of its last document come back, which are broadcast if they are few
    (a count decides) and joined in slices otherwise.
    """
    keys = [f"__l{i}" for i in range(len(levels))]
    named = {k: F.coalesce(x.cast("string"), F.lit("")) for x, k in zip(levels, keys)}
    placed = nested(docs, (n_copies,), __key=order_key(F.col(f"`{doc_id}`"), seed), **named)
    narrow = stash(docs.select(*[c.alias(k) for k, c in named.items()], order_key(F.col(f"`{doc_id}`"), seed).alias("__key"), tokens_in(F.col(f"`{text}`")).alias("__tokens")), "mix")
    bucket = F.substring("__key", 1, BUCKET_DIGITS)
    sums = narrow.groupBy(*keys, bucket.alias("__bucket")).agg(F.sum("__tokens").alias("__tokens"))
    leaves = sums.groupBy(*keys).agg(F.sum("__tokens").alias("__tokens"))
    whole = narrow.agg(F.coalesce(F.sum("__tokens"), F.lit(0)).alias("t")).first()["t"]
    dealt = budgets(leaves, weights, F.lit(float(whole) * share), max_epochs, default_weight)
    need = F.floor(F.round(F.col("__part"), 3))
    epochs = F.when(F.col("__tokens") > 0, F.floor(need / F.col("__tokens"))).otherwise(0)
    plan = stash(dealt.select(*keys, epochs.cast("long").alias("__epochs"), (need - epochs * F.col("__tokens")).cast("long").alias("__need")), "mix")
    # the bucket where the prefix ends, then the key where it ends
    run = W.partitionBy(*keys).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    marked = sums.withColumn("__before", F.coalesce(F.sum("__tokens").over(run), F.lit(0))).join(plan, keys)
    edge = marked.where((F.col("__before") <= F.col("__need")) & (F.col("__before") + F.col("__tokens") > F.col("__need"))).select(*keys, "__bucket", "__before", "__need")
    inner = narrow.withColumn("__bucket", bucket).join(F.broadcast(edge) if plan.count() <= BROADCAST_ROWS else edge, [*keys, "__bucket"])
    ids = inner.groupBy(*keys, "__key").agg(F.sum("__tokens").alias("__tokens"), F.first("__before").alias("__before"), F.first("__need").alias("__need"))
    upto = W.partitionBy(*keys).orderBy("__key").rowsBetween(W.unboundedPreceding, 0)
    last = ids.withColumn("__sum", F.col("__before") + F.sum("__tokens").over(upto)).where(F.col("__sum") <= F.col("__need")).groupBy(*keys).agg(F.max("__key").alias("__last"))
    cut = plan.join(edge.select(*keys, "__bucket"), keys, "left").join(last, keys, "left")
    # without an edge the prefix is the whole epoch only if nothing is left to cut, which epochs has counted
    cut = stash(cut.select(*keys, "__epochs", F.coalesce("__last", "__bucket", F.lit("")).alias("__last")), "mix")
    few = plan.count() <= BROADCAST_ROWS
    if few:
        joined = placed.join(F.broadcast(cut), keys)
    else:
        salt = F.pmod(F.conv(F.substring("__key", 1, 4), 16, 10).cast("int"), F.lit(64))
        joined = placed.withColumn("__salt", salt).join(cut.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(63)))), [*keys, "__salt"])
    copies = F.col("__epochs") + F.when((F.col("__key") <= F.col("__last")) & (F.col("__last") != ""), 1).otherwise(0)
    return joined.select(*unnested(docs.columns, (n_copies,)), copies.cast("long").alias(n_copies))


def copies_as_rows(mixed: DataFrame, n_copies: str = "n_copies") -> DataFrame:
    """Each row as often as it is taken, without the count."""
    rows = nested(mixed, (n_copies,), copies=F.col(n_copies)).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*unnested(mixed.columns, (n_copies,)))
