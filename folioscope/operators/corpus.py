"""Corpus statistics over expressions and their tokens; every operator takes and returns DataFrames.

An expression table has an id, a text and, once ``tokenized``, a column tokens. Vocabulary-sized tables are ranked in one task: they are
bounded by the tokenizer's vocabulary and the script's characters, not by the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import text as T


def tokenized(expressions: DataFrame, text: str = "text", vocabulary: list[str] | None = None) -> DataFrame:
    """expressions with tokens and norm, the stripped text; those without text are left out."""
    norm = T.normalized(F.col(text))
    return expressions.where(F.col(text).rlike(r"\S")).withColumn("norm", norm).withColumn("tokens", T.tokens(F.col("norm"), vocabulary))


def each(rows: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """(keep..., name): a row for each element that isn't null.

    The plain generator makes the optimizer ask ahead, at the scan, whether the array is empty, which would work it out twice.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def token_counts(corpus: DataFrame, *by: str) -> DataFrame:
    """(by..., token, count)."""
    return each(corpus, F.col("tokens"), "token", *by).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("count"))


def longtail(counts: DataFrame) -> DataFrame:
    """Rank, share and cumulative share of each token; ties by token."""
    order = W.orderBy(F.desc("count"), "token")
    total = F.sum("count").over(W.partitionBy())
    ranked = counts.select(F.row_number().over(order).cast("long").alias("rank"), "token", "count", F.sum("count").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("run"), total.alias("total"))
    return ranked.select("rank", "token", "count", (F.col("count") / F.col("total")).alias("share"), (F.col("run") / F.col("total")).alias("cumulative_share"))


def gini_and_coverage(counts: DataFrame, tops: tuple[int, ...] = (10, 50, 100, 500), rare: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: Gini coefficient, coverage of the most frequent tokens, share of rare types."""
    ranked = counts.select("count", F.row_number().over(W.orderBy("count", "token")).alias("i"), F.row_number().over(W.orderBy(F.desc("count"), "token")).alias("r"))
    n, total = F.count(F.lit(1)), F.sum("count")
    gini = T.ratio(F.sum(2 * F.col("i") * F.col("count")) - (n + 1) * total, n * total)
    parts = [T.ratio(F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("count"))), F.lit(0)), total).alias(f"top_{k}") for k in tops]
    types = [T.ratio(F.count(F.when(F.col("count") <= t, 1)), n).alias(f"rare_types_{t}") for t in rare]
    return ranked.agg(n.alias("vocabulary"), F.coalesce(total, F.lit(0)).alias("tokens"), gini.alias("gini"), *parts, *types)


def rare_expression_ratio(corpus: DataFrame, counts: DataFrame, key: str, thresholds: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """For each threshold the share of expressions that hold a token with no more occurrences in the corpus."""
    rare = counts.where(F.col("count") <= max(thresholds))
    least = each(corpus, F.array_distinct("tokens"), "token", key).join(rare, "token").groupBy(key).agg(F.min("count").alias("least"))
    total = corpus.agg(F.count(F.lit(1)).alias("total"))
    hits = least.agg(*[F.count(F.when(F.col("least") <= t, 1)).alias(str(t)) for t in thresholds])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(str(t)).alias("expressions")) for t in thresholds]))
    return hits.crossJoin(F.broadcast(total)).select(rows.alias("x"), "total").select("x.threshold", "x.expressions", T.ratio(F.col("x.expressions"), F.col("total")).alias("ratio"))


def zero_filled(counts: DataFrame, key: str, domain: list, value: str = "count") -> DataFrame:
    """counts for every member of the domain, 0 where there are none, with its place."""
    spark = counts.sparkSession
    names = spark.createDataFrame([(x, i) for i, x in enumerate(domain)], f"{key} string, place int")
    return F.broadcast(names).join(counts, key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def taxonomy(counts: DataFrame) -> DataFrame:
    """Tokens and share of each category, zeros kept; categories are told once a distinct token."""
    by = counts.groupBy(T.category(F.col("token")).alias("category")).agg(F.sum("count").alias("count"))
    full = zero_filled(by, "category", list(T.CATEGORIES))
    return full.select("place", "category", "count", T.ratio(F.col("count"), F.sum("count").over(W.partitionBy())).alias("share"))


def length_distribution(corpus: DataFrame, length: Column, *by: str) -> DataFrame:
    """Mean, population deviation, variation, percentiles and maximum of lengths."""
    q = F.percentile(length, F.array(*map(F.lit, (0.5, 0.9, 0.95, 0.99))))
    out = corpus.groupBy(*by).agg(F.count(length).alias("n"), F.avg(length).alias("mean"), F.stddev_pop(length).alias("std"), q.alias("q"), F.max(length).cast("long").alias("max"))
    return out.select(*by, "n", "mean", "std", T.ratio(F.col("std"), F.col("mean")).alias("cv"), *[F.col("q")[i].alias(p) for i, p in enumerate(("p50", "p90", "p95", "p99"))], "max")


def bin_counts(corpus: DataFrame, length: Column, bins: list[tuple] = T.LENGTH_BINS) -> DataFrame:
    """Rows and share of each bin, zeros kept."""
    by = corpus.groupBy(T.binned(length, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    full = zero_filled(by, "bin", [b[0] for b in bins])
    return full.select("place", "bin", "count", T.ratio(F.col("count"), F.sum("count").over(W.partitionBy())).alias("share"))


def digest(text: Column) -> Column:
    """16 bytes that stand for a text in groups and joins, so that texts themselves are not shuffled."""
    return F.unhex(F.md5(text.cast("binary")))


def scale(corpus: DataFrame, *by: str) -> DataFrame:
    """Expressions, tokens, vocabulary, distinct strings and the rate of redundant ones; two aggregations instead of nested distincts."""
    base = corpus.groupBy(*by, digest(F.col("norm")).alias("d")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("tokens")).alias("t"))
    base = base.groupBy(*by).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("expressions"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("unique_strings"))
    both = _with_vocabulary(base, corpus, by)
    return both.withColumn("duplicate_rate", T.ratio(F.col("expressions") - F.col("unique_strings"), F.col("expressions")))


def _with_vocabulary(base: DataFrame, corpus: DataFrame, by: tuple[str, ...]) -> DataFrame:
    words = each(corpus, F.array_distinct("tokens"), "token", *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("vocabulary"))
    return base.join(words, list(by)) if by else base.crossJoin(F.broadcast(words))


def duplicate_sizes(corpus: DataFrame) -> DataFrame:
    """How many groups of equal texts there are of each size."""
    return corpus.groupBy(digest(F.col("norm")).alias("d")).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def duplicate_stats(corpus: DataFrame) -> DataFrame:
    """One row: texts, distinct ones, redundant ones, those in groups, groups and the largest."""
    sizes = corpus.groupBy(digest(F.col("norm")).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    n, grouped = F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0))
    return sizes.agg(
        n.alias("expressions"), F.count(F.lit(1)).alias("unique_expressions"), (n - F.count(F.lit(1))).alias("redundant"), T.ratio(n - F.count(F.lit(1)), n).alias("duplicate_rate"), grouped.alias("grouped"),
        T.ratio(grouped, n).alias("grouped_ratio"), F.count(F.when(F.col("c") > 1, 1)).alias("duplicate_groups"), F.coalesce(F.max("c"), F.lit(0)).alias("largest"),
    )


def duplicate_groups(corpus: DataFrame, key: str, source: str) -> DataFrame:
    """Groups of equal texts: size, the smallest member, sources. Sources are counted by a first aggregation over (group, source)."""
    parts = corpus.groupBy(F.sha2(F.col("norm"), 256).alias("group"), source).agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("m"))
    out = parts.groupBy("group").agg(F.sum("c").alias("size"), F.min("m").alias("first_id"), F.count(source).alias("sources"))
    return out.where("size > 1")


def duplicate_index(corpus: DataFrame, key: str) -> DataFrame:
    """(key, group, group_size): groups are numbered by their smallest member, by joining counts back instead of a window over texts."""
    keyed = corpus.select(key, digest(F.col("norm")).alias("d"))
    sizes = keyed.groupBy("d").agg(F.count(F.lit(1)).alias("group_size"), F.min(key).alias("group"))
    return keyed.join(sizes, "d").select(key, "group", "group_size")


def content_kinds(corpus: DataFrame) -> DataFrame:
    by = corpus.groupBy(T.content_kind(F.col("tokens")).alias("kind")).agg(F.count(F.lit(1)).alias("count"))
    full = zero_filled(by, "kind", ["latex", "text", "mixed"])
    return full.select("kind", "count", T.ratio(F.col("count"), F.sum("count").over(W.partitionBy())).alias("share"))


def confusable_groups(corpus: DataFrame, counts: DataFrame) -> DataFrame:
    """For each group of look-alike tokens: tokens, share, expressions with one, and with two distinct of a subgroup."""
    flags, sums = [], []
    for name, subgroups in T.CONFUSABLE.items():
        members = [t for s in subgroups for t in s]
        some = F.arrays_overlap("tokens", F.array(*map(F.lit, members)))
        two = None
        for s in subgroups:
            hit = F.size(F.array_intersect(F.array_distinct("tokens"), F.array(*map(F.lit, s)))) >= 2
            two = hit if two is None else two | hit
        flags += [F.count(F.when(some, 1)).alias(f"{name}|e"), F.count(F.when(two, 1)).alias(f"{name}|t")]
        sums.append(F.coalesce(F.sum(F.when(F.col("token").isin(members), F.col("count"))), F.lit(0)).alias(f"{name}|c"))
    wide = corpus.agg(*flags).crossJoin(F.broadcast(counts.agg(*sums, F.sum("count").alias("total"))))
    rows = [F.struct(F.lit(n).alias("confusable_group"), F.col(f"{n}|c").alias("tokens"), T.ratio(F.col(f"{n}|c"), F.col("total")).alias("token_ratio"), F.col(f"{n}|e").alias("expressions"), F.col(f"{n}|t").alias("together")) for n in T.CONFUSABLE]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def similar_cooccurrence(page_counts: DataFrame) -> DataFrame:
    """Events of look-alike tokens on one page: where two distinct members of a subgroup occur, all their occurrences."""
    table = page_counts.sparkSession.createDataFrame([(s, t) for s, m in T.SIMILAR.items() for t in m.split()], "subgroup string, token string")
    held = page_counts.join(F.broadcast(table), "token").groupBy("page", "subgroup").agg(F.sum("count").alias("events"), F.count(F.lit(1)).alias("members")).where("members >= 2")
    found = held.groupBy("subgroup").agg(F.count(F.lit(1)).alias("pages"), F.sum("events").alias("events"))
    full = zero_filled(found, "subgroup", list(T.SIMILAR), "events")
    return full.select("subgroup", F.coalesce("pages", F.lit(0)).alias("pages"), "events")


def structures(array: Column) -> Column:
    """array<string> of the structures whose triggers occur; the distinct tokens are found once, then looked into."""
    some = lambda d, v: F.arrays_overlap(d, F.array(*map(F.lit, v)))
    listed = lambda d: F.array_compact(F.array(*[F.when(some(d, v), F.lit(k)) for k, v in T.STRUCTURE_TRIGGERS.items()]))
    return F.transform(F.array(F.array_distinct(array)), listed)[0]


def _member_of(values: list[str]):
    return lambda t: t.isin(values)


def structure_distribution(corpus: DataFrame) -> DataFrame:
    """For each structure: expressions with it, their share, and occurrences of its triggers, from one pass over distinct structures."""
    kinds = {t: k for k, v in T.STRUCTURE_TRIGGERS.items() for t in v}
    held = corpus.select(F.filter("tokens", _member_of(list(kinds))).alias("t"))
    sums = []
    for k, v in T.STRUCTURE_TRIGGERS.items():
        n = F.size(F.filter("t", _member_of(v)))
        sums += [F.sum(n).alias(f"{k}|n"), F.count(F.when(n > 0, 1)).alias(f"{k}|e")]
    wide = held.agg(*sums, F.count(F.lit(1)).alias("all"))
    rows = [F.struct(F.lit(k).alias("structure"), F.col(f"{k}|e").alias("expressions"), T.ratio(F.col(f"{k}|e").cast("double"), F.col("all")).alias("ratio"), F.col(f"{k}|n").alias("occurrences")) for k in T.STRUCTURE_TRIGGERS]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def structure_patterns(corpus: DataFrame) -> DataFrame:
    """Exact sets of structures, their counts and shares."""
    by = corpus.groupBy(F.array_join(F.array_sort(structures(F.col("tokens"))), "+").alias("pattern")).agg(F.count(F.lit(1)).alias("count"))
    return by.withColumn("share", F.col("count") / F.sum("count").over(W.partitionBy()))


def structure_grid(corpus: DataFrame) -> DataFrame:
    """Expressions for every ordered pair of structures, the diagonal included, zeros kept; sets are counted before they are paired."""
    sets = corpus.groupBy(structures(F.col("tokens")).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    pairs = each(each(sets, F.col("s"), "a", "s", "c"), F.col("s"), "b", "a", "c").groupBy("a", "b").agg(F.sum("c").alias("count"))
    names = list(T.STRUCTURE_TRIGGERS)
    grid = corpus.sparkSession.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    return F.broadcast(grid).join(pairs, ["a", "b"], "left").select("a", "b", F.coalesce("count", F.lit(0)).alias("count"))


def structure_complexity(corpus: DataFrame) -> DataFrame:
    n = F.col("n")
    corpus = corpus.select(F.size(structures(F.col("tokens"))).alias("n"))
    shares = [F.avg((n >= k).cast("double")).alias(f"at_least_{k}") for k in (1, 2, 3, 4)]
    return corpus.agg(*shares, F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("p50"), F.percentile(n, F.lit(0.9)).alias("p90"), F.max(n).cast("long").alias("max"))


def corpus_profile(corpus: DataFrame, by: str) -> DataFrame:
    """One row a group: scale, lengths, rare and duplicate ratios, structure shares.

    Equal texts meet once, with their number, so that one pass over them gives all but the vocabulary.
    """
    kinds = ("frac", "sup", "sub", "sqrt")
    rows = corpus.select(by, digest(F.col("norm")).alias("d"), F.size("tokens").alias("n"), structures(F.col("tokens")).alias("s"))
    texts = rows.groupBy(by, "d").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("s").alias("s"))
    share = lambda k: (F.sum(F.when(F.array_contains("s", k), F.col("c")).otherwise(0)) / F.sum("c")).alias(f"{k}_ratio")
    q = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9)), F.col("c"))
    sums = texts.groupBy(by).agg(
        F.sum("c").alias("expressions"), F.sum(F.col("c") * F.col("n")).alias("tokens"), F.count(F.lit(1)).alias("unique_strings"), (F.sum(F.col("c") * F.col("n")) / F.sum("c")).alias("mean"), q.alias("q"), F.max("n").cast("long").alias("max"), *map(share, kinds)
    )
    rate = T.ratio(F.col("expressions") - F.col("unique_strings"), F.col("expressions")).alias("duplicate_rate")
    full = _with_vocabulary(sums, corpus, (by,))
    return full.select(by, "expressions", "tokens", "unique_strings", "vocabulary", rate, "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"), "max", *[f"{k}_ratio" for k in kinds])


def page_metrics(pages: DataFrame, corpus: DataFrame, rare: DataFrame) -> DataFrame:
    """One row a page, those without expressions as zeros: expressions, tokens, distinct tokens, longest, occurrences of rare tokens."""
    sums = corpus.groupBy("page").agg(F.count(F.lit(1)).alias("expressions"), F.sum(F.size("tokens")).alias("tokens"), F.max(F.size("tokens")).cast("long").alias("longest"))
    words = token_counts(corpus, "page")
    distinct = words.join(rare.select("token", F.lit(1).alias("rare")), "token", "left").groupBy("page").agg(F.count(F.lit(1)).alias("distinct_tokens"), F.coalesce(F.sum(F.when(F.col("rare") == 1, F.col("count"))), F.lit(0)).alias("rare_tokens"))
    full = pages.select("page").distinct().join(sums, "page", "left").join(distinct, "page", "left")
    return full.na.fill(0)


def rare_detail(corpus: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """Of each rare token its occurrences, expressions and pages."""
    held = each(corpus, F.col("tokens"), "token", "key", "page").join(counts.where(F.col("count") <= most), "token")
    return held.groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("key").alias("expressions"), F.countDistinct("page").alias("pages"))


def rare_tail(counts: DataFrame, fraction: float = 0.08) -> DataFrame:
    """The rarest types by (count, token), a fraction of all, at least one."""
    placed = counts.withColumn("place", F.row_number().over(W.orderBy("count", "token"))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy()))
    return placed.where(F.col("place") <= F.greatest(F.lit(1), F.bround(fraction * F.col("n"), 0))).select("token", "count")


def lbd(length: Column, types: Column, depth: Column) -> Column:
    """Position of an expression by its length, structure types and depth, as LxByDz."""
    step = lambda v, a, b: F.when(v <= a, 1).when(v <= b, 2).otherwise(3).cast("string")
    return F.concat(F.lit("L"), step(length, 20, 40), F.lit("B"), step(types, 1, 2), F.lit("D"), step(depth, 1, 2))


def overview_histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Rows in each half-open interval of the edges, the last one closed; what lies outside is left out."""
    v, n = F.col(value), len(edges) - 1
    place = F.lit(None).cast("int")
    for i in range(n - 1, -1, -1):
        hit = (v >= edges[i]) & (v < edges[i + 1]) if i < n - 1 else (v >= edges[i]) & (v <= edges[i + 1])
        place = F.when(hit, i).otherwise(place)
    by = rows.select(place.alias("place")).where("place is not null").groupBy("place").agg(F.count(F.lit(1)).alias("count"))
    frame = rows.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(n)], "place int, low double, high double")
    return F.broadcast(frame).join(by, "place", "left").select("place", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))


def continuous_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, population deviation and percentiles of each column; one pass, then one row a metric."""
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    aggs = [F.struct(F.lit(c).alias("metric"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).cast("double").alias("min"), F.percentile(c, F.array(*map(F.lit, qs))).alias("q"), F.max(c).cast("double").alias("max")) for c in columns]
    out = rows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x"))
    return out.select("x.metric", "x.n", "x.mean", "x.std", "x.min", *[F.col("x.q")[i].alias(f"p{int(q * 100):02d}") for i, q in enumerate(qs)], "x.max")


def categorical_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and ratios of each column's labels."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("label")) for c in columns])).alias("x")).groupBy("x.field", "x.label").agg(F.count(F.lit(1)).alias("count"))
    return long.withColumn("ratio", F.col("count") / F.sum("count").over(W.partitionBy("field")))
