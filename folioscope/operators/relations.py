"""Joins, validation, windows, sets and rollups on tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: repeated keys of either side, and keys that only one side has; for checks before a one-to-one join."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(key, F.lit(0), F.lit(1)))
    by = sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    n = lambda c: F.count(F.when(c, 1))
    return by.agg(n(F.col("l") > 1).alias("repeated_left"), n(F.col("r") > 1).alias("repeated_right"), n((F.col("l") > 0) & (F.col("r") == 0)).alias("left_only"), n((F.col("l") == 0) & (F.col("r") > 0)).alias("right_only"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a key repeats on either side; the check is part of the plan."""
    once = lambda df, name: df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key)
    both = once(left, "__l").join(once(right, "__r"), key)
    fine = F.when((F.col("__l") == 1) & (F.col("__r") == 1), True).otherwise(F.raise_error(F.lit(f"{key} repeats in a one-to-one join")).cast("boolean"))
    return both.where(fine).drop("__l", "__r")


def with_indicator(left: DataFrame, right: DataFrame, key: str, name: str = "matched") -> DataFrame:
    """Left join with a column telling whether the key was found."""
    return left.join(right.withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def upsert_last(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new by key, new rows winning; one shuffle by the key."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    picked = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in old.columns if c != key]), "__batch").alias("__row"))
    return picked.select(key, "__row.*")


def coalesced(current: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """current left joined with previous, whose values win where there are any."""
    old = previous.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return current.join(old, key, "left").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in columns])


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group and task before the shuffle."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def seeded_order(key: Column, seed: int) -> Column:
    """A digest to order by, the same in any engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256)


def overlapping_pairs(boxes: DataFrame, page: str, key: str, gap: float = 50.0, small_page: int = 64) -> DataFrame:
    """Unordered pairs on one page whose y-intervals overlap and whose x-intervals do or are no further apart than gap.

    boxes has x0, x1, y0, y1. A count decides: where no page has more than small_page boxes, a page's boxes meet in one row and are
    paired there, after one exchange; otherwise pages are cut into bands.
    """
    names = [key, "x0", "x1", "y0", "y1"]
    rows = boxes.select(page, *names)
    most = rows.groupBy(page).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if most <= small_page:
        held = rows.groupBy(page).agg(F.collect_list(F.struct(*names)).alias("l"))
        both = held.select(page, F.explode("l").alias("a"), "l").select(page, "a", F.explode("l").alias("b")).where(f"a.`{key}` < b.`{key}`")
        pairs = both.select(page, *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in names])
    else:
        pairs = _banded(rows, page, key, names)
    apart = F.greatest(F.col("x0_a"), F.col("x0_b")) - F.least(F.col("x1_a"), F.col("x1_b"))
    pairs = pairs.where((F.col("y0_a") < F.col("y1_b")) & (F.col("y0_b") < F.col("y1_a")) & (apart <= gap))
    ha, hb = F.col("y1_a") - F.col("y0_a"), F.col("y1_b") - F.col("y0_b")
    overlap = F.least("y1_a", "y1_b") - F.greatest("y0_a", "y0_b")
    return pairs.select(page, f"{key}_a", f"{key}_b", F.greatest(apart, F.lit(0.0)).alias("gap"), (apart < 0).alias("x_overlap"), (F.least(ha, hb) / F.greatest(ha, hb)).alias("height_similarity"), (overlap / F.least(ha, hb)).alias("y_overlap_ratio"))


def _banded(boxes: DataFrame, page: str, key: str, names: list[str]) -> DataFrame:
    """Pairs by an equi-join on the page and on bands of y with the height of its largest box.

    Each pair is taken in one band only, the higher of the bands where both begin, so no pair is made twice and a page's rows are not
    all paired.
    """
    band = boxes.groupBy(page).agg(F.greatest(F.max(F.col("y1") - F.col("y0")), F.lit(1e-9)).alias("__h"))
    at = boxes.join(band, page).withColumn("__first", F.floor(F.col("y0") / F.col("__h"))).withColumn("__last", F.floor(F.col("y1") / F.col("__h")))
    spread = at.withColumn("__band", F.explode(F.sequence("__first", "__last")))
    a = spread.select(page, "__band", *[F.col(c).alias(f"{c}_a") for c in (*names, "__first")])
    b = spread.select(page, "__band", *[F.col(c).alias(f"{c}_b") for c in (*names, "__first")])
    return a.join(b, [page, "__band"]).where((F.col(f"{key}_a") < F.col(f"{key}_b")) & (F.col("__band") == F.greatest("__first_a", "__first_b")))


def adjacency(pairs: DataFrame, similarity: float = 0.7, overlap: float = 0.7, gap: float = 50.0) -> DataFrame:
    """Pairs with adjacent: separated in x, of like height, side by side."""
    near = ~F.col("x_overlap") & (F.col("height_similarity") >= similarity) & (F.col("y_overlap_ratio") >= overlap) & (F.col("gap") <= gap)
    return pairs.withColumn("adjacent", near)


def adjacent_overlap(rows: DataFrame, page: str, order: list[str], low: str, high: str) -> DataFrame:
    """For each page the share of consecutive rows whose intervals overlap, and the largest step back."""
    w = W.partitionBy(page).orderBy(*order)
    step = rows.select(page, low, F.lag(high).over(w).alias("__high"), F.lag(low).over(w).alias("__low")).where("__high is not null")
    return step.groupBy(page).agg(F.count(F.lit(1)).alias("steps"), F.avg((F.col(low) < F.col("__high")).cast("double")).alias("overlap_share"), F.max(F.greatest(F.col("__low") - F.col(low), F.lit(0.0))).alias("step_back"))


def overall_and_by(rows: DataFrame, split: str, category: str) -> DataFrame:
    """Rows of each category in all and in each split, by one aggregation with grouping sets; ratios within the split."""
    sums = rows.rollup(category, split).agg(F.count(F.lit(1)).alias("count"), F.grouping(category).alias("__c"), F.grouping(split).alias("__s")).where("__c = 0")
    named = sums.select(F.col(category), F.when(F.col("__s") == 1, "overall").otherwise(F.col(split)).alias(split), "count")
    return named.withColumn("ratio", F.col("count") / F.sum("count").over(W.partitionBy(split)))


def crosstab(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of b's given values by a, one column each."""
    return rows.groupBy(a).pivot(b, values).agg(F.count(F.lit(1))).na.fill(0)


def robust_scale(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range of each column; 0 where the range is."""
    qs = rows.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in columns])
    q = F.broadcast(qs.select(*[F.col(c).alias(f"__{c}") for c in columns]))
    spread = lambda c: F.col(f"__{c}")[2] - F.col(f"__{c}")[0]
    return rows.crossJoin(q).select(key, *[F.when(spread(c) > 0, (F.col(c) - F.col(f"__{c}")[1]) / spread(c)).otherwise(0.0).alias(c) for c in columns])


def _ranks(rows: DataFrame, column: str, name: str, parts: int = 64) -> DataFrame:
    """Mean ranks of a column's values: counts of distinct values, summed within ranges of the column, each a task of its own.

    The ranges' ends are approximate quantiles, a few numbers; how well they divide the values changes the balance, not the ranks.
    """
    ends = sorted(set(rows.approxQuantile(column, [i / parts for i in range(1, parts)], 0.005)))
    values = rows.groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e < F.col(column))) if ends else F.lit(0)
    placed = values.withColumn("__p", place)
    sizes = placed.groupBy("__p").agg(F.sum("__c").alias("__s"))
    before = sizes.select("__p", (F.sum("__s").over(W.orderBy("__p")) - F.col("__s")).alias("__b"))  # as many rows as ranges
    run = F.sum("__c").over(W.partitionBy("__p").orderBy(column).rowsBetween(W.unboundedPreceding, 0))
    return placed.join(F.broadcast(before), "__p").withColumn(name, F.col("__b") + run - (F.col("__c") - 1) / 2.0).select(column, name)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Spearman's correlation with mean ranks for ties."""
    both = rows.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = both.join(_ranks(both, a, "__ra"), a).join(_ranks(both, b, "__rb"), b)
    return ranked.agg(F.corr("__ra", "__rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def otsu(histogram: DataFrame, value: str, count: str) -> DataFrame:
    """One row: the threshold of a histogram with the largest variance between classes; windows over its few bins."""
    w = W.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy()
    v, c = F.col(value).cast("double"), F.col(count).cast("double")
    s = histogram.select(F.col(value), F.sum(c).over(w).alias("w0"), F.sum(v * c).over(w).alias("m0"), F.sum(c).over(all_).alias("n"), F.sum(v * c).over(all_).alias("m"))
    w1 = F.col("n") - F.col("w0")
    between = F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") * w1 * F.pow(F.col("m0") / F.col("w0") - (F.col("m") - F.col("m0")) / w1, 2)).otherwise(0.0)
    return s.select(F.col(value).alias("threshold"), between.alias("between")).orderBy(F.desc(F.round(between, 3)), value).limit(1)


def histogram_percentiles(histogram: DataFrame, value: str, count: str, percents: list[float]) -> DataFrame:
    """For each percent the smallest value at which the cumulative count reaches it."""
    run = F.sum(count).over(W.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(count).over(W.partitionBy())
    s = histogram.select(F.col(value).alias("v"), (100.0 * run / total).alias("p"))
    found = s.agg(*[F.min(F.when(F.col("p") >= q, F.col("v"))).alias(f"q{i}") for i, q in enumerate(percents)])
    return found.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("percent"), F.col(f"q{i}").alias("value")) for i, q in enumerate(percents)])).alias("x")).select("x.*")
