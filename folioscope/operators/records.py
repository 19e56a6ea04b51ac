"""Feature rows of texts, boxes and pages, and the checks of tables made of them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from folioscope.functions import text as T
from folioscope.operators import geometry as G

# Flags of a text in the order of the primary status, those that make it unusable, and the words of layout labels.
STATUSES = {
    "is_empty": "empty", "hit_max_tokens": "truncated", "has_catastrophic_ngram_repeat": "catastrophic_repeat", "has_high_repetition_ratio": "high_repetition", "has_grounding_parse_failure": "grounding_parse_failure",
    "has_extreme_line_count": "extreme_line_count", "has_extreme_formula_count": "extreme_formula_count", "has_invalid_characters": "invalid_characters", "has_invalid_bounding_boxes": "invalid_bounding_boxes",
}
LENIENT = ("is_empty", "hit_max_tokens", "has_catastrophic_ngram_repeat", "has_grounding_parse_failure")
STRICT = (*LENIENT, "has_high_repetition_ratio", "has_extreme_line_count", "has_extreme_formula_count")
TEXT_WORDS = ("title", "header", "footer", "caption", "text")
TEXT_LABELS = ("paragraph",)
KIND_WORDS = {"formula": ("formula", "equation", "math", "latex"), "figure": ("figure", "image", "chart", "diagram", "picture", "photo"), "table": ("table",)}
FORMULA_MARKS = (r"\$\$.*?\$\$", r"\$[^$]+\$", r"\\\(.*?\\\)", r"\\\[.*?\\\]")
LEAST_SIDE, LEAST_AREA = 1e-6, 1e-8
TIERS = ("L1", "L2", "L3")
# end of fixed values


# ---- texts -------------------------------------------------------------------------------------------------------------------------


def formula_marks(text: Column) -> Column:
    """Marked formulas, those of each family counted by themselves."""
    return sum((F.regexp_count(text, F.lit(f"(?s){p}")) for p in FORMULA_MARKS[1:]), F.regexp_count(text, F.lit(f"(?s){FORMULA_MARKS[0]}")))


@F.pandas_udf(ST.StructType([ST.StructField("spans", ST.LongType()), ST.StructField("covered", ST.DoubleType())]))
def formula_spans(texts: pd.Series) -> pd.DataFrame:
    """Joined spans of marked formulas, and the characters in them by the visible ones; an Arrow pass, as places are needed."""
    marks = [re.compile(p, re.S) for p in FORMULA_MARKS]

    def one(text: str | None) -> tuple[int, float]:
        text = text or ""
        ends: list[list[int]] = []
        for a, b in sorted(m.span() for p in marks for m in p.finditer(text)):
            if ends and a <= ends[-1][1]:
                ends[-1][1] = max(ends[-1][1], b)
            else:
                ends.append([a, b])
        return len(ends), sum(b - a for a, b in ends) / max(1, sum(map(len, text.split())))

    return pd.DataFrame([one(t) for t in texts], columns=["spans", "covered"])


def quality_flags(text: Column, n_tokens: Column, max_tokens: int, grounding_failed: Column | None = None, boxes_failed: Column | None = None, repetition: float = 0.35, repeats: int = 20, invalid: float = 0.05, lines: int = 400, formulas: int = 80) -> dict[str, Column]:
    """Nine flags that do not exclude each other, the first that holds as status, and whether the text is usable, strictly or leniently."""
    empty = T.normalized(text) == ""
    flags = {
        "is_empty": empty, "hit_max_tokens": ~empty & (n_tokens >= max_tokens), "has_high_repetition_ratio": T.repetition_ratio(text) >= repetition, "has_catastrophic_ngram_repeat": T.max_ngram_repeat(text) >= repeats,
        "has_extreme_line_count": line_count(text) >= lines, "has_extreme_formula_count": formula_marks(text) >= formulas, "has_invalid_characters": T.invalid_char_rate(text) >= invalid,
        "has_grounding_parse_failure": F.lit(False) if grounding_failed is None else grounding_failed, "has_invalid_bounding_boxes": F.lit(False) if boxes_failed is None else boxes_failed,
    }
    return flags


def line_count(text: Column) -> Column:
    """Lines of a text; one that ends in a line feed has no further line behind it."""
    return F.when(text == "", 0).otherwise(F.regexp_count(text, F.lit("\n")) + F.when(text.endswith("\n"), 0).otherwise(1))


def usable(row: str = "") -> dict[str, Column]:
    """Status and usability from columns of flags."""
    status = F.lit("ok")
    for flag, name in reversed(STATUSES.items()):
        status = F.when(F.col(row + flag), name).otherwise(status)
    clear = lambda names: ~F.array_contains(F.array(*[F.col(row + n) for n in names]), True)
    return {"primary_status": status, "usable_strict": clear(STRICT), "usable_lenient": clear(LENIENT)}


def morphology(text: Column, formula_chars: Column, formula_lines: Column, structures_per_line: Column) -> Column:
    """What a recognised text looks like: a figure's caption, heavy in formulas, mixed, or plain."""
    low = F.lower(text)
    figure = F.lit(False)
    for mark in ("<|ref|>figure", "<|ref|>image", "<|ref|>picture", "!["):
        figure = figure | low.contains(mark)
    return (
        F.when(figure & (formula_chars < 0.15) & (F.length(text) < 800), "figure_caption").when((formula_chars >= 0.25) | (formula_lines >= 0.4) | (structures_per_line >= 1.5), "formula_heavy")
        .when((formula_chars >= 0.05) | (formula_lines >= 0.1), "text_formula_mix").otherwise("plain_text")
    )


def label_bucket(label: Column) -> Column:
    """Kind of a layout label; a label that speaks of text is still a formula, figure or table if it names one."""
    low = F.lower(T.normalized(F.coalesce(label, F.lit(""))))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    kind = F.when(has(KIND_WORDS["formula"]), "formula").when(has(KIND_WORDS["figure"]), "figure").when(has(KIND_WORDS["table"]), "table")
    return F.coalesce(kind, F.when(has(TEXT_WORDS) | low.isin(*TEXT_LABELS), "text").otherwise("other"))


def colour_type(grey: Column, transparent: Column) -> Column:
    return F.concat_ws(";", F.when(grey, "grayscale_content").otherwise("color_content"), F.when(transparent > 0, "transparency_used").otherwise("opaque"))


def depth_label(depth: Column, mapping: dict[str, list[int]]) -> Column:
    """The label that lists a depth; beyond all, the last one."""
    out = F.lit(list(mapping)[-1])
    for label, values in reversed(mapping.items()):
        out = F.when(depth.isin(values), label).otherwise(out)
    return out


def zeroed(valid: Column, values: dict[str, Column]) -> list[Column]:
    """Values of valid rows; zeros, false and empty strings of all others."""
    blank = {"string": "", "boolean": False}
    return [F.when(valid, v).otherwise(F.lit(blank.get(kind, 0))).alias(name) for name, (v, kind) in values.items()]


def level_keys(names: DataFrame, name: str) -> DataFrame:
    """(name, key): up to the first underscore; names without one, what they share with the nearest other name in sorted order, else themselves.

    Neighbours that share anything share their first character, which deals the names out.
    """
    known = names.select(F.col(name).alias("name")).distinct()
    by = W.partitionBy(F.substring("name", 1, 1)).orderBy("name")
    same = lambda other: F.coalesce(F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("name"), F.length(other))), lambda i: F.substr(F.col("name"), F.lit(1), i) == F.substr(other, F.lit(1), i))), F.lit(0))
    near = known.withColumn("b", F.lag("name").over(by)).withColumn("a", F.lead("name").over(by))
    length = F.greatest(F.when(F.length("b") > 0, same(F.col("b"))).otherwise(0), F.when(F.length("a") > 0, same(F.col("a"))).otherwise(0))
    shared = F.when(length > 0, F.substr(F.col("name"), F.lit(1), length)).otherwise(F.col("name"))
    return near.select(F.col("name").alias(name), F.when(F.col("name").contains("_"), F.substring_index("name", "_", 1)).otherwise(shared).alias("key"))


# ---- structure ---------------------------------------------------------------------------------------------------------------------


def _steps(value: Column, low: int, high: int) -> Column:
    return F.when(value <= low, 0).when(value <= high, 1).otherwise(2)


def difficulty(length: Column, types: Column, depth: Column) -> Column:
    """Tier of an expression by its places in length, structure types and depth: easiest with all lowest, hardest with two highest at neither the least length nor depth."""
    a, b, c = _steps(length, 20, 40), _steps(types, 1, 2), _steps(depth, 1, 2)
    highest = (a == 2).cast("int") + (b == 2).cast("int") + (c == 2).cast("int")
    return F.when(a + b + c == 0, TIERS[0]).when((highest >= 2) & (a > 0) & (c > 0), TIERS[2]).otherwise(TIERS[1])


def position_problems(rows: DataFrame, types: str, depth: str, position: str) -> DataFrame:
    """One row: expressions, positions in use, and rows that contradict themselves (depth without a structure, structure without depth)."""
    t, d = F.col(types), F.col(depth)
    return rows.agg(
        F.count(F.lit(1)).alias("expressions"), F.countDistinct(position).alias("positions"), F.count(F.when((t == 0) & (d > 0), 1)).alias("depth_without_type"), F.count(F.when((t > 0) & (d == 0), 1)).alias("type_without_depth"),
    )


def cohort(rows: DataFrame, depth: str, types: str, *order: Column) -> DataFrame:
    """Expressions of depth four and three structure types at least, in a given order."""
    return rows.where((F.col(depth) >= 4) & (F.col(types) >= 3)).orderBy(*order)


def prevalence(rows: DataFrame, flags: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(feature, rate, decision) of binary columns: keep, drop_low or drop_high."""
    wide = rows.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias("rate")) for c in flags]).alias("a"))
    rate = F.col("x.rate")
    return wide.select(F.explode("a").alias("x")).select("x.feature", "x.rate", F.when(rate < low, "drop_low").when(rate > high, "drop_high").otherwise("keep").alias("decision"))


def examples_by_token(corpus: DataFrame, key: str, tokens: list[str], per_token: int = 10, min_chars: int = 3) -> DataFrame:
    """(token, key, rank): up to so many expressions for each token, longest first; an expression serves one token only.

    Tokens are taken one after the other, as each bars the expressions of those before; a token's pick is a top-n, not a sort of all.
    What is carried on is per_token rows for each token, of the few that are asked for.
    """
    rows = corpus.select(key, F.length(F.translate("norm", T.BLANK, "")).alias("chars"), F.size("tokens").alias("n"), F.array_intersect(F.array_distinct("tokens"), F.array(*map(F.lit, tokens))).alias("held")).where(F.col("chars") > min_chars)
    rows = rows.where(F.size("held") > 0)
    order = (F.desc("chars"), F.desc("n"), F.asc(key))
    used, picked = [], []
    for token in tokens:
        free = rows.where(F.array_contains("held", token))
        found = (free.where(~F.col(key).isin(used)) if used else free).orderBy(*order).limit(per_token).select(key).collect()
        picked += [(token, r[0], i) for i, r in enumerate(found, 1)]
        used += [r[0] for r in found]
    return corpus.sparkSession.createDataFrame(picked, f"token string, {key} {corpus.schema[key].dataType.simpleString()}, rank int")


# ---- boxes -------------------------------------------------------------------------------------------------------------------------


def checked_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes (..., x1, y1, x2, y2) with their corners sorted and cut to the unit square, what is wrong with them, and their measures."""
    side = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    raw = ("x1", "y1", "x2", "y2")
    missing = F.greatest(*[F.col(c).isNull().cast("int") for c in raw]) == 1
    odd = F.greatest(*[(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).cast("int") for c in raw]) == 1
    cut = F.struct(F.least(side("x1"), side("x2")).alias("x1"), F.least(side("y1"), side("y2")).alias("y1"), F.greatest(side("x1"), side("x2")).alias("x2"), F.greatest(side("y1"), side("y2")).alias("y2"))
    kept = [c for c in boxes.columns if c not in raw]
    rows = boxes.select(*kept, F.when(missing, "invalid_coordinate").when(odd, "nonfinite").alias("problem"), cut.alias("b"))
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    problem = F.coalesce("problem", F.when(w <= LEAST_SIDE, "zero_width").when(h <= LEAST_SIDE, "zero_height").when(w * h <= LEAST_AREA, "zero_area"))
    good = problem.isNull()
    shape = F.when(good, F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.log(w / h))))
    return rows.select(*kept, problem.alias("problem"), "b.*", ((F.col("b.x1") + F.col("b.x2")) / 2).alias("cx"), ((F.col("b.y1") + F.col("b.y2")) / 2).alias("cy"), w.alias("w"), h.alias("h"), (w * h).alias("area"), shape.alias("log_aspect_ratio"))


def union_ratio(boxes: DataFrame, image: str, grid: int = 256) -> DataFrame:
    """(image, union_ratio): the share of a grid's cells that an image's valid boxes touch; an image's few boxes meet in one row."""

    @F.pandas_udf(ST.DoubleType())
    def touched(lists: pd.Series) -> pd.Series:
        out = []
        for corners in lists:
            mask = np.zeros((grid, grid), bool)
            for x1, y1, x2, y2 in (np.asarray(c, float) for c in corners):
                a, b = int(x1 * grid), int(y1 * grid)
                mask[b : max(int(np.ceil(y2 * grid)), b + 1), a : max(int(np.ceil(x2 * grid)), a + 1)] = True
            out.append(mask.mean())
        return pd.Series(out, dtype=float)

    held = boxes.where("problem is null").groupBy(image).agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("l"))
    return held.select(image, touched("l").alias("union_ratio"))


def layout_row(boxes: DataFrame, image: str, label: str = "label") -> DataFrame:
    """One row an image of its valid boxes: counts by kind, area ratios, centres, spreads, margins, sizes, columns and occupied cells."""
    good = boxes.where("problem is null").withColumn("kind", label_bucket(F.col(label)))
    cell = (F.least(F.floor(F.col("cx") * 4), F.lit(3)) * 4 + F.least(F.floor(F.col("cy") * 4), F.lit(3))).cast("int")
    sums = [F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_blocks") for k in ("text", "formula", "figure", "table", "other")]
    sums += [T.ratio(F.sum(F.when(F.col("kind") == k, F.col("area")).otherwise(0.0)), F.sum("area")).alias(f"{k}_area_ratio") for k in ("text", "formula", "figure", "table")]
    sums += [F.avg(c).alias(f"mean_{c}") for c in ("cx", "cy", "w", "h", "area", "log_aspect_ratio")] + [F.stddev_pop(c).alias(f"std_{c}") for c in ("cx", "cy", "w", "h")]
    margins = [F.min("x1").alias("left_margin"), F.min("y1").alias("top_margin"), (1 - F.max("x2")).alias("right_margin"), (1 - F.max("y2")).alias("bottom_margin"), F.max("area").alias("largest_area")]
    two = F.least(F.avg((F.col("cx") < 0.5).cast("double")), F.avg((F.col("cx") >= 0.5).cast("double")))
    return good.groupBy(image).agg(F.count(F.lit(1)).alias("blocks"), *sums, *margins, two.alias("column_balance"), (F.countDistinct(cell) / 16).alias("occupied"))


def block_geometry(blocks: DataFrame, polygon: str, width: Column, height: Column) -> DataFrame:
    """blocks with box, centre, size, core interval and all of these by the page; blocks of fewer than three points are left out."""
    p = F.col(polygon)
    rows = blocks.where(F.size(p) >= 3).select("*", G.area(p).alias("mask_area"), G.bbox(p).alias("box"), G.core_interval(p).alias("core"), width.cast("double").alias("page_w"), height.cast("double").alias("page_h"))
    x, y = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    return rows.select(
        *[c for c in blocks.columns if c != polygon], "mask_area", "box.*", (F.col("box.x1") - F.col("box.x0")).alias("width"), (F.col("box.y1") - F.col("box.y0")).alias("height"), x.alias("center_x"), y.alias("center_y"), ((F.col("core.lo") + F.col("core.hi")) / 2).alias("core_center_x"),
        (x / F.col("page_w")).alias("norm_center_x"), (y / F.col("page_h")).alias("norm_center_y"), (F.col("mask_area") / (F.col("page_w") * F.col("page_h"))).alias("norm_mask_area"),
    )


def box_problems(rows: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, problem) of rotated boxes (width, height, aspect, angle) whose fields contradict each other."""
    w, h, a, t = (F.col(c) for c in ("width", "height", "aspect", "angle"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    problem = F.when(~(finite(w) & finite(h) & finite(a) & finite(t)), "non_finite").when((w <= 0) | (h <= 0), "not_positive").when(F.abs(a - w / h) > tolerance * F.greatest(F.lit(1.0), F.abs(a)), "aspect_mismatch").when((t < -90) | (t > 90), "angle_out_of_range")
    return rows.select(key, problem.alias("problem")).where("problem is not null")


def darkness(threshold: Column, dark: Column, light: Column) -> Column:
    """Darkness that a grey threshold stands for between the two references; light ones below dark ones count as one step above."""
    span = F.when(light > dark, light - dark).otherwise(F.lit(1.0))
    return 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), (threshold - dark) / span))


# ---- checks of tables --------------------------------------------------------------------------------------------------------------


def joint_tv(assigned: DataFrame, split: str, *labels: str) -> DataFrame:
    """One row: half the absolute differences of the labels' joint shares by split from those expected by the splits' sizes."""
    cells = assigned.groupBy(split, *labels).agg(F.count(F.lit(1)).alias("c"))
    sizes = F.broadcast(assigned.groupBy(split).agg(F.count(F.lit(1)).alias("s")))  # as many rows as splits
    total = F.broadcast(assigned.agg(F.count(F.lit(1)).alias("n")))
    overall = cells.groupBy(*labels).agg(F.sum("c").alias("o"))
    grid = overall.join(sizes).join(cells, [split, *labels], "left").join(total)
    return grid.agg(F.coalesce(F.sum(F.abs(F.coalesce("c", F.lit(0)) / F.col("n") - F.col("o") / F.col("n") * F.col("s") / F.col("n"))) / 2, F.lit(0.0)).alias("tv"))


def acceptance(pages: DataFrame, assigned: DataFrame, key: str, split: str, expected: dict[str, int], unseen: DataFrame | None = None) -> DataFrame:
    """(check, passed): all pages assigned once, no page in two splits, sizes as expected, no token outside train that train lacks."""
    both = pages.select(key).distinct().join(assigned.groupBy(key).agg(F.count(F.lit(1)).alias("times"), F.countDistinct(split).alias("splits")), key, "full")
    once = both.agg((F.count(F.when(F.coalesce("times", F.lit(0)) != 1, 1)) == 0).alias("a"), (F.count(F.when(F.col("splits") > 1, 1)) == 0).alias("b")).first()
    sizes = {r[0]: r[1] for r in assigned.groupBy(split).agg(F.count(F.lit(1))).collect()}
    rows = [("all_pages_assigned_once", bool(once["a"])), ("splits_disjoint", bool(once["b"])), ("capacities_match", sizes == {k: v for k, v in expected.items() if v})]
    if unseen is not None:
        rows.append(("vocab_coverage", unseen.isEmpty()))
    return pages.sparkSession.createDataFrame(rows, "check string, passed boolean")


def manifest_hash(assigned: DataFrame, key: str, split: str) -> str:
    """SHA-256 of the sorted assignment as CSV, read in order without holding it."""
    import hashlib

    out = hashlib.sha256(f"{key},{split}\n".encode())
    for r in assigned.select(key, split).orderBy(key).toLocalIterator():
        out.update(f"{r[0]},{r[1]}\n".encode())
    return out.hexdigest()


def pass_audit(rows: DataFrame, page: str, line: str, reason: Column) -> DataFrame:
    """One row: pages, lines, excluded ones by reason, and lines whose id their page has already."""
    keys = rows.select(page, line, reason.alias("reason")).groupBy(page, line).agg(F.count(F.lit(1)).alias("c"), F.count(F.when(F.col("reason") != "", 1)).alias("x"))
    return keys.agg(F.countDistinct(page).alias("pages"), F.sum("c").alias("lines"), F.sum("x").alias("excluded"), F.sum(F.col("c") - 1).alias("repeated_lines"))


def expected_values(found: DataFrame, expected: dict[str, float]) -> DataFrame:
    """(metric, observed, expected, passed) of a one-row table against frozen values."""
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("observed"), F.lit(float(v)).alias("expected")) for k, v in expected.items()])
    return found.select(F.explode(rows).alias("x")).select("x.*").withColumn("passed", F.abs(F.col("observed") - F.col("expected")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("expected")))


def aligned(left: DataFrame, *others: tuple[str, DataFrame], key: str = "key") -> DataFrame:
    """(key, problem) for all keys of left: what other table misses it or has it twice, in their order; null where all agree."""
    out, problem = left.select(key).distinct(), F.lit(None).cast("string")
    for name, rows in reversed(others):
        out = out.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
        problem = F.when(F.col(name).isNull(), f"missing_{name}").when(F.col(name) > 1, f"duplicate_{name}").otherwise(problem)
    return out.select(key, problem.alias("problem"))


def first_of_layouts(*layouts: DataFrame, key: str) -> DataFrame:
    """All layouts' pages, each once, as the first layout that has it has it."""
    rows = layouts[0].withColumn("__from", F.lit(0))
    for i, more in enumerate(layouts[1:], 1):
        rows = rows.unionByName(more.withColumn("__from", F.lit(i)))
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy("__from"))).where("__rank = 1").drop("__rank", "__from")


def label_coverage(rows: DataFrame, title: str, label: str) -> DataFrame:
    """(label, titles, share): distinct titles with each label, and their share of all titles."""
    total = F.broadcast(rows.agg(F.countDistinct(title).alias("all")))
    return rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.countDistinct(title).alias("titles")).join(total).select(label, "titles", (F.col("titles") / F.col("all")).alias("share"))


def token_ratios(counts: DataFrame, known: DataFrame, rare: int = 8) -> DataFrame:
    """One row: of all tokens those outside the known vocabulary and the rare ones, and the part of the known types that occurs."""
    held = counts.join(known.select("token", F.lit(1).alias("k")), "token", "left")
    size = F.broadcast(known.agg(F.countDistinct("token").alias("size")))
    sums = held.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("k").isNull(), F.col("count")).otherwise(0)).alias("u"), F.sum(F.when(F.col("count") <= rare, F.col("count")).otherwise(0)).alias("r"), F.count("k").alias("c"))
    return sums.join(size).select(T.ratio(F.col("u"), F.col("n")).alias("unknown_ratio"), T.ratio(F.col("r"), F.col("n")).alias("rare_ratio"), T.ratio(F.col("c"), F.col("size")).alias("coverage"))


def summary(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by..., metric, total, mean, median, max) of columns."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    return long.groupBy(*by, "x.metric").agg(F.sum("x.v").alias("total"), F.avg("x.v").alias("mean"), F.percentile("x.v", F.lit(0.5)).alias("median"), F.max("x.v").alias("max"))


# ---- clusters ----------------------------------------------------------------------------------------------------------------------


def stratified_quotas(sizes: dict, sample: int) -> dict:
    """Rows to take of each cluster: in proportion, three at least; what is left goes one by one to the largest remainder of a cluster."""
    total = sum(sizes.values())
    sample = min(sample, total)
    quota = {c: min(n, max(3, round(sample * n / total))) if n else 0 for c, n in sizes.items()}
    if (all_ := sum(quota.values())) > sample:
        quota = {c: q * sample // all_ for c, q in quota.items()}
    while sum(quota.values()) < sample:
        c = max(sorted(sizes), key=lambda k: sizes[k] - quota[k])
        if quota[c] >= sizes[c]:
            break
        quota[c] += 1
    return quota


def stratified_sample(rows: DataFrame, key: str, cluster: str, sample: int, seed: int) -> DataFrame:
    """Rows by quotas of their clusters, in the order of a seeded digest; of the clusters only the sizes come to the driver."""
    sizes = {r[0]: r[1] for r in rows.groupBy(cluster).agg(F.count(F.lit(1))).collect()}
    limit = rows.sparkSession.createDataFrame(list(stratified_quotas(sizes, sample).items()), f"{cluster} {rows.schema[cluster].dataType.simpleString()}, quota int")
    order = W.partitionBy(cluster).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256))
    return rows.withColumn("__r", F.row_number().over(order)).join(F.broadcast(limit), cluster).where("__r <= quota").drop("__r", "quota")


def galleries(scored: DataFrame, key: str, cluster: str, distance: str, n: int) -> DataFrame:
    """(cluster, key, place, rank): each cluster's nearest and farthest rows."""
    near, far = W.partitionBy(cluster).orderBy(distance, key), W.partitionBy(cluster).orderBy(F.desc(distance), key)
    pick = lambda w, name: scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(cluster, key, F.lit(name).alias("place"), "rank")
    return pick(near, "nearest").union(pick(far, "farthest"))


def transitions(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of each change."""
    return rows.groupBy(before, after).agg(F.count(F.lit(1)).alias("count"), F.max((F.col(before) != F.col(after)).cast("int")).alias("changed"))
