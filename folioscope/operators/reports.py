"""Report tables: curves, grids, gates, audits, and parsers of small embedded formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gap_filled(rows: DataFrame, value: str) -> DataFrame:
    """Counts of an integer for every number from its least to its largest."""
    by = rows.groupBy(F.col(value).cast("long").alias(value)).agg(F.count(F.lit(1)).alias("count"))
    ends = by.agg(F.min(value).alias("a"), F.max(value).alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias(value)).join(by, value, "left").select(value, F.coalesce("count", F.lit(0)).alias("count"))


def grid(rows: DataFrame, a: str, a_values: list[int], b: str, b_values: list[int]) -> DataFrame:
    """Counts for every pair of given values, zeros kept; what lies outside is left out."""
    frame = rows.sparkSession.createDataFrame([(x, y) for x in a_values for y in b_values], f"{a} long, {b} long")
    by = rows.groupBy(F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b)).agg(F.count(F.lit(1)).alias("count"))
    return F.broadcast(frame).join(by, [a, b], "left").select(a, b, F.coalesce("count", F.lit(0)).alias("count"))


def gates(rows: DataFrame, checks: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """(gate, value, passed): an aggregate for each gate and the closed range it must lie in; one pass over the rows."""
    wide = rows.agg(*[c.cast("double").alias(k) for k, (c, _, _) in checks.items()])
    parts = [F.struct(F.lit(k).alias("gate"), F.col(k).alias("value"), F.coalesce(F.col(k).between(lo, hi), F.lit(False)).alias("passed")) for k, (_, lo, hi) in checks.items()]
    return wide.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def disjointness(assigned: DataFrame, key: str, split: str) -> DataFrame:
    """One row: keys, those in several splits, those without one."""
    by = assigned.groupBy(key).agg(F.countDistinct(split).alias("n"))
    return by.agg(F.count(F.lit(1)).alias("keys"), F.count(F.when(F.col("n") > 1, 1)).alias("in_several"), F.count(F.when(F.col("n") == 0, 1)).alias("in_none"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one table only; one shuffle."""
    both = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(b.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return both.where("l <> r").select(key, F.when(F.col("l") == 1, "extra").otherwise("missing").alias("side"))


def pair_summary(pairs: DataFrame, page: str, a: str, b: str, qualified: bool = True) -> DataFrame:
    """One row: pairs, distinct lines (within their page, or by name alone) and pages."""
    ends = pairs.select(page, F.explode(F.array(a, b)).alias("line"))
    lines = ends.agg(F.countDistinct(page, "line") if qualified else F.countDistinct("line")).toDF("lines")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct(page).alias("pages")).crossJoin(F.broadcast(lines))


def grounding_blocks(text: Column) -> Column:
    """array<struct<label, boxes>> of reference and detection marks in a recognised text, in order."""
    labels = F.regexp_extract_all(text, F.lit(r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"), 1)
    boxes = F.regexp_extract_all(text, F.lit(r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"), 2)
    return F.zip_with(labels, boxes, lambda a, b: F.struct(a.alias("label"), F.from_json(b, "array<array<double>>").alias("boxes")))


def label_objects(text: Column) -> Column:
    """array<struct<l1, l2>> of a model's answer: fences are stripped; a list, or an old single label, is read."""
    clean = F.regexp_replace(text, r"(?s)^\s*```(?:json)?|```\s*$", "")
    many = F.from_json(clean, "labels array<struct<l1:string, l2:string>>")["labels"]
    one = F.from_json(clean, "l1 string, l2 string")
    return F.coalesce(many, F.when(one["l1"].isNotNull(), F.array(F.struct(one["l1"].alias("l1"), one["l2"].alias("l2")))), F.array().cast("array<struct<l1:string,l2:string>>"))


def special_tokens(tokens: Column, names: tuple[str, ...] = ("\\begin", "\\end", "\\frac", "\\sqrt", "^", "_")) -> Column:
    """map of counts; the marks of environments count with anything that begins like them."""
    counts = [(F.lit(n), F.size(F.filter(tokens, _named(n)))) for n in names]
    return F.create_map(*[x for pair in counts for x in pair])


def _named(name: str):
    return (lambda t: t.startswith(name)) if name in ("\\begin", "\\end") else (lambda t: t == name)


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, distinct) of columns with at most one value."""
    wide = rows.agg(*[F.countDistinct(c).alias(c) for c in columns])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in columns])).alias("x"))
    return long.select("x.*").where("distinct <= 1")


def log_scaled(value: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(value, F.lit(0)).cast("double"), F.lit(0.0)))


def duplicate_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kept): columns that equal an earlier one of their type in every row, nulls included; one aggregation over the pairs."""
    kind = dict(rows.dtypes)
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i] if kind[a] == kind[b]]
    same = rows.agg(*[F.coalesce(F.min(F.col(a).eqNullSafe(F.col(b)).cast("int")), F.lit(1)).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    found: dict[str, str] = {}
    for i, (a, b) in enumerate(pairs):
        if same[i] and b not in found and a not in found:
            found[b] = a
    return rows.sparkSession.createDataFrame(list(found.items()), "column string, kept string")


def table_rows(markdown: Column, heading: str) -> Column:
    """array<array<string>>: the cells of the rows of the first table under a heading of a Markdown text, its own header left out."""
    body = F.regexp_extract(F.concat(markdown, F.lit("\n#")), r"(?s)(?:^|\n)#+ " + heading + r"[^\n]*\n(.*?)(?=\n#)", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x).startswith("|") & ~x.rlike(r"^[\s|:-]+$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.btrim(x), r"^\||\|$", ""), r"\|"), lambda c: F.btrim(c, F.lit(" `\t\r")))
    return F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), cells)


def taxonomy(texts: DataFrame, text: str, upper: str, lower: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(l1_code, l1_name, l2_code, l2_name) of a label scheme written as two Markdown tables: (code, name) and (upper's name, code, name).

    A lower label belongs to the upper one of its name, else to that of its code's first part. With sizes, other numbers of labels fail.
    """
    first = texts.select(F.explode(table_rows(F.col(text), upper)).alias("r")).select(F.col("r")[0].alias("l1_code"), F.col("r")[1].alias("l1_name"))
    second = texts.select(F.explode(table_rows(F.col(text), lower)).alias("r")).select(F.col("r")[0].alias("of"), F.col("r")[1].alias("l2_code"), F.col("r")[2].alias("l2_name"))
    by_code = first.select(F.col("l1_code").alias("c"), F.col("l1_name").alias("n"))
    both = second.join(first, F.col("of") == F.col("l1_name"), "left").join(by_code, F.substring_index("l2_code", ".", 1) == F.col("c"), "left")
    found = both.select(F.coalesce("l1_code", "c").alias("l1_code"), F.coalesce("l1_name", "n").alias("l1_name"), "l2_code", "l2_name")
    if sizes is not None and (first.count(), found.where("l1_code is not null").count()) != sizes:
        raise ValueError(f"expected {sizes[0]} upper and {sizes[1]} lower labels")
    return found
