"""Sources: page annotations as JSON, caption files, one-file-a-formula folders, image inventories, and sinks for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A page annotation; always given, never inferred. A polygon's points stay JSON here, as they may be pairs or objects.
PAGE = "image_name string, blocks array<struct<order:int, type:string, polygon:array<string>, lines:array<struct<order:int, ocr:string, polygon:array<string>>>>>"
EXPRESSION = ["dataset", "image_name", "block_order", "line_order", "block_type", "ocr", "source_file", "expression_id", "line_id", "line_polygon"]


def pages(spark: SparkSession, folder: str, pattern: str = "*.jpg.json") -> DataFrame:
    """Page annotations of a folder; fails if it is missing."""
    rows = spark.read.schema(PAGE).option("multiLine", True).option("pathGlobFilter", pattern).json(folder)
    return rows.withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def pages_or_any(spark: SparkSession, folder: str) -> DataFrame:
    """Page annotations by their usual names, or all JSON files of a folder that has none by these."""
    usual = pages(spark, folder)
    return pages(spark, folder, "*.json") if usual.isEmpty() else usual


def points(polygon: Column) -> Column:
    """array<struct<x, y>> of points that are pairs or objects with x and y; empty for none, and without what is neither."""

    def point(q: Column) -> Column:
        pair, named = F.from_json(q, "array<double>"), F.from_json(q, "x double, y double")
        return F.when(F.startswith(q, F.lit("{")), named).when(F.size(pair) >= 2, F.struct(pair[0].alias("x"), pair[1].alias("y")))

    made = F.filter(F.transform(polygon, point), lambda q: q["x"].isNotNull() & q["y"].isNotNull())
    return F.coalesce(made, F.array().cast("array<struct<x:double,y:double>>"))


def lines(page: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Every line of every block, empty ones too; missing orders are 0, missing texts empty; is_ignore for those in blocks of ignored types."""
    blocks = page.select("image_name", "source_file", F.explode("blocks").alias("b"))
    rows = blocks.select("image_name", "source_file", F.coalesce("b.order", F.lit(0)).alias("block_order"), F.coalesce("b.type", F.lit("")).alias("block_type"), F.explode("b.lines").alias("l"))
    return rows.select("image_name", "source_file", "block_order", "block_type", F.coalesce("l.order", F.lit(0)).alias("line_order"), F.coalesce("l.ocr", F.lit("")).alias("ocr"), points(F.col("l.polygon")).alias("line_polygon"), F.lower("block_type").isin(*ignored).alias("is_ignore") if ignored else F.lit(False).alias("is_ignore"))


def expressions(page: DataFrame, dataset: str) -> DataFrame:
    """Expression records: stripped texts that aren't empty, with ids."""
    stem = F.regexp_replace("source_file", r"\.json$", "")
    rows = lines(page).withColumn("ocr", F.regexp_replace("ocr", r"^\s+|\s+$", "")).where("ocr != ''")
    rows = rows.withColumn("line_id", F.concat_ws(":", "block_order", "line_order")).withColumn("dataset", F.lit(dataset))
    return rows.withColumn("expression_id", F.concat_ws(":", "dataset", stem, "line_id")).select(*EXPRESSION)


def raw_expressions(page: DataFrame) -> DataFrame:
    """All lines, empty ones kept for audits, with their place in the page."""
    place = W.partitionBy("image_name").orderBy("block_order", "line_order")
    return lines(page).withColumn("place", F.row_number().over(place) - 1)


def blocks(page: DataFrame) -> DataFrame:
    """Blocks with polygons and the page's size, by its largest coordinates, at least 1."""
    rows = page.select("source_file", F.explode("blocks").alias("b")).select(F.regexp_replace("source_file", r"\.json$", "").alias("page_id"), F.coalesce("b.order", F.lit(0)).alias("block_order"), F.coalesce("b.type", F.lit("")).alias("block_type"), points(F.col("b.polygon")).alias("polygon"))
    by = W.partitionBy("page_id")
    side = lambda k: F.greatest(F.coalesce(F.max(F.array_max(F.transform("polygon", lambda q: q[k]))).over(by), F.lit(1.0)), F.lit(1.0))
    return rows.withColumn("block_id", F.concat(F.col("page_id"), F.lit(":block_"), F.col("block_order"))).withColumn("page_width", side("x")).withColumn("page_height", side("y"))


#: A release of pages with regions, to be turned into page annotations.
RELEASE = "image_name string, regions array<struct<reading_order:string, region_type:string, region_polygon:array<string>, lines:array<struct<reading_order:string, formula:string, polygon:array<string>>>>>"


def released_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page annotations of a release file (a JSON list of pages): regions in reading order, their own place where that is no number.

    Lines without a formula are left out; a page without a name fails the read.
    """
    rows = spark.read.schema(RELEASE).option("multiLine", True).json(path)
    number = lambda order, i: F.coalesce(order.try_cast("int"), i)
    line = lambda x, j: F.struct(number(x["reading_order"], j).alias("order"), F.btrim(F.coalesce(x["formula"], F.lit(""))).alias("ocr"), F.coalesce(x["polygon"], F.array().cast("array<string>")).alias("polygon"))
    block = lambda r, i: F.struct(
        number(r["reading_order"], i).alias("order"), i.alias("at"), F.coalesce(r["region_type"], F.lit("")).alias("type"), F.coalesce(r["region_polygon"], F.array().cast("array<string>")).alias("polygon"),
        F.filter(F.transform(F.coalesce(r["lines"], F.array().cast("array<struct<reading_order:string, formula:string, polygon:array<string>>>")), line), lambda x: x["ocr"] != "").alias("lines"),
    )
    name = F.btrim(F.coalesce("image_name", F.lit("")))
    checked = F.when(name == "", F.raise_error(F.lit("a page has no image_name"))).otherwise(name)
    made = F.array_sort(F.transform(F.coalesce("regions", F.array().cast(RELEASE.split("regions ")[1])), block))
    kept = F.transform(made, lambda b: F.struct(b["order"].alias("order"), b["type"].alias("type"), b["polygon"].alias("polygon"), b["lines"].alias("lines")))
    return rows.select(checked.alias("image_name"), kept.alias("blocks"), F.concat(F.regexp_replace(checked, r"(?i)\.jpg$", ""), F.lit(".jpg.json")).alias("source_file"))


def paired_files(spark: SparkSession, folder: str, depth: int = 0) -> DataFrame:
    """(group, name, image, annotation, problem) of images and the annotations named after them.

    The group is the path of so many folders below the root. A file without its partner, or a name that its group has twice, is a problem.
    Only names are read: the listing never opens a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    below = F.split(F.substring_index("path", folder.rstrip("/") + "/", -1), "/")
    rows = files.select("path", F.array_join(F.slice(below, 1, depth) if depth else F.array().cast("array<string>"), "/").alias("group"), F.element_at(below, -1).alias("file"))
    rows = rows.select("group", "path", F.regexp_replace("file", r"\.json$", "").alias("name"), F.col("file").endswith(".json").alias("j"))
    by = rows.groupBy("group", "name").agg(F.min(F.when(~F.col("j"), F.col("path"))).alias("image"), F.min(F.when(F.col("j"), F.col("path"))).alias("annotation"), F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("annotation").isNull(), "no_annotation").when(F.col("image").isNull(), "no_image").when(F.col("n") > 2, "duplicate")
    return by.select("group", "name", "image", "annotation", problem.alias("problem"))


def captions(spark: SparkSession, path: str, dataset: str, keep_empty: bool = False, white_space: bool = False) -> DataFrame:
    """Lines of an id, a tab (or any white space) and a formula; rows without both are left out. Line numbers count from 1 in each file."""
    text = spark.read.option("wholetext", True).text(path).withColumn("source_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))
    rows = text.select("source_file", F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    parts = F.split(F.ltrim("line"), r"\s+", 2) if white_space else F.split("line", "\t", 2)
    rows = rows.withColumn("parts", parts).where(F.size("parts") == 2)
    rows = rows.select("source_file", (F.col("n") + 1).alias("line_id"), F.regexp_replace(F.col("parts")[0], r"^.*/|\.[A-Za-z]+$", "").alias("sample_id"), F.regexp_replace(F.col("parts")[1], r"^\s+|\s+$", "").alias("ocr"))
    rows = rows if keep_empty else rows.where("ocr != ''")
    return rows.select(F.lit(dataset).alias("dataset"), "sample_id", "ocr", "source_file", F.concat_ws(":", F.lit(dataset), "sample_id", "line_id").alias("expression_id"), F.col("line_id").cast("string").alias("line_id"))


def one_file_each(spark: SparkSession, root: str, dataset: str, parts: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """One formula a file in shards; the id is the path below root without its suffix."""
    rows = spark.read.option("wholetext", True).text([f"{root}/{p}/shard-*/*.txt" for p in parts])
    name = F.regexp_extract(F.col("_metadata.file_path"), r"((?:" + "|".join(parts) + r")/shard-[^/]+/[^/]+)\.txt$", 1)
    return rows.select(F.lit(dataset).alias("dataset"), name.alias("sample_id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("ocr")).where("ocr != ''")


#: Readers by kind of dataset; a new kind is a new entry.
LOADERS = {
    "pages": lambda spark, path, name: expressions(pages(spark, path), name), "caption": captions, "caption_with_empty": lambda spark, path, name: captions(spark, path, name, keep_empty=True),
    "caption_by_space": lambda spark, path, name: captions(spark, path, name, white_space=True), "files": one_file_each,
}


def load(spark: SparkSession, kind: str, path: str, name: str) -> DataFrame:
    if kind not in LOADERS:
        raise ValueError(f"unknown dataset kind {kind!r}; known: {', '.join(sorted(LOADERS))}")
    return LOADERS[kind](spark, path, name)


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files with a stable id by content; resumable runs join earlier results by it."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", "length", F.sha2("content", 256).alias("file_hash"), F.when(F.col("length") > 0, "ok").otherwise("corrupt").alias("status"))


def pending(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run has not done."""
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Parquet, and CSV beside it where asked for, numbers with six decimals; Spark's commit makes either whole or absent."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    if csv:
        shown = [F.format_string("%.6f", F.col(c)).alias(c) if t in ("double", "float") else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
        df.select(*shown).write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_vectors(spark: SparkSession, path: str, key: str, vector: str, dims: int) -> DataFrame:
    """A store of vectors; a row of another length fails the read."""
    rows = spark.read.parquet(path)
    return rows.where(F.when(F.size(vector) == dims, True).otherwise(F.raise_error(F.lit(f"{vector} must have {dims} components")).cast("boolean"))).select(key, vector)
