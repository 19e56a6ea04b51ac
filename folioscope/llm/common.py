"""Shared pieces: tables in the shared folder, size-checked joins, let-bindings."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of anything but space, tab, LF, VT, FF and CR is a word.
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast up to so many rows (of at most a few hundred bytes each); beyond, joins shuffle.
BROADCAST_ROWS = 250_000
#: Or up to so many where a row is an id or two, some 70 bytes in memory, and the other side holds whole texts.
NARROW_ROWS = 1_000_000
#: And up to so many bytes where rows have no fixed width.
BROADCAST_BYTES = 32_000_000


@lru_cache(maxsize=None)
def _local_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="folioscope-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; where that is unset, a local one if driver and executors are one process."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return _local_dir(spark.sparkContext.applicationId)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*stashed: DataFrame) -> None:
    """Delete what stash wrote, once nothing will read it again; other frames are left alone."""
    for df in stashed:
        if path := df.__dict__.get("_stashed_at"):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def nested(docs: DataFrame, but: tuple[str, ...] = (), **more: Column) -> DataFrame:
    """The rows of docs as one column ``row``, without the columns in but, and more columns, whose names so can't clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in but]) if set(docs.columns) - set(but) else F.lit(None)
    return docs.select(row.alias("row"), *[c.alias(name) for name, c in more.items()])


def unnested(columns: list[str], but: tuple[str, ...] = (), **replaced: Column) -> list[Column]:
    """The columns of a nested row again, some replaced."""
    return [(replaced[c] if c in replaced else F.col("row").getField(c)).alias(c) for c in columns if c not in but]


def bounded_broadcast(small: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for small only where its counted rows, of fixed width, are within the limit."""
    return F.broadcast(small) if rows <= limit else small


def broadcast_by_bytes(small: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a written table only where the bytes of its rows, as size tells for each, are within the limit."""
    return F.broadcast(small) if small.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"] <= limit else small.hint("merge")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that no model learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_ids(labels: DataFrame, label: str, max_rows: int, seed: int = 17) -> DataFrame:
    """(doc_id, label) of at most max_rows labelled rows outside the held-out fifth.

    The choice is by seeded hash, so it is the same on every run; rows with a null id or label are left out and repeated ids count once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    once = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return once.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows)


#: Bytes of a batch that goes to a Python worker, where the session sets no bound: whole texts may be long.
BATCH_BYTES = 8_000_000


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, unless it does so itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; Python workers started from here on find this package where it lies, if they see that folder."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
