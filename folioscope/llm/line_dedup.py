"""Site-relative line dedup with DataFrame functions only.

A line is boilerplate of a host if the share of the host's pages that hold it exceeds ``max_ratio`` and several pages hold it, whatever
the host's size. Lines are compared after trimming blanks at both ends; blank lines stay.

Defined results: a null text stays null and counts as a page without lines; an empty text stays empty; null hosts form one host of
their own; repeated rows are pages of their own; texts of any length are read whole; an empty table gives an empty table; all other
columns pass through unchanged, whatever their names, but columns named as the two counts are replaced by these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, let, nested, stash, unnested

#: Slices of each host in the join of hosts too many to broadcast.
SALTS = 64
#: The least pages that make a line a repeated one.
REPEATED = 2


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(" \t\r")).cast("binary")))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def _host(host: str) -> Column:
    return F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\0null"))


def boilerplate(docs: DataFrame, host: str, text: str, max_ratio: float) -> DataFrame:
    """(host, lines): of each host with boilerplate, the digests of these lines.

    A host's pages hold at most (its mean distinct lines a page) / max_ratio such lines, so each array is bounded whatever the host's size.
    """
    pages = docs.select(_host(host).alias("host"), F.col(f"`{text}`").alias("text"))
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: ~_blank(x)), _digest))
    counts = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    frequent = counts.where(F.col("pages") >= REPEATED).join(totals, "host").where(F.col("pages") > F.lit(max_ratio) * F.col("total"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = 0.1, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """docs with boilerplate lines taken out of text, and two counts in the columns named n_lines and n_dropped.

    ``docs`` may be read twice. Nothing is shuffled but line digests and the hosts' arrays; the texts stay where they are unless the arrays
    are too many to broadcast, in which case hosts are dealt in SALTS slices.
    """
    found = stash(boilerplate(docs, host, text, max_ratio), "lines")
    size = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("lines")).first()
    keyed = nested(docs, (n_lines, n_dropped), host=_host(host), text=F.col(f"`{text}`"))
    if size["lines"] + size["n"] <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(found), "host", "left")
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.join(found, ["host", "salt"], "left")
    parts = F.split("text", "\n", -1)
    known = F.coalesce(F.col("lines"), F.array().cast("array<binary>"))
    stay = F.filter(parts, lambda x: _blank(x) | ~F.array_contains(known, _digest(x)))
    result = F.when(F.size(known) == 0, F.struct(F.col("text").alias("t"), F.size(parts).alias("n"), F.size(parts).alias("k"))).otherwise(let(stay, lambda s: F.struct(F.array_join(s, "\n").alias("t"), F.size(parts).alias("n"), F.size(s).alias("k"))))
    joined = joined.withColumn("out", result)
    some = F.col("text").isNotNull()
    count = F.when(some, F.col("out.n")).otherwise(0).cast("long")
    left = F.when(some, F.col("out.k")).otherwise(0).cast("long")
    return joined.select(*unnested(docs.columns, (n_lines, n_dropped), **{text: F.when(some, F.col("out.t"))}), count.alias(n_lines), (count - left).alias(n_dropped))
