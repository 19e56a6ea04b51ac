"""Reading tables and collecting queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; Python workers started from here on find this package where it lies, if they see that folder."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables under so many bytes are not worth an exchange.
SPREAD_BYTES = 1_000_000


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are much work, on all cores."""
    return spread(table(spark, sf_dir, name))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to all cores where the files come in fewer parts than that (few large row groups); a large corpus has more and stays as it is.

    Only the plan is asked. What is selected and filtered later is still pushed down to the scan.
    """
    cores, plan = rows.sparkSession.sparkContext.defaultParallelism, rows._jdf.queryExecution()
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


class Catalogue:
    """Queries by name, and the SQL of those that have any."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep
