"""SQL views over an annotation corpus, and a small command line.

``python -m folioscope.views QUERY SF_DIR`` prints the first rows of a query of the catalogue.
"""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import latex, text
from folioscope.operators import corpus


def register(spark: SparkSession, expressions: DataFrame, text_column: str = "text", prefix: str = "corpus") -> list[str]:
    """Views of the expressions with tokens, of token counts, of structures and of duplicates; their names."""
    tokenized = corpus.tokenized(expressions, text_column)
    views = {
        "expressions": tokenized, "tokens": corpus.token_counts(tokenized), "longtail": corpus.longtail(corpus.token_counts(tokenized)), "taxonomy": corpus.taxonomy(corpus.token_counts(tokenized)),
        "structures": tokenized.withColumn("structure", latex.structure(F.col("tokens"))), "duplicates": corpus.duplicate_sizes(tokenized),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
    spark.udf.register("parse_status", F.pandas_udf(parse_statuses, "string"))
    return [f"{prefix}_{name}" for name in views]


def parse_statuses(formulas: pd.Series) -> pd.Series:
    """Parse status of each formula of an Arrow batch."""
    return formulas.map(lambda t: latex.parse_status(text_tokens(t)))


def text_tokens(value: str | None) -> list[str]:
    """Tokens of one string, by the same rule as the column expression."""
    return re.findall(text.token_pattern(), value or "")


def main() -> None:
    from folioscope.plans import catalogue

    if len(sys.argv) != 3 or sys.argv[1] not in catalogue.queries():
        sys.exit("usage: python -m folioscope.views QUERY SF_DIR\nqueries: " + " ".join(sorted(catalogue.queries())))
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    catalogue.queries()[sys.argv[1]](spark, sys.argv[2]).show(50, truncate=80)


if __name__ == "__main__":
    main()
