"""The queries of this subpackage, with production parameters, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lattice, line_dedup, mixing, neighbours, ngram_join, private_data, quality_classifier, quality_rules, substring_dedup, token_counts
from .common import NARROW_ROWS, bounded_broadcast, held_out, table

#: A label-1 score from here on counts as good.
GOOD = 0.3
#: Lines on more than this share of a source's documents are boilerplate.
LINE_RATIO = 0.1
#: Domains of the sources: by the number at the end of the source's name, modulo four.
DOMAINS = ("web", "books", "news", "code")
DOMAIN_WEIGHTS = {"web": 0.4, "books": 0.3, "news": 0.2, "code": 0.1}
LANGUAGE_WEIGHTS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}
SAMPLES = 2
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 3, 11


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.classify(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio decides at every host size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    done = line_dedup.line_dedup(docs, "source", "text", LINE_RATIO)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = f"""
with docs as (select doc_id, text, coalesce(source, chr(1) || 'null') as host, row_number() over () as r from documents),
lines as (select r, host, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from docs where text is not null),
marked as (select *, trim(line, ' ' || chr(9) || chr(13)) as norm from lines),
counts as (select host, norm, count(distinct r) as pages from marked where norm <> '' group by host, norm),
totals as (select host, count(*) as total from docs group by host),
boiler as (select c.host, c.norm from counts c join totals t using (host) where pages >= {line_dedup.REPEATED} and pages > {LINE_RATIO} * total),
kept as (select m.r, string_agg(m.line, chr(10) order by m.pos) filter (where b.norm is null) as text, count(*) as n_lines, count(b.norm) as n_dropped
  from marked m left join boiler b on m.host = b.host and m.norm = b.norm group by m.r)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_dropped, 0)::bigint as n_dropped,
  case when d.text is not null then sha256(coalesce(k.text, '')) end as kept_sha256
from docs d left join kept k using (r)
"""


def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.private_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    done = quality_rules.quality_rules(docs, rules)
    return done.select("doc_id", *[f"__stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


def domain(source: Column) -> Column:
    """The made-up domain of a source, for tables that have none."""
    number = F.coalesce(F.regexp_extract(source, r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (number % len(DOMAINS) + 1).cast("int"))


def mixed(docs: DataFrame, share: float, epochs: int) -> DataFrame:
    levels = [domain(F.col("source")), F.col("lang"), F.col("source")]
    return mixing.mix(docs, levels, [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, {}], share=share, max_epochs=epochs, seed=MIX_SEED)


def bounded(small: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it is small enough, so that texts need no shuffle."""
    return bounded_broadcast(small, small.count(), NARROW_ROWS)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixed(docs, MIX_SHARE, MIX_EPOCHS).select("doc_id", "lang", "source", "n_copies")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled segmentations themselves, as piece ids, with what is told of them."""
    return lattice.segmentations(table(spark, sf_dir, "documents").select("doc_id", "text"), k=SAMPLES)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digests_only=True)
    return done.withColumnRenamed("kept", "kept_sha256")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_line_dedup, op3_private_data, op4_quality_rules, op5_sentencepiece, op6_substring_dedup, op7_nearest_neighbours, op8_mixing, op9_ngram_join, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL}
