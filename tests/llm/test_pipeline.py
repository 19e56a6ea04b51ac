"""The pipeline's stages take effect, keep the columns of documents, and agree with their operators."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from folioscope.llm import queries  # noqa: E402
from folioscope.llm.common import stash, table  # noqa: E402
from tests.llm.test_dedup import brute_components, by_id  # noqa: E402


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns, name
        seen[name] = docs
    good = {r.doc_id for r in queries.op1_quality_classifier(spark, sf_dir).where("predicted = 1").collect()}
    assert {r.doc_id for r in seen["quality"].collect()} == good
    assert seen["lines"].count() == seen["quality"].count()
    components = brute_components(by_id(seen["lines"]))
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {c for _, c in components.values()}
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert 0.6 * words(seen["near_duplicates"]) < words(seen["mixture"]) <= queries.MIX_SHARE * words(seen["near_duplicates"]) + 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in seen["mixture"].collect()} and all(r.decoded for r in last)


def test_stages_on_empty_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_near_duplicates_make_no_row_of_a_shingle(spark, monkeypatch):
    """in the third stage the shingles of whole sets travel in packed rows; only prefixes become rows."""
    from folioscope.llm import ngram_join

    plans, real = {}, ngram_join.stash
    monkeypatch.setattr(ngram_join, "stash", lambda df, tag: plans.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString()) and real(df, tag))
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:100]), " ".join(words[:99]), " ".join(words[100:]), "a b", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 3, 4]
    assert "ranked" in plans and "sets" not in plans and "Generate" not in plans["ranked"]
