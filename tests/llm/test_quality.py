"""Quality classifier, quality rules and mixing against brute force and held-out labels."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import mixing, quality_classifier, quality_rules
from folioscope.llm.common import held_out


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_classifier_ranks_held_out_labels(tables):
    docs, labels = tables
    model = quality_classifier.learn(docs, labels)
    rows = quality_classifier.classify(docs, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifier_odd_rows(spark, odd_docs, no_docs, tables):
    model = quality_classifier.learn(*tables)
    rows = quality_classifier.classify(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (40, 41, 42)}) == 1
    assert quality_classifier.classify(no_docs, model).count() == 0
    none = quality_classifier.learn(no_docs, tables[1])
    assert {r.score for r in quality_classifier.classify(odd_docs, none).collect()} == {0.5}


def test_classifier_never_learns_from_held_out(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.learn(docs, labels), quality_classifier.learn(docs, flipped)
    assert np.array_equal(a.means, b.means) and a.link == b.link


def test_classifier_equals_its_formulas():
    """Densities by the full covariance matrices, statistics by plain counting."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(quality_classifier.STATISTICS))) @ rng.normal(size=(len(quality_classifier.STATISTICS),) * 2)
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    model = quality_classifier.fit(x, y, shrink=0.3, sphere=0.2)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = own[0] * np.mean(y == 0) + own[1] * np.mean(y == 1)
    pooled = 0.8 * pooled + 0.2 * np.trace(pooled) / len(pooled) * np.eye(len(pooled))
    logs = []
    for c in (0, 1):
        cov, d = 0.7 * own[c] + 0.3 * pooled, z - z[y == c].mean(0)
        logs.append(np.log(np.mean(y == c)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))
    assert np.allclose(model.margin(x), (logs[1] - logs[0]) / x.shape[1])
    order = np.argsort(model.margin(x))
    assert (np.diff(model.score(x)[order]) >= 0).all()
    got = dict(zip(quality_classifier.STATISTICS, quality_classifier.measure("Ab ab ab 12!\nAb ab ab 12!\n| x")))
    root = lambda a, b: np.arcsin(np.sqrt(a / b))
    want = {
        "log_words": np.log1p(10), "mean_chars": 22 / 10, "upper": root(2, 22), "digits": root(4, 22), "marks": root(1, 22), "points": root(2, 22), "bars": root(1, 10), "distinct": root(5, 10),
        "new_pairs": root(6, 9), "stutter": root(2, 10), "dup_lines": root(1, 3), "log_line_words": np.log1p(10 / 3),
    }
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want), (got, want)


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    cover = {k for i, g in enumerate(grams) if count[g] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_rule_statistics(spark, odd_docs, no_docs, tables):
    more = spark.createDataFrame([(90, "a b c a b c"), (91, "a a a a"), (92, "x | y # z\nx | y # z\n \n𐍈 é"), (93, "a b c d a b c")], "doc_id long, text string")
    df = odd_docs.select("doc_id", "text").union(more).union(tables[0].select("doc_id", "text").limit(60))
    for r in quality_rules.statistics(df).collect():
        s = r["__stats"]
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == brute_statistics(r.text), r.text
    assert quality_rules.quality_rules(no_docs, quality_rules.DecisionList([])).count() == 0
    docs = clashing(odd_docs, "row", "words", "lines", "symbols", "upper", "failed", "__w", "__n", "__stats")
    out = quality_rules.quality_rules(docs, quality_rules.DecisionList([quality_rules.Rule([("n_words", ">", 69)])]), stats="s")
    assert out.columns == [*docs.columns, "s", "base_failed", "kept"] and Counter(out.select(*docs.columns).collect()) == Counter(docs.collect())
    for r in out.collect():
        n, _, _, _, repeated = brute_statistics(r.text)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and r.kept == (not r.base_failed and n <= 69)


def test_rules_learn_and_keep_clean(tables):
    docs, labels = tables
    rules = quality_rules.learn(docs, labels)
    assert rules.rules and all(r.tests for r in rules.rules)
    rows = quality_rules.quality_rules(docs, rules).join(labels, "doc_id").where("not base_failed").collect()
    kept = {q: np.mean([r.kept for r in rows if r.quality == q]) for q in (0, 1)}
    assert kept[1] > 0.98 and kept[0] < 0.1


def test_rules_without_labels(odd_docs, no_docs, tables):
    rules = quality_rules.learn(no_docs, tables[1])
    assert rules.rules == []
    rows = quality_rules.quality_rules(odd_docs, rules).collect()
    assert all(r.kept != r.base_failed for r in rows)


def test_cover_prunes_to_the_true_threshold():
    rng = np.random.default_rng(1)
    x = rng.random((900, len(quality_rules.FEATURES)))
    rules = quality_rules.cover(x, (x[:, 2] > 0.7) & (x[:, 5] > 0.4))
    hit = np.any([r.holds(x) for r in rules.rules], axis=0)
    assert np.mean(hit == ((x[:, 2] > 0.7) & (x[:, 5] > 0.4))) > 0.95


def water(budget, caps, weights):
    """Parts by bisection on the level."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, mid * w) for c, w in zip(caps, weights)) < budget else (lo, mid)
    return [min(c, lo * w) for c, w in zip(caps, weights)]


def brute_mix(rows, weights, share, epochs, seed):
    import hashlib

    leaves = {}
    for i, (path, doc, text) in enumerate(rows):
        leaves.setdefault(path, []).append((hashlib.md5(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest(), len((text or "").split()), i))
    budget = {(): share * sum(t for v in leaves.values() for _, t, _ in v)}
    for depth, table in enumerate(weights):
        for parent in {p[:depth] for p in leaves}:
            kids = sorted({p[: depth + 1] for p in leaves if p[:depth] == parent})
            caps = [epochs * sum(t for p, v in leaves.items() if p[: depth + 1] == k for _, t, _ in v) for k in kids]
            budget |= dict(zip(kids, water(budget[parent], caps, [table.get(k[-1], 1.0) for k in kids])))
    out = {}
    for path, docs in leaves.items():
        total, need = sum(t for _, t, _ in docs), int(np.floor(round(budget[path], 3)))
        whole = need // total if total else 0
        left, run, last = need - whole * total, 0, ""
        for key in sorted({k for k, _, _ in docs}):
            run += sum(t for k, t, _ in docs if k == key)
            if run > left:
                break
            last = key
        for k, _, i in docs:
            out[i] = whole + (left > 0 and total > left and k <= last)
    return out


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (0.9, 3), (2.5, 3), (0.0, 2)])
def test_mixture(spark, share, epochs):
    rng = np.random.default_rng(7)
    rows = [((str(rng.choice(["web", "books"])), str(rng.choice(["en", "de", "fr"])), str(rng.choice(["s1", "s2"]))), i, " ".join(["w"] * int(rng.integers(1, 40)))) for i in range(300)]
    rows = [r for r in rows if r[0][:2] != ("books", "fr")] + [rows[0]]
    df = spark.createDataFrame([(*p, i, t) for p, i, t in rows], "a string, b string, c string, doc_id long, text string")
    weights = [{"web": 1.0, "books": 3.0}, {"en": 0.2, "de": 5.0}, {}]
    got = mixing.mix(df, [F.col("a"), F.col("b"), F.col("c")], weights, share=share, max_epochs=epochs, seed=5)
    want = brute_mix(rows, weights, share, epochs, 5)
    assert Counter((r.doc_id, r.n_copies) for r in got.collect()) == Counter((rows[i][1], n) for i, n in want.items())
    assert mixing.copies_as_rows(got).count() == sum(want.values())


def clashing(docs, *names):
    return docs.select("*", *[F.lit(f"my {c}").alias(c) for c in names if c not in docs.columns])


def test_mixture_odd_rows(odd_docs, no_docs):
    levels = [F.col("source"), F.col("lang")]
    docs = clashing(odd_docs, "row", "copies", "__key", "__l0", "__l1", "__epochs", "__last", "__tokens", "__bucket", "__salt")
    out = mixing.mix(docs, levels, [{}, {}], share=0.5)
    assert out.columns == [*docs.columns, "n_copies"] and Counter(out.drop("n_copies").collect()) == Counter(docs.collect())
    want = brute_mix([((r.source or "", r.lang or ""), r.doc_id, r.text) for r in docs.collect()], [{}, {}], 0.5, 1, 11)
    rows = docs.collect()
    assert Counter((r.doc_id, r.text, r.n_copies) for r in out.collect()) == Counter((rows[i].doc_id, rows[i].text, n) for i, n in want.items())
    assert mixing.copies_as_rows(out).columns == docs.columns
    assert mixing.mix(no_docs, levels, [{}, {}]).count() == 0
