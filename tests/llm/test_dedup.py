"""Near duplicates, repeated passages and boilerplate lines against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import exchange, line_dedup, ngram_join, queries, substring_dedup


def by_id(df):
    """(id, text) of each id, nulls left out."""
    return {r.doc_id: r.text or "" for r in df.where("doc_id is not null").select("doc_id", "text").collect()}


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(texts):
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_join(df, **params):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, **params).collect()}
    assert got == brute_components(by_id(df))


def test_join_odd_rows(odd_docs):
    check_join(odd_docs)


def test_join_empty(no_docs):
    assert ngram_join.near_duplicates(no_docs).count() == 0


@pytest.fixture(scope="module")
def families(spark):
    """Chains and stars of edited copies around the threshold, documents made of shared passages, sizes at exact ties."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    shared = [[word() for _ in range(rng.randint(8, 40))] for _ in range(6)]
    texts = []
    for _ in range(12):
        w = [word() for _ in range(rng.randint(6, 60))]
        for _ in range(rng.randint(1, 14)):
            texts.append(" ".join(w))
            for _ in range(rng.randint(0, 3)):
                w = list(w)
                w[rng.randrange(len(w))] = word()
                if rng.random() < 0.3:
                    del w[rng.randrange(len(w))]
    for _ in range(60):
        w = sum((rng.choice(shared) for _ in range(rng.randint(1, 4))), [])
        texts.append(" ".join(w + [word() for _ in range(rng.randint(0, 12))]))
    rng.shuffle(texts)
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("in_memory", [1, 6, 256])
def test_join_families(families, in_memory):
    check_join(families, in_memory=in_memory)


def test_join_near_copies(spark):
    """One text in many edited copies: few edits link with the original, many edits with nothing; some copies are shorter."""
    rng = random.Random(12)
    first, texts = [f"w{i}" for i in range(120)], []
    for k in range(400):
        w = list(first)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 7])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        texts.append(" ".join(w[: len(w) - rng.choice([0, 0, 0, 4, 15, 40])]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check_join(df)
    check_join(df, in_memory=20)


def test_join_words_with_nul(spark):
    df = spark.createDataFrame([(1, "a\x00b"), (2, "a b"), (3, "A\x00b"), (4, "a\x00 b")], "doc_id long, text string")
    check_join(df)


def test_join_small_chunks(families, monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_WORDS", 50)
    check_join(families)


def test_join_entries_do_not_grow_with_the_buckets():
    """a document's part in the first exchange is about half its shingles, at eight bytes, however many buckets a large input has."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**64, 400, np.uint64)) for _ in range(200)]
    sent = lambda buckets: sum(len(h) + len(k) for h, k in ngram_join._entries(np.arange(200), sets, 75, buckets)[["hashes", "keys"]].to_numpy())
    assert sent(8) == sent(500) < 4.2 * sum(map(len, sets))


@pytest.mark.parametrize("percent", [40, 75, 95])
def test_join_sizes_around_whole(spark, percent):
    """sets that are counted whole, sets counted in part, and links between both."""
    rng, texts = random.Random(percent), []
    for _ in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(50, 150))]
        for _ in range(6):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            w = w[: len(w) - rng.choice([0, 1, len(w) // 5])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for x in range(len(texts)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]) and find(x) != find(y):
                parent[max(find(x), find(y))] = min(find(x), find(y))
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df, percent=percent).collect()} == {i: find(i) for i in range(len(texts))}


def brute_substring(texts, window=50):
    words, first = {i: t.encode().split() for i, t in texts.items()}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(b" ".join(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[b" ".join(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def check_substring(df):
    rows = substring_dedup.substring_dedup(df, digests_only=True).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.select("doc_id").collect())
    want = brute_substring(by_id(df))
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id
        else:
            assert r.n_removed == 0


def test_substring_odd_rows(odd_docs):
    check_substring(odd_docs)
    kept = {r.doc_id: r.kept for r in substring_dedup.substring_dedup(odd_docs).collect()}
    assert kept[43] == "one two" and kept[41] == "" and kept[46] == ""


def test_substring_empty(no_docs):
    assert substring_dedup.substring_dedup(no_docs).count() == 0


@pytest.mark.parametrize("size", [60, 500_000])
def test_substring_shared_passages(spark, monkeypatch, size):
    monkeypatch.setattr(exchange, "CHUNK_WORDS", size)
    rng = random.Random(size)
    word = lambda: rng.choice("abcdefghijkl") + rng.choice("xyz")
    shared = [[word() for _ in range(rng.randint(40, 140))] for _ in range(5)]
    texts = []
    for _ in range(80):
        w = []
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 30)
            w += [word() for _ in range(rng.randint(0, 40))] + p[a:]
        texts.append(" ".join(w))
    check_substring(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7))


def brute_lines(rows, ratio):
    norm = lambda x: x.strip(" \t\r")
    pages, total = Counter(), Counter()
    for host, text in rows:
        total[host] += 1
        pages.update({(host, norm(x)) for x in (text or "").split("\n") if norm(x)})
    bad = {k for k, n in pages.items() if n >= 2 and n > ratio * total[k[0]]}
    out = []
    for host, text in rows:
        if text is None:
            out.append((None, 0, 0))
        else:
            parts = text.split("\n")
            keep = [x for x in parts if (host, norm(x)) not in bad]
            out.append(("\n".join(keep), len(parts), len(parts) - len(keep)))
    return Counter(out)


@pytest.mark.parametrize("rows", [250_000, 0])
def test_lines(spark, odd_docs, monkeypatch, rows):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    rng = random.Random(2)
    made = [(rng.choice("ab"), "\n".join(rng.choice(["menu ", "menu", "foot", "", "  ", "x\r", f"own {i}"]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    df = spark.createDataFrame(made + [(None, "menu"), (None, None), ("a", "")], "source string, text string")
    done = line_dedup.line_dedup(df, max_ratio=0.3)
    assert Counter((r.text, r.n_lines, r.n_dropped) for r in done.collect()) == brute_lines([tuple(r) for r in df.collect()], 0.3)
    names = ("host", "lines", "salt", "row", "out", "total", "__host", "__lines", "__salt", "pages", "line")
    clash = odd_docs.select("*", *[F.lit(f"my {c}").alias(c) for c in names if c not in odd_docs.columns])
    out = line_dedup.line_dedup(clash, max_ratio=0.5)
    assert out.columns == [*clash.columns, "n_lines", "n_dropped"]
    others = [c for c in clash.columns if c != "text"]
    assert Counter(out.select(*others).collect()) == Counter(clash.select(*others).collect())
    assert Counter((r.text, r.n_lines, r.n_dropped) for r in out.collect()) == brute_lines([(r.source, r.text) for r in clash.collect()], 0.5)


def test_lines_of_small_hosts(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"menu\nown {i}" + "\nfoot" * (i < 9), "en", "twenty", 5) for i in range(20)] + [(20 + i, f"all\nfirst {i}", "en", "three", 5) for i in range(3)] + [(23, "alone", "en", "one", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter(r[0] for r in brute_lines([(r[3], r[1]) for r in rows], 0.1).elements())
    got = {r.doc_id: r for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert Counter(r.kept_sha256 for r in got.values()) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in want.elements())
    assert [got[i].n_dropped for i in (0, 10, 20, 23)] == [2, 1, 1, 0]
    assert Counter(r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).collect()) == want


def test_lines_empty(no_docs):
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_lines_keep_clean_text(spark):
    df = spark.createDataFrame([(str(i), f"line {i}\n\nmore {i}") for i in range(20)], "source string, text string")
    assert line_dedup.line_dedup(df).agg(F.sum("n_dropped")).first()[0] == 0


def test_words_of_bytes_hash_alike_wherever_they_stand(monkeypatch):
    """hashes come from a text's bytes, in blocks that cut no word."""
    from folioscope.llm.exchange import ByteHashes

    monkeypatch.setattr(ByteHashes, "BLOCK", 37)
    rng, made, seen = random.Random(3), ByteHashes(), {}
    for _ in range(600):
        raw = bytes(rng.choice(b"abcdeAB\xc3\x85\x1c\xa0 \t\n\v\f\r  ") for _ in range(rng.choice([0, 1, 3, 20, 200, 900])))
        found = made.of(raw).tolist()
        assert len(found) == len(raw.split())
        assert all(seen.setdefault(w, h) == h for w, h in zip(raw.split(), found))
    assert len(set(seen.values())) == len(seen)


def test_ids_that_leave_texts_in_place_are_broadcast(spark):
    """the ids of near duplicates of some GB are few bytes, for which no text is shuffled."""
    from folioscope.llm import queries as production

    docs, out = spark.range(10).selectExpr("id as doc_id", "'t' as text"), spark.range(400_000).selectExpr("id as doc_id")
    joined = docs.join(production.bounded(out), "doc_id", "left_anti")
    assert "strategy=broadcast" in joined._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" not in docs.join(production.bounded(spark.range(1_100_000).selectExpr("id as doc_id")), "doc_id", "left_anti")._jdf.queryExecution().analyzed().toString()
