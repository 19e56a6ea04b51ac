"""Token counts, lattice samples and personal data against libraries and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import lattice, pieces, private_data, queries, tagger, token_counts


def test_counts_equal_the_library(spark, odd_docs, no_docs):
    tokenizers = pytest.importorskip("tokenizers")
    words = pieces.vocabulary(pieces.DEFAULT_MODEL)
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -1.0) for b in range(256)] + list(words.scores.items())
    library = tokenizers.Tokenizer(tokenizers.models.Unigram(vocab, unk_id=0, byte_fallback=True))
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 漢𐍈é\n\tzZ  1x#▁") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["the theory of everything", "  two  spaces ", "a" * 300]
    for t in texts:
        assert token_counts.count_tokens(t) == (len(library.encode(pieces.MARK + t.replace(" ", pieces.MARK)).ids) if t else 0), t
    rows = {r.doc_id: r.n_tokens for r in token_counts.token_counts(odd_docs).collect()}
    assert rows[40] is None and rows[41] == 0 and rows[49] == token_counts.count_tokens(odd_docs.where("doc_id = 49").first().text)
    assert token_counts.token_counts(no_docs).count() == 0


def every_segmentation(sampler, text):
    """Probabilities of all segmentations, by listing them."""
    lat = lattice.Lattices(sampler.trie)
    total = [((), 1.0)]
    for i in lat.number_of([sampler.vocabulary.fine_units(text)]).tolist():
        found, todo = [], [(int(lat.begin[i]), (), 1.0)]
        while todo:
            s, path, p = todo.pop()
            if s == lat.last[i]:
                found.append((path, p))
                continue
            for e in lat.open(s):
                todo.append((int(lat.end[e]), (*path, int(lat.piece[e])), p * float(lat.share[e])))
        total = [(a + b, x * y) for a, x in total for b, y in found]
    out = Counter()
    for path, p in total:
        ids = []
        for k in path:
            ids += [k] if k >= 0 else [sampler.vocabulary.byte_ids[b] for b in chr(-2 - k).encode()]
        out[tuple(ids)] += p
    return out


@pytest.mark.parametrize("text", ["the cat", "a", "ab\ncd", "漢𐍈 x", "  a"])
def test_samples(text):
    sampler, n, k = lattice.Sampler(), 2500, 3
    every = every_segmentation(sampler, text)
    assert math.isclose(sum(every.values()), 1, abs_tol=1e-9)
    first, weight, by = Counter(), Counter(), {}
    for i, rank, ids, logp, value, inclusion in sampler.sample([text] * n, [f"key{j}" for j in range(n)], k):
        ids = tuple(ids.tolist())
        assert math.isclose(math.exp(logp), every[ids], rel_tol=1e-6) and sampler.vocabulary.decode(ids) == text
        by.setdefault(i, []).append((value, ids))
        first[ids] += rank == 1
        weight[ids] += 1 / inclusion if inclusion > 0 else 0
    for found in by.values():
        assert len({x for _, x in found}) == len(found) == min(k, len(every)) and found == sorted(found, reverse=True)
    for ids, p in every.items():
        if p > 0.02:
            assert abs(first[ids] / n - p) < 5 * math.sqrt(p / n) and abs(weight[ids] / n - 1) < 0.2


def test_runs_of_spaces_are_in_the_lattice():
    sampler = lattice.Sampler()
    runs = {i: len(p) for p, i in sampler.vocabulary.ids.items() if len(p) > 1 and set(p) == {"▁"}}
    every = every_segmentation(sampler, " " * 15)
    assert len(runs) == 14 and set(runs) <= {x for ids in every for x in ids}
    two = every_segmentation(sampler, " a")
    assert sum(p for ids, p in two.items() if set(ids) & set(runs)) > 0


def test_samples_odd_rows(odd_docs, no_docs):
    rows = lattice.segmentations(odd_docs, k=2).collect()
    assert all(r.decoded for r in rows)
    by = Counter(r.doc_id for r in rows)
    assert by[40] == by[41] == 1 and by[49] == 2 and by[45] == 4
    again = lattice.segmentations(odd_docs.repartition(3), k=2).collect()
    assert Counter((r.doc_id, r.rank, r.ids_sha256) for r in rows) == Counter((r.doc_id, r.rank, r.ids_sha256) for r in again)
    assert lattice.segmentations(no_docs).count() == 0
    small = lattice.segmentations(odd_docs, k=2, kept_states=300, chunk_chars=500).collect()
    assert Counter((r.doc_id, r.rank, r.ids_sha256) for r in rows) == Counter((r.doc_id, r.rank, r.ids_sha256) for r in small)


def plain_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and private_data.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("a@.-+0129 4(é") for _ in range(rng.randint(0, 40)))
        assert private_data.base_spans(t) == plain_spans(t), t
    assert private_data.base_spans("1" * 200_000 + "@" * 50) == []


def test_gradients():
    model, rng = tagger.Tagger.new(5, 1), np.random.default_rng(0)
    made = private_data.examples(5)
    x = np.stack([tagger.encode(t) for t, _ in made])[:, :20]
    y = np.stack([private_data.tags_of(t, [s for s in spans if s[2] <= 20]) for t, spans in made])[:, :20]
    _, g = model.gradients(x, y)
    for k in g:
        at = (0, 0) if k == "trans" else tuple(rng.integers(0, n) for n in model.params[k].shape)
        old, side = model.params[k][at], []
        for step in (1e-5, -1e-5):
            model.params[k][at] = old + step
            side.append(model.gradients(x, y)[0])
        model.params[k][at] = old
        assert abs((side[0] - side[1]) / 2e-5 - g[k][at]) < 1e-4 * max(1, abs(g[k][at]))


def recalls(model, labelled):
    found = private_data.find([t for t, _ in labelled], model)
    wanted, hit = Counter(), Counter()
    for (_, spans), (_, every) in zip(labelled, found):
        wanted.update(k for k, _, _ in spans)
        hit.update(s[0] for s in spans if s in every)
    return {k: hit[k] / wanted[k] for k in wanted}


def test_tagger_finds_held_out_spans_and_reconciles_windows():
    model = private_data.default_tagger()
    got = recalls(model, private_data.examples(300, seed=99))
    assert set(got) == set(tagger.KINDS) and min(got.values()) > 0.9, got
    # a span over a window's edge is found once
    for at in (17, 18, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45):
        text = "word " * at + "call (555) 555-0123 now " + "word " * 40
        (base, every), = private_data.find([text], model)
        assert base == [] and [text[a:b] for k, a, b in every if k == "phone"] == ["(555) 555-0123"], at


def test_tagger_finds_forms_that_its_generator_does_not_make():
    """Other countries' groupings, longer hosts, other blanks; recall by kind."""
    rng, labelled = np.random.default_rng(31), []
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("bcefghijklmnprstuvw"), rng.integers(3, 9)))

    def luhn(n):
        return next(n + str(d) for d in range(10) if private_data.luhn(n + str(d)))

    made = {
        "email": lambda: rng.choice([f"{word()}.{word()}.{word()}@{word()}.co.uk", f"{word()}[at]{word()}[dot]ac[dot]uk", f"{word()}{num(4)} (AT) {word()} (DOT) edu", f"{word()}_{word()} at {word()} dot io"]),
        "ip": lambda: ".".join(f"{n}" for n in rng.integers(0, 256, 4)) if rng.random() < 0.5 else "[.]".join(f"{n:03d}" for n in rng.integers(0, 256, 4)),
        "card": lambda: (lambda n: rng.choice([f"{n[:8]}-{n[8:]}", f"{n[:6]} {n[6:]}", f"{n[:4]}.{n[4:8]}.{n[8:]}"]))(luhn(num(15))),
        "phone": lambda: rng.choice([f"+{num(2)} {num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"(0{num(4)}) {num(6)}", f"00{num(2)} {num(3)} {num(3)} {num(3)}", f"0{num(3)} {num(3)} {num(2)} {num(2)}"]),
    }
    for kind, make in made.items():
        for _ in range(150):
            head, span = " ".join(word() for _ in range(rng.integers(1, 40))) + " ", str(make())
            labelled.append((head + span + " " + " ".join(word() for _ in range(rng.integers(1, 40))), [(kind, len(head), len(head) + len(span))]))
    got = recalls(private_data.default_tagger(), labelled)
    assert min(got.values()) >= 0.8 and np.mean(list(got.values())) >= 0.9, got


def test_stretches_give_the_tags_of_the_whole_text():
    """Cutting where the network is sure changes nothing: the same tags as one Viterbi pass over all averaged emissions."""
    model = private_data.default_tagger()
    texts = [" ".join(t for t, _ in private_data.examples(12, seed=s)) for s in range(8)] + ["", "7", "plain words " * 90, "+49 30 1234567"]
    got = {i: np.zeros(len(t), np.int64) for i, t in enumerate(texts)}
    for i, start, tags in private_data._tagged(texts, model, rows=4):
        got[i][start : start + len(tags)] = tags
    for i, t in enumerate(texts):
        if t:
            total, weight = np.zeros((len(t), tagger.TAGS)), np.zeros(len(t))
            for s in range(0, len(t), private_data.STRIDE):
                part = np.full(private_data.WINDOW, private_data._BLANK)
                part[: len(c)] = (c := tagger.encode(t[s : s + private_data.WINDOW]))
                n = min(private_data.WINDOW, len(t) - s)
                total[s : s + n] += (model.emissions(part[:, None])[:, :, 0] * private_data._EDGE[:, None])[:n]
                weight[s : s + n] += private_data._EDGE[:n]
            assert (got[i] == model.decode([total / weight[:, None]], [True], [True])[0]).all(), i


def test_written_out_addresses_without_digits_are_found():
    model = private_data.default_tagger()
    for mail in ("anver [AT] rein [DOT] com", "anver {at} rein {dot} org", "anver [ at ] rein [ dot ] com", "verun at reinmo dot com", "anver(at)rein(dot)net"):
        text = "word " * 30 + "mail " + mail + " now " + "word " * 30
        assert private_data.sensible("email", mail)
        (base, every), = private_data.find([text], model)
        assert base == [] and [text[a:b] for k, a, b in every if k == "email"] == [mail], mail


def test_query_of_private_data(spark, tmp_path):
    """Counts, order, digest and all base spans of the registered query."""
    texts = ["a@b.de, 1.2.3.4 x@y.org +49 30 1234567", "none", None, "", "call (555) 555-0123 or 4111 1111 1111 1111 now", "1.2.3.999 " * 30 + "u@v.w.x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    order = {k: n for n, k in enumerate(tagger.KINDS)}
    for r in queries.op3_private_data(spark, str(tmp_path)).collect():
        base = sorted(plain_spans(texts[r.doc_id] or ""), key=lambda s: (order[s[0]], s[1]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans) and spans == sorted(spans, key=lambda s: (order[s[0]], s[1]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in tagger.KINDS]


def test_clean_text_stays_clean():
    model = private_data.default_tagger()
    texts = ["In 2024 there were 12 of 300 such, 3.5 per cent.", "plain prose without numbers " * 30, "", "page 12, line 7; v1.2.3"]
    assert all(every == [] for _, every in private_data.find(texts, model))


def test_private_data_odd_rows(spark, odd_docs, no_docs):
    more = spark.createDataFrame([(80, "mail a.b@c.de or +49 30 1234567, 10.0.0.1 card 4111 1111 1111 1111")], "doc_id long, text string")
    rows = {r.doc_id: r for r in private_data.private_data(odd_docs.select("doc_id", "text").union(more)).collect()}
    r = rows[80]
    assert (r.n_email, r.n_ip, r.n_phone) == (1, 1, 1) and r.spans.startswith("email:5:13,ip:")
    assert rows[40].spans == rows[41].spans == "" and len(rows) == len({x.doc_id for x in odd_docs.select("doc_id").collect()}) + 1
    assert private_data.private_data(no_docs).count() == 0


def test_op5_returns_the_pieces(spark, tmp_path):
    """F8: the query returns the segmentations' piece ids, not only their digest."""
    from folioscope.llm import queries

    spark.createDataFrame([(1, "some words here"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op5_sentencepiece(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {1, 2} and all(len(r.ids) == 2 * r.n_pieces and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in rows)
