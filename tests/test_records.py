"""Feature rows, boxes and checks against plain Python."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import records as X


def test_formula_spans(spark):
    texts = [None, "", "a $x$ b $$y$$", r"\(a\) and \[b\]", "$a$b$c$", "no dollar", "$$ open", "x $a\nb$ $$c\n\nd$$ \\(e $f$ g\\)"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", X.formula_spans("text").alias("f")).collect()
    for r in rows:
        text = texts[r.i] or ""
        mark = [False] * (len(text) + 1)
        ends = []
        for p in X.FORMULA_MARKS:
            for m in re.finditer(p, text, re.S):
                ends.append(m.span())
                mark[m.start() : m.end()] = [True] * (m.end() - m.start())
        groups = []
        for a, b in sorted(ends):
            if groups and a <= groups[-1]:
                groups[-1] = max(groups[-1], b)
            else:
                groups.append(b)
        assert r.f.spans == len(groups) and math.isclose(r.f.covered, sum(mark) / max(1, len("".join(text.split())))), text


def test_union_ratio(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 3, *map(float, np.round(rng.random(4), 3))) for i in range(30)] + [(3, 0.5, 0.5, 0.5, 0.9), (4, 0.0, 0.0, 1.0, 1.0), (4, 0.2, 0.2, 0.3, 0.3)]
    boxes = X.checked_boxes(spark.createDataFrame(rows, "image int, x1 double, y1 double, x2 double, y2 double"))
    got = {r.image: r.union_ratio for r in X.union_ratio(boxes, "image", 64).collect()}
    for image in (0, 1, 2, 4):
        cells = set()
        for _, a, b, c, d in (r for r in rows if r[0] == image):
            (x1, x2), (y1, y2) = sorted((a, c)), sorted((b, d))
            cells |= {(i, j) for i in range(int(x1 * 64), max(math.ceil(x2 * 64), int(x1 * 64) + 1)) for j in range(int(y1 * 64), max(math.ceil(y2 * 64), int(y1 * 64) + 1))}
        assert math.isclose(got[image], len(cells) / 64**2)
    assert 3 not in got and got[4] == 1.0


@pytest.mark.parametrize("sizes,sample", [({0: 50, 1: 5, 2: 45}, 20), ({0: 3, 1: 2}, 10), ({0: 100, 1: 100, 2: 1}, 10), ({0: 0, 1: 4}, 2)])
def test_stratified_quotas(sizes, sample):
    got = X.stratified_quotas(sizes, sample)
    assert sum(got.values()) == min(sample, sum(sizes.values())) and all(got[c] <= sizes[c] for c in sizes)


def test_manifest_hash_and_acceptance(spark):
    import hashlib

    rows = spark.createDataFrame([("b", "val"), ("a", "train"), ("c", "train")], "page string, split string")
    assert X.manifest_hash(rows, "page", "split") == hashlib.sha256(b"page,split\na,train\nb,val\nc,train\n").hexdigest()
    checks = {r.check: r.passed for r in X.acceptance(rows.select("page"), rows, "page", "split", {"train": 2, "val": 1, "test": 0}).collect()}
    assert checks == {"all_pages_assigned_once": True, "splits_disjoint": True, "capacities_match": True}
    twice = rows.union(spark.createDataFrame([("a", "val")], "page string, split string"))
    checks = {r.check: r.passed for r in X.acceptance(rows.select("page"), twice, "page", "split", {"train": 2, "val": 2}).collect()}
    assert checks == {"all_pages_assigned_once": False, "splits_disjoint": False, "capacities_match": True}


def test_line_count(spark):
    texts = ["", "a", "a\n", "a\nb", "\n", "\n\n", "a\n\nb\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.line_count(F.col("t")).alias("n")).collect()
    assert all(r.n == len(r.t.splitlines()) for r in rows)
