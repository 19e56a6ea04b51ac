"""Text functions, formula structure and sources on small literals."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import latex as L
from folioscope.functions import text as T
from folioscope.operators import geometry as G
from folioscope.sources import annotations as A


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column(F.col("t"))).collect()]


@pytest.mark.parametrize("text,n", [(r"\frac { a } { b }", 7), ("解 : ( 1 ) 依 题", 7), (r"\delete x", 2), ("a---b", 5)])
def test_token_counts(spark, text, n):
    assert len(values(spark, [text], T.tokens)[0]) == n


def test_vocabulary_is_greedy(spark):
    found = values(spark, [r"\deltax \deltab"], lambda c: T.tokens(c, [r"\delta", r"\deltab"]))
    assert found == [[r"\delta", "x", r"\deltab"]]


def test_categories(spark):
    wanted = {"a": "english tokens", "7": "digit tokens", r"\alpha": "greek tokens", r"\to": "special symbol tokens", "=": "operator tokens", "(": "grouping tokens", r"\frac": "structural tokens", "解": "CJK tokens", ",": "punctuation tokens", "&": "layout / alignment tokens", "é": "other / unknown tokens"}
    assert values(spark, list(wanted), T.category) == list(wanted.values())


def test_quality(spark):
    assert values(spark, ["", "ab" * 40, "plain words of no repeat here"], T.quality_status) == ["empty", "repetitive", "valid"]


def tokens(text):
    return text.split()


def test_matrix_environments():
    cases = r"\begin { cases } x \\ y \end { cases }"
    assert L.analyse(tokens(cases))["envs"] == 1
    assert L.analyse(tokens(cases.replace(r"\\ ", "")))["envs"] == 0
    nested = r"\begin { matrix } \begin { cases } x \\ y \end { cases } \\ z \end { matrix }"
    assert (L.analyse(tokens(nested))["envs"], L.analyse(tokens(nested))["env_depth"]) == (2, 2)
    assert L.Marks(tokens(r"\begin { cases } x \\ \end { cases }")).matrix_at(0) == (4, 6)


def test_chain_costs_nested_scripts():
    chain = "^ { " * 5 + "x" + " }" * 5
    r = L.analyse(tokens(chain + r" \frac { a } { b } \sqrt { x } _ { y }"))
    assert (r["ntc"], r["cbc"], r["max_repeat"]) == (5, 3, 5)


def test_chain_costs_environments():
    deep = r"\begin { cases } \frac { ^ { \sqrt { x } } } { y } \\ z \end { cases }"
    flat = r"\begin { cases } \frac { ^ { a } } { b } \\ c \end { cases }"
    r = L.analyse(tokens(deep + " " + flat))
    assert (r["ntc"], r["cbc"]) == (7, 0)


def test_deep_nesting_does_not_recurse():
    assert L.analyse(tokens("^ { " * 3000 + "x" + " }" * 3000))["depth"] == 3000


def test_nulls_and_empty_formulas(spark):
    df = spark.createDataFrame([(None,), ([],)], "t array<string>").select(L.structure(F.col("t")).alias("s")).select("s.nodes", "s.status")
    assert [tuple(r) for r in df.collect()] == [(0, "ok")] * 2


def test_page_annotations(spark, tmp_path):
    page = {"image_name": "p.jpg", "blocks": [{"order": 1, "type": "Txtblock", "polygon": [[0, 0], [10, 0], [10, 20]], "lines": [{"order": 2, "ocr": " x + 1 ", "polygon": []}, {"ocr": "   "}]}, {"type": "fig"}]}
    (tmp_path / "p.jpg.json").write_text(json.dumps(page))
    pages = A.pages(spark, str(tmp_path))
    got = A.expressions(pages, "d").collect()
    assert [(r.ocr, r.expression_id, r.line_id) for r in got] == [("x + 1", "d:p.jpg:1:2", "1:2")]
    assert A.raw_expressions(pages).count() == 2
    size = A.blocks(pages).where("block_type = 'Txtblock'").first()
    assert (size.page_width, size.page_height, size.block_id) == (10.0, 20.0, "p.jpg:block_1")
    with pytest.raises(Exception):
        A.pages(spark, str(tmp_path / "none")).count()


def test_captions(spark, tmp_path):
    (tmp_path / "caption.txt").write_text("a\tx^{2}\nb\t\nbad\n")
    rows = A.load(spark, "caption", str(tmp_path / "caption.txt"), "c").collect()
    assert [(r.sample_id, r.ocr, r.line_id) for r in rows] == [("a", "x^{2}", "1")]
    assert A.load(spark, "caption_with_empty", str(tmp_path / "caption.txt"), "h").count() == 2
    with pytest.raises(ValueError):
        A.load(spark, "nothing", "", "x")


def test_geometry(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([(square,), ([],)], "p array<struct<x:double,y:double>>")
    got = df.select(G.area(F.col("p")), G.bbox(F.col("p"))["x1"], G.polygon_problem(F.col("p"), F.lit(3), F.lit(9))).collect()
    assert [tuple(r) for r in got] == [(8.0, 4.0, "out_of_bounds"), (0.0, 0.0, "too_few_points")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "a int, b double")
    A.write_table(df, str(tmp_path / "t"), csv=True)
    A.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "t.csv")).first()["b"] == "0.500000"
    assert spark.read.json(str(tmp_path / "j")).first()["a"] == 1
