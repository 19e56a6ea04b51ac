"""Page annotations in their variants, releases, and files in pairs."""

import json

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.sources import annotations as A

PAGE = {
    "image_name": "a.jpg",
    "blocks": [
        {"order": 1, "type": "Txtblock", "polygon": [{"x": 0, "y": 1}, {"x": 10, "y": 1.5}, [10, 20], [3], "odd"], "lines": [{"order": 0, "ocr": " x + 1 ", "polygon": [[1, 2], [3, 4]]}, {"ocr": "   "}]},
        {"type": "deleted", "lines": [{"order": 2, "ocr": "y"}]},
    ],
}


def test_points_as_pairs_and_objects(spark, tmp_path):
    (tmp_path / "a.jpg.json").write_text(json.dumps(PAGE))
    pages = A.pages_or_any(spark, str(tmp_path))
    first = A.blocks(pages).orderBy("block_id").collect()
    assert [(p.x, p.y) for b in first if b.block_type == "Txtblock" for p in b.polygon] == [(0.0, 1.0), (10.0, 1.5), (10.0, 20.0)]
    lines = {(r.block_type, r.line_order, r.ocr.strip()): (len(r.line_polygon), r.is_ignore) for r in A.lines(pages, ignored=("deleted",)).collect()}
    assert lines == {("Txtblock", 0, "x + 1"): (2, False), ("Txtblock", 0, ""): (0, False), ("deleted", 2, "y"): (0, True)}
    assert sorted(r.ocr for r in A.expressions(pages, "d").collect()) == ["x + 1", "y"]


def test_other_names_where_the_usual_are_missing(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(PAGE))
    assert A.pages(spark, str(tmp_path)).count() == 0 and A.pages_or_any(spark, str(tmp_path)).count() == 1


def test_release(spark, tmp_path):
    regions = [
        {"reading_order": "2", "region_type": "b", "region_polygon": [[0, 0]], "lines": [{"reading_order": "x", "formula": " q ", "polygon": None}, {"formula": " "}]},
        {"reading_order": 0, "region_type": "a"}, {"region_type": "c", "lines": [{"reading_order": 7, "formula": "z"}]},
    ]
    (tmp_path / "annotations.json").write_text(json.dumps([{"image_name": "p1.JPG", "regions": regions}, {"image_name": "p2", "regions": None}]))
    rows = {r.source_file: r for r in A.released_pages(spark, str(tmp_path / "annotations.json")).collect()}
    assert [(b.order, b.type, [(x.order, x.ocr) for x in b.lines]) for b in rows["p1.jpg.json"].blocks] == [(0, "a", []), (2, "b", [(0, "q")]), (2, "c", [(7, "z")])]
    assert rows["p2.jpg.json"].blocks == []
    assert A.expressions(A.released_pages(spark, str(tmp_path / "annotations.json")), "d").count() == 2


def test_pairs(spark, tmp_path):
    for name in ("g1/q/a.jpg", "g1/q/a.jpg.json", "g1/q/b.jpg", "g2/r/c.jpg.json", "g2/r/x/c.jpg", "g2/r/x/c.jpg.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    found = {(r.group, r.name): r.problem for r in A.paired_files(spark, str(tmp_path), 2).collect()}
    assert found == {("g1/q", "a.jpg"): None, ("g1/q", "b.jpg"): "no_annotation", ("g2/r", "c.jpg"): "duplicate"}


def test_vocabulary_tokens(spark):
    words = ["abc", "ab", "x" * 32, "y" * 33]
    text = "abcab " + "x" * 33 + " " + "y" * 33
    got = spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t"), words).alias("k")).first().k
    want, i = [], 0
    while i < len(text):
        if text[i].isspace():
            i += 1
            continue
        best = next((w for w in sorted(words, key=len, reverse=True) if len(w) <= 32 and text.startswith(w, i)), text[i])
        want.append(best)
        i += len(best)
    assert got == want
