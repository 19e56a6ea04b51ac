"""Layout, splits, vectors and streams on small tables, where SQL can't tell or edges matter."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import layout as Y
from folioscope.operators import models as M
from folioscope.operators import relations as R
from folioscope.operators import split_solver as S
from folioscope.operators import vectors as V
from folioscope.streaming import events as E
from folioscope import views


def test_one_to_one_join_fails_on_repeats(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(Exception, match="repeats"):
        R.one_to_one(a, b, "k").collect()


def test_overlapping_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    boxes = [(int(p), i, float(x), float(x + w), float(y), float(y + h)) for i, (p, x, w, y, h) in enumerate(zip(rng.integers(0, 3, 120), rng.random(120) * 300, rng.random(120) * 40, rng.random(120) * 80, rng.random(120) * 30 + 1))]
    df = spark.createDataFrame(boxes, "page int, id int, x0 double, x1 double, y0 double, y1 double")
    got = {(r.page, r.id_a, r.id_b) for r in R.overlapping_pairs(df, "page", "id", 50.0).collect()}
    want = {(p, i, j) for p, i, x0, x1, y0, y1 in boxes for q, j, a0, a1, b0, b1 in boxes if p == q and i < j and y0 < b1 and b0 < y1 and max(x0, a0) - min(x1, a1) <= 50}
    assert got == want


def test_segments_compare_with_their_start(spark):
    df = spark.createDataFrame([([0.0, 0.05, 0.1, 0.16],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(Y.segments(F.col("v"), 0.06)).collect()] == [2, 0]


def test_smallest_rectangle():
    turn = np.radians(30)
    square = np.array([[0, 0], [8, 0], [8, 2], [0, 2]]) @ np.array([[np.cos(turn), np.sin(turn)], [-np.sin(turn), np.cos(turn)]])
    long, short, angle = Y.smallest_rectangle(square)
    assert (round(long, 6), round(short, 6), round(angle, 6)) == (8, 2, 30)
    assert Y.smallest_rectangle(np.zeros((1, 2))) == (0.0, 0.0, 0.0)


def test_pixels():
    gray = np.full((10, 12), 255, np.uint8)
    gray[2:5, 3:9] = 10
    square = [(3, 2), (9, 2), (9, 5), (3, 5)]
    assert Y.raster(square, 12, 10).sum() == 18
    assert Y.foreground_density(gray, 100) == 18 / 120 and Y.foreground_density(gray, 100, square) == 1.0
    assert Y.ink_outside(gray, 100, [(3, 2), (9, 2), (3, 5)]) > 0
    assert 10 <= Y.pooled_otsu(Y.gray_histogram(gray)) < 255
    assert Y.density_percentile(Y.equal_image_average([Y.gray_histogram(gray)]), 1.0) == 10
    assert Y.darkness(np.array([10, 255]), 10, 255).tolist() == [1.0, 0.0]


def test_boxes_keep_the_first(spark):
    rows = [("p", 1, "t", 0.1, 0.1, 0.5, 0.5), ("p", 2, "t", 0.1, 0.1, 0.5, 0.501), ("p", 3, "f", 0.1, 0.1, 0.5, 0.5), ("q", 1, "t", 0.1, 0.1, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "image string, o int, label string, x0 double, y0 double, x1 double, y1 double")
    assert {(r.image, r.o): r.kept for r in Y.deduplicated_boxes(df, "image", "o").collect()} == {("p", 1): True, ("p", 2): False, ("p", 3): True, ("q", 1): True}


def test_split_solver_covers_the_vocabulary():
    labels = {f"p{i:02d}": ["even" if i % 2 else "odd", f"b{i % 3}"] for i in range(40)}
    tokens = {p: ["x", "1", f"t{i % 5}"] for i, p in enumerate(labels)}
    split = S.solve(labels, tokens, 42)
    sizes = {s: sum(v == s for v in split.values()) for s in S.RATIOS}
    assert sizes == {"train": 32, "val": 4, "test": 4}
    assert {t for p, s in split.items() if s == "train" for t in tokens[p]} == {t for v in tokens.values() for t in v}
    assert split == S.solve(labels, tokens, 42)
    worst, mean = S.objective(labels, split, S.RATIOS)
    assert worst <= 1 and mean < 0.5


def test_split_solver_is_bounded(spark):
    pages = spark.createDataFrame([(i, ["a"], ["t"]) for i in range(5)], "page long, labels array<string>, tokens array<string>")
    with pytest.raises(ValueError):
        S.constrained_split(pages, "page", max_pages=4)
    assert S.constrained_split(pages, "page", seeds=(1, 2)).count() == 5


def test_constrained_split_takes_all_conversations_and_words(spark, tmp_path):
    from folioscope.plans import catalogue

    words = {i: [f"w{(i * 7 + j * j) % 50:02d}" for j in range(20)] + ["zz"] * (i == 190) for i in range(200)}
    spark.createDataFrame([(i, 0, "user", " ".join(w)) for i, w in words.items()], "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    split = {r.conv_id: r.split for r in catalogue.queries()["constrained_split"](spark, str(tmp_path)).collect()}
    assert set(split) == set(words) and split[190] == "train"
    assert {w for i, s in split.items() if s == "train" for w in words[i]} == {w for v in words.values() for w in v}


def test_kmeans_and_pca_by_group(spark):
    rng = np.random.default_rng(0)
    axes = np.eye(32)[:4]
    rows = [("g", i, (axes[i % 4] + rng.normal(0, 0.05, 32)).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>")
    found = V.spherical_kmeans(df, "g", "id", "v", 4).toPandas()
    assert found.assign(t=found.id % 4).groupby("cluster").t.nunique().max() == 1
    x = np.stack(V.principal_components(df, "g", "id", "v", 3).orderBy("id").toPandas().reduced.to_numpy())
    assert x.shape == (80, 3) and np.allclose(x.mean(0), 0, atol=1e-9)


def test_neighbour_graph_of_all_vectors_equals_brute_force(spark, tmp_path):
    from folioscope.plans import catalogue

    x = np.random.default_rng(5).normal(0, 1, (300, 8)).astype(np.float32).astype(float)
    x[210:220] = x[3]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.src, r.dst) for r in catalogue.queries()["neighbour_graph"](spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 9)
    np.fill_diagonal(c, -np.inf)
    assert got == {(min(i, int(j)), max(i, int(j))) for i in range(300) for j in np.lexsort((np.arange(300), -c[i]))[:5]}


def test_communities_follow_the_graph_to_its_end(spark):
    path = spark.createDataFrame([(i, i + 1, 20.0 - i) for i in range(11)], "src long, dst long, weight double")
    assert {(r.node, r.community) for r in M.communities(path).collect()} == {(i, 0) for i in range(12)}
    with pytest.raises(RuntimeError, match="still change"):
        M.communities(path, 3)


def test_coverage_in_blocks(spark, monkeypatch):
    x = np.random.default_rng(2).normal(0, 1, (60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    best = (u @ u[:20].T).max(1).round(9)
    for block in (10_000, 3):
        monkeypatch.setattr(V, "CENTER_BLOCK", block)
        got = {r.limit: r.covered for r in V.coverage(df, df.where("i < 20"), "v", [0.5, 0.8, 1.0]).collect()}
        assert got == {t: np.mean(best >= t) for t in (0.5, 0.8, 1.0)}


def test_fusion_has_length_one(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<double>, b array<double>").select(V.fused(V.unit(F.col("a")), V.unit(F.col("b"))).alias("v"))
    assert np.allclose(df.first().v, np.array([0.6, 0.8, 1, 0]) / np.sqrt(2))


def test_streams_agree_with_tables(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = E.windowed(E.read(spark, str(tmp_path / "in"), table), "ts", "6 hours", late="1000 days")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    plain = lambda df: sorted((str(r.start), str(r.end), r.event_type, r.n, r.total) for r in df.collect())
    assert plain(spark.table("windows")) == plain(E.windowed(table, "ts", "6 hours"))


def test_views(spark, sf_dir):
    names = views.register(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix="b")
    assert spark.sql("select count(*) from b_longtail").first()[0] > 0 and len(names) == 6
    assert spark.sql(r"select parse_status('x ^ { 2 }')").first()[0] == "ok"


def test_plans_push_down(spark, sf_dir, capsys):
    from folioscope.plans import catalogue

    catalogue.queries()["pricing_summary"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_comment" not in plan


def test_boxes_of_many_images_equal_brute_force(spark):
    """boxes are compared for many images at once; images go over the ends of batches, and a null image keeps its rows."""
    rng = np.random.default_rng(5)
    boxes = [(None if p == 0 else int(p), i, "ab"[int(b)], float(x), float(y), float(x + 1), float(y + 1)) for i, (p, b, x, y) in enumerate(zip(rng.integers(0, 60, 900), rng.integers(0, 2, 900), rng.integers(0, 3, 900) * 0.015, rng.integers(0, 2, 900) * 0.015))]
    want, held = {}, {}
    for p, i, label, x0, y0, *_ in boxes:
        near = [(a, b) for kind, a, b in held.setdefault(p, []) if kind == label and abs(a - x0) <= 0.02 and abs(b - y0) <= 0.02 and (inter := (1 - abs(a - x0)) * (1 - abs(b - y0))) / (2 - inter) >= 0.95]
        want[p, i] = not near
        held[p] += [] if near else [(label, x0, y0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = Y.deduplicated_boxes(spark.createDataFrame(boxes, "image int, o int, label string, x0 double, y0 double, x1 double, y1 double"), "image", "o").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.image, r.o): r.kept for r in got} == want and not all(want.values())


def test_split_of_more_pages_than_a_stratum_holds(spark):
    """any number of pages is split, by strata that cover their types; one stratum gives the solver's own result."""
    rows = [(i, ["even" if i % 2 else "odd", f"b{i % 3}"], [f"t{i % 5}", "x"]) for i in range(400)]
    pages = spark.createDataFrame(rows, "page long, labels array<string>, tokens array<string>")
    got = S.split_by_strata(pages, "page", seeds=(1, 2), stratum_pages=100).collect()
    sizes = {s: sum(r.split == s for r in got) for s in S.RATIOS}
    assert sorted(r.page for r in got) == list(range(400)) and abs(sizes["train"] - 320) <= 8 and len({(r.seed, r.worst, r.mean) for r in got}) == 1
    assert {t for r in got if r.split == "train" for t in rows[r.page][2]} == {"x", *(f"t{i}" for i in range(5))}
    key = lambda df: sorted(map(tuple, df.select("seed", "page", "split", "worst", "mean").collect()))
    assert key(S.split_by_strata(pages, "page", seeds=(1, 2))) == key(S.constrained_split(pages, "page", seeds=(1, 2)))
