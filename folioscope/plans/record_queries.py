"""Queries of feature rows, boxes and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import corpus as C
from folioscope.operators import geometry as G
from folioscope.operators import records as X
from folioscope.operators import reports as P
from folioscope.plans.common import Catalogue, table, texts
from folioscope.plans.text_queries import _DOCS, _TURNS, documents, turns
from folioscope.plans.text_queries import _RULE as _RULE_SQL

Q = Catalogue()

_FLAGS = rf"""g as (select doc_id, length(text) as n, case when length(text) >= 8 then [substr(text, i + 1, 8) for i in range(0, length(text) - 7, 8)] else [] end as g from documents),
c as (select doc_id, max(c) as top from (select doc_id, x, count(*) as c from (select doc_id, unnest(g) as x from g) group by all) group by 1),
g2 as (select doc_id, case when length(text) >= 12 then [substr(text, i + 1, 12) for i in range(0, length(text) - 11, 6)] else [] end as g from documents),
c2 as (select doc_id, max(c) as top from (select doc_id, x, count(*) as c from (select doc_id, unnest(g) as x from g2) group by all) group by 1),
f as (select d.doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') = '' as is_empty, regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' and n_chars >= 8000 as hit_max_tokens,
 (case when g.n < 16 or coalesce(c.top, 0) <= 1 then 0 else c.top * 8 / g.n::double end) >= 0.35 as has_high_repetition_ratio, (case when g.n < 36 then 0 else coalesce(c2.top, 0) end) >= 20 as has_catastrophic_ngram_repeat,
 (case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text[-1] = chr(10) then 0 else 1 end end) >= 40 as has_extreme_line_count,
 len(regexp_extract_all(text, '(?s)\$\$.*?\$\$')) + len(regexp_extract_all(text, '\$[^$]+\$')) + len(regexp_extract_all(text, '(?s)\\\(.*?\\\)')) + len(regexp_extract_all(text, '(?s)\\\[.*?\\\]')) >= 3 as has_extreme_formula_count
 from documents d join g using (doc_id) left join c using (doc_id) left join c2 using (doc_id))"""


@Q.add("with " + _FLAGS + """ select doc_id, is_empty, hit_max_tokens, has_high_repetition_ratio, has_catastrophic_ngram_repeat, has_extreme_line_count, has_extreme_formula_count,
 case when is_empty then 'empty' when hit_max_tokens then 'truncated' when has_catastrophic_ngram_repeat then 'catastrophic_repeat' when has_high_repetition_ratio then 'high_repetition' when has_extreme_line_count then 'extreme_line_count' when has_extreme_formula_count then 'extreme_formula_count' else 'ok' end as primary_status,
 not (is_empty or hit_max_tokens or has_catastrophic_ngram_repeat or has_high_repetition_ratio or has_extreme_line_count or has_extreme_formula_count) as usable_strict, not (is_empty or hit_max_tokens or has_catastrophic_ngram_repeat) as usable_lenient from f""")
def quality_flags(spark, sf_dir):
    """All flags of every document; its characters stand for output tokens."""
    rows = texts(spark, sf_dir, "documents")
    flags = X.quality_flags(F.col("text"), F.col("n_chars"), 8000, lines=40, formulas=3)
    shown = [f for f in flags if not f.startswith(("has_invalid", "has_grounding"))]
    wide = rows.select("doc_id", *[c.alias(n) for n, c in flags.items()])
    return wide.select("doc_id", *shown, *[c.alias(n) for n, c in X.usable().items()])


@Q.add()
def formula_spans(spark, sf_dir):
    """Joined spans of marked formulas and what they cover; tested against marking characters."""
    return texts(spark, sf_dir, "documents").select("doc_id", X.formula_spans("text").alias("f")).select("doc_id", "f.spans", F.round("f.covered", 9).alias("covered"))


@Q.add("select o_orderkey, case when (o_orderkey % 3 = 0 and position('a' in lower(o_orderpriority)) > 0 and o_totalprice % 1 < 0.15) then 'figure_caption' when o_totalprice % 1 >= 0.25 or o_totalprice % 7 >= 6 then 'formula_heavy' when o_totalprice % 1 >= 0.05 or o_totalprice % 7 >= 5 then 'text_formula_mix' else 'plain_text' end as morphology from orders")
def content_morphology(spark, sf_dir):
    """Texts made of orders' priorities, every third with a figure's mark, and ratios made of their prices."""
    price = F.col("o_totalprice")
    mark = F.when((F.col("o_orderkey") % 3 == 0) & F.lower("o_orderpriority").contains("a"), F.concat(F.lit("![x] "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    lines = F.when(price % 7 >= 6, 0.4).when(price % 7 >= 5, 0.1).otherwise(0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", X.morphology(mark, price % 1, lines, F.lit(0.0)).alias("morphology"))


_LABELS = "['Sub_Title', 'title_image', 'Display Formula', 'photo', 'table caption', 'PARAGRAPH', 'seal', ' Chart ', 'text of math', '', 'footer']"


@Q.add(f"""with l as (select p_partkey, trim(lower({_LABELS}[1 + p_partkey % 11])) as l from part)
select case when regexp_matches(l, 'formula|equation|math|latex') then 'formula' when regexp_matches(l, 'figure|image|chart|diagram|picture|photo') then 'figure' when l like '%table%' then 'table' when regexp_matches(l, 'title|header|footer|caption|text') or l = 'paragraph' then 'text' else 'other' end as bucket, count(*) as count from l group by 1""")
def label_buckets(spark, sf_dir):
    names = F.array(*[F.lit(x.strip("' ") if x.strip(" ") != "' Chart '" else " Chart ") for x in _LABELS[1:-1].split(", ")])
    label = F.element_at(names, (F.col("p_partkey") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "part").groupBy(X.label_bucket(label).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


@Q.add("select case when s_acctbal > 0 then 'grayscale_content' else 'color_content' end || ';' || case when s_suppkey % 4 = 1 then 'transparency_used' else 'opaque' end as color_type, count(*) as count from supplier group by 1")
def colour_types(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(X.colour_type(F.col("s_acctbal") > 0, (F.col("s_suppkey") % 4 == 1).cast("double")).alias("color_type")).agg(F.count(F.lit(1)).alias("count"))


@Q.add("select case when l_linenumber in (0, 1) then 'flat' when l_linenumber in (2, 3) then 'nested' else 'deep' end as depth, count(*) as count from lineitem group by 1")
def depth_labels(spark, sf_dir):
    label = X.depth_label(F.col("l_linenumber"), {"flat": [0, 1], "nested": [2, 3], "deep": [4, 5]})
    return table(spark, sf_dir, "lineitem").groupBy(label.alias("depth")).agg(F.count(F.lit(1)).alias("count"))


@Q.add("select conv_id, turn, case when length(text) >= 60 then length(text) else 0 end as chars, case when length(text) >= 60 then role else '' end as role, case when length(text) >= 60 then contains(text, '?') else false end as asks from conversations")
def zeroed_rows(spark, sf_dir):
    values = {"chars": (F.length("text").cast("long"), "long"), "role": (F.col("role"), "string"), "asks": (F.col("text").contains("?"), "boolean")}
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *X.zeroed(F.length("text") >= 60, values))


@Q.add("""with n as (select distinct p_type as name from part union select distinct p_brand || '_' || p_size from part union select distinct p_name from part),
w as (select name, lag(name) over (order by name) as b, lead(name) over (order by name) as a from n),
k as (select name, len(list_filter(range(1, least(length(name), coalesce(length(b), 0)) + 1), lambda i: left(name, i) = left(b, i))) as x, len(list_filter(range(1, least(length(name), coalesce(length(a), 0)) + 1), lambda i: left(name, i) = left(a, i))) as y from w)
select name, case when contains(name, '_') then split_part(name, '_', 1) when greatest(x, y) > 0 then left(name, greatest(x, y)) else name end as key from k""")
def level_keys(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_type").alias("name")).union(part.select(F.concat_ws("_", "p_brand", "p_size"))).union(part.select("p_name"))
    return X.level_keys(names, "name")


_STEP = "case when {0} <= {1} then 0 when {0} <= {2} then 1 else 2 end"
_BINS = f"select {_STEP.format('l_quantity', 20, 40)} as a, {_STEP.format('l_linenumber', 1, 2)} as b, {_STEP.format('(l_partkey % 5)', 1, 2)} as c from lineitem"


@Q.add(f"select case when a + b + c = 0 then 'L1' when (a = 2)::int + (b = 2)::int + (c = 2)::int >= 2 and a > 0 and c > 0 then 'L3' else 'L2' end as tier, count(*) as count from ({_BINS}) group by 1")
def difficulty_tiers(spark, sf_dir):
    tier = X.difficulty(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_partkey") % 5)
    return table(spark, sf_dir, "lineitem").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("count"))


@Q.add("""select count(*) as expressions, count(distinct (least(l_linenumber % 4, 2), least(l_partkey % 3, 2))) as positions, count(*) filter (where l_linenumber % 4 = 0 and l_partkey % 3 > 0) as depth_without_type, count(*) filter (where l_linenumber % 4 > 0 and l_partkey % 3 = 0) as type_without_depth from lineitem""")
def position_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).alias("t"), (F.col("l_partkey") % 3).alias("d"))
    return X.position_problems(rows.withColumn("p", F.struct(F.least("t", F.lit(2)), F.least("d", F.lit(2)))), "t", "d", "p")


@Q.add("select l_orderkey, l_linenumber, l_partkey % 6 as types, row_number() over (order by l_linenumber desc, l_partkey % 6 desc, l_orderkey, l_partkey, l_suppkey, l_quantity) as place from lineitem where l_linenumber >= 4 and l_partkey % 6 >= 3 and l_quantity > 45")
def structure_cohort(spark, sf_dir):
    """The cohort in order; its place is numbered for the comparison."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 45").withColumn("types", F.col("l_partkey") % 6)
    order = [F.desc("l_linenumber"), F.desc("types"), "l_orderkey", "l_partkey", "l_suppkey", "l_quantity"]
    return X.cohort(rows, "l_linenumber", "types", *order).select("l_orderkey", "l_linenumber", "types", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


@Q.add("""with r as (select avg((l_quantity > 49.6)::int) as big, avg((l_discount > 0.05)::int) as discounted, avg((l_quantity > 0)::int) as any_ from lineitem),
f as (select 'big' as feature, big as rate from r union all select 'discounted', discounted from r union all select 'any', any_ from r)
select feature, rate, case when rate < 0.01 then 'drop_low' when rate > 0.99 then 'drop_high' else 'keep' end as decision from f""")
def feature_prevalence(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") > 49.6).alias("big"), (F.col("l_discount") > 0.05).alias("discounted"), (F.col("l_quantity") > 0).alias("any"))
    return X.prevalence(rows, ["big", "discounted", "any"])


_PICKED = ("x", "z", "<", "4", "q")


def _picks() -> str:
    found = [", h as (select doc_id, tokens, length(regexp_replace(norm, '\\s', '', 'g')) as chars, len(tokens) as n from corpus)"]
    for i, t in enumerate(_PICKED):
        bar = "".join(f" and doc_id not in (select doc_id from t{j})" for j in range(i))
        found.append(f"t{i} as (select '{t}' as token, doc_id, row_number() over (order by chars desc, n desc, doc_id)::int as rank from h where list_contains(tokens, '{t}') and chars > 3{bar} qualify rank <= 10)")
    return ",\n".join(found) + " " + " union all ".join(f"select token, doc_id, rank from t{i}" for i in range(len(_PICKED)))


@Q.add(_DOCS + _picks())
def confusable_examples(spark, sf_dir):
    return X.examples_by_token(documents(spark, sf_dir), "doc_id", list(_PICKED))


_BOXES = "select l_orderkey as image, l_linenumber as id, l_quantity / 50 as x1, l_discount * 9 as y1, case when l_partkey % 50 = 0 then null when l_partkey % 50 = 1 then 'nan'::double else l_quantity / 40 end as x2, case when l_partkey % 50 = 2 then l_discount * 9 else l_tax * 12 end as y2, l_partkey % 7 as kind from lineitem"
_CUT = f"""with b as ({_BOXES}), s as (select *, least(1, greatest(0, x1)) as ax, least(1, greatest(0, y1)) as ay, least(1, greatest(0, x2)) as bx, least(1, greatest(0, y2)) as by_ from b),
k as (select image, id, kind, case when x2 is null then 'invalid_coordinate' when isnan(x2) then 'nonfinite' when abs(bx - ax) <= 1e-6 then 'zero_width' when abs(by_ - ay) <= 1e-6 then 'zero_height' when abs(bx - ax) * abs(by_ - ay) <= 1e-8 then 'zero_area' end as problem,
 least(ax, bx) as x1, least(ay, by_) as y1, greatest(ax, bx) as x2, greatest(ay, by_) as y2 from s)"""


def _boxes(spark, sf_dir):
    p = F.col("l_partkey") % 50
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("id"), (F.col("l_partkey") % 7).alias("kind"), (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 9).alias("y1"),
        F.when(p == 0, F.lit(None)).when(p == 1, float("nan")).otherwise(F.col("l_quantity") / 40).alias("x2"), F.when(p == 2, F.col("l_discount") * 9).otherwise(F.col("l_tax") * 12).alias("y2"),
    )


@Q.add(_CUT + " select coalesce(problem, '') as problem, count(*) as boxes, round(sum(case when problem is null then (x2 - x1) * (y2 - y1) end), 4) as area, round(avg(case when problem is null then greatest(-5, least(5, ln((x2 - x1) / (y2 - y1)))) end), 6) as log_aspect from k group by 1")
def checked_boxes(spark, sf_dir):
    rows = X.checked_boxes(_boxes(spark, sf_dir))
    good = F.col("problem").isNull()
    return rows.groupBy(F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count(F.lit(1)).alias("boxes"), F.round(F.sum(F.when(good, F.col("area"))), 4).alias("area"), F.round(F.avg("log_aspect_ratio"), 6).alias("log_aspect"))


@Q.add()
def box_unions(spark, sf_dir):
    """Part of each image's grid that its boxes touch; tested against marking cells."""
    return X.union_ratio(X.checked_boxes(_boxes(spark, sf_dir)), "image")


@Q.add(_CUT + """, g as (select *, (x1 + x2) / 2 as cx, (y1 + y2) / 2 as cy, (x2 - x1) * (y2 - y1) as area, case when kind < 3 then 'text' when kind = 3 then 'formula' when kind = 4 then 'table' else 'other' end as bucket from k where problem is null)
select image, count(*) as blocks, count(*) filter (where bucket = 'text') as text_blocks, count(*) filter (where bucket = 'table') as table_blocks, round(coalesce(sum(area) filter (where bucket = 'text'), 0) / sum(area), 9) as text_area_ratio, round(avg(cx), 9) as mean_cx, round(stddev_pop(cy), 9) as std_cy,
 round(min(x1), 9) as left_margin, round(1 - max(y2), 9) as bottom_margin, round(least(avg((cx < 0.5)::int), avg((cx >= 0.5)::int)), 9) as column_balance, count(distinct (least(floor(cx * 4), 3) * 4 + least(floor(cy * 4), 3))) / 16 as occupied from g group by image""")
def layout_features(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ("title", "text", "caption", "equation", "table", "seal", "stamp"))), (F.col("kind") + 1).cast("int"))
    rows = X.layout_row(X.checked_boxes(_boxes(spark, sf_dir).withColumn("label", names)), "image")
    shown = [F.round(c, 9).alias(c) for c in ("text_area_ratio", "mean_cx", "std_cy", "left_margin", "bottom_margin", "column_balance")]
    return rows.select("image", "blocks", "text_blocks", "table_blocks", *shown, "occupied")


@Q.add("""with p as (select p_partkey, p_size * 10.0 as a, p_retailprice / 10 as b from part)
select p_partkey, round((a + 5) / 2, 6)::double as center_x, round((b + 3) / 2, 6)::double as center_y, round((a + 5) / 2 / 1000, 9)::double as norm_center_x, round((b + 3) / 2 / 500, 9)::double as norm_center_y, round((list_sort([0, a, a + 5, 5])[1] + list_sort([0, a, a + 5, 5])[3]) / 2, 6)::double as core_center_x from p""")
def block_geometry(spark, sf_dir):
    a, b = F.col("p_size") * F.lit(10.0), F.col("p_retailprice") / 10
    points = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(a, F.lit(0.0)), F.array(a + 5, b), F.array(F.lit(5.0), b + 3))
    rows = X.block_geometry(table(spark, sf_dir, "part").select("p_partkey", G.polygon_from_arrays(points).alias("p")), "p", F.lit(1000), F.lit(500))
    return rows.select("p_partkey", *[F.round(c, 6).alias(c) for c in ("center_x", "center_y")], *[F.round(c, 9).alias(c) for c in ("norm_center_x", "norm_center_y")], F.round("core_center_x", 6).alias("core_center_x"))


@Q.add("""with r as (select l_orderkey, l_linenumber, l_quantity - 3 as w, l_tax * 100 as h, case when l_partkey % 9 = 0 then 1 else (l_quantity - 3) / (l_tax * 100) end as a, l_partkey % 200 - 95 as t from lineitem where l_tax > 0)
select problem, count(*) as count from (select case when w <= 0 then 'not_positive' when abs(a - w / h) > 1e-6 * greatest(1, abs(a)) then 'aspect_mismatch' when t < -90 or t > 90 then 'angle_out_of_range' end as problem from r) where problem is not null group by 1""")
def rotated_box_problems(spark, sf_dir):
    w, h = F.col("l_quantity") - 3, F.col("l_tax") * 100
    rows = table(spark, sf_dir, "lineitem").where("l_tax > 0").select(
        F.struct("l_orderkey", "l_linenumber").alias("key"), w.cast("double").alias("width"), h.alias("height"), F.when(F.col("l_partkey") % 9 == 0, 1.0).otherwise(w / h).alias("aspect"), (F.col("l_partkey") % 200 - 95).cast("double").alias("angle")
    )
    return X.box_problems(rows, "key").groupBy("problem").agg(F.count(F.lit(1)).alias("count"))


@Q.add("select s_suppkey, round(1 - least(1, greatest(0, (s_acctbal / 40 - 12) / (case when 12 + s_nationkey > 14 then s_nationkey else 1 end))), 9) as tau from (select s_suppkey, s_acctbal, case when 12 + s_nationkey > 14 then s_nationkey else 0 end as s_nationkey from supplier)")
def darkness_thresholds(spark, sf_dir):
    light = F.when(F.col("s_nationkey") > 2, 12 + F.col("s_nationkey")).otherwise(12)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(X.darkness(F.col("s_acctbal") / 40, F.lit(12), light), 9).alias("tau"))


_ASSIGNED = "select o_orderkey as page, case when o_custkey % 10 < 8 then 'train' when o_custkey % 10 = 8 then 'val' else 'test' end as split, o_custkey % 3 as types, length(o_orderpriority) % 4 as depth from orders"


def _assigned(spark, sf_dir):
    k = F.col("o_custkey") % 10
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split"), (F.col("o_custkey") % 3).alias("types"), (F.length("o_orderpriority") % 4).alias("depth"))


@Q.add(f"""with a as ({_ASSIGNED}), n as (select count(*)::double as n from a), s as (select split, count(*) as s from a group by 1), o as (select types, depth, count(*) as o from a group by all), c as (select split, types, depth, count(*) as c from a group by all)
select round(sum(abs(coalesce(c, 0) / n - o / n * s / n)) / 2, 9) as tv from o cross join s cross join n left join c using (split, types, depth)""")
def split_joint_tv(spark, sf_dir):
    return X.joint_tv(_assigned(spark, sf_dir), "split", "types", "depth").select(F.round("tv", 9).alias("tv"))


@Q.add("select * from (values ('all_pages_assigned_once', true), ('splits_disjoint', true), ('capacities_match', false)) t(\"check\", passed)")
def split_acceptance(spark, sf_dir):
    """The assignment by customers is whole and disjoint, but not of the sizes asked for."""
    rows = _assigned(spark, sf_dir)
    return X.acceptance(rows.select("page"), rows, "page", "split", {"train": 1, "val": 1, "test": 1})


@Q.add("with k as (select conv_id, turn, count(*) as c, count(*) filter (where length(text) < 30) as x from conversations group by all) select count(distinct conv_id) as pages, sum(c)::bigint as lines, sum(x)::bigint as excluded, sum(c - 1)::bigint as repeated_lines from k")
def pass_audit(spark, sf_dir):
    return X.pass_audit(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.when(F.length("text") < 30, "short").otherwise(""))


@Q.add("select 'nations' as metric, count(*)::double as observed, 25.0::double as expected, count(*) = 25 as passed from nation union all select 'regions', count(distinct n_regionkey)::double, 6.0::double, false from nation")
def frozen_values(spark, sf_dir):
    found = table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("nations"), F.countDistinct("n_regionkey").alias("regions"))
    return X.expected_values(found, {"nations": 25, "regions": 6})


@Q.add("""with s as (select c_custkey as key from customer), a as (select o_custkey as key, count(*) as n from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as key, count(*) as n from orders where o_orderkey % 7 = 0 group by 1)
select case when a.n is null then 'missing_vision' when a.n > 1 then 'duplicate_vision' when b.n is null then 'missing_text' when b.n > 1 then 'duplicate_text' else '' end as problem, count(*) as count from s left join a using (key) left join b using (key) group by 1""")
def sample_alignment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    found = X.aligned(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key"), ("vision", orders.where("o_orderkey % 2 = 0")), ("text", orders.where("o_orderkey % 7 = 0")))
    return found.groupBy(F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count(F.lit(1)).alias("count"))


@Q.add("""with u as (select c_custkey as page, 'structure' as layout, 0 as f from customer where c_custkey % 2 = 0 union all select c_custkey, 'hybrid', 1 from customer where c_custkey % 3 = 0)
select layout, count(*) as pages from (select *, row_number() over (partition by page order by f) as r from u) where r = 1 group by 1""")
def layout_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"))
    found = X.first_of_layouts(c.where("page % 2 = 0").withColumn("layout", F.lit("structure")), c.where("page % 3 = 0").withColumn("layout", F.lit("hybrid")), key="page")
    return found.groupBy("layout").agg(F.count(F.lit(1)).alias("pages"))


@Q.add("select o_orderpriority as label, count(distinct o_custkey) as titles, count(distinct o_custkey) / (select count(distinct o_custkey) from orders)::double as share from orders group by 1")
def label_coverage(spark, sf_dir):
    return X.label_coverage(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("title"), F.col("o_orderpriority").alias("label")), "title", "label")


@Q.add(_TURNS + """, known as (select distinct token from (select unnest(regexp_extract_all(text, '[A-Za-z0-9]')) as token from benchmark) union select '☃'), h as (select counts.token, c, k.token is not null as known from counts left join known k using (token))
select sum(c) filter (where not known) / sum(c)::double as unknown_ratio, coalesce(sum(c) filter (where c <= 8), 0) / sum(c)::double as rare_ratio, count(*) filter (where known) / (select count(*) from known)::double as coverage from h""")
def token_ratios(spark, sf_dir):
    letters = F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9])"), 1)).alias("token")
    known = table(spark, sf_dir, "benchmark").select(letters).union(spark.createDataFrame([("☃",)], "token string")).distinct()
    return X.token_ratios(C.token_counts(turns(spark, sf_dir)), known)


_PAGES = "select conv_id, count(*) as expressions, sum(len(tokens))::double as tokens, max(len(tokens)) as longest from corpus group by 1"


@Q.add(_TURNS + f", p as ({_PAGES}), l as (select 'expressions' as metric, expressions::double as v from p union all select 'tokens', tokens from p union all select 'longest', longest from p) select metric, sum(v) as total, avg(v) as mean, quantile_cont(v, 0.5) as median, max(v) as max from l group by 1")
def page_summary(spark, sf_dir):
    pages = turns(spark, sf_dir).groupBy("conv_id").agg(F.count(F.lit(1)).alias("expressions"), F.sum(F.size("tokens")).alias("tokens"), F.max(F.size("tokens")).alias("longest"))
    return X.summary(pages, ["expressions", "tokens", "longest"])


@Q.add("with l as (select c_mktsegment as dataset, 'c_acctbal' as metric, c_acctbal as v from customer union all select c_mktsegment, 'c_nationkey', c_nationkey from customer) select dataset, metric, round(sum(v), 2) as total, round(avg(v), 6) as mean, quantile_cont(v, 0.5) as median, max(v) as max from l group by all")
def dataset_summaries(spark, sf_dir):
    rows = X.summary(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "dataset"), ["c_acctbal", "c_nationkey"], "dataset")
    return rows.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 6))


@Q.add()
def stratified_rows(spark, sf_dir):
    """A sample of vectors by quotas of their labels; the quotas are tested against the definition."""
    return X.stratified_sample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label", 60, 42)


_DISTANCE = "d as (select vec_id, label, round(1 - list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 9) as distance from u join (select label, list(a order by i) as c from (select label, i, avg(x) as a from (select label, generate_subscripts(v, 1) as i, unnest(v) as x from u) group by all) group by 1) using (label))"
_UNITS = "u as (select vec_id, label, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as v from embeddings)"


@Q.add(f"with {_UNITS}, {_DISTANCE} select label, vec_id, 'nearest' as place, row_number() over (partition by label order by distance, vec_id)::int as rank from d qualify rank <= 5 union all select label, vec_id, 'farthest', row_number() over (partition by label order by distance desc, vec_id)::int as rank from d qualify rank <= 5")
def cluster_galleries(spark, sf_dir):
    return X.galleries(_distances(spark, sf_dir), "vec_id", "label", "distance", 5)


def _distances(spark, sf_dir):
    """(vec_id, label, distance) of unit vectors from their label's mean direction."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(e, lambda x: x / F.sqrt(dot(e, e))).alias("v"))
    means = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("a")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "a"))).alias("l"))
    both = rows.join(means.select("label", F.transform("l", lambda s: s["a"]).alias("c")), "label")
    return both.select("vec_id", "label", F.round(1 - dot(F.col("v"), F.col("c")) / F.sqrt(dot(F.col("c"), F.col("c"))), 9).alias("distance"))


@Q.add(f"with {_UNITS}, {_DISTANCE} select count(*) as n, round(sum(distance), 4) as distortion, round(count(*) - sum(1 - distance), 4) as by_similarity, abs(sum(distance) - (count(*) - sum(1 - distance))) < 1e-5 as agree from d")
def cosine_distortion(spark, sf_dir):
    """Distortion as the sum of distances and as rows less the sum of similarities; both must agree."""
    d, s = F.sum("distance"), F.sum(1 - F.col("distance"))
    n = F.count(F.lit(1))
    return _distances(spark, sf_dir).agg(n.alias("n"), F.round(d, 4).alias("distortion"), F.round(n - s, 4).alias("by_similarity"), (F.abs(d - (n - s)) < 1e-5).alias("agree"))


@Q.add("select label as before, vec_id % 3 as after, count(*) as count, max((label <> vec_id % 3)::int) as changed from embeddings group by all")
def label_transitions(spark, sf_dir):
    return X.transitions(table(spark, sf_dir, "embeddings").select(F.col("label").alias("before"), (F.col("vec_id") % 3).alias("after")), "before", "after")


@Q.add("""with l as (select 'pc' || (l_linenumber % 3) as pca, o_orderpriority as feature, avg(l_quantity) as v from lineitem join orders on o_orderkey = l_orderkey group by all)
select pca, """ + ", ".join(f"round(max(v) filter (where feature = '{p}'), 6) as \"{p}\"" for p in ("1-URGENT", "2-HIGH", "5-LOW")) + " from l group by pca")
def wide_correlations(spark, sf_dir):
    """A long table of values turned into one column for each of the given features."""
    names = ["1-URGENT", "2-HIGH", "5-LOW"]
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    long = both.groupBy(F.concat(F.lit("pc"), F.col("l_linenumber") % 3).alias("pca"), F.col("o_orderpriority").alias("feature")).agg(F.avg("l_quantity").alias("v"))
    wide = long.groupBy("pca").pivot("feature", names).agg(F.first("v"))
    return wide.select("pca", *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in names])


@Q.add("select * from (values ('p_copy', 'p_size'), ('p_twice', 'p_name')) t(\"column\", kept)")
def duplicate_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_copy", F.col("p_size")).withColumn("p_twice", F.col("p_name")).withColumn("p_near", F.col("p_size") + F.when(F.col("p_partkey") == 1, 1).otherwise(0))
    return P.duplicate_columns(part, ["p_size", "p_name", "p_copy", "p_near", "p_twice"])


@Q.add("select r_regionkey::varchar as l1_code, r_name as l1_name, n_regionkey || '.' || n_nationkey as l2_code, n_name as l2_name from nation join region on r_regionkey = n_regionkey")
def label_taxonomy(spark, sf_dir):
    """Regions and nations written as a Markdown text and read back; every other nation is found by its code alone."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    one = region.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("| "), "r_regionkey", F.lit(" | "), "r_name", F.lit(" |")))), "\n").alias("a"))
    name = F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise("?")
    two = nation.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("| "), name, F.lit(" | `"), "n_regionkey", F.lit("."), "n_nationkey", F.lit("` | "), "n_name", F.lit(" |")))), "\n").alias("b"))
    text = F.concat(F.lit("# Labels\n\n## Upper\n| code | name |\n|---|---|\n"), "a", F.lit("\n\n## Lower\n\n| of | code | name |\n| --- | --- | --- |\n"), "b", F.lit("\n\n## Notes\nnone\n"))
    return P.taxonomy(one.join(two).select(text.alias("text")), "text", "Upper", "Lower", (5, 25))


_WORDS = ("the", "an", "and", "er", "in", "ing", "a", "tion", "=")


@Q.add(_TURNS.replace(_RULE_SQL, "|".join(sorted(_WORDS, key=lambda w: (-len(w), w))) + r"|\S") + " select token, c as count from counts")
def dictionary_tokens(spark, sf_dir):
    """Tokens by a given vocabulary: its longest entry at each place, else one character."""
    return C.token_counts(C.tokenized(texts(spark, sf_dir, "conversations").select("text"), vocabulary=list(_WORDS)))


# ---- classes of queries that a user of SQL expects beside these -----------------------------------------------------------------------


@Q.add("select user_id, event_id, (select max(o.ts) from events o where o.user_id = e.user_id and o.event_type = 'purchase' and o.ts <= e.ts) as last_purchase from events e where event_type = 'click'")
def asof_last(spark, sf_dir):
    """As-of join: each click's last purchase of its user, by one window over both instead of a join on a range."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    by = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    seen = rows.withColumn("last_purchase", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(by))
    return seen.where("event_type = 'click'").select("user_id", "event_id", "last_purchase")


@Q.add("select coalesce(c_nationkey, s_nationkey) as nation, c, s from (select c_nationkey, count(*) as c from customer where c_nationkey < 20 group by 1) full join (select s_nationkey, count(*) as s from supplier where s_nationkey > 4 group by 1) on c_nationkey = s_nationkey")
def full_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("c"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey > 4").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("s"))
    return c.join(s, "nation", "full")


@Q.add("select n_name, count(c_custkey) as customers from (select * from customer where c_acctbal > 9900) right join nation on n_nationkey = c_nationkey group by 1")
def right_outer(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9900")
    return rich.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "right").groupBy("n_name").agg(F.count("c_custkey").alias("customers"))


@Q.add("select o_orderpriority, sum(o_totalprice::decimal(12, 2))::varchar as total, min(o_totalprice::decimal(12, 2))::varchar as least from orders group by 1")
def decimal_sums(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(12,2)")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.sum(price).cast("string").alias("total"), F.min(price).cast("string").alias("least"))


@Q.add("select event_type, true as users_within, true as median_within from events group by 1")
def approximate_counts(spark, sf_dir):
    """Approximate distinct counts and medians are within their bounds of the exact ones."""
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.countDistinct("user_id").alias("e"), F.approx_percentile("value", 0.5, 10_000).alias("m"), F.percentile("value", F.array(F.lit(0.45), F.lit(0.55))).alias("q"))
    return rows.select("event_type", (F.abs(F.col("a") - F.col("e")) <= 0.1 * F.col("e") + 1).alias("users_within"), F.col("m").between(F.col("q")[0], F.col("q")[1]).alias("median_within"))


@Q.add("select * from (select 'customer' as kind, c_nationkey as nation from customer union all select 'supplier', s_nationkey from supplier)")
def union_all(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation")))
