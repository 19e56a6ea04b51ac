"""Queries of report tables and vector diagnostics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import geometry as G
from folioscope.operators import relations as R
from folioscope.operators import reports as P
from folioscope.operators import vectors as V
from folioscope.plans.common import Catalogue, table, texts

Q = Catalogue()


@Q.add("with c as (select turn as value, count(*) as n from conversations group by 1) select v as value, coalesce(n, 0) as count from (select unnest(range(min(value), max(value) + 1)) as v from c) left join c on v = value")
def gap_filled_curve(spark, sf_dir):
    return P.gap_filled(texts(spark, sf_dir, "conversations").select(F.col("turn").alias("value")), "value")


@Q.add("with c as (select l_linenumber as a, floor(l_discount * 100)::bigint % 6 as b, count(*) as n from lineitem group by all) select a, b, coalesce(n, 0) as count from (select unnest(range(0, 10)) as a) cross join (select unnest(range(0, 6)) as b) left join c using (a, b)")
def joint_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), (F.floor(F.col("l_discount") * 100) % 6).alias("b"))
    return P.grid(rows, "a", list(range(10)), "b", list(range(6)))


@Q.add("""with g as (select avg((length(text) > 0)::int) as non_empty, count(distinct lang)::double as languages, avg(n_chars) as mean_chars, count(*) filter (where text is null)::double as nulls from documents)
select 'non_empty' as gate, non_empty as value, non_empty between 0.99 and 1 as passed from g union all select 'languages', languages, languages between 2 and 10 from g union all select 'mean_chars', mean_chars, mean_chars between 10 and 100 from g union all select 'nulls', nulls, nulls between 0 and 0 from g""")
def quality_gates(spark, sf_dir):
    checks = {
        "non_empty": (F.avg((F.length("text") > 0).cast("double")), 0.99, 1), "languages": (F.countDistinct("lang"), 2, 10), "mean_chars": (F.avg("n_chars"), 10, 100),
        "nulls": (F.count(F.when(F.col("text").isNull(), 1)), 0, 0),
    }
    return P.gates(texts(spark, sf_dir, "documents"), checks)


@Q.add("with k as (select o_custkey as k, count(distinct o_orderstatus) as n from orders group by 1) select count(*) as keys, count(*) filter (where n > 1) as in_several, count(*) filter (where n = 0) as in_none from k")
def split_disjointness(spark, sf_dir):
    return P.disjointness(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@Q.add("with a as (select distinct o_custkey as k from orders where o_orderstatus = 'O'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'F') select k as o_custkey, 'extra' as side from a where k not in (select k from b) union all select k, 'missing' from b where k not in (select k from a)")
def manifest_difference(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return P.symmetric_difference(orders.where("o_orderstatus = 'O'"), orders.where("o_orderstatus = 'F'"), "o_custkey")


@Q.add("""with p as (select a.l_orderkey as page, a.l_linenumber as a, b.l_linenumber as b from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber < b.l_linenumber and a.l_discount = b.l_discount)
select (select count(*) from p) as pairs, (select count(distinct page) from p) as pages, (select count(distinct (page, l)) from (select page, unnest([a, b]) as l from p)) as lines""")
def pair_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_discount")
    pairs = rows.select("page", F.col("l_linenumber").alias("a"), "l_discount").join(rows.select("page", F.col("l_linenumber").alias("b"), "l_discount"), ["page", "l_discount"]).where("a < b")
    return P.pair_summary(pairs, "page", "a", "b")


@Q.add("select l_returnflag as label, count(*) filter (where l_linenumber > 1) as first, sum(l_linenumber)::bigint as blocks, sum(l_linenumber * (1 + l_linenumber % 2))::bigint as boxes, round(sum(l_quantity * l_linenumber), 2) as left_sides from lineitem group by 1")
def grounding_blocks(spark, sf_dir):
    """Texts made of lineitem's numbers: as many marked blocks as the line number, of one or two boxes each, with prose between."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    boxes = F.concat(F.lit("[["), q.cast("string"), F.lit(",2,3,4]"), F.when(n % 2 == 1, ",[5,6,7,8]]").otherwise("]"))
    mark = F.concat(F.lit("prose <|ref|>"), F.col("l_returnflag"), F.lit("<|/ref|><|det|>"), boxes, F.lit("<|/det|> more\n"))
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", P.grounding_blocks(F.repeat(mark, n)).alias("b")).select("l_linenumber", F.posexplode("b").alias("at", "x"))
    left = F.col("x.boxes")[0][0]
    return rows.groupBy("x.label").agg(F.count(F.when((F.col("at") == 0) & (F.col("l_linenumber") > 1), 1)).alias("first"), F.count(F.lit(1)).alias("blocks"), F.sum(F.size("x.boxes")).alias("boxes"), F.round(F.sum(left), 2).alias("left_sides"))


@Q.add("""with o as (select o_orderkey % 5 as kind, o_orderpriority as p, o_orderstatus as s from orders)
select l1, l2, count(*) as count from (select p as l1, s as l2 from o where kind in (0, 1) union all select p, 'Sets' from o where kind = 0 union all select p, null from o where kind = 2) group by all""")
def label_objects(spark, sf_dir):
    """Answers made of orders: two labels in a fence, one label in a list, an old single label, and two kinds that are no answer."""
    p, s, kind = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey") % 5
    pair = lambda a, b: F.concat(F.lit('{"l1": "'), a, F.lit('", "l2": "'), b, F.lit('"}'))
    text = (
        F.when(kind == 0, F.concat(F.lit('```json\n{"labels": ['), pair(p, s), F.lit(", "), pair(p, F.lit("Sets")), F.lit("]}\n```"))).when(kind == 1, F.concat(F.lit('{"labels": ['), pair(p, s), F.lit("]}")))
        .when(kind == 2, F.concat(F.lit('{"l1": "'), p, F.lit('"}'))).when(kind == 3, F.lit("no answer"))
    )
    return table(spark, sf_dir, "orders").select(F.explode(P.label_objects(text)).alias("x")).groupBy("x.l1", "x.l2").agg(F.count(F.lit(1)).alias("count"))


@Q.add("select name, split_part(name, '_', 1) as prefix, count(*) as count from (select p_name || case when p_partkey % 2 = 0 then '_' || p_brand || '_' else '' end as name from part) group by all")
def prefix_keys(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_"), "p_brand", F.lit("_"))).otherwise(""))
    return table(spark, sf_dir, "part").select(name.alias("name")).groupBy("name", T.prefix_key(F.col("name")).alias("prefix")).agg(F.count(F.lit(1)).alias("count"))


@Q.add("select column_name as \"column\", n as \"distinct\" from (select 'one' as column_name, count(distinct 1) as n from part union all select 'p_size', count(distinct p_size) from part union all select 'p_brand', count(distinct p_brand) from part) where n <= 1")
def constant_columns(spark, sf_dir):
    return P.constant_columns(table(spark, sf_dir, "part").withColumn("one", F.lit(1)), ["one", "p_size", "p_brand"])


@Q.add("select c_custkey, ln(1 + greatest(coalesce(c_acctbal, 0), 0)) as scaled from customer")
def log_scaled(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", P.log_scaled(F.col("c_acctbal")).alias("scaled"))


@Q.add("""with p as (select p_partkey, list_sort([p_size::double, p_size * 2.0, p_size + 30.0, p_retailprice / 50, 7.0]) as x from part)
select p_partkey, x[1] as lo, x[4] as hi, round(greatest(0, least(x[4], 40) - greatest(x[1], 10)), 6)::double as overlap, round(greatest(0, greatest(x[1], 10) - least(x[4], 40)), 6)::double as gap from p""")
def core_intervals(spark, sf_dir):
    xs = F.array(F.col("p_size").cast("double"), F.col("p_size") * F.lit(2.0), F.col("p_size") + F.lit(30.0), F.col("p_retailprice") / 50, F.lit(7.0))
    rows = table(spark, sf_dir, "part").select("p_partkey", G.core_interval(F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(0.0).alias("y")))).alias("c"))
    args = (F.col("c.lo"), F.col("c.hi"), F.lit(10.0), F.lit(40.0))
    return rows.select("p_partkey", "c.lo", "c.hi", F.round(G.overlap(*args), 6).alias("overlap"), F.round(G.gap(*args), 6).alias("gap"))


_UNIT = "with raw as (select vec_id, label, embedding::double[] as e from embeddings), u as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as v from raw), d as (select label, unnest(v) as x, generate_subscripts(v, 1) as i from u), m as (select label, list(a order by i) as mean from (select label, i, avg(x) as a from d group by all) group by label)"


@Q.add(_UNIT + " select label, count(*) as n, round(avg(1 - list_dot_product(v, mean) / sqrt(list_dot_product(mean, mean))), 6) as mean_distance from u join m using (label) group by label")
def group_centres(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return V.cosine_to_centroid(rows, "label", "embedding").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(1 - F.col("cosine")), 6).alias("mean_distance"))


@Q.add(_UNIT + " select a.label as a, b.label as b, round(1 - list_dot_product(a.mean, b.mean) / sqrt(list_dot_product(a.mean, a.mean) * list_dot_product(b.mean, b.mean)), 6) as distance from m a join m b on a.label < b.label")
def centre_distances(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    c = V.centroids(V.normalized(rows, "embedding"), "label", "embedding")
    a, b = c.select(F.col("label").alias("a"), F.col("mean").alias("ma")), c.select(F.col("label").alias("b"), F.col("mean").alias("mb"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(1 - V.dot(F.col("ma"), F.col("mb")) / (V.norm(F.col("ma")) * V.norm(F.col("mb"))), 6).alias("distance"))


@Q.add("""with c as (select c_custkey % 40 as page, c_nationkey % 5 as rare from customer), p as (select page, count(*) filter (where rare = 0) as n from c group by page)
select case when n = 0 then '0' when n <= 3 then n::varchar when n <= 5 then '4-5' else '>=6' end as bin, count(*) as pages from p group by 1""")
def rare_occurrences(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 40).alias("page")).agg(F.count(F.when(F.col("c_nationkey") % 5 == 0, 1)).alias("n"))
    n = F.col("n")
    return pages.groupBy(F.when(n <= 3, n.cast("string")).when(n <= 5, "4-5").otherwise(">=6").alias("bin")).agg(F.count(F.lit(1)).alias("pages"))


@Q.add("""with a as (select p_size::double as x, p_retailprice as y, length(p_name)::double as z from part), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as x, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as y, rank() over (order by z) + (count(*) over (partition by z) - 1) / 2.0 as z from a)
select 'p_size' as component, 'p_retailprice' as variable, round(corr(x, y), 6) as spearman, abs(corr(x, y)) >= 0.5 as alert from r union all select 'p_size', 'name_length', round(corr(x, z), 6), abs(corr(x, z)) >= 0.5 from r""")
def confound_alerts(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("name_length", F.length("p_name"))
    out = None
    for other in ("p_retailprice", "name_length"):
        one = R.spearman(part, "p_size", other).select(F.lit("p_size").alias("component"), F.lit(other).alias("variable"), F.round("spearman", 6).alias("spearman"), (F.abs("spearman") >= 0.5).alias("alert"))
        out = one if out is None else out.unionByName(one)
    return out
