"""Queries of joins, windows, sets, histograms and geometry over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import corpus as C
from folioscope.operators import geometry as G
from folioscope.operators import relations as R
from folioscope.plans.common import Catalogue, table, texts

Q = Catalogue()


@Q.add("select doc_id, lang, quality, toxic from documents join labels using (doc_id)")
def one_to_one_join(spark, sf_dir):
    return R.one_to_one(texts(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@Q.add("select 0::bigint as repeated_left, 0::bigint as repeated_right, (select count(*) from documents where doc_id not in (select doc_id from labels)) as left_only, (select count(*) from labels where doc_id not in (select doc_id from documents)) as right_only")
def key_violations(spark, sf_dir):
    return R.key_violations(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@Q.add("select d.doc_id, d.lang, l.quality, l.doc_id is not null as matched from documents d left join labels l using (doc_id)")
def left_indicator(spark, sf_dir):
    return R.with_indicator(texts(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@Q.add("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def anti_missing(spark, sf_dir):
    return texts(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang")


@Q.add("select doc_id, n_chars from documents where doc_id in (select doc_id from labels where quality = 1 and toxic = 0)")
def semi_usable(spark, sf_dir):
    return texts(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0"), "doc_id", "left_semi").select("doc_id", "n_chars")


@Q.add("select doc_id, coalesce(l.quality, d.quality) as quality from (select doc_id, -1 as quality from documents) d left join labels l using (doc_id)")
def upsert_last(spark, sf_dir):
    old = texts(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return R.upsert_last(old, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")


@Q.add("select doc_id, coalesce('q' || l.quality, d.lang) as lang from documents d left join labels l using (doc_id)")
def coalesced_manifest(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("lang"))
    return R.coalesced(texts(spark, sf_dir, "documents"), old, "doc_id", ["lang"])


_BOXES = "select l_orderkey as page, l_linenumber::bigint as id, l_quantity * 10 as x0, l_quantity * 10 + 60 as x1, l_discount * 1000 as y0, l_discount * 1000 + 20 + l_tax * 100 as y1 from lineitem"
_PAIRS = f"""with b as ({_BOXES}), p as (select a.page, a.id as id_a, b.id as id_b, greatest(greatest(a.x0, b.x0) - least(a.x1, b.x1), 0) as gap, greatest(a.x0, b.x0) - least(a.x1, b.x1) < 0 as x_overlap,
 least(a.y1 - a.y0, b.y1 - b.y0) / greatest(a.y1 - a.y0, b.y1 - b.y0) as height_similarity, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) as y_overlap_ratio
 from b a join b on a.page = b.page and a.id < b.id and a.y0 < b.y1 and b.y0 < a.y1 and greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 50)"""


def _boxes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("id"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + 60).alias("x1"), (F.col("l_discount") * 1000).alias("y0"), (F.col("l_discount") * 1000 + 20 + F.col("l_tax") * 100).alias("y1")
    )


@Q.add(_PAIRS + " select page, id_a, id_b, round(gap, 6) as gap, x_overlap, round(height_similarity, 6) as height_similarity, round(y_overlap_ratio, 6) as y_overlap_ratio from p")
def interval_pairs(spark, sf_dir):
    pairs = R.overlapping_pairs(_boxes(spark, sf_dir), "page", "id")
    return pairs.select("page", "id_a", "id_b", F.round("gap", 6).alias("gap"), "x_overlap", F.round("height_similarity", 6).alias("height_similarity"), F.round("y_overlap_ratio", 6).alias("y_overlap_ratio"))


@Q.add(_PAIRS + ", a as (select *, (not x_overlap and height_similarity >= 0.7 and y_overlap_ratio >= 0.7 and gap <= 50) as adjacent from p) select adjacent, count(*) as pairs, count(distinct page) as pages from a group by adjacent")
def pair_adjacency(spark, sf_dir):
    found = R.adjacency(R.overlapping_pairs(_boxes(spark, sf_dir), "page", "id"))
    return found.groupBy("adjacent").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("page").alias("pages"))


@Q.add("""with s as (select l_orderkey as page, l_quantity as lo, lag(l_quantity + 10) over w as h, lag(l_quantity) over w as l from lineitem window w as (partition by l_orderkey order by l_linenumber, l_quantity))
select page, count(*) as steps, avg((lo < h)::int) as overlap_share, max(greatest(l - lo, 0)) as step_back from s where h is not null group by page""")
def adjacent_overlap_score(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", F.col("l_quantity").alias("low"), (F.col("l_quantity") + 10).alias("high"))
    return R.adjacent_overlap(rows, "page", ["l_linenumber", "low"], "low", "high")


@Q.add("select lang, doc_id, n_chars, rank from (select lang, doc_id, n_chars, row_number() over (partition by lang order by n_chars desc, doc_id)::int as rank from documents) where rank <= 20")
def topn_per_group(spark, sf_dir):
    return R.top_per_group(texts(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 20)


@Q.add("select source, doc_id, rank from (select source, doc_id, row_number() over (partition by source order by sha256('42:' || doc_id), doc_id)::int as rank from documents) where rank <= 3")
def hash_order_pick(spark, sf_dir):
    return R.top_per_group(texts(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [R.seeded_order(F.col("doc_id"), 42), F.col("doc_id")], 3)


@Q.add("""with h as ((select p_partkey, p_size, 'low' as side, row_number() over (order by p_size, p_partkey)::int as rank from part) union all (select p_partkey, p_size, 'high', row_number() over (order by p_size desc, p_partkey)::int from part))
select * from h where rank <= 20""")
def extremes(spark, sf_dir):
    """The n lowest and the n highest rows: two top-n operators, no global sort."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    sides = []
    for side, order in (("low", F.col("p_size").asc()), ("high", F.col("p_size").desc())):
        top = part.orderBy(order, "p_partkey").limit(20)
        sides.append(R.top_per_group(top.withColumn("side", F.lit(side)), ["side"], [order, F.col("p_partkey")], 20))
    return sides[0].unionByName(sides[1])


@Q.add("""with d as (select lang, case when source in ('src0', 'src1', 'src2') then source else 'rest' end as split from documents) select lang,
 case when grouping(split) = 1 then 'overall' else split end as split, count(*) as count, count(*) / sum(count(*)) over (partition by case when grouping(split) = 1 then 'overall' else split end)::double as ratio from d group by grouping sets ((lang, split), (lang))""")
def split_rollup(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents").select("lang", F.when(F.col("source").isin("src0", "src1", "src2"), F.col("source")).otherwise("rest").alias("split"))
    return R.overall_and_by(rows, "split", "lang")


@Q.add("select o_orderstatus, " + ", ".join(f"count(*) filter (where o_orderpriority = '{p}') as \"{p}\"" for p in ("1-URGENT", "2-HIGH", "5-LOW")) + " from orders group by o_orderstatus")
def label_crosstab(spark, sf_dir):
    return R.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"])


_HIST = "select least(floor(o_totalprice / 2000), 255)::int as bin, count(*) as n from orders group by 1"


def _histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.least(F.floor(F.col("o_totalprice") / 2000), F.lit(255)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@Q.add(f"""with h as ({_HIST}), s as (select bin, sum(n) over w as w0, sum(n * bin) over w as m0, sum(n) over () as n, sum(n * bin) over () as m from h window w as (order by bin rows unbounded preceding)),
b as (select bin as threshold, case when w0 > 0 and n - w0 > 0 then w0::double * (n - w0)::double * pow(m0::double / w0::double - (m - m0)::double / (n - w0)::double, 2) else 0 end as between_ from s)
select threshold, round(between_ / 1e6, 2) as between_m from b order by round(between_, 3) desc, threshold limit 1""")
def otsu_threshold(spark, sf_dir):
    return R.otsu(_histogram(spark, sf_dir), "bin", "n").select("threshold", F.round(F.col("between") / 1e6, 2).alias("between_m"))


@Q.add(f"""with h as ({_HIST}), s as (select bin, 100.0::double * sum(n) over (order by bin rows unbounded preceding) / sum(n) over () as p from h)
select q::double as percent, (select min(bin) from s where p >= q) as value from (values (1.0), (50.0), (99.5)) v(q)""")
def hist_percentile(spark, sf_dir):
    return R.histogram_percentiles(_histogram(spark, sf_dir), "bin", "n", [1.0, 50.0, 99.5])


@Q.add("select case when l_discount >= 0 and l_discount < 0.03 then 'low' when l_discount >= 0.03 and l_discount < 0.06 then 'middle' else 'high' end as bin, count(*) as count from lineitem group by 1")
def density_bins(spark, sf_dir):
    bins = [("low", 0.0, 0.03), ("middle", 0.03, 0.06), ("high", 0.06, None)]
    return table(spark, sf_dir, "lineitem").groupBy(T.half_open(F.col("l_discount"), bins[:2] + [("high", 0.06, float("inf"))]).alias("bin")).agg(F.count(F.lit(1)).alias("count"))


_POLYGON = "[[0, 0], [p_size * 10.0, 0], [p_size * 10.0 + 5, p_retailprice / 10], [5, p_retailprice / 10 + 3]]"


@Q.add("""with p as (select p_partkey, p_size * 10.0 as a, p_retailprice / 10 as b from part)
select p_partkey, round(abs(a * 0 - a * 0 + a * b - (a + 5) * 0 + (a + 5) * (b + 3) - 5 * b + 5 * 0 - 0 * (b + 3)) / 2, 6)::double as area, 0.0::double as x0, 0.0::double as y0, (a + 5)::double as x1, (b + 3)::double as y1, case when a + 5 < b + 3 then 'portrait' when a + 5 > b + 3 then 'landscape' else 'square' end as orientation from p""")
def polygon_metrics(spark, sf_dir):
    a, b = F.col("p_size") * F.lit(10.0), F.col("p_retailprice") / 10
    points = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(a, F.lit(0.0)), F.array(a + 5, b), F.array(F.lit(5.0), b + 3))
    rows = table(spark, sf_dir, "part").select("p_partkey", G.polygon_from_arrays(points).alias("p")).withColumn("box", G.bbox(F.col("p")))
    return rows.select("p_partkey", F.round(G.area(F.col("p")), 6).alias("area"), "box.*", G.orientation(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")).alias("orientation"))


@Q.add(" union all ".join(f"select '{c}' as metric, count({c}) as n, avg({c}) as mean, stddev_pop({c}) as std, min({c}) as min, " + ", ".join(f"quantile_cont({c}, {q}) as p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + f", max({c}) as max from lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def continuous_stats(spark, sf_dir):
    out = C.continuous_stats(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out


@Q.add(" union all ".join(f"select '{c}' as field, {c} as label, count(*) as count, count(*) / sum(count(*)) over ()::double as ratio from orders group by {c}" for c in ("o_orderstatus", "o_orderpriority")))
def categorical_stats(spark, sf_dir):
    return C.categorical_stats(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


_EDGES = [900.0, 1100.0, 1300.0, 1500.0, 1900.0]


@Q.add(" union all ".join(f"select {i}::int as place, {a}::double as low, {b}::double as high, count(*) filter (where p_retailprice >= {a} and p_retailprice <{'=' if i == 3 else ''} {b}) as count from part" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))))
def overview_histograms(spark, sf_dir):
    return C.overview_histogram(table(spark, sf_dir, "part"), "p_retailprice", _EDGES)


@Q.add("""with q as (select quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) as q from customer) select c_custkey, case when q[3] > q[1] then (c_acctbal - q[2]) / (q[3] - q[1]) else 0 end as c_acctbal from customer, q""")
def robust_scale(spark, sf_dir):
    return R.robust_scale(table(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"])


@Q.add("""with a as (select p_size, p_retailprice, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2.0 as ra, rank() over (order by p_retailprice) + (count(*) over (partition by p_retailprice) - 1) / 2.0 as rb from part)
select round(corr(ra, rb), 9) as spearman, count(*) as n from a""")
def spearman_confounds(spark, sf_dir):
    return R.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.round("spearman", 9).alias("spearman"), "n")


@Q.add("select distinct lang as value, 'documents' as origin from documents union select distinct role, 'conversations' from conversations")
def set_union_distinct(spark, sf_dir):
    a = texts(spark, sf_dir, "documents").select(F.col("lang").alias("value"), F.lit("documents").alias("origin"))
    return a.unionByName(texts(spark, sf_dir, "conversations").select(F.col("role").alias("value"), F.lit("conversations").alias("origin"))).distinct()


@Q.add("select c_nationkey as nationkey from customer intersect select s_nationkey from supplier where s_acctbal > 5000")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@Q.add("select p_partkey as partkey from part except select l_partkey from lineitem where l_returnflag = 'R'")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey")).subtract(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_partkey"))


@Q.add(r"""select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, len(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'))::bigint - 1 as depth, len(regexp_extract_all(html, '<a[ >]'))::bigint as links, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') as title from pages""")
def html_pages(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host"), (F.size(F.split(path, "/")) - 1).cast("long").alias("depth"), F.regexp_count("html", F.lit("<a[ >]")).cast("long").alias("links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@Q.add("select event_type, k as key, count(*) as count from (select event_type, unnest(json_keys(props)) as k from events) group by all")
def json_unnest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("count"))


@Q.add("""select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice) as sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) as sum_disc_price, avg(l_quantity) as avg_qty, count(*) as count_order
from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum("l_extendedprice").alias("sum_base_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc_price"), F.avg("l_quantity").alias("avg_qty"), F.count(F.lit(1)).alias("count_order"))


_LBD = "select l_orderkey, 'L' || case when l_quantity <= 20 then 1 when l_quantity <= 40 then 2 else 3 end || 'B' || case when l_linenumber <= 1 then 1 when l_linenumber <= 2 then 2 else 3 end || 'D' || case when l_tax * 100 <= 1 then 1 when l_tax * 100 <= 2 then 2 else 3 end as position from lineitem"


@Q.add(f"select position, count(*) as count from ({_LBD}) group by position")
def lbd_positions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(C.lbd(F.col("l_quantity"), F.col("l_linenumber"), F.col("l_tax") * 100).alias("position")).agg(F.count(F.lit(1)).alias("count"))
