"""Queries over embeddings, selection and splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import selection as S
from folioscope.operators import splits as P
from folioscope.operators import vectors as V
from folioscope.plans.common import Catalogue, table, texts

Q = Catalogue()

_UNIT = """with raw as (select vec_id, label, embedding::double[] as e from embeddings), u as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as v from raw)"""
_DIM = ", d as (select label, unnest(v) as x, generate_subscripts(v, 1) as i from u), m as (select label, list(a order by i) as mean from (select label, i, avg(x) as a from d group by all) group by label), n as (select label, count(*) as n from u group by label)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


@Q.add(_UNIT + """, p as (select a.vec_id as query, b.vec_id as neighbour, round(list_dot_product(a.v, b.v), 6) as cosine, list_dot_product(a.v, b.v) as c from u a join u b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select query, rank, neighbour, cosine from (select *, row_number() over (partition by query order by round(c, 9) desc, neighbour)::int as rank from p) where rank <= 10""")
def cosine_knn(spark, sf_dir):
    near = V.knn(_vectors(spark, sf_dir), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 10)
    return near.select("query", "rank", "neighbour", F.round("cosine", 6).alias("cosine"))


@Q.add(_UNIT + _DIM + """, c as (select u.label, vec_id, round(list_dot_product(v, mean) / sqrt(list_dot_product(mean, mean)), 9) as c, n from u join m using (label) join n using (label))
select label, max(n) as size, arg_min(vec_id, (-c, vec_id)) as medoid, round(max(c), 6) as cosine from c group by label""")
def medoids(spark, sf_dir):
    out = V.medoids(_vectors(spark, sf_dir), "vec_id", "label", "embedding")
    return out.select("label", "size", "medoid", F.round("cosine", 6).alias("cosine"))


@Q.add(_UNIT + _DIM + """, f as (select u.vec_id, u.label, m.label as other, n, 1 - list_dot_product(v, mean) as d from u, m join n using (label)),
s as (select vec_id, label, max(case when other = label and n > 1 then d * n / (n - 1) end) as a, min(case when other <> label then d end) as b from f group by all)
select label, count(*) as n, round(avg(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end), 6) as silhouette from s group by label""")
def silhouette(spark, sf_dir):
    rows = V.silhouette(_vectors(spark, sf_dir), "vec_id", "label", "embedding")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


@Q.add("""with t as (select label as a, vec_id % 7 as b, count(*)::double as c from embeddings group by all), x as (select sum(c * (c - 1) / 2) as ij, sum(c) as n, sum(c * ln(c)) as h from t),
a as (select sum(c * (c - 1) / 2) as p, sum(c * ln(c)) as h from (select sum(c) as c from t group by a)), b as (select sum(c * (c - 1) / 2) as p, sum(c * ln(c)) as h from (select sum(c) as c from t group by b))
select round((ij - a.p * b.p / (n * (n - 1) / 2)) / ((a.p + b.p) / 2 - a.p * b.p / (n * (n - 1) / 2)), 9) as ari, round((ln(n) - a.h / n + ln(n) - b.h / n - (ln(n) - x.h / n)) / ((ln(n) - a.h / n + ln(n) - b.h / n) / 2), 9) as nmi from x, a, b""")
def ari_nmi(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b"))
    return V.agreement(rows, "a", "b").select(F.round("ari", 9).alias("ari"), F.round("nmi", 9).alias("nmi"))


@Q.add(_UNIT + """, g as (select *, vec_id // 20 as grp from u), p as (select a.grp, a.vec_id as a, b.vec_id as b, round(list_dot_product(a.v, b.v), 9) as c from g a join g b on a.grp = b.grp and a.vec_id < b.vec_id)
select grp, a, b, round(c, 6) as cosine from (select *, row_number() over (partition by grp order by c, a, b) as r from p) where r = 1""")
def diverse_pair(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("grp", F.floor(F.col("vec_id") / 20))
    return V.diverse_pair(rows, "vec_id", "grp", "embedding").select("grp", "a", "b", F.round("cosine", 6).alias("cosine"))


@Q.add(_UNIT + """, c as (select v from u where vec_id % 50 = 0), b as (select vec_id, max(list_dot_product(u.v, c.v)) as best from u, c group by vec_id)
select t::double as "limit", avg((round(best, 9) >= t)::int) as covered from b, (values (0.2), (0.5), (0.8)) v(t) group by t""")
def coverage(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return V.coverage(rows, rows.where("vec_id % 50 = 0"), "embedding", [0.2, 0.5, 0.8])


@Q.add("""with c as (select * from (values (2, 0.90), (3, 0.60), (4, 0.40), (5, 0.34), (6, 0.30), (8, 0.26)) t(k, v)), s as (select k, (k - 2) / 6.0 as x, (v - 0.26) / 0.64 as y from c)
select k, round(abs(y - (1.0 - x)) / sqrt(2.0), 6)::double as distance from s order by round(abs(y - (1 - x)) / sqrt(2), 9) desc, k limit 1""")
def elbow(spark, sf_dir):
    curve = spark.createDataFrame([(2, 0.90), (3, 0.60), (4, 0.40), (5, 0.34), (6, 0.30), (8, 0.26)], "k int, v double")
    return V.elbow(curve, "k", "v").select("k", F.round("distance", 6).alias("distance"))


@Q.add("select vec_id, case when len(embedding) <> 64 then 'dims' else '' end as reasons from embeddings")
def embedding_quality(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return rows.select("vec_id", V.vector_quality(rows, "embedding", 64).alias("reasons"))


@Q.add("select e.label, count(*) as n, avg(x) as mean from (select label, unnest(embedding::double[]) as x from embeddings) e group by e.label")
def feature_means(spark, sf_dir):
    return _vectors(spark, sf_dir).select("label", F.explode("embedding").alias("x")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


@Q.add("""with r as (select source, doc_id, n_chars, lang, row_number() over (partition by source order by n_chars desc, doc_id) as r from documents), s as (select *, row_number() over (partition by source, r = 1 order by lang, n_chars, doc_id) as s from r)
select source, doc_id, case when r = 1 then 1 else 2 end as pick from s where r = 1 or s = 1""")
def hard_pick(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", "lang")
    return S.hard_pick(rows, "source", "doc_id", [F.desc("n_chars")], [F.col("lang"), F.col("n_chars")]).select("source", "doc_id", "pick")


@Q.add("select source, doc_id, rank from (select source, doc_id, row_number() over (partition by source order by sha256('7:' || doc_id), doc_id)::int as rank from documents) where rank <= 4")
def random_pick(spark, sf_dir):
    return S.random_pick(texts(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 4, 7)


@Q.add("""with r as (select vec_id, label, vec_id % 3 <> 0 as only_, (vec_id * 37) % 101 as score from embeddings), b as (select label, arg_min(vec_id, (-score, vec_id)) as best from r where only_ group by label)
select vec_id, case when not only_ then 'not_random' when vec_id = best then 'best_of_cluster' else 'removed' end as reason from r left join b using (label)""")
def global_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") * 37 % 101).alias("score"))
    return S.dedupe_by_cluster(rows, "label", "vec_id", "score", F.col("vec_id") % 3 != 0).select("vec_id", "reason")


@Q.add("""with r as (select vec_id, vec_id // 50 as grp, label, (vec_id * 37) % 101 as score, vec_id % 6 = 0 as chosen from embeddings),
z as (select *, count(*) over (partition by grp, label) as size, bool_or(chosen) over (partition by grp, label) as has from r),
a as (select grp, vec_id as added, label as added_cluster, row_number() over (partition by grp order by size desc, label) as i from (select *, row_number() over (partition by grp, label order by score desc, vec_id) as r from z where not has) where r = 1),
d as (select grp, vec_id as removed, row_number() over (partition by grp order by score, vec_id) as i from (select *, row_number() over (partition by grp, label order by score desc, vec_id) as r from z where chosen) where r > 1)
select grp, i::int as i, removed, added, added_cluster from d join a using (grp, i)""")
def stage2_adjust(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).alias("grp"), "label", (F.col("vec_id") * 37 % 101).alias("score"))
    return S.cover_clusters(rows, "grp", "label", "vec_id", "score", F.col("vec_id") % 6 == 0)


_QUOTAS = """n as (select lang || ':' || coalesce(quality::varchar, '-') as label, count(*) as n from documents left join labels using (doc_id) group by 1), p as (select * from (values ('train', 0.8, 0), ('val', 0.1, 1), ('test', 0.1, 2)) t(split, ratio, place)),
e as (select *, n * ratio as exact, floor(n * ratio) as whole from n, p), l as (select *, n - sum(whole) over (partition by label) as left_, row_number() over (partition by label order by exact - whole desc, place) as r from e),
q as (select label, split, place, n, (whole + case when r <= left_ then 1 else 0 end)::bigint as quota from l)"""
_ASSIGNED = _QUOTAS + """, k as (select doc_id, lang || ':' || coalesce(quality::varchar, '-') as label from documents left join labels using (doc_id)), o as (select *, row_number() over (partition by label order by sha256('42:' || doc_id), doc_id) as r from k),
w as (select label, split, place, sum(quota) over (partition by label order by place) as end_ from q), s as (select doc_id, o.label, arg_min(split, place) as split from o join w on o.label = w.label and o.r <= w.end_ group by all)"""


def _labelled(spark, sf_dir):
    both = texts(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.select("doc_id", F.concat_ws(":", "lang", F.coalesce(F.col("quality").cast("string"), F.lit("-"))).alias("label"))


@Q.add(f"with {_QUOTAS} select label, split, n, quota from q")
def quota_table(spark, sf_dir):
    return P.quotas(_labelled(spark, sf_dir), "label")


@Q.add(f"with {_ASSIGNED} select doc_id, label, split from s")
def split_assignment(spark, sf_dir):
    return P.assign(_labelled(spark, sf_dir), "doc_id", "label", 42)


@Q.add(f"with {_ASSIGNED}, g as (select label, n, split, ratio::double as target from n, p), c as (select label, split, count(*) as c from s group by all) select label, split, coalesce(c, 0) as count, coalesce(c, 0) / n::double as share, target, abs(coalesce(c, 0) / n::double - target) as deviation from g left join c using (label, split)")
def split_deviations(spark, sf_dir):
    return P.deviations(P.assign(_labelled(spark, sf_dir), "doc_id", "label", 42), "label")


@Q.add(f"with {_ASSIGNED}, a as (select label, count(*) / sum(count(*)) over ()::double as p from s group by label), t as (select split, count(*) as t from s group by split), c as (select split, label, count(*) as c from s group by all) select t.split, sum(abs(coalesce(c, 0) / t::double - p)) / 2 as tv from a cross join t left join c on c.split = t.split and c.label = a.label group by t.split")
def split_tv(spark, sf_dir):
    return P.total_variation(P.assign(_labelled(spark, sf_dir), "doc_id", "label", 42), "label")


_WORDS = r"tk as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) as token from documents)"


def _words(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1))).alias("token"))


@Q.add(f"with {_ASSIGNED}, {_WORDS}, b as (select token, bool_or(split = 'train') as t, bool_or(split <> 'train') as h from tk join s using (doc_id) group by token) select count(*) filter (where t) as train_types, count(*) filter (where h) as held_types, count(*) filter (where h and not t) as held_only from b")
def vocabulary_audit(spark, sf_dir):
    assigned = P.assign(_labelled(spark, sf_dir), "doc_id", "label", 42)
    return P.vocabulary_audit(_words(spark, sf_dir).join(assigned.select("doc_id", "split"), "doc_id"))


@Q.add(f"with {_ASSIGNED}, {_WORDS}, b as (select token, bool_or(split = 'train') as t, min(doc_id) as f from tk join s using (doc_id) group by token), m as (select distinct f as doc_id from b where not t) select s.doc_id, label, case when m.doc_id is not null then 'train' else split end as split, m.doc_id is not null as moved from s left join m using (doc_id)")
def split_coverage_moves(spark, sf_dir):
    assigned = P.assign(_labelled(spark, sf_dir), "doc_id", "label", 42)
    return P.move_for_coverage(assigned, "doc_id", _words(spark, sf_dir))


@Q.add()
def group_kmeans(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("grp", F.floor(F.col("vec_id") / 100))
    return V.spherical_kmeans(rows, "grp", "vec_id", "embedding", 4)


@Q.add()
def group_pca(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("grp", F.floor(F.col("vec_id") / 100))
    return V.principal_components(rows, "grp", "vec_id", "embedding", 8)
