"""Queries of formula structure: fixed formulas with known answers, and formulas made from tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions import latex as L
from folioscope.functions import text as T
from folioscope.operators import corpus as C
from folioscope.plans.common import Catalogue, table, texts

Q = Catalogue()

#: (formula, nodes, depth, level of nesting, nested cost, single count, status), worked out by hand.
GOLDEN = [
    (r"x + 1", 0, 0, 0, 0, 0, "ok"), (r"\frac { a } { b }", 1, 1, 1, 0, 1, "ok"), (r"x ^ { 2 }", 1, 1, 1, 0, 1, "ok"), (r"\sqrt { \frac { 1 } { 2 } }", 2, 2, 2, 2, 0, "ok"),
    (r"x ^ { y ^ { z } }", 2, 2, 2, 3, 0, "ok"), (r"\sum _ { i } ^ { n } x", 3, 2, 1, 2, 1, "ok"), (r"\frac { a }", 1, 1, 1, 0, 1, "incomplete_substructure"), (r"{ a", 0, 0, 0, 0, 0, "unbalanced_braces"),
    (r"a }", 0, 0, 0, 0, 0, "incomplete_substructure"), (r"x ^", 1, 1, 1, 0, 1, "incomplete_substructure"), (r"\sqrt [ 3 ] { x }", 1, 1, 1, 0, 1, "ok"),
    (r"\begin { cases } x \\ y \end { cases }", 1, 1, 1, 0, 1, "ok"), (r"\begin { cases } x y \end { cases }", 0, 0, 0, 0, 0, "ok"), (r"\vec { a } \textcircled { 1 }", 2, 1, 0, 0, 2, "ok"),
]


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@Q.add("with g as (select * from (values " + ", ".join(f"({i}, {_literal(f)}, {n}, {d}, {v}, {t}, {c}, {_literal(s)})" for i, (f, n, d, v, t, c, s) in enumerate(GOLDEN)) + f") t(place, formula, nodes, depth, nested_level, ntc, cbc, status)) select formula, nodes, depth, nested_level, ntc, cbc, status, count(*) as lines, sum(l_quantity) as quantity from lineitem join g on l_partkey % {len(GOLDEN)} = place group by all")
def latex_golden(spark, sf_dir):
    """Every line's formula, one of those worked out by hand, is parsed; lines of one formula agree in all numbers."""
    formula = F.element_at(F.array(*[F.lit(g[0]) for g in GOLDEN]), (F.col("l_partkey") % len(GOLDEN) + 1).cast("int"))
    rows = texts(spark, sf_dir, "lineitem").select("l_quantity", formula.alias("formula")).withColumn("s", L.structure(T.tokens(F.col("formula"))))
    return rows.groupBy("formula", *[f"s.{c}" for c in ("nodes", "depth", "nested_level", "ntc", "cbc", "status")]).agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


def made_formulas(spark, sf_dir):
    """Formulas written from lineitem's numbers: a chain of as many nested roots and scripts as the line number."""
    rows = texts(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    n = F.col("l_linenumber")
    return rows.withColumn("formula", F.concat(F.repeat(F.lit(r"\sqrt { "), n), F.lit("x"), F.repeat(F.lit(" }"), n), F.when(F.col("l_quantity") > 25, r" + \frac { a } { b }").otherwise("")))


_MADE = "select l_orderkey, l_linenumber as n, l_quantity > 25 as f from lineitem"


@Q.add(f"""select n as line, count(*) as formulas, sum(n + f::int)::bigint as nodes, max(n)::int as depth, sum(case when n = 1 then 0 else 2 + ceil(log2(n)) end)::bigint as ntc, sum(case when n = 1 then 1 else 0 end + f::int)::bigint as cbc from ({_MADE}) group by n""")
def latex_structures(spark, sf_dir):
    s = made_formulas(spark, sf_dir).withColumn("s", L.structure(T.tokens(F.col("formula"))))
    return s.groupBy(F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("formulas"), F.sum("s.nodes").alias("nodes"), F.max("s.depth").alias("depth"), F.sum("s.ntc").alias("ntc"), F.sum("s.cbc").alias("cbc"))


@Q.add(f"select depth::int as depth, count(*) as formulas, count(*) / sum(count(*)) over ()::double as share from (select n as depth from ({_MADE})) group by depth")
def ast_depth_histogram(spark, sf_dir):
    s = made_formulas(spark, sf_dir).select(L.structure(T.tokens(F.col("formula")))["depth"].alias("depth"))
    return s.groupBy("depth").agg(F.count(F.lit(1)).alias("formulas")).withColumn("share", F.col("formulas") / F.sum("formulas").over(W.partitionBy()))


@Q.add(f"""with m as (select l_orderkey as page, n, f from ({_MADE})), l as (select page, n, (n + f::int) as nodes, 1 + f::int as types, 3 * n + 1 + case when f then 8 else 0 end as len from m)
select 'L' || case when len <= 20 then 1 when len <= 40 then 2 else 3 end || 'B' || case when types <= 1 then 1 when types <= 2 then 2 else 3 end || 'D' || case when n <= 1 then 1 when n <= 2 then 2 else 3 end as position, count(*) as count from l group by 1""")
def latex_lbd(spark, sf_dir):
    rows = made_formulas(spark, sf_dir).withColumn("tokens", T.tokens(F.col("formula")))
    s = rows.select(F.size("tokens").alias("len"), L.structure(F.col("tokens")).alias("s"))
    return s.groupBy(C.lbd(F.col("len"), F.size("s.types"), F.col("s.depth")).alias("position")).agg(F.count(F.lit(1)).alias("count"))


@Q.add(f"""with m as (select l_orderkey as page, n, f from ({_MADE})) select page, count(*) as formulas, sum(n + f::int)::bigint as nodes, max(n)::int as max_depth, max((f)::int) as has_frac, 1 as has_sqrt, {', '.join(f'max((n = {d})::int) as has_depth_{d}' for d in range(1, 6))} from m group by page""")
def page_features(spark, sf_dir):
    s = made_formulas(spark, sf_dir).select(F.col("l_orderkey").alias("page"), L.structure(T.tokens(F.col("formula"))).alias("s"))
    has = lambda c: F.max(c.cast("int"))
    return s.groupBy("page").agg(F.count(F.lit(1)).alias("formulas"), F.sum("s.nodes").alias("nodes"), F.max("s.depth").alias("max_depth"), has(F.array_contains("s.types", "frac")).alias("has_frac"), has(F.array_contains("s.types", "sqrt")).alias("has_sqrt"), *[has(F.col("s.depth") == d).alias(f"has_depth_{d}") for d in range(1, 6)])


@Q.add()
def document_structures(spark, sf_dir):
    """Parse status and structure of every document's lines taken as formulas."""
    rows = C.tokenized(texts(spark, sf_dir, "conversations"))
    other = F.exists("tokens", lambda t: T.category(t) == "other / unknown tokens")
    return rows.select("conv_id", "turn", L.structure(F.col("tokens"), ~other).alias("s")).groupBy("s.status").agg(F.count(F.lit(1)).alias("count"), F.max("s.depth").alias("depth"))


@Q.add()
def token_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", F.explode(L.token_spans(F.col("text"), T.tokens(F.col("text")))).alias("x")).select("item_id", "x.token", "x.start", "x.end")
