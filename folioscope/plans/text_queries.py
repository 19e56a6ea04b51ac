"""Queries over the text tables and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import corpus as C
from folioscope.plans.common import Catalogue, table, texts

Q = Catalogue()


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_RULE = T.TOKEN_RULE.replace("'", "''")
_CJK = r"^[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]$"


def _corpus_sql(source: str, columns: str, text: str = "text") -> str:
    """Common tables: corpus with tokens, and token counts."""
    return rf"""
with base as (select {columns}, regexp_replace({text}, '^\s+|\s+$', '', 'g') as norm from {source}),
corpus as (select *, regexp_extract_all(norm, '{_RULE}') as tokens from base where norm <> ''),
counts as (select token, count(*) as c from (select unnest(tokens) as token from corpus) group by token)"""


_DOCS = _corpus_sql("documents", "doc_id, lang, source")
_TURNS = _corpus_sql("conversations", "conv_id, turn, role")
_CATEGORY = rf"""case when regexp_matches(token, '{_CJK}') then 'CJK tokens' when regexp_matches(token, '^\p{{Nd}}$') then 'digit tokens' when regexp_matches(token, '^[A-Za-z]$') then 'english tokens'
when token in ({_quoted(T.LAYOUT)}) then 'layout / alignment tokens' when token in ({_quoted(T.PUNCTUATION)}) then 'punctuation tokens' when token in ({_quoted(T.GREEK)}) then 'greek tokens'
when token in ({_quoted(T.GROUPING)}) then 'grouping tokens' when token in ({_quoted(T.STRUCTURAL)}) then 'structural tokens' when token in ({_quoted(T.RELATIONS)}) then 'operator tokens'
when regexp_matches(token, '^\\[A-Za-z]+$') or token = '√' then 'special symbol tokens' else 'other / unknown tokens' end"""


def _domain_sql(name: str, values) -> str:
    return f"{name} as (select * from (values {', '.join(f'({i}, {_quoted([v])})' for i, v in enumerate(values))}) t(place, name))"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokenized(texts(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokenized(texts(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


@Q.add(_DOCS + """
select row_number() over (order by c desc, token) as rank, token, c as count, c / sum(c) over () as share,
 sum(c) over (order by c desc, token rows unbounded preceding) / sum(c) over () as cumulative_share from counts""")
def token_longtail(spark, sf_dir):
    return C.longtail(C.token_counts(documents(spark, sf_dir)))


@Q.add(_DOCS + """,
r as (select c, row_number() over (order by c, token) as i, row_number() over (order by c desc, token) as r from counts)
select count(*) as vocabulary, sum(c)::bigint as tokens, (sum(2 * i * c) - (count(*) + 1) * sum(c)) / (count(*) * sum(c))::double as gini,
 """ + ", ".join(f"coalesce(sum(c) filter (where r <= {k}), 0) / sum(c)::double as top_{k}" for k in (10, 50, 100, 500)) + ", " + ", ".join(f"count(*) filter (where c <= {t}) / count(*)::double as rare_types_{t}" for t in (1, 5, 10)) + " from r")
def token_gini_topk(spark, sf_dir):
    return C.gini_and_coverage(C.token_counts(documents(spark, sf_dir)))


@Q.add(_TURNS + """,
held as (select distinct conv_id, turn, token from (select conv_id, turn, unnest(tokens) as token from corpus)),
least as (select conv_id, turn, min(c) as least from held join counts using (token) group by all), n as (select count(*) as n from corpus)
select t::int as threshold, count(*) filter (where least <= t) as expressions, count(*) filter (where least <= t) / max(n.n)::double as ratio from least, n, (values (1), (5), (10)) v(t) group by t""")
def rare_expression_ratio(spark, sf_dir):
    corpus = turns(spark, sf_dir).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return C.rare_expression_ratio(corpus, C.token_counts(corpus), "key")


@Q.add(_DOCS + f""", {_domain_sql('d', T.CATEGORIES)},
by_ as (select {_CATEGORY} as category, sum(c) as n from counts group by 1)
select place::int as place, d.name as category, coalesce(n, 0)::bigint as count, coalesce(n, 0) / sum(coalesce(n, 0)) over ()::double as share from d left join by_ on by_.category = d.name""")
def token_taxonomy(spark, sf_dir):
    return C.taxonomy(C.token_counts(documents(spark, sf_dir)))


_LENGTHS = "count(*) as n, avg(len(tokens)) as mean, stddev_pop(len(tokens)) as std, stddev_pop(len(tokens)) / avg(len(tokens)) as cv, " + ", ".join(f"quantile_cont(len(tokens), {p}) as {n}" for p, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))) + ", max(len(tokens))::bigint as max"


@Q.add(_corpus_sql("benchmark", "item_id") + f" select {_LENGTHS} from corpus")
def length_distribution(spark, sf_dir):
    return C.length_distribution(C.tokenized(table(spark, sf_dir, "benchmark")), F.size("tokens"))


@Q.add(_TURNS + f""", {_domain_sql('d', [b[0] for b in T.LENGTH_BINS])},
by_ as (select case when len(tokens) <= 10 then 0 when len(tokens) <= 20 then 1 when len(tokens) <= 40 then 2 when len(tokens) <= 80 then 3 else 4 end as place, count(*) as n from corpus group by 1)
select d.place::int as place, d.name as bin, coalesce(n, 0) as count, coalesce(n, 0) / sum(coalesce(n, 0)) over ()::double as share from d left join by_ using (place)""")
def length_bins(spark, sf_dir):
    return C.bin_counts(turns(spark, sf_dir), F.size("tokens"))


_MADE = r"(values ('解 : ( 1 ) 依 题'), ('依题'), ('\frac { a } { b }'), ('x = 解'), ('\delete x'), ('a---b')) v(text)"


@Q.add(_corpus_sql(f"(select text from conversations union all select * from {_MADE})", "1 as one") + rf"""
, {_domain_sql('d', ['latex', 'text', 'mixed'])},
kinds as (select case when len(list_filter(tokens, lambda t: regexp_matches(t, '{_CJK}'))) = len(tokens) then 'text' when len(list_filter(tokens, lambda t: regexp_matches(t, '{_CJK}'))) > 0 then 'mixed' else 'latex' end as kind from corpus),
by_ as (select kind, count(*) as n from kinds group by 1)
select d.name as kind, coalesce(n, 0) as count, coalesce(n, 0) / sum(coalesce(n, 0)) over ()::double as share from d left join by_ on kind = name""")
def content_kind(spark, sf_dir):
    made = spark.sql(f"select * from {_MADE.replace(chr(92), chr(92) * 2)}")
    return C.content_kinds(C.tokenized(texts(spark, sf_dir, "conversations").select("text").unionByName(made)))


def _confusable_sql() -> str:
    parts = []
    for name, groups in T.CONFUSABLE.items():
        members = [t for s in groups for t in s]
        two = " or ".join(f"len(list_intersect(list_distinct(tokens), [{_quoted(s)}])) >= 2" for s in groups)
        parts.append(f"select '{name}' as confusable_group, (select coalesce(sum(c), 0)::bigint from counts where token in ({_quoted(members)})) as tokens, (select coalesce(sum(c) filter (where token in ({_quoted(members)})), 0) / sum(c)::double from counts) as token_ratio, count(*) filter (where list_has_any(tokens, [{_quoted(members)}])) as expressions, count(*) filter (where {two}) as together from corpus")
    return _DOCS + " " + " union all ".join(parts)


@Q.add(_confusable_sql())
def confusable_groups(spark, sf_dir):
    corpus = documents(spark, sf_dir)
    return C.confusable_groups(corpus, C.token_counts(corpus))


_SIZES = _DOCS + ", s as (select norm, count(*) as c, min(doc_id) as first_id, count(distinct source) as sources from corpus group by norm) "


@Q.add(_SIZES + """select sum(c)::bigint as expressions, count(*) as unique_expressions, (sum(c) - count(*))::bigint as redundant, (sum(c) - count(*)) / sum(c)::double as duplicate_rate,
 coalesce(sum(c) filter (where c > 1), 0)::bigint as grouped, coalesce(sum(c) filter (where c > 1), 0) / sum(c)::double as grouped_ratio, count(*) filter (where c > 1) as duplicate_groups, max(c) as largest from s""")
def duplicate_stats(spark, sf_dir):
    return C.duplicate_stats(documents(spark, sf_dir))


@Q.add(_SIZES + 'select sha256(norm) as "group", c as size, first_id, sources from s where c > 1')
def duplicate_groups(spark, sf_dir):
    return C.duplicate_groups(documents(spark, sf_dir), "doc_id", "source")


@Q.add(_SIZES + "select c as size, count(*) as groups from s group by c")
def duplicate_sizes(spark, sf_dir):
    return C.duplicate_sizes(documents(spark, sf_dir))


@Q.add(_SIZES + 'select doc_id, first_id as "group", c as group_size from corpus join s using (norm)')
def duplicate_index(spark, sf_dir):
    return C.duplicate_index(documents(spark, sf_dir), "doc_id")


_HAS = {k: f"list_has_any(tokens, [{_quoted(v)}])" for k, v in T.STRUCTURE_TRIGGERS.items()}


@Q.add(_DOCS + f""", w as (select lang, count(distinct token) as vocabulary from (select lang, unnest(tokens) as token from corpus) group by lang)
select lang, count(*) as expressions, sum(len(tokens))::bigint as tokens, count(distinct norm) as unique_strings, max(vocabulary) as vocabulary, (count(*) - count(distinct norm)) / count(*)::double as duplicate_rate,
 avg(len(tokens)) as mean, quantile_cont(len(tokens), 0.5) as p50, quantile_cont(len(tokens), 0.9) as p90, max(len(tokens))::bigint as max,
 {', '.join(f'avg({_HAS[k]}::int) as {k}_ratio' for k in ('frac', 'sup', 'sub', 'sqrt'))} from corpus join w using (lang) group by lang""")
def corpus_profile(spark, sf_dir):
    return C.corpus_profile(documents(spark, sf_dir), "lang")


@Q.add(_DOCS + "select count(*) as expressions, sum(len(tokens))::bigint as tokens, count(distinct norm) as unique_strings, (select count(*) from counts) as vocabulary, (count(*) - count(distinct norm)) / count(*)::double as duplicate_rate from corpus")
def corpus_scale(spark, sf_dir):
    return C.scale(documents(spark, sf_dir))


@Q.add(_DOCS + " " + " union all ".join(f"select '{k}' as structure, count(*) filter (where {_HAS[k]}) as expressions, avg({_HAS[k]}::int) as ratio, sum(len(list_filter(tokens, lambda t: t in ({_quoted(v)}))))::bigint as occurrences from corpus" for k, v in T.STRUCTURE_TRIGGERS.items()))
def structure_distribution(spark, sf_dir):
    return C.structure_distribution(documents(spark, sf_dir))


_PRESENT = "list_filter([" + ", ".join(f"case when {h} then '{k}' end" for k, h in _HAS.items()) + "], lambda x: x is not null)"


@Q.add(_DOCS + f", p as (select array_to_string(list_sort({_PRESENT}), '+') as pattern from corpus) select pattern, count(*) as count, count(*) / sum(count(*)) over ()::double as share from p group by pattern")
def structure_patterns(spark, sf_dir):
    return C.structure_patterns(documents(spark, sf_dir))


@Q.add(_DOCS + f""", p as (select {_PRESENT} as p from corpus), {_domain_sql('d', T.STRUCTURE_TRIGGERS)},
pairs as (select a, unnest(p) as b from (select p, unnest(p) as a from p)), n as (select a, b, count(*) as n from pairs group by all)
select x.name as a, y.name as b, coalesce(n, 0) as count from d x cross join d y left join n on n.a = x.name and n.b = y.name""")
def structure_patterns_grid(spark, sf_dir):
    return C.structure_grid(documents(spark, sf_dir))


@Q.add(_DOCS + f", p as (select len({_PRESENT}) as n from corpus) select {', '.join(f'avg((n >= {k})::int) as at_least_{k}' for k in (1, 2, 3, 4))}, avg(n) as mean, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.9) as p90, max(n)::bigint as max from p")
def structure_complexity(spark, sf_dir):
    return C.structure_complexity(documents(spark, sf_dir))


@Q.add("select conv_id, string_agg(text, chr(10) order by turn) as page_text, count(*) as lines from conversations group by conv_id")
def page_assembly(spark, sf_dir):
    """Lines of a page in order; a page's lines are few, so they meet in one row."""
    rows = texts(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("page_text"), F.size("l").cast("long").alias("lines"))


@Q.add(_TURNS + "select conv_id as page, token, count(*) as count from (select conv_id, unnest(tokens) as token from corpus) group by all")
def page_token_counts(spark, sf_dir):
    return C.token_counts(turns(spark, sf_dir).withColumnRenamed("conv_id", "page"), "page")


@Q.add(_TURNS + """, rare as (select token from counts where c <= 8),
sums as (select conv_id as page, count(*) as expressions, sum(len(tokens))::bigint as tokens, max(len(tokens))::bigint as longest from corpus group by 1),
words as (select conv_id as page, unnest(tokens) as token from corpus),
dist as (select page, count(distinct token) as distinct_tokens, count(*) filter (where token in (select token from rare)) as rare_tokens from words group by 1)
select p.page, coalesce(expressions, 0) as expressions, coalesce(tokens, 0) as tokens, coalesce(longest, 0) as longest, coalesce(distinct_tokens, 0) as distinct_tokens, coalesce(rare_tokens, 0) as rare_tokens
from (select distinct conv_id as page from conversations) p left join sums using (page) left join dist using (page)""")
def page_metrics(spark, sf_dir):
    corpus = turns(spark, sf_dir).withColumnRenamed("conv_id", "page")
    counts = C.token_counts(corpus)
    return C.page_metrics(texts(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page")), corpus, counts.where("count <= 8"))


@Q.add(_TURNS + f""", {_domain_sql('d', T.SIMILAR)}, m as (select * from (values {', '.join(f"('{s}', '{t}')" for s, x in T.SIMILAR.items() for t in x.split())}) t(subgroup, token)),
pc as (select conv_id, token, count(*) as n from (select conv_id, unnest(tokens) as token from corpus) group by all),
held as (select conv_id, subgroup, sum(n) as events from pc join m using (token) group by all having count(*) >= 2), f as (select subgroup, count(*) as pages, sum(events) as events from held group by 1)
select d.name as subgroup, coalesce(pages, 0) as pages, coalesce(events, 0)::bigint as events from d left join f on f.subgroup = d.name""")
def similar_cooccurrence(spark, sf_dir):
    return C.similar_cooccurrence(C.token_counts(turns(spark, sf_dir).withColumnRenamed("conv_id", "page"), "page"))


@Q.add(_TURNS + ", w as (select conv_id || ':' || turn as key, conv_id, unnest(tokens) as token from corpus) select token, count(*) as occurrences, count(distinct key) as expressions, count(distinct conv_id) as pages from w join counts using (token) where c <= 10 group by token")
def rare_detail(spark, sf_dir):
    corpus = turns(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("conv_id").alias("page"), "tokens")
    return C.rare_detail(corpus, C.token_counts(corpus), 10)


@Q.add(_DOCS + ', r as (select token, c, row_number() over (order by c, token) as r, count(*) over () as n from counts) select token, c as count from r where r <= greatest(1, round_even(0.08 * n, 0))')
def rare_tail(spark, sf_dir):
    return C.rare_tail(C.token_counts(documents(spark, sf_dir)))


@Q.add(r"""
select doc_id, """ + ", ".join(
    rf"case when length(regexp_replace(text, '\s', '', 'g')) > 0 then len(regexp_extract_all(text, '{k}')) / length(regexp_replace(text, '\s', '', 'g'))::double else 0 end as {n}"
    for n, k in (("chinese_ratio", r"[\x{4E00}-\x{9FFF}]"), ("latin_ratio", "[A-Za-z]"), ("digit_ratio", "[0-9]"), ("operator_ratio", r"[-+*/=<>^_]"), ("bracket_ratio", r"[\[\](){}]"), ("punct_ratio", "[.,;:!?]"))
) + r", case when length(text) > 0 then len(regexp_extract_all(text, '\s')) / length(text)::double else 0 end as whitespace_ratio from documents")
def char_ratios(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in T.char_ratios(F.col("text")).items()])


_GRAMS = """g as (select doc_id, length(text) as n, case when length(text) >= {s} then [substr(text, i + 1, {s}) for i in range(0, length(text) - {s} + 1, {t})] else [] end as g from documents),
c as (select doc_id, max(c) as top from (select doc_id, x, count(*) as c from (select doc_id, unnest(g) as x from g) group by all) group by 1)"""


@Q.add("with " + _GRAMS.format(s=8, t=8) + " select g.doc_id, case when n < 16 or coalesce(top, 0) <= 1 then 0 else top * 8 / n::double end as repetition_ratio from g left join c using (doc_id)")
def repetition(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", T.repetition_ratio(F.col("text")).cast("double").alias("repetition_ratio"))


@Q.add("with " + _GRAMS.format(s=12, t=6) + " select g.doc_id, case when n < 36 then 0 else coalesce(top, 0) end::bigint as max_repeat from g left join c using (doc_id)")
def ngram_repeat(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", T.max_ngram_repeat(F.col("text")).cast("long").alias("max_repeat"))


@Q.add("with " + _GRAMS.format(s=8, t=8) + ", " + _GRAMS.format(s=12, t=6).replace("g as", "g2 as").replace("c as", "c2 as").replace("from g)", "from g2)") + r"""
select d.doc_id, case when trim(text) = '' then 'empty' when length(text) >= 20000 then 'truncated'
 when (case when g.n < 16 or coalesce(c.top, 0) <= 1 then 0 else c.top * 8 / g.n::double end) >= 0.35 or (case when g.n < 36 then 0 else coalesce(c2.top, 0) end) >= 20 then 'repetitive' else 'valid' end as status
from documents d join g using (doc_id) left join c using (doc_id) left join c2 using (doc_id)""")
def ocr_quality(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", T.quality_status(F.col("text")).alias("status"))


@Q.add("select doc_id, " + ", ".join(rf"len(regexp_extract_all(text, '{p}'))::bigint as {n}" for n, p in (("n_equals", "="), ("n_frac", r"\\frac"), ("n_sqrt", r"\\sqrt"), ("n_sub", "_"), ("n_sup", r"\^"), ("n_vec", r"\\vec"), ("n_angle", r"\\angle"), ("n_env", r"\\begin"))) + " from documents")
def math_counts(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in T.math_counts(F.col("text")).items()])


@Q.add(r"""select doc_id, len(string_split(text, chr(10)))::bigint as lines, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\s*(\$\$|\\\[|\\\()') or (contains(l, '$') and regexp_matches(l, '[=+<>^_\\]'))))::bigint as formula_lines from documents""")
def formula_lines(spark, sf_dir):
    parts = F.split("text", "\n")
    return texts(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("lines"), F.size(F.filter(parts, T.is_formula_line)).cast("long").alias("formula_lines"))


@Q.add(r"""with e as (select conv_id, turn, text, regexp_replace(text, '^\s+|\s+$', '', 'g') as norm from conversations),
t as (select *, regexp_extract_all(norm, '""" + _RULE + r"""') as tokens from e)
select case when text is null or text = '' then 'empty_annotation' when norm = '' then 'empty_after_normalization' when len(tokens) = 0 then 'empty_after_tokenization' else '' end as reason, count(*) as count from t group by 1""")
def exclusion_audit(spark, sf_dir):
    rows = texts(spark, sf_dir, "conversations").withColumn("norm", T.normalized(F.col("text")))
    return rows.groupBy(T.exclusion_reason(F.col("text"), F.col("norm"), T.tokens(F.col("norm"))).alias("reason")).agg(F.count(F.lit(1)).alias("count"))


@Q.add("select doc_id, len(tokens)::bigint as n_tokens, len(list_filter(tokens, lambda t: t = '{'))::bigint - len(list_filter(tokens, lambda t: t = '}'))::bigint as brace_balance, list_has_any(tokens, ['\\delete', '\\ddelete', '\\deleted']) or contains(norm, '\\delete') as has_delete from (" + _DOCS + " select * from corpus)")
def expression_flags(spark, sf_dir):
    t = F.col("tokens")
    return documents(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), T.brace_balance(t).cast("long").alias("brace_balance"), T.has_delete_marker(F.col("norm"), t).alias("has_delete"))
