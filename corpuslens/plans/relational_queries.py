"""Listings, alignments, aggregates, windows and samples over the star schema, labels, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import aggregates as A
from corpuslens.operators import evaluation as V
from corpuslens.operators import joins as J
from corpuslens.operators import selection as S
from corpuslens.operators import windows as W
from corpuslens.plans.registry import query, table

# listings


@query("""
select o_orderkey as feedback_id, c_name, n_name, o_orderstatus as thumb from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 50 offset 50""")
def jon01_feedback_list(spark, d):
    feedback = table(spark, d, "orders").selectExpr("o_orderkey as feedback_id", "o_custkey as message_id", "o_orderdate as created_at", "o_orderstatus as thumb")
    messages = table(spark, d, "customer").selectExpr("c_custkey as message_id", "c_name", "c_nationkey as user_id")
    users = table(spark, d, "nation").selectExpr("n_nationkey as user_id", "n_name")
    return J.feedback_list(feedback, messages, users, "F", 2, 50).select("feedback_id", "c_name", "n_name", "thumb")


@query("select o_orderkey, o_custkey from orders join customer on o_custkey = c_custkey where c_nationkey = 3")
def jon02_owned(spark, d):
    owners = table(spark, d, "customer").selectExpr("c_custkey as o_custkey", "c_nationkey")
    return J.owned(table(spark, d, "orders").select("o_orderkey", "o_custkey"), owners, "o_custkey", F.col("c_nationkey") == 3)


@query("""
with t as (select l_orderkey, l_linenumber, case when l_linenumber = 2 then 'x' || l_orderkey else l_suppkey::varchar end as target_id from lineitem)
select l_orderkey, l_linenumber, target_id, left(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g'), 140) as preview from t left join documents on try_cast(target_id as bigint) = doc_id""")
def jon03_enrich_targets(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case when l_linenumber = 2 then concat('x', cast(l_orderkey as string)) else cast(l_suppkey as string) end as target_id")
    m = table(spark, d, "documents").selectExpr("doc_id as message_id", "text")
    return J.enrich_targets(t, m, T.preview(F.col("text"))).select("l_orderkey", "l_linenumber", "target_id", "preview")


@query("""
select o_orderkey as message_id, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' order by l_linenumber, l_partkey), '') as citations
from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 25 group by o_orderkey""")
def jon04_messages_with_citations(spark, d):
    m = table(spark, d, "orders").selectExpr("o_orderkey as message_id")
    c = table(spark, d, "lineitem").where("l_quantity > 25").selectExpr("l_orderkey as message_id", "l_linenumber as rank", "l_partkey as chunk_id")
    joined = J.messages_with_citations(m, c)
    return joined.select("message_id", F.array_join(F.transform("citations", lambda x: F.concat_ws(":", x["rank"].cast("string"), x["chunk_id"].cast("string"))), ",").alias("citations"))


@query("""
select l_suppkey as item_id, min((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) as first, arg_min(l_partkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) filter (where l_returnflag = 'A') as A,
  arg_min(l_partkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) filter (where l_returnflag = 'N') as N, arg_min(l_partkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) filter (where l_returnflag = 'R') as R from lineitem group by l_suppkey""")
def jon05_align_systems(spark, d):
    a = table(spark, d, "lineitem").selectExpr("l_suppkey as item_id", "l_returnflag as system", "l_partkey as answer", "(l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as ord")
    return J.align_systems(a, ["A", "N", "R"])


@query("""
with a as (select l_orderkey as item_id, max(l_quantity) as m, max(case when l_returnflag = 'R' then l_discount end) as k from lineitem where l_linenumber <= 3 group by 1),
b as (select l_orderkey as item_id, max(l_quantity) as m, max(case when l_returnflag = 'R' then l_discount end) as k from lineitem where l_linenumber > 2 group by 1)
select a.item_id, s as strategy, case s when 'max' then greatest(a.m, b.m) when 'mean' then coalesce((a.m + b.m) / 2, a.m, b.m) else coalesce(b.m, a.m) end as m,
  case s when 'max' then greatest(a.k, b.k) when 'mean' then coalesce((a.k + b.k) / 2, a.k, b.k) else coalesce(b.k, a.k) end as k
from a left join b on a.item_id = b.item_id, (values ('max'), ('mean'), ('second_unless_none')) v(s)""")
def jon06_merge_runs(spark, d):
    items = table(spark, d, "lineitem")
    n = items.count()
    rows = lambda cond: items.where(cond).selectExpr("l_orderkey as item_id", "l_quantity", "case when l_returnflag = 'R' then l_discount end as discount")
    run = lambda cond: J.dealt_runs(rows(cond), "item_id", n).groupBy("item_id").agg(F.max("l_quantity").alias("m"), F.max("discount").alias("k"))
    a, b = run("l_linenumber <= 3"), run("l_linenumber > 2")
    out = None
    for s in ("max", "mean", "second_unless_none"):
        one = J.merge_runs(a, b, ["m", "k"], s).withColumn("strategy", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
with c as (select source as k, arg_min(text, doc_id) as content from documents where text <> '' group by source)
select page_id, 'src' || (page_id % 25) as chunk_id, content from pages left join c on k = 'src' || (page_id % 25)""")
def jon07_hydrate(spark, d):
    c = table(spark, d, "pages").selectExpr("page_id", "concat('src', cast(page_id % 25 as string)) as chunk_id")
    chunks = table(spark, d, "documents").selectExpr("source as chunk_id", "text as content", "doc_id as ord")
    return J.hydrate(c, chunks).select("page_id", "chunk_id", "content")


@query("""
with g as (select item_id, 'src' || (item_id % 20) as spec_id, case when item_id % 4 = 0 then null else (item_id % 9)::varchar end as section from benchmark
           union all select item_id, 'src' || (item_id % 20), (item_id % 9) || '.1' from benchmark),
c as (select doc_id, source as spec_id, (doc_id % 7) || '.' || (doc_id % 3) as clause, text as t from documents where text is not null),
u as (select item_id, min(doc_id) as doc_id, t from g join c using (spec_id) where coalesce(section, '') = '' or clause = section or starts_with(clause, section || '.') group by item_id, t),
r as (select item_id, nullif(left(string_agg(t, chr(10) || chr(10) order by doc_id), 3000), '') as sec from u group by item_id),
i as (select item_id, case when item_id % 5 = 0 then [] else list_transform(string_split(text, '.'), lambda x: trim(x)) end as facts from benchmark),
s as (select i.item_id, sec, case when len(facts) > 0 then array_to_string(facts, '. ') || '.' end as sent, case when len(facts) > 0 then array_to_string(list_transform(facts, lambda f: 'The answer should mention ' || f), '. ') || '.' end as wrap
      from i left join r on i.item_id = r.item_id)
select item_id, 'sentences' as variant, coalesce(sent, '(no ground truth)') as reference from s
union all select item_id, 'section', coalesce(sec, sent, '(no ground truth)') from s
union all select item_id, 'hybrid', coalesce(wrap || chr(10) || chr(10) || 'Reference section content:' || chr(10) || sec, sec, wrap, '(no ground truth)') from s""")
def jon08_reference_text(spark, d):
    """Three variants; some items have no facts, some no section that is there."""
    b = table(spark, d, "benchmark")
    section = "case when item_id % 4 = 0 then null else cast(item_id % 9 as string) end as section"
    asked = b.selectExpr("item_id", "concat('src', cast(item_id % 20 as string)) as spec_id", section)
    g = asked.unionByName(b.selectExpr("item_id", "concat('src', cast(item_id % 20 as string)) as spec_id", "concat(cast(item_id % 9 as string), '.1') as section"))
    items = b.selectExpr("item_id", "case when item_id % 5 = 0 then cast(array() as array<string>) else split(text, '[.]') end as facts")
    c = table(spark, d, "documents").selectExpr("doc_id as chunk_id", "doc_id as document_order", "source as spec_id", "concat(cast(doc_id % 7 as string), '.', cast(doc_id % 3 as string)) as clause", "text as content")
    out = None
    for variant in ("sentences", "section", "hybrid"):
        one = J.reference_text(g, c, items, variant).select("item_id", F.lit(variant).alias("variant"), "reference")
        out = one if out is None else out.unionByName(one)
    return out


_PRICES = [("view", "m0", 1e-3, 2e-3, 0.0, True), ("click", "m1", 5e-3, 0.0, 0.01, True), ("error", "m0", 1.0, 1.0, 1.0, False)]
_PRICES_SQL = "(values " + ", ".join(f"('{k}', '{m}', {i}::double, {o}::double, {c}::double, {str(b).lower()})" for k, m, i, o, c, b in _PRICES) + ") p(kind, model, i, o, c, billed)"


def _calls(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "user_id", "ts", "event_type as kind", "concat('m', cast(user_id % 2 as string)) as model", "cast(floor(value) as bigint) - 2 as input_tokens", "event_id % 7 as output_tokens")


def _prices(spark):
    return spark.createDataFrame(_PRICES, "kind string, model string, input_price double, output_price double, call_price double, billed boolean")


@query(f"select event_id, event_type as kind, coalesce(i, 0) as input_price, coalesce(o, 0) as output_price, coalesce(c, 0) as call_price from events left join {_PRICES_SQL} on kind = event_type and model = 'm' || (user_id % 2) and billed")
def jon09_attach_price(spark, d):
    return J.attach_price(_calls(spark, d), _prices(spark)).select("event_id", "kind", "input_price", "output_price", "call_price")


@query("""
with r as (select doc_id, lower(text) as h, string_split(text, ' ') as w from documents),
f as (select doc_id, h, [lower(w[1]), 'zzz', lower(w[2])] as o, [lower(w[1]), lower(w[3]), 'the'] as n from r where len(w) >= 3)
select doc_id as item_id, len(list_filter(o, lambda x: contains(h, x))) / 3 as old_coverage, len(list_filter(n, lambda x: contains(h, x))) / 3 as new_coverage,
  array_to_string(list_filter(list_distinct(list_sort(n)), lambda x: not list_contains(o, x)), ',') as added, array_to_string(list_filter(list_distinct(list_sort(o)), lambda x: not list_contains(n, x)), ',') as removed from f""".replace("list_distinct(list_sort(n))", "list_sort(list_distinct(n))").replace("list_distinct(list_sort(o))", "list_sort(list_distinct(o))"))
def jon10_rescore(spark, d):
    w = F.split("text", " ")
    t = table(spark, d, "documents").where(F.size(w) >= 3).select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer"), w.alias("w"))
    fact = lambda *c: F.transform(F.array(*c), F.lower).alias("facts")
    old = t.select("item_id", fact(F.col("w")[0], F.lit("zzz"), F.col("w")[1]))
    new = t.select("item_id", fact(F.col("w")[0], F.col("w")[2], F.lit("the")))
    join = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return J.rescore(t.select("item_id", "answer"), old, new).select("item_id", "old_coverage", "new_coverage", join("added"), join("removed"))


@query("""
select doc_id, 'in' as which from documents where doc_id in (select doc_id from labels) union all select doc_id, 'missing' from documents where doc_id not in (select doc_id from labels where quality is not null and toxic = 0)""")
def jon11_semi_and_anti(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    scored = labels.select("doc_id", F.when(F.col("toxic") == 0, F.col("quality")).alias("score"))
    return S.keep_in(docs, labels, "doc_id").withColumn("which", F.lit("in")).unionByName(S.keep_missing(docs, scored, "doc_id", "score").withColumn("which", F.lit("missing")))


@query("""
with a as (select l_suppkey as item_id, l_returnflag as system, min(l_partkey) as answer from lineitem group by all)
select a.item_id, a.system as system_a, b.system as system_b, a.answer as answer_a, b.answer as answer_b from a join a b on a.item_id = b.item_id and a.system < b.system""")
def jon12_system_pairs(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("item_id"), F.col("l_returnflag").alias("system")).agg(F.min("l_partkey").alias("answer"))
    return J.system_pairs(a)


@query("""
with w as (select regexp_split_to_array(text, '[ \\n]+') as w from benchmark),
t as (select distinct array_to_string(list_slice(w, i, i + k), ' ') as term from w, unnest(range(1, len(w) + 1)) x(i), unnest(range(0, 4)) y(k) where i + k <= len(w)),
p as (select term, lower(trim(term)) as low from t), d as (select source, lower(text) as low from documents where text is not null)
select term, count(distinct source) as n_documents from p left join d on p.low <> '' and contains(d.low, p.low) group by term""")
def jon13_term_document_counts(spark, d):
    """Every phrase of one to four words of the benchmark, with whatever stands in and at its words."""
    words = table(spark, d, "benchmark").select(F.split("text", "[ \\n]+").alias("w"))
    begun = words.select("w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    runs = begun.select("w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(4), F.size("w") - F.col("i") + 1))).alias("k"))
    terms = runs.select(F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("term"))
    return J.term_document_counts(terms, table(spark, d, "documents").selectExpr("source as spec_id", "text as content"))


# aggregates


@query("select source as spec_id, 'r' || (doc_id % 3) as release, lang as series, source as title, count(*) as n_chunks from documents where lang = 'en' group by all")
def agg01_list_docs(spark, d):
    t = table(spark, d, "documents").selectExpr("source as spec_id", "concat('r', cast(doc_id % 3 as string)) as release", "lang as series", "source as title")
    return A.list_docs(t, series="en")


@query("select source as spec_id, (doc_id % 7) || '.' || (doc_id % 3) as path, lang as section_title, count(*) as n_chunks, min(doc_id) as first_order from documents group by all")
def agg02_doc_sections(spark, d):
    t = table(spark, d, "documents").selectExpr("source as spec_id", "array(cast(doc_id % 7 as string), cast(doc_id % 3 as string)) as section_path", "lang as section_title", "doc_id as document_order")
    return A.doc_sections(t).select("spec_id", F.array_join("section_path", ".").alias("path"), "section_title", "n_chunks", "first_order")


@query("""
select 'rows' as kind, 'documents' as name, count(*)::double as value from documents union all select 'rows', 'pages', count(*)::double from pages
union all select 'tasks', o_orderstatus, count(*)::double from orders group by o_orderstatus
union all select 'last_7_days', 'tokens', coalesce(sum(event_id % 10), 0)::double from events where ts::date between date '2024-01-13' and date '2024-01-20'
union all select 'last_7_days', 'cost', coalesce(round(sum(value), 6), 0) from events where ts::date between date '2024-01-13' and date '2024-01-20'""")
def agg03_platform_stats(spark, d):
    usage = table(spark, d, "events").selectExpr("to_date(ts) as day", "event_id % 10 as tokens", "value as cost")
    tasks = table(spark, d, "orders").selectExpr("o_orderstatus as status")
    return A.platform_stats({n: table(spark, d, n) for n in ("documents", "pages")}, tasks, usage, F.lit("2024-01-20").cast("date"))


@query("select count(*) filter (where quality = 1) as up, count(*) filter (where quality = 0) as down, count(*) as total from labels")
def agg04_feedback_stats(spark, d):
    return A.feedback_stats(table(spark, d, "labels").select(F.when(F.col("quality") == 1, "up").when(F.col("quality") == 0, "down").alias("thumb")))


@query("""
select source as series, grouping(source)::int as overall, count(*) as n_docs, count(distinct lang) as n_distinct, sum(n_chars) as bytes, sum(doc_id % 5) as images from documents group by rollup (source)""")
def agg09_source_audit(spark, d):
    return A.source_audit(table(spark, d, "documents").selectExpr("source as series", "lang as spec_id", "n_chars as size", "doc_id % 5 as n_images"))


RESULTS = """doc_id as item_id, lang as category, source, case when doc_id % 4 = 0 then null else n_chars / 100.0d end as coverage, case when doc_id % 3 = 0 then null else doc_id % 2 end as recall,
  doc_id % 5 = 0 as banned, case when doc_id % 6 = 0 then 'error' else 'final' end as terminal_event, n_chars as duration_ms"""


def _results(spark, d):
    t = table(spark, d, "documents").selectExpr(
        "doc_id as item_id", "lang as category", "source", "case when doc_id % 4 = 0 then null else n_chars / 100.0d end as coverage", "case when doc_id % 3 = 0 then null else doc_id % 2 end as recall",
        "doc_id % 5 = 0 as banned", "case when doc_id % 6 = 0 then 'error' else 'final' end as terminal_event", "n_chars as duration_ms",
    )
    return t.withColumn("forbidden", F.when(F.col("banned"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))


@query(f"""
with r as (select {RESULTS.replace("100.0d", "100.0::double")} from documents)
select category, source, grouping_id(category, source)::int as level, count(*) as total, round(avg(coverage), 9) as coverage, round(avg(recall), 9) as recall, round(avg(banned::int), 9) as forbidden_rate,
  count(*) filter (where terminal_event = 'final') as n_final, list_sort(list(duration_ms))[(count(*) // 2 + 1)]::double as duration_p50 from r group by grouping sets ((category), (source), ())""")
def agg10_eval_aggregate(spark, d):
    return A.eval_aggregate(_results(spark, d), ["coverage", "recall"], ["category", "source"])


@query("""
with s as (select source, list_sort(list(n_chars)) as x, count(*) as n, 0.9::double * (count(*) + 1) as pos from documents group by source),
k as (select *, least(greatest(floor(pos), 1), n - 1)::bigint as j, round_even(0.95::double * (n - 1), 0)::bigint as r from s)
select source, x[r + 1]::double as nearest, x[n // 2 + 1]::double as upper, (select median(n_chars) from documents d where d.source = k.source) as median, case when n >= 10 then x[j] + (x[j + 1] - x[j]) * (pos - j) end as exclusive from k""")
def agg11_percentiles(spark, d):
    wanted = {"nearest": (0.95, "nearest"), "upper": (0.5, "upper"), "median": (0.5, "median"), "exclusive": (0.9, "exclusive")}
    return A.percentiles(table(spark, d, "documents"), ["source"], "n_chars", wanted)


@query("""
with r as (select l_returnflag as config, l_suppkey as item_id, l_discount as metric, l_quantity as ms from lineitem),
i as (select config, item_id, max(metric) as b, avg(metric) as m from r group by all), j as (select config, round(avg(b), 9) as mean_best, round(avg(m), 9) as mean_mean from i group by config),
t as (select config, list_sort(list(ms)) as x, count(*) as n from r group by config),
f as (select config, mean_best, mean_mean, x[round_even(0.5::double * (n - 1), 0)::bigint + 1]::double as p50, x[round_even(0.95::double * (n - 1), 0)::bigint + 1]::double as p95 from j join t using (config))
select a.config, a.mean_best, a.mean_mean, a.p50, a.p95, round(a.mean_best - b.mean_best, 9) as gain from f a join f b on b.config = 'A'""")
def agg12_runs_summary(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_returnflag as config", "l_suppkey as item_id", "l_discount as metric", "l_quantity as duration_ms")
    s = A.runs_summary(r, "metric", ["config"])
    base = s.select("config").withColumn("b", F.lit("A")).join(s.select(F.col("config").alias("b"), "mean_best"), "b").drop("b")
    return s.join(A.delta(s.select("config", "mean_best"), base, ["config"], ["mean_best"]).withColumnRenamed("mean_best", "gain"), "config")


@query("""
select l_shipmode_ as model, count(*) as total, count(p) as parsed, count(*) filter (where p = l_suppkey % 3) as n_correct, count(e) as errors, sum(l_linenumber) as tokens,
  round(count(*) filter (where p = l_suppkey % 3) / count(*), 9) as accuracy, round(count(p) / count(*), 9) as parse_rate
from (select l_returnflag || l_linestatus as l_shipmode_, case when l_linenumber = 4 then null else l_partkey % 3 end as p, case when l_linenumber = 5 then 'timeout' end as e, * from lineitem) group by 1""")
def agg13_model_scoreboard(spark, d):
    t = table(spark, d, "lineitem").selectExpr("concat(l_returnflag, l_linestatus) as model", "case when l_linenumber = 4 then null else l_partkey % 3 end as predicted", "l_suppkey % 3 as right_", "case when l_linenumber = 5 then 'timeout' end as error", "l_linenumber as tokens")
    return A.model_scoreboard(t.withColumn("correct", F.coalesce(F.col("predicted") == F.col("right_"), F.lit(False))))


COMPARED = """doc_id as item_id, lang as system, case when doc_id % 5 = 0 then 'negative' else 'definition' end as category, source as series, doc_id % 7 <> 0 as ok,
 case when doc_id % 3 = 0 then null else n_chars / 100000.0d end as coverage, case when doc_id % 4 = 0 then null else doc_id % 2 = 0 end as spec_recall, case doc_id % 3 when 0 then 'VALID_REFUSAL' when 1 then 'INVALID' else null end as verdict"""


@query(f"""
with s as (select {COMPARED.replace("0.0d", "0.0::double")} from documents), t as (select *, category = 'negative' as neg, case when series in ('src0', 'src1') then 'core' else 'tail' end as part from s)
select system, part, count(*) as n, (100 * count(*) filter (where ok)) // count(*) as answer_pct, round(avg(coverage) filter (where not neg), 3) as coverage,
  (100 * count(*) filter (where spec_recall and not neg)) // nullif(count(*) filter (where spec_recall is not null and not neg), 0) as spec_hit_pct,
  (100 * count(*) filter (where neg and verdict = 'VALID_REFUSAL')) // nullif(count(*) filter (where neg and verdict is not null), 0) as refusal_pct from t group by system, part""")
def agg14_comparison_summary(spark, d):
    return A.comparison_summary(table(spark, d, "documents").selectExpr(
        "doc_id as item_id", "lang as system", "case when doc_id % 5 = 0 then 'negative' else 'definition' end as category", "source as series", "doc_id % 7 <> 0 as ok",
        "case when doc_id % 3 = 0 then null else n_chars / 100000.0d end as coverage", "case when doc_id % 4 = 0 then null else doc_id % 2 = 0 end as spec_recall",
        "case doc_id % 3 when 0 then 'VALID_REFUSAL' when 1 then 'INVALID' else null end as verdict"), ["src0", "src1"])


@query("""
with c as (select lang as category, count(*) as actual from documents group by lang), t as (select * from (values ('en', 600), ('de', 10), ('fr', 100000), ('it', 3)) v(category, target))
select coalesce(c.category, t.category) as category, coalesce(actual, 0) as actual, target, coalesce(actual, 0) - target as delta,
  case when target is null then 'UNKNOWN' when abs(coalesce(actual, 0) - target) <= 40 then 'OK' when coalesce(actual, 0) < target then 'GAP' else 'OVER' end as status from c full join t on c.category = t.category""")
def agg15_distribution_check(spark, d):
    targets = spark.createDataFrame([("en", 600), ("de", 10), ("fr", 100000), ("it", 3)], "category string, target int")
    return A.distribution_check(table(spark, d, "documents").selectExpr("lang as category"), targets, 40)


ROUTED = "case when doc_id % 3 = 0 then 'kept' when doc_id % 3 = 1 then 'out_of_scope' else 'rejected_no_spec' end"


@query(f"""
with r as (select {ROUTED} as verdict, lang as category, [source, 'x' || (doc_id % 2)] as specs from documents)
select 'verdict' as kind, verdict as name, count(*) as n from r group by verdict union all select 'category', category, count(*) from r where verdict = 'kept' group by category
union all select 'spec', s, count(*) from (select unnest(specs) as s from r where verdict = 'kept') group by s""")
def agg16_filter_stats(spark, d):
    return A.filter_stats(table(spark, d, "documents").selectExpr(f"{ROUTED} as verdict", "lang as category", "array(source, concat('x', cast(doc_id % 2 as string))) as specs"))


@query("select 'category' as kind, lang as name, count(*) as n from documents group by lang union all select 'spec', source, count(*) from documents group by source")
def agg17_distribution(spark, d):
    return A.distribution(table(spark, d, "documents").selectExpr("lang as category", "array(source) as specs"))


@query("""
with t as (select doc_id % 3 as k, replace(text, ', ', chr(10) || '|--|' || lang) || case when doc_id % 5 = 0 then '$x$' else '' end as c from documents),
s as (select k, length(c) as size, least(len(list_filter(string_split(c, chr(10)), lambda x: regexp_matches(x, '^\\s*\\|.*\\|\\s*$'))), 50) as rows, regexp_matches(c, '\\|\\s*:?-{2,}') as ruled, contains(c, '$') as formula from t)
select k::varchar as chunk_type, count(*) as n, min(size) as min_size, max(size) as max_size, list_sort(list(size))[count(*) // 2 + 1]::double as mid_size, round(avg(ruled::int), 9) as ruled, round(avg(formula::int), 9) as formula,
  list_sort(list(rows))[count(*) // 2 + 1]::double as mid_rows from s group by k""")
def agg18_chunk_quality(spark, d):
    t = table(spark, d, "documents").selectExpr("cast(doc_id % 3 as string) as chunk_type", "concat(replace(text, ', ', concat(chr(10), '|--|', lang)), case when doc_id % 5 = 0 then '$x$' else '' end) as content")
    return A.chunk_quality(t)


@query("""
with t as (select source as spec_id, lang as chunk_type, doc_id % 2 = 0 as s, doc_id % 3 = 0 as l from documents)
select spec_id, chunk_type, grouping_id(spec_id, chunk_type)::int as level, count(*) as n, count(*) filter (where s and not l) as symbols_only, count(*) filter (where l and not s) as lost_only, count(*) filter (where s and l) as both from t group by rollup (spec_id, chunk_type)""")
def agg19_annotation_stats(spark, d):
    t = table(spark, d, "documents").selectExpr("source as spec_id", "lang as chunk_type", "concat(text, case when doc_id % 2 = 0 then ' Formula symbols: a' else '' end, case when doc_id % 3 = 0 then ' [Note: source markdown contains stripped formula(s)]' else '' end) as content")
    return A.annotation_stats(t)


@query("""
with t as (select source, doc_id % 3 = 0 as f, string_split(text, chr(10)) as facts from documents)
select source, count(*) as n, count(*) filter (where f) as with_forbidden, sum(len(facts))::bigint as n_facts, sum(len(list_filter(facts, lambda x: regexp_matches(x, '[.!?]$') or len(string_split_regex(x, '\\s+')) > 12)))::bigint as n_sentences from t group by source""")
def agg20_golden_audit(spark, d):
    t = table(spark, d, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("forbidden"), F.split("text", "\n").alias("facts"))
    return A.golden_audit(t)


@query("select lang as series, count(distinct source) as n_specs, count(distinct (source, doc_id % 7)) as n_clauses from documents group by lang")
def agg21_series_histogram(spark, d):
    return A.series_histogram(table(spark, d, "documents").selectExpr("lang as series", "source as spec_id", "doc_id % 7 as clause"))


# windows


@query("""
with m as (select *, row_number() over (partition by source order by doc_id % 5 desc, doc_id) as n from documents) select doc_id, source from m where n = 1""")
def win01_latest_release(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id as ordinal", "source as spec_id", "concat('Rel-', cast(doc_id % 5 as string)) as release")
    return S.latest_release(t).select(F.col("ordinal").alias("doc_id"), F.col("spec_id").alias("source"))


@query("""
with t as (select source as spec_id, ((doc_id * 7) % 3) || '.' || (doc_id * doc_id % 41) as clause, lang as title, doc_id from documents),
f as (select spec_id, clause, arg_min(title, doc_id) as title from t group by all),
l as (select spec_id, split_part(clause, '.', 1) as parent, split_part(clause, '.', 2)::bigint as leaf, title from f),
n as (select *, lead(leaf) over w as next, lead(title) over w as next_title from l window w as (partition by spec_id, parent order by leaf))
select spec_id, parent, leaf as prev, next, array_to_string(range(leaf + 1, next), ',') as missing, title as prev_title, next_title from n where next - leaf > 1""")
def win02_clause_gaps(spark, d):
    t = table(spark, d, "documents").selectExpr("source as spec_id", "concat(cast((doc_id * 7) % 3 as string), '.', cast(doc_id * doc_id % 41 as string)) as clause", "lang as section_title", "doc_id as document_order")
    return W.clause_gaps(t).withColumn("missing", F.array_join(F.transform("missing", lambda x: x.cast("string")), ","))


@query("""
with c as (select lang as category, count(*) as n from documents group by lang)
select category, least(n, case category when 'en' then 60 when 'de' then 100000 else 10 end)::bigint as n, case when category = 'en' then least(20, (select count(distinct source) from documents where lang = 'en')) end::bigint as n_specs from c""")
def win03_stratified_sample(spark, d):
    targets = spark.createDataFrame([("en", 60), ("de", 100000)], "category string, target int")
    t = table(spark, d, "documents").selectExpr("doc_id as item_id", "lang as category", "source as spec_id")
    got = W.stratified_sample(t, targets, 42)
    return got.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.when(F.col("category") == "en", F.count_distinct("spec_id")).alias("n_specs"))


@query("""
with q as (select * from (values ('src0', 5), ('src1', 9), ('src2', 7)) v(series, quota)), t as (select * from (values ('en', 40), ('de', 9)) v(category, target)),
p as (select doc_id as item_id, lang as category, source as series, target, coalesce(quota, 0) as quota, row_number() over (partition by lang, source order by n_chars desc, doc_id) as tier from documents join t on lang = category left join q on source = series),
o as (select *, row_number() over (partition by category order by tier, quota desc, series) as place from p)
select item_id, category, series, place::int as place from o where place <= target""")
def win04_select_balanced(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id as item_id", "lang as category", "source as series", "cast(n_chars as double) as coverage")
    targets = spark.createDataFrame([("en", 40), ("de", 9)], "category string, target int")
    quota = spark.createDataFrame([("src0", 5), ("src1", 9), ("src2", 7)], "series string, quota int")
    return W.select_balanced(t, targets, quota)


@query("""
with t as (select lang as category, count(*) as target from documents group by lang), s as (select n_name as series, n_regionkey + 1 as quota from nation where n_nationkey < 7),
w as (select sum(quota) as a from s), e as (select category, series, greatest(1, round_even(target * 1.3::double, 0)::int) as n, quota from t, s),
r as (select category, series, n, n * quota / a::double as raw from e, w),
f as (select *, floor(raw)::int as base, round(raw - floor(raw), 9) as rest from r),
p as (select *, n - sum(base) over (partition by category) as left_, row_number() over (partition by category order by rest desc, series) as place from f)
select category, series, base + (place <= left_)::int as slots from p""")
def win05_plan_slots(spark, d):
    targets = table(spark, d, "documents").groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("target"))
    quota = table(spark, d, "nation").where("n_nationkey < 7").selectExpr("n_name as series", "n_regionkey + 1 as quota")
    return W.plan_slots(targets, quota, 1.3)


@query("""
with r as (select source as spec_id, doc_id as chunk_id, list(doc_id) over w as ids, list(text) over w as c from documents window w as (partition by source order by doc_id rows between current row and 2 following))
select spec_id, chunk_id, array_to_string(ids, ',') as ids, array_to_string(c, chr(10) || chr(10)) as content from r where len(ids) >= 2""")
def win06_adjacent_runs(spark, d):
    t = table(spark, d, "documents").selectExpr("source as spec_id", "doc_id as chunk_id", "doc_id as document_order", "text as content")
    return W.adjacent_runs(t).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("""
select doc_id, case lang when 'en' then 'eng' when 'de' then 'ger' else 'qa' end || '-' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as id from (select doc_id, lang, row_number() over (partition by lang order by source, doc_id) as n from documents)""")
def win07_assign_ids(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", "lang as category", "source")
    return W.assign_ids(t, {"en": "eng", "de": "ger"}, [F.col("source"), F.col("doc_id")]).select("doc_id", "id")


@query("""
with s as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as b, count(*) over (partition by conv_id) as n from conversations where trim(coalesce(text, '')) <> '')
select conv_id, turn, case when b <= 3 then 'recent' else 'older' end as part from s where b <= 3 or n > 4""")
def win08_history_window(spark, d):
    return W.history_window(table(spark, d, "conversations"), 4, 3).select("conv_id", "turn", "part")


@query("""
with a as (select conv_id, min(turn) + conv_id % 3 as anchor from conversations group by conv_id), j as (select c.*, anchor from conversations c join a using (conv_id)),
k as (select *, min(case when role = 'user' and turn > anchor then turn end) over (partition by conv_id) as cut from j)
select conv_id, turn, role from k where (cut is null or turn < cut) and (role <> 'assistant' or text <> '')""")
def win09_branch_history(spark, d):
    m = table(spark, d, "conversations")
    anchors = m.groupBy("conv_id").agg((F.min("turn") + F.col("conv_id") % 3).alias("anchor"))
    return W.branch_history(m, anchors).select("conv_id", "turn", "role")


@query("""
with u as (select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as b from conversations where role = 'user'), c as (select conv_id, min(turn) as cut from u where b <= 2 group by conv_id)
select m.conv_id, count(*) filter (where coalesce(turn < cut, true)) as kept, count(*) filter (where coalesce(turn >= cut, false)) as deleted, max(turn) filter (where coalesce(turn < cut, true)) as last_turn from conversations m left join c using (conv_id) group by m.conv_id""")
def win10_rollback_turns(spark, d):
    return W.rollback_turns(table(spark, d, "conversations"), 2)


@query("select conv_id, max(turn) as turn from conversations where role = 'assistant' and conv_id % 3 <> 1 and (conv_id + turn) % 5 = 0 group by conv_id")
def win11_inflight(spark, d):
    m = table(spark, d, "conversations").withColumn("text", F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "").otherwise("said")).withColumn("status", F.when(F.col("conv_id") % 3 == 1, "error").otherwise("ok"))
    return W.inflight(m)


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 100 offset 200")
def win12_page(spark, d):
    return J.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 100)


@query("select l_suppkey, l_orderkey, l_linenumber, rank::int as rank from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 3")
def win13_topk(spark, d):
    t = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.topk(t, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).drop("l_extendedprice")


@query("select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey from orders group by o_custkey")
def win14_first_distinct(spark, d):
    return W.first_distinct(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


# evaluation

GOLDEN = "concat('src', cast(item_id % 20 as string))"


def _golden(spark, d):
    b = table(spark, d, "benchmark")
    section = "cast(item_id % 7 as string)"
    return b.selectExpr("item_id as query_id", f"""case when item_id % 10 = 9 then cast(array() as array<struct<spec_id:string,sections:array<string>>>)
        when item_id % 3 = 0 then array(named_struct('spec_id', {GOLDEN}, 'sections', cast(array() as array<string>)))
        else array(named_struct('spec_id', {GOLDEN}, 'sections', array('9.9', {section})), named_struct('spec_id', 'src3', 'sections', array(concat({section}, '.1')))) end as expected""")


def _judged(spark, d):
    from corpuslens.plans.retrieval_queries import lexical

    places = table(spark, d, "documents").selectExpr("doc_id as chunk_id", "source as spec_id", "array(cast(doc_id % 7 as string), cast(doc_id % 3 as string)) as section_path", "'' as clause", "case when doc_id % 11 = 0 then '<merged: 4.1 / 5.1>' else lang end as section_title")
    return V.judge_hits(lexical(spark, d).join(places, "chunk_id"), _golden(spark, d))


def _judge_sql():
    from corpuslens.plans.retrieval_queries import _LEX

    return f"""with {_LEX}, h as (select query_id, rank, chunk_id, source, (chunk_id % 7)::varchar as a, (chunk_id % 3)::varchar as b, chunk_id % 11 = 0 as merged, (query_id % 7)::varchar as s, query_id % 10 = 9 as none, query_id % 3 = 0 as whole, 'src' || (query_id % 20) as g from lex join documents on doc_id = chunk_id where rank <= 20),
judged as (select query_id, rank, chunk_id, not none and (source = g or (not whole and source = 'src3')) as spec_hit,
  not none and ((source = g and (whole or a = s or (merged and s in ('4', '5')))) or (not whole and source = 'src3' and ((a = s and b = '1') or (merged and s in ('4', '5'))))) as section_hit from h)"""


@query(_judge_sql() + " select query_id, rank, chunk_id, spec_hit, section_hit from judged")
def evl01_judge_hits(spark, d):
    return _judged(spark, d).select("query_id", "rank", "chunk_id", "spec_hit", "section_hit")


_METRICS = """, qs as (select item_id as query_id, item_id % 10 <> 9 as asked, item_id % 4 as category from benchmark), m as (select query_id, min(rank) filter (where spec_hit) as sp, min(rank) filter (where section_hit) as se, count(*) filter (where section_hit and rank <= 5) as n5, count(*) filter (where section_hit and rank <= 10) as n10 from judged group by query_id),
metrics as (select qs.query_id, category, case when asked then coalesce(1.0 / se, 0)::double end as mrr, case when asked then coalesce(1.0 / sp, 0)::double end as mrr_spec,
  case when asked then coalesce(sp <= 5, false)::int::double end as spec_recall_5, case when asked then coalesce(se <= 5, false)::int::double end as section_recall_5, case when asked then coalesce(n5, 0) / 5.0::double end as precision_5,
  case when asked then coalesce(sp <= 10, false)::int::double end as spec_recall_10, case when asked then coalesce(se <= 10, false)::int::double end as section_recall_10, case when asked then coalesce(n10, 0) / 10.0::double end as precision_10 from qs left join m using (query_id))"""


@query(_judge_sql() + _METRICS + " select * exclude (category) from metrics")
def evl02_question_metrics(spark, d):
    return V.question_metrics(_judged(spark, d), _golden(spark, d), (5, 10))


@query(_judge_sql() + _METRICS + " select category, grouping(category)::int as overall, count(*) as n, round(avg(mrr), 9) as mrr, round(avg(section_recall_10), 9) as section_recall_10 from metrics group by rollup (category)")
def evl03_mean_metrics(spark, d):
    m = V.question_metrics(_judged(spark, d), _golden(spark, d), (5, 10)).withColumn("category", F.col("query_id") % 4)
    return V.mean_metrics(m, ["mrr", "section_recall_10"], "category").withColumn("overall", F.col("overall").cast("int"))


@query(_judge_sql() + _METRICS + """, g as (select avg(section_recall_10) filter (where query_id % 2 = 0) - avg(section_recall_10) filter (where query_id % 2 = 1) as r, avg(mrr) filter (where query_id % 2 = 0) - avg(mrr) filter (where query_id % 2 = 1) as m from metrics)
select round(r, 9) as recall_gap, round(m, 9) as mrr_gap, case when abs(r) > 0.03 then if(r > 0, 64, 32) when abs(m) > 0.03 then if(m > 0, 64, 32) else 32 end as winner, abs(r) <= 0.03 and abs(m) <= 0.03 as fallback from g""")
def evl04_decide(spark, d):
    m = V.question_metrics(_judged(spark, d), _golden(spark, d), (5, 10))
    by = m.groupBy(F.when(F.col("query_id") % 2 == 0, 64).otherwise(32).alias("dim")).agg(F.avg("section_recall_10").alias("section_recall_10"), F.avg("mrr").alias("mrr"))
    return V.decide(by, 64, 32)


@query(_judge_sql() + _METRICS + """, v as (select 'mrr' as metric, round(avg(mrr), 9) as value, 0.2::double as baseline from metrics union all select 'section_recall_10', round(avg(section_recall_10), 9), 0.01 from metrics)
select metric, value, baseline, round((value - baseline) * 100, 9) as delta_pp, round((value - baseline) * 100, 9) < -2 as fails from v""")
def evl06_regression(spark, d):
    m = V.mean_metrics(V.question_metrics(_judged(spark, d), _golden(spark, d), (5, 10)), ["mrr", "section_recall_10"])
    rows = m.select(F.expr("stack(2, 'mrr', mrr, 'section_recall_10', section_recall_10) as (metric, value)"))
    return V.regression(rows, spark.createDataFrame([("mrr", 0.2), ("section_recall_10", 0.01)], "metric string, value double"), True)


def _answers(spark, d):
    w = F.split("text", " ")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer"), F.array("source", F.lit("src1")).alias("retrieved"), w.alias("w"), "source", "doc_id")
    g = t.select("item_id", F.array(F.col("w")[0], F.lit(" "), F.lit("zzz"), F.coalesce(F.get("w", F.lit(2)), F.lit(""))).alias("facts"), F.array(F.lit("the"), F.lit(""), F.lit("qqq")).alias("forbidden"),
                 F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.lit("src2"))).otherwise(F.array("source")).alias("specs"))
    return t.select("item_id", "answer", "retrieved"), g


@query("""
with t as (select doc_id, source, lower(text) as h, string_split(text, ' ') as w from documents), f as (select *, [lower(w[1]), ' ', 'zzz', lower(coalesce(w[3], ''))] as facts from t),
n as (select *, len(list_filter(facts, lambda x: trim(x) <> '' and contains(h, x))) as hits, len(list_filter(facts, lambda x: trim(x) <> '')) as told from f)
select doc_id as item_id, round(hits / 4, 9) as coverage, round(hits / told, 9) as coverage_non_blank, contains(h, 'the')::bigint + contains(h, 'qqq')::bigint as n_forbidden,
  case doc_id % 3 when 0 then null when 1 then (source = 'src2')::int::double else 1.0::double end as spec_recall from n""")
def evl07_score_answers(spark, d):
    return V.score_answers(*_answers(spark, d))


@query("""
with t as (select a.doc_id, a.text, b.text as fact from documents a join documents b on b.doc_id = a.doc_id + 1), f as (select doc_id, trim(regexp_replace(lower(fact || ' qqqq'), '[^a-z0-9]+', ' ', 'g')) as fact, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' as h from t),
k as (select doc_id, fact, h, list_filter(string_split(fact, ' '), lambda x: length(x) >= 4) as ws from f)
select doc_id, len(list_filter(ws, lambda x: contains(h, x))) / len(ws) >= 0.6 as present from k""")
def evl08_fact_in_text(spark, d):
    docs = table(spark, d, "documents")
    t = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.concat("text", F.lit(" qqqq")).alias("fact")), "doc_id")
    return t.select("doc_id", V.fact_in_text(F.col("fact"), F.col("text")).alias("present"))


@query("select l_orderkey, l_linenumber, case when l_tax > 0 then round(least(1.0::double, l_discount / l_tax), 3) end as u from lineitem")
def evl09_utilisation(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.utilisation(F.col("l_discount"), F.col("l_tax")).alias("u"))


@query("""
with t as (select l_orderkey, list(case l_returnflag when 'A' then 'hit ' when 'N' then 'PARTIAL' else case when l_linestatus = 'F' then 'odd' else 'MISS' end end order by l_linenumber, case l_returnflag when 'A' then 'hit ' when 'N' then 'PARTIAL' else case when l_linestatus = 'F' then 'odd' else 'MISS' end end) as v from lineitem group by l_orderkey),
f as (select l_orderkey, list_filter(list_transform(list_slice(v, 1, 4), lambda x: case upper(trim(x)) when 'HIT' then 1.0 when 'PARTIAL' then 0.5 when 'MISS' then 0.0 end), lambda x: x is not null) as k from t)
select l_orderkey, case when len(k) > 0 then list_sum(k)::double / 4 end as score from f""")
def evl10_weight_verdicts(spark, d):
    v = F.when(F.col("l_returnflag") == "A", "hit ").when(F.col("l_returnflag") == "N", "PARTIAL").when(F.col("l_linestatus") == "F", "odd").otherwise("MISS")
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", v.alias("v")))), lambda x: x["v"]).alias("v"))
    return t.select("l_orderkey", V.weight_verdicts(F.col("v"), F.array(*[F.lit(str(i)) for i in range(4)])).alias("score"))


VERDICT = "case l_returnflag when 'A' then 'VALID_REFUSAL' when 'N' then 'PARTIAL_REFUSAL' else case when l_linestatus = 'F' then 'INVALID' end end"


@query(f"""
with t as (select l_linenumber, case when l_quantity < 10 then null else {VERDICT} end as v from lineitem),
s as (select l_linenumber, count(*) as n, count(*) filter (where v = 'VALID_REFUSAL') as valid_refusal, count(*) filter (where v = 'PARTIAL_REFUSAL') as partial_refusal, count(*) filter (where v = 'INVALID') as invalid from t group by 1)
select *, n - valid_refusal - partial_refusal - invalid as unjudged, round((valid_refusal + 0.5 * partial_refusal)::double / (valid_refusal + partial_refusal + invalid), 9) as pass_judged, round((valid_refusal + 0.5 * partial_refusal)::double / n, 9) as pass_all from s""")
def evl11_refusal_rate(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_linenumber", f"case when l_quantity < 10 then null else {VERDICT} end as verdict")
    return V.refusal_rate(t, ["l_linenumber"])


@query("""
with t as (select l_orderkey, l_linenumber, case l_partkey % 4 when 0 then 'X' when 1 then 'Y' when 2 then 'TIE' end as a, case l_suppkey % 4 when 0 then 'X' when 1 then 'Y' when 2 then 'TIE' end as b from lineitem),
s as (select *, case a when 'X' then 1 when 'Y' then 0 else 0.5 end + case b when 'X' then 0 when 'Y' then 1 else 0.5 end as f from t)
select l_orderkey, l_linenumber, case when f > 1 then '1' when f < 1 then '2' else 'TIE' end as winner from s""")
def evl12_pair_winner(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "case l_partkey % 4 when 0 then 'X' when 1 then 'Y' when 2 then 'TIE' end as a", "case l_suppkey % 4 when 0 then 'X' when 1 then 'Y' when 2 then 'TIE' end as b")
    return t.select("l_orderkey", "l_linenumber", V.pair_winner(F.col("a"), F.col("b")).alias("winner"))


@query("select doc_id as item_id from documents where doc_id % 6 = 0 or doc_id % 5 = 0 or doc_id % 7 = 1 or (doc_id % 3 <> 0 and doc_id % 2 = 0)")
def evl13_flag_items(spark, d):
    t = _results(spark, d).withColumns({"verdict": F.when(F.col("item_id") % 7 == 1, "INVALID"), "section_recall": F.col("recall")})
    return V.flag_items(t).select("item_id")


@query("""
with s as (select doc_id, source, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') as text from documents),
t as (select doc_id, regexp_extract_all(upper(source) || ' ' || text, '\\b([A-Z][A-Z0-9]{1,9})\\b', 1) as a from s)
select doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i and x not in ('THE', 'OF')), ',') as acronyms from t""")
def evl14_acronyms(spark, d):
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    t = table(spark, d, "documents").select("doc_id", "source", ascii_only.alias("text"))
    return t.select("doc_id", F.array_join(V.acronyms(F.concat(F.upper("source"), F.lit(" "), F.col("text")), ["THE", "OF"]), ",").alias("acronyms"))
