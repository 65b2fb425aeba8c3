"""Differences and repairs, usage and quota over documents, labels, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.operators import sets as S
from corpuslens.operators import usage as U
from corpuslens.plans.registry import query, table


@query("""
with o as (select distinct source as spec_id, doc_id from documents where doc_id % 10 <> 0), n as (select distinct source as spec_id, doc_id from documents where doc_id % 7 <> 0),
b as (select coalesce(o.spec_id, n.spec_id) as spec_id, o.doc_id is not null as o, n.doc_id is not null as n from o full join n on o.spec_id = n.spec_id and o.doc_id = n.doc_id),
c as (select spec_id, grouping(spec_id)::int as overall, count(*) filter (where o) as old_count, count(*) filter (where n) as new_count, count(*) filter (where o and n) as shared, count(*) filter (where o and not n) as only_old, count(*) filter (where n and not o) as only_new from b group by rollup (spec_id))
select *, round((only_old + only_new) / (shared + only_old + only_new), 6) as drift, round((only_old + only_new) / (shared + only_old + only_new), 6) <= 0.2 as passed from c""")
def set01_id_drift(spark, d):
    t = table(spark, d, "documents").selectExpr("source as spec_id", "doc_id as chunk_id")
    return S.id_drift(t.where("chunk_id % 10 <> 0"), t.where("chunk_id % 7 <> 0"), 0.2)


@query("""
with t as (select source as spec_id, doc_id, 1 + (not (source = 'src1' and doc_id % 5 = 0))::int + (source <> 'src2' or doc_id % 2 = 0)::int as n from documents)
select spec_id, count(*) as n_ids, count(*) filter (where n < 3) as n_missing, count(*) filter (where n < 3) = 0 as consistent from t group by spec_id""")
def set02_sink_consistency(spark, d):
    t = table(spark, d, "documents").selectExpr("source as spec_id", "doc_id as chunk_id")
    return S.sink_consistency({"a": t, "b": t.where("not (spec_id = 'src1' and chunk_id % 5 = 0)"), "c": t.where("spec_id <> 'src2' or chunk_id % 2 = 0")})


@query("select source as spec_id from documents where lang = 'es' intersect select source from documents where doc_id % 3 = 0")
def set03_common_docs(spark, d):
    t = table(spark, d, "documents").withColumnRenamed("source", "spec_id")
    return S.common_docs(t.where("lang = 'es'"), t.where("doc_id % 3 = 0"))


@query("""
with f as (select doc_id % 3 as file_no, doc_id as item_no, source || '-' || (n_chars % 40) as id from documents), m as (select *, row_number() over (partition by id order by file_no, item_no) as n, count(*) over (partition by id) as c from f)
select 'merged' as what, file_no, id from m where c = 1 union all select 'error', file_no, id from m where n > 1 union all select 'forced', file_no, id from m where n = c""")
def set04_merge_golden(spark, d):
    f = table(spark, d, "documents").selectExpr("doc_id % 3 as file_no", "doc_id as item_no", "concat(source, '-', cast(n_chars % 40 as string)) as id")
    merged, errors = S.merge_golden(f)
    forced, _ = S.merge_golden(f, True)
    tag = lambda df, what: df.select(F.lit(what).alias("what"), "file_no", "id")
    return tag(merged, "merged").unionByName(tag(errors, "error")).unionByName(tag(forced, "forced"))


@query("""
with i as (select doc_id as item_no, case when doc_id % 9 = 0 then ' ' else 'id-' || (doc_id % 700) end as id, case doc_id % 5 when 0 then 'negative' when 1 then 'formula' when 2 then 'odd' else 'definition' end as category,
  case when lang = 'es' then null else 'en' end as language, case when lang in ('en', 'es') then 'hand_crafted' else lang end as source, doc_id % 4 as k, doc_id % 6 = 0 as says from documents),
j as (select *, trim(id) = '' as blank, row_number() over (partition by id order by item_no) > 1 as again from i)
select item_no, id, 'error' as severity, 'empty_field' as code, 'id' as field from j where blank union all select item_no, id, 'error', 'empty_field', 'language' from j where language is null
union all select item_no, id, 'error', 'missing_field', 'expected' from j where k = 3 union all select item_no, id, 'error', 'duplicate_id', 'id' from j where not blank and again
union all select item_no, id, 'error', 'invalid_category', 'category' from j where category = 'odd' union all select item_no, id, 'warning', 'unknown_source', 'source' from j where source not in ('hand_crafted')
union all select item_no, id, 'error', 'missing_spec_id', 'expected' from j where k = 1 union all select item_no, id, 'warning', 'spec_id_format', 'expected' from j where k = 1
union all select item_no, id, 'error', 'section_not_scalar', 'expected' from j where k = 1
union all select item_no, id, 'warning', 'non_negative_must_not_found', 'must_say_not_found' from j where category <> 'negative' and says union all select item_no, id, 'warning', 'negative_has_specs', 'expected' from j where category = 'negative' and k in (1, 2)
union all select item_no, id, 'error', 'negative_must_say_not_found', 'must_say_not_found' from j where category = 'negative' and not says""")
def set05_validate_golden(spark, d):
    t = table(spark, d, "documents").selectExpr(
        "doc_id as item_no", "case when doc_id % 9 = 0 then ' ' else concat('id-', cast(doc_id % 700 as string)) end as id", "case doc_id % 5 when 0 then 'negative' when 1 then 'formula' when 2 then 'odd' else 'definition' end as category",
        "case when lang = 'es' then null else 'en' end as language", "'q' as question", "case when lang in ('en', 'es') then 'hand_crafted' else lang end as source",
        """case doc_id % 4 when 0 then cast(array() as array<struct<spec_id:string,sections:array<string>>>) when 1 then array(named_struct('spec_id', '', 'sections', array('1', null)), named_struct('spec_id', 'x.1', 'sections', cast(array() as array<string>)))
           when 2 then array(named_struct('spec_id', '23.501', 'sections', array('1'))) end as expected""",
        "array('f') as facts", "cast(array() as array<string>) as forbidden", "case when doc_id % 6 = 0 then true end as must_say_not_found",
    )
    return S.validate_golden(t)


@query("""
with c as (select source as spec_id, n_chars % 60 as chunk_id, lang as p, text as t, case when doc_id % 2 = 0 then 'table' else 'text' end as kind, text from documents),
r as (select spec_id, count(*) filter (where kind = 'table' and len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '-') and translate(x, '-:| ' || chr(9) || chr(13), '') = '')) = 0) as n from c group by 1)
select spec_id, 'table_without_rule' as code, n from r where n > 0
union all select spec_id, 'repeated_id', count(*) from (select spec_id, chunk_id from c group by all having count(*) > 1) group by 1
union all select spec_id, 'repeated_content', count(*) from (select spec_id, p, t from c group by all having count(*) > 1) group by 1""")
def set06_integrity_audit(spark, d):
    t = table(spark, d, "documents").selectExpr("source as spec_id", "n_chars % 60 as chunk_id", "lang as parent_section_id", "text as content", "case when doc_id % 2 = 0 then 'table' else 'text' end as chunk_type", "lang as section_title")
    return S.integrity_audit(t)


@query("""
select doc_id, case when hit then '' else f end as forbidden, case when hit then f end as original, case when hit then concat_ws(chr(10) || chr(10), n, 'cleared') else n end as notes
from (select doc_id, doc_id % 2 = 0 and source = 'src3' as hit, case when doc_id % 2 = 0 then 'x' else '' end as f, case when doc_id % 3 = 0 then 'old' end as n from documents)""")
def set07_repair_forbidden(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", "source", "case when doc_id % 2 = 0 then array('x') else cast(array() as array<string>) end as forbidden", "case when doc_id % 3 = 0 then 'old' end as notes")
    flat = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, ","))
    return S.repair_forbidden(t, "src3", "cleared").select("doc_id", flat("forbidden").alias("forbidden"), flat("original_forbidden").alias("original"), "notes")


@query("""
select doc_id as item_id, case when k = 4 then 'missing' when k = 0 then 'agree' else 'diff' end as status, k = 1 and c as applied, case when k = 1 and c then 'b:2;z:' else 'a:1;b:2' end as expected
from (select doc_id, doc_id % 5 as k, doc_id % 2 = 0 as c from documents)""")
def set08_attribution_diff(spark, d):
    items = table(spark, d, "documents").selectExpr("doc_id as item_id", "array(named_struct('spec_id', 'a', 'sections', array('1')), named_struct('spec_id', 'b', 'sections', array('2'))) as expected")
    proposals = table(spark, d, "documents").where("doc_id % 5 <> 4").selectExpr("doc_id as item_id", "case doc_id % 5 when 0 then array('b', 'a') when 1 then array('b', 'z') else cast(array() as array<string>) end as proposed", "case when doc_id % 2 = 0 then 'high' else 'low' end as confidence")
    out = S.attribution_diff(items, proposals, ["high"])
    return out.withColumn("expected", F.array_join(F.transform("expected", lambda e: F.concat(e["spec_id"], F.lit(":"), F.array_join(e["sections"], ","))), ";"))


@query("""
with t as (select item_id, string_split_regex(replace(text, chr(10), ' '), ' *[.,;] *') as ts from benchmark), d as (select source, lower(text) as low from documents where text is not null),
p as (select item_id, i, trim(ts[i]) as term from t, unnest(range(1, len(ts) + 1)) x(i) where length(trim(ts[i])) >= 4), q as (select distinct term from p),
c as (select term, count(distinct source) as n from q join d on contains(low, lower(term)) group by term)
select t.item_id, (select arg_min(term, i) from p join c using (term) where n >= 3 and p.item_id = t.item_id) as found, (select count(*) from p join c using (term) where n >= 3 and p.item_id = t.item_id) = 0 as kept from t""")
def set09_symmetry_gate(spark, d):
    """Probes are the clauses of each benchmark text, of many words."""
    from corpuslens.operators.joins import term_document_counts

    items = table(spark, d, "benchmark").select("item_id", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " *[.,;] *").alias("terms"))
    counts = term_document_counts(items.select(F.explode("terms").alias("t")).select(F.trim("t").alias("term")), table(spark, d, "documents").selectExpr("source as spec_id", "text as content"))
    return S.symmetry_gate(items, counts).select("item_id", "found", "kept")


@query("""
with t as (select doc_id, lang, '23.' || (100 + doc_id % 400) as a, doc_id % 4 as k, regexp_replace(text, '[0-9]', 'x', 'g') as text from documents), s as (select *, case k when 0 then [] when 1 then [a] else [a, '38.331'] end as seen from t),
i as (select *, list_filter(seen, lambda x: x in ('38.331', '23.101', '23.105')) as ins from s)
select doc_id as item_id, lang as category, case when lang not in ('en', 'de') then 'rejected_category' when len(seen) = 0 then 'rejected_no_spec' when len(ins) = 0 then 'out_of_scope' else 'kept' end as verdict, array_to_string(ins, ',') as specs,
  regexp_matches(text, '(?i)(^|[^\\pL\\pN_])the($|[^\\pL\\pN_])')::int + regexp_matches(text, '(?i)(^|[^\\pL\\pN_])und($|[^\\pL\\pN_])')::int as topic_score from i""")
def set10_route_items(spark, d):
    a = "concat('23.', cast(100 + doc_id % 400 as string))"
    t = table(spark, d, "documents").selectExpr("doc_id as item_id", "lang as category", "regexp_replace(text, '[0-9]', 'x') as question", f"case when doc_id % 4 > 0 then concat('TS ', {a}) end as explanation", "case when doc_id % 4 > 1 then array('see 38.331', 'x') else array('y') end as options")
    return S.route_items(t, ["en", "de"], ["38.331", "23.101", "23.105"], ["the", "und"]).withColumn("specs", F.array_join("specs", ","))


@query("""
with s as (select round(list_inner_product(list_slice(embedding, 1, 32)::double[], list_transform(list_slice(embedding, 1, 32)::double[], lambda x: x + 0.01)) /
  (sqrt(list_inner_product(list_slice(embedding, 1, 32)::double[], list_slice(embedding, 1, 32)::double[])) * sqrt(list_inner_product(list_transform(list_slice(embedding, 1, 32)::double[], lambda x: x + 0.01), list_transform(list_slice(embedding, 1, 32)::double[], lambda x: x + 0.01)))), 9) as sim from embeddings),
l as (select list_sort(list(sim)) as x, count(*) as n, min(sim) as least, median(sim) as median, round(avg(sim), 9) as mean from s)
select n, least, x[round_even(0.01::double * (n - 1), 0)::bigint + 1] as p01, x[round_even(0.05::double * (n - 1), 0)::bigint + 1] as p05, median, mean, median >= 0.99 and least >= 0.95 as passed from l""")
def set11_vector_equivalence(spark, d):
    t = table(spark, d, "embeddings").selectExpr("vec_id as id", "embedding as vec")
    narrow = t.select("id", F.transform(F.slice("vec", 1, 32), lambda x: x.cast("double") + 0.01).alias("vec"))
    return S.vector_equivalence(t, narrow, 32)


# usage and quota

_P = [("chat", "m0", 1e-3, 2e-3, 0.0, True), ("embedding", "m1", 5e-4, 0.0, 0.0, True), ("rerank", "m0", 1e-4, 0.0, 0.0, True), ("search", "m1", 0.0, 0.0, 0.01, True), ("chat", "m1", 9.0, 9.0, 0.0, False)]
_P_SQL = "(values " + ", ".join(f"('{k}', '{m}', {i}::double, {o}::double, {c}::double, {str(b).lower()})" for k, m, i, o, c, b in _P) + ") p(k, m, i, o, c, billed)"
KIND = "case event_type when 'view' then 'chat' when 'click' then 'embedding' when 'error' then 'rerank' when 'purchase' then 'search' else 'chat' end"
_CALLS = f"""ca as (select event_id, case when user_id % 11 = 0 then null else user_id end as user_id, ts, {KIND} as kind, 'm' || (user_id % 2) as model, floor(value)::bigint - 2 as it, event_id % 7 as ot, event_id % 5 - 1 as nd, event_id % 13 as dt from events),
co as (select ca.*, case kind when 'rerank' then coalesce(i, 0) * (greatest(it, 0) * greatest(nd, 0) + dt) when 'search' then coalesce(c, 0) else coalesce(i, 0) * greatest(it, 0) + coalesce(o, 0) * ot end as cost from ca left join {_P_SQL} on k = kind and m = model and billed)"""
_DAILY = _CALLS + """,
us as (select user_id, ts::date as day, sum(case when kind = 'chat' then it else 0 end)::bigint as llm_input_tokens, sum(case when kind = 'chat' then ot else 0 end)::bigint as llm_output_tokens, sum(case when kind = 'embedding' then it else 0 end)::bigint as embedding_tokens,
  count(*) filter (where kind = 'rerank') as rerank_calls, count(*) filter (where kind = 'search') as web_search_calls, round(sum(cost), 6) as total_cost_usd from co where user_id is not null and (it + ot > 0 or kind in ('rerank', 'search')) group by user_id, ts::date)"""


def _calls(spark, d):
    return table(spark, d, "events").selectExpr(
        "event_id", "case when user_id % 11 = 0 then null else user_id end as user_id", "ts", f"{KIND} as kind", "concat('m', cast(user_id % 2 as string)) as model", "cast(floor(value) as bigint) - 2 as input_tokens",
        "event_id % 7 as output_tokens", "event_id % 5 - 1 as n_docs", "event_id % 13 as doc_tokens",
    )


def _priced(spark, d):
    prices = spark.createDataFrame(_P, "kind string, model string, input_price double, output_price double, call_price double, billed boolean")
    return U.call_cost(_calls(spark, d), prices)


def _usage(spark, d):
    return U.usage_daily(_priced(spark, d))


@query(f"with {_CALLS} select event_id, kind, round(cost, 9) as cost from co")
def agg08_call_cost(spark, d):
    return _priced(spark, d).select("event_id", "kind", F.round("cost", 9).alias("cost"))


@query(f"with {_DAILY} select * replace (day::varchar as day) from us")
def agg05_usage_daily(spark, d):
    return _usage(spark, d).withColumn("day", F.col("day").cast("string"))


@query(f"with {_DAILY} select 'day' as what, coalesce(round(sum(total_cost_usd), 6), 0) as cost from us where day = date '2024-01-09' union all select 'month', coalesce(round(sum(total_cost_usd), 6), 0) from us where day between date '2024-01-01' and date '2024-01-09'")
def agg06_cost_totals(spark, d):
    u, day = _usage(spark, d), F.lit("2024-01-09").cast("date")
    return U.cost_on(u, day).select(F.lit("day").alias("what"), "cost").unionByName(U.cost_mtd(u, day).select(F.lit("month").alias("what"), "cost"))


@query(f"""with {_DAILY}, s as (select coalesce(round(sum(total_cost_usd) filter (where day = date '2024-01-14'), 6), 0) as daily_cost, coalesce(round(sum(total_cost_usd) filter (where day between date '2024-01-01' and date '2024-01-15'), 6), 0) as monthly_cost from us)
select '2024-01-14' as day, daily_cost, monthly_cost, daily_cost > 0.5 as daily_warning, daily_cost > 1e6 as daily_critical, false as monthly_warning from s""")
def agg07_cost_alerts(spark, d):
    return U.cost_alerts(_usage(spark, d), F.lit("2024-01-15").cast("date"), 0.5, 1e6, 0.0).withColumn("day", F.col("day").cast("string"))


@query("""
with t as (select event_id, user_id, event_type as bucket, floor(epoch(ts) / p)::bigint * p as window_start, m, ts from events join (values ('view', 3600, 2), ('click', 86400, 3)) v(b, p, m) on b = event_type)
select event_id, window_start, row_number() over (partition by user_id, bucket, window_start order by ts, event_id)::int as n, row_number() over (partition by user_id, bucket, window_start order by ts, event_id) > m as over_limit from t""")
def str01_rate_windows(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "user_id", "event_type as bucket", "ts")
    return U.rate_windows(e, {"view": (3600, 2), "click": (86400, 3)}).select("event_id", "window_start", "n", F.col("over").alias("over_limit"))


@query("""
with t as (select event_id, user_id, (ts + interval 8 hour)::date as local_day, ts from events where user_id % 5 <> 0), n as (select *, row_number() over (partition by user_id, local_day order by ts, event_id)::int as n from t)
select event_id, local_day::varchar as local_day, n, case n when 1 then 'first' when 4 then 'over' end as edge from n""")
def str02_daily_quota(spark, d):
    e = table(spark, d, "events").selectExpr("event_id", "user_id", "ts", "case when user_id % 5 = 0 then 'admin' else 'user' end as role")
    return U.daily_quota(e, "Asia/Shanghai", 3).select("event_id", F.col("local_day").cast("string").alias("local_day"), "n", "edge")


@query("""
with e as (select user_id as run_id, event_id as seq, case event_type when 'view' then 'token' when 'click' then 'node_end' when 'error' then 'error' when 'purchase' then 'final' else 'end' end as event, event_type, props, event_id % 4 as nd, floor(value * 10)::bigint as ms from events),
f as (select run_id, coalesce('a' || max(seq) filter (where event = 'final'), '') as answer, count(*) filter (where event = 'token') as n_tokens, coalesce(arg_max(event, seq) filter (where event in ('final', 'error')), case when bool_or(event = 'end') then 'end' else 'incomplete' end) as terminal,
  coalesce(string_agg('n' || nd || ':' || ms, ',' order by seq) filter (where event = 'node_end'), '') as nodes from e group by run_id)
select * from f""")
def str05_fold_run_events(spark, d):
    kind = "case event_type when 'view' then 'token' when 'click' then 'node_end' when 'error' then 'error' when 'purchase' then 'final' else 'end' end"
    data = "case event_type when 'click' then to_json(named_struct('node', concat('n', cast(event_id % 4 as string)), 'duration_ms', cast(floor(value * 10) as bigint))) when 'purchase' then to_json(named_struct('answer', concat('a', cast(event_id as string)))) else props end"
    e = table(spark, d, "events").selectExpr("user_id as run_id", "event_id as seq", f"{kind} as event", f"{data} as data")
    return U.fold_run_events(e).select("run_id", "answer", "n_tokens", "terminal", F.array_join(F.transform("node_durations", lambda x: F.concat(x["node"], F.lit(":"), x["ms"].cast("string"))), ",").alias("nodes"))


@query(f"""with {_DAILY}, d as (select day, sum(total_cost_usd) as c, sum(llm_input_tokens) as t from us group by day)
select day::varchar as day, round(sum(c) over (order by day range between interval 7 day preceding and current row), 6) as trailing_cost, (sum(t) over (order by day range between interval 7 day preceding and current row))::bigint as trailing_tokens,
  round(sum(c) over (partition by date_trunc('month', day) order by day), 6) as month_cost from d""")
def str08_trailing_usage(spark, d):
    return U.trailing_usage(_usage(spark, d)).withColumn("day", F.col("day").cast("string"))
