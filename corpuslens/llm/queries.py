"""One query for each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import chat, exact_dedup, filter_audit, hard_negatives, language_id, license_scan, line_dedup, minhash, mixing, sentencepiece_codec, substring_dedup, topk, url_filter

TOP = 5
QUERY_EVERY = 50
ANCHOR_EVERY = 100
MIX_SEED = 17


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.topk(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0), TOP)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), seed=MIX_SEED)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_codec.sentencepiece_codec(_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(url_filter.with_fetch_time(pages), url_filter.dated_list(pages))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
        F.round(F.array_max(F.col("found.dice")), 6).alias("best_dice"),
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    events = chat.events_of_turns(rows.unionByName(extra))
    return chat.read_back(chat.format_chats(events))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and web pages with their markup and address: doc_id or page_id is null, source is the host."""
    nothing = F.lit(None).cast("string")
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "lang", "source", nothing.alias("domain"), nothing.alias("suffix"))
    evidence = language_id.page_evidence(F.col("url"), F.col("html"))
    pages = _table(spark, sf_dir, "pages").select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", evidence["text"].alias("text"), evidence["lang"].alias("lang"), evidence["host"].alias("source"),
        evidence["domain"].alias("domain"), evidence["suffix"].alias("suffix"),
    )
    rows = docs.unionByName(pages)
    keep = ["doc_id", "page_id", "lang", "source"]
    return language_id.identify(rows, language_id.fit(rows, id_cols=keep[:2]), keep, "text", F.col("lang"), F.col("source"), F.col("domain"), F.col("suffix"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has the next label, so that some rows are like their anchors but labelled otherwise."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % ANCHOR_EVERY == 0)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_minhash_near_dedup, op3_exact_topk, op4_exact_dedup, op5_mix_sources,
    op6_sentencepiece, op7_url_filter, op8_license_scan, op9_chat_formatting, op10_language_id,
    op11_hard_negatives, op12_line_dedup, op13_filter_interaction,
)}

_OP1 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') as s from d, unnest(range(1, len(w) - 48)) as t(i)),
least as (select s, min(doc_id) as lo from win group by s),
rep as (select win.doc_id, i from win join least using (s) where win.doc_id > lo),
gone as (select distinct doc_id, i + k as p from rep, unnest(range(0, 50)) as t(k)),
word as (select doc_id, p, w[p] as word from d, unnest(range(1, len(w) + 1)) as t(p)),
kept as (select word.doc_id, string_agg(word, ' ' order by word.p) as text, count(*) as n from word left join gone on word.doc_id = gone.doc_id and word.p = gone.p where gone.p is null group by all)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""

_OP3 = f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {QUERY_EVERY} = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= {TOP}
"""

_OP4 = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

_OP5 = f"""
with s as (select source, sum(length(coalesce(text, '')))::double as chars from documents group by source),
t as (select sum(chars) as chars, sum(case when chars > 0 then 1.0 else 0.0 end)::double as targets from s),
w as (select source, case when s.chars > 0 then (1.0::double * (1.0::double * t.chars)) / (t.targets * s.chars) else 0.0 end as rate from s, t),
r as (select source, rate, greatest(ceil(rate / {mixing.TABLE_RATE}), 1)::bigint as draws, rate / greatest(ceil(rate / {mixing.TABLE_RATE}), 1) as part from w),
p as (select source, k, exp(-part + sum(case when k > 0 then ln(part / k) else 0 end) over (partition by source order by k)) as p
      from r, unnest(range(0, (part + 12 * sqrt(part) + 40)::int + 1)) as x(k) where part > 0),
c as (select source, k, sum(p) over (partition by source order by k) as cum from p),
d as (select documents.*, r.rate, r.draws, row_number() over () as row_id from documents join r on documents.source is not distinct from r.source),
u as (select row_id, source, j, (('0x' || substr(md5('{MIX_SEED}' || case when j = 0 then '' else '.' || j end || ':' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 1)
      / 4503599627370496.0 as u from d, unnest(range(0, draws)) as x(j)),
n as (select row_id, j // {mixing.DRAWS_A_BLOCK} as block, count(*) as n from u join c on u.source is not distinct from c.source and c.cum < u.u group by all),
e as (select row_id, block * {mixing.BLOCK_STEP} + i as copy from n, unnest(range(1, n + 1)) as x(i))
select doc_id, text, lang, source, n_chars, copy::bigint as copy, rate, md5('{MIX_SEED}/place:' || coalesce(doc_id::varchar, '') || ':' || copy) as shuffle_key
from e join d using (row_id)
"""

_HOST = r"nullif(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)), '')"
_PATH = r"regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)', 1)"
_OP7 = f"""
with p as (select page_id, url, timestamp '2024-01-01' + to_seconds((page_id * 7919) % (60 * 86400)) as fetched_at, {_HOST} as host, {_PATH} as path from pages),
q as (select *, string_split(host, '.') as labels, list_filter(string_split(lower(path), '/'), lambda x: x <> '') as parts, string_split(lower(path), '/')[1] as first from p),
named as (
  select distinct * from (
    select 'host' as kind, host as pattern from q
    union all select 'domain', array_to_string(list_slice(labels, greatest(len(labels) - 2, 1), len(labels)), '.') from q
    union all select 'prefix', case when first <> '' then host || '/' || first end from q) where pattern is not null),
h as (select *, ('0x' || substr(md5(kind || ':' || pattern), 1, 6))::bigint as h from named),
chosen as (select *, case when kind = 'prefix' and h % 8 = 1 then 'allow' else 'block' end as action, (h // 8) % 40 as day from h where h % 8 < case when kind = 'prefix' then 2 else 1 end),
log as (select kind, pattern, action, unnest(range(0, h % 3 + 1)) as step, day from chosen),
ent as (select kind, pattern, action, step, timestamp '2024-01-01' + to_days((day + case step when 0 then 0 when 1 then 10 else 15 end)::int) as since from log),
iv as (select *, lead(since) over (partition by kind, pattern order by since) as valid_to from ent),
keys as (
  select page_id, fetched_at, 'host' as kind, host as pattern from q where host is not null
  union all select page_id, fetched_at, 'domain', array_to_string(list_slice(labels, i, len(labels)), '.') from q, unnest(range(1, len(labels) + 1)) t(i) where host is not null
  union all select page_id, fetched_at, 'prefix', host || '/' || array_to_string(list_slice(parts, 1, i), '/') from q, unnest(range(1, len(parts) + 1)) t(i) where host is not null),
m as (select page_id, kind, pattern, action, since, row_number() over (partition by page_id order by length(pattern) desc, kind desc, pattern desc, action desc, since desc) as r
      from keys join iv using (kind, pattern) where step <> 1 and since <= fetched_at and (valid_to is null or fetched_at < valid_to))
select q.page_id, url, fetched_at, host, m.kind as matched_kind, m.pattern as matched_pattern, m.since as listed_at, coalesce(m.action <> 'block', true) as kept
from q left join m on q.page_id = m.page_id and m.r = 1
"""

_TEMPLATE_ROWS = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(license_scan.TEMPLATES))
_WORDS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"
_OP8 = f"""
with tw as (select t, name, {_WORDS.format("body")} as w from (values {_TEMPLATE_ROWS}) x(t, name, body)),
tb as (select t, name, len(w) - 1 as n, w[i] || ' ' || w[i + 1] as b, count(*) as k from tw, unnest(range(1, len(w))) x(i) group by all),
ln as (select doc_id, string_split(text, chr(10)) as lines, text from documents where text is not null),
ps as (select doc_id, i, {_WORDS.format("lines[i]")} as w from ln, unnest(range(1, len(lines) + 1)) x(i)
       union all select doc_id, 0, {_WORDS.format("text")} from ln where len(lines) > 1),
pb as (select doc_id, i, len(w) - 1 as n, w[j] || ' ' || w[j + 1] as b, count(*) as k from ps, unnest(range(1, len(w))) x(j) group by all),
sc as (select doc_id, i, t, name, 2 * sum(least(pb.k, tb.k)) / (any_value(pb.n) + any_value(tb.n)) as dice from pb join tb using (b) group by doc_id, i, t, name),
hit as (select doc_id, count(*) as n_found, array_to_string(list_sort(list_distinct(list(name))), ',') as licenses, round(max(dice), 6) as best_dice from sc where dice >= {license_scan.THRESHOLD} group by doc_id)
select d.doc_id, coalesce(n_found, 0) as n_found, coalesce(licenses, '') as licenses, best_dice from documents d left join hit on d.doc_id = hit.doc_id
"""

_OP9 = r"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_start|>' || '<|im_end|>') + 2)::bigint as formatted_chars
from o group by conv_id
"""

_OP11 = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint)::double[] as v from embeddings
           where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_inner_product(a.v, c.v)::bigint as score
      from v a join v c on a.vec_id <> c.vec_id where a.vec_id % {ANCHOR_EVERY} = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as nth from s where same),
n as (select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, nth order by s.score desc, s.vec_id) as rank
      from p join s on p.anchor_id = s.anchor_id where nth <= 5 and not same and 30 * positive_score <= 100 * s.score and 100 * s.score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""

_OP12 = r"""
with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
x as (select doc_id, i, lines[i] as line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
      from l, unnest(range(1, len(lines) + 1)) as t(i)),
k as (select key, max(doc_id) as last from x where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select x.*, k.last is not null and k.last <> doc_id as gone from x left join k using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""

_OP13 = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) over (partition by text), false)] as fails
      from d left join l on d.doc_id = l.doc_id),
g as (select part, good, toxic, fails, count(*) as n from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s as (select filter_order, step, filter_order[step] as letter, list_transform(range(1, step), lambda j: ascii(filter_order[j]) - 64) as before, ascii(filter_order[step]) - 64 as own from o, unnest(range(1, 6)) as t(step)),
r as (select part, filter_order, step, letter, n, good, toxic, fails[own] as fail, len(list_filter(before, lambda j: fails[j])) > 0 as gone, fails[own] and len(list_filter(fails, lambda b: b)) = 1 as alone from g, s),
t as (select part, filter_order, step, letter, coalesce(sum(n) filter (not fail and not gone), 0) as kept, coalesce(sum(n) filter (fail and not gone), 0) as removed,
        coalesce(sum(n) filter (fail and gone), 0) as redundant, coalesce(sum(n) filter (alone), 0) as unique_fails,
        coalesce(sum(n) filter (fail and not gone and good), 0) as good_lost, coalesce(sum(n) filter (fail and not gone and toxic), 0) as toxic_lost from r group by all)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from t
"""

ORACLE_SQL = {
    "op1_substring_dedup": _OP1, "op3_exact_topk": _OP3, "op4_exact_dedup": _OP4, "op5_mix_sources": _OP5,
    "op7_url_filter": _OP7, "op8_license_scan": _OP8, "op9_chat_formatting": _OP9,
    "op11_hard_negatives": _OP11, "op12_line_dedup": _OP12, "op13_filter_interaction": _OP13,
}
