"""Sections, blocks, chunks, glossary, sinks and user functions over documents and pages.

Documents get headings from their own lines: every third line is a heading, its
number made from its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import blocks as B
from corpuslens.operators import chunks as C
from corpuslens.operators import evaluation as V
from corpuslens.operators import glossary as G
from corpuslens.operators import joins as J
from corpuslens.operators import sections as S
from corpuslens.operators import splitting as P
from corpuslens.operators import selection, udf
from corpuslens.plans.registry import query, table
from corpuslens.sources import write as W


def marked_up(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    head = lambda x, i: F.concat(F.lit("## "), (F.floor(i / 6) + 1).cast("string"), F.lit("."), (F.floor(i / 3) + 1).cast("string"), F.lit(" "), x)
    marked = F.transform(lines, lambda x, i: F.when(i % 3 == 0, head(x, i)).otherwise(x))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("spec_id"), F.col("source").alias("release"), F.array_join(marked, "\n").alias("text"))


_LINES = """
l as (select doc_id, source, i - 1 as i, string_split(text, chr(10))[i] as x from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i)),
m as (select *, i % 3 = 0 and x is not null as h, ((i // 6) + 1) || '.' || ((i // 3) + 1) as clause, case when length(trim(x)) <= 1200 then trim(x) else rtrim(left(trim(x), 1199)) || '…' end as title from l)"""


@query(f"""with {_LINES}, s as (select doc_id::varchar as spec_id, (i // 3)::int as section_ord, max(clause) filter (where h) as clause, max(title) filter (where h) as title, coalesce(string_agg(x, chr(10) order by i) filter (where not h), '') as body from m group by doc_id, i // 3)
select spec_id, section_ord, case when title = '' then '' else clause end as clause, case when title = '' then clause else title end as section_title, regexp_replace(body, '^\\s+|\\s+$', '', 'g') as body, length(regexp_replace(body, '^\\s+|\\s+$', '', 'g'))::int as body_chars from s""")
def chk01_sectionize(spark, d):
    return S.sectionize(marked_up(spark, d)).select("spec_id", "section_ord", "clause", "section_title", "body", "body_chars")


_SECT = f"""{_LINES},
s as (select doc_id::varchar as spec_id, source as release, (i // 3)::int as section_ord, max(clause) filter (where h) as c, max(title) filter (where h) as t, regexp_replace(coalesce(string_agg(x, chr(10) order by i) filter (where not h), ''), '^\\s+|\\s+$', '', 'g') as body from m group by all),
se as (select spec_id, section_ord, case when t = '' then '' else c end as clause, case when t = '' then c else t end as title, body, len(regexp_extract_all(body, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]')) as n from s)"""


@query(f"""with recursive {_SECT}, p as (select *, case when clause <> '' and title not like '<%' and n < 60 then regexp_extract(clause, '^(.+)\\.[^.]*$', 1) end as parent from se),
b as (select *, case when parent is not null and parent is not distinct from lag(parent) over (partition by spec_id order by section_ord) then 0 else 1 end as brk from p),
i as (select *, sum(brk) over (partition by spec_id order by section_ord) as island, row_number() over (partition by spec_id order by section_ord) as k from b),
g as (select spec_id, k, island, n as run, 0 as grp from i where k = 1
  union all select i.spec_id, i.k, i.island, case when i.island = g.island and g.run + i.n <= 100 then g.run + i.n else i.n end, case when i.island = g.island and g.run + i.n <= 100 then g.grp else g.grp + 1 end from g join i on i.spec_id = g.spec_id and i.k = g.k + 1),
f as (select i.*, grp from i join g using (spec_id, k))
select spec_id, min(section_ord) as section_ord, case when count(*) > 1 then min(parent) else min(clause) end as clause, case when count(*) > 1 then '<merged: ' || string_agg(clause, ' / ' order by section_ord) || '>' else min(title) end as section_title,
  count(*)::int as n_merged, case when count(*) > 1 then string_agg(rtrim('## ' || clause || ' ' || title) || case when trim(body) <> '' then chr(10) || chr(10) || rtrim(body) else '' end, chr(10) || chr(10) order by section_ord) else min(body) end as body from f group by spec_id, grp""")
def chk02_merge_siblings(spark, d):
    return S.merge_siblings(S.sectionize(marked_up(spark, d)), 60, 100).select("spec_id", "section_ord", "clause", "section_title", "n_merged", "body")


def _sections(spark, d):
    """Sections whose lines become tables, actions, formulae and paragraphs by their place."""
    lines = F.split(F.translate(F.replace("text", F.lit("\n"), F.lit(" ")), "$|", "SI"), r"\. ")

    def made(x, i):
        x = F.concat(F.lit("t "), x)
        table_ = F.concat(F.lit("| a | "), x, F.lit(" |\n|---|---|\n| 1 | 2 |"))
        return F.when(i % 7 == 1, table_).when(i % 7 == 3, F.concat(F.lit("- 1> "), x, F.lit("\n    more"))).when(i % 7 == 5, F.concat(F.lit("$$"), x, F.lit("$$"))).otherwise(x)

    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("spec_id"), F.col("source").alias("release"), F.lit(0).alias("section_ord"), F.array_join(F.transform(lines, made), "\n").alias("body"))


_TOKENS = "len(regexp_extract_all({}, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]'))"
_BLOCKS = """
p as (select doc_id, source, string_split(translate(replace(text, chr(10), ' '), '$|', 'SI'), '. ') as p from documents), l as (select doc_id, source, i - 1 as i, 't ' || p[i] as x from p, unnest(range(1, len(p) + 1)) u(i)),
m as (select *, case i % 7 when 1 then '| a | ' || x || ' |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' when 3 then '- 1> ' || x || chr(10) || '    more' when 5 then '$$' || x || '$$' else x end as t,
  case i % 7 when 1 then 'table' when 3 then 'action_list' when 5 then 'formula_block' else 'paragraph' end as k, (i % 7 <> 0 or i = 0)::int as opens from l),
b as (select *, (sum(opens) over (partition by doc_id order by i))::int as block_ord from m),
blocks as (select doc_id::varchar as spec_id, source as release, 0 as section_ord, block_ord, min(k) as kind, regexp_replace(string_agg(t, chr(10) order by i), '\\s+$', '') as text from b group by all)"""


@query(f"with {_BLOCKS} select * from blocks")
def chk03_blockize(spark, d):
    return B.blockize(_sections(spark, d))


@query(f"""with recursive {_BLOCKS}, n as (select *, {_TOKENS.format("text")} as n, row_number() over (partition by spec_id order by block_ord) as k from blocks),
g as (select spec_id, k, n as total, n >= 40 as shut, 0 as piece_ord from n where k = 1
  union all select n.spec_id, n.k, case when shut or n > 60 or total + n > 60 then n else total + n end, case when shut or n > 60 or total + n > 60 then n >= 40 else total + n >= 40 end, piece_ord + (shut or n > 60 or total + n > 60)::int from g join n on n.spec_id = g.spec_id and n.k = g.k + 1)
select spec_id, piece_ord::int as piece_ord, case when bool_or(kind = 'table') then 'table' when bool_or(kind = 'formula_block') then 'formula' when bool_or(kind = 'action_list') then 'action_list' else 'text' end as chunk_type, trim(string_agg(text, chr(10) || chr(10) order by k)) as text
from g join n using (spec_id, k) group by spec_id, piece_ord""")
def chk04_pack(spark, d):
    blocks = B.blockize(_sections(spark, d)).withColumns({"part": F.lit(0), "whole": F.lit(True)})
    return C.pack(blocks, 40, 60).select("spec_id", "piece_ord", "chunk_type", "text")


TABLE_TEXT = "concat('Table 5.', cast(doc_id as string), '-1: cap', chr(10), '| a | b |', chr(10), '|---|---|', chr(10), '| ', replace(replace(text, '|', '/'), chr(10), concat(' | x |', chr(10), '| ')), ' | x |')"


@query(f"""
with t as (select doc_id, {TABLE_TEXT.replace("as string", "as varchar")} as t from documents), l as (select doc_id, t, string_split(t, chr(10)) as ls from t), r as (select doc_id, t, list_slice(ls, 1, 1) || [''] || list_slice(ls, 2, 3) as head, list_slice(ls, 4, len(ls)) as rows from l),
n as (select *, array_to_string(head, chr(10)) as h, list_sort(list_transform(rows, lambda x: len(regexp_extract_all(x, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]')))) as sizes from r),
k as (select *, greatest(floor(greatest(120 - len(regexp_extract_all(h, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]')), 1) / greatest(sizes[greatest(floor(len(sizes) * 0.95)::int - 1, 0) + 1], 1)), 1)::int as per from n)
select doc_id, p::int as piece, case when len(rows) > per then h || chr(10) || array_to_string(list_slice(rows, p * per + 1, p * per + per), chr(10)) else t end as text from k, unnest(range(0, case when len(rows) > per then ceil(len(rows) / per)::bigint else 1 end)) x(p)""")
def chk05_split_tables(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{TABLE_TEXT} as t")
    return t.select("doc_id", F.posexplode(P.split_table(F.col("t"), 120)).alias("piece", "text"))


@query(r"""
with t as (select doc_id, replace(regexp_replace(text, '[^A-Za-z0-9 .\n]', 'x', 'g'), '. ', chr(10) || 'Name' || doc_id || ' ::= x ') as b from documents), l as (select doc_id, i, string_split(b, chr(10))[i] as x from t, unnest(range(1, len(string_split(b, chr(10))) + 1)) u(i)),
g as (select *, sum((i > 1 and x like 'Name%')::int) over (partition by doc_id order by i) as p from l)
select doc_id, p::int as piece, '-- ASN1START' || chr(10) || string_agg(x, chr(10) order by i) || chr(10) || '-- ASN1STOP' as text from g group by doc_id, p""")
def chk06_split_asn1(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", r"concat('-- ASN1START', chr(10), replace(regexp_replace(text, '[^A-Za-z0-9 .\\n]', 'x'), '. ', concat(chr(10), 'Name', cast(doc_id as string), ' ::= x ')), chr(10), '-- ASN1STOP') as t")
    return t.select("doc_id", F.posexplode(B.split_asn1(F.col("t"))).alias("piece", "text"))


_RUNS = "regexp_extract_all({}, '(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])(?:\\s*(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])){{0,59}}')"


@query(f"""
with p as (select doc_id, string_split(replace(text, chr(10), ' '), '. ') as p from documents), l as (select doc_id, i - 1 as i, '- ' || ((i - 1) % 2 + 1) || '> ' || p[i] as x from p, unnest(range(1, len(p) + 1)) u(i)),
a as (select doc_id, rtrim(string_agg(x, chr(10) order by i)) as t from l group by doc_id), q as (select doc_id, i // 2 as k, rtrim(string_agg(x, chr(10) order by i)) as t from l group by all),
u as (select doc_id, 0 as k, [t] as ts from a where {_TOKENS.format("t")} <= 60 union all select doc_id, k, case when {_TOKENS.format("q.t")} <= 60 then [q.t] else {_RUNS.format("q.t")} end from q join a using (doc_id) where {_TOKENS.format("a.t")} > 60)
select doc_id, (row_number() over (partition by doc_id order by k, j) - 1)::int as part, ts[j] as text from u, unnest(range(1, len(ts) + 1)) x(j)""")
def chk07_split_actions(spark, d):
    """Actions of two levels by turns, so a piece is an action of the first level with the next one under it."""
    lines = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")
    made = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("- "), (i % 2 + 1).cast("string"), F.lit("> "), x)), "\n")
    return table(spark, d, "documents").select("doc_id", made.alias("t")).select("doc_id", F.posexplode(P.split_actions(F.col("t"), 60)).alias("part", "text"))


@query(f"""
with recursive t as (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents), s as (select doc_id, t, {_TOKENS.format("t")} as n, string_split(regexp_replace(t, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)) as ss from t where t <> ''),
e as (select doc_id, n, i, regexp_replace(ss[i], '^\\s+|\\s+$', '', 'g') as x from s, unnest(range(1, len(ss) + 1)) u(i) where n > 60),
h as (select doc_id, i, case when {_TOKENS.format("x")} > 60 then {_RUNS.format("x")} else [x] end as xs from e where x <> ''),
u as (select doc_id, row_number() over (partition by doc_id order by i, j) as k, xs[j] as x, {_TOKENS.format("xs[j]")} as n from h, unnest(range(1, len(xs) + 1)) y(j)),
g as (select doc_id, k, n as total, 0 as piece from u where k = 1 union all select u.doc_id, u.k, case when total + n <= 60 then total + n else n end, piece + (total + n > 60)::int from g join u on u.doc_id = g.doc_id and u.k = g.k + 1)
select doc_id, piece::int as piece, string_agg(x, ' ' order by k) as text from g join u using (doc_id, k) group by doc_id, piece union all select doc_id, 0, t from s where n <= 60""")
def chk08_split_paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(B.split_paragraph(F.col("text"), 60)).alias("piece", "text"))


_PIECES = """p as (select doc_id::varchar as spec_id, i - 1 as piece_ord, regexp_extract_all(text, '(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])(?:\\s*(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])){0,39}')[i] as text, i % 4 <> 0 as plain from documents, unnest(range(1, 1 + len(regexp_extract_all(text, '(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])(?:\\s*(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])){0,39}')))) t(i))"""


def _pieces(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("spec_id"), F.lit("r").alias("release"), F.lit(0).alias("section_ord"), F.posexplode(T.split_tokens(F.col("text"), 40)).alias("piece_ord", "text"))
    return t.withColumn("chunk_type", F.when((F.col("piece_ord") + 1) % 4 != 0, "text").otherwise("table"))


@query(f"""with {_PIECES}, b as (select *, lag(text) over w as before, lag(plain) over w as kind from p window w as (partition by spec_id order by piece_ord)),
t as (select *, case when plain and kind then (regexp_extract_all(before, '(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])(?:\\s*(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])){{0,14}}')) end as runs from b),
u as (select *, case when len(regexp_extract_all(before, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]')) <= 15 then before else trim(case when regexp_matches(runs[len(runs)], '[.!?]\\s+') then regexp_extract(runs[len(runs)], '(?s)^.*?[.!?]\\s+(.*)$', 1) else runs[len(runs)] end) end as tail from t)
select spec_id, piece_ord::int as piece_ord, case when runs is not null and coalesce(tail, '') <> '' and not starts_with(text, tail) then tail || chr(10) || chr(10) || text else text end as text from u""")
def chk09_add_overlap(spark, d):
    return C.add_overlap(_pieces(spark, d), 15).select("spec_id", "piece_ord", "text")


@query(f"""with {_PIECES}, q as (select *, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]')) > 30 and plain as over from p),
r as (select *, case when over then regexp_extract_all(text, '(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])(?:\\s*(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])){{0,19}}') else [text] end as parts from q)
select spec_id, piece_ord::int as piece_ord, (i - 1)::int as sub_ord, over as forced, parts[i] as text from r, unnest(range(1, len(parts) + 1)) t(i) where plain""")
def chk10_enforce_size(spark, d):
    return C.enforce_size(_pieces(spark, d).where("chunk_type = 'text'"), 20).select("spec_id", "piece_ord", "sub_ord", "forced", "text")


@query("""
with b as (select source, doc_id, case when doc_id % 5 = 0 then 'figure' when doc_id % 5 = 1 then 'table' else 'paragraph' end as kind, text from documents),
c as (select *, last_value(case when kind = 'paragraph' and trim(text) <> '' then text end ignore nulls) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding) as context from b)
select source, doc_id, left(context, 600) as context from c where kind = 'figure'""")
def chk11_figure_context(spark, d):
    b = table(spark, d, "documents").selectExpr("source as spec_id", "'r' as release", "0 as section_ord", "doc_id as block_ord", "case when doc_id % 5 = 0 then 'figure' when doc_id % 5 = 1 then 'table' else 'paragraph' end as kind", "text")
    return C.figure_context(b).select(F.col("spec_id").alias("source"), F.col("block_ord").alias("doc_id"), "context")


@query()
def chk12_build_chunks(spark, d):
    return C.build_chunks(marked_up(spark, d)).select("chunk_id", "spec_id", "section_ord", "piece_ord", "sub_ord", "chunk_type", "clause", "section_title", "parent_section_id", "content")


@query("""
with c as (select doc_id, source, lang, text as content, n_chars % 50 as chunk_id from documents), a as (select *, row_number() over (partition by source, lang, content order by doc_id) as a from c), b as (select *, row_number() over (partition by source, chunk_id order by doc_id) as b from a where a = 1)
select doc_id, source from b where b = 1""")
def chk13_dedupe_chunks(spark, d):
    t = table(spark, d, "documents").selectExpr("source as spec_id", "'r' as release", "0 as section_ord", "doc_id as piece_ord", "0 as sub_ord", "concat(lang, text) as content", "n_chars % 50 as chunk_id")
    return C.dedupe_chunks(t).select(F.col("piece_ord").alias("doc_id"), F.col("spec_id").alias("source"))


@query("""
select 'section' as kind, case doc_id % 3 when 0 then 'stop-list' when 1 then 'empty-body' else 'kept' end as name, count(*) as n from documents group by 2 union all select 'chunk', lang, count(*) from documents group by lang""")
def chk14_chunk_stats(spark, d):
    s = table(spark, d, "documents").selectExpr("case doc_id % 3 when 0 then 'stop-list:x' when 1 then 'empty-body:3chars' end as drop_reason")
    return C.chunk_stats(s, table(spark, d, "documents").selectExpr("lang as chunk_type"))


def _terms(spark, d):
    body = "concat('**T', cast(doc_id % 40 as string), ':** ', replace(text, chr(10), concat(chr(10), chr(10), chr(10), chr(10))), chr(10), '**', left(lang, 1), ':** x', chr(10), '| A', cast(doc_id % 30 as string), ' | ', replace(replace(text, chr(10), ' '), '|', '/'), ' |', chr(10), '|---|---|', chr(10), '| Abbreviation | Meaning |')"
    return table(spark, d, "documents").selectExpr("source as spec_id", "doc_id as section_ord", "'3.1' as clause", "case doc_id % 3 when 0 then 'Definitions' when 1 then ' abbreviations' else 'Definitions and abbreviations' end as section_title", f"{body} as body")


_DEFINED = """t as (select source, doc_id, 'T' || (doc_id % 40) as term, left(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10)), '\\n[ \\t]*\\n[ \\t]*(?:\\n[ \\t]*)+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 8000) as definition from documents),
terms as (select source, doc_id, term, definition, 0 as place from t where definition <> ''
  union all select source, doc_id, left(lang, 1), 'x' || chr(10) || '| A' || (doc_id % 30) || ' | ' || replace(replace(text, chr(10), ' '), '|', '/') || ' |' || chr(10) || '|---|---|' || chr(10) || '| Abbreviation | Meaning |', 1 from documents),
named as (select source, doc_id, term, left(definition, 8000) as definition, place from terms), short as (select source, doc_id, 'A' || (doc_id % 30) as term, left(trim(replace(replace(text, chr(10), ' '), '|', '/')), 8000) as definition, 0 as place from documents where trim(replace(text, chr(10), ' ')) <> '')"""


@query(f"with {_DEFINED} select source as spec_id, doc_id as section_ord, term, definition from named")
def chk15_definitions(spark, d):
    return G.extract_definitions(_terms(spark, d)).select("spec_id", "section_ord", "term", "definition")


@query("""
select source as spec_id, doc_id as section_ord, 'A' || (doc_id % 30) as term, left(trim(replace(replace(text, chr(10), ' '), '|', '/')), 8000) as definition from documents""")
def chk16_abbreviations(spark, d):
    return G.extract_abbreviations(_terms(spark, d)).select("spec_id", "section_ord", "term", "definition")


@query(f"""with {_DEFINED}, e as (select *, 0 as k from named where doc_id % 3 <> 1 union all select *, 1 from short where doc_id % 3 <> 0),
f as (select *, row_number() over (partition by source, term order by doc_id, k, place) as n from e)
select source as spec_id, term, lower(term) as normalized_term, definition, '3.1' as path from f where n = 1""")
def chk17_build_glossary(spark, d):
    return G.build_glossary(_terms(spark, d)).select("spec_id", "term", "normalized_term", "definition", F.array_join("section_path", "/").alias("path"))


@query("""
select doc_id as ref_id, case when n_chars % 7 = 0 then null when n_chars % 3 = 0 then 'cached' else 'made ' || length(sha256(text)) end as label from documents""")
def chk18_enrich_by_hash(spark, d):
    docs = table(spark, d, "documents")
    refs = docs.select(F.col("doc_id").alias("ref_id"), F.sha2("text", 256).alias("sha256"), F.lit("p").alias("path"), "n_chars")
    cache = refs.where("n_chars % 3 = 0 and n_chars % 7 <> 0").select("sha256", F.struct(F.lit("cached").alias("label")).alias("told")).distinct()
    dead = refs.where("n_chars % 7 = 0").select("sha256")
    return udf.enrich_by_hash(refs.drop("n_chars"), cache, dead, lambda sha, path: {"label": f"made {len(sha)}"}, "label string").select("ref_id", "told.label")


# search inside documents


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as n from documents where contains(lower(lang), 'e') or contains(lower((doc_id % 7)::varchar), 'e')) where n <= 50")
def prj29_search_doc(spark, d):
    from corpuslens.operators.lookup import search_doc

    t = table(spark, d, "documents").selectExpr("source as spec_id", "doc_id as document_order", "doc_id as chunk_id", "lang as section_title", "cast(doc_id % 7 as string) as clause")
    return search_doc(t, "E").select(F.col("spec_id").alias("source"), F.col("chunk_id").alias("doc_id"))


@query("""
with t as (select doc_id, (doc_id % 40) || '.' || (doc_id % 3) as clause from documents)
select doc_id, 'text' as mode from t where starts_with(clause, '1') union all select doc_id, 'segments' from t where split_part(clause, '.', 1) = '1'""")
def prj30_prefix_filter(spark, d):
    from corpuslens.operators.lookup import prefix_filter

    t = table(spark, d, "documents").selectExpr("doc_id", "concat(cast(doc_id % 40 as string), '.', cast(doc_id % 3 as string)) as clause").withColumn("section_path", T.section_path(F.col("clause")))
    return prefix_filter(t, "1", "text").select("doc_id", F.lit("text").alias("mode")).unionByName(prefix_filter(t, "1", "segments").select("doc_id", F.lit("segments").alias("mode")))


#: Kinds of fusion, with and without a re-ranker; several share a fusion.
_CONFIGS = [
    (1, "rrf", 5, 5, 60, 5, None), (2, "rrf", 20, 20, 60, 10, None), (3, "rrf", 20, 20, 10, 10, None), (4, "rrf", 20, 20, 60, 10, 5), (5, "rrf", 20, 20, 60, 4, 10),
    (6, "dense", 20, 0, 60, 10, None), (7, "dense", 20, 0, 60, 10, 5), (8, "round_robin", 20, 10, 60, 10, None), (9, "round_robin", 20, 10, 60, 10, 4), (10, "sparse", 0, 20, 60, 10, None),
]


def _sweep_sql() -> str:
    from corpuslens.plans.retrieval_queries import _DEN, _HITS, _LEX

    rows = ", ".join(str(c).replace("None", "null") for c in _CONFIGS)
    return f"""with {_LEX}, {_DEN}, {_HITS}, cfg as (select * from (values {rows}) v(config_id, kind, dd, sd, rrf_k, top_n, rerank_k)),
fus as (select config_id, query_id, chunk_id, any_value(kind) as kind, round(sum(1.0::double / (rrf_k + rank)), 12) as score, min(list_no * 100000 + rank) as f, min(rank * 100000 + list_no) as g, max(top_n) as top_n, max(rerank_k) as rerank_k
       from hits, cfg where case when list_no < 10000 then kind <> 'sparse' and rank <= dd else kind <> 'dense' and rank <= sd end group by all),
rkd as (select *, row_number() over (partition by config_id, query_id order by case kind when 'round_robin' then 0 else -score end, case kind when 'round_robin' then g else f end, chunk_id) as r from fus),
scd as (select *, case when query_id % 8 <> 3 and chunk_id % 3 <> 0 then ((chunk_id * 7919 + query_id * 31) % 1000) / 1000.0 end as rr from rkd where r <= top_n),
cut as (select *, case when rerank_k is null then r else row_number() over (partition by config_id, query_id order by rr desc nulls last, r) end as p from scd),
jud as (select config_id, query_id, p, query_id % 10 <> 9 and source = 'src' || (query_id % 20) as a, query_id % 10 <> 9 and query_id % 3 <> 0 and source = 'src3' as b,
        query_id % 10 <> 9 and ((source = 'src' || (query_id % 20) and (query_id % 3 = 0 or chunk_id % 7 = query_id % 7)) or (query_id % 3 <> 0 and source = 'src3' and chunk_id % 7 = query_id % 7 and chunk_id % 3 = 1)) as hit
      from cut join documents on doc_id = chunk_id where rerank_k is null or p <= rerank_k),
met as (select config_id, query_id, count(*) as n_hits, min(p) filter (where hit) as se, min(p) filter (where a or b) as sp from jud group by all),
gol as (select config_id, item_id as query_id, item_id % 10 <> 9 as asked from benchmark, cfg),
per as (select config_id, query_id, coalesce(n_hits, 0) as n_hits, asked, asked and coalesce(se, 99) > 20 as failed, case when asked then coalesce(1.0::double / se, 0) end as mrr, case when asked then coalesce(1.0::double / sp, 0) end as mrr_spec,
        case when asked then coalesce(se <= 5, false)::int::double end as section_recall_5 from gol left join met using (config_id, query_id))
select config_id, null::bigint as failed_item, count(*) as n, count(*) filter (n_hits = 0) as n_empty, count(*) filter (failed) as n_failed, round(avg(mrr), 9) as mrr, round(avg(mrr_spec), 9) as mrr_spec, round(avg(section_recall_5), 9) as section_recall_5 from per group by config_id
union all select config_id, query_id, n_hits, 0, 0, mrr, mrr_spec, section_recall_5 from per where failed"""


@query(_sweep_sql())
def evl05_sweep(spark, d):
    """A row for each configuration, and one for each item that it failed."""
    from corpuslens.plans.relational_queries import _golden
    from corpuslens.plans.retrieval_queries import hits

    places = table(spark, d, "documents").selectExpr("doc_id as chunk_id", "source as spec_id", "array(cast(doc_id % 7 as string), cast(doc_id % 3 as string)) as section_path", "'' as clause", "lang as section_title")
    configs = spark.createDataFrame(_CONFIGS, "config_id int, kind string, dense_depth int, sparse_depth int, rrf_k int, top_n int, rerank_k int")
    found = hits(spark, d)
    scores = found.select("query_id", "chunk_id").distinct().where("query_id % 8 <> 3 and chunk_id % 3 <> 0").selectExpr("query_id", "chunk_id", "((chunk_id * 7919 + query_id * 31) % 1000) / 1000.0D as score")
    summary, questions = V.sweep(found, _golden(spark, d), places, configs, scores)
    failed = questions.where("failed").selectExpr("config_id", "query_id as failed_item", "n_hits as n", "0L as n_empty", "0L as n_failed", "mrr", "mrr_spec", "section_recall_5")
    return summary.select("config_id", F.lit(None).cast("long").alias("failed_item"), "n", "n_empty", "n_failed", "mrr", "mrr_spec", "section_recall_5").unionByName(failed)


# sources and sinks


@query("select source, lang, doc_id, n_chars from documents where doc_id % 5 <> 4 and not (doc_id % 2 = 0 and doc_id < 300) union all select source, lang, doc_id, -1 from documents where doc_id % 2 = 0 and doc_id < 300")
def snk01_upsert_manifest(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("release"), F.col("doc_id").alias("spec_uid"), "lang", "n_chars", F.when(F.col("doc_id") % 5 == 4, "old").otherwise("new").alias("dataset_revision"))
    new = t.where("spec_uid % 2 = 0 and spec_uid < 300").withColumn("n_chars", F.lit(-1).cast("long"))
    return W.upsert_manifest(t, new, "old").select(F.col("release").alias("source"), "lang", F.col("spec_uid").alias("doc_id"), "n_chars")


@query("select doc_id as chunk_id, case when doc_id % 3 = 0 then 'new' else 'old' end as v from documents")
def snk03_upsert_chunks(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit("p").alias("provider"), F.lit("old").alias("v"))
    new = t.where("chunk_id % 3 = 0").withColumn("v", F.lit("new"))
    return W.upsert_chunks(t, new.unionByName(new)).select("chunk_id", "v")


@query("select 'a' as sink, count(*) as removed from documents where source in ('src1', 'src2') union all select 'b', count(*) from documents where source in ('src1', 'src2') and doc_id % 2 = 0")
def snk04_purge_documents(spark, d):
    t = table(spark, d, "documents").select(F.col("source").alias("spec_id"), "doc_id")
    ids = spark.createDataFrame([("src1",), ("src2",), ("none",)], "spec_id string")
    return W.purge_documents(ids, {"a": t, "b": t.where("doc_id % 2 = 0")})[1]


@query("select source as spec_id, count(*) as n_chunks from documents group by source")
def snk05_finalize_corpus(spark, d):
    return W.finalize_corpus(table(spark, d, "documents").withColumnRenamed("source", "spec_id"))


@query("select doc_id as chunk_id, '[\"' || source || '\",\"' || lang || '\"]' as tags, 'p' as provider, lang = 'en' as is_en from documents")
def snk06_projections(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.array("source", "lang").alias("tags"), "lang")
    payload = W.to_payload(t).select("chunk_id", (F.get_json_object("payload", "$.lang") == "en").alias("is_en"))
    return W.to_meta(t.drop("lang"), "p").join(payload, "chunk_id")


@query("select doc_id, doc_id % 4 = 0 as failed, case when doc_id % 4 = 0 then 'broken' end as error from documents")
def snk09_split_failures(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "broken").alias("error"))
    ok, failed = W.split_failures(t)
    told = lambda df, failed, error: df.select("doc_id", F.lit(failed).alias("failed"), error.alias("error"))
    return told(ok, False, F.lit(None).cast("string")).unionByName(told(failed, True, F.col("error")))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def snk10_only_new(spark, d):
    return selection.only_new(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("select count(*) as attempted, count(*) filter (where doc_id % 4 <> 0) as ok, count(*) filter (where doc_id % 4 = 0) as failed, sum(doc_id % 7) filter (where doc_id % 4 <> 0)::bigint as chunks, sum(n_chars) filter (where doc_id % 4 <> 0)::bigint as tokens from documents")
def snk11_run_stats(spark, d):
    return W.run_stats(table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "broken").alias("error"), (F.col("doc_id") % 7).alias("n_chunks"), F.col("n_chars").alias("tokens")))


@query("select 'chunks' as sink, count(*) as n_rows, count(distinct source) as n_documents from documents where source = 'src3' union all select 'meta', count(*), count(distinct source) from documents where source = 'src3' and lang = 'en'")
def snk12_sink_status(spark, d):
    t = table(spark, d, "documents").withColumnRenamed("source", "spec_id")
    return W.sink_status({"chunks": t, "meta": t.where("lang = 'en'")}, "src3")


@query("""
with f as (select source as spec_uid, doc_id as ordinal, 'x-' || chr((97 + doc_id % 9)::int) || (10 + doc_id % 80) || case when doc_id % 4 = 0 then 'docx' else '.docx' end as name from documents), v as (select *, nullif(lower(regexp_extract(name, '-([A-Za-z]\\d{2})[_.]', 1)), '') as version from f)
select spec_uid, name, version from (select *, row_number() over (partition by spec_uid order by version desc nulls last, ordinal) as n from v) where n = 1""")
def src03_latest_original(spark, d):
    f = table(spark, d, "documents").selectExpr("source as spec_uid", "doc_id as ordinal", "concat('x-', chr(97 + doc_id % 9), cast(10 + doc_id % 80 as string), case when doc_id % 4 = 0 then 'docx' else '.docx' end) as name")
    return selection.latest_original(f)


@query("""
with f as (select 'hf/Rel-' || (page_id % 3) || '/38_series/38' || lpad((page_id % 40)::varchar, 3, '0') || '/' || case when page_id % 4 = 0 then 'raw.md' else 'img' || page_id || '.png' end as path, page_id as size from pages),
p as (select *, string_split(path, '/') as s from f), g as (select s[2] as release, s[4] as spec_uid, max(size) filter (where s[5] = 'raw.md') as raw_md_size, count(*) filter (where s[5] <> 'raw.md') as n_images, min(path) filter (where s[5] <> 'raw.md') as first_image from p group by all)
select release, spec_uid, '38.' || substr(spec_uid, 3) as spec_id, raw_md_size, n_images::int as n_images, first_image from g where raw_md_size is not null""")
def src02_build_manifest(spark, d):
    from corpuslens.sources.read import build_manifest

    files = table(spark, d, "pages").selectExpr("concat('hf/Rel-', cast(page_id % 3 as string), '/38_series/38', lpad(cast(page_id % 40 as string), 3, '0'), '/', case when page_id % 4 = 0 then 'raw.md' else concat('img', cast(page_id as string), '.png') end) as path", "page_id as size")
    return build_manifest(files).select("release", "spec_uid", "spec_id", "raw_md_size", "n_images", F.get("images", F.lit(0))["path"].alias("first_image"))


# user functions


@query("select vec_id as chunk_id, 4 as width, length(label::varchar)::double as first, 1.0::double as last from embeddings")
def udf01_embed(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("content"))
    return udf.embed(t, lambda texts: [[float(len(x)), 0.0, 0.0, 1.0] for x in texts], 4).select("chunk_id", F.size("vec").alias("width"), F.col("vec")[0].cast("double").alias("first"), F.col("vec")[3].cast("double").alias("last"))


@query("select doc_id, case when doc_id % 5 = 0 then null else lang || length(source) end as label, doc_id % 5 = 0 as failed from documents")
def udf02_resolve(spark, d):
    def look(k, c):
        if int(k) % 5 == 0:
            raise ValueError("dead")
        return {"label": c}

    t = table(spark, d, "documents").select("doc_id", F.concat("lang", F.length("source").cast("string")).alias("c"))
    return udf.resolve(t, look, "label string", "doc_id", "c").select("doc_id", "told.label", F.col("error").isNotNull().alias("failed"))


@query("select doc_id % 25 as query_id, doc_id as chunk_id, length(lang || source)::double as score from documents qualify row_number() over (partition by doc_id % 25 order by doc_id) <= 30")
def udf03_score_pairs(spark, d):
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    t = table(spark, d, "documents").select((F.col("doc_id") % 25).alias("query_id"), F.lit("q").alias("query"), F.col("doc_id").alias("chunk_id"), F.concat("lang", "source").alias("content")).withColumn("rank", F.row_number().over(order))
    return udf.score_pairs(t, lambda q, texts: [len(x) for x in texts], 30)


@query("select doc_id, len(regexp_extract_all(text, '\\S+'))::int as n from documents")
def udf04_token_counter(spark, d):
    ascii_spaces = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    count = udf.token_counter(lambda texts: [len(x.split()) for x in texts])
    return table(spark, d, "documents").select("doc_id", count(ascii_spaces).alias("n"))


@query("""
with t as (select doc_id, text, regexp_extract_all(text, '[A-Za-z0-9_]+|[ \\t\\n\\r\\f\\v]+|[^A-Za-z0-9_ \\t\\n\\r\\f\\v]') as ts from documents where text <> '')
select doc_id, len(ts)::bigint as n, sum(length(ts[i]) * i)::bigint as weight, max(length(text))::bigint as last_end, any_value(sha256(text)) as joined_sha256, true as as_placed from t, unnest(range(1, len(ts) + 1)) x(i) group by doc_id, ts""")
def udf04_token_spans(spark, d):
    """Words, blanks and other characters, which together are the text: joined in the order of their places they give it back."""
    import re

    pattern = r"[A-Za-z0-9_]+|[ \t\n\r\f\v]+|[^A-Za-z0-9_ \t\n\r\f\v]"
    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    found = udf.with_spans(docs, lambda text: (m.span() for m in re.finditer(pattern, text))).where(F.size("spans") > 0).drop("text")
    weights = F.transform("spans", lambda x, i: F.char_length(x["token"]) * (i + 1).cast("long"))
    follows = F.forall(
        F.transform("spans", lambda x, i: (x["begin"] == F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"])) & (F.char_length(x["token"]) == x["end"] - x["begin"])), lambda x: x,
    )
    return found.select(
        "doc_id", F.size("spans").cast("long").alias("n"), F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"), F.array_max("spans.end").cast("long").alias("last_end"),
        F.sha2(F.array_join("spans.token", ""), 256).alias("joined_sha256"), follows.alias("as_placed"),
    )


@query("select doc_id, count(*) as n from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]')) from documents) group by doc_id")
def udf05_explode_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(T.split_tokens(F.col("text"), 1)).alias("t"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
