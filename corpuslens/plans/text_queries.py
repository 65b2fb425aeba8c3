"""Text expressions over the documents and the star schema's names."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import ids, text, vectors
from corpuslens.plans.registry import query, table

# Expressions that both engines read: names and notes made from a row's own values.
SPEC = "concat(cast(21 + doc_id % 18 as string), '.', lpad(cast(doc_id * 37 % 1000 as string), 3, '0'))"
UID = "concat(cast(l_orderkey as string), case when l_linenumber > 3 then concat('-', cast(l_linenumber as string)) else '' end)"
CLAUSE = "case doc_id % 4 when 0 then '' when 1 then concat('A.', cast(doc_id % 7 as string)) else concat(cast(doc_id % 9 + 1 as string), '.', cast(doc_id % 5 as string), '.', cast(doc_id % 3 as string)) end"


def sql_of(expr: str) -> str:
    """The same expression for the other engine."""
    return expr.replace("as string", "as varchar")


@query(f"""
with t as (select l_orderkey, l_linenumber, {sql_of(UID)} as uid from lineitem)
select l_orderkey, l_linenumber, uid, case when regexp_full_match(uid, '\\d\\d\\d+(-\\d+)?') then left(uid, 2) else '' end as series,
  case when regexp_full_match(uid, '\\d\\d\\d+(-\\d+)?') then left(uid, 2) || '.' || substr(uid, 3) else uid end as spec_id from t""")
def prj01_parse_spec_uid(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{UID} as uid").withColumn("p", text.parse_spec_uid(F.col("uid")))
    return t.select("l_orderkey", "l_linenumber", "uid", "p.series", "p.spec_id")


@query("""
with t as (select o_orderkey, case when o_orderkey % 5 = 0 then 'Release ' else 'Rel-' end || o_orderkey % 23 as release from orders)
select o_orderkey, release, coalesce(try_cast(nullif(regexp_extract(release, '^Rel-(\\d+)$', 1), '') as int), -1) as rank from t""")
def prj02_release_rank(spark, d):
    t = table(spark, d, "orders").selectExpr("o_orderkey", "concat(case when o_orderkey % 5 = 0 then 'Release ' else 'Rel-' end, cast(o_orderkey % 23 as string)) as release")
    return t.withColumn("rank", text.release_rank(F.col("release")))


@query("""
with t as (select p_partkey, p_partkey || '-' || chr((97 + p_partkey % 26)::int) || case when p_partkey % 120 < 10 then '0' else '' end || p_partkey % 120 || case when p_partkey % 3 = 0 then '_s01.docx' else '.zip' end as file from part)
select p_partkey, file, nullif(lower(regexp_extract(file, '-([A-Za-z]\\d{2})[_.]', 1)), '') as version from t""")
def prj03_doc_version(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey", "concat(cast(p_partkey as string), '-', chr(97 + p_partkey % 26), case when p_partkey % 120 < 10 then '0' else '' end, cast(p_partkey % 120 as string), case when p_partkey % 3 = 0 then '_s01.docx' else '.zip' end) as file")
    return t.withColumn("version", text.doc_version(F.col("file")))


@query("""
select doc_id, source, lang from documents where lang = 'en' and source in ('src0', 'src1', 'src2') or source = 'src5' and lang = 'de'""")
def prj05_select_documents(spark, d):
    from corpuslens.operators.selection import select_glossary_docs

    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("series"), F.col("lang").alias("spec_type"), F.concat_ws("/", "source", "lang").alias("spec_id"))
    return select_glossary_docs(t, "en", ["src0", "src1", "src2"], ["src5/de"]).select("doc_id", F.col("series").alias("source"), F.col("spec_type").alias("lang"))


@query("""
select doc_id, source, lang from documents where lang = 'en' and source in ('src0', 'src1', 'src2') and doc_id in (select doc_id from labels)""")
def prj04_filter_documents(spark, d):
    from corpuslens.operators.selection import filter_specs

    t = table(spark, d, "documents").select(F.col("doc_id").alias("spec_id"), F.col("source").alias("series"), F.col("lang").alias("spec_type"))
    kept = filter_specs(t, "en", ["src0", "src1", "src2"], table(spark, d, "labels").select(F.col("doc_id").alias("spec_id")))
    return kept.select(F.col("spec_id").alias("doc_id"), F.col("series").alias("source"), F.col("spec_type").alias("lang"))


HEADED = "concat(case doc_id % 6 when 0 then '# 3GPP **TS** 38.211 V19' when 1 then '# *Study on lines*' when 2 then '# Technical Specification' when 3 then '# Notes' else 'no heading' end, chr(10), text)"


@query(f"""
with t as (select doc_id, {sql_of(SPEC)} as spec_id, left({HEADED}, 4096) as head from documents),
h as (select *, list_filter(list_transform(string_split(head, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '# '))[1] as h1 from t),
p as (select *, coalesce(h1, '') || chr(10) || head as pool from h),
k as (select *, upper(regexp_extract(pool, '(?i)3GPP\\s*\\*{{0,2}}\\s*(TS|TR)\\s*\\*{{0,2}}\\s*\\d{{2}}\\.\\d{{3}}', 1)) as named, lower(pool) as low, split_part(spec_id, '.', 2)::int as num from p)
select doc_id, case when named <> '' then named when contains(low, 'study on') or contains(low, 'study item') or contains(low, 'technical report') then 'TR'
  when contains(low, 'technical specification') then 'TS' when num >= 500 then 'TR' else 'TS' end as spec_type,
  nullif(regexp_replace(regexp_replace(h1, '^# ', ''), '^[\\s*]+|[\\s*]+$', '', 'g'), '') as title from k""")
def prj06_classify_doc(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{SPEC} as spec_id", f"{HEADED} as text").withColumn("c", text.classify_doc(F.col("text"), F.col("spec_id")))
    return t.select("doc_id", "c.spec_type", "c.title")


@query(f"""
with t as (select doc_id, list_transform(string_split({HEADED}, chr(10)), lambda x: trim(x)) as ls from documents),
h as (select doc_id, ls, list_filter(ls, lambda x: starts_with(x, '# '))[1] as h1 from t)
select doc_id, coalesce(nullif(regexp_replace(regexp_replace(h1, '^# ', ''), '^[\\s*]+|[\\s*]+$', '', 'g'), ''), left(list_filter(ls, lambda x: x <> '')[1], 200)) as title from h""")
def prj07_doc_title(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{HEADED} as text")
    return t.select("doc_id", text.doc_title(F.col("text")).alias("title"))


TITLED = f"trim(concat({CLAUSE}, ' ', replace(text, chr(10), ' ')))"


@query(f"""
with t as (select doc_id, {sql_of(TITLED)} as heading from documents),
c as (select doc_id, heading, regexp_extract(heading, '^([A-Z](?:\\.\\d+[a-z]*)*|\\d+[a-z]*(?:\\.\\d+[a-z]*)*)\\s+(.+)$', 1) as c, regexp_extract(heading, '^([A-Z](?:\\.\\d+[a-z]*)*|\\d+[a-z]*(?:\\.\\d+[a-z]*)*)\\s+(.+)$', 2) as r from t),
e as (select doc_id, case when regexp_matches(c, '\\d') then c else '' end as clause, case when regexp_matches(c, '\\d') then trim(r) else heading end as title from c)
select doc_id, clause, case when length(title) <= 1200 then title else rtrim(left(title, 1199)) || '…' end as title from e""")
def prj08_split_clause(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{TITLED} as heading").withColumn("c", text.split_clause(F.col("heading")))
    return t.select("doc_id", "c.clause", "c.title")


@query("""
with t as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
select doc_id, count(*) as n_lines, count(*) filter (where trim(line) = '' or starts_with(trim(line), '|') or regexp_matches(line, '\\|\\s*:?-{2,}')) as n_pseudo from t group by doc_id""")
def prj09_pseudo_headings(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(text.is_pseudo_heading(F.col("line"))).alias("n_pseudo"))


IMAGED = "concat('![a](img/', cast(doc_id as string), '.png)', chr(10), text, '![', text, '](x.jpg) ![](y z.png)')"


@query(f"select doc_id, array_to_string(regexp_extract_all({sql_of(IMAGED)}, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1), ',') as refs from documents")
def prj10_image_refs(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{IMAGED} as text")
    return t.select("doc_id", F.array_join(text.image_refs(F.col("text")), ",").alias("refs"))


LISTED = "case doc_id % 5 when 0 then ' **Contents** ' when 1 then '3rd Generation Partnership Project' when 2 then 'Scope' else text end"
NUMBERED = f"case when doc_id % 11 = 3 then {SPEC} else {CLAUSE} end"
TABLED = "case when doc_id % 7 = 4 then concat(regexp_replace(text, '([a-z]) ([a-z])', '$1 |$2'), ' Internet') else text end"


@query(f"""
with t as (select doc_id, {sql_of(NUMBERED)} as clause, {LISTED} as title, replace(text, ' ', chr(10) || '| 12 |') as body from documents),
m as (select *, lower(trim(regexp_replace(title, '[*_`#\\s]+', ' ', 'g'))) as norm, length(regexp_replace(body, '^\\s+|\\s+$', '', 'g')) as size,
  list_filter(string_split(body, chr(10)), lambda x: trim(x) <> '') as lines from t),
q as (select *, len(lines) as n, list_filter(lines, lambda x: regexp_matches(x, '^\\s*\\|')) as pipes from m),
r as (select *, len(pipes) as p, len(list_filter(pipes, lambda x: regexp_matches(x, '\\|\\s*\\d{{1,4}}\\s*\\|?\\s*$'))) as tails from q)
select doc_id, case when regexp_matches(clause, '^\\d{{2}}\\.\\d{{3}}(-\\d+)?$') then 'clause-looks-like-spec-id'
  when norm in ('contents', 'foreword', 'copyright notification', '<preamble>', 'introduction', 'postal address', 'keywords', 'trademarks', 'intellectual property rights') then 'stop-list:' || norm
  when regexp_matches(title, '(?i)3rd\\s+Generation\\s+Partnership\\s+Project|Technical\\s+Specification\\s+Group') then 'spec-template-title'
  when size < 30 then 'empty-body:' || size || 'chars'
  when size < 600 and (contains(body, 'Postal address') or contains(body, 'Sophia Antipolis') or contains(body, 'Internet') or contains(body, '3GPP support office')) then 'contact-info'
  when n > 20 and p / n > 0.80 and tails / greatest(p, 1) > 0.50 then 'toc-table:' || p || '/' || n || '-pipe-lines,' || tails || '-page-tails' end as reason from r""")
def prj11_flag_garbage(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{NUMBERED} as clause", f"{LISTED} as title", "replace(text, ' ', concat(chr(10), '| 12 |')) as body")
    return t.select("doc_id", text.garbage_reason(F.col("clause"), F.col("title"), F.col("body")).alias("reason"))


@query(f"""
with t as (select doc_id, {sql_of(SPEC)} as spec_id, {sql_of(CLAUSE)} as clause, text as title from documents)
select doc_id, nullif(regexp_extract(clause, '^(.+)\\.[^.]*$', 1), '') as parent, case when clause = '' then 0 else len(string_split(clause, '.')) end as depth,
  '[' || spec_id || case when trim(clause) = '' and trim(title) = '' then '' else ' § ' || concat_ws(' ', nullif(trim(clause), ''), nullif(trim(title), '')) end || ']' as header from t""")
def prj12_section_headers(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{SPEC} as spec_id", f"{CLAUSE} as clause", "text as title")
    c = F.col("clause")
    return t.select("doc_id", text.parent_clause(c).alias("parent"), F.size(text.section_path(c)).cast("long").alias("depth"), text.section_header(F.col("spec_id"), c, F.col("title")).alias("header"))


def _uuid_sql(space: str, name: str) -> str:
    h = f"sha1(unhex('{space.replace('-', '')}') || encode({name}))"
    v = "translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
    return h, f"substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || {v} || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


_H, _U = _uuid_sql(ids.CHUNK_SPACE, f"{sql_of(SPEC)} || '|' || {sql_of(CLAUSE)} || '|' || left(sha256(text), 16)")
_H2, _ = _uuid_sql(ids.SECTION_SPACE, f"{sql_of(SPEC)} || '|' || {sql_of(CLAUSE)} || '|' || text")


@query(f"""
with a as (select doc_id, {_H} as h from documents), b as (select doc_id, {_H2} as h from documents)
select x.doc_id, x.chunk_id, y.parent_section_id from (select doc_id, {_U} as chunk_id from a) x join (select doc_id, {_U} as parent_section_id from b) y using (doc_id)""")
def prj13_content_ids(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{SPEC} as s", f"{CLAUSE} as c", "text as t", "text")
    return t.select("doc_id", ids.chunk_id(F.col("s"), F.col("c"), F.col("text")).alias("chunk_id"), ids.parent_section_id(F.col("s"), F.col("c"), F.col("t")).alias("parent_section_id"))


LOST = "case doc_id % 5 when 0 then concat(text, ' is given by:', chr(10), chr(10), 'where x') when 1 then concat('- are defined as ', text) when 2 then concat('where', chr(10), text, chr(10), ' and ', chr(10)) else text end"


@query(f"""
with t as (select doc_id, {LOST} as text from documents)
select doc_id, regexp_matches(text, '(?i)\\b(?:(?:defined|given|expressed|computed|obtained|determined|described|denoted|generated|calculated)\\s+by|(?:computed|obtained|generated|calculated|written|stated|formulated)\\s+as|is\\s+given\\s+as|as\\s+follows|converted to [^.\\n]*as)[\\t ]*[:.,]?[\\t ]*\\n\\s*\\n\\s*(?:where|and|with|here|in which|for which|such that)\\b')
  or len(list_filter(string_split(lower(text), chr(10)), lambda x: rtrim(regexp_replace(trim(x), '[:.,]$', '')) in ('where', 'and', 'with', 'here', 'in which', 'for which', 'such that'))) >= 2
  or len(list_filter(string_split(lower(text), chr(10)), lambda x: regexp_matches(x, '^[-*]\\s+(is|are|denotes?|represents?)\\s+(given|defined|expressed|the|a|an)\\b'))) > 0 as stripped from t""")
def prj14_stripped_formula(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{LOST} as text")
    return t.select("doc_id", text.has_stripped_formula(F.col("text")).alias("stripped"))


FORMULA = "concat('$$N_{slot}^{', replace(text, '$', ''), '} = \\\\sum x_', cast(doc_id as string), ' 12$$ and $\\\\mathrm{abc} + q$')"


@query(r"""
with t as (select doc_id, '$$N_{slot}^{' || replace(text, '$', '') || '} = \sum x_' || doc_id || ' 12$$ and $\mathrm{abc} + q$' as text from documents),
f as (select doc_id, array_to_string(list_concat(regexp_extract_all(text, '(?s)\$\$(.+?)\$\$', 1), regexp_extract_all(regexp_replace(text, '(?s)\$\$(.+?)\$\$', ' ', 'g'), '\$([^$\n]{1,400}?)\$', 1)), ' ' || chr(10) || ' ') as s from t),
n as (select doc_id, regexp_replace(regexp_replace(regexp_replace(s, '\\(?:mathrm|text)\s*\{([^{}]*)\}', ' \1 ', 'g'), '\\([a-zA-Z]+)', ' \1 ', 'g'), '[{}\\\[\]()|=+*/<>!~&%@?:;"''`,\-\s]+', ' ', 'g') as s from f),
k as (select doc_id, list_transform(string_split(s, ' '), lambda x: regexp_replace(x, '^[_^.,]+|[_^.,]+$', '', 'g')) as w from n),
u as (select doc_id, i, w[i] as tok from k, unnest(range(1, len(w) + 1)) r(i)),
g as (select doc_id, tok, min(i) as i from u where regexp_matches(tok, '\p{L}') and lower(tok) not in ('""" + "', '".join(w.lower() for w in text.LATEX_WORDS) + r"""') group by all),
h as (select *, row_number() over (partition by doc_id order by i) as place from g)
select t.doc_id, coalesce(string_agg(tok, ' ' order by i), '') as symbols from t left join h on t.doc_id = h.doc_id and place <= 40 group by t.doc_id""")
def prj15_formula_symbols(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{FORMULA} as text")
    return t.select("doc_id", F.array_join(text.formula_symbols(F.col("text")), " ").alias("symbols"))


FIGURE = "concat('![Alt ', cast(doc_id as string), '](img/', cast(doc_id as string), '.png)', chr(10), chr(10), text, case when doc_id % 2 = 0 then concat(chr(10), '**Figure 5.', cast(doc_id as string), '-1: The line.**') else concat(' Alt ', cast(doc_id as string)) end)"


@query(f"""
with t as (select doc_id, {sql_of(FIGURE)} as b from documents),
l as (select doc_id, string_split(b, chr(10)) as ls from t),
m as (select doc_id, ls[1] as head, list_filter(list_slice(ls, 2, len(ls)), lambda x: trim(x) <> '') as body from l),
c as (select *, trim(body[len(body)]) as last, 'Alt ' || doc_id as alt from m),
x as (select *, regexp_matches(last, '(?i)^\\s*\\**\\s*(Figure\\s+[A-Z]?\\d+(?:\\.\\d+)*(?:-\\d+)?\\s*[:.].*?)\\**\\s*$') as capped from c),
y as (select *, trim(array_to_string(case when capped then list_slice(body, 1, len(body) - 1) else body end, chr(10))) as told from x)
select doc_id, alt, 'img/' || doc_id || '.png' as path, case when capped then regexp_replace(regexp_extract(last, '(?i)^\\s*\\**\\s*(Figure\\s+[A-Z]?\\d+(?:\\.\\d+)*(?:-\\d+)?\\s*[:.].*?)\\**\\s*$', 1), '\\.+$', '') end as caption,
  case when ends_with(told, alt) then rtrim(left(told, length(told) - length(alt))) else told end as description from y""")
def prj16_figure_fields(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{FIGURE} as b")
    return t.select("doc_id", text.figure_fields(F.col("b")).alias("f")).select("doc_id", "f.*")


PATH = "concat(case page_id % 5 when 0 then '/abs/' when 1 then './img\\\\' when 2 then 'marked/' when 3 then '' else '././a/b/' end, case when page_id % 10 = 3 then '' else concat(cast(page_id as string), '.png') end)"


@query(r"""
with t as (select page_id, case page_id % 5 when 0 then '/abs/' when 1 then './img\' when 2 then 'marked/' when 3 then '' else '././a/b/' end || case when page_id % 10 = 3 then '' else page_id || '.png' end as path from pages),
p as (select page_id, path, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') as p from t)
select page_id, case when path = '' or starts_with(p, '/') or starts_with(p, 'marked/') then p else 'marked/doc/' || regexp_extract(p, '([^/]*)$', 1) end as full_path from p""")
def prj17_resolve_path(spark, d):
    t = table(spark, d, "pages").selectExpr("page_id", f"{PATH} as path")
    return t.select("page_id", text.resolve_path(F.col("path"), F.lit("marked\\doc/")).alias("full_path"))


@query("""
select doc_id, lower(regexp_replace(regexp_replace(regexp_replace('  "' || text || ''' ', '^\\s+|\\s+$', '', 'g'), '^["''`]+|["''`]+$', '', 'g'), '\\s+', ' ', 'g')) as term,
  left(regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10) || ' ' || chr(10) || chr(10) || chr(10)), '\\n[ \\t]*\\n[ \\t]*(?:\\n[ \\t]*)+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 8000) as definition from documents""")
def prj18_glossary_text(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", "concat('  \"', text, '\\' ') as term", "replace(text, '. ', concat('.', chr(10), ' ', chr(10), chr(10), chr(10))) as body")
    return t.select("doc_id", text.normalize_term(F.col("term")).alias("term"), text.clean_definition(F.col("body")).alias("definition"))


MARKED = "concat('[38.331 § 5 x]', chr(10), chr(10), '<b>', replace(text, ', ', '* | *'), '</b>', chr(10), '|---|:--|', chr(10), '**end**')"


@query(f"""
with a as (select doc_id, text, regexp_replace({MARKED}, '</?[A-Za-z][^>]*>', '', 'g') as s from documents),
b as (select doc_id, text, regexp_replace(regexp_replace(s, '(?m)^\\s*\\[\\s*\\d+\\.\\d+(?:-\\d+)?(?:\\s*§[^\\]\\n]*)?\\s*\\]\\s*$', '', 'g'), '(?m)^\\s*\\|?[\\s\\-:|]+\\|[\\s\\-:|]+\\s*$', '', 'g') as s from a),
c as (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(s, '\\*{{1,3}}([^*\\n]{{1,200}}?)\\*{{1,3}}', '\\1', 'g'), '\\s*\\n+\\s*', ' ', 'g'), '\\s*\\|\\s*', ' | ', 'g') as s from b),
e as (select doc_id, text, regexp_replace(regexp_replace(s, '\\s{{2,}}', ' ', 'g'), '^[ |]+|[ |]+$', '', 'g') as s from c)
select doc_id, case when length(s) > 180 then rtrim(left(s, 179)) || '…' else s end as clean, left(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g'), 140) as preview from e""")
def prj19_sanitize(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", "text", f"{MARKED} as marked")
    return t.select("doc_id", text.sanitize(F.col("marked")).alias("clean"), text.preview(F.col("text")).alias("preview"))


CHUNK = "concat('[', source, ' § 1 Scope]', chr(10), chr(10), text, case doc_id % 3 when 0 then concat(chr(10), chr(10), 'Formula symbols: a, b', chr(10), '[Note: source markdown contains stripped formula(s)]') when 1 then concat(chr(10), chr(10), 'Formula symbols: q') else '' end)"


@query("select doc_id, trim(text) as body from documents")
def prj20_chunk_body(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{CHUNK} as content")
    return t.select("doc_id", text.chunk_body(F.col("content")).alias("body"))


NAMED = f"concat('See TS ', {SPEC}, '-h60 and 3GPP ts', {SPEC}, ' or 23.501 v17; ', text, ' 2', cast(doc_id % 9 as string), '700-81-i00.docx 23501.jsonl')"


@query(f"""
with t as (select doc_id, {sql_of(NAMED)} as text from documents),
a as (select doc_id, regexp_extract_all(text, '\\b(?:3GPP\\s+)?(?:TS\\s*|ts\\s*)?(\\d{{2}}\\.\\d{{3}})(?:[-\\s][a-zA-Z]?\\d+)?\\b', 1) as x,
  list_transform(regexp_extract_all(text, '\\d{{2}}[.\\-]?\\d{{3}}(?:-\\d{{1,3}}\\b)?'), lambda x: regexp_replace(x, '^(\\d{{2}})[.\\-]?(\\d{{3}})', '\\1.\\2')) as y from t),
f as (select doc_id, list_filter(x, lambda v, i: list_position(x, v) = i) as x, list_filter(y, lambda v, i: list_position(y, v) = i) as y from a),
al as (select doc_id, list_transform(x, lambda v: case when v = '23.501' then '23.502' else v end) as z, x, y from f)
select doc_id, array_to_string(x, ',') as ids, array_to_string(y, ',') as part_ids, array_to_string(list_filter(z, lambda v, i: list_position(z, v) = i), ',') as canonical from al""")
def prj21_spec_ids_in_text(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{NAMED} as text")
    found = text.extract_spec_ids(F.col("text"))
    return t.select("doc_id", F.array_join(found, ",").alias("ids"), F.array_join(text.extract_part_ids(F.col("text")), ",").alias("part_ids"), F.array_join(text.canonical_ids(found, {"23.501": "23.502"}), ",").alias("canonical"))


TOPICS = ["the", "of", "in", "und", "la", "thing", "and the", "ing"]


@query("select doc_id, (" + " + ".join(f"regexp_matches(text, '(?i)(^|[^\\pL\\pN_]){k}($|[^\\pL\\pN_])')::int" for k in TOPICS) + ") as score from documents")
def prj22_topic_score(spark, d):
    return table(spark, d, "documents").select("doc_id", text.topic_score(F.col("text"), TOPICS).alias("score"))


ASKED = f"concat(text, case doc_id % 4 when 0 then concat(' in TS ', {SPEC}) when 1 then ' see Clause 5' when 2 then ' stable 5' else ' Annex b' end)"
CODED = "concat('38.', cast(101 + doc_id % 50 as string), case when doc_id % 3 = 0 then '-1' else '' end)"


@query(f"""
with t as (select doc_id, {sql_of(ASKED)} as q, {sql_of(CODED)} as spec, case doc_id % 3 when 0 then 'text' when 1 then 'table' else 'other' end as kind, case when doc_id % 5 = 0 then 'Change History' else 'Use' end as title, text from documents)
select doc_id, not regexp_matches(q, '(?i)\\bTS\\s*\\d{{2}}\\.\\d{{3}}|\\b\\d{{2}}\\.\\d{{3}}\\b|\\bclause\\s+\\d|\\bsub-?clause\\s+\\d|\\bsection\\s+\\d|\\bTable\\s+\\d|\\bFigure\\s+\\d|\\bAnnex\\s+[A-Z]\\b|§') as closed,
  regexp_matches(spec, '-\\d+$') or spec in ('37.141', '38.113', '38.114', '38.124', '38.508', '38.509', '38.522', '38.533') as excluded,
  title <> 'Change History' and length(trim(text)) >= case kind when 'table' then 120 else 220 end as usable from t""")
def prj23_sampling_predicates(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{ASKED} as q", f"{CODED} as spec", "case doc_id % 3 when 0 then 'text' when 1 then 'table' else 'other' end as kind", "case when doc_id % 5 = 0 then 'Change History' else 'Use' end as title", "concat('[38.101 § 1 Use] ', text) as content")
    return t.select("doc_id", text.is_closed_book(F.col("q")).alias("closed"), text.is_excluded(F.col("spec")).alias("excluded"), text.is_usable(F.col("title"), F.col("content"), F.col("kind")).alias("usable"))


QUESTION = f"concat(text, ' p-ZP-CSI RRCReconfiguration in ', {SPEC}, case when doc_id % 2 = 0 then ' section 5.3.1' else ' at 7.2' end)"


@query(f"""
with t as (select doc_id, {sql_of(QUESTION)} as q, {sql_of(SPEC)} as spec from documents),
s as (select doc_id, q, spec, list_transform(regexp_extract_all(q, '[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+|[A-Z][A-Za-z0-9]{{2,}}'), lambda x: lower(x)) as terms, list_filter(regexp_extract_all(q, '[A-Z][A-Za-z0-9\\-]+|[a-z]{{3,}}'), lambda x: lower(x) not in ('the', 'and', 'section')) as c from t),
f as (select *, list_transform(c, lambda x: lower(x)) as lc, nullif(regexp_extract(q, '\\b((?:2[1-9]|3[0-8])\\.\\d{{3}})\\b', 1), '') as spec_id from s)
select doc_id, array_to_string(terms, ' ') as terms, array_to_string(list_slice(list_filter(c, lambda v, i: list_position(lc, lower(v)) = i), 1, 8), ' ') as candidates, spec_id,
  coalesce(nullif(regexp_extract(replace(q, coalesce(spec_id, chr(0)), ''), '(?i)(?:§|sec(?:tion)?\\.?\\s+|clause\\s+)(\\d+(?:\\.\\d+){{0,4}})', 1), ''), nullif(regexp_extract(replace(q, coalesce(spec_id, chr(0)), ''), '\\b(\\d+(?:\\.\\d+){{1,4}})\\b', 1), '')) as prefix from f""")
def prj24_query_targets(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"{QUESTION} as q").withColumn("t", text.toc_target(F.col("q")))
    return t.select("doc_id", F.array_join(text.salient_terms(F.col("q")), " ").alias("terms"), F.array_join(text.glossary_candidates(F.col("q"), ["the", "and", "section"]), " ").alias("candidates"), "t.spec_id", "t.prefix")


REPLY = "concat(text, case doc_id % 4 when 0 then ' Not Found here' when 1 then ' 未定义' when 2 then ' does not exist' else '' end)"


@query(f"""
with t as (select doc_id, case when doc_id % 3 = 0 then 'zh' else lang end as lang, {REPLY} as a from documents)
select doc_id, regexp_matches(lower(a), case when lang = 'zh' then '{"|".join(text.NOT_FOUND["zh"])}' else '{"|".join(text.NOT_FOUND["en"])}' end) as not_found from t""")
def prj25_not_found(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", "case when doc_id % 3 = 0 then 'zh' else lang end as lang", f"{REPLY} as a")
    return t.select("doc_id", text.is_not_found(F.col("a"), F.col("lang")).alias("not_found"))


CHOICE = "case l_linenumber when 1 then concat('ANSWER: Option', cast(l_quantity as int)) when 2 then concat(' (', cast(l_quantity as int), ') ') when 3 then 'none of them' else concat('the option ', cast(l_suppkey % 5 as int), ' or option 7') end"


@query(f"""
with t as (select l_orderkey, l_linenumber, {CHOICE} as a, 'option ' || (l_quantity % 5)::int as wanted from lineitem),
p as (select *, 'option ' || coalesce(try_cast(nullif(regexp_extract(a, '(?i)\\boption\\s*(\\d+)\\b', 1), '') as int), try_cast(nullif(regexp_extract(a, '^\\s*[\\[(]?\\s*(\\d+)\\s*[.)\\]]?\\s*$', 1), '') as int)) as predicted from t)
select l_orderkey, l_linenumber, predicted, coalesce(predicted = wanted, false) as correct from p""")
def prj26_multiple_choice(spark, d):
    t = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{CHOICE} as a", "concat('option ', cast(l_quantity % 5 as int)) as wanted").withColumn("predicted", text.parse_option(F.col("a")))
    return t.select("l_orderkey", "l_linenumber", "predicted", text.score_option(F.col("predicted"), F.col("wanted")).alias("correct"))


MODEL = "case event_id % 4 when 0 then concat('Sure: ```json ', props, ' ``` done') when 1 then concat('x ', props, ' y') when 2 then props else concat('no { object ', event_type) end"


@query(f"""
with t as (select event_id, {MODEL} as m from events)
select event_id, case when event_id % 4 <> 3 then json_extract_string(regexp_extract(m, '(\\{{.*\\}})', 1), '$.k')::bigint end as k from t""")
def prj27_extract_json(spark, d):
    t = table(spark, d, "events").selectExpr("event_id", f"{MODEL} as m")
    return t.select("event_id", text.extract_json(F.col("m"), "k bigint")["k"].alias("k"))


CITING = f"case when doc_id % 2 = 0 then concat('from the document 3GPP 29', cast(272 + doc_id % 9 as string), '-i20.docx. and document 3GPP 23700-81-i00.docx') else '' end"


@query(f"""
select doc_id, case when doc_id % 3 = 0 then '11.111' when doc_id % 2 = 0 then '29.' || (272 + doc_id % 9) || ',23.700-81' else {sql_of(SPEC)} end as cited from documents""")
def prj28_cited_specs(spark, d):
    t = table(spark, d, "documents").selectExpr("doc_id", f"concat('as TS ', {SPEC}, ' says') as answer", f"{CITING} as retrieval", "case when doc_id % 3 = 0 then array('11.111', null, '11.111') end as listed")
    return t.select("doc_id", F.array_join(text.cited_specs(F.col("answer"), F.col("retrieval"), F.col("listed")), ",").alias("cited"))


_TOK = "'[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]'"


@query(f"""
with t as (select doc_id, text, len(regexp_extract_all(text, {_TOK})) as n from documents)
select doc_id, n as n_tokens, array_to_string(regexp_extract_all(text, '(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])(?:\\s*(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])){{0,39}}'), '¶') as pieces,
  case when n <= 40 then text else regexp_extract(text, '(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])(?:\\s*(?:[A-Za-z0-9_]+|[^\\sA-Za-z0-9_])){{0,39}}') end as cut from t""")
def prj31_tokens(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.n_tokens(c).cast("long").alias("n_tokens"), F.array_join(text.split_tokens(c, 40), "¶").alias("pieces"), text.truncate_tokens(c, 40).alias("cut"))


@query("""
with t as (select vec_id, unnest([16, 32, 64]) as d, embedding from embeddings),
s as (select vec_id, d, list_slice(embedding, 1, d)::double[] as v from t),
n as (select *, sqrt(list_inner_product(v, v)) as n from s)
select vec_id, d, round(list_sum(list_transform(v, lambda x: x / n)), 9) as total, round(v[1] / n, 12) as first from n""")
def prj32_truncate_renorm(spark, d):
    t = table(spark, d, "embeddings")
    made = [t.select("vec_id", F.lit(w).alias("d"), vectors.truncate_renorm(F.col("embedding"), w).alias("v")) for w in (16, 32, 64)]
    out = made[0].unionByName(made[1]).unionByName(made[2])
    return out.select("vec_id", "d", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 9).alias("total"), F.round(F.col("v")[0], 12).alias("first"))
