"""Lexical and vector retrieval, fusion and expansion over documents, embeddings and benchmark items.

Documents are chunks, their source the document, their language the series.
Each benchmark item's text, and the vector of its number, are a query; vector
search alone is asked every vector whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators import bm25, dense, fusion
from corpuslens.plans.registry import query, table
from corpuslens.sources.scratch import kept, scratch_path

K = 20
PARENT = "concat(source, '/', cast(doc_id div 8 as string))"
KIND = "case doc_id % 4 when 0 then 'text' when 1 then 'table' when 2 then 'formula' else 'figure' end"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr(
        "doc_id as chunk_id", "source as spec_id", "text as content", f"{KIND} as chunk_type", f"{PARENT} as parent_section_id", "doc_id as document_order", "lang as section_title",
        "cast(n_chars * 8 as int) as parent_section_chars", "concat(cast(doc_id % 7 as string), '.', cast(doc_id % 3 as string)) as clause",
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def lexical(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return bm25.bm25_search(questions(spark, d), chunks(spark, d), k)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), F.col("label").alias("spec_id"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return vectors(spark, d).join(items, F.col("chunk_id") == F.col("query_id")).select("query_id", "vec")


def every_fiftieth(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vec")


def nearest(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return dense.dense_topk(asked(spark, d), vectors(spark, d), k)


def hits(spark: SparkSession, d: str) -> DataFrame:
    both = fusion.as_hits(nearest(spark, d).withColumn("sub", F.lit(0)), lexical(spark, d).withColumn("sub", F.lit(0)), F.col("sub"))
    return kept(both, "hits")  # some rows for each query; read several times


def fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(hits(spark, d), 60, 10)


_STOP = "', '".join(bm25.STOP_WORDS)
_LEX = f"""
qt as (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]{{2,}}')) as term from benchmark),
q as (select query_id, term, count(*) as qtf from qt where term not in ('{_STOP}') group by all),
w as (select doc_id as chunk_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]{{2,}}'), lambda x: x not in ('{_STOP}')) as ws from documents),
st as (select count(*) as n, avg(len(ws)) as avgdl from w),
ps as (select term, chunk_id, count(*) as tf, any_value(dl) as dl from (select chunk_id, len(ws) as dl, unnest(ws) as term from w) group by term, chunk_id),
df as (select term, count(*) as df from ps group by term),
sc as (select query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf / (tf + {bm25.K1} * (1 - {bm25.B} + {bm25.B} * dl / avgdl)))), 9) as score
  from q join df using (term) join ps using (term), st group by query_id, chunk_id),
lex as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from sc)"""
_DEN = """
v as (select vec_id as chunk_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n, label from embeddings),
ds as (select item_id as query_id, c.chunk_id, c.label, round(list_inner_product(a.e, c.e) / (a.n * c.n), 9) as score from benchmark join v a on a.chunk_id = item_id, v c),
den as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from ds)"""
_DEN50 = _DEN.replace("item_id as query_id", "a.chunk_id as query_id").replace("from benchmark join v a on a.chunk_id = item_id, v c", "from v a, v c where a.chunk_id % 50 = 0")
_HITS = f"""
hits as (select query_id, 0 as list_no, rank, chunk_id, score as score_dense, null::double as score_sparse from den where rank <= {K}
  union all select query_id, 10000, rank, chunk_id, null, score from lex where rank <= {K})"""
_RRF = """
fu as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as fused_score, min(list_no * 100000 + rank) as f, max(score_dense) as score_dense, max(score_sparse) as score_sparse from hits group by query_id, chunk_id),
fused as (select *, row_number() over (partition by query_id order by fused_score desc, f, chunk_id)::int as rank from fu)"""
_ALL = f"with {_LEX}, {_DEN}, {_HITS}, {_RRF}"


@query(f"with {_LEX} select term, df, (select n from st) as n, round((select avgdl from st), 9) as avgdl from df")
def ret01_build_bm25(spark, d):
    index = bm25.build_bm25(chunks(spark, d))
    n, avgdl = index.corpus.first()
    return index.term_stats.select("term", "df", F.lit(n).alias("n"), F.round(F.lit(avgdl), 9).alias("avgdl"))


@query(f"with {_LEX} select query_id, rank, chunk_id, score from lex where rank <= {K}")
def ret02_bm25_topk(spark, d):
    return lexical(spark, d)


@query(f"""with {_LEX}, f as (select query_id, chunk_id, rank, score, source as spec_id, {KIND} as chunk_type, left(text, 240) as preview from lex join documents on doc_id = chunk_id where rank <= 60)
select query_id, row_number() over (partition by query_id order by rank)::int as place, chunk_id, spec_id, chunk_type, score, preview from f where chunk_type in ('text', 'table')
qualify place <= 10""")
def ret03_field_lookup(spark, d):
    c, path = chunks(spark, d), scratch_path(spark, "bm25")
    bm25.write_bm25(bm25.build_bm25(c), path)
    return bm25.field_lookup(questions(spark, d), bm25.read_bm25(spark, path), c)


@query(f"""with {_DEN50}, f as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from ds where label < 5)
select query_id, 'all' as which, rank, chunk_id, score from den where rank <= {K} union all select query_id, 'some', rank, chunk_id, score from f where rank <= {K}""")
def ret04_dense_topk(spark, d):
    asked_ = every_fiftieth(spark, d)
    some = dense.dense_topk(asked_, vectors(spark, d), K, spark.range(5).select(F.col("id").cast("int").alias("spec_id")))
    return dense.dense_topk(asked_, vectors(spark, d), K).withColumn("which", F.lit("all")).unionByName(some.withColumn("which", F.lit("some"))).select("query_id", "which", "rank", "chunk_id", "score")


@query()
def ret05_ann_topk(spark, d):
    return dense.ann_topk(every_fiftieth(spark, d), vectors(spark, d), K, 64)


@query(f"select count(*) as n_queries, least({K}, (select count(*) from embeddings)) * count(*) as n_wanted, true as recall_is_90 from embeddings where vec_id % 50 = 0", name="ret05_ann_recall")
def ret05_ann_recall(spark, d):
    """Recall of the approximate search over all its queries: at least 0.9 of the exact hits."""
    wanted = dense.dense_topk(every_fiftieth(spark, d), vectors(spark, d), K).select("query_id", "chunk_id")
    found = ret05_ann_topk(spark, d).select("query_id", "chunk_id", F.lit(1).alias("found"))
    both = wanted.join(found, ["query_id", "chunk_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_wanted"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_is_90"))


@query(f"""
with x as (select vec_id as chunk_id, unnest([16, 32, 64]) as dim, embedding from embeddings),
v as (select chunk_id, dim, list_slice(embedding, 1, dim)::double[] as e from x),
n as (select *, sqrt(list_inner_product(e, e)) as n from v),
s as (select a.chunk_id as query_id, a.dim, c.chunk_id, round(list_inner_product(a.e, c.e) / (a.n * c.n), 9) as score from n a join n c on a.dim = c.dim where a.chunk_id % 50 = 0)
select query_id, dim, row_number() over (partition by query_id, dim order by score desc, chunk_id)::int as rank, chunk_id, score from s qualify rank <= {K}""")
def ret06_dense_multidim(spark, d):
    return dense.dense_multidim(every_fiftieth(spark, d), vectors(spark, d), [16, 32, 64], K)


@query(_ALL + " select query_id, rank, chunk_id, fused_score, score_dense, score_sparse from fused")
def ret07_rrf(spark, d):
    return fusion.rrf(hits(spark, d))


@query(_ALL + """, m as (select query_id, chunk_id, min(rank * 100000 + list_no) as f from hits group by all)
select query_id, row_number() over (partition by query_id order by f, chunk_id)::int as place, chunk_id from m qualify place <= 15""")
def ret08_round_robin(spark, d):
    return fusion.round_robin(hits(spark, d), 15)


_SUBS = f"""
sub as (select query_id, chunk_id % 2 as sub, rank, chunk_id, score, 'd' as kind from den where rank <= {K} union all select query_id, chunk_id % 2, rank, chunk_id, score, 's' from lex where rank <= {K}),
sh as (select query_id, sub, sub + case kind when 's' then 10000 else 0 end as list_no, row_number() over (partition by query_id, sub, kind order by rank)::int as rank, chunk_id, case kind when 'd' then score end as score_dense, case kind when 's' then score end as score_sparse from sub)"""


def _subs(spark, d):
    order = Window.partitionBy("query_id", "sub").orderBy("rank")
    split = lambda df: df.withColumn("sub", (F.col("chunk_id") % 2).cast("int")).withColumn("rank", F.row_number().over(order))
    return split(nearest(spark, d)), split(lexical(spark, d))


@query(f"""with {_LEX}, {_DEN}, {_SUBS}, g as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as fused_score, min(list_no * 100000 + rank) as f, max(score_dense) as score_dense, max(score_sparse) as score_sparse from sh group by all)
select query_id, row_number() over (partition by query_id order by fused_score desc, f, chunk_id)::int as rank, chunk_id, fused_score, score_dense, score_sparse from g qualify rank <= 12""")
def ret09_hybrid(spark, d):
    return fusion.hybrid(*_subs(spark, d), top_n=12)


@query(f"""with {_LEX}, {_DEN}, {_SUBS}, g as (select query_id, sub, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as fused_score, min(list_no * 100000 + rank) as f from sh where sub <> 1 group by all),
h as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) as fused_score, min(list_no * 100000 + rank) as f from sh group by all),
a as (select query_id, sub::int as sub, row_number() over (partition by query_id, sub order by fused_score desc, f, chunk_id)::int as rank, chunk_id, fused_score from g),
b as (select query_id, -1 as sub, row_number() over (partition by query_id order by fused_score desc, f, chunk_id)::int as rank, chunk_id, fused_score from h)
select * from a where rank <= 8 union all select * from b where rank <= 12""")
def ret10_hybrid_by_facet(spark, d):
    facets, flat = fusion.hybrid_by_facet(*_subs(spark, d), pool=8, top_n=12, flat_only=1)
    return facets.select("query_id", "sub", "rank", "chunk_id", "fused_score").unionByName(flat.select("query_id", F.lit(-1).alias("sub"), "rank", "chunk_id", "fused_score"))


def _scores(found):
    """An outside score for most hits of most queries, from their numbers."""
    return found.where("query_id % 5 <> 0 and chunk_id % 4 <> 0").selectExpr("query_id", "chunk_id", "cast((chunk_id * 31 + query_id) % 97 as double) as score")


@query(_ALL + """, s as (select query_id, chunk_id, rank, fused_score, case when query_id % 5 <> 0 and chunk_id % 4 <> 0 then ((chunk_id * 31 + query_id) % 97)::double end as score_rerank from fused where rank <= 10),
k as (select *, max(score_rerank is not null) over (partition by query_id) as rated from s)
select query_id, row_number() over (partition by query_id order by case when rated then score_rerank else fused_score end desc nulls last, rank)::int as place, chunk_id, fused_score, score_rerank from k qualify place <= 5""")
def ret11_rerank(spark, d):
    found = kept(fused(spark, d), "fused")
    return fusion.rerank(found, _scores(found), 5)


@query(_ALL + """, s as (select query_id, chunk_id % 3 as sub, chunk_id, rank, coalesce(case when query_id % 5 <> 0 and chunk_id % 4 <> 0 then ((chunk_id * 31 + query_id) % 97)::double end, fused_score) as key from fused where rank <= 10),
p as (select *, row_number() over (partition by query_id, sub order by key desc, rank) as r from s),
m as (select query_id, chunk_id, min(r * 1000 + sub) as f from p where r <= 2 group by all)
select query_id, row_number() over (partition by query_id order by f, chunk_id)::int as place, chunk_id from m qualify place <= 4""")
def ret12_rerank_by_facet(spark, d):
    found = kept(fused(spark, d), "fused")
    joined = found.join(_scores(found).withColumnRenamed("score", "score_rerank"), ["query_id", "chunk_id"], "left").withColumn("sub", F.col("chunk_id") % 3)
    return fusion.rerank_by_facet(joined, 2, 4)


@query(_ALL + """, s as (select query_id, chunk_id, rank, round(fused_score + case when contains(lower(b.text), lang) then 0.1 else 0 end, 12) as boosted from fused join documents on doc_id = chunk_id join benchmark b on item_id = query_id where rank <= 10)
select query_id, row_number() over (partition by query_id order by boosted desc, rank)::int as place, chunk_id, boosted from s qualify place <= 6""")
def ret13_title_boost(spark, d):
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("q"))
    langs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    joined = fused(spark, d).join(words, "query_id").join(langs, "chunk_id")
    ready = joined.select("query_id", "chunk_id", "rank", "fused_score", F.lit(None).cast("double").alias("score_rerank"), F.array("lang").alias("terms"), F.col("q").alias("section_title"))
    return fusion.title_boost(ready, 0.1, 6)


_SQL_PARENT = PARENT.replace("doc_id div 8", "doc_id // 8").replace("as string", "as varchar")


@query(_ALL + f""", h as (select query_id, rank, chunk_id, {_SQL_PARENT.replace("source", "d.source")} as p from fused join documents d on doc_id = chunk_id where rank <= 10),
f as (select *, row_number() over (partition by query_id, p order by rank) as n from h),
c as (select {_SQL_PARENT} as p, doc_id, text, row_number() over (partition by {_SQL_PARENT} order by doc_id) - 1 as pos, max(n_chars * 8) over (partition by {_SQL_PARENT}) as chars from documents),
x as (select f.query_id, f.rank, f.chunk_id, c.doc_id, c.text, c.pos, c.chars > 9000 as long from f join c using (p) join c o on o.doc_id = f.chunk_id where f.n = 1 and (c.chars <= 9000 or abs(c.pos - o.pos) <= 1) and c.text <> ''),
t as (select query_id, rank, chunk_id, string_agg(text, chr(10) || chr(10) order by pos) as t, bool_or(long) as degraded from x group by all),
r as (select *, coalesce(sum(length(t)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as b from t)
select h.query_id, h.rank, h.chunk_id, left(t, (20000 - b)::bigint) as expanded_content, degraded from h left join r on h.query_id = r.query_id and h.rank = r.rank and r.b < 20000""")
def ret14_expand_to_section(spark, d):
    c = chunks(spark, d)
    found = fused(spark, d).join(c.select("chunk_id", "parent_section_id"), "chunk_id")
    return fusion.expand_to_section(found, c, window=1, max_chars=9000, budget=20_000)


@query(_ALL + " select distinct chunk_id, text as content from fused join documents on doc_id = chunk_id where rank <= 10 and text <> ''")
def ret15_fetch_content(spark, d):
    return fusion.fetch_content(fused(spark, d), chunks(spark, d))


_GLOSS = "with g as (select lower(string_split(text, ' ')[-1]) as normalized_term, doc_id as term, source as spec_id from documents where lang = 'en'), "


@query(_GLOSS + """q as (select item_id as query_id, unnest(list_distinct(list_transform(string_split(text, ' '), lambda x: lower(x)))) as normalized_term from benchmark),
m as (select query_id, normalized_term, term, spec_id, row_number() over (partition by query_id order by normalized_term, spec_id, term)::int as place from q join g using (normalized_term))
select query_id, place, normalized_term, spec_id, term from m where place <= 16""")
def ret16_glossary_lookup(spark, d):
    g = table(spark, d, "documents").where("lang = 'en'").selectExpr("lower(element_at(split(text, ' '), -1)) as normalized_term", "doc_id as term", "source as spec_id")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.split("text", " ").alias("candidates"))
    return fusion.glossary_lookup(q, g).select("query_id", "place", "normalized_term", "spec_id", "term")


@query("""
with t as (select item_id as query_id, 'src' || (item_id % 20) as spec_id, case when item_id % 3 = 0 then null else (item_id % 7)::varchar end as prefix from benchmark),
c as (select doc_id, source as spec_id, (doc_id % 7) || '.' || (doc_id % 3) as clause, lang from documents),
u as (select query_id, doc_id, clause, lang, row_number() over (partition by query_id order by doc_id) as n from t join c using (spec_id) where prefix is null or starts_with(clause, prefix)),
f as (select *, row_number() over (partition by query_id, clause order by n) as k from u where n <= 20)
select query_id, row_number() over (partition by query_id order by n)::int as place, clause as path, lang as section_title, doc_id as chunk_id from f where k = 1 qualify place <= 5""")
def ret17_toc(spark, d):
    targets = table(spark, d, "benchmark").selectExpr("item_id as query_id", "concat('src', cast(item_id % 20 as string)) as spec_id", "case when item_id % 3 = 0 then null else cast(item_id % 7 as string) end as prefix")
    c = chunks(spark, d).withColumn("section_path", T.section_path(F.col("clause")))
    return fusion.toc(targets, c, 5).select("query_id", "place", F.array_join("section_path", ".").alias("path"), "section_title", "chunk_id")


@query(_ALL + r""", a as (select item_id as query_id, 'see [' || (item_id % 12) || '] and [3][1] or [99], [1] ' || text as answer from benchmark),
m as (select query_id, i, regexp_extract_all(answer, '\[(\d+)\]', 1)[i]::int as rank from a, unnest(range(1, 6)) t(i)),
f as (select query_id, rank, min(i) as i from m group by all)
select f.query_id, row_number() over (partition by f.query_id order by i)::int as place, f.rank, chunk_id from f join fused using (query_id, rank) where f.rank <= 10""")
def ret18_resolve_citations(spark, d):
    answers = table(spark, d, "benchmark").selectExpr("item_id as query_id", "concat('see [', cast(item_id % 12 as string), '] and [3][1] or [99], [1] ', text) as answer")
    return fusion.resolve_citations(answers, fused(spark, d))


@query(_ALL + """, h as (select query_id, rank, '[' || source || ' §' || (doc_id % 7) || '.' || (doc_id % 3) || ']' || chr(10) || trim(case when doc_id % 5 = 0 then 'expanded' else text end) as seg from fused join documents on doc_id = chunk_id where rank <= 10),
r as (select *, sum(length(seg)) over (partition by query_id order by rank) as run from h)
select query_id, string_agg(seg, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context from r where run <= 12000 group by query_id""")
def ret19_assemble_context(spark, d):
    c = chunks(spark, d).select("chunk_id", "spec_id", T.section_path(F.col("clause")).alias("section_path"), "content", F.when(F.col("chunk_id") % 5 == 0, "expanded").alias("expanded_content"))
    return fusion.assemble_context(fused(spark, d).join(c, "chunk_id"), 12_000)


@query("""
with t as (select item_id, list_transform(string_split(text, ' '), lambda x: lower(trim(x))) as l, list_transform(string_split(text, ' '), lambda x: trim(x)) as w from benchmark),
a as (select item_id, w as s, ['Extra', 'extra', w[1], ' '] as m from t),
b as (select item_id, m, list_slice(list_filter(s, lambda x, i: x <> '' and list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i), 1, 4) as s from a),
c as (select item_id, list_concat(s, list_filter(m, lambda x: trim(x) <> '')) as s from b)
select item_id, array_to_string(list_filter(s, lambda x, i: list_position(list_transform(s, lambda y: lower(y)), lower(x)) = i), '|') as queries from c""")
def ret20_expand_queries(spark, d):
    w = F.split("text", " ")
    t = table(spark, d, "benchmark").select("item_id", w[0].alias("primary"), F.slice(w, 2, F.size(w)).alias("sub_queries"), F.array(F.lit("Extra"), F.lit("extra"), w[0], F.lit(" ")).alias("missing"))
    return fusion.expand_queries(t).select("item_id", F.array_join("queries", "|").alias("queries"))


