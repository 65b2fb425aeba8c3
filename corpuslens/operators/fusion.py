"""Fusion, re-ranking and expansion of ranked lists, for all queries at once.

Hits are rows (query_id, list_no, rank, chunk_id, …): the place in a list is a
column. Facets are parts of a query with lists of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rrf(hits: DataFrame, k: int = 60, top_n: int | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal rank fusion: by, rank, chunk_id, fused_score, score_dense, score_sparse.

    Of the scores the first that isn't null stays, in the order of lists and
    ranks; equal sums keep that order too.
    """
    place = F.struct("list_no", "rank")
    parts = F.array_sort(F.collect_list(F.struct("list_no", "rank")))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + 1.0 / (k + x["rank"]))
    fused = hits.groupBy(*by, "chunk_id").agg(
        F.round(total, 12).alias("fused_score"), F.min(place).alias("_first"),
        F.min_by("score_dense", F.when(F.col("score_dense").isNotNull(), place)).alias("score_dense"),
        F.min_by("score_sparse", F.when(F.col("score_sparse").isNotNull(), place)).alias("score_sparse"),
    )
    order = Window.partitionBy(*by).orderBy(F.desc("fused_score"), "_first", "chunk_id")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    if top_n is not None:
        ranked = ranked.where(F.col("rank") <= top_n)
    return ranked.select(*by, "rank", "chunk_id", "fused_score", "score_dense", "score_sparse")


def round_robin(ranked: DataFrame, budget: int) -> DataFrame:
    """Merge lists tier by tier: (query_id, list_no, rank, chunk_id) → query_id, place, chunk_id.

    A chunk counts where it comes first; budget ≤ 0 keeps all.
    """
    firsts = ranked.groupBy("query_id", "chunk_id").agg(F.min(F.struct("rank", "list_no")).alias("_first"))
    placed = firsts.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_first", "chunk_id")))
    return (placed if budget <= 0 else placed.where(F.col("place") <= budget)).select("query_id", "place", "chunk_id")


def as_hits(dense: DataFrame, sparse: DataFrame, list_no: Column) -> DataFrame:
    """Dense and lexical results (query_id, sub, rank, chunk_id, score) as lists; all dense ones come first."""
    d = dense.select("query_id", "sub", list_no.alias("list_no"), "rank", "chunk_id", F.col("score").alias("score_dense"), F.lit(None).cast("double").alias("score_sparse"))
    s = sparse.select("query_id", "sub", (list_no + 10_000).alias("list_no"), "rank", "chunk_id", F.lit(None).cast("double").alias("score_dense"), F.col("score").alias("score_sparse"))
    return d.unionByName(s)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int = 60, top_n: int = 50) -> DataFrame:
    """One pool for each query from all its sub-queries (sub: their number)."""
    return rrf(as_hits(dense, sparse, F.col("sub")), k, top_n)


def hybrid_by_facet(dense: DataFrame, sparse: DataFrame, k: int = 60, pool: int = 20, top_n: int = 50, flat_only: int = -1) -> tuple[DataFrame, DataFrame]:
    """A pool for each facet (sub), and one for the query; the sub ``flat_only`` counts for the latter only."""
    hits = as_hits(dense, sparse, F.col("sub"))
    facets = rrf(hits.where(F.col("sub") != flat_only), k, pool, by=("query_id", "sub"))
    return facets, rrf(hits, k, top_n)


def rerank(hits: DataFrame, scores: DataFrame, top_k: int) -> DataFrame:
    """Order by an external score (query_id, chunk_id, score); queries without any keep the fused order."""
    joined = hits.join(scores.select("query_id", "chunk_id", F.col("score").alias("score_rerank")), ["query_id", "chunk_id"], "left")
    some = F.max(F.col("score_rerank").isNotNull()).over(Window.partitionBy("query_id"))
    key = F.when(some, F.col("score_rerank")).otherwise(F.col("fused_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("_key"), "rank")
    return (
        joined.withColumn("_key", key).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k)
        .select("query_id", "place", "chunk_id", "fused_score", "score_rerank")
    )


def rerank_by_facet(hits: DataFrame, m: int, budget: int) -> DataFrame:
    """The m best of each facet (query_id, sub, rank, chunk_id, fused_score, score_rerank), merged in turn."""
    order = Window.partitionBy("query_id", "sub").orderBy(F.coalesce("score_rerank", "fused_score").desc(), "rank")
    best = hits.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= m)
    return round_robin(best.select("query_id", F.col("sub").alias("list_no"), F.col("_place").alias("rank"), "chunk_id"), budget)


def title_boost(hits: DataFrame, weight: float = 0.1, top_k: int = 10) -> DataFrame:
    """Add a weight where a salient term of the query (terms) is in the section title; the earlier rank breaks ties."""
    named = F.exists("terms", lambda t: F.contains(F.lower(F.coalesce("section_title", F.lit(""))), t))
    boosted = F.round(F.coalesce("score_rerank", "fused_score", F.lit(0.0)) + F.when(named, weight).otherwise(0.0), 12)
    order = Window.partitionBy("query_id").orderBy(F.desc("boosted"), "rank")
    return hits.withColumn("boosted", boosted).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_k).select("query_id", "place", "chunk_id", "boosted")


def expand_to_section(hits: DataFrame, chunks: DataFrame, window: int = 2, max_chars: int = 8000, budget: int = 24_000) -> DataFrame:
    """Replace hits by their sections: query_id, rank, chunk_id, expanded_content, degraded.

    hits: (query_id, rank, chunk_id, parent_section_id). Of the hits of one
    section the best alone is expanded. A section of over ``max_chars`` is cut
    to ``window`` neighbours on each side. Sections fill the budget by rank; the
    one that passes it is cut, later ones stay as they are (null).
    """
    known = F.coalesce(F.trim("parent_section_id"), F.lit("")) != ""
    first = Window.partitionBy("query_id", "parent_section_id").orderBy("rank")
    heads = hits.where(known).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    wanted = heads.select("parent_section_id").distinct()
    sections = chunks.join(wanted, "parent_section_id", "left_semi")
    by_order = Window.partitionBy("parent_section_id").orderBy("document_order", "chunk_id")
    placed = sections.select(
        "parent_section_id", F.col("chunk_id").alias("_id"), "content", (F.row_number().over(by_order) - 1).alias("_pos"),
        F.max(F.coalesce("parent_section_chars", F.lit(0))).over(Window.partitionBy("parent_section_id")).alias("_chars"),
    )
    own = placed.select("parent_section_id", F.col("_id").alias("chunk_id"), F.col("_pos").alias("_hit"))
    at = heads.join(own, ["parent_section_id", "chunk_id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    near = at.join(placed, "parent_section_id")
    long_ = (F.col("_chars") > max_chars) & F.lit(max_chars > 0)
    near = near.where(~long_ | (F.abs(F.col("_pos") - F.col("_hit")) <= window)).where(F.coalesce("content", F.lit("")) != "")
    texts = near.groupBy("query_id", "rank", "chunk_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "content"))), lambda x: x["content"]), "\n\n").alias("_text"),
        F.max(long_).alias("degraded"),
    )
    before = F.coalesce(F.sum(F.char_length("_text")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fitted = texts.withColumn("_before", before).where(F.col("_before") < budget).select(
        "query_id", "rank", "chunk_id", F.left("_text", (F.lit(budget) - F.col("_before")).cast("int")).alias("expanded_content"), "degraded"
    )
    return hits.select("query_id", "rank", "chunk_id").join(fitted, ["query_id", "rank", "chunk_id"], "left")


def fetch_content(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """Content of chunks by id; those missing or empty are left out."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").where(F.coalesce("content", F.lit("")) != "").select("chunk_id", "content")


def glossary_lookup(queries: DataFrame, glossary: DataFrame, most: int = 16) -> DataFrame:
    """Entries for the candidate terms of each query: (query_id, candidates) ⋈ glossary."""
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform("candidates", F.lower))).alias("normalized_term"))
    order = Window.partitionBy("query_id").orderBy("normalized_term", "spec_id", "term")
    return asked.join(glossary, "normalized_term").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def toc(targets: DataFrame, chunks: DataFrame, most: int = 60) -> DataFrame:
    """Sections under a clause prefix: (query_id, spec_id, prefix) → query_id, place, section_path, section_title, chunk_id.

    The first 4 · most chunks are looked at; of these the first of each path stays.
    """
    under = targets.join(chunks, "spec_id").where(F.col("prefix").isNull() | F.startswith("clause", "prefix"))
    order = Window.partitionBy("query_id").orderBy("document_order", "chunk_id")
    seen = under.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 4 * most)
    first = seen.withColumn("_f", F.row_number().over(Window.partitionBy("query_id", "section_path").orderBy("_n"))).where("_f = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_n"))).where(F.col("place") <= most).select("query_id", "place", "section_path", "section_title", "chunk_id")


def resolve_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Marks [N] of answers as rows of hits: query_id, place (order of first mention), rank (N), chunk_id."""
    marks = answers.select("query_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("at", "mark"))
    first = marks.withColumn("rank", F.col("mark").try_cast("int")).groupBy("query_id", "rank").agg(F.min("at").alias("at"))
    found = first.join(hits.select("query_id", "rank", "chunk_id"), ["query_id", "rank"])
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).select("query_id", "place", "rank", "chunk_id")


def assemble_context(hits: DataFrame, max_chars: int = 32_000) -> DataFrame:
    """One text for each query from its hits (rank, spec_id, section_path, content, expanded_content).

    Segments are taken whole, up to the first that would pass the limit.
    """
    body = F.trim(F.coalesce(F.nullif("expanded_content", F.lit("")), F.col("content"), F.lit("")))
    where = F.concat(F.coalesce("spec_id", F.lit("")), F.lit(" §"), F.coalesce(F.array_join("section_path", "."), F.lit("")))
    head = F.when(where != " §", F.concat(F.lit("["), where, F.lit("]"))).otherwise("[chunk]")
    segments = hits.withColumn("_body", body).where("_body <> ''").withColumn("_seg", F.concat(head, F.lit("\n"), F.col("_body")))
    running = F.sum(F.char_length("_seg")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    fit = segments.withColumn("_run", running).where(F.col("_run") <= max_chars)
    return fit.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_seg"))), lambda x: x["_seg"]), "\n\n---\n\n").alias("context"))


def expand_queries(df: DataFrame, most: int = 3) -> DataFrame:
    """Sub-queries of each query: primary first, distinct but for case, then missing aspects.

    Columns primary, sub_queries and missing (arrays) → queries. At most ``most``
    sub-queries; missing aspects have no limit.
    """
    from corpuslens.functions.text import distinct_ignoring_case

    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda y: F.trim(y)), lambda x: x != "")
    merged = F.slice(distinct_ignoring_case(F.concat(F.array("primary"), tidy(F.col("sub_queries")))), 1, 1 + most)
    return df.withColumn("queries", distinct_ignoring_case(F.concat(merged, tidy(F.col("missing")))))
