"""Lexical index and retrieval for a table of queries (BM25)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.sources.scratch import kept

K1, B = 1.5, 0.75

#: English words that carry no meaning of their own.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)


def terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-case words of two letters or digits and more, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\pL\pN]{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(stop_words))


@dataclass
class Bm25Index:
    """postings (term, chunk_id, tf, dl), term_stats (term, df), corpus (n, avgdl)."""

    postings: DataFrame
    term_stats: DataFrame
    corpus: DataFrame


#: No term; a chunk's row of its own, so that n and the mean length come from the same pass as the counts.
MARK = ""

#: Chunks whose counts one task holds: the tasks grow in number with the chunks, not in size.
CHUNKS_PER_TASK = 8192

#: Scores that one task of a search holds, as a chunk may have one for each query.
SCORES_PER_TASK = 1 << 18

#: Tasks of a search at most; beyond, their scores are spilled.
MOST_TASKS = 20_000


def _tasks(spark: SparkSession, n: int, queries: int = 0) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // CHUNKS_PER_TASK), min(MOST_TASKS, -(-n * queries // SCORES_PER_TASK)))


def _split(chunks: DataFrame, id_col: str, text_col: str, stop_words: list[str], queries: int = 0) -> DataFrame:
    """Words of each chunk. Whole texts are dealt out, so that words are counted where they are split and only texts are shuffled."""
    texts = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))
    return texts.repartition(_tasks(chunks.sparkSession, texts.count(), queries), "chunk_id").select("chunk_id", terms(F.col("text"), stop_words).alias("words"))


def _marked(split: DataFrame) -> DataFrame:
    return split.select("chunk_id", F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit(MARK)), "words")).alias("term"))


def _counted(words: DataFrame) -> DataFrame:
    return words.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def build_bm25(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", stop_words: list[str] = STOP_WORDS) -> Bm25Index:
    """Index of all chunks, split and counted once. Chunks without words count for n and the mean length, and have no postings."""
    split = _split(chunks, id_col, text_col, stop_words)
    counted = kept(_counted(_marked(split)), "index")
    postings = counted.where(F.col("term") != MARK)
    term_stats = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    corpus = counted.where(F.col("term") == MARK).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return Bm25Index(postings.select("term", "chunk_id", "tf", "dl"), term_stats, corpus)


def write_bm25(index: Bm25Index, path: str) -> None:
    """Keep an index. Postings are laid out by term, so that a search reads the row groups of its terms."""
    n = index.corpus.first()["n"]
    index.postings.repartitionByRange(_tasks(index.postings.sparkSession, n), "term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read_bm25(spark: SparkSession, path: str) -> Bm25Index:
    """An index that was kept."""
    return Bm25Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "term_stats", "corpus")])


#: Terms of a batch of queries up to which they are broadcast: some 60 bytes each.
BROADCAST_TERMS = 200_000


def _asked(queries: DataFrame, query_id: str, text_col: str, stop_words: list[str]) -> tuple[DataFrame, int, Callable[[DataFrame], DataFrame]]:
    """Terms of each query (query_id, term, qtf), the number of queries with any, and a hint for what is no larger than the terms."""
    words = queries.select(F.col(query_id).alias("query_id"), F.explode(terms(F.col(text_col), stop_words)).alias("term"))
    asked = kept(words.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")), "asked")
    n_terms, n_queries = asked.agg(F.count(F.lit(1)), F.count_distinct("query_id")).first()
    return asked, n_queries, F.broadcast if n_terms <= BROADCAST_TERMS else lambda df: df


def _ranked(asked: DataFrame, n_queries: int, hint: Callable[[DataFrame], DataFrame], postings: DataFrame, stats: DataFrame, n: int, avgdl: float | None, k: int) -> DataFrame:
    idf = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl or 1.0)))
    weighed = asked.join(stats, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))
    # a chunk's terms stay together, so that a task has all of its scores and only the k best of a query leave it
    near = postings.join(hint(asked.select("term").distinct()), "term", "left_semi").repartition(_tasks(asked.sparkSession, n, n_queries), "chunk_id")
    scored = near.join(hint(weighed), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * tf), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def bm25_topk(queries: DataFrame, index: Bm25Index, k: int, query_id: str = "query_id", text_col: str = "text", max_df: int | None = None, stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """The k best chunks of each query: query_id, rank, chunk_id, score.

    A term asked twice counts twice. Equal scores go by chunk id. Terms in more
    than ``max_df`` chunks are left out if that is given. A batch of few terms is
    sent to the postings, so no frequent term gathers its postings in one task.
    """
    asked, n_queries, hint = _asked(queries, query_id, text_col, stop_words)
    stats = index.term_stats if max_df is None else index.term_stats.where(F.col("df") <= max_df)
    n, avgdl = index.corpus.first()
    return _ranked(asked, n_queries, hint, index.postings, stats, n, avgdl, k)


def bm25_search(queries: DataFrame, chunks: DataFrame, k: int, id_col: str = "chunk_id", content_col: str = "content", query_id: str = "query_id", text_col: str = "text", stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """The same for chunks without an index: one pass over the texts, in which only the asked terms are counted."""
    asked, n_queries, hint = _asked(queries, query_id, text_col, stop_words)
    wanted = asked.select("term").distinct().unionByName(asked.sparkSession.createDataFrame([(MARK,)], "term string"))
    near = _marked(_split(chunks, id_col, content_col, stop_words, n_queries)).join(hint(wanted), "term", "left_semi")
    found = kept(_counted(near), "found")
    n, avgdl = found.where(F.col("term") == MARK).agg(F.count(F.lit(1)), F.avg("dl")).first()
    postings = found.where(F.col("term") != MARK)
    return _ranked(asked, n_queries, hint, postings, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), n, avgdl, k)


def field_lookup(queries: DataFrame, index: Bm25Index, chunks: DataFrame, over: int = 60, keep: int = 10, types: tuple[str, ...] = ("text", "table"), chars: int = 240) -> DataFrame:
    """Best ``keep`` chunks of the given types among the ``over`` best of all, with a preview."""
    hits = bm25_topk(queries, index, over)
    found = hits.join(chunks.select("chunk_id", "spec_id", "chunk_type", "content"), "chunk_id").where(F.col("chunk_type").isin(*types))
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
        .select("query_id", "place", "chunk_id", "spec_id", "chunk_type", "score", F.left("content", F.lit(chars)).alias("preview"))
    )
