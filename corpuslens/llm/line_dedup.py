"""Removal of lines that many documents share.

Texts are split at line feeds. A line's key is the line without ASCII white
space at its ends and with A-Z in lower case. Keys of at least ``min_chars`` code
points are hashed (128 bits of SHA-256) and the documents that hold each are
counted; a key found in ``min_docs`` documents or more keeps its lines in the
document with the largest id only. The positions of the lines to go are gathered
for each text and the others are joined again in their order.

Only hashes, ids and positions are shuffled for counting, combined before they
move, so a line that a third of all documents holds is one row of each task. The
table of keys over the threshold is broadcast where its counted size allows it;
else the keys that most documents hold are, and the rest, each of a bounded number
of documents, is joined. Texts move only in the join with their own positions, and
not at all where these are few enough to be broadcast.

Null texts count as empty, and an empty text is one empty line. Documents are told
apart by id: rows that share an id are one document for the count, but each row
gives one row of the result. A row without an id is never counted and never the
one that keeps a line. All of this is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.arrays import let
from corpuslens.llm.common import stored

MIN_CHARS, MIN_DOCS = 40, 5
#: Largest table that is broadcast, by its rows' own bytes.
BROADCAST_BYTES = 32 << 20

SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), _UPPER, _LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _hashed(key: Column) -> Column:
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line whose key is long enough: id, digest of the whole text, at (position from 0), key (hash)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = texts.select("id", F.sha2("text", 256).alias("digest"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    keyed = lines.select("id", "digest", "at", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).withColumn("key", _hashed(F.col("key")))


def shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys of ``lines`` in at least ``min_docs`` documents: key, n_docs, last (the largest id)."""
    return lines.groupBy("key").agg(F.count_distinct("id").alias("n_docs"), F.max("id").alias("last")).where(F.col("n_docs") >= min_docs)


def _with_keys(lines: DataFrame, keys: DataFrame, broadcast_bytes: int) -> DataFrame:
    """Lines whose key is one of ``keys``; keys of many documents never meet in one task."""
    above, row_bytes = 0, 16 + 8 + 8
    while (keys.where(F.col("n_docs") > above).count()) * row_bytes > broadcast_bytes:
        above = max(10, above * 10)
    common = F.broadcast(keys.where(F.col("n_docs") > above))
    found = lines.join(common, "key")
    if not above:
        return found
    return found.unionByName(lines.join(common, "key", "left_anti").join(keys.where(F.col("n_docs") <= above), "key"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per row of ``docs``: its id, n_lines, n_dropped, kept_text."""
    lines = long_lines(docs, id_col, text_col, min_chars)
    keys = stored(shared_keys(lines, min_docs), "keys")
    gone = _with_keys(lines, keys, broadcast_bytes).where(~F.col("id").eqNullSafe(F.col("last")))
    # a text's lines bound its set of positions, however many rows repeat it
    places = stored(gone.groupBy(F.col("id").alias("of_id"), F.col("digest").alias("of_digest")).agg(F.collect_set("at").alias("gone")), "places")
    size = places.agg(F.sum(F.size("gone") * 4 + 80)).first()[0] or 0

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest"))
    joined = texts.join(F.broadcast(places) if size <= broadcast_bytes else places, same, "left")

    def kept(both: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(both["lines"]) - 1), both["gone"])
        return F.array_join(F.transform(stay, lambda i: F.get(both["lines"], i)), "\n")

    lines_of = F.split("text", "\n", -1)
    return joined.select(
        F.col("id").alias(id_col), F.size(lines_of).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.struct(lines_of.alias("lines"), F.col("gone")), kept)).alias("kept_text"),
    )
