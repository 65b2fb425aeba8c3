"""Chunks of sections: packed blocks under a header, with ids from their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import ids
from corpuslens.functions import text as T
from corpuslens.functions.arrays import chars, cut_at, where_true
from corpuslens.operators import blocks as B
from corpuslens.operators import splitting as P
from corpuslens.operators.sections import flag_garbage, merge_siblings, sectionize

TARGET, CAP, OVERLAP = 250, 400, 50
#: Chunk type of each kind of block, the leading ones first.
TYPES = [("figure", "figure"), ("asn1", "asn1"), ("table", "table"), ("formula_block", "formula"), ("action_list", "action_list")]
SECTION = ["spec_id", "release", "section_ord"]


def chunk_type(kinds: Column) -> Column:
    """Type of a piece by the kinds in it."""
    out = F.lit("text")
    for kind, name in reversed(TYPES):
        out = F.when(F.array_contains(kinds, kind), name).otherwise(out)
    return out


def split_blocks(blocks: DataFrame, cap: int = CAP) -> DataFrame:
    """Blocks with those over the cap split by their kind: adds part (which orders the pieces) and whole."""
    large = (T.n_tokens(F.col("text")) > cap) & ~F.col("kind").isin("figure", "formula_block")
    marked = blocks.withColumn("whole", ~large)
    of = lambda kind: F.when(~F.col("whole") & (F.col("kind") == kind), F.col("text"))  # noqa: E731  the other texts don't go to Python
    native = F.when(F.col("whole"), F.array("text")).when(F.col("kind") == "asn1", B.split_asn1(F.col("text"))).otherwise(B.split_paragraph(F.col("text"), cap))
    pieces = F.coalesce(P.split_table(of("table"), cap), P.split_actions(of("action_list"), cap), native)
    # from a named column, Spark would infer a filter on its size, which makes all pieces twice
    return marked.select(*[c for c in marked.columns if c != "text"], F.posexplode(pieces).alias("part", "text"))


def piece_starts(items: Column, target: int, cap: int) -> Column:
    """Where pieces begin in an array of (kind, n, whole): flushed before one would pass the cap, after it reaches the target; figures and split blocks stand alone."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("shut"), F.lit("").alias("codes"))

    def step(acc, x):
        alone = (x["kind"] == "figure") | ~x["whole"] | (x["n"] > cap)
        new = acc["shut"] | alone | (acc["sum"] + x["n"] > cap)
        total = F.when(new, x["n"]).otherwise(acc["sum"] + x["n"])
        return F.struct(total.alias("sum"), (alone | (total >= target)).alias("shut"), F.concat(acc["codes"], F.when(new, "1").otherwise("0")).alias("codes"))

    return where_true(F.transform(chars(F.aggregate(items, start, step, lambda acc: acc["codes"])), lambda c: c == "1"))


def pack(blocks: DataFrame, target: int = TARGET, cap: int = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of each section packed into pieces: the section's keys, piece_ord, kinds, text, chunk_type, context of a figure.

    carry: more columns of the section, which are the same in all its blocks.
    """
    context = F.col("context") if "context" in blocks.columns else F.lit(None).cast("string").alias("context")
    row = F.struct("block_ord", "part", "kind", "text", T.n_tokens(F.col("text")).alias("n"), "whole", context)
    grouped = blocks.groupBy(*SECTION, *carry).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    each = grouped.select(*SECTION, *carry, F.posexplode(cut_at(F.col("_rows"), piece_starts(F.col("_rows"), target, cap))).alias("piece_ord", "_own"))
    kinds = F.transform("_own", lambda r: r["kind"])
    return each.select(
        *SECTION, *carry, "piece_ord", kinds.alias("kinds"), F.trim(F.array_join(F.transform("_own", lambda r: r["text"]), "\n\n")).alias("text"), chunk_type(kinds).alias("chunk_type"), F.get("_own", F.lit(0))["context"].alias("context"),
    )


def tail_tokens(text: Column, n: int) -> Column:
    """The last run of up to ``n`` tokens, from its first sentence start if it has one."""
    last = F.element_at(T.split_tokens(text, n), -1)
    cut = F.when(last.rlike(r"[.!?。！？]\s+"), F.regexp_extract(last, r"(?s)^.*?[.!?。！？]\s+(.*)$", 1)).otherwise(last)
    return F.when(T.n_tokens(text) <= n, text).otherwise(F.trim(cut))


def add_overlap(pieces: DataFrame, n: int = OVERLAP) -> DataFrame:
    """Text pieces with the end of the text piece before them (as it was) put in front."""
    order = Window.partitionBy(*SECTION).orderBy("piece_ord")
    before, kind = F.lag("text").over(order), F.lag("chunk_type").over(order)
    tail = F.when((F.col("chunk_type") == "text") & (F.col("_kind") == "text"), tail_tokens(F.col("_before"), n))
    joined = F.when((F.coalesce(F.col("_tail"), F.lit("")) != "") & ~F.col("text").startswith(F.col("_tail")), F.concat("_tail", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    ready = pieces.withColumns({"_before": before, "_kind": kind}).withColumn("_tail", tail)
    return ready.withColumn("text", joined).drop("_before", "_kind", "_tail")


def enforce_size(pieces: DataFrame, cap: int = CAP) -> DataFrame:
    """Pieces over 1.5 times the cap, but for figures, are split by force and marked (forced); sub_ord orders them."""
    over = (T.n_tokens(F.col("text")) > int(cap * 1.5)) & (F.col("chunk_type") != "figure")
    marked = pieces.withColumn("forced", over)
    table = P.force_split_table(F.when(F.col("forced") & (F.col("chunk_type") == "table"), F.col("text")), cap)
    parts = F.coalesce(table, F.when(F.col("forced"), T.split_tokens(F.col("text"), cap)).otherwise(F.array("text")))
    return marked.select(*[c for c in marked.columns if c != "text"], F.posexplode(parts).alias("sub_ord", "text"))


def with_context(blocks: DataFrame, chars: int = 600) -> DataFrame:
    """Blocks with the last paragraph before them in their section (context, cut; null if there is none)."""
    before = Window.partitionBy(*SECTION).orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last_value(F.when((F.col("kind") == "paragraph") & (F.trim("text") != ""), F.col("text")), F.lit(True)).over(before)
    return blocks.withColumn("context", F.left(last, F.lit(chars)))


def figure_context(blocks: DataFrame, chars: int = 600) -> DataFrame:
    """Figure blocks with their context."""
    return with_context(blocks, chars).where("kind = 'figure'")


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without those whose content came earlier in their section, or whose id came earlier in their document."""
    first = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("section_ord", "piece_ord", "sub_ord"))
    once = chunks.withColumn("_a", first("spec_id", "release", "section_ord", F.sha2("content", 256))).where("_a = 1")
    return once.withColumn("_b", first("spec_id", "release", "chunk_id")).where("_b = 1").drop("_a", "_b")


def build_chunks(docs: DataFrame, target: int = TARGET, cap: int = CAP, overlap: int = OVERLAP) -> DataFrame:
    """Documents (spec_id, release, text) as chunks in order, with content-derived ids."""
    sections = merge_siblings(flag_garbage(sectionize(docs)).where("drop_reason is null").drop("drop_reason"))
    about = ("clause", "section_title", "parent_section_chars")
    blocks = with_context(B.blockize(sections.select(*SECTION, "clause", "section_title", F.char_length("body").alias("parent_section_chars"), "body")))
    pieces = pack(split_blocks(blocks, cap), target, cap, about)
    if overlap > 0:
        pieces = add_overlap(pieces, overlap)
    sized = enforce_size(pieces, cap)
    head = T.section_header(F.col("spec_id"), F.col("clause"), F.col("section_title"))
    noted = T.formula_annotation(F.col("text"))
    plain = F.concat_ws("\n\n", head, F.trim("text"), F.nullif(noted, F.lit("")))
    content = F.when(F.col("chunk_type") == "figure", T.figure_content(head, T.figure_fields(F.col("text")), F.col("context"))).otherwise(plain)
    made = sized.withColumn("content", content)
    chunks = made.select(
        ids.chunk_id(F.col("spec_id"), F.col("clause"), F.col("content")).alias("chunk_id"), *SECTION, "piece_ord", "sub_ord", "chunk_type", "clause", T.section_path(F.col("clause")).alias("section_path"), "section_title",
        ids.parent_section_id(F.col("spec_id"), F.col("clause"), F.col("section_title")).alias("parent_section_id"), "parent_section_chars", "content", "forced",
    )
    return dedupe_chunks(chunks)


def chunk_stats(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts of a build: sections kept and dropped by reason (up to its colon), chunks by type: (kind, name, n)."""
    reason = F.coalesce(F.substring_index("drop_reason", ":", 1), F.lit("kept"))
    count = lambda df, kind: df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return count(sections.withColumn("name", reason), "section").unionByName(count(chunks.withColumn("name", F.col("chunk_type")), "chunk"))
