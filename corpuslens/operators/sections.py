"""Sections of documents: cut at headings, judged, and merged with short neighbours.

Cutting stays inside a document's row (arrays of lines), so it needs no shuffle;
only merging brings a document's sections together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.arrays import cut_at, packed

HEADING = r"^(#{1,6})\s+(.*?)\s*$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(T.SPACES))


def sectionize(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents (spec_id, release, text) as sections in order.

    A heading is a line of its own; pseudo headings are text. A level-1 heading
    that comes first and is the only one is the document's title and no section.
    Text before the first section is one of level 0, ``<preamble>``, if it isn't
    blank. Null texts have no sections.
    """
    lines = F.split(F.col(text_col), "\n")
    heads = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.length(F.regexp_extract(x, HEADING, 1)).alias("level"), F.regexp_extract(x, HEADING, 2).alias("raw"))),
        lambda h: (h["level"] > 0) & ~T.is_pseudo_heading(h["raw"]),
    )
    base = docs.withColumns({"_lines": lines, "_heads": heads})
    titled = (F.get("_heads", F.lit(0))["level"] == 1) & (F.size(F.filter("_heads", lambda h: h["level"] == 1)) == 1)
    base = base.withColumn("_titled", F.coalesce(titled, F.lit(False)))
    own = F.when(F.col("_titled"), F.slice("_heads", 2, F.greatest(F.size("_heads"), F.lit(1)))).otherwise(F.col("_heads"))
    base = base.withColumn("_own", own)
    begin = F.when(F.col("_titled"), F.get("_heads", F.lit(0))["at"] + 1).otherwise(F.lit(0))
    piece = lambda a, b: strip(F.array_join(F.slice("_lines", a + 1, F.greatest(b - a, F.lit(0))), "\n"))
    first = F.struct(F.lit(0).alias("level"), F.lit("<preamble>").alias("raw"), piece(begin, F.coalesce(F.get("_own", F.lit(0))["at"], F.size("_lines"))).alias("body"))
    rest = F.transform(
        "_own", lambda h, i: F.struct(h["level"].alias("level"), h["raw"].alias("raw"), piece(h["at"] + 1, F.coalesce(F.get("_own", i + 1)["at"], F.size("_lines"))).alias("body"))
    )
    all_ = F.concat(F.when(first["body"] != "", F.array(first)).otherwise(F.array().cast("array<struct<level:int,raw:string,body:string>>")), rest)
    split = base.select("spec_id", "release", F.posexplode(all_).alias("section_ord", "s"))
    parts = T.split_clause(F.col("s.raw"))
    preamble = F.col("s.level") == 0
    return split.select(
        "spec_id", "release", "section_ord", F.when(preamble, "").otherwise(parts["clause"]).alias("clause"), F.when(preamble, F.col("s.raw")).otherwise(parts["title"]).alias("section_title"),
        F.col("s.level").alias("section_level"), F.col("s.body").alias("body"), F.char_length("s.body").alias("body_chars"), T.image_refs(F.col("s.body")).alias("image_refs"),
    )


def flag_garbage(sections: DataFrame) -> DataFrame:
    """Sections with the reason why each is dropped (null: kept)."""
    return sections.withColumn("drop_reason", T.garbage_reason(F.col("clause"), F.col("section_title"), F.col("body")))


def merge_siblings(sections: DataFrame, short: int = 200, cap: int = 400) -> DataFrame:
    """Merge runs of neighbouring short sections under one parent clause, up to ``cap`` tokens.

    A merged section has the parent's clause, a title that lists what was merged,
    and the parts' headings in its body; n_merged tells their number.
    """
    order = Window.partitionBy("spec_id", "release").orderBy("section_ord")
    tokens = T.n_tokens(F.col("body"))
    fits = (F.col("clause") != "") & ~F.col("section_title").startswith("<") & F.col("clause").contains(".") & (tokens < short)
    parent = F.when(fits, T.parent_clause(F.col("clause")))
    marked = sections.withColumns({"_parent": parent, "_tokens": tokens})
    breaks = F.when(F.col("_parent").isNotNull() & F.col("_parent").eqNullSafe(F.lag("_parent").over(order)), 0).otherwise(1)
    islands = marked.withColumn("_island", F.sum(breaks).over(order))
    row = F.struct("section_ord", "clause", "section_title", "section_level", "body", "image_refs", "_tokens")
    grouped = islands.groupBy("spec_id", "release", "_island", "_parent").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    starts = packed(F.transform("_rows", lambda r: r["_tokens"]), cap)
    part = grouped.select("spec_id", "release", "_parent", F.explode(cut_at(F.col("_rows"), starts)).alias("_part"))
    one = F.col("_part")[0]
    many = F.size("_part") > 1

    def child(r):
        head = F.rtrim(F.concat(F.repeat(F.lit("#"), F.greatest(r["section_level"], F.lit(1))), F.lit(" "), r["clause"], F.lit(" "), r["section_title"]))
        return F.when(F.trim(r["body"]) != "", F.concat(head, F.lit("\n\n"), F.rtrim(r["body"]))).otherwise(head)

    title = F.concat(F.lit("<merged: "), F.array_join(F.transform("_part", lambda r: r["clause"]), " / "), F.lit(">"))
    body = F.when(many, F.array_join(F.transform("_part", child), "\n\n")).otherwise(one["body"])
    return part.select(
        "spec_id", "release", one["section_ord"].alias("section_ord"), F.when(many, F.col("_parent")).otherwise(one["clause"]).alias("clause"), F.when(many, title).otherwise(one["section_title"]).alias("section_title"),
        F.when(many, F.greatest(one["section_level"] - 1, F.lit(1))).otherwise(one["section_level"]).alias("section_level"), body.alias("body"), F.flatten(F.transform("_part", lambda r: r["image_refs"])).alias("image_refs"),
        F.size("_part").alias("n_merged"),
    )
