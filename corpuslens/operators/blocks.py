"""Blocks inside sections, and the splitting of those that are too large.

A section's lines are classed by patterns, then one pass over the array carries
what is open from line to line and numbers the blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.arrays import chars, cut_at, let, where_true
from corpuslens.operators.sections import strip

#: Lines of Markdown, and actions of procedures.
ROW = r"^[ \t]*\|.*\|[ \t\r]*$"
RULE = r"^[-:| \t\r]*-[-:| \t\r]*$"
IMAGE = r"^[ \t]*!\[[^\]]*\]\([^)]+\)[ \t\r]*$"
ACTION = r"^[ \t]*-[ \t]+[0-9]+>[ \t]"


def is_row(line: Column) -> Column:
    return line.rlike(ROW)


def is_rule(line: Column) -> Column:
    """The line under a table's header: nothing but dashes, colons, bars and spaces."""
    return line.rlike(RULE)


def is_caption(line: Column, what: str) -> Column:
    """Whether a line begins as a caption, ``Table 5.1-2``, perhaps with emphasis."""
    return line.rlike(rf"(?i)^[ \t*]*{what}[ \t]+[A-Z]?[0-9]")


def is_asn1(line: Column, mark: str) -> Column:
    """Whether a line has the mark in a comment."""
    return line.contains(mark) & F.contains(F.substring_index(line, mark, 1), F.lit("--"))


def line_classes(lines: Column) -> Column:
    """Array of struct for each line: what it may start, end or continue."""
    own = F.transform(lines, lambda x: F.struct(x.alias("line"), is_row(x).alias("row"), is_rule(x).alias("rule"), x.rlike(ACTION).alias("action"), (F.trim(x) == "").alias("blank")))

    def classes(every):
        def one(x, i):
            line = x["line"]
            ahead = lambda k, what: F.coalesce(F.get(every, i + k)[what], F.lit(False))
            ruled = ahead(1, "rule")
            return F.struct(
                line.alias("line"), is_asn1(line, "ASN1START").alias("asn1"), is_asn1(line, "ASN1STOP").alias("stop"), line.rlike(IMAGE).alias("image"), x["row"].alias("row"),
                (x["row"] & (x["rule"] | ruled | ahead(2, "rule"))).alias("table"), (x["rule"] | (x["row"] & ruled)).alias("ruled"),
                x["action"].alias("action"), (line.startswith("    ") | line.startswith("\t")).alias("indented"), x["blank"].alias("blank"),
                (~F.coalesce(F.get(every, i + 1)["blank"], F.lit(True)) & ~ahead(1, "action")).alias("then_text"), line.contains("$$").alias("math"), (F.size(F.split(line, r"\$\$")) > 2).alias("whole_math"),
                line.rlike("^#{1,6}[ \t]").alias("heading"), is_caption(line, "figure").alias("caption"), (is_caption(line, "table") & ahead(1, "row") & (ruled | ahead(2, "rule") | ahead(3, "rule"))).alias("titles"),
            )

        return F.transform(every, one)

    return let(own, classes)


#: A letter for each kind of block; a capital one where a block begins.
KINDS = {"asn1": "a", "figure": "i", "table": "t", "action_list": "l", "formula_block": "f", "paragraph": "p"}
#: Letters of what else is open from line to line: nothing, the caption line before a table, and a heading.
NONE, CAPTION, HEADING = "-", "c", "h"


def line_steps(classes: Column) -> Column:
    """What a line does to what is open, as far as it hangs on the line alone, so that the fold over the lines has little to do.

    fresh: the letter that it begins; first: that of its block; after: what is then
    open; goes: what it continues; shuts: what it continues and ends.
    """

    def begun(x):
        fresh = (
            F.when(x["asn1"], "a").when(x["image"], "i").when(x["table"], "t").when(x["action"], "l").when(x["math"], "f").when(x["titles"], CAPTION)
            .when(x["heading"], HEADING).otherwise("p")
        )
        return F.struct(fresh.alias("fresh"), x.alias("x"))

    def one(both):
        fresh, x = both["fresh"], both["x"]
        also = lambda test, code: F.when(test, code).otherwise("")
        closed = ((fresh == "a") & x["stop"]) | ((fresh == "f") & x["whole_math"]) | (fresh == HEADING)
        return F.struct(
            fresh.alias("fresh"), F.when(fresh == CAPTION, "T").when(fresh == HEADING, "P").otherwise(F.upper(fresh)).alias("first"), F.when(closed, NONE).otherwise(fresh).alias("after"),
            F.concat(
                F.lit(f"af{CAPTION}"), also(x["row"] | x["blank"], "t"), also(x["action"] | x["indented"] | (x["blank"] & ~x["then_text"]), "l"), also(~(x["image"] | x["heading"] | x["asn1"] | x["ruled"]), "i"),
            ).alias("goes"),
            F.concat(also(x["stop"], "a"), also(x["math"], "f")).alias("shuts"), x["blank"].alias("blank"), x["caption"].alias("caption"),
        )

    return F.transform(F.transform(classes, begun), one)


def block_codes(classes: Column) -> Column:
    """A letter for each line: the kind of its block, a capital one where the block begins.

    Precedence where nothing is open: ASN.1, image, table (with the caption line
    before it), action list, formula, heading, paragraph. A figure ends at its
    second blank line, or at the first after its caption.
    """
    start = F.struct(F.lit(NONE).alias("open"), F.lit(0).alias("blanks"), F.lit(False).alias("captioned"), F.lit("").alias("codes"))

    def step(acc, x):
        was = acc["open"]
        goes_on = F.contains(x["goes"], was) & ~((was == "i") & x["blank"] & ((acc["blanks"] >= 1) | acc["captioned"]))
        kept = F.when(was == CAPTION, "t").otherwise(was)
        on = F.struct(
            F.when(F.contains(x["shuts"], was), NONE).otherwise(kept).alias("open"), F.when(x["blank"], acc["blanks"] + 1).otherwise(0).alias("blanks"),
            ((was == "i") & (acc["captioned"] | x["caption"])).alias("captioned"), F.concat(acc["codes"], kept).alias("codes"),
        )
        letter = F.when((x["fresh"] == "p") & (was == "p"), "p").otherwise(x["first"])
        return F.when(goes_on, on).otherwise(F.struct(x["after"].alias("open"), F.lit(0).alias("blanks"), F.lit(False).alias("captioned"), F.concat(acc["codes"], letter).alias("codes")))

    return F.aggregate(line_steps(classes), start, step, lambda acc: acc["codes"])


def blockize(sections: DataFrame) -> DataFrame:
    """Sections as blocks: keys of the section, block_ord (from 1), kind, text. Blank blocks are left out."""
    keys = [c for c in sections.columns if c != "body"]
    kind_of = lambda code: reduce(lambda other, x: F.when(code == x[1].upper(), x[0]).otherwise(other), KINDS.items(), F.lit("paragraph"))
    # a blank body has blank blocks only; a filter on bodies would make each twice
    classed = sections.withColumn("_lines", F.split("body", "\n"))

    def tidy(run):
        text = lambda x: F.when(F.left(x, F.lit(1)).isin(*T.SPACES), F.regexp_replace(x, r"^(\s*\n)+", "")).otherwise(x)
        return let(F.rtrim(F.array_join(run, "\n"), F.lit(T.SPACES)), text)

    def runs(codes):
        begins = lambda c: c == F.upper(c)
        zipped = F.arrays_zip(F.filter(codes, begins).alias("code"), cut_at(F.col("_lines"), where_true(F.transform(codes, begins))).alias("run"))
        # blank ones go here: a filter on the rows would make each text twice
        made = F.transform(zipped, lambda b, i: F.struct((i + 1).alias("block_ord"), kind_of(b["code"]).alias("kind"), tidy(b["run"]).alias("text")))
        return F.filter(made, lambda b: b["text"] != "")

    each = classed.select(*keys, F.explode(let(chars(block_codes(line_classes(F.col("_lines")))), runs)).alias("_b"))
    return each.select(*keys, "_b.block_ord", "_b.kind", "_b.text")


# splitting


def split_asn1(text: Column) -> Column:
    """Pieces of an ASN.1 block at its top-level definitions, each between the marks; one definition stays whole."""
    lines = F.split(text, "\n")
    begins, ends = is_asn1(lines[0], "ASN1START"), is_asn1(F.element_at(lines, -1), "ASN1STOP")
    first, last = F.when(begins, lines[0]).otherwise("-- ASN1START"), F.when(ends, F.element_at(lines, -1)).otherwise("-- ASN1STOP")
    inner = F.slice(lines, F.when(begins, 2).otherwise(1), F.greatest(F.size(lines) - begins.cast("int") - ends.cast("int"), F.lit(0)))
    defines = lambda x: x.rlike(r"^\s*[A-Za-z][\w-]*\s.{0,100}::= ") | x.rlike(r"^\s*[A-Za-z][\w-]* ::= ")
    at = F.filter(F.transform(inner, lambda x, i: F.when((i > 0) & defines(x), i)), lambda i: i.isNotNull())
    pieces = F.transform(cut_at(inner, F.concat(F.array(F.lit(0)), at)), lambda part: F.regexp_replace(F.array_join(F.concat(F.array(first), part, F.array(last)), "\n"), r"\s+$", ""))
    return F.when(F.size(at) > 0, pieces).otherwise(F.array(text))


def split_paragraph(text: Column, cap: int) -> Column:
    """Pieces of a long paragraph: whole paragraphs between blank lines, else sentences, else runs of tokens, packed up to the cap."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: strip(p)), lambda p: p != "")
    sentences = lambda p: F.filter(F.transform(F.split(p, r"(?<=[.!?。！？])\s+"), lambda s: strip(s)), lambda s: s != "")
    hard = lambda s: F.when(T.n_tokens(s) > cap, T.split_tokens(s, cap)).otherwise(F.array(s))
    unit = lambda group: (lambda u: F.struct(group.alias("group"), u.alias("text"), T.n_tokens(u).alias("n")))
    units = F.flatten(F.transform(
        paragraphs, lambda p, i: F.when(T.n_tokens(p) <= cap, F.array(unit(F.lit(-1))(p))).otherwise(F.transform(F.flatten(F.transform(sentences(p), hard)), unit(i))),
    ))
    start = F.struct(F.lit(-2).alias("group"), F.lit(0).alias("n"), F.lit("").alias("codes"))

    def step(acc, u):
        joins = (acc["group"] == u["group"]) & (acc["n"] + u["n"] <= cap)
        return F.struct(
            u["group"].alias("group"), F.when(joins, acc["n"] + u["n"]).otherwise(u["n"]).alias("n"), F.concat(acc["codes"], F.when(joins, "0").otherwise("1")).alias("codes"),
        )

    def pieces(every):
        starts = where_true(F.transform(chars(F.aggregate(every, start, step, lambda acc: acc["codes"])), lambda c: c == "1"))
        texts = lambda run, glue: F.array_join(F.transform(run, lambda u: u["text"]), glue)
        return F.transform(cut_at(every, starts), lambda run: F.when(run[0]["group"] == -1, texts(run, "\n\n")).otherwise(texts(run, " ")))

    return let(units, pieces)
