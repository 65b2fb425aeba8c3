"""Splitting of large tables and action lists.

Both are cut by expressions over the lines of a block, without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions.arrays import cut_at, let, packed, where_true
from corpuslens.operators.blocks import is_row, is_rule

#: The level of an action, ``- 2> …``.
LEVEL = r"^[ \t]*-[ \t]+(\d+)>\s"


def split_table(text: Column, cap: int, by_tokens: bool = False) -> Column:
    """Pieces of a table, each with its caption and header.

    The number of rows of a piece comes from the 95th percentile of their sizes;
    by_tokens packs rows by their own sizes instead, and cuts those over the
    budget. A table without a rule line, or rows, stays whole, or is cut by tokens.
    """
    none = F.array().cast("array<string>")
    full = lambda x: F.trim(x) != ""

    def parts(lines):
        rule = F.get(where_true(F.transform(lines, is_rule)), F.lit(0))
        captioned = ~is_row(lines[0])
        begin = F.when(captioned, 1).otherwise(0)
        header = F.filter(F.slice(lines, begin + 1, F.greatest(rule + 1 - begin, F.lit(0))), full)
        return F.struct(F.concat(F.when(captioned, F.array(lines[0], F.lit(""))).otherwise(none), header).alias("head"), F.coalesce(F.filter(F.slice(lines, rule + 2, F.size(lines)), full), none).alias("rows"))

    def sized(t):
        return F.struct(t["head"].alias("head"), t["rows"].alias("rows"), F.greatest(cap - T.n_tokens(F.array_join(t["head"], "\n")), F.lit(1)).alias("budget"), F.transform(t["rows"], T.n_tokens).alias("sizes"))

    def pieces(t):
        shown = lambda part: F.array_join(F.concat(t["head"], part), "\n")
        if by_tokens:
            pattern = F.concat(F.lit(rf"((?:{T.TOKEN})(?:\s*(?:{T.TOKEN})){{0,"), (t["budget"] - 1).cast("string"), F.lit("})"))
            cut = F.flatten(F.transform(t["rows"], lambda x, i: F.when(F.get(t["sizes"], i) > t["budget"], F.regexp_extract_all(x, pattern, F.lit(1))).otherwise(F.array(x))))
            made, whole = let(cut, lambda c: F.transform(cut_at(c, packed(F.transform(c, T.n_tokens), t["budget"])), shown)), T.split_tokens(text, cap)
        else:
            large = F.greatest(F.get(F.array_sort(t["sizes"]), F.greatest(F.floor(F.size(t["sizes"]) * F.lit(0.95)).cast("int") - 1, F.lit(0))), F.lit(1))
            groups = lambda each: F.transform(F.sequence(F.lit(0), F.size(t["rows"]) - 1, each), lambda a: shown(F.slice(t["rows"], a + 1, each)))
            made = let(F.greatest(F.floor(t["budget"] / large), F.lit(1)).cast("int"), lambda each: F.when(F.size(t["rows"]) <= each, F.array(text)).otherwise(groups(each)))
            whole = F.array(text)
        return F.when(F.size(t["rows"]) > 0, made).otherwise(whole)

    return F.when(text.isNotNull(), let(let(let(F.split(text, "\n"), parts), sized), pieces))


def force_split_table(text: Column, cap: int) -> Column:
    """Pieces of at most ``cap`` tokens, but for the header."""
    return split_table(text, cap, True)


def split_actions(text: Column, cap: int) -> Column:
    """Pieces of an action list: cut at its shallowest level, and where still over the cap at the next one, under the first line.

    Lines before the first cut go with the first piece. What can't be cut at a
    level is cut by tokens. A fold over the levels that the list has: in each round
    every piece that is still too large is cut at its shallowest level that is
    deeper than that of the round in which it was made.
    """
    rest = lambda lines, n: F.slice(lines, n + 1, F.greatest(F.size(lines), F.lit(1)))
    none = F.array().cast("array<string>")

    def piece(anchor: Column, lines: Column, above: Column, done: bool) -> Column:
        return F.struct(anchor.alias("anchor"), lines.alias("lines"), above.cast("int").alias("above"), F.lit(done).alias("done"))

    def finished(texts: Column) -> Column:
        return F.transform(texts, lambda x: piece(none, F.array(x), F.lit(0), True))

    def sized(p: Column) -> Column:
        whole = F.regexp_replace(F.array_join(F.concat(p["anchor"], p["lines"]), "\n"), r"\s+$", "")
        levels = F.transform(p["lines"], lambda x: F.regexp_extract(x, LEVEL, 1).try_cast("int"))
        return F.struct(p["anchor"].alias("anchor"), p["lines"].alias("lines"), p["above"].alias("above"), whole.alias("whole"), levels.alias("levels"))

    def placed(q: Column) -> Column:
        least = F.array_min(F.filter(q["levels"], lambda v: v > q["above"]))
        starts = let(least, lambda m: where_true(F.transform(q["levels"], lambda v: F.coalesce(v == m, F.lit(False)))))
        return F.struct(q["anchor"].alias("anchor"), q["lines"].alias("lines"), q["whole"].alias("whole"), least.alias("least"), starts.alias("starts"))

    def cut(q: Column) -> Column:
        under = F.size(q["anchor"]) > 0
        alone = F.array(piece(F.when(under, q["anchor"]).otherwise(F.slice(q["lines"], 1, 1)), F.when(under, q["lines"]).otherwise(rest(q["lines"], 1)), q["least"], False))

        def part(lines: Column) -> Column:
            kept = under | (T.n_tokens(F.array_join(lines, "\n")) <= cap)
            return piece(F.when(kept, q["anchor"]).otherwise(F.slice(lines, 1, 1)), F.when(kept, lines).otherwise(rest(lines, 1)), q["least"], False)

        begins = F.concat(F.array(F.lit(0)), rest(q["starts"], 1))
        several = F.transform(cut_at(q["lines"], begins), part)
        return F.when(q["least"].isNull(), finished(T.split_tokens(q["whole"], cap))).when(F.size(q["starts"]) == 1, alone).otherwise(several)

    def step(p: Column) -> Column:
        small = lambda q: F.when(q["whole"] == "", finished(none)).otherwise(finished(F.array(q["whole"])))
        work = let(sized(p), lambda q: F.when(T.n_tokens(q["whole"]) <= cap, small(q)).otherwise(let(placed(q), cut)))
        return F.when(p["done"], F.array(p)).otherwise(work)

    def fold(lines: Column) -> Column:
        depth = F.size(F.array_distinct(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, LEVEL, 1).try_cast("int")), lambda v: v.isNotNull())))
        start = F.array(piece(none, lines, F.lit(-1), False))
        return F.aggregate(F.sequence(F.lit(0), depth), start, lambda acc, _: F.flatten(F.transform(acc, step)), lambda acc: F.flatten(F.transform(acc, lambda p: p["lines"])))

    return F.when(text.isNotNull(), let(F.split(text, "\n"), fold))
