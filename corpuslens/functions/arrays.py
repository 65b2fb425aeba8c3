"""Expressions over arrays that are read once from left to right.

A fold writes one character for each item instead of growing an array, which
would be copied whole at every step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used, also inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def where_true(flags: Column) -> Column:
    """Positions (from 0) of the items that are true, in order."""
    return F.filter(F.transform(flags, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())


def chars(codes: Column) -> Column:
    """The characters of a text of plain letters, as an array."""
    return F.when(codes == "", F.array().cast("array<string>")).otherwise(F.split(codes, "(?!^)"))


def cut_at(items: Column, starts: Column) -> Column:
    """Runs of ``items`` from each position (from 0, ascending) to the next."""
    def runs(both):
        return F.transform(both["at"], lambda a, i: F.slice(both["all"], a + 1, F.coalesce(F.get(both["at"], i + 1), F.size(both["all"])) - a))

    return let(F.struct(items.alias("all"), starts.alias("at")), runs)


def packed(sizes: Column, cap: Column | int) -> Column:
    """Positions where a new run begins if runs are closed before the sum of their sizes passes ``cap``."""
    start = F.struct(F.lit(-1).alias("sum"), F.lit("").alias("codes"))

    def step(acc, n):
        new = (acc["sum"] < 0) | (acc["sum"] + n > cap)
        return F.struct(F.when(new, n).otherwise(acc["sum"] + n).alias("sum"), F.concat(acc["codes"], F.when(new, "1").otherwise("0")).alias("codes"))

    return where_true(F.transform(chars(F.aggregate(sizes, start, step, lambda acc: acc["codes"])), lambda c: c == "1"))
