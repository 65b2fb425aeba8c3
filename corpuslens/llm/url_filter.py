"""URL filtering against dated lists, as an as-of join.

A list is a log of changes: kind, pattern, action, change (``add`` or
``remove``) and the time of the change. An added entry is active until the next
change of the same kind and pattern; so the log becomes validity intervals. A
capture is judged by the entries that were active when it was fetched:

=========  ==================================================================
kind       a pattern is
=========  ==================================================================
``host``   a host, exactly
``domain`` a domain, with all hosts under it
``prefix`` a host and the first parts of a path, in whole parts
=========  ==================================================================

Each capture looks up its host, the domains above it and its path prefixes by
equality, then by time. Of several active entries the longest pattern decides,
then prefix before host before domain; its action is ``block`` or ``allow``.

Changes at equal times apply adds first, so a remove at the same time wins.
Entries with a null among kind, pattern, action, change and time have no
effect. URLs are matched without scheme, user, port, query and fragment, in
lower case up to the path. A capture whose URL is null or has no host matches
nothing, and one with a null time neither: they are kept. The verdict depends on
URL and time alone, so each pair of them is looked up once, and rows that repeat
have the same one.

Captures look up no more than the list can answer: paths down to its deepest
prefix, and single labels (``com``) only if it has one. A list of up to
``BROADCAST_ENTRIES`` is broadcast, so no key of the captures is shuffled. Of a
longer one the entries that many captures look up are, and the rest is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import join_counted, stored, unused

#: Intervals up to which a list is broadcast: some 150 bytes each.
BROADCAST_ENTRIES = 100_000


def url_host(url: Column) -> Column:
    """Host of a URL, in lower case; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)", 2)), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a URL without its leading slash, query and fragment."""
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """A log of changes as intervals: kind, pattern, action, valid_from, valid_to (null: still active)."""
    known = entries.select("kind", F.lower("pattern").alias("pattern"), "action", "change", "changed_at").dropna()
    log = Window.partitionBy("kind", "pattern").orderBy("changed_at", "change", "action")
    return (
        known.withColumn("valid_to", F.lead("changed_at").over(log)).where("change = 'add'")
        .select("kind", "pattern", "action", F.col("changed_at").alias("valid_from"), "valid_to").where("valid_to is null or valid_to > valid_from")
    )


def lookup_keys(host: Column, path: Column, depth: int, least_labels: int) -> Column:
    """What a capture looks up: array of (kind, pattern); prefixes of up to ``depth`` parts, domains of so many labels at least."""
    labels = F.split(host, r"\.")
    n = F.size(labels)

    def up_to(last: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: i > 0)

    domains = F.transform(up_to(n - (least_labels - 1)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("pattern")))
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: p != "")
    prefixes = F.transform(
        up_to(F.least(F.size(parts), F.lit(depth))),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")).alias("pattern")),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host.isNotNull(), F.concat(own, domains, prefixes))


def url_filter(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """The captures with host, matched_kind, matched_pattern and listed_at of the entry that decides (null if none), and kept.

    Where the captures have a column of one of these names, that stays as it is
    and the new one has an underscore before its name.
    """
    listed = stored(validity(entries), "list")
    prefix, domain = F.col("kind") == "prefix", F.col("kind") == "domain"
    about = listed.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(prefix, F.size(F.split("pattern", "/")) - 1)).alias("depth"), F.min(F.when(domain, F.size(F.split("pattern", r"\.")))).alias("labels")
    ).first()
    url, at = F.col(url_col).cast("string"), F.col(time_col)
    pairs = captures.select(url.alias("_url"), at.alias("_at")).where("_url is not null and _at is not null").distinct()
    keys = lookup_keys(url_host(F.col("_url")), url_path(F.col("_url")), about["depth"] or 0, about["labels"] or 1)
    looked_up = ["kind", "pattern"]
    if about["n"] <= BROADCAST_ENTRIES:
        seen = pairs.select("_url", "_at", F.inline(keys))
        found = seen.join(F.broadcast(listed), looked_up)
    else:
        seen = stored(pairs, "pairs").select("_url", "_at", F.inline(keys))
        times = seen.groupBy(*looked_up).agg(F.count(F.lit(1)).alias("times"))
        found = join_counted(seen, stored(listed.join(times, looked_up), "weighed"), looked_up, "times", F.octet_length("pattern") + 64)
    active = found.where((F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    rank = F.struct(F.length("pattern").alias("n"), F.col("kind").alias("kind"), F.col("pattern").alias("pattern"), F.col("action").alias("action"), F.col("valid_from").alias("listed_at"))
    decided = active.groupBy("_url", "_at").agg(F.max(rank).alias("_top"))
    names = captures.columns
    top, by_url, by_at = unused(names, "_top"), unused(names, "_url"), unused(names, "_at")
    found = captures.join(decided.toDF(by_url, by_at, top), (url == F.col(by_url)) & (at == F.col(by_at)), "left")
    return found.select(
        *names, url_host(F.col(url_col)).alias(unused(names, "host")), F.col(f"{top}.kind").alias(unused(names, "matched_kind")), F.col(f"{top}.pattern").alias(unused(names, "matched_pattern")),
        F.col(f"{top}.listed_at").alias(unused(names, "listed_at")), F.coalesce(F.col(f"{top}.action") != "block", F.lit(True)).alias(unused(names, "kept")),
    )


def dated_list(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """A list with dates, made from the hosts and paths of the pages themselves by a hash.

    Of the hosts 1 in 8 is blocked for a while, some again later; of the domains
    1 in 8, of first path parts 1 in 8 is blocked and 1 in 8 allowed.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    labels = F.split(host, r"\.")
    first = F.split(F.lower(path), "/")[0]
    named = pages.select(F.explode(F.array(
        F.struct(F.lit("host").alias("kind"), host.alias("pattern")),
        F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 9), ".").alias("pattern")),
        F.struct(F.lit("prefix").alias("kind"), F.when(first != "", F.concat(host, F.lit("/"), first)).alias("pattern")),
    )).alias("e")).select("e.*").where("pattern is not null").distinct()
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "pattern")), 1, 6), 16, 10).cast("long")
    chosen = named.withColumn("h", digit).where(F.col("h") % 8 < F.when(F.col("kind") == "prefix", 2).otherwise(1))
    action = F.when((F.col("kind") == "prefix") & (F.col("h") % 8 == 1), "allow").otherwise("block")
    start = F.lit("2024-01-01").cast("timestamp")
    day = (F.col("h") / 8).cast("long") % 40

    def change(kind: str, days: Column):
        return F.struct(F.lit(kind).alias("change"), F.timestamp_add("DAY", days.cast("int"), start).alias("changed_at"))

    log = F.array(change("add", day), change("remove", day + 10), change("add", day + 15))
    some = F.slice(log, 1, (F.col("h") % 3).cast("int") + 1)
    return chosen.select("kind", "pattern", action.alias("action"), F.explode(some).alias("c")).select("kind", "pattern", "action", "c.change", "c.changed_at")


def with_fetch_time(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Pages with a fetch time within 60 days, by their id."""
    seconds = F.pmod(F.col(id_col) * 7919, F.lit(60 * 86400)).cast("int")
    return pages.withColumn("fetched_at", F.timestamp_add("SECOND", seconds, F.lit("2024-01-01").cast("timestamp")))
