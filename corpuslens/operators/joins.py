"""Listings and alignments by join."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.sources.scratch import kept


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The page ``number`` (from 1) of a listing in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def feedback_list(feedback: DataFrame, messages: DataFrame, users: DataFrame, thumb: str | None = None, number: int = 1, size: int = 20) -> DataFrame:
    """Feedback with its message and user, newest first; feedback without either is left out."""
    chosen = feedback if thumb is None else feedback.where(F.col("thumb") == thumb)
    joined = chosen.join(messages, "message_id").join(users, "user_id")
    return page(joined, [F.desc("created_at"), F.col("feedback_id")], number, size)


def owned(rows: DataFrame, owners: DataFrame, key: str, owner: Column) -> DataFrame:
    """Rows whose owner fits a predicate on the owners' table."""
    return rows.join(owners.where(owner).select(key).distinct(), key, "left_semi")


def enrich_targets(targets: DataFrame, messages: DataFrame, preview: Column) -> DataFrame:
    """Targets (target_id: text) with a preview of their message; a target that is no id, or unknown, has none.

    Targets that are no ids don't go through the join, where one task would get them all.
    """
    known = messages.select(F.col("message_id").cast("long").alias("_id"), preview.alias("preview"))
    number = F.col("target_id").try_cast("long")
    found = targets.where(number.isNotNull()).join(known, number == F.col("_id"), "left").drop("_id")
    return found.unionByName(targets.where(number.isNull()).withColumn("preview", F.lit(None).cast(known.schema["preview"].dataType)))


def messages_with_citations(messages: DataFrame, citations: DataFrame) -> DataFrame:
    """Messages with their citations as an array in the order of rank (empty if there are none)."""
    grouped = citations.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("citations"))
    empty = F.array().cast("array<struct<rank:int,chunk_id:bigint>>")
    return messages.join(grouped, "message_id", "left").withColumn("citations", F.coalesce("citations", empty))


def align_systems(answers: DataFrame, systems: list[str], value: str = "answer") -> DataFrame:
    """One row for each item with a column for each system (null where it gave none), in the order of first appearance (first)."""
    cells = [F.min_by(value, F.when(F.col("system") == s, F.col("ord"))).alias(s) for s in systems]
    return answers.groupBy("item_id").agg(F.min("ord").alias("first"), *cells)


#: Rows of a run that one task groups and joins.
ROWS_PER_TASK = 1_000_000


def dealt_runs(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt by their item into tasks that grow in number with ``n``, the rows of the runs, and not in size.

    Runs grouped by item from rows dealt by the same ``n`` are merged where they are.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_TASK))
    return rows.repartition(tasks, key)


def merge_runs(a: DataFrame, b: DataFrame, metrics: list[str], strategy: str) -> DataFrame:
    """Items of run ``a`` with each metric merged from both: ``max``, ``mean`` (of those that aren't null) or ``second_unless_none``."""
    other = b.select("item_id", *[F.col(m).alias(f"_{m}") for m in metrics])
    joined = a.join(other, "item_id", "left")

    def merged(m: str) -> Column:
        x, y = F.nanvl(F.col(m), F.lit(None)), F.nanvl(F.col(f"_{m}"), F.lit(None))
        if strategy == "max":
            return F.greatest(x, y)
        if strategy == "mean":
            return F.coalesce((x + y) / 2, x, y)
        return F.coalesce(y, x)

    return joined.withColumns({m: merged(m) for m in metrics}).drop(*[f"_{m}" for m in metrics])


def hydrate(citations: DataFrame, chunks: DataFrame, order: str = "ord") -> DataFrame:
    """Citations with the content of their chunk; of several contents the first that isn't empty."""
    first = chunks.where(F.coalesce("content", F.lit("")) != "").groupBy("chunk_id").agg(F.min_by("content", order).alias("content"))
    return citations.join(first, "chunk_id", "left")


def clause_ancestors(clause: Column) -> Column:
    """A clause's own number and those of all sections around it, and the empty one of the document: ``4.2.1`` gives ``, 4, 4.2, 4.2.1``."""
    parts = F.split(clause, r"\.")
    own = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "."))
    return F.concat(F.array(F.lit("")), F.coalesce(own, F.array().cast("array<string>")))


def section_text(golden: DataFrame, chunks: DataFrame, most: int = 3000, separator: str = "\n\n") -> DataFrame:
    """Text of each item's expected sections: (item_id, spec_id, section) ⋈ chunks by document and section prefix.

    A section null or empty takes the whole document; a content counts once; texts
    come in document order, cut at ``most`` characters. A chunk is joined under each
    section around it, so the join is one of equality and no chunk meets an item
    that doesn't ask for it. Only chunks that begin before the cut are gathered:
    each but the first adds a separator, so they are among the first ``most``, which
    each task finds before the shuffle.
    """
    asked = golden.select("item_id", "spec_id", F.coalesce(F.trim("section"), F.lit("")).alias("under")).distinct()
    places = chunks.where("content is not null").select("spec_id", "chunk_id", "document_order", "content", F.explode(F.array_distinct(clause_ancestors(F.col("clause")))).alias("under"))
    once = asked.join(places, ["spec_id", "under"]).groupBy("item_id", F.sha2("content", 256).alias("_sha")).agg(F.min(F.struct("document_order", "chunk_id", F.left("content", F.lit(most)).alias("content"))).alias("c"))
    order = Window.partitionBy("item_id").orderBy("c.document_order", "c.chunk_id")
    first = once.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    size = F.char_length("c.content") + len(separator)
    early = first.withColumn("_before", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "c.content"))), lambda x: x["content"]), separator)
    return early.groupBy("item_id").agg(F.left(joined, F.lit(most)).alias("reference"))


VARIANTS = ("facts", "sentences", "wrapped", "section", "hybrid")


def reference_text(golden: DataFrame, chunks: DataFrame, items: DataFrame, variant: str = "section", most: int = 3000, separator: str = "\n\n") -> DataFrame:
    """A reference for each of ``items`` (item_id, facts): item_id, reference.

    ``facts``: the facts in a row. ``sentences``: each fact, trimmed, as a sentence.
    ``wrapped``: each as what the answer should mention. ``section``: the text of the
    item's expected sections (``section_text``), else its sentences. ``hybrid``: the
    wrapped facts and that text, or what there is of them. Where an item has nothing,
    a note says so.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant is one of {', '.join(VARIANTS)}")
    facts = F.coalesce("facts", F.array().cast("array<string>"))
    trimmed = F.transform(facts, lambda f: F.trim(f))
    none, some = F.lit("(no ground truth)"), F.size(facts) > 0
    sentences = F.when(some, F.concat(F.array_join(trimmed, ". "), F.lit(".")))
    wrapped = F.when(some, F.concat(F.array_join(F.transform(trimmed, lambda f: F.concat(F.lit("The answer should mention "), f)), ". "), F.lit(".")))
    if variant not in ("section", "hybrid"):
        made = {"facts": F.when(some, F.array_join(facts, " ")), "sentences": sentences, "wrapped": wrapped}[variant]
        return items.select("item_id", F.coalesce(made, none).alias("reference"))
    found = section_text(golden, chunks, most, separator).select("item_id", F.when(F.col("reference") != "", F.col("reference")).alias("_text"))
    joined, text = items.join(found, "item_id", "left"), F.col("_text")
    both = F.concat(wrapped, F.lit("\n\nReference section content:\n"), text)
    made = F.coalesce(text, sentences, none) if variant == "section" else F.coalesce(both, text, wrapped, none)
    return joined.select("item_id", made.alias("reference"))


def attach_price(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Usage with the prices of (kind, model); unknown or unbilled ones cost nothing."""
    billed = prices.where("billed").select("kind", "model", "input_price", "output_price", "call_price")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    joined = usage.join(billed, ["kind", "model"], "left")
    return joined.select(*[c for c in usage.columns], zero("input_price"), zero("output_price"), zero("call_price"))


def rescore(results: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Results under an older and a newer set of expectations (facts): coverage by both, and what was added and removed."""
    from corpuslens.operators.evaluation import fact_coverage

    joined = results.join(old.select("item_id", F.col("facts").alias("old_facts")), "item_id").join(new.select("item_id", F.col("facts").alias("new_facts")), "item_id")
    return joined.select(
        "item_id", fact_coverage(F.col("answer"), F.col("old_facts")).alias("old_coverage"), fact_coverage(F.col("answer"), F.col("new_facts")).alias("new_coverage"),
        F.array_except("new_facts", "old_facts").alias("added"), F.array_except("old_facts", "new_facts").alias("removed"),
    )


def system_pairs(answers: DataFrame) -> DataFrame:
    """Pairs of different systems' answers to one item, the smaller name first; an item has one answer for each system."""
    other = answers.select("item_id", F.col("system").alias("system_b"), F.col("answer").alias("answer_b"))
    return answers.join(other, "item_id").where(F.col("system") < F.col("system_b")).select("item_id", F.col("system").alias("system_a"), "system_b", F.col("answer").alias("answer_a"), "answer_b")


#: Bytes of terms that one automaton holds, and so one pass over the texts looks for.
TERM_BYTES = 8 << 20


def _found_in(terms: list[tuple[int, str]]) -> Callable:
    """Columns (spec_id, content) to (spec_id, number): the terms that each document's texts hold, once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, term in terms:
            automaton.add_word(term, number)
        automaton.make_automaton()
        for batch in batches:
            seen: dict[int, set[str]] = {}
            for spec, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for _, number in automaton.iter(text.as_py()):
                    seen.setdefault(number, set()).add(spec)
            rows = [(spec, number) for number, specs in seen.items() for spec in specs]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["spec_id", "number"])

    return run


def term_document_counts(terms: DataFrame, chunks: DataFrame, term_bytes: int = TERM_BYTES) -> DataFrame:
    """In how many documents each term occurs: (term) × (spec_id, content) → term, n_documents.

    A term is any text: a word, part of one, a phrase with blanks, hyphens or commas.
    It occurs where a content holds it, without regard to case; blanks at its ends
    don't count, and an empty term occurs nowhere. A document is all chunks of a
    spec_id. Texts don't move: each task looks for all terms in one pass with an
    automaton of ``term_bytes`` of terms at most; more terms take more passes. What
    is shuffled is (term, document), each once for a task.
    """
    wanted = kept(terms.where("term is not null").select("term", F.lower(F.trim("term")).alias("lowered")).distinct(), "terms")
    looked = wanted.where("lowered <> ''").select("lowered").distinct()
    total = looked.agg(F.sum(F.octet_length("lowered") + 64)).first()[0] or 0
    passes = -(-total // term_bytes)
    texts = chunks.where("content is not null and spec_id is not null").select(F.col("spec_id").cast("string").alias("spec_id"), F.lower("content").alias("content"))
    numbered = kept(looked.withColumns({"number": F.monotonically_increasing_id(), "pass": F.pmod(F.xxhash64("lowered"), F.lit(max(passes, 1)))}), "numbered")
    found = None
    for n in range(passes):
        part = [(r["number"], r["lowered"]) for r in numbered.where(F.col("pass") == n).collect()]  # a bounded part, about term_bytes
        if not part:
            continue
        one = texts.mapInArrow(_found_in(part), "spec_id string, number long")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return wanted.select("term", F.lit(0).cast("long").alias("n_documents")).distinct()
    counts = found.distinct().groupBy("number").agg(F.count(F.lit(1)).alias("n"))
    named = numbered.join(counts, "number").select("lowered", "n")
    return wanted.join(named, "lowered", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents")).distinct()
