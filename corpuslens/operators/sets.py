"""Differences, consistency and repair of tables of ids and expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions import vectors as V
from corpuslens.operators.aggregates import percentiles
from corpuslens.operators.blocks import is_rule


def id_drift(old: DataFrame, new: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Drift of ids (spec_id, chunk_id) by document, and in all (spec_id null): Jaccard distance and whether it passes."""
    mark = lambda df, c: df.select("spec_id", "chunk_id").distinct().withColumn(c, F.lit(True))
    both = mark(old, "o").join(mark(new, "n"), ["spec_id", "chunk_id"], "full_outer").select("spec_id", F.coalesce("o", F.lit(False)).alias("o"), F.coalesce("n", F.lit(False)).alias("n"))
    o, n = F.col("o"), F.col("n")
    sums = [F.count_if(o).alias("old_count"), F.count_if(n).alias("new_count"), F.count_if(o & n).alias("shared"), F.count_if(o & ~n).alias("only_old"), F.count_if(n & ~o).alias("only_new")]
    per_doc = both.groupBy("spec_id").agg(*sums).withColumn("overall", F.lit(0))
    out = per_doc.unionByName(both.agg(*sums).withColumns({"overall": F.lit(1), "spec_id": F.lit(None).cast("string")}))  # a row even if there are no ids
    drift = F.round(F.coalesce(F.try_divide(F.col("only_old") + F.col("only_new"), F.col("shared") + F.col("only_old") + F.col("only_new")), F.lit(0.0)), 6)
    return out.withColumn("drift", drift).withColumn("passed", F.col("drift") <= threshold)


def sink_consistency(sinks: dict[str, DataFrame]) -> DataFrame:
    """Whether each document has the same ids (spec_id, chunk_id) in every sink: spec_id, n_ids, n_missing (ids that some sink lacks), consistent."""
    tagged = None
    for name, df in sinks.items():
        one = df.select("spec_id", "chunk_id", F.lit(name).alias("sink"))
        tagged = one if tagged is None else tagged.unionByName(one)
    per_id = tagged.groupBy("spec_id", "chunk_id").agg(F.count_distinct("sink").alias("n"))
    missing = F.count_if(F.col("n") < len(sinks))
    return per_id.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_ids"), missing.alias("n_missing"), (missing == 0).alias("consistent"))


def common_docs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("spec_id").intersect(b.select("spec_id"))


def merge_golden(files: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items (file_no, item_no, id, …) of several files in one, and errors: ids met before (file_no, id).

    With ``force`` the last file wins. Without, items with an error aren't merged.
    """
    order = Window.partitionBy("id").orderBy("file_no", "item_no")
    marked = files.withColumns({"_n": F.row_number().over(order), "_all": F.count(F.lit(1)).over(Window.partitionBy("id"))})
    if force:
        return marked.where("_n = _all").drop("_n", "_all"), marked.limit(0).select("file_no", "id")
    return marked.where("_all = 1").drop("_n", "_all"), marked.where("_n > 1").select("file_no", "id")


#: What an item's fields may hold.
CATEGORIES = ["definition", "procedure", "multi_section", "table_lookup", "formula", "negative"]
LANGUAGES, SOURCES = ["en", "zh"], ["teleqna_transformed", "hand_crafted"]


def validate_golden(items: DataFrame) -> DataFrame:
    """Issues of items as rows: item_no, id, severity, code, field.

    items: (item_no, id, category, language, question, source, expected array of
    (spec_id, sections), facts, forbidden, must_say_not_found).
    """
    c = F.col
    issue = lambda sev, code, field=None: F.struct(F.lit(sev).alias("severity"), F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"))
    blank = lambda name: F.trim(F.coalesce(c(name), F.lit(""))) == ""
    rules: list[tuple[Column, Column]] = [(blank(f), issue("error", "empty_field", f)) for f in ("id", "category", "language", "question", "source")]
    rules += [(c(f).isNull(), issue("error", "missing_field", f)) for f in ("expected", "facts", "forbidden")]
    again = F.row_number().over(Window.partitionBy("id").orderBy("item_no")) > 1
    rules += [
        (~blank("id") & c("_again"), issue("error", "duplicate_id", "id")), (~blank("category") & ~c("category").isin(CATEGORIES), issue("error", "invalid_category", "category")),
        (~blank("language") & ~c("language").isin(LANGUAGES), issue("error", "invalid_language", "language")), (~blank("source") & ~c("source").isin(SOURCES), issue("warning", "unknown_source", "source")),
        (F.exists("expected", lambda e: F.coalesce(e["spec_id"], F.lit("")) == ""), issue("error", "missing_spec_id", "expected")),
        (F.exists("expected", lambda e: (e["spec_id"] != "") & ~e["spec_id"].rlike(r"^\d{1,3}\.\d{1,3}$")), issue("warning", "spec_id_format", "expected")),
        (F.exists("expected", lambda e: F.exists(e["sections"], lambda s: s.isNull())), issue("error", "section_not_scalar", "expected")),
    ]
    negative, says = c("category") == "negative", F.coalesce(c("must_say_not_found"), F.lit(False))
    rules += [
        (~negative & says, issue("warning", "non_negative_must_not_found", "must_say_not_found")), (negative & (F.size("expected") > 0), issue("warning", "negative_has_specs", "expected")),
        (negative & ~says, issue("error", "negative_must_say_not_found", "must_say_not_found")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), what) for cond, what in rules]))
    return items.withColumn("_again", again).select("item_no", "id", F.explode(found).alias("i")).select("item_no", "id", "i.severity", "i.code", "i.field")


def integrity_audit(chunks: DataFrame, title_chars: int = 1200) -> DataFrame:
    """Counts of what is wrong with chunks by document: repeated ids, repeated content in a section, tables without a rule, overlong titles."""
    by_id = chunks.groupBy("spec_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"))
    by_text = chunks.groupBy("spec_id", "parent_section_id", F.sha2("content", 256).alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"))
    ruled = F.exists(F.split("content", "\n"), is_rule)
    rows = chunks.groupBy("spec_id").agg(F.count_if((F.col("chunk_type") == "table") & ~ruled).alias("a"), F.count_if(F.char_length("section_title") > title_chars).alias("b"))
    flat = rows.select("spec_id", F.expr("stack(2, 'table_without_rule', a, 'long_title', b) as (code, n)")).where("n > 0")
    return flat.unionByName(by_id.select("spec_id", F.lit("repeated_id").alias("code"), "n")).unionByName(by_text.select("spec_id", F.lit("repeated_content").alias("code"), "n"))


def repair_forbidden(items: DataFrame, source: str, note: str) -> DataFrame:
    """Clear the forbidden phrases of one source's items, with the original kept and a note added."""
    hit = (F.col("source") == source) & (F.size("forbidden") > 0)
    empty = F.array().cast("array<string>")
    return items.withColumns({
        "original_forbidden": F.when(hit, F.col("forbidden")), "notes": F.when(hit, F.concat_ws("\n\n", F.nullif("notes", F.lit("")), F.lit(note))).otherwise(F.col("notes")),
        "forbidden": F.when(hit, empty).otherwise(F.col("forbidden")),
    })


def attribution_diff(items: DataFrame, proposals: DataFrame, accept: list[str]) -> DataFrame:
    """Expected documents against proposed ones: status agree, diff or missing; applied, and the expectation after it.

    A proposal that differs is applied if its confidence is accepted and it isn't
    empty; sections of documents that stay are kept.
    """
    joined = items.join(proposals.select("item_id", "proposed", "confidence"), "item_id", "left")
    current = F.transform("expected", lambda e: e["spec_id"])
    status = F.when(F.col("proposed").isNull(), "missing").when(F.array_sort(current) == F.array_sort("proposed"), "agree").otherwise("diff")
    applied = (status == "diff") & F.col("confidence").isin(accept) & (F.size("proposed") > 0)
    kept = F.map_from_entries(F.transform("expected", lambda e: F.struct(e["spec_id"], e["sections"])))
    made = F.transform("proposed", lambda p: F.struct(p.alias("spec_id"), F.coalesce(F.try_element_at(kept, p), F.array().cast("array<string>")).alias("sections")))
    return joined.select("item_id", status.alias("status"), F.coalesce(applied, F.lit(False)).alias("applied"), F.when(applied, made).otherwise(F.col("expected")).alias("expected"))


def symmetry_gate(items: DataFrame, counts: DataFrame, least: int = 3) -> DataFrame:
    """Items (item_id, terms) with the first probe term of four letters or more that at least ``least`` documents have (null: kept)."""
    probes = items.select("item_id", F.posexplode("terms").alias("at", "t")).withColumn("term", F.trim("t")).where(F.char_length("term") >= 4)
    hits = probes.join(counts.where(F.col("n_documents") >= least), "term").groupBy("item_id").agg(F.min_by("term", "at").alias("found"))
    return items.join(hits, "item_id", "left").withColumn("kept", F.col("found").isNull())


def route_items(items: DataFrame, categories: list[str], whitelist: list[str], keywords: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Verdict on each item by category and by the documents its texts name, with topic score: item_id, category, verdict, specs, topic_score."""
    said = F.concat_ws("\n", "question", "explanation", F.array_join("options", "\n"))
    seen = T.canonical_ids(T.extract_spec_ids(said), aliases or {})
    inside = F.filter(seen, lambda s: s.isin(whitelist))
    verdict = F.when(~F.coalesce(F.col("category").isin(categories), F.lit(False)), "rejected_category").when(F.size(seen) == 0, "rejected_no_spec").when(F.size(inside) == 0, "out_of_scope").otherwise("kept")
    return items.select("item_id", "category", verdict.alias("verdict"), inside.alias("specs"), T.topic_score(F.concat_ws("\n", "question", "explanation"), keywords).alias("topic_score"))


def vector_equivalence(wide: DataFrame, narrow: DataFrame, width: int, median_gate: float = 0.99, min_gate: float = 0.95) -> DataFrame:
    """Cosine of cut wide vectors with narrow ones (id, vec): min, p01, p05, median, mean, and whether the gates are met."""
    joined = wide.select("id", V.truncate_renorm(F.col("vec"), width).alias("w")).join(narrow.select("id", F.col("vec").alias("v")), "id")
    sims = joined.select(F.round(V.cosine(F.col("w"), F.col("v")), 9).alias("sim"))
    whole = sims.withColumn("whole", F.lit(0))
    ranks = percentiles(whole, ["whole"], "sim", {"p01": (0.01, "nearest"), "p05": (0.05, "nearest"), "median": (0.5, "median")})
    sums = sims.agg(F.count("sim").alias("n"), F.min("sim").alias("least"), F.round(F.avg("sim"), 9).alias("mean")).withColumn("whole", F.lit(0))
    out = sums.join(ranks, "whole", "left").fillna(0.0, ["p01", "p05"]).select("n", "least", "p01", "p05", "median", "mean")
    return out.withColumn("passed", F.coalesce((F.col("median") >= median_gate) & (F.col("least") >= min_gate), F.lit(False)))
