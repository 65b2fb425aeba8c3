"""Scores of retrieval and answers against expectations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.arrays import let


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


# relevance of hits


def is_section_prefix(expected: Column, path: Column) -> Column:
    """Whether a clause such as ``4.2`` is a prefix of a path of segments; an empty one is none."""
    segments = F.filter(F.split(F.coalesce(expected, F.lit("")), r"\."), lambda s: s != "")
    n = F.size(segments)
    return (n > 0) & (n <= F.size(path)) & (F.slice(path, 1, F.greatest(n, F.lit(1))) == segments)


def merged_children(title: Column) -> Column:
    """Clauses that a merged section's title lists."""
    inner = F.regexp_extract(F.coalesce(title, F.lit("")), r"<merged:\s*([0-9.\s/]+)>", 1)
    return F.filter(F.transform(F.split(inner, "/"), lambda x: F.trim(x)), lambda x: x != "")


def judge_hits(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """Hits with spec_hit and section_hit.

    hits: (query_id, rank, spec_id, section_path, clause, section_title);
    golden: (query_id, expected: array of (spec_id, sections)). An expectation
    without sections takes any section; a hit may also fit by its clause or by
    what its title says was merged into it.
    """
    joined = hits.join(golden.select("query_id", "expected"), "query_id")
    paths = F.concat(F.array("section_path", F.split(F.coalesce("clause", F.lit("")), r"\.")), F.transform(merged_children(F.col("section_title")), lambda c: F.split(c, r"\.")))
    of_doc = lambda e: e["spec_id"] == F.col("spec_id")
    fits = lambda e: (F.size(e["sections"]) <= 0) | F.exists(e["sections"], lambda s: F.exists(paths, lambda p: is_section_prefix(s, p)))
    return joined.select(
        *hits.columns, F.exists("expected", of_doc).alias("spec_hit"), F.exists("expected", lambda e: of_doc(e) & fits(e)).alias("section_hit"),
    )


def question_metrics(judged: DataFrame, golden: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Recall, precision and reciprocal rank of each question; null where nothing was expected, 0 where nothing was found."""
    spec_rank, section_rank = F.min(F.when(F.col("spec_hit"), F.col("rank"))), F.min(F.when(F.col("section_hit"), F.col("rank")))
    inside = lambda k: F.count_if(F.col("section_hit") & (F.col("rank") <= k))
    per = judged.groupBy("query_id").agg(spec_rank.alias("_spec"), section_rank.alias("_section"), *[inside(k).alias(f"_n{k}") for k in ks])
    asked = golden.select("query_id", (F.size("expected") > 0).alias("_any")).join(per, "query_id", "left")

    def when_asked(c: Column) -> Column:
        return F.when(F.col("_any"), F.coalesce(c, F.lit(0.0)))

    cols = [when_asked(1.0 / F.col("_section")).alias("mrr"), when_asked(1.0 / F.col("_spec")).alias("mrr_spec")]
    for k in ks:
        cols += [
            when_asked((F.col("_spec") <= k).cast("double")).alias(f"spec_recall_{k}"), when_asked((F.col("_section") <= k).cast("double")).alias(f"section_recall_{k}"),
            when_asked(F.col(f"_n{k}") / F.lit(float(k))).alias(f"precision_{k}"),
        ]
    return asked.select("query_id", *cols)


def mean_metrics(rows: DataFrame, metrics: list[str], by: str | None = None, digits: int = 9) -> DataFrame:
    """Means without nulls, over all rows and for each value of ``by`` (null: over all)."""
    means = [F.round(F.avg(m), digits).alias(m) for m in metrics]
    if by is None:
        return rows.agg(F.count(F.lit(1)).alias("n"), *means)
    out = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(F.grouping(by).alias("overall"), F.count(F.lit(1)).alias("n"), *means)
    return out


def decide(by_dim: DataFrame, wide: int, narrow: int, threshold: float = 0.03) -> DataFrame:
    """Which of two widths wins: by recall if the gap is over the threshold, else by MRR, else the narrow one.

    by_dim: (dim, section_recall_10, mrr), a row for each width.
    """
    pick = lambda m, d: F.max(F.when(F.col("dim") == d, F.col(m)))
    gaps = by_dim.agg((pick("section_recall_10", wide) - pick("section_recall_10", narrow)).alias("recall_gap"), (pick("mrr", wide) - pick("mrr", narrow)).alias("mrr_gap"))
    by = lambda gap: F.when(F.col(gap) > 0, wide).otherwise(narrow)
    winner = F.when(F.abs("recall_gap") > threshold, by("recall_gap")).when(F.abs("mrr_gap") > threshold, by("mrr_gap")).otherwise(narrow)
    fallback = (F.abs("recall_gap") <= threshold) & (F.abs("mrr_gap") <= threshold)
    return gaps.select(F.round("recall_gap", 9).alias("recall_gap"), F.round("mrr_gap", 9).alias("mrr_gap"), winner.alias("winner"), fallback.alias("fallback"))


#: Lists from this number on are lexical (``fusion.as_hits``).
SPARSE_LISTS = 10_000
KINDS = ("rrf", "round_robin", "dense", "sparse")
_NESTED = "array<struct<kind:string,dense_depth:int,sparse_depth:int,rrf_k:int,nested:array<struct<config_id:int,top_n:int,rerank_k:int>>>>"


def _fusions(configs: DataFrame) -> tuple[Column, int, int]:
    """The configurations as one value, those that share a fusion side by side, and the greatest depths. They are parameters, and come to the driver."""
    rows = [r.asDict() for r in configs.select("config_id", "kind", "dense_depth", "sparse_depth", "rrf_k", "top_n", "rerank_k").collect()]
    if unknown := {r["kind"] for r in rows} - set(KINDS):
        raise ValueError(f"unknown kinds of fusion: {', '.join(sorted(map(str, unknown)))}")
    shared: dict[tuple, list[dict]] = {}
    for r in rows:
        shared.setdefault((r["kind"], r["dense_depth"], r["sparse_depth"], r["rrf_k"]), []).append({x: r[x] for x in ("config_id", "top_n", "rerank_k")})
    text = json.dumps([{"kind": k, "dense_depth": d, "sparse_depth": s, "rrf_k": n, "nested": v} for (k, d, s, n), v in shared.items()])
    deepest = lambda c: max((r[c] for r in rows), default=0)
    return F.from_json(F.lit(text), _NESTED), deepest("dense_depth"), deepest("sparse_depth")


def _fused_order(found: Column, f: Column) -> Column:
    """Candidates of a question in the order of the fusion ``f``, without those in none of its lists."""

    def place(x: Column) -> Column:
        inside = lambda p: F.when(p["list_no"] < SPARSE_LISTS, (f["kind"] != "sparse") & (p["rank"] <= f["dense_depth"])).otherwise((f["kind"] != "dense") & (p["rank"] <= f["sparse_depth"]))

        def keyed(parts: Column) -> Column:
            total = F.round(F.aggregate(parts, F.lit(0.0), lambda s, p: s + 1.0 / (f["rrf_k"] + p["rank"])), 12)
            turn, head = F.array_min(F.transform(parts, lambda p: F.struct(p["rank"].alias("a"), p["list_no"].alias("b")))), F.struct(parts[0]["list_no"].alias("a"), parts[0]["rank"].alias("b"))
            by_turn = f["kind"] == "round_robin"
            return F.when(F.size(parts) > 0, F.struct(F.when(by_turn, 0.0).otherwise(-total).alias("key"), F.when(by_turn, turn).otherwise(head).alias("first"), x["chunk_id"].alias("chunk_id"), x["known"].alias("known"), x["spec_hit"].alias("spec_hit"), x["section_hit"].alias("section_hit"), x["score"].alias("score")))

        return let(F.filter(x["parts"], inside), keyed)

    return F.array_sort(F.filter(F.transform(found, place), lambda x: x.isNotNull()))


def _shown(ordered: Column, c: Column) -> Column:
    """What a configuration shows of a fused list: its first, or the best of these by the re-ranker where it scored any."""

    def cut(top: Column) -> Column:
        keyed = F.transform(top, lambda x, i: F.struct(x["score"].isNull().alias("none"), (-x["score"]).alias("key"), i.alias("place"), x.alias("hit")))
        by_score = F.transform(F.array_sort(keyed), lambda x: x["hit"])
        some = F.exists(top, lambda x: x["score"].isNotNull())
        return F.when(c["rerank_k"].isNull(), top).otherwise(F.slice(F.when(some, by_score).otherwise(top), 1, F.coalesce(c["rerank_k"], F.lit(0))))

    return let(F.slice(ordered, 1, c["top_n"]), cut)


def sweep(hits: DataFrame, golden: DataFrame, chunks: DataFrame, configs: DataFrame, scores: DataFrame | None = None, ks: tuple[int, ...] = (5, 10, 20)) -> tuple[DataFrame, DataFrame]:
    """Metrics of many configurations from one set of candidate lists: a summary of each, and its questions.

    configs: (config_id, kind, dense_depth, sparse_depth, rrf_k, top_n, rerank_k).
    The first of each list, to the depth of its side, are fused by ``rrf``, in turns
    (``round_robin``), or from one side (``dense``, ``sparse``), and cut to
    ``top_n``; then, unless ``rerank_k`` is null, re-ranked by ``scores`` (query_id,
    chunk_id, score) and cut to that. A question without scores keeps the fused order.

    A question's candidates, as many as the greatest depths allow, are judged once
    and gathered in its row. Configurations that share a fusion share its order,
    of which each takes a prefix; no hit is joined with a configuration.
    A candidate that isn't among the chunks keeps its place in the lists, and is no hit.

    Summary: config_id, n, n_empty (nothing was found), n_failed, and means of mrr,
    mrr_spec, spec_recall_k, section_recall_k. Questions: config_id, query_id,
    n_hits, the metrics (null where nothing was expected), and failed (no expected
    section among the first of the largest k).
    """
    fusions, dense, sparse = _fusions(configs)
    near = hits.where(F.col("rank") <= F.when(F.col("list_no") < SPARSE_LISTS, dense).otherwise(sparse))
    each = near.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("list_no", "rank"))).alias("parts"))
    about = chunks.join(near.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "spec_id", "section_path", "clause", "section_title", F.lit(True).alias("known"))
    judged = judge_hits(each.join(about, "chunk_id", "left"), golden).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("known", "spec_hit", "section_hit")})
    scored = judged.withColumn("score", F.lit(None).cast("double")) if scores is None else judged.join(scores.select("query_id", "chunk_id", F.col("score").cast("double").alias("score")), ["query_id", "chunk_id"], "left")
    lists = scored.groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", "parts", "known", "spec_hit", "section_hit", "score")).alias("found"))
    asked = golden.select("query_id", (F.size("expected") > 0).alias("asked")).join(lists, "query_id", "left")
    ordered = asked.withColumn("f", F.explode(fusions)).select("query_id", "asked", _fused_order(F.col("found"), F.col("f")).alias("ordered"), "f.nested")
    shown = ordered.select("query_id", "asked", "ordered", F.explode("nested").alias("c")).select("query_id", "asked", "c.config_id", _shown(F.col("ordered"), F.col("c")).alias("shown"))
    place = lambda flag: F.nullif(F.array_position(F.transform("shown", lambda x: x[flag]), F.lit(True)), F.lit(0))
    placed = shown.select("config_id", "query_id", "asked", F.coalesce(F.size(F.filter("shown", lambda x: x["known"])), F.lit(0)).cast("long").alias("n_hits"), place("section_hit").alias("_section"), place("spec_hit").alias("_spec"))
    when_asked = lambda c: F.when(F.col("asked"), F.coalesce(c, F.lit(0.0)))
    metrics = {"mrr": when_asked(1.0 / F.col("_section")), "mrr_spec": when_asked(1.0 / F.col("_spec"))}
    for k in ks:
        metrics |= {f"spec_recall_{k}": when_asked((F.col("_spec") <= k).cast("double")), f"section_recall_{k}": when_asked((F.col("_section") <= k).cast("double"))}
    failed = F.col("asked") & (F.coalesce(F.col("_section"), F.lit(max(ks) + 1)) > max(ks))
    questions = placed.select("config_id", "query_id", "n_hits", *[c.alias(n) for n, c in metrics.items()], failed.alias("failed"))
    summary = questions.groupBy("config_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_hits") == 0).alias("n_empty"), F.count_if("failed").alias("n_failed"), *[F.round(F.avg(m), 9).alias(m) for m in metrics],
    )
    return summary, questions


def regression(metrics: DataFrame, baseline: DataFrame, strict: bool, tolerance: float = 2.0) -> DataFrame:
    """(metric, value) against a baseline in percentage points; only the strict mode fails."""
    delta = F.round((F.col("value") - F.col("baseline")) * 100, 9)
    joined = metrics.join(baseline.select("metric", F.col("value").alias("baseline")), "metric")
    return joined.select("metric", "value", "baseline", delta.alias("delta_pp"), (F.lit(strict) & (delta < -tolerance)).alias("fails"))


# answers


def fact_coverage(answer: Column, facts: Column, skip_blank: bool = False) -> Column:
    """Share of the facts that occur in the answer, without regard to case; null without facts.

    skip_blank: whether blank facts count among all of them.
    """
    hay = F.lower(F.coalesce(answer, F.lit("")))
    counted = F.filter(facts, lambda f: ~_blank(f)) if skip_blank else facts
    hits = F.size(F.filter(facts, lambda f: ~_blank(f) & F.contains(hay, F.lower(f))))
    return F.when(F.size(counted) > 0, hits / F.size(counted))


def forbidden_hits(answer: Column, forbidden: Column) -> Column:
    hay = F.lower(F.coalesce(answer, F.lit("")))
    return F.filter(F.coalesce(forbidden, F.array().cast("array<string>")), lambda f: ~_blank(f) & F.contains(hay, F.lower(f)))


def score_answers(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """Fact coverage, forbidden hits and whether an expected document was retrieved, for each answer.

    golden: (item_id, facts, forbidden, specs); answers: (item_id, answer, retrieved).
    """
    joined = answers.join(golden, "item_id")
    recall = F.when(F.size("specs") > 0, F.arrays_overlap("specs", F.coalesce("retrieved", F.array().cast("array<string>"))).cast("double"))
    return joined.select(
        "item_id", F.round(fact_coverage(F.col("answer"), F.col("facts")), 9).alias("coverage"), F.round(fact_coverage(F.col("answer"), F.col("facts"), True), 9).alias("coverage_non_blank"),
        F.size(forbidden_hits(F.col("answer"), F.col("forbidden"))).cast("long").alias("n_forbidden"), F.coalesce(recall, F.when(F.size("specs") > 0, 0.0)).alias("spec_recall"),
    )


def _n_found(words: Column, tokens: Column) -> Column:
    """How many of the words occur in a token, each as often as it comes.

    Tokens (marked by a blank) and words (by ``!``) are sorted together: a word
    right after its like has the same verdict, only others are sought in the tokens' text.
    """

    def counted(x: Column) -> Column:
        def step(acc: Column, marked: Column) -> Column:
            w, is_word = F.left(marked, F.length(marked) - 1), F.endswith(marked, F.lit("!"))
            ok = F.when(~is_word | (w == acc["w"]), F.when(is_word, acc["ok"]).otherwise(1)).otherwise(F.contains(x["vocabulary"], w).cast("int"))
            return F.struct(w.alias("w"), ok.alias("ok"), is_word.alias("is_word"), (acc["n"] + F.when(acc["is_word"], acc["ok"]).otherwise(0)).alias("n"))

        start = F.struct(F.lit("").alias("w"), F.lit(0).alias("ok"), F.lit(False).alias("is_word"), F.lit(0).alias("n"))
        return F.aggregate(x["marked"], start, step, lambda acc: acc["n"] + F.when(acc["is_word"], acc["ok"]).otherwise(0))

    mark = lambda items, m: F.transform(items, lambda w: F.concat(w, F.lit(m)))
    return let(F.struct(F.array_join(tokens, " ").alias("vocabulary"), F.sort_array(F.concat(mark(tokens, " "), mark(words, "!"))).alias("marked")), counted)


def fact_in_text(fact: Column, text: Column, share: float = 0.6) -> Column:
    """Whether a text has enough of a fact's words of four letters and more, or the whole fact if it has none.

    Both are normalised once a row. Words are sought among the text's distinct ones,
    which hold the same substrings without a space.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))

    def judged(x: Column) -> Column:
        share_found = _n_found(x["words"], F.array_distinct(F.split(x["text"], " "))) / F.size(x["words"])
        return F.when(F.size(x["words"]) > 0, share_found >= share).otherwise(F.contains(padded(x["text"]), x["whole"]))

    def split(x: Column) -> Column:
        return let(F.struct(x["text"].alias("text"), x["whole"].alias("whole"), F.filter(F.split(x["whole"], " "), lambda w: F.length(w) >= 4).alias("words")), judged)

    return let(F.struct(norm(text).alias("text"), norm(fact).alias("whole")), split)


def context_recall(facts: Column, contexts: Column, share: float = 0.6) -> Column:
    """Share of facts that the contexts have; null without facts or contexts."""
    told = F.filter(facts, lambda f: ~_blank(f))
    joined = F.array_join(contexts, "\n")
    return F.when((F.size(told) > 0) & (F.size(contexts) > 0), F.size(F.filter(told, lambda f: fact_in_text(f, joined, share))) / F.size(told))


def utilisation(coverage: Column, recall: Column) -> Column:
    """How much of what was found is answered: coverage / recall, at most 1; null without recall."""
    return F.when(recall > 0, F.round(F.least(F.lit(1.0), coverage / recall), 3))


#: Weight of a verdict on a fact, and on a refusal.
FACT_WEIGHT = {"HIT": 1.0, "PARTIAL": 0.5, "MISS": 0.0}
REFUSAL_WEIGHT = {"VALID_REFUSAL": 1.0, "PARTIAL_REFUSAL": 0.5, "INVALID": 0.0}


def _weight(verdict: Column, weights: dict[str, float]) -> Column:
    v, out = F.upper(F.trim(verdict)), F.lit(None).cast("double")
    for k, w in weights.items():
        out = F.when(v == k, w).otherwise(out)
    return out


def weight_verdicts(verdicts: Column, facts: Column) -> Column:
    """Mean weight of the verdicts that belong to facts by position; missing and unknown ones weigh nothing; null if none is known."""
    cut = F.transform(F.slice(verdicts, 1, F.greatest(F.size(facts), F.lit(1))), lambda v: _weight(v, FACT_WEIGHT))
    known = F.filter(cut, lambda w: w.isNotNull())
    return F.when((F.size(facts) > 0) & (F.size(known) > 0), F.aggregate(known, F.lit(0.0), lambda s, w: s + w) / F.size(facts))


def refusal_rate(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Refusals by verdict, and the weighted pass rate among the judged and among all."""
    v = F.col("verdict")
    count = {k: F.count_if(v == k) for k in REFUSAL_WEIGHT}
    judged = F.count_if(v.isin(*REFUSAL_WEIGHT))
    total = F.sum(F.coalesce(_weight(v, REFUSAL_WEIGHT), F.lit(0.0)))
    return results.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k.lower()) for k, c in count.items()], (F.count(F.lit(1)) - judged).alias("unjudged"),
        F.round(F.try_divide(total, judged), 9).alias("pass_judged"), F.round(total / F.count(F.lit(1)), 9).alias("pass_all"),
    )


def pair_winner(v_ab: Column, v_ba: Column) -> Column:
    """Winner of two judgements with places swapped: ``1``, ``2`` or ``TIE``; an unknown verdict is a tie."""
    first = F.when(v_ab == "X", 1.0).when(v_ab == "Y", 0.0).otherwise(0.5) + F.when(v_ba == "X", 0.0).when(v_ba == "Y", 1.0).otherwise(0.5)
    return F.when(first > 1, "1").when(first < 1, "2").otherwise("TIE")


def flag_items(results: DataFrame) -> DataFrame:
    """Results worth a look: not ended, with forbidden content, refused badly, or without the expected section."""
    return results.where(
        (F.coalesce("terminal_event", F.lit("")) != "final") | (F.size("forbidden") > 0) | F.coalesce(F.col("verdict").isin("PARTIAL_REFUSAL", "INVALID"), F.lit(False))
        | F.coalesce(F.col("section_recall") == 0, F.lit(False))
    )


def acronyms(text: Column, common: list[str]) -> Column:
    """Distinct words of capitals and digits in a text but for common ones, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][A-Z0-9]{1,9})\b"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(c) for c in common]).cast("array<string>"))
