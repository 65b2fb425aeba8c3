"""Retrieval, evaluation, usage and streams on hand-made rows."""

import datetime as dt
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.functions import vectors as V
from corpuslens.operators import aggregates, bm25, dense, evaluation, fusion, joins, sets, usage, windows
from corpuslens.streaming import usage as stream

HITS = "query_id long, list_no int, rank int, chunk_id string, score_dense double, score_sparse double"


def hits(spark, *lists):
    rows = [(0, n, r + 1, c, 1.0 if n == 0 else None, 2.0 if n == 1 else None) for n, l in enumerate(lists) for r, c in enumerate(l)]
    return spark.createDataFrame(rows, HITS)


def test_rrf(spark):
    got = fusion.rrf(hits(spark, ["a", "b"], ["b", "a"])).collect()
    assert [(r.rank, r.chunk_id) for r in got] == [(1, "a"), (2, "b")]
    assert all(r.fused_score == pytest.approx(1 / 61 + 1 / 62, abs=1e-12) and r.score_dense == 1.0 and r.score_sparse == 2.0 for r in got)
    assert [r.chunk_id for r in fusion.rrf(hits(spark, [f"x{i}" for i in range(10)]), top_n=3).collect()] == ["x0", "x1", "x2"]
    assert fusion.rrf(hits(spark, ["a"]).limit(0)).count() == 0


def test_round_robin(spark):
    merged = lambda budget: [r.chunk_id for r in fusion.round_robin(hits(spark, ["a", "b", "c"], ["b", "d"]), budget).orderBy("place").collect()]
    assert merged(0) == ["a", "b", "d", "c"] and merged(3) == ["a", "b", "d"]


def test_bm25(spark):
    df = spark.createDataFrame([("c1", "radio frames and slots"), ("c2", "session"), ("c3", "PDU Session establishment PDU"), ("c4", None)], "chunk_id string, content string")
    q = spark.createDataFrame([(0, "PDU session"), (1, "the of"), (2, None)], "query_id long, text string")
    index = bm25.build_bm25(df)
    assert [(r.query_id, r.rank, r.chunk_id) for r in bm25.bm25_topk(q, index, 5).orderBy("query_id", "rank").collect()] == [(0, 1, "c3"), (0, 2, "c2")]
    assert index.corpus.first().n == 4


def test_dense_is_brute_force_in_any_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(200, 8))
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)], "chunk_id long, vec array<double>")
    q = df.where("chunk_id < 12").select(F.col("chunk_id").alias("query_id"), "vec")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for i in range(12):
        s = np.round(unit @ unit[i], 9)
        want[i] = np.lexsort((np.arange(200), -s))[:5].tolist()
    for rows in (4096, 30):
        got: dict = {}
        for r in dense.dense_topk(q, df, 5, block_rows=rows).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        assert got == want


def test_ann_recall(spark):
    from corpuslens.plans.retrieval_queries import asked, nearest, vectors

    d = "/root/testdata/sf0.01"
    exact = nearest(spark, d, 10)
    near = dense.ann_topk(asked(spark, d), vectors(spark, d), 10, 64)
    found = exact.join(near.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").count()
    assert found >= 0.9 * exact.count()


def test_ann_shuffles_no_pairs_and_divides_large_buckets(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(300, 8))
    x[100:200] = x[5]  # one bucket of many copies
    x[7] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, vec array<double>")
    q = df.where("chunk_id < 12 and chunk_id <> 7").select(F.col("chunk_id").alias("query_id"), "vec")
    took = lambda rows: sorted(map(tuple, dense.ann_topk(q, df, 6, 8, tables=8, bits=3, block_rows=rows).collect()))
    whole = took(4096)
    assert whole == took(20) == took(5)
    # by hand: the best of the rows that share a bucket with the query, or lie beyond one plane
    planes = np.random.default_rng(7).normal(size=(8, 3, 8))
    own = ((np.einsum("tbw,nw->ntb", planes, x) > 0) * (1 << np.arange(3))).sum(2)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in (0, 5, 11):
        near = np.isin(own[i] ^ own, (0, 1, 2, 4)).any(1) & (np.arange(300) != 7)
        score = np.where(near, np.round(unit @ unit[i], 9), -9)
        assert [r[2] for r in whole if r[0] == i] == np.lexsort((np.arange(300), -score))[:6].tolist()
    plan = dense.ann_topk(q, df, 6, 8)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan


def test_scores_of_a_block_are_taken_in_slices(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(700, 4))
    got = list(dense._pairs(np.arange(700), x, np.arange(700), x, 3))
    assert len(got) == 3 and max(len(q) for q, _, _ in got) <= dense.SLICE_ROWS * 3


def test_pairs_of_blocks_are_dealt_into_more_tasks_as_they_grow(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(300)], "chunk_id long, vec array<double>")
    q = df.where("chunk_id % 3 = 0").select(F.col("chunk_id").alias("query_id"), "vec")
    many, few = dense.dense_multidim(q, df, [2, 4], 5, block_rows=10), dense.dense_multidim(q, df, [2, 4], 5)
    # 30 blocks of rows and 10 of queries
    tasks = lambda df: df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("hashpartitioning(shard")
    assert ", 19)" in many._jdf.queryExecution().toString() and tasks(many) == tasks(few) == 2
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_renorm(spark):
    df = spark.createDataFrame([([3.0, 4.0, 9.0],), ([0.0, 0.0, 1.0],)], "v array<float>")
    got = [r.v for r in df.select(V.truncate_renorm(F.col("v"), 2).alias("v")).collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
    with pytest.raises(Exception, match="shorter"):
        df.select(V.truncate_renorm(F.col("v"), 4).alias("v")).collect()


CHUNK = "chunk_id string, parent_section_id string, content string, document_order int, parent_section_chars int"


def test_expansion(spark):
    chunks = spark.createDataFrame([(f"{p}{i}", p, f"{p}{i}" * 5, i, 50 if p == "s" else 9000) for p in "st" for i in range(6)], CHUNK)
    found = spark.createDataFrame([(0, 1, "s2", "s"), (0, 2, "s3", "s"), (0, 3, "t4", "t"), (0, 4, "x", None)], "query_id long, rank int, chunk_id string, parent_section_id string")
    got = {r.rank: r for r in fusion.expand_to_section(found, chunks, 1, 8000, 1000).collect()}
    assert got[1].expanded_content == "\n\n".join(f"s{i}" * 5 for i in range(6)) and not got[1].degraded
    assert got[2].expanded_content is None and got[4].expanded_content is None
    assert got[3].expanded_content == "\n\n".join(f"t{i}" * 5 for i in (3, 4, 5)) and got[3].degraded
    cut = {r.rank: r.expanded_content for r in fusion.expand_to_section(found, chunks, 1, 8000, 75).collect()}
    assert len(cut[1]) == 70 and len(cut[3]) == 5
    none = {r.rank: r.expanded_content for r in fusion.expand_to_section(found, chunks, 1, 8000, 20).collect()}
    assert len(none[1]) == 20 and none[3] is None


@pytest.mark.parametrize("expected,path,want", [("4.2", ["4", "2", "2", "3"], True), ("4.20", ["4", "2"], False), ("4.2", ["4", "2"], True), ("4.2", ["4", "20", "1"], False), ("", ["4"], False), ("4", [], False)])
def test_section_prefix(spark, expected, path, want):
    df = spark.createDataFrame([(expected, path)], "e string, p array<string>")
    assert df.select(evaluation.is_section_prefix(F.col("e"), F.col("p")).alias("x")).first().x is want


def test_drift(spark):
    ids = lambda *xs: spark.createDataFrame([("a", x) for x in xs], "spec_id string, chunk_id string")
    overall = lambda o, n: sets.id_drift(o, n, 0.5).where("overall = 1").first()
    assert overall(ids("1", "2"), ids("1", "2")).drift == 0.0 and overall(ids("1"), ids("2")).drift == 1.0
    assert overall(ids("1", "2", "3", "4", "5"), ids("1", "2", "3", "4", "6")).drift == pytest.approx(1 / 3, abs=1e-6)
    assert overall(ids("1").limit(0), ids("1").limit(0)).passed


def test_percentiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 13)], "x double")
    wanted = {"nearest": (0.5, "nearest"), "upper": (0.5, "upper"), "median": (0.5, "median"), "exclusive": (0.9, "exclusive")}
    got = aggregates.percentiles(df, [], "x", wanted).first()
    import statistics

    xs = list(map(float, range(1, 13)))
    assert (got.nearest, got.upper, got.median) == (sorted(xs)[round(0.5 * 11)], xs[6], statistics.median(xs)) and got.exclusive == pytest.approx(statistics.quantiles(xs, n=10)[8])
    keyed = spark.createDataFrame([("a", 3), ("a", 1), ("a", 1), (None, 7), ("b", None)], "k string, x int")
    few = {r.k: r for r in aggregates.percentiles(keyed, ["k"], "x", wanted).collect()}
    assert {k: (r.nearest, r.upper, r.median, r.exclusive) for k, r in few.items()} == {"a": (1, 1, 1, None), None: (7, 7, 7, None), "b": (0, None, None, None)}
    rng = random.Random(3)
    many = [(g, float(rng.randrange(40)) if g == "a" else rng.random()) for g in "ab" for _ in range(3001)]
    got = {r.k: r for r in aggregates.percentiles(spark.createDataFrame(many, "k string, x double"), ["k"], "x", {"p": (0.95, "nearest"), "e": (0.9, "exclusive")}).collect()}
    for g in "ab":
        xs = sorted(x for k, x in many if k == g)
        assert got[g].p == xs[round(0.95 * 3000)] and got[g].e == pytest.approx(statistics.quantiles(xs, n=10)[8])


def test_alerts(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 1), 5.0), (dt.date(2024, 1, 31), 9.0)], "day date, total_cost_usd double")
    row = usage.cost_alerts(df, F.lit("2024-02-01").cast("date"), 8.0, 20.0, 4.0).first()
    assert (row.daily_cost, row.monthly_cost, row.daily_warning, row.daily_critical, row.monthly_warning) == (9.0, 5.0, True, False, True)
    off = usage.cost_alerts(df, F.lit("2024-02-01").cast("date"), 0.0, -1.0, 0.0).first()
    assert not (off.daily_warning or off.daily_critical or off.monthly_warning)


def test_align_and_merge(spark):
    a = spark.createDataFrame([("q", "A", "x", 0), ("q", "B", "y", 1), ("r", "B", "z", 2), ("q", "A", "later", 3)], "item_id string, system string, answer string, ord int")
    assert [(r.item_id, r.A, r.B) for r in joins.align_systems(a, ["A", "B"]).orderBy("first").collect()] == [("q", "x", "y"), ("r", None, "z")]


def test_history_and_rollback(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(12)] + [(2, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(7)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): r.n for r in windows.history_window(m).groupBy("conv_id", "part").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "recent"): 6, (1, "older"): 6, (2, "recent"): 6}
    back = {r.conv_id: (r.kept, r.deleted) for r in windows.rollback_turns(m, 2).collect()}
    assert back == {1: (8, 4), 2: (4, 3)}


def test_plans_keep_to_built_in_operators(spark):
    d = "/root/testdata/sf0.001"
    from corpuslens.plans import QUERIES

    for name in ("prj19_sanitize", "ret02_bm25_topk", "chk01_sectionize", "agg05_usage_daily", "evl07_score_answers"):
        plan = QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert "WindowGroupLimit" in QUERIES["win13_topk"](spark, d)._jdf.queryExecution().executedPlan().toString()


def run(df, tmp_path, mode="append"):
    import uuid

    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture
def events(spark, tmp_path):
    base = dt.datetime(2024, 1, 1, 15, 0)
    rows = [(i, i % 3, base + dt.timedelta(minutes=17 * i), "view", "admin" if i % 3 == 2 else "user") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, bucket string, role string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    flush = spark.createDataFrame([(999, 99, base + dt.timedelta(days=30), "none", "admin")], df.schema)
    return df, lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), flush


def test_rate_windows_as_a_stream(spark, events, tmp_path):
    batch, make, _ = events
    want = {(r.user_id, r.window_start): r.n for r in usage.rate_windows(batch, {"view": (3600, 2)}).groupBy("user_id", "window_start").agg(F.max("n").alias("n")).collect()}
    got = run(stream.rate_windows(make(), "view", 3600, 2), tmp_path, "complete").collect()
    assert {(r.user_id, r.window_start): r.n for r in got} == want and all(r.over == (r.n > 2) for r in got)


def test_streaming_dedupe(spark, events, tmp_path):
    _, make, _ = events
    got = run(stream.dedupe(make().select(F.col("user_id").alias("chunk_id"), "ts"), "60 days"), tmp_path)
    assert got.count() == 3


def test_usage_cube_and_trailing_as_streams(spark, tmp_path):
    rows = [(i, i % 2, dt.datetime(2024, 1, 1 + i % 9, 3), "chat", 10 + i, 1, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, kind string, input_tokens long, output_tokens long, cost double")
    df.coalesce(1).write.parquet(str(tmp_path / "calls"))
    make = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "calls"))
    want = {(r.user_id, r.day): (r.llm_input_tokens, r.total_cost_usd) for r in usage.usage_daily(df).collect()}
    got = {(r.user_id, r.day): (r.llm_input_tokens, r.total_cost_usd) for r in run(stream.usage_cube(make()), tmp_path, "complete").collect()}
    assert got == want
    trailing = {r.day: r.trailing_cost for r in usage.trailing_usage(usage.usage_daily(df)).collect()}
    streamed = {r.day: r.trailing_cost for r in run(stream.trailing_usage(make()), tmp_path, "complete").collect()}
    assert {d: streamed[d] for d in trailing} == pytest.approx(trailing)
    path = str(tmp_path / "cube")
    write = stream.upsert_into(path, ["user_id", "day"])
    for number in (0, 1, 1):
        write(usage.usage_daily(df.where(f"event_id < {20 + 20 * number}")), number)
    newest = stream.latest(spark.read.parquet(path).drop("batch"), ["user_id", "day"])
    assert {(r.user_id, r.day): (r.llm_input_tokens, r.total_cost_usd) for r in newest.collect()} == want


def test_a_kept_lexical_index_gives_what_a_search_without_one_gives(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "the PDU session one one"), (2, "session two"), (3, None), (4, "of the"), (5, "one two three session")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "PDU session session"), (2, "the of"), (3, None), (4, "three one")], "query_id long, text string")
    bm25.write_bm25(bm25.build_bm25(chunks), str(tmp_path))
    one = sorted(map(tuple, bm25.bm25_topk(asked, bm25.read_bm25(spark, str(tmp_path)), 2).collect()))
    assert one == sorted(map(tuple, bm25.bm25_search(asked, chunks, 2).collect())) and [r[:3] for r in one] == [(1, 1, 1), (1, 2, 2), (4, 1, 5), (4, 2, 1)]
    assert bm25.bm25_search(asked, chunks.limit(0), 2).count() == 0


def test_operators_don_t_depend_on_the_order_of_rows(spark):
    from corpuslens.plans.retrieval_queries import hits as real_hits

    d = "/root/testdata/sf0.001"
    one = real_hits(spark, d)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(fusion.rrf(one)) == rows(fusion.rrf(one.orderBy(F.rand(1)).repartition(7)))


def test_text_of_nulls_and_blanks(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",)], "t string")
    t = F.col("t")
    got = df.select(
        T.sanitize(t).alias("a"), T.image_refs(t).alias("b"), T.salient_terms(t).alias("c"), T.is_closed_book(t).alias("d"), T.formula_symbols(t).alias("e"), T.has_stripped_formula(t).alias("f"),
        T.doc_title(t).alias("g"), T.extract_spec_ids(t).alias("h"), T.parse_option(t).alias("i"), T.chunk_body(t).alias("j"),
    ).collect()
    assert all(r.a == "" and r.b == [] and r.c == [] and r.d and r.e == [] and not r.f and r.g is None and r.h == [] and r.i is None for r in got)


def test_a_sweep_of_many_configurations_keeps_them_all(spark):
    from corpuslens.plans.corpus_queries import table
    from corpuslens.plans.relational_queries import _golden
    from corpuslens.plans.retrieval_queries import hits

    sf = "/root/testdata/sf0.001"
    places = table(spark, sf, "documents").selectExpr("doc_id as chunk_id", "source as spec_id", "array(cast(doc_id % 7 as string), cast(doc_id % 3 as string)) as section_path", "'' as clause", "lang as section_title")
    found, golden = hits(spark, sf).where("rank <= 2"), _golden(spark, sf)
    many = spark.range(1010).selectExpr("cast(id as int) as config_id", "'rrf' as kind", "2 as dense_depth", "2 as sparse_depth", "60 as rrf_k", "2 as top_n", "cast(null as int) as rerank_k")
    got = evaluation.sweep(found, golden, places, many)[0].collect()
    few = {r.config_id: r for r in evaluation.sweep(found, golden, places, many.where("config_id < 3"))[0].collect()}
    with pytest.raises(ValueError):
        evaluation.sweep(found, golden, places, many.withColumn("kind", F.lit("other")))
    assert sorted(r.config_id for r in got) == list(range(1010))
    assert all(r[1:] == few[0][1:] for r in got) and len(few) == 3


def test_a_sweep_keeps_the_place_of_a_candidate_without_a_chunk(spark):
    """It fills a place of the list before it is cut, and isn't counted as a hit."""
    found = spark.createDataFrame([(1, 0, r, c, 0.5, None) for r, c in ((1, 90), (2, 10), (3, 11))], "query_id long, list_no int, rank int, chunk_id long, score_dense double, score_sparse double")
    places = spark.createDataFrame([(10, "a", ["1"], "", ""), (11, "b", ["1"], "", "")], "chunk_id long, spec_id string, section_path array<string>, clause string, section_title string")
    golden = spark.createDataFrame([(1, [("b", [])])], "query_id long, expected array<struct<spec_id:string,sections:array<string>>>")
    configs = spark.createDataFrame([(1, "dense", 3, 0, 60, 2, None), (2, "dense", 3, 0, 60, 3, None)], "config_id int, kind string, dense_depth int, sparse_depth int, rrf_k int, top_n int, rerank_k int")
    got = {r.config_id: (r.n_hits, r.mrr) for r in evaluation.sweep(found, golden, places, configs)[1].collect()}
    assert got == {1: (1, 0.0), 2: (2, 1 / 3)}


def test_facts_of_long_texts_are_read_once(spark):
    """Words of a fact are sought in the text's distinct words; a text isn't normalised again for each word."""
    rng = random.Random(8)
    make = lambda n, letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(n))
    rows = [(make(30, "ab"), make(rng.randrange(1, 60), "abC-"), i) for i in range(200)] + [("a b", "x A-b y", 200), ("a b", "xa b", 201), ("", "", 202), ("abcd", None, 203), (None, "abcd", 204)]
    rows += [("abcd abcd zzzz", "xabcdx", 205), ("abcd zzzz zzzz", "xabcdx zz zz", 206), (make(30_000, "abcdef"), make(30_000, "abcdef"), 207)]

    def want(fact, text):
        if fact is None or text is None:
            return None
        norm = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip(" ")
        hay, words = f" {norm(text)} ", [w for w in norm(fact).split(" ") if len(w) >= 4]
        return sum(w in hay for w in words) / len(words) >= 0.6 if words else norm(fact) in hay

    t, begun = spark.createDataFrame(rows, "fact string, text string, i int"), time.time()
    got = {r.i: r.p for r in t.select("i", evaluation.fact_in_text(F.col("fact"), F.col("text")).alias("p")).collect()}
    assert got == {i: want(f, x) for f, x, i in rows} and time.time() - begun < 30


def test_targets_that_are_no_ids_dont_share_a_task(spark):
    """Only numbers are joined; others keep their rows without a preview."""
    rows = [(i, t) for i, t in enumerate(["1", "2", "x1", None, "x1", "", "9", " 1 "] * 3)]
    t, m = spark.createDataFrame(rows, "i int, target_id string"), spark.createDataFrame([(1, "one"), (2, "two"), (None, "none")], "message_id long, text string")
    got = joins.enrich_targets(t, m, F.col("text"))
    assert {r.i: r.preview for r in got.collect()} == {i: {"1": "one", "2": "two", " 1 ": "one"}.get(x) for i, x in rows} and got.count() == len(rows)
    joined = got._jdf.queryExecution().optimizedPlan().toString().split("Join ")[1]
    assert "isnotnull(try_cast(target_id" in joined or "isnotnull(cast(target_id" in joined


def test_lexical_tasks_grow_with_the_chunks_and_change_nothing(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(i, " ".join(f"w{i % j}" for j in range(1, 9))) for i in range(120)] + [(200, None)], "chunk_id long, content string")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i}") for i in range(6)], "query_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    index = bm25.build_bm25(chunks)
    whole, kept_ = rows(bm25.bm25_search(asked, chunks, 7)), rows(bm25.bm25_topk(asked, index, 7))
    assert bm25._tasks(spark, 10) == 4 and bm25._tasks(spark, 10 * bm25.CHUNKS_PER_TASK + 1) == 11
    monkeypatch.setattr(bm25, "CHUNKS_PER_TASK", 8)
    assert "RepartitionByExpression [chunk_id" in bm25.bm25_search(asked, chunks, 7)._jdf.queryExecution().toString()
    assert rows(bm25.bm25_search(asked, chunks, 7)) == whole == kept_ == rows(bm25.bm25_topk(asked, bm25.build_bm25(chunks), 7))
    assert index.corpus.first()["n"] == 121 and index.postings.where("term = ''").count() == 0


def test_lexical_tasks_grow_with_the_queries_and_shuffle_no_words(spark, monkeypatch):
    """A chunk has a score for each query, so a task holds fewer chunks where more is asked; texts are shuffled, not their words."""
    plans, real = {}, bm25.kept
    monkeypatch.setattr(bm25, "kept", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or real(df, name))
    chunks = spark.createDataFrame([(i, " ".join(f"w{i % j}" for j in range(1, 9))) for i in range(120)], "chunk_id long, content string")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i}") for i in range(6)], "query_id long, text string")
    rows = lambda: sorted(map(tuple, bm25.bm25_search(asked, chunks, 7).collect()))
    whole = rows()
    monkeypatch.setattr(bm25, "SCORES_PER_TASK", 32)
    assert bm25._tasks(spark, 120, 6) == 23 and rows() == whole
    assert plans["found"].index("Generate explode") < plans["found"].index("RepartitionByExpression [chunk_id") and ", 23" in plans["found"]


def test_runs_are_dealt_into_more_tasks_as_they_grow(spark, monkeypatch):
    from corpuslens.operators import joins as J

    monkeypatch.setattr(J, "ROWS_PER_TASK", 10)
    rows = spark.createDataFrame([(i % 50, float(i)) for i in range(100)], "item_id long, m double")
    a = J.dealt_runs(rows, "item_id", 100).groupBy("item_id").agg(F.max("m").alias("m"))
    b = J.dealt_runs(rows.where("item_id < 20"), "item_id", 100).groupBy("item_id").agg(F.min("m").alias("m"))
    assert J.dealt_runs(rows, "item_id", 100).rdd.getNumPartitions() == 10 and J.dealt_runs(rows, "item_id", 9).rdd.getNumPartitions() == 4
    got = {r.item_id: r.m for r in J.merge_runs(a, b, ["m"], "second_unless_none").collect()}
    assert got == {i: float(i if i < 20 else i + 50) for i in range(50)}
