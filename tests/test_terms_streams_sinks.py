"""Terms in texts, streams over several deliveries, snapshots, reference texts."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import joins as J
from corpuslens.operators import sets as S
from corpuslens.operators import usage
from corpuslens.sources import snapshots, write
from corpuslens.streaming import corpus as follow
from corpuslens.streaming import processors
from corpuslens.streaming import usage as stream

# terms

CHUNKS = [
    ("a", "Random access begins.\nThe RRC-Setup, then more"), ("a", "random ACCESS again"), ("b", "no random  access here; rrc-setup"), ("c", "Zugriff über Öl, wahlfrei"),
    ("d", None), (None, "random access"), ("e", ""), ("f", "aaaa"),
]


@pytest.mark.parametrize("term_bytes", [8 << 20, 100])
def test_terms_are_any_text(spark, term_bytes):
    chunks = spark.createDataFrame(CHUNKS, "spec_id string, content string").withColumns({x: F.lit(1) for x in ("term", "number", "lowered")})
    terms = ["random access", "RRC-Setup", "Setup, then", "access", "cess", " random access ", "ÖL, WAHL", "", "  ", None, "aa", "aaa", "aaaaa", "begins.\nthe", "random access", "(", "never"]
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {r.term: r.n_documents for r in J.term_document_counts(wanted, chunks, term_bytes).collect()}
    want = {t: len({s for s, c in CHUNKS if s and c and t.strip(" ") and t.strip(" ").lower() in c.lower()}) for t in terms if t is not None}
    assert got == want and got["random access"] == 1 and got["RRC-Setup"] == 2 and got["cess"] == 2


def test_no_terms_and_no_texts(spark):
    chunks, terms = spark.createDataFrame(CHUNKS, "spec_id string, content string"), spark.createDataFrame([("access",)], "term string")
    assert J.term_document_counts(terms.limit(0), chunks).count() == 0
    assert [tuple(r) for r in J.term_document_counts(terms, chunks.limit(0)).collect()] == [("access", 0)]


def test_gate_drops_items_whose_phrase_is_known(spark):
    chunks = spark.createDataFrame([(f"s{i}", "the random access channel") for i in range(3)] + [("t", "a quiet RRC-Setup")], "spec_id string, content string")
    items = spark.createDataFrame([(1, ["abc", "random access"]), (2, ["RRC-Setup"]), (3, []), (4, ["the"])], "item_id int, terms array<string>")
    counts = J.term_document_counts(items.select(F.explode("terms").alias("term")), chunks)
    assert {r.item_id: (r.found, r.kept) for r in S.symmetry_gate(items, counts).collect()} == {1: ("random access", False), 2: (None, True), 3: (None, True), 4: (None, True)}


# snapshots


def test_replacement_is_seen_whole_or_not_at_all_and_counted(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "spec_id string, n int"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    read = lambda version=None: sorted(map(tuple, snapshots.read_table(spark, path, version).collect()))
    snapshots.create_table(spark, path, spark.createDataFrame([], schema).schema, buckets=4)
    assert read() == []
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        snapshots.create_table(spark, path, spark.createDataFrame([], schema).schema)
    assert snapshots.replace_documents(make(*[("a", i) for i in range(5)], ("b", 1), ("c", 1)), path) == {"version": 1, "deleted": 0, "inserted": 7, "documents": 3}
    open_reader = snapshots.read_table(spark, path)
    assert snapshots.replace_documents(make(*[("a", i) for i in range(10, 13)]), path) == {"version": 2, "deleted": 5, "inserted": 3, "documents": 1}
    assert len(open_reader.collect()) == 7  # an open reader keeps its version
    assert read() == [("a", 10), ("a", 11), ("a", 12), ("b", 1), ("c", 1)] and len(read(1)) == 7
    assert snapshots.replace_documents(make(("d", 1)), path, spark.createDataFrame([("b",), ("unknown",), (None,)], "spec_id string")) == {"version": 3, "deleted": 1, "inserted": 1, "documents": 3}
    assert snapshots.purge_documents(spark.createDataFrame([("a",), ("c",), ("d",)], "spec_id string"), path)["deleted"] == 5
    assert read() == [] and len(read(3)) == 5
    with pytest.raises(ValueError):
        snapshots.replace_documents(make((None, 1)), path)
    assert {r.version: (r.deleted, r.inserted, r.n_rows) for r in snapshots.commits(spark, path).collect()} == {0: (0, 0, 0), 1: (0, 7, 7), 2: (5, 3, 5), 3: (1, 1, 5), 4: (5, 0, 0)}


def test_a_failed_replacement_leaves_the_table(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "spec_id string, n int"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], schema)
    snapshots.create_table(spark, path, rows.schema, buckets=2)
    snapshots.replace_documents(rows, path)
    with pytest.raises(Exception):
        snapshots.replace_documents(rows.withColumn("n", F.raise_error(F.lit("broken")).cast("int")), path)
    assert sorted(map(tuple, snapshots.read_table(spark, path).collect())) == [("a", 1), ("b", 2)]
    assert os.listdir(f"{path}/commits") and snapshots.commits(spark, path).count() == 2


def test_upsert_doesnt_hang_on_order(spark):
    old = spark.createDataFrame([(1, "p", "old"), (2, "p", "old")], "chunk_id int, provider string, v string")
    for rows in ([(1, "p", "b"), (1, "p", "a"), (3, "p", None), (3, "p", "x")], [(3, "p", "x"), (1, "p", "a"), (3, "p", None), (1, "p", "b")]):
        got = write.upsert_chunks(old, spark.createDataFrame(rows, old.schema).coalesce(1))
        assert sorted((r.chunk_id, r.v) for r in got.collect()) == [(1, "a"), (2, "old"), (3, "x")]


# streams over several deliveries

START = dt.datetime(2024, 3, 1)


def deliver(spark, tmp_path, rows, schema, parts):
    """A stream of one file a batch: ``parts`` says in which delivery each row comes."""
    path = str(tmp_path / "in")
    for n in range(max(parts) + 1):
        spark.createDataFrame([r for r, p in zip(rows, parts) if p == n], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def to_end(spark, df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    query = df.writeStream.foreachBatch(stream.upsert_into(out, [])).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def test_quota_edges_follow_the_order_of_events(spark, tmp_path):
    rng = random.Random(2)
    schema = "event_id long, user_id long, ts timestamp, role string"
    rows = [(i, i % 3, START + dt.timedelta(minutes=rng.randrange(5 * 24 * 60)), "admin" if i % 17 == 0 else "user") for i in range(300)]
    rows += [(400 + i, 1, START + dt.timedelta(hours=12), "user") for i in range(3)]  # ties
    batch = spark.createDataFrame(rows, schema)
    rows += [(900, 5, START + dt.timedelta(days=40), "user")]  # lets all before it end
    parts = [rng.randrange(4) for _ in rows[:-1]] + [4]
    got = to_end(spark, processors.daily_quota(deliver(spark, tmp_path, rows, schema, parts), "Asia/Shanghai", 4, "10 days"), tmp_path)
    want = sorted((r.user_id, str(r.local_day), r.event_id, r.n, r.edge) for r in usage.daily_quota(batch, "Asia/Shanghai", 4).where("edge is not null").collect())
    assert sorted((r.user_id, r.local_day, r.event_id, r.n, r.edge) for r in got.collect()) == want


def test_quota_of_nought_is_off(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp, role string"
    rows = [(1, 1, START, "user"), (2, 1, START + dt.timedelta(days=3), "user")]
    path = str(tmp_path / "out")
    query = processors.daily_quota(deliver(spark, tmp_path, rows, schema, [0, 1]), "UTC", 0).writeStream.format("parquet").option("path", path)
    query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("user_id long").parquet(path).count() == 0


def test_runs_are_folded_whole_and_sent_once(spark, tmp_path):
    rng = random.Random(6)
    schema = "run_id long, seq long, event string, data string, ts timestamp"
    rows = []
    for run_id in range(12):
        events = [("run_start", None), ("token", "{}"), ("node_end", '{"node": "a", "duration_ms": %d}' % run_id), ("chunks_hit", '{"chunks": [1, {"x": "y"}]}'), ("node_end", '{"node": "b"}'), ("token", None)]
        events += [("node_end", '{"node": "a", "duration_ms": 7}'), ("chunks_rerank", '{"chunks": ["p"]}'), ("chunks_rerank", '{"chunks": ["q", "r"]}'), ("chunks_expanded", "no json"), ("token", "{}")]
        events += {0: [("final", '{"answer": "old"}'), ("final", '{"answer": "new", "citations": [3], "confidence": 0.5}')], 1: [("error", '{"why": "x"}')], 2: [("cancelled", "{}"), ("end", None)], 3: [("end", None)], 4: [], 5: [("final", "{}"), ("end", "{}")]}[run_id % 6]
        rows += [(run_id, n, e, data, START + dt.timedelta(hours=run_id, seconds=n)) for n, (e, data) in enumerate(events)]
    batch = spark.createDataFrame(rows, schema)
    n = len(rows)
    rows += [(99, 0, "token", None, START + dt.timedelta(days=30)), (0, 50, "token", "{}", START + dt.timedelta(days=30)), (0, 51, "final", '{"answer": "again"}', START + dt.timedelta(days=30)), (98, 0, "token", None, START + dt.timedelta(days=60))]
    parts = [rng.randrange(3) for _ in range(n)] + [3, 4, 4, 5]
    got = to_end(spark, processors.fold_run_events(deliver(spark, tmp_path, rows, schema, parts), "2 days", memory="60 days"), tmp_path)
    plain = lambda r: (r.run_id, r.answer, r.n_tokens, [tuple(x) for x in r.node_durations], r.chunks_hit, r.chunks_rerank, r.chunks_expanded, r.citations, r.confidence, r.terminal, r.error)
    assert sorted(plain(r) for r in got.where("run_id < 99 and run_id <> 98").collect()) == sorted(plain(r) for r in usage.fold_run_events(batch).collect())
    assert got.where("run_id = 99").count() == 1 and got.where("run_id = 98").count() == 0


def test_month_to_date_as_calls_arrive(spark, tmp_path):
    rng = random.Random(3)
    schema = "event_id long, user_id long, ts timestamp, kind string, input_tokens long, output_tokens long, cost double"
    rows = [(i, i % 2, dt.datetime(2024, 1, 20) + dt.timedelta(hours=rng.randrange(24 * 60)), "chat", 10 + i, 1, float(i)) for i in range(80)]
    parts = [rng.randrange(4) for _ in rows]
    streamed = to_end(spark, stream.trailing_usage(deliver(spark, tmp_path, rows, schema, parts), delay="90 days"), tmp_path, "update")
    got = {r.day: (r.trailing_cost, r.trailing_tokens, r.month_cost) for r in stream.latest(streamed, ["day"]).collect()}
    want = {r.day: (r.trailing_cost, r.trailing_tokens, r.month_cost) for r in usage.trailing_usage(usage.usage_daily(spark.createDataFrame(rows, schema))).collect()}
    assert {d: got[d] for d in want} == want and len(got) > len(want)


def test_corpus_follows_its_listing(spark, tmp_path):
    listing, corpus = str(tmp_path / "listing"), str(tmp_path / "corpus")
    content = {("p1", "1"): "x y", ("p2", "1"): "z", ("p3", "1"): "w", ("p1", "2"): "new"}
    store = spark.createDataFrame([(*k, v) for k, v in content.items()], "path string, digest string, text string")
    built = []

    def build(files):
        built.append(sorted(r.path for r in files.collect()))
        return files.join(store, ["path", "digest"]).selectExpr("spec_id", "explode(split(text, ' ')) as word")

    snapshots.create_table(spark, listing, spark.createDataFrame([], follow.LISTING).schema, buckets=4)
    snapshots.create_table(spark, corpus, spark.createDataFrame([], "spec_id string, word string").schema, buckets=4)

    def publish(*files):
        return follow.publish_listing(spark.createDataFrame(list(files), follow.LISTING), listing)

    def take():
        follow.stream_corpus(spark, listing, corpus, str(tmp_path / "state"), build)
        return sorted(map(tuple, snapshots.read_table(spark, corpus).collect()))

    publish(("a", "p1", "1"), ("b", "p3", "1"))
    assert take() == [("a", "x"), ("a", "y"), ("b", "w")]
    publish(("a", "p1", "1"), ("a", "p2", "1"), ("b", "p3", "1"))  # the rest of a document
    assert take() == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "w")] and built[-1] == ["p1", "p2"]
    version = snapshots.commits(spark, corpus).count()
    assert publish(("a", "p2", "1"), ("a", "p1", "1"), ("b", "p3", "1"))["documents"] == 0
    assert take() and snapshots.commits(spark, corpus).count() == version  # nothing differs
    publish(("a", "p1", "2"), ("a", "p2", "1"))
    publish(("a", "p1", "2"))  # two commits at once: a file changed, a file gone, a document gone
    assert take() == [("a", "new")]
    write_again = follow.apply_listings(listing, corpus, str(tmp_path / "state" / "applied"), build)
    write_again(spark.createDataFrame([(0, 4)], "bucket int, version int"), 3)  # a replayed batch
    assert sorted(map(tuple, snapshots.read_table(spark, corpus).collect())) == [("a", "new")]


def test_many_days_and_runs_share_few_groups(spark, tmp_path):
    """State is kept by bucket: 240 days of users and 60 runs are few groups, and their rows are those of the batch forms."""
    rng = random.Random(4)
    schema = "event_id long, user_id long, ts timestamp, role string, run_id string, seq long, event string, data string"
    events = [("token", None), ("node_end", '{"node": "a", "duration_ms": 3}'), ("chunks_hit", '{"chunks": [1]}'), ("final", '{"answer": "x"}'), ("error", "{}"), ("end", None), (None, None), ("odd", "{}")]
    rows = [(i, rng.choice([*range(60), None]), START + dt.timedelta(minutes=rng.randrange(4 * 24 * 60)), "user", rng.choice([None, *map(str, range(60))]), i, *rng.choice(events)) for i in range(900)]
    batch = spark.createDataFrame(rows, schema)
    rows += [(9999, 77, START + dt.timedelta(days=40), "user", "last", 9999, "token", None)]  # lets all before it end
    parts = [rng.randrange(3) for _ in rows[:-1]] + [3]
    delivered = deliver(spark, tmp_path, rows, schema, parts)
    quota = to_end(spark, processors.daily_quota(delivered, "Asia/Shanghai", 2, "10 days", buckets=3), tmp_path / "quota")
    assert 0 < spark.read.format("statestore").option("stateVarName", "least").load(str(tmp_path / "quota/state")).count() <= 3
    want = usage.daily_quota(batch, "Asia/Shanghai", 2).where("edge is not null").collect()
    plain = lambda r: str((r.user_id, str(r.local_day), r.event_id, r.n, r.edge))
    assert sorted(map(plain, quota.collect())) == sorted(map(plain, want))
    runs = to_end(spark, processors.fold_run_events(delivered, "10 days", memory="60 days", buckets=3), tmp_path / "runs").drop("_batch")
    assert sorted(map(str, runs.collect())) == sorted(map(str, usage.fold_run_events(batch).select(runs.columns).collect()))
