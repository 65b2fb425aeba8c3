"""Sinks and streams over the tables: what is written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.plans.registry import query, table
from corpuslens.plans.set_queries import _DAILY, _P, KIND
from corpuslens.operators import usage as U
from corpuslens.sources import read, snapshots, write
from corpuslens.sources.scratch import scratch_path, with_scheme
from corpuslens.streaming import corpus as follow
from corpuslens.streaming import processors
from corpuslens.streaming import usage as stream


@query("select doc_id, source as spec_id, case when source in ('src1', 'src2') then 'new' else 'old' end as v from documents where source not in ('src1', 'src2') or doc_id % 3 = 0")
def snk02_replace_documents(spark, d):
    path = scratch_path(spark, "snk02")
    t = table(spark, d, "documents").select("doc_id", F.col("source").alias("spec_id"))
    old = t.withColumn("v", F.lit("old"))
    snapshots.create_table(spark, path, old.schema)
    snapshots.replace_documents(old, path)
    snapshots.replace_documents(t.where("spec_id in ('src1', 'src2') and doc_id % 3 = 0").withColumn("v", F.lit("new")), path)
    return snapshots.read_table(spark, path)


@query("""
with d as (select doc_id, source || '/' || (doc_id % 50) as spec_id, source, doc_id % 50 as k from documents),
v as (select *, k < 10 as again, k >= 40 as gone from d),
c as (select 1 as version, 0 as deleted, count(*) as inserted, count(distinct spec_id) as documents from v
      union all select 2, count(*) filter (again), count(*) filter (again and doc_id % 3 = 0), count(distinct spec_id) filter (again) from v
      union all select 3, count(*) filter (gone), 0, count(distinct spec_id) filter (gone) from v)
select 'row' as kind, doc_id as a, spec_id, case when again then 'new' else 'old' end as v, 0 as b, 0 as n from v where not gone and (not again or doc_id % 3 = 0)
union all select 'commit', version, '', '', deleted, inserted * 1000000 + documents from c""")
def snk02_snapshots(spark, d):
    """A table with its three commits: everything, a fifth of the documents replaced (some by nothing), a fifth purged."""
    path = scratch_path(spark, "snk02")
    t = table(spark, d, "documents").selectExpr("doc_id", "concat(source, '/', cast(doc_id % 50 as string)) as spec_id", "doc_id % 50 as k", "'old' as v")
    rows = t.drop("k")
    snapshots.create_table(spark, path, rows.schema, buckets=16)
    snapshots.replace_documents(rows, path)
    again = t.where("k < 10")
    snapshots.replace_documents(again.where("doc_id % 3 = 0").drop("k").withColumn("v", F.lit("new")), path, again)
    snapshots.purge_documents(t.where("k >= 40"), path)
    told = snapshots.commits(spark, path).where("version > 0").select(
        F.lit("commit").alias("kind"), F.col("version").cast("long").alias("a"), F.lit("").alias("spec_id"), F.lit("").alias("v"), F.col("deleted").alias("b"), (F.col("inserted") * 1000000 + F.col("documents")).alias("n")
    )
    left = snapshots.read_table(spark, path).select(F.lit("row").alias("kind"), F.col("doc_id").alias("a"), "spec_id", "v", F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    return left.unionByName(told)


@query("select doc_id as term, source as spec_id from documents where source not in ('src1', 'src2') union all select doc_id, source from documents where source = 'src2' and lang = 'en'")
def snk07_write_glossary(spark, d):
    path = scratch_path(spark, "snk07")
    t = table(spark, d, "documents").select(F.col("doc_id").alias("term"), F.col("source").alias("spec_id"), "lang")
    snapshots.create_table(spark, path, t.drop("lang").schema)
    snapshots.write_glossary(t.drop("lang"), t, path)
    both = t.where("spec_id in ('src1', 'src2')")
    snapshots.write_glossary(both.where("spec_id = 'src2' and lang = 'en'").drop("lang"), both, path)
    return snapshots.read_table(spark, path)


@query("select doc_id, text, lang from documents where trim(lang) <> '' and lang <> 'de'")
def snk08_export_jsonl(spark, d):
    path = scratch_path(spark, "snk08")
    write.export_jsonl(table(spark, d, "documents").select("doc_id", "text", F.when(F.col("lang") != "de", F.col("lang")).alias("lang")), path)
    return read.read_jsonl(spark, path, "doc_id bigint, text string, lang string", ["lang"])


@query("select doc_id as spec_uid, lang as series from documents where source = 'src3'")
def src08_read_manifest(spark, d):
    path = scratch_path(spark, "src08")
    table(spark, d, "documents").select(F.col("doc_id").alias("spec_uid"), F.col("lang").alias("series"), F.col("source").alias("release")).write.partitionBy("release").parquet(path)
    return read.read_manifest(spark, path, "src3").select("spec_uid", "series")


#: Deliveries of the events, and the delay that their disorder needs: some events come with the next quarter of the month.
DELIVERIES, DELAY = 4, "16 days"
#: The watermark at the end of all deliveries, and that of a stream in milliseconds.
_MARK = "(select max(ts) - interval 16 day from events)"


#: Events of a file, at most about.
FILE_ROWS = 1 << 20


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of four deliveries, one a batch, each of as many files as its size asks for; a fifth of the events comes a delivery late, and none in order."""
    path = scratch_path(spark, "deliveries")
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    first, last, n_rows = rows.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts")), F.count(F.lit(1))).first()
    n_files = max(1, -(-n_rows // (DELIVERIES * FILE_ROWS)))
    share = F.floor((F.unix_timestamp("ts") - first) * DELIVERIES / (last - first + 1)).cast("int")
    dealt = rows.withColumn("_d", F.least(F.lit(DELIVERIES - 1), share + F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)))
    for n in range(DELIVERIES):
        dealt.where(F.col("_d") == n).drop("_d").repartition(n_files).sortWithinPartitions(F.xxhash64("event_id")).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", n_files).parquet(path)


def _to_end(df: DataFrame, mode: str, name: str) -> str:
    """Run a stream over what is there; each batch is written to a folder of its own."""
    path = scratch_path(df.sparkSession, name)
    q = df.writeStream.foreachBatch(stream.upsert_into(f"{path}/out", [])).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{path}/out"


@query(f"with {_DAILY} select * replace (day::varchar as day) from us")
def str04_usage_cube(spark, d):
    prices = spark.createDataFrame(_P, "kind string, model string, input_price double, output_price double, call_price double, billed boolean")
    calls = _events(spark, d).selectExpr(
        "event_id", "case when user_id % 11 = 0 then null else user_id end as user_id", "ts", f"{KIND} as kind", "concat('m', cast(user_id % 2 as string)) as model", "cast(floor(value) as bigint) - 2 as input_tokens",
        "event_id % 7 as output_tokens", "event_id % 5 - 1 as n_docs", "event_id % 13 as doc_tokens",
    )
    out = _to_end(stream.usage_cube(U.call_cost(calls, prices), DELAY), "update", "str04")
    newest = stream.latest(spark.read.parquet(out).drop("batch"), ["user_id", "day"])
    return newest.withColumns({"day": F.col("day").cast("string"), "total_cost_usd": F.round("total_cost_usd", 6)})


@query(f"""
with w as (select user_id, floor(epoch(ts) / 3600)::bigint * 3600 as window_start from events where event_type = 'view')
select user_id, window_start, count(*) as n, count(*) > 2 as over_limit from w where window_start + 3600 <= epoch({_MARK}) group by 1, 2""")
def str03_rate_windows_with_expiry(spark, d):
    """Windows whose end the watermark has passed: each is sent once, and its state ends."""
    e = _events(spark, d).selectExpr("event_id", "user_id", "event_type as bucket", "ts")
    out = _to_end(stream.rate_windows(e, "view", 3600, 2, DELAY), "append", "str03")
    return spark.read.parquet(out).select("user_id", "window_start", "n", F.col("over").alias("over_limit"))


@query("select user_id as chunk_id, count(*) as n from (select distinct user_id, floor(value) as v from events) group by user_id")
def str07_dedupe(spark, d):
    e = _events(spark, d).select(F.concat_ws("/", "user_id", F.floor("value")).alias("chunk_id"), "ts", "user_id")
    out = _to_end(stream.dedupe(e, "60 days"), "append", "str07")
    return spark.read.parquet(out).groupBy(F.col("user_id").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n"))


# the streaming forms of quota, runs and trailing cost


@query("select user_id, floor(epoch(ts) / 86400)::bigint * 86400 as window_start, count(*) as n, count(*) > 3 as over_limit from events where event_type = 'click' group by 1, 2")
def str01_rate_windows_stream(spark, d):
    e = _events(spark, d).select("user_id", F.col("event_type").alias("bucket"), "ts")
    out = _to_end(stream.rate_windows(e, "click", 86400, 3, DELAY), "update", "str01")
    return stream.latest(spark.read.parquet(out).drop("batch"), ["user_id", "window_start"]).withColumnRenamed("over", "over_limit")


@query(f"""
with n as (select event_id, user_id, ts, (ts + interval 8 hour)::date as local_day, row_number() over (partition by user_id, (ts + interval 8 hour)::date order by ts, event_id) as n from events where user_id % 5 <> 0)
select user_id, local_day::varchar as local_day, event_id, n, case n when 1 then 'first' else 'over' end as edge from n where n in (1, 4) and epoch_ms(ts) < epoch_ms({_MARK})""")
def str02_daily_quota_stream(spark, d):
    """Edges that the watermark has passed, in the order of events whatever their deliveries."""
    e = _events(spark, d).selectExpr("event_id", "user_id", "ts", "case when user_id % 5 = 0 then 'admin' else 'user' end as role")
    out = _to_end(processors.daily_quota(e, "Asia/Shanghai", 3, DELAY), "append", "str02")
    return spark.read.parquet(out).select("user_id", "local_day", "event_id", "n", "edge")


@query(f"""
with e as (select user_id || '/' || (ts::date)::varchar as run_id, event_id as seq, ts, case event_type when 'view' then 'token' when 'click' then 'node_end' when 'error' then 'error' when 'purchase' then 'final' when 'signup' then 'chunks_rerank' else 'end' end as event,
  event_id % 4 as nd, floor(value * 10)::bigint as ms, props from events),
r as (select run_id, coalesce('a' || max(seq) filter (where event = 'final'), '') as answer, count(*) filter (where event = 'token') as n_tokens,
  coalesce(arg_max(event, seq) filter (where event in ('final', 'error')), case when bool_or(event = 'end') then 'end' else 'incomplete' end) as terminal,
  coalesce(string_agg('n' || nd || ':' || ms, ',' order by seq) filter (where event = 'node_end'), '') as nodes, max(seq) filter (where event = 'chunks_rerank') as reranked,
  arg_max(props, seq) filter (where event = 'error') as error, max(ts) as last from e group by run_id)
select run_id, answer, n_tokens, terminal, nodes, '[' || reranked || ']' as chunks_rerank, error from r
where epoch_ms(last) + 1 + case when terminal in ('final', 'error') then 0 else 1800000 end <= epoch_ms({_MARK})""")
def str05_fold_run_events_stream(spark, d):
    """A run is a user's day. Runs that have ended, by a terminal event or by silence; the last ones are still open when the stream stops."""
    kind = "case event_type when 'view' then 'token' when 'click' then 'node_end' when 'error' then 'error' when 'purchase' then 'final' when 'signup' then 'chunks_rerank' else 'end' end"
    data = """case event_type when 'click' then to_json(named_struct('node', concat('n', cast(event_id % 4 as string)), 'duration_ms', cast(floor(value * 10) as bigint)))
      when 'purchase' then to_json(named_struct('answer', concat('a', cast(event_id as string)))) when 'signup' then to_json(named_struct('chunks', array(event_id))) else props end"""
    e = _events(spark, d).selectExpr("concat(cast(user_id as string), '/', cast(to_date(ts) as string)) as run_id", "event_id as seq", f"{kind} as event", f"{data} as data", "ts")
    out = _to_end(processors.fold_run_events(e, DELAY), "append", "str05")
    nodes = F.array_join(F.transform("node_durations", lambda x: F.concat(x["node"], F.lit(":"), x["ms"].cast("string"))), ",")
    return spark.read.parquet(out).select("run_id", "answer", "n_tokens", "terminal", nodes.alias("nodes"), "chunks_rerank", "error")


@query(f"""with {_DAILY}, d as (select day, sum(total_cost_usd) as c, sum(llm_input_tokens) as t from us group by day),
a as (select distinct unnest(generate_series(day, greatest(day + 7, last_day(day)), interval 1 day))::date as day from d)
select a.day::varchar as day, round(sum(case when d.day >= a.day - 7 then c else 0 end), 4) as trailing_cost, sum(case when d.day >= a.day - 7 then t else 0 end)::bigint as trailing_tokens,
  round(sum(case when date_trunc('month', d.day) = date_trunc('month', a.day) then c else 0 end), 4) as month_cost
from a join d on d.day <= a.day and (d.day >= a.day - 7 or date_trunc('month', d.day) = date_trunc('month', a.day)) group by a.day""")
def str08_trailing_usage_stream(spark, d):
    prices = spark.createDataFrame(_P, "kind string, model string, input_price double, output_price double, call_price double, billed boolean")
    calls = _events(spark, d).selectExpr(
        "event_id", "case when user_id % 11 = 0 then null else user_id end as user_id", "ts", f"{KIND} as kind", "concat('m', cast(user_id % 2 as string)) as model", "cast(floor(value) as bigint) - 2 as input_tokens",
        "event_id % 7 as output_tokens", "event_id % 5 - 1 as n_docs", "event_id % 13 as doc_tokens",
    )
    out = _to_end(stream.trailing_usage(U.call_cost(calls, prices), delay=DELAY), "update", "str08")
    newest = stream.latest(spark.read.parquet(out).drop("batch"), ["day"])
    return newest.select(F.col("day").cast("string").alias("day"), F.round("trailing_cost", 4).alias("trailing_cost"), "trailing_tokens", F.round("month_cost", 4).alias("month_cost"))


@query("""
select doc_id, source as spec_id, length(coalesce(text, '')) as chars, doc_id % 5 = 0 and source = 'src3' as changed from documents
where source <> 'src1' and not (source = 'src2' and doc_id % 3 = 0)""")
def str06_stream_corpus(spark, d):
    """Three listings of the documents' rows as files: half of each document, then all, then one source gone, files of one gone, files of one changed."""
    path = scratch_path(spark, "str06")
    docs = table(spark, d, "documents").where("source is not null")
    files = docs.select(F.col("source").alias("spec_id"), F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    number = F.col("path").cast("long")
    last = files.where("spec_id <> 'src1'").where(~((F.col("spec_id") == "src2") & (number % 3 == 0)))
    last = last.withColumn("digest", F.when((F.col("spec_id") == "src3") & (number % 5 == 0), F.lit("new")).otherwise(F.col("digest")))

    def build(listed: DataFrame) -> DataFrame:
        """Rows of a document from its files, each of which the store has by its path."""
        stored = docs.select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
        return listed.join(stored, "path").select("doc_id", "spec_id", "chars", (F.col("digest") == "new").alias("changed"))

    listing, corpus = f"{path}/listing", f"{path}/corpus"
    snapshots.create_table(spark, listing, files.schema)
    snapshots.create_table(spark, corpus, build(files).schema)
    for delivery in (files.where(number % 2 == 0), files, last):
        follow.publish_listing(delivery, listing)
        follow.stream_corpus(spark, listing, corpus, f"{path}/state", build)
    return snapshots.read_table(spark, corpus)


# readers


#: Pages whose files one task writes.
TASK_PAGES = 8192


def _files(spark: SparkSession, d: str, name: str) -> str:
    """A file for each page, under RELEASE/SERIES/DOCUMENT/."""
    path = with_scheme(spark, scratch_path(spark, name))
    placed = table(spark, d, "pages").selectExpr("html", "page_id % 3 as release", "page_id % 2 as series", "page_id as spec_uid")
    n, most = placed.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    if n and most > TASK_PAGES:  # a table of large row groups is read by few tasks
        placed = placed.repartition(-(-n // TASK_PAGES))
    if path.startswith("file:"):
        place = "concat('release=', release, '/series=', series, '/spec_uid=', spec_uid, '/part-0.txt') as path"
        write.write_files(placed.selectExpr(place, "concat(coalesce(html, ''), '\\n') as content"), path)
    else:  # a store that tasks reach through Spark only
        placed.write.partitionBy("release", "series", "spec_uid").text(path)
    return path


@query("select 'release=' || (page_id % 3) as release, 'spec_uid=' || page_id as spec_uid, sha256(html || chr(10)) as sha256 from pages")
def src01_read_corpus(spark, d):
    return read.read_corpus(spark, _files(spark, d, "src01"), "part-*").select("release", "spec_uid", F.sha2("text", 256).alias("sha256"))


@query("select doc_id, text from documents where doc_id % 5 > 1 and trim(text) <> ''")
def src04_read_jsonl(spark, d):
    """Of the lines one in five is broken and one blank."""
    path = scratch_path(spark, "src04")
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 5 == 1, " ").otherwise(F.to_json(F.struct("doc_id", "text")))
    table(spark, d, "documents").select(line.alias("value")).write.text(path)
    return read.read_jsonl(spark, path, "doc_id bigint, text string", ["doc_id", "text"])


@query("select doc_id::varchar as key, text, lang from documents")
def src05_read_keyed_json(spark, d):
    """Objects of fifty records each."""
    path = scratch_path(spark, "src05")
    record = F.struct(F.col("doc_id").cast("string").alias("key"), F.struct("text", "lang").alias("value"))
    grouped = table(spark, d, "documents").groupBy(F.expr("doc_id div 50").alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(record))).alias("value"))
    grouped.write.partitionBy("file").text(path)
    return read.read_keyed_json(spark, f"{path}/*", "text string, lang string")


@query("select 'q' || item_id as id, text as question, case when item_id % 3 = 0 then '' else 's' || item_id end as specs, case when item_id % 4 = 0 then 1 else 0 end as n_facts, item_id % 5 = 0 as refuses from benchmark")
def src06_read_golden(spark, d):
    path = scratch_path(spark, "src06")
    spec = F.struct(F.when(F.col("item_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" s"), F.col("item_id").cast("string"))).alias("spec_id"))
    item = F.struct(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), F.array(spec).alias("expected_specs"),
        F.when(F.col("item_id") % 4 == 0, F.array("text")).alias("expected_facts"), F.when(F.col("item_id") % 5 == 0, F.lit(True)).alias("must_say_not_found"),
    )
    files = table(spark, d, "benchmark").groupBy(F.expr("item_id div 10").alias("file")).agg(F.to_json(F.collect_list(item)).alias("value"))
    files.write.partitionBy("file").text(path)
    golden = read.read_golden(spark, f"{path}/*")
    return golden.select("id", "question", F.array_join("expected_specs.spec_id", ",").alias("specs"), F.size("expected_facts").alias("n_facts"), F.col("must_say_not_found").alias("refuses"))


@query("select page_id::varchar as spec_uid, strlen(html) + 1 as size, sha256(html || chr(10)) as sha256 from pages")
def src07_hash_files(spark, d):
    return read.hash_files(spark, _files(spark, d, "src07"), "part-*").select(F.regexp_extract("path", "spec_uid=([0-9]+)/", 1).alias("spec_uid"), "size", "sha256")
