"""Search, mixing, encoding, filters, scans, formatting, language ID, the pipeline."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import chat, common, language_id, license_scan, mixing, sentencepiece_codec, topk, url_filter
from corpuslens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# exact top-k


def topk_by_force(rows, asked, k):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in fine if i in asked}):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,query_rows", [(2048, 1024), (50, 7)])
def test_topk_is_brute_force_with_ties_and_holes(spark, shard_rows, query_rows):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)] + [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (None, rows[1][1]), (7, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"v": F.lit(1), "shard": F.lit(1), "q": F.lit("q")})
    got = topk.topk(df, df.where("vec_id % 10 = 0 or vec_id > 498"), 5, shard_rows=shard_rows, query_rows=query_rows).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == topk_by_force(rows, {*range(0, 420, 10), 500, 501, 502, 503}, 5)


def test_topk_with_fewer_rows_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.topk(df, df.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 256 * 128)]
    assert topk.topk(df.limit(0), df.limit(0), 5).count() == 0


def test_topk_of_huge_and_ragged_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-(2**17), 2**17, 3 + i % 2) * 1.0).tolist()) for i in range(60)] + [(60, [1e30, 0.0, 0.0]), (61, []), (62, [1.0]), (63, [2.0**18, 2.0**18, 2.0**18]), (64, [-(2.0**18), 1.0, 2.0**18]), (65, [2.0**18, 2.0**18, 2.0**18 - 1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.topk(df, df, 4, shard_rows=7, query_rows=5).collect())
    fine = [(i, [int(256 * x) for x in v]) for i, v in rows if i != 61]
    want = []
    for i, q in fine:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i and len(v) == len(q))[:4]
        want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scored)]
    assert got == sorted(want) and max(abs(r[3]) for r in got) > 2**53


@pytest.mark.parametrize("shard_rows", [2048, 3])
def test_topk_keeps_every_finite_vector(spark, shard_rows):
    rows = [(50, [1.0, 0.0]), (51, [1e6, 0.0]), (100, [3e5, 1.0]), (1, [2.0, 5.0]), (2, [-3.0, 1.0]), (3, [3.0, 0.0]), (4, [0.5, 0.5]), (150, [1e300, -1e300]), (5, [-1e299, 1e298]), (6, [1e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.topk(df, df.where("vec_id % 50 = 0"), 9, shard_rows=shard_rows).collect())
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i != 6]  # 256e308 is no double
    want = []
    for i, q in (x for x in fine if x[0] % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)
        want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scored)]
    assert got == sorted(want)
    only = [r[2:] for r in topk.topk(df.where("vec_id <= 100"), df.where("vec_id = 50"), 1).collect()]
    assert only == [(51, 65_536_000_000)]


def test_topk_drops_cells_before_the_shuffle(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(32, 16)) * 4
    rows = [(i, (centres[i % 32] + 0.05 * rng.normal(size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    result, first, rest = topk._searched(df, df.where("vec_id % 50 = 0"), 5, 256.0, "vec_id", "embedding", 125, 4096)
    cells = first.select("cell").distinct().count()
    assert cells > 8 and rest.count() < 0.3 * 80 * 32
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in result.collect()) == topk_by_force(rows, set(range(0, 4000, 50)), 5)


# mixing


def test_mixing_draws_the_poisson_counts(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id < 3000, 'big', 'small') as source", "repeat('x', 10) as text", "1 as copy_no")
    got = mixing.mix_sources(docs, {"big": 1.0, "small": 3.0}, seed=5)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["big"] - 1000) < 5 * 1000**0.5 and abs(n["small"] - 3000) < 5 * 3000**0.5
    rates = {r.source: r.rate for r in got.select("source", "rate").distinct().collect()}
    assert rates == {"big": pytest.approx(1 / 3), "small": pytest.approx(3.0)}
    seen = got.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.m == r.n for r in seen)
    again = mixing.mix_sources(docs.repartition(7), {"big": 1.0, "small": 3.0}, seed=5)
    assert again.exceptAll(got).isEmpty() and got.exceptAll(again).isEmpty()


def test_poisson_table_in_the_far_tail(spark):
    got = spark.range(1).select(mixing.poisson_table(F.lit(900.0)).alias("t")).first().t
    assert got[-1] == pytest.approx(1.0) and 0.45 < got[900] < 0.55


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "text"), (None, "a", "text"), (2, "a", None), (3, "b", ""), (3, "b", "")], "doc_id long, source string, text string")
    got = mixing.mix_sources(docs, budget=50.0)
    assert {r.source for r in got.select("source").collect()} == {None, "a"}
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_of_a_tiny_source_at_a_large_rate(spark):
    docs = spark.createDataFrame([(1, "tiny", "x"), (2, "big", "y" * 100_000)], "doc_id long, source string, text string").withColumns({"copy": F.lit("c"), "rate": F.lit("r"), "shuffle_key": F.lit("s"), "_n": F.lit(5)})
    got = mixing.mix_sources(docs, {"tiny": 1.0, "big": 0.0}, budget=10.0)
    assert got.columns == [*docs.columns, "_copy", "_rate", "_shuffle_key"]
    r = got.agg(F.count("*").alias("n"), F.max("_copy").alias("m"), F.max("_rate").alias("rate"), F.min("copy").alias("c"), F.min("_n").alias("k")).first()
    assert r.rate == pytest.approx(1_000_010) and abs(r.n - 1_000_010) < 5 * 1000 and (r.c, r.k) == ("c", 5)
    assert got.select("_copy").distinct().count() == r.n and r.m // mixing.BLOCK_STEP == 7813 // mixing.DRAWS_A_BLOCK  # every number once, in all blocks


def test_rates_of_several_draws_have_mean_and_variance_of_the_rate(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id < 2000, 's', 't') as source", "if(id < 2000, 'x', repeat('x', 1000)) as text")
    n = [r.n for r in mixing.mix_sources(docs, {"s": 1.0, "t": 0.0}, budget=2.0 / 3).groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    rate = (1_002_000 * 2 / 3) / 2000
    assert len(n) == 2000 and abs(np.mean(n) - rate) < 5 * (rate / 2000) ** 0.5 and 0.85 < np.var(n) / rate < 1.15


# SentencePiece


def test_codec_is_the_library_on_all_texts_and_odd_ones(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    odd = ["", " ", "  ", " a", "a ", "a  ", "a  b   c", "▁", "▁▁x ▁y", "a▁b", "\n", " \n x", "<s> </s> <unk> <0x41>", "é x　y​", "\x00\x01", "ﬁÅ", "🙂 🙂🙂", "x" * 30_000, "ab " * 20_000, "\t a\t"]
    rng = random.Random(2)
    odd += ["".join(rng.choice(["a", "b", " ", " ", "▁", "\n", "é", "the", "🙂", ".", "  "]) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts = odd + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame([*enumerate(texts), (None, "null id"), (10**6, None)], "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r.doc_id: r for r in sentencepiece_codec.sentencepiece_codec(df).collect()}
    for i, t in enumerate(texts):
        ids = p.encode(t)
        assert got[i].ids == ids and got[i].ids_text == ",".join(map(str, ids)) and got[i].decoded == p.decode(ids), repr(t[:80])
    assert got[10**6].ids == [] and got[10**6].decoded == "" and got[None].ids
    assert sentencepiece_codec.sentencepiece_codec(df.limit(0)).count() == 0


def test_codec_without_the_table_is_the_same():
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    assert sentencepiece_codec.marks_only_lead(p)
    table = sentencepiece_codec.ChunkTable(p)
    texts = ["a  b c ", "Hello World", "", " ", "a  b"]
    one, two = (sentencepiece_codec.encode_decode(texts, table, whole) for whole in (True, False))
    assert [x.tolist() if isinstance(x, np.ndarray) else x for x in one] == [x.tolist() if isinstance(x, np.ndarray) else x for x in two]


# URL filter


def test_url_filter_at_fetch_time(spark):
    day = lambda n: datetime(2024, 1, n)
    log = [
        ("host", "a.com", "block", "add", day(2)), ("host", "a.com", "block", "remove", day(5)), ("domain", "evil.net", "block", "add", day(3)),
        ("prefix", "good.evil.net/docs", "allow", "add", day(4)), ("host", "a.com", "block", "add", day(8)), ("host", "b.com", "block", "add", day(2)),
        ("host", "b.com", "block", "remove", day(2)), (None, "b.com", "block", "add", day(1)), ("host", None, "block", "add", day(1)),
    ]
    entries = spark.createDataFrame(log, "kind string, pattern string, action string, change string, changed_at timestamp")
    cases = [
        ("http://a.com/x", 1, True), ("http://A.com:80/x", 2, False), ("http://a.com", 5, True), ("http://a.com?q", 9, False), ("http://www.a.com/", 9, True),
        ("https://x.y.evil.net/p", 3, False), ("https://evil.net", 2, True), ("http://u@good.evil.net/docs/a#f", 4, True), ("http://good.evil.net/docsearch", 4, False),
        ("http://b.com/", 3, True), (None, 3, True), ("not a url", 3, True), ("http://a.com/", None, True), ("http://A.com:80/x", 2, False),
    ]
    df = spark.createDataFrame([(i, u, None if d is None else day(d)) for i, (u, d, _) in enumerate(cases)], "page_id long, url string, fetched_at timestamp").withColumn("pattern", F.lit("p"))
    got = url_filter.url_filter(df, entries).collect()
    assert {r.page_id: r.kept for r in got} == {i: c[2] for i, c in enumerate(cases)} and len(got) == len(cases)
    assert url_filter.url_filter(df.limit(0), entries).count() == 0
    assert url_filter.url_filter(df, entries.limit(0)).where("kept").count() == len(cases)


def test_url_filter_looks_up_what_the_list_can_answer(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_ENTRIES", 1)
    monkeypatch.setattr(common, "HEAVY_ROWS", 0)
    day = datetime(2024, 1, 1)
    entries = spark.createDataFrame(
        [("domain", "zip", "block", "add", day), ("prefix", "a.com/x/y", "block", "add", day), ("domain", "b.co.uk", "block", "add", day)],
        "kind string, pattern string, action string, change string, changed_at timestamp",
    )
    urls = {"http://x.zip/": False, "http://a.com/x": True, "http://a.com/x/Y/z": False, "http://a.com/" + "x/" * 3000: True, "http://w.b.co.uk": False, "http://co.uk": True, "http://localhost/": True}
    df = spark.createDataFrame([(u, datetime(2024, 1, 2), "h") for u in urls] * 2, "url string, fetched_at timestamp, host string")
    df = df.withColumns({"kept": F.lit("k"), "_row": F.lit(1), "listed_at": F.lit("l"), "_top": F.lit(2), "_url": F.lit(3)})
    got = url_filter.url_filter(df, entries)
    assert got.columns == [*df.columns, "_host", "matched_kind", "matched_pattern", "_listed_at", "_kept"]
    assert {r.url: r["_kept"] for r in got.collect()} == urls and got.count() == 2 * len(urls)


# license scan


def test_license_scan_is_brute_force(spark):
    from collections import Counter

    texts = [
        "Some prose.\nLicensed under the Apache License, Version 2.0.\nmore", "RELEASED under the mit-license", "Released under the MIT License.", None, "", "x", "\n\n",
        "This work is licensed under the GNU General Public License, version 2.", "licensed licensed licensed under the under the", "This is free and\nunencumbered software released into\nthe public domain.",
        *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()],
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("found", F.lit(1))
    got = {r.doc_id: sorted((f.license, round(f.dice, 9), -1 if f.line is None else f.line) for f in r.found) for r in license_scan.license_scan(df).collect()}

    def grams(t):
        w = license_scan.words(t.encode())
        return Counter(zip(w, w[1:]))

    for i, t in enumerate(texts):
        want = []
        lines = (t or "").split("\n")
        for k, p in [*enumerate(lines), *([(-1, t)] if len(lines) > 1 else [])]:
            a = grams(p)
            for name, body in license_scan.TEMPLATES:
                b = grams(body)
                d = 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
                if d >= license_scan.THRESHOLD:
                    want.append((name, round(d, 9), k))
        assert got[i] == sorted(want)
    assert got[0] and got[2] and got[9] and not got[3]
    assert license_scan.license_scan(df.limit(0)).count() == 0


# chat formatting

EVENT = "conv_id long, seq long, event string, turn long, role string, text string"


def folded_by_force(events):
    """Replay in order, as a chat window would."""
    convs = {}
    for conv, _, event, turn, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        messages = convs.setdefault(conv, {})
        if event in ("edit", "regenerate"):
            for t in [t for t in messages if t >= turn]:
                del messages[t]
            messages[turn] = (role, text or "", event)
        else:
            old = messages.get(turn, (role, "", ""))
            messages[turn] = (role, old[1] + (text or ""), event)
    return {(c, t): m[:2] for c, ms in convs.items() for t, m in ms.items()}


def test_fold_is_a_replay(spark):
    rng = random.Random(6)
    events = []
    for conv in range(30):
        seq = turn = 0
        for _ in range(rng.randrange(1, 40)):
            kind = rng.choice(["delta"] * 6 + ["edit", "regenerate"])
            if rng.random() < 0.4 and kind == "delta":
                turn += 1
            if kind != "delta":
                turn = rng.randrange(turn + 1)
            events.append((conv, seq, kind, turn, "assistant" if turn % 2 else "user", None if kind == "regenerate" else rng.choice(["a", "b c", "", None, "<|im_end|>"])))
            seq += 1
    df = spark.createDataFrame(events, EVENT).repartition(5).withColumn("_parts", F.lit(1))
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.final_messages(df).collect()}
    assert got == folded_by_force(events)


def test_render_is_reversible(spark):
    rng = random.Random(7)
    texts = ["", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<|", "|<", "<", "\\", "a\nb", *("".join(rng.choice(["<", "|", "\\", "im_end", ">", "\n", "é"]) for _ in range(20)) for _ in range(200))]
    rows = [(i, 0, rng.choice(["user", "assistant", "sys\\n\ntem", "<|im_start|>"]), t) for i, t in enumerate(texts)]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for r in got:
        role, text = chat.read_segment(r.segment)
        assert (role, text) == rows[r.conv_id][2:]
        assert r.segment.count("<|") == 2
        assert (r.loss_start is not None) == (role == "assistant")
        if r.loss_start is not None:
            assert chat.unescape_text(r.segment[r.loss_start : r.loss_end]) == text


def test_chats_with_odd_rows(spark):
    import hashlib

    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "first"), (None, 0, "assistant", "lost"), (1, 1, None, "x"), (2, 0, "assistant", "<|im_end|>" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.events_of_turns(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("assistant\nfirst\nuser\n\n\nx\n\nx\n") and got[1].loss_sha256 == sha("first")
    assert got[2].loss_chars == 50_000 and got[None].n_turns == 1
    assert chat.read_back(chat.format_chats(chat.events_of_turns(df.limit(0)))).count() == 0


def test_license_notices_are_found_across_lines_and_within_them(spark):
    body = dict(license_scan.BODIES)["MIT"].split()
    wrapped = "\n".join(" * " + " ".join(body[i : i + 11]) for i in range(0, len(body), 11))
    texts = {
        "MIT": [
            "Copyright (c) 2020 Someone\n\n" + wrapped, " ".join(body), "int main() {}\n" * 300 + wrapped + "\nint x;" * 300,
            "The plugin is small and does what it says. Released under the MIT License. See the docs for all of its settings.",
        ],
        "BSD-3-Clause": ["Some words before it.\n" * 20 + "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n" + "And after it.\n" * 20],
        "ISC": ["x = 1\n" * 50 + "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted\n" + "y = 2\n" * 50],
    }
    rows = [(name, t) for name, ts in texts.items() for t in ts] + [(None, "the license of this software is under the terms that are permitted " * 40)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    for r in license_scan.license_scan(df).collect():
        assert ([f.license for f in r.found] == [rows[r.doc_id][0]]) if rows[r.doc_id][0] else not r.found, (r.doc_id, r.found)


def test_license_windows_are_brute_force():
    from collections import Counter

    rng = random.Random(5)
    templates = [("a", "released under the mit license"), ("b", "one two three two three four five six"), ("c", "x y x y x y")]
    known = license_scan.Windows(templates, 0.8)
    for _ in range(150):
        w = [rng.choice("released under the mit license one two three four five six x y of".split()).encode() for _ in range(8)]
        for _ in range(3):
            body = rng.choice(templates)[1].encode().split()
            w += [x for x in body if rng.random() > 0.1] + [b"of"] * rng.randrange(4)
        got: dict[str, float] = {}
        for dice, a, b, name in known.matches(w):
            got[name] = max(dice, got.get(name, 0))
        want: dict[str, float] = {}
        grams = list(zip(w, w[1:]))
        for name, text in templates:
            body = text.encode().split()
            t = Counter(zip(body, body[1:]))
            best = max(2 * sum((Counter(grams[i:j]) & t).values()) / (j - i + sum(t.values())) for i in range(len(grams)) for j in range(i + 1, len(grams) + 1))
            if best >= 0.8:
                want[name] = best
        assert got == pytest.approx(want)


# language ID


def test_language_id_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 200")
    models = language_id.fit(docs.where("doc_id % 3 <> 0"))
    assert set(models) == {"en", "de", "fr", "es"}
    held = docs.where("doc_id % 3 = 0")
    got = language_id.identify(held, models, ["doc_id", "lang"], "text").collect()
    assert sum(r.lang == r.detected for r in got) > 0.97 * len(got) and all(r.accepted for r in got)
    wrong = language_id.identify(held, models, ["doc_id", "lang"], "text", F.lit("en"), F.lit("h")).collect()
    assert sum(r.lang == r.detected for r in wrong) > 0.95 * len(wrong)


def test_language_evidence_decides_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = language_id.fit(docs)
    hosts = [("the", "de", "a.example.de", "example.de", "de")] * 30 + [("zzz", None, "a.example.de", "example.de", "de"), ("zzz", None, "new.example.de", "example.de", "de"), ("zzz", "fr-FR", None, None, None)]
    df = spark.createDataFrame([(i, *h) for i, h in enumerate(hosts)], "doc_id long, text string, d string, h string, o string, s string")
    got = {r.doc_id: r.detected for r in language_id.identify(df, models, ["doc_id"], "text", F.col("d"), F.col("h"), F.col("o"), F.col("s")).collect()}
    assert got[30] == "de" and got[31] == "de" and got[32] == "fr"


def test_long_texts_are_counted_by_bucket():
    rng = random.Random(4)
    data = bytes(rng.randrange(256) for _ in range(50_001))
    want = np.bincount(language_id.trigrams(data), minlength=language_id.BUCKETS)
    assert (language_id.trigram_counts(data, 777) == want).all() and want.sum() == len(data) - 2
    assert language_id.trigram_counts(b"ab").sum() == 0 and language_id.trigram_counts(b"").sum() == 0


def test_posterior_is_brute_force(spark):
    """Each source of evidence summed by hand for short and long texts."""
    rng = random.Random(9)
    word = {"en": "the of and ing", "de": "der und die sch", "fr": "le la et que"}
    rows = [(i, " ".join(rng.choice(word[x].split()) for _ in range(rng.choice([1, 3, 40, 9000]))), x if i % 3 else None, f"h{i % 4}") for i, x in enumerate(rng.choices(list(word), k=60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    models = language_id.fit(df)
    names, dense = list(models), {k: m.dense() for k, m in models.items()}
    got = {r.doc_id: r for r in language_id.identify(df, models, ["doc_id"], "text", F.col("lang"), F.col("source")).collect()}
    smooth = lambda counts, prior: [(c + language_id.KAPPA * p) / (sum(counts) + language_id.KAPPA) for c, p in zip(counts, prior)]
    whole = [sum(r[2] == x for r in rows) + 1.0 for x in names]
    wide = [x / sum(whole) for x in whole]
    every = [sum(r[2] == x for r in rows) for x in names]
    for _ in range(2):  # suffix and domain are one group of all rows here
        wide = smooth(every, wide)
    for i, text, lang, host in rows:
        own = smooth([sum(r[2] == x and r[3] == host for r in rows) for x in names], wide)
        grams = language_id.trigrams(text.encode())
        log = []
        for k, x in enumerate(names):
            one = math.log(own[k]) + (sum(dense[x][g] for g in grams) / len(grams) * min(len(grams), language_id.EFFECTIVE) if len(grams) else 0.0)
            if lang in names:
                one += math.log(language_id.DECLARED_RIGHT if x == lang else (1 - language_id.DECLARED_RIGHT) / (len(names) - 1))
            log.append(one)
        p = [math.exp(v - max(log)) for v in log]
        assert got[i].detected == names[p.index(max(p))] and got[i].confidence == pytest.approx(max(p) / sum(p), abs=1e-6)


def test_language_id_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(10**6 + i, t, l, s, 0) for i, (t, l, s) in enumerate([(None, "en", "src0"), ("", None, None), ("123 !!", "en", None), ("日本語テキスト" * 50, None, None), ("the and of", "??", None)])], docs.schema)
    both = docs.unionByName(odd).withColumns({"detected": F.lit("x"), "_text": F.lit(1), "_h0": F.lit(2)})
    got = language_id.keep_identified(both)
    assert got.columns == both.columns and {r.doc_id for r in got.where("doc_id >= 1000000").collect()} <= {10**6 + 4}
    clean = docs.where("length(text) > 100").count()
    assert got.where("length(text) > 100 and doc_id < 1000000").count() == clean
    assert language_id.keep_identified(both.limit(0)).count() == 0


def test_hosts_without_declared_rows_have_the_wider_prior(spark):
    models = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    known = [("de", "a.one.com", "one.com", "com")] * 60 + [("es", "a.two.org", "two.org", "org")] * 80 + [("fr", "a.three.net", "three.net", "net")] * 300
    asked = [("new.one.com", "one.com", "com", "de"), ("a.four.org", "four.org", "org", "es"), ("a.five.info", "five.info", "info", "fr")]
    rows = [("zzz", *k) for k in known] + [("zzz", d, *a[:3]) for d in (None, "xx") for a in asked]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, d string, h string, o string, s string")
    got = {r.doc_id: r.detected for r in language_id.identify(df, models, ["doc_id"], "text", F.col("d"), F.col("h"), F.col("o"), F.col("s")).collect()}
    assert [got[len(known) + i] for i in range(6)] == [a[3] for a in asked] * 2
    priors = language_id.host_priors(df, list(models), [F.col(c) for c in "hos"], F.col("d"))
    assert priors.count() == 6 and all(sum(r._prior) == pytest.approx(1) for r in priors.collect())


def test_every_label_has_a_model(spark):
    """40 languages of own words, one with few of many rows; and copies of one text don't come into the sample together."""
    names = [f"q{chr(97 + i // 20)}{chr(97 + i % 20)}" for i in range(40)]
    rng = random.Random(1)
    words = {n: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for n in names}
    rows = [(n, " ".join(rng.choice(words[n]) for _ in range(25))) for k, n in enumerate(names) for _ in range(400 if not k else 3)]
    df = spark.createDataFrame([(i, t, n) for i, (n, t) in enumerate(rows)], "doc_id long, text string, lang string")
    models = language_id.fit(df, sample_rows=10)
    assert set(models) == set(names)
    got = language_id.identify(df, models, ["doc_id", "lang"], "text").collect()
    assert sum(r.detected == r.lang and r.accepted for r in got) > 0.99 * len(got)
    copies = spark.range(8000).selectExpr("id as doc_id", "if(id < 6000, 'one hot text', concat('text ', id)) as text", "if(id < 7990, 'en', 'de') as lang")
    picked, labels = language_id.sample(copies, "text", "lang", 1000, ["doc_id"])
    n = {r.label: r["count"] for r in picked.groupBy("label").count().collect()}
    assert sorted(labels) == ["de", "en"] and n["de"] == 10 and 350 < n["en"] < 650
    assert set(language_id.fit(copies.where("doc_id >= 7990 or doc_id < 7000").withColumn("text", F.when(F.col("lang") == "de", "x").otherwise(F.col("text"))))) == {"de", "en"}


def test_odd_labels_dont_change_the_other_models(spark):
    """300 labels of a row each: models and scores of the four languages stay as they are without them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 200")
    odd = spark.createDataFrame([(10**6 + i, f"q{i} zz", f"{chr(97 + i // 26)}{chr(97 + i % 26)}q") for i in range(300)], "doc_id long, text string, lang string")
    alone, among = language_id.fit(docs, sample_rows=10**6), language_id.fit(docs.unionByName(odd), sample_rows=10**6)
    assert len(alone) == 4 and len(among) == 304
    for name, model in alone.items():
        assert np.array_equal(model.dense(), among[name].dense())
    assert sum(len(m.buckets) for k, m in among.items() if k not in alone) < 300 * 10
    one, many = ({r.doc_id: (r.detected, r.accepted) for r in language_id.identify(docs, m, ["doc_id"], "text").collect()} for m in (alone, among))
    assert one == many


def test_priors_of_few_hosts_are_broadcast_and_the_rest_joined(spark, monkeypatch):
    """However many priors may be broadcast, each row has the same result, once; null hosts and ties in size among them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    host = F.when(F.col("doc_id") % 2 == 0, "hot").when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("h"), (F.col("doc_id") % 40).cast("string")))
    models = language_id.fit(docs)
    results = []
    for most in (640_000, 4 * 5, 4, 0):
        monkeypatch.setattr(language_id, "BROADCAST_PRIORS", most)
        got = language_id.identify(docs, models, ["doc_id"], "text", F.col("lang"), host)
        results.append(sorted((r.doc_id, r.detected or "", round(r.confidence, 9), r.accepted) for r in got.collect()))
    assert len(results[0]) == docs.count() and all(r == results[0] for r in results)


def test_language_id_covers_the_pages(spark, tmp_path):
    page = '<!DOCTYPE html><html class="x" lang="{}"><head><style>p {{}}</style></head><body><!-- no --><p>caf&eacute; &amp; th&#233;</p><script>var a = "<p>";</script></body></html>'
    urls = ["https://u@A.example.de:80/x", "http://shop.example.co.uk/", "http://10.0.0.1/", "http://localhost/x", None, "http://example.com"]
    df = spark.createDataFrame([(i, u, page.format("fr-FR")) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = df.select("page_id", *[c.alias(n) for n, c in language_id.page_evidence(F.col("url"), F.col("html")).items()]).orderBy("page_id").collect()
    assert {(r.text, r.lang) for r in got} == {("café & thé", "fr-FR")}
    assert [(r.host, r.domain, r.suffix) for r in got] == [
        ("a.example.de", "example.de", "de"), ("shop.example.co.uk", "example.co.uk", "uk"), ("10.0.0.1", None, None), ("localhost", None, None), (None, None, None), ("example.com", "example.com", "com"),
    ]
    refs = "R&D &lt;b&gt; &#x4E2D;&#128512;&Uuml;&#0;&#55296;&#9999999;&none; &amp;lt; &; a&"
    row = spark.createDataFrame([(f"<p>{refs}</p>",)], "html string").select(language_id.page_evidence(F.lit("x"), F.col("html"))["text"].alias("t")).first()
    assert row.t == "R&D <b> 中😀Ü\ufffd\ufffd\ufffd&none; &lt; &; a&"
    short = [(i, "http://a.example.de/", '<html lang="de"><p>zzz</p></html>') for i in range(30)] + [(30, "http://a.example.de/x", "<html><p>zzz</p></html>")]
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(10**6 + i, u, h) for i, u, h in short], "page_id long, url string, html string")).write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op10_language_id"](spark, str(tmp_path)).collect()
    assert sum(r.doc_id is not None for r in got) == 200 and sum(r.page_id is not None for r in got) == 50 + 31
    own = [r for r in got if r.page_id is not None and r.page_id < 10**6]
    assert all(r.lang for r in own) and sum(r.detected == r.lang and r.accepted for r in own) > 0.9 * len(own)
    assert {r.detected for r in got if r.page_id == 10**6 + 30} == {"de"}


# the pipeline


def test_each_stage_does_its_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "sentencepiece"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.subtract(before).isEmpty()
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts))
    mixed = corpus_pipeline.mix(spark, kept, SF)
    assert mixed.columns == docs.columns and mixed.subtract(kept).isEmpty()


def test_stages_with_odd_rows_and_columns(spark):
    docs = spark.createDataFrame(
        [(1, "die und der die schon", "de", "a", 3, "c", 0.5), (2, None, None, None, None, None, None), (None, "", "de", "a", 0, "x", 1.0), (1, "die und der die schon", "de", "a", 3, "c", 0.5), (4, "der und " * 5000, "de", "b", 9, "c", 2.0)],
        "doc_id long, text string, lang string, source string, n_chars long, copy string, rate double",
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns and {r.copy for r in got.collect()} <= {"c", "x", None}, name
        assert stage(spark, docs.limit(0), "").count() == 0
    coded = corpus_pipeline.encode(spark, docs, "")
    assert sorted(str(r.doc_id) for r in coded.collect()) == ["1", "1", "2", "4", "None"] and coded.where("doc_id = 2").first().n_tokens == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), "").count() == 0
    renamed = sentencepiece_codec.sentencepiece_codec(docs.withColumnRenamed("doc_id", "ids"), "ids")
    assert renamed.columns == ["ids", "_ids", "ids_text", "decoded"]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
