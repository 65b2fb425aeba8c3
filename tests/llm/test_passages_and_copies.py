"""Substring dedup, exact dedup and near dedup against brute force."""

import hashlib
import random
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import common, exact_dedup, minhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("id", "h", "row", "n", "same", "band", "node", "kept", "copy")}) if extra else df


def cut_by_force(texts, window):
    starts = {}
    split = [(i, [w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) for i, t in texts]
    for i, w in split:
        if i is None:
            continue
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            starts[key] = min(starts.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if starts[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(40))
    shared = [[word() for _ in range(n)] for n in (12, 30, 80)]
    texts = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 120))]
        for p in shared:
            if rng.random() < 0.4:
                at = rng.randrange(len(w) + 1)
                w[at:at] = p
        texts.append((i, rng.choice([" ", "\n", "  ", " \t"]).join(w)))
    texts += [(60, "x " * 200), (61, "x " * 300), (62, None), (63, ""), (None, texts[3][1]), (5, texts[9][1]), (7, texts[7][1])]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("hot_windows", [1, 40, 2048])
def test_substring_dedup_is_brute_force(spark, hot_windows):
    texts = passages(hot_windows)
    got = substring_dedup.substring_dedup(frame(spark, texts, extra=True), window=20, hot_windows=hot_windows, context_windows=hot_windows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == cut_by_force(texts, 20)


@pytest.mark.parametrize("hot_windows", [1, 60, 2048])
def test_hot_passages_are_sorted_by_context(spark, monkeypatch, hot_windows):
    """Passages longer and shorter than a window and its contexts, in many documents with other words around."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 20)
    rng = random.Random(hot_windows)
    shared = [[f"p{k}q{i}" for i in range(n)] for k, n in enumerate((30, 45, 58, 75, 140))]
    texts = []
    for i in range(120):
        w = [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
        for p in rng.sample(shared, 2):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        texts.append((i, " ".join(w)))
    got = substring_dedup.substring_dedup(frame(spark, texts), hot_windows=hot_windows, context_windows=hot_windows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == cut_by_force(texts, 50)


def test_repeated_rows_cost_in_proportion(spark):
    text = " ".join(f"w{i}" for i in range(70))
    texts = [(2, text)] * 4000 + [(1, text[:-1])]
    got = substring_dedup.substring_dedup(frame(spark, texts))
    assert {(r.doc_id, r.n_removed, len(r.removed)) for r in got.distinct().collect()} == {(1, 0, 0), (2, 69, 1)} and got.count() == 4001


def test_substring_dedup_of_one_very_long_text(spark):
    words = [f"w{i % 977}x{i}" for i in range(60_000)]
    texts = [(1, " ".join(words)), (2, " ".join(words[100:40_000] + ["new"] + words[50_000:50_049]))]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(spark, texts)).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 39_900 and got[2].removed[0].end == 39_900


def test_super_kmers_cover_each_window_once():
    h = np.arange(500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc, start, size, _ = substring_dedup.super_kmers(np.array([300, 10, 190]), h, 50, 12)
    at = sorted((int(d), int(s) + k) for d, s, n in zip(doc, start, size) for k in range(n))
    assert at == [(0, i) for i in range(251)] + [(2, i) for i in range(141)]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substring_dedup.substring_dedup(none).count() == 0
    assert exact_dedup.exact_dedup(none).count() == 0
    assert exact_dedup.keep_distinct(none).count() == 0
    assert minhash.near_classes(none).count() == 0
    assert minhash.keep_one_of_each(none).columns == none.columns


def copies():
    rng = random.Random(4)
    long = [" ".join(f"w{rng.randrange(5000)}" for _ in range(9000)) for _ in range(3)]
    texts = [*long, "a b", "a b ", "A b", "", None, "é", "é"]
    rows = [(i, texts[rng.randrange(len(texts))]) for i in range(80)]
    return [*rows, (None, "a b"), (None, "only null ids"), (None, "only null ids"), (79, rows[79][1]), (500, ""), (501, long[0][:-1])]


@pytest.mark.parametrize("identifiers", [exact_dedup.IDENTIFIERS, (lambda b: b[:1], lambda b: hashlib.md5(b).digest())])
@pytest.mark.parametrize("large,most", [(1000, 1 << 25), (2, 1 << 25), (1, 700)])
def test_exact_dedup_is_brute_force(spark, monkeypatch, identifiers, large, most):
    monkeypatch.setattr(exact_dedup, "LARGE_GROUP", large)
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", most)
    rows = copies()
    got = exact_dedup.exact_dedup(frame(spark, rows, extra=True), identifiers=identifiers).collect()
    size = Counter(t or "" for _, t in rows)
    last = {}
    for i, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
    want = sorted((str(i), last[t or ""], size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), -1 if r.keep_id is None else r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(size) and len({r.text_sha256 for r in kept}) == len(size) and all(r.doc_id == r.keep_id for r in kept)


def test_keep_distinct_keeps_one_row_of_each_text(spark):
    rows = copies()
    df = frame(spark, rows, extra=True).withColumns({c: F.lit("x") for c in ("_sha", "_kept_id", "_kept_sha")})
    got = exact_dedup.keep_distinct(df)
    assert got.columns == df.columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in rows})


def test_chunks_are_cut_by_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= exact_dedup.MAX_BYTES
    moved = set(exact_dedup.chunks(b"some more" + data))
    assert len(moved & set(parts)) > 0.8 * len(parts)
    assert exact_dedup.chunks(b"") == [b""] and b"".join(exact_dedup.chunks(b"\0" * 100_000)) == b"\0" * 100_000


def weigh(text):
    w = (text or "").split()
    n = min(5, len(w))
    count = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else {}
    return {k: 1 + np.log(v) for k, v in count.items()}


def similarity(a, b):
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def near_texts(seed, groups=12):
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([1, 4, 7, 60, 150, 400]))]
        if rng.random() < 0.3:
            base += base[:20] * 3
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += rng.randrange(1, 3)
    return rows


def classes_by_force(rows, threshold=0.8):
    sets = [(i, weigh(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and similarity(a, b) >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def classes_by_shared_shingles(texts, threshold=0.8):
    sets = {i: weigh(t) for i, t in texts.items()}
    root, having = {i: i for i in texts}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in having.setdefault(s, []))
        for j, n in common.items():
            # the similarity is at most the common share of the distinct shingles times the largest ratio of weights
            if n >= 0.3 * max(len(sets[i]), len(sets[j])) and find(i) != find(j) and similar(sets[i], sets[j]) >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for s in sets[i]:
            having[s].append(i)
    return {i: find(i) for i in texts}


def similar(a, b):
    """similarity(), summed over arrays."""
    keys = sorted(a.keys() | b.keys())
    x, y = (np.array([s.get(k, 0.0) for k in keys]) for s in (a, b))
    both = (x > 0) & (y > 0)
    return sum(1 / np.maximum(x / p, y / q).sum() for p, q in zip(x[both], y[both]))


@pytest.mark.parametrize("seed,refine,heavy", [(1, 1000, 1000), (2, 1000, 1), (3, 2, 1)])
def test_near_classes_are_brute_force(spark, monkeypatch, seed, refine, heavy):
    monkeypatch.setattr(common, "HEAVY_ROWS", heavy)
    monkeypatch.setattr(minhash, "LINKS_OF_A_TASK", heavy)
    rows = near_texts(seed)
    got = minhash.near_classes(frame(spark, rows, extra=True), refine=refine).collect()
    assert {r.doc_id: r.class_id for r in got} == classes_by_force(rows)
    assert sorted(r.doc_id for r in got if r.kept) == sorted(set(r.class_id for r in got))


def test_a_hub_joins_copies_that_are_not_near_each_other(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(50, " ".join(base))]
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(300), 6):
            w[at] = f"n{i}x{at}"
        rows.append((i, " ".join(w)))
    want = classes_by_force(rows)
    for refine in (1000, 3):
        got = minhash.near_classes(frame(spark, rows), refine=refine).collect()
        assert {r.doc_id: r.class_id for r in got} == want


def test_near_classes_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (5, text), (None, text), (None, None), (6, "one two"), (7, "one two"), (8, "one")]
    got = minhash.near_classes(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8)]
    assert [r.class_id for r in got if r.doc_id is None] == [None, None]
    left = minhash.keep_one_of_each(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "2", "3", "4", "6", "8", "None", "None"]


def test_an_id_with_several_texts_loses_no_link(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "else " + " ".join(f"c{i}" for i in range(60)))]
    got = sorted((r.doc_id, r.class_id, r.kept) for r in minhash.near_classes(frame(spark, rows)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    left = minhash.keep_one_of_each(frame(spark, rows, extra=True).withColumns({"_id": F.lit(1), "_text": F.lit("x")}))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(1, a), (1, b), rows[4]])


def test_many_short_texts_are_signed_in_bounded_memory():
    texts = [f"{i} one two three four five six seven eight nine ten" for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([t.encode() for t in texts])], ["id", "text"])
    tracemalloc.start()
    began = time.process_time()
    rows = sum(b.num_rows for b in minhash._sketch(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000 and peak < 100e6 and time.process_time() - began < 120


@pytest.mark.parametrize("refine", [1000, 2])
def test_near_classes_of_the_documents_lose_no_link(spark, refine):
    """Recall over all pairs of the table, found by their shared shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = classes_by_shared_shingles({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs, refine=refine).collect()}
    assert got == want


def test_signatures_estimate_the_probability_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 2**63, 300).astype(np.uint64)
    a = (np.sort(x[:250]), rng.uniform(0.5, 3, 250))
    b = (np.sort(x[30:]), rng.uniform(0.5, 3, 270))
    da, db = (dict(zip(*map(list, s))) for s in (a, b))
    exact = similarity(da, db)
    assert minhash.probability_jaccard(a, b) == pytest.approx(exact)
    doc = np.repeat([0, 1], [250, 270])
    sig = minhash.signatures(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), doc, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    alone = minhash.signatures(b[0], b[1], np.zeros(270, np.int64), 1, 4096)
    assert (alone[0] == sig[1]).all()


@pytest.mark.parametrize("most", [1, 500, 32 << 20])
def test_heavy_keys_are_broadcast_as_far_as_they_fit(spark, monkeypatch, most):
    """Half of the rows have one key; whatever is broadcast, the joined rows are those of a plain join."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 3)
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    rows = spark.createDataFrame([(0 if i % 2 else i % 40, i) for i in range(400)] + [(999, -1), (None, -2)], "k int, i int")
    told = rows.where("k < 900").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for how in ("inner", "left"):
        got = common.join_counted(rows, told, ["k"], "n", how=how)
        assert got.columns == ["k", "i", "n"] and sorted(map(str, got.collect())) == sorted(map(str, rows.join(told, "k", how).collect()))


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_links_of_a_hub(spark, monkeypatch, most):
    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    monkeypatch.setattr(minhash, "LINKS_OF_A_TASK", most)
    links = spark.createDataFrame([(99, i) for i in range(60)] + [(70, i) for i in range(71, 90)] + [(200, 201)], "a long, b long")
    got = {r.node: r.root for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, 99: 0, **{i: 70 for i in range(71, 90)}, 201: 200}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
