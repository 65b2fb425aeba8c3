"""Line dedup, filter interaction audit and hard negatives against brute force."""

import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import filter_audit, hard_negatives, line_dedup

# line dedup

DOCS = "doc_id long, text string"


def key_of(line):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def lines_by_force(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(i)
    known = {k: {i for i in ids if i is not None} for k, ids in holders.items() if len(k) >= min_chars}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(known.get(key_of(x), ())) < min_docs or i == max(known[key_of(x)])]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(4)
    pool = [f"line {n} of the pool" + " Über" * (n % 3) for n in range(30)]
    rows = [(i, "\n".join(rng.choice(["  {}\t", "{}", "\x0b{} \r", "{}\x1c"]).format(rng.choice([str, str.upper, str.title])(rng.choice(pool))) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    shared = "This passage is on nearly every page of the site."
    rows += [(200 + i, f"head {i}\n{shared}\n\n{shared}\nfoot") for i in range(60)]
    rows += [(None, shared), (None, None), (90, None), (91, ""), (92, "\n\n"), (93, shared), (93, shared), (93, f"{shared}\nother text of the same id")]
    rows += [(300, "\n".join([shared, "own words"] * 5000)), (301, "x" * 200_000)]
    return rows


@pytest.mark.parametrize("min_chars,min_docs,broadcast_bytes", [(5, 3, 1 << 20), (5, 3, 400), (40, 5, 0), (0, 1, 1 << 20)])
def test_line_dedup_is_brute_force(spark, min_chars, min_docs, broadcast_bytes):
    rows = odd_rows()
    df = spark.createDataFrame(rows, DOCS).withColumns({x: F.lit(1) for x in ("key", "at", "gone", "last", "digest", "id", "n_docs", "line")})
    got = line_dedup.line_dedup(df, min_chars=min_chars, min_docs=min_docs, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(map(tuple, got), key=str) == lines_by_force(rows, min_chars, min_docs)


def test_line_dedup_of_nothing_and_without_python(spark):
    none = spark.createDataFrame([], DOCS)
    assert line_dedup.line_dedup(none).count() == 0
    df = line_dedup.line_dedup(spark.createDataFrame([(1, "a")], DOCS))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# filter interaction audit


def fails_of(text, copied):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return (
        (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) << 2
        | bool(re.search(r"[#$%&*|]", text)) << 3 | copied << 4
    )


def masks_by_force(rows):
    least = defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            least[text or ""].append(i)
    return [(i, part or "", fails_of(text or "", i is not None and i > min(least[text or ""]))) for i, text, part in rows]


def audit_by_force(rows, labels):
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    out, shapley = {}, defaultdict(int)
    found = masks_by_force(rows)
    for part in {p for _, p, _ in found}:
        mine = [(i, m) for i, p, m in found if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order):
                bit = 1 << "ABCDE".index(c)
                gone, stay = [i for i, m in left if m & bit], [x for x in left if not x[1] & bit]
                failing = sum(bool(m & bit) for _, m in mine)
                out[part, "".join(order), step + 1] = [len(stay), len(gone), failing - len(gone), sum(m == bit for _, m in mine), sum(i in good for i in gone), sum(i in toxic for i in gone)]
                shapley[part, c] += len(gone)
                left = stay
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def audit_rows():
    rng = random.Random(8)
    stem = "The same beginning of many long texts, " * 40
    texts = ["", None, "#", "A B C", "ünï çödé " * 250, "é" * 300, " ".join(f"w{n}" for n in range(300)), "x y " * 200, stem, stem + "a", stem + "b", "a b\x1cc " * 201]
    texts += [stem + rng.choice("abc") * n for n in range(1, 40)] + [" ".join(rng.choice(["good", "Word", "x%", "y", f"u{rng.random()}"]) for _ in range(rng.randint(1, 400))) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(500)]
    rows += [(i, "the hot text", "en") for i in range(600, 900)] + [(None, "the hot text", "en"), (None, "only without id", "fr"), (600, "the hot text", "de"), (599, None, "it"), (7, "the hot text", "en")]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 2000, "range_bytes": 3000, "prefix_bytes": 4, "many_holders": 3}])
def test_masks_and_audit_are_brute_force(spark, sizes):
    rows = audit_rows()
    clash = {x: F.lit(1) for x in ("id", "part", "mask", "copies", "prefix", "hot", "long", "p", "n", "good")}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7).withColumns(clash)
    got = filter_audit.masks(df, **sizes)
    assert sorted([(r.id, r.part, r["mask"]) for r in got.collect() for _ in range(r.copies)], key=str) == sorted(masks_by_force(rows), key=str)
    rng = random.Random(9)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 900, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (10**6, 1, 0)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    told = filter_audit.audit(filter_audit.counts(got, said)).collect()
    assert sorted(map(tuple, told)) == audit_by_force(rows, labels)


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(none, labels).count() == 0
    assert filter_audit.filter_audit(spark.createDataFrame([(1, None, None)], none.schema), labels).count() == 600


def test_prefixes_grow_where_long_texts_begin_alike(spark):
    stem = b"s" * 3000
    rows = [(i, "", 0, 1, stem + bytes([65 + i % 26]) * 50) for i in range(52)] + [(100 + i, "", 0, 1, b"t" * 3000) for i in range(50)] + [(200 + i, "", 0, 1, bytes([35 + i]) * 9) for i in range(20)]
    df = spark.createDataFrame(rows, filter_audit.ROWS)
    lengths = {r.id: len(r.prefix) for r in filter_audit.adaptive_prefixes(df, 8000, 4).collect()}
    assert len(lengths) == len(rows)
    assert {lengths[i] for i in range(52)} == {3050} and {lengths[i] for i in range(100, 150)} == {4} and {lengths[i] for i in range(200, 220)} == {4}


# hard negatives


def negatives_by_force(rows, every):
    fine = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, q in {(i, y, tuple(v)) for i, y, v in fine if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j, z) for j, z, v in fine if j != i and len(v) == len(q))
        for p, j in [(-s, j) for s, j, z in scored if z == y][:5]:
            found = [(-s, n) for s, n, z in scored if z != y and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(i, j, r + 1, n, max(-(2**63), min(2**63 - 1, p)), max(-(2**63), min(2**63 - 1, s))) for r, (s, n) in enumerate(found)]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=6) + 1).tolist()) for i in range(300)]
    rows += [(300 + i, i % 2, rows[10][2]) for i in range(150)]  # one vector on many rows
    rows += [(460 + i, i % 3, (rng.normal(size=4) + 1).tolist()) for i in range(40)] + [(500, 1, [2.0]), (501, 0, [1.0]), (502, 1, [1.0])]
    rows += [(510 + i, i % 2, (rng.normal(size=6) * 10.0 ** (3 * i)).tolist()) for i in range(12)]  # up to 1e33
    rows += [(600, 0, [3e30, 0.0, 1.0, 0.0, 0.0, 0.0]), (601, 0, [1e30] * 6), (602, 1, [6e29] * 6), (603, 1, [5e29, 1e30, 0.0, 0.0, 0.0, 0.0])]
    rows += [(700, 1, None), (710, None, [1.0] * 6), (720, 1, [math.nan] * 6), (730, 1, [None] + [1.0] * 5), (740, 1, []), (None, 1, [1.0] * 6), (750, 2, [math.inf] * 6)]
    return rows + [rows[20], (20, 1, rows[30][2]), (20, 2, rows[30][2])]  # repeated ids


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16, "anchor_rows": 5, "map_blocks": 7}])
def test_hard_negatives_are_brute_force(spark, sizes):
    rows = vector_rows()
    clash = {x: F.lit(1) for x in ("id", "anchor", "v", "width", "block", "q", "part", "windows", "p", "wide")}
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns(clash)
    got = sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 10 == 0, **sizes).collect()))
    assert got == negatives_by_force(rows, 10) and len(got) > 500


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("vec_id") % 10 == 0).count() == 0
    lone = spark.createDataFrame([(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0])], df.schema)
    assert hard_negatives.mine(lone, F.col("vec_id") % 10 == 0).count() == 0


def test_zone_maps_spare_blocks(spark):
    """Vectors in narrow groups: an anchor reads the blocks of its own group and of those near it."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 8)) * 4
    rows = [(i, i % 40 % 5, (centres[i % 40] + rng.normal(size=8) * 0.05).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got, miner = hard_negatives.mined(df, F.col("vec_id") % 100 == 0, "vec_id", "label", "embedding", 256.0, 5, 10, 30, 90, 50, 4096, 4096)
    assert sorted(map(tuple, got.collect())) == negatives_by_force(rows, 100)
    all_pairs = miner.zones.count() * 40
    assert sum(r.count() for r in miner.read) < all_pairs / 3


def test_curve_visits_neighbours():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    place = hard_negatives.hilbert(grid, 3)
    assert sorted(place.tolist()) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_wide_keys_sort_as_their_scores():
    scores = sorted({s * (n + d) for n in (2**63, 2**64, 2**80, 2**200, 255 << 70) for d in (-1, 0, 1, 12345) for s in (1, -1)})
    keys = [(max(-(2**63), min(2**63 - 1, s)), hard_negatives.wide_key(s) or b"") for s in scores]
    assert keys == sorted(keys) and [hard_negatives.wide_value(s, k or None) for s, k in keys] == scores
