"""Sections, blocks, chunks, glossary and sinks on hand-made documents."""

import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import ids
from corpuslens.functions import text as T
from corpuslens.operators import blocks as B
from corpuslens.operators import chunks as C
from corpuslens.operators import glossary as G
from corpuslens.operators import sections as S
from corpuslens.operators import selection, splitting, udf
from corpuslens.plans import io_queries
from corpuslens.sources import read, snapshots, write

LONG = "This sentence is here to be long enough for a section that is kept by the rules. " * 3
DOC = f"""# Title 38.211

before all
## 1 Scope
{LONG}
## Contents
| a | 1 |
## 5 Frames
### 5.1 First
short one
### 5.2 Second
short two ![x](img/a.png)
#### | not | a heading |
## 6 Blocks
{LONG}

Table 6-1: caption
| h | i |
|---|---|
| 1 | 2 |

- 1> do this
    more of it
- 2> and that
text after
![alt](img/f.png)

the picture shows
Figure 6-1: The line.

$$x = y$$
-- ASN1START
A ::= B
-- ASN1STOP
end
"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("38.211", "Rel-19", DOC), ("38.212", "Rel-19", ""), ("38.213", "Rel-19", None), ("38.214", "Rel-19", "no heading at all")], "spec_id string, release string, text string")


def test_sectionize(docs):
    got = [(r.spec_id, r.section_ord, r.clause, r.section_title, r.section_level) for r in S.sectionize(docs).orderBy("spec_id", "section_ord").collect()]
    assert got == [
        ("38.211", 0, "", "<preamble>", 0), ("38.211", 1, "1", "Scope", 2), ("38.211", 2, "", "Contents", 2), ("38.211", 3, "5", "Frames", 2), ("38.211", 4, "5.1", "First", 3),
        ("38.211", 5, "5.2", "Second", 3), ("38.211", 6, "6", "Blocks", 2), ("38.214", 0, "", "<preamble>", 0),
    ]
    second = S.sectionize(docs).where("clause = '5.2'").first()
    assert second.image_refs == ["img/a.png"] and second.body.endswith("#### | not | a heading |")


def test_garbage_and_merge(docs):
    flagged = S.flag_garbage(S.sectionize(docs))
    reasons = {r.section_title: r.drop_reason for r in flagged.where("spec_id = '38.211'").collect()}
    assert reasons["Contents"] == "stop-list:contents" and reasons["<preamble>"] == "stop-list:<preamble>" and reasons["Scope"] is None and reasons["Frames"] == "empty-body:0chars"
    merged = S.merge_siblings(S.sectionize(docs).where("clause like '5.%'")).collect()
    assert len(merged) == 1 and merged[0].clause == "5" and merged[0].section_title == "<merged: 5.1 / 5.2>" and merged[0].body.startswith("### 5.1 First\n\nshort one\n\n### 5.2 Second")
    apart = S.merge_siblings(S.sectionize(docs).where("clause like '5.%'"), cap=3).collect()
    assert len(apart) == 2


def test_blocks(docs):
    section = S.sectionize(docs).where("clause = '6'")
    got = [(r.kind, r.text.split("\n")[0]) for r in B.blockize(section).orderBy("block_ord").collect()]
    assert got == [
        ("paragraph", LONG.strip()), ("table", "Table 6-1: caption"), ("action_list", "- 1> do this"), ("paragraph", "text after"), ("figure", "![alt](img/f.png)"),
        ("formula_block", "$$x = y$$"), ("asn1", "-- ASN1START"), ("paragraph", "end"),
    ]


def test_chunks_are_stable_headed_and_once(spark, docs):
    twice = docs.unionByName(docs.limit(0))
    one = C.build_chunks(docs).orderBy("section_ord", "piece_ord").collect()
    two = C.build_chunks(twice.repartition(3)).orderBy("section_ord", "piece_ord").collect()
    assert [r.chunk_id for r in one] == [r.chunk_id for r in two] and len({r.chunk_id for r in one}) == len(one)
    scope = next(r for r in one if r.clause == "1")
    assert scope.content.startswith("[38.211 § 1 Scope]\n\nThis sentence")
    figure = next(r for r in one if r.chunk_type == "figure")
    assert "Figure caption: Figure 6-1: The line" in figure.content and figure.content.endswith("Context: text after")


_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]", re.ASCII)
_LEVEL = re.compile(r"[ \t]*-[ \t]+(\d+)>\s")


def n_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def token_pieces(text: str, cap: int) -> list[str]:
    """Runs of ``cap`` tokens of a text."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    return [text[spans[a][0] : spans[min(a + cap, len(spans)) - 1][1]] for a in range(0, len(spans), cap)]


def action_pieces(text: str, cap: int) -> list[str]:
    """Pieces of an action list by recursion over its levels."""

    def cut(lines: list[str], above: int, anchor: list[str]) -> list[str]:
        whole = "\n".join([*anchor, *lines]).rstrip()
        if n_tokens(whole) <= cap:
            return [whole] if whole.strip() else []
        levels = [int(m[1]) if (m := _LEVEL.match(x)) else None for x in lines]
        deeper = [v for v in levels if v is not None and v > above]
        if not deeper:
            return token_pieces(whole, cap)
        least = min(deeper)
        starts = [i for i, v in enumerate(levels) if v == least]
        if len(starts) == 1:
            return cut(lines, least, anchor) if anchor else cut(lines[1:], least, lines[:1])
        out: list[str] = []
        for a, b in zip([0, *starts[1:]], [*starts[1:], len(lines)]):
            part = lines[a:b]
            out += cut(part, least, anchor) if anchor or n_tokens("\n".join(part)) <= cap else cut(part[1:], least, part[:1])
        return out

    return cut(text.split("\n"), -1, [])


def split_by_expressions(spark, texts, cap):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.p for r in df.select("i", splitting.split_actions(F.col("t"), cap).alias("p")).orderBy("i").collect()]


def test_action_lists_are_cut_as_by_recursion(spark):
    rng = random.Random(12)
    texts = [None, "", "\n\n", "no action at all " * 20, "- 1> only one " + "word " * 40, "- 3> deep\n- 2> less\n- 3> again\n", "intro words here\n- 1> a\n- 1> b"]
    for _ in range(150):
        lines = [rng.choice(["- {}> {}", "  -  {}>\t{}", "- {}> {}  "]).format(rng.choice([1, 1, 2, 2, 3, 4, 9]), "w " * rng.randint(0, 25)) if rng.random() < 0.8 else rng.choice(["", "plain " * rng.randint(1, 12), " "]) for _ in range(rng.randint(1, 14))]
        texts.append("\n".join(lines))
    for cap in (7, 30):
        assert split_by_expressions(spark, texts, cap) == [None if t is None else action_pieces(t, cap) for t in texts]
    plan = spark.createDataFrame([("a",)], "t string").select(splitting.split_actions(F.col("t"), 30))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_oversized_blocks_are_split(spark):
    table = "Table 1: c\n| a | b |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(40))
    odd = [table, "| a |\n| b |", "| a |\n|:-:|\n| " + "y, " * 100 + " |", "| a |\n|---|\n", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", splitting.split_table(F.col("t"), 60).alias("p"), splitting.force_split_table(F.col("t"), 60).alias("f")).orderBy("i").collect()
    parts, forced = got[0].p, got[0].f
    assert len(parts) > 1 and all(p.startswith("Table 1: c\n\n| a | b |\n|---|---|\n") for p in parts)
    assert [x for p in parts for x in p.split("\n")[4:]] == table.split("\n")[3:]
    assert all(n_tokens(p) <= 60 for p in forced) and [x for p in forced for x in p.split("\n")[4:]] == table.split("\n")[3:]
    assert got[1].p == got[1].f == [odd[1]] and got[3].p == [odd[3]] and got[4].p is None
    assert got[2].p == [odd[2]] and len(got[2].f) > 3 and all(n_tokens(p) <= 60 for p in got[2].f) and "".join("".join(p.split("\n")[2:]) for p in got[2].f).count("y") == 100
    actions = "- 1> one\n" + "\n".join(f"- 2> two {i} and some words more" for i in range(10)) + "\n- 1> last"
    parts = split_by_expressions(spark, [actions], 30)[0]
    assert all(n_tokens(p) <= 30 for p in parts) and parts[0].startswith("- 1> one\n- 2> two 0") and parts[1].startswith("- 1> one\n- 2> two 1") and parts[-1] == "- 1> last"
    assert split_by_expressions(spark, ["word " * 100], 30)[0] == [("word " * 30).strip()] * 3 + [("word " * 10).strip()]


def test_split_by_expressions(spark):
    text = "One two three. Four five.\n\nSix.\n\n" + "w " * 30
    got = spark.createDataFrame([(text,)], "t string").select(B.split_paragraph(F.col("t"), 8).alias("p")).first().p
    assert got[0] == "One two three. Four five." or got[0].startswith("One two three.")
    assert all(n_tokens(p) <= 8 for p in got) and " ".join(got).split() == text.split()
    asn = "-- ASN1START\nA ::= B\n x\nC ::= D\n-- ASN1STOP"
    got = spark.createDataFrame([(asn,), ("one line",)], "t string").select(B.split_asn1(F.col("t")).alias("p")).collect()
    assert got[0].p == ["-- ASN1START\nA ::= B\n x\n-- ASN1STOP", "-- ASN1START\nC ::= D\n-- ASN1STOP"] and got[1].p == ["one line"]


def test_ids_are_uuid5(spark):
    import hashlib
    import uuid

    row = spark.createDataFrame([("38.211", "5.1", "text é")], "s string, c string, t string").select(ids.chunk_id(F.col("s"), F.col("c"), F.col("t")).alias("i")).first()
    assert row.i == str(uuid.uuid5(uuid.UUID(ids.CHUNK_SPACE), "38.211|5.1|" + hashlib.sha256("text é".encode()).hexdigest()[:16]))


def test_overlap_uses_the_piece_as_it_was(spark):
    rows = [("s", "r", 0, i, t, k) for i, (t, k) in enumerate([("a b. c d", "text"), ("e f", "text"), ("g", "table"), ("h", "text"), ("i", "text")])]
    df = spark.createDataFrame(rows, "spec_id string, release string, section_ord int, piece_ord int, text string, chunk_type string")
    got = [r.text for r in C.add_overlap(df, 3).orderBy("piece_ord").collect()]
    assert got == ["a b. c d", "c d\n\ne f", "g", "h", "h\n\ni"] or got[1].endswith("e f") and got[2:] == ["g", "h", "h\n\ni"]


def test_glossary(spark):
    body = "**PDU Session:** a link\nmore\n\n\n\nstill\n**AMF:** x\n## next\n| UE | User Equipment |\n|---|---|\n| Abbreviation | Meaning |\n| " + "y" * 70 + " | no |"
    df = spark.createDataFrame([("23.501", 0, "3", "Definitions and abbreviations", body), ("23.501", 1, "3", "definitions", body), ("23.501", 2, "4", "Other", body)], "spec_id string, section_ord int, clause string, section_title string, body string")
    got = sorted((r.term, r.normalized_term, r.definition) for r in G.build_glossary(df).collect())
    assert got == [("AMF", "amf", "x"), ("PDU Session", "pdu session", "a link\nmore\n\nstill"), ("UE", "ue", "User Equipment")]


def test_tokens(spark):
    row = spark.createDataFrame([("one, two  three_3é",), ("",), (None,)], "t string").select(T.n_tokens(F.col("t")).alias("n"), T.split_tokens(F.col("t"), 2).alias("p")).collect()
    assert [r.n for r in row] == [5, 0, 0] and row[0].p == ["one,", "two  three_3", "é"] and row[1].p == []


def test_replace_by_document(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "spec_id string, chunk_id int")
    snapshots.create_table(spark, path, make([]).schema)
    snapshots.replace_documents(make([("a", i) for i in range(5)] + [("b", 9)]), path)
    snapshots.replace_documents(make([("a", i) for i in range(3)]), path)
    got = snapshots.read_table(spark, path).groupBy("spec_id").count().collect()
    assert {r.spec_id: r["count"] for r in got} == {"a": 3, "b": 1}
    assert snapshots.write_glossary(make([("b", 1), ("b", 2)]), make([("a", 0), ("b", 0)]), path)["deleted"] == 4
    assert sorted((r.spec_id, r.chunk_id) for r in snapshots.read_table(spark, path).collect()) == [("b", 1), ("b", 2)]


def test_readers(spark, tmp_path):
    root = tmp_path / "hf" / "Rel-19" / "38_series" / "38211"
    root.mkdir(parents=True)
    (root / "raw.md").write_text("# T\nbody")
    (root / "b.png").write_bytes(b"2")
    (root / "a.png").write_bytes(b"1")
    (tmp_path / "hf" / "Rel-19" / "38_series" / "38999").mkdir()
    (tmp_path / "hf" / "Rel-19" / "38_series" / "38999" / "a.png").write_bytes(b"1")
    text = read.read_corpus(spark, str(tmp_path / "hf")).first()
    assert (text.release, text.spec_uid, text.text) == ("Rel-19", "38211", "# T\nbody")
    manifest = read.build_manifest(read.list_files(spark, str(tmp_path / "hf"))).collect()
    assert len(manifest) == 1 and manifest[0].spec_id == "38.211" and [i.path[-5:] for i in manifest[0].images] == ["a.png", "b.png"]
    hashes = {r.path[-5:]: r.sha256 for r in read.hash_files(spark, str(tmp_path / "hf"), "*.png").collect()}
    assert len(hashes) == 2
    lines = tmp_path / "q.jsonl"
    lines.write_text('{"item_id": "1", "question": "q"}\n\nnot json\n{"item_id": "", "question": "x"}\n')
    assert read.read_jsonl(spark, str(lines), "item_id string, question string", ["item_id", "question"]).count() == 1
    keyed = tmp_path / "k.json"
    keyed.write_text('{"q 1": {"a": "x"}, "q 2": {"a": "y"}}')
    assert sorted((r.key, r.a) for r in read.read_keyed_json(spark, str(keyed), "a string").collect()) == [("q 1", "x"), ("q 2", "y")]
    golden = tmp_path / "g.json"
    golden.write_text('[{"id": "a", "expected_specs": [{"spec_id": " 23.501 "}, {"spec_id": ""}]}, {"id": "b"}]')
    got = {r.id: r for r in read.read_golden(spark, str(golden)).collect()}
    assert got["a"].expected_specs[0].spec_id == "23.501" and len(got["a"].expected_specs) == 1 and got["b"].expected_facts == [] and got["b"].must_say_not_found is False


def test_production_documents_take_the_newest_release_first(spark):
    rows = [("a", "Rel-18", "TS", "38", 0), ("a", "Rel-19", "TR", "38", 1), ("b", "Rel-18", "TS", "38", 2), ("b", "odd", "TS", "38", 3), ("b", "Rel-18", "TS", "23", 4)]
    df = spark.createDataFrame(rows, "spec_id string, release string, spec_type string, series string, ordinal int")
    assert [(r.spec_id, r.ordinal) for r in selection.production_documents(df, "TS", ["38"]).collect()] == [("b", 2)]


def test_user_functions_check_sizes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "chunk_id long, content string")
    assert [list(r.vec) for r in udf.embed(df, lambda t: [[1.0, float(len(x))] for x in t], 2).orderBy("chunk_id").collect()] == [[1.0, 1.0], [1.0, 0.0]]
    with pytest.raises(Exception, match="vectors for"):
        udf.embed(df, lambda t: [], 2).collect()
    with pytest.raises(Exception, match="wide"):
        udf.embed(df, lambda t: [[1.0]] * len(t), 2).collect()


def test_emphasis_of_over_200_characters_stays(spark):
    """Marks go in pairs around 1 to 200 characters; longer spans keep theirs, and the second may open the next."""
    rows = [(f"*{'a' * n}* b",) for n in (1, 200, 201)] + [(f"**{'x' * 201}* y* z",), ("*a **b** c",), ("***",), ("é" * 200,), (f"*{'é' * 200}*",)]
    t = spark.createDataFrame(rows, "t string").select(T.sanitize(F.col("t"), 1000).alias("s"))
    want = ["a b", "a" * 200 + " b", f"*{'a' * 201}* b", f"**{'x' * 201} y z", "a b** c", "***", "é" * 200, "é" * 200]
    assert [r.s for r in t.collect()] == want


def test_files_are_written_whole_by_their_tasks_and_listed_in_few_tasks(spark, tmp_path):
    rows = [(f"release={i % 2}/series=0/spec_uid={i}/part-0.txt", "é\n" * (i + 1)) for i in range(100)]
    root = f"file://{tmp_path}/a folder"
    df = spark.createDataFrame(rows, "path string, content string").repartition(3)
    assert write.write_files(df, root.replace(" ", "%20")) == 100
    assert write.write_files(df, root.replace(" ", "%20")) == 100  # again: the same files
    seen = []
    tracker, job = spark.sparkContext.statusTracker(), "listing"
    spark.sparkContext.setJobGroup(job, job)
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(key)
    got = read.hash_files(spark, root, "part-*")
    for j in tracker.getJobIdsForGroup(job):
        seen += [tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen and max(seen) <= 8 * spark.sparkContext.defaultParallelism and spark.conf.get(key) == was
    assert {r.path.split("spec_uid=")[1].split("/")[0]: (r.size, r.sha256) for r in got.collect()} == {
        str(i): (len(c.encode()), hashlib.sha256(c.encode()).hexdigest()) for i, (_, c) in enumerate(rows)
    }
    assert {(r.release, r.spec_uid): r.text for r in read.read_corpus(spark, root, "part-*").collect()} == {(f"release={i % 2}", f"spec_uid={i}"): c for i, (_, c) in enumerate(rows)}
    with pytest.raises(ValueError, match="isn't a file"):
        write.write_files(df, "hdfs://x/y")


def test_small_files_are_read_in_tasks_of_many(spark, tmp_path, monkeypatch):
    """A task of its own for each two files, as Spark's readers had here, takes longer than the files."""
    rows = [(f"release={i % 3}/series=0/spec_uid={i}/raw.md", "é\n" * (i + 1)) for i in range(200)]
    root = f"file://{tmp_path}/corpus"
    write.write_files(spark.createDataFrame(rows, "path string, content string"), root)
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, str(8 << 20))
    try:
        got = read.read_corpus(spark, root)
        other = read.read_corpus(spark, root.removeprefix("file://"))  # by Spark's reader, as in any other store
        assert got.rdd.getNumPartitions() == 4 and other.rdd.getNumPartitions() == 32
        want = sorted((f"release={i % 3}", f"spec_uid={i}", c) for i, (_, c) in enumerate(rows))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, other.collect())) == want
    finally:
        spark.conf.set(key, was)
    monkeypatch.setattr(read, "BATCH_BYTES", 300)
    monkeypatch.setattr(read, "TASK_FILES", 20)
    many = read.read_corpus(spark, root)  # tasks grow in number with the files and with their bytes
    assert many.rdd.getNumPartitions() == 10 and sorted(map(tuple, many.collect())) == want
    monkeypatch.setattr(read, "TASK_BYTES", 1500)
    assert read.read_corpus(spark, root).rdd.getNumPartitions() == -(-sum(len(c.encode()) for _, c in rows) // 1500)


def test_files_that_tasks_list_are_those_of_sparks_readers(spark, tmp_path):
    top = tmp_path / "a b%20c"
    files = {
        "raw.md": b"top", "R 1+x/s=1/d #2/raw.md": b"\xef\xbb\xbfa\r\n\xff\x00", "R/s/_d/raw.md": b"hidden", "R/s/.d/raw.md": b"hidden", "R/s/_d=1/raw.md": b"kept", "R/s/_metadata/raw.md": b"kept",
        "R/s/e/raw.md": b"", "R/s/e/raw.md._COPYING_": b"x", "R/s/f/_raw.md": b"hidden", "R/s/f/raw.mdx": b"x", "R/s/deep/er/est/é/raw.md": b"deep", "R/s/g/raw.md.gz": gzip.compress(b"zipped"),
    }
    for name, content in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(content)
    (top / "R/s/link").symlink_to(top / "R/s/_d=1")
    (top / "R/s/broken").symlink_to(top / "nowhere")
    texts = lambda root, name: sorted((r.release, r.spec_uid, bytes(r.b)) for r in read.read_corpus(spark, root, name).select("*", F.col("text").cast("binary").alias("b")).collect())
    got = texts(f"file://{top}", "raw.md")
    assert got == texts(str(top), "raw.md") == texts(f"file:{top}/", "raw.md")
    assert ("R 1+x", "d #2", b"\xef\xbb\xbfa\r\n\xff\x00") in got and ("er", "é", b"deep") in got and ("R", "link", b"kept") in got and len(got) == 6
    assert ("R", "g", b"zipped") in texts(f"file://{top}", "raw*") == texts(str(top), "raw*")
    assert sorted(read.list_files(spark, f"file://{top}").collect()) == sorted(read.list_files(spark, str(top)).collect())
    assert texts(f"file://{top}", "raw.{md,mdx}") == texts(str(top), "raw.{md,mdx}") and read.list_files(spark, f"file://{top}/R/*/e").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read.list_files(spark, f"file://{top}/nowhere")


def test_pages_of_large_row_groups_are_dealt_before_their_files_are_written(spark, tmp_path, monkeypatch):
    rows = [(i, f"<p>{i}</p>") for i in range(100)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(io_queries, "TASK_PAGES", 30)
    seen, write_files = [], write.write_files
    monkeypatch.setattr(write, "write_files", lambda df, root: seen.append(df.rdd.getNumPartitions()) or write_files(df, root))
    got = io_queries.src01_read_corpus(spark, str(tmp_path)).collect()
    assert seen == [4]
    assert {(r.release, r.spec_uid, r.sha256) for r in got} == {(f"release={i % 3}", f"spec_uid={i}", hashlib.sha256(f"{h}\n".encode()).hexdigest()) for i, h in rows} and len(got) == 100


def test_small_files_are_hashed_in_tasks_of_many(spark, tmp_path, monkeypatch):
    rows = [(f"release={i % 3}/series=0/spec uid={i}/b.png", "é\n" * (i + 1)) for i in range(200)]
    root = f"file://{tmp_path}/corpus"
    write.write_files(spark.createDataFrame(rows, "path string, content string"), root)
    write.write_files(spark.createDataFrame([("a/empty.png", ""), ("a/_b.png", "hidden"), ("a/b.txt", "another")], "path string, content string"), root)
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    spark.conf.set(key, str(8 << 20))
    try:
        got = read.hash_files(spark, root, "*.png")
        other = read.hash_files(spark, root.removeprefix("file://"), "*.png")  # by Spark's reader, as in any other store
        assert got.rdd.getNumPartitions() == 4 and other.rdd.getNumPartitions() == 32
        want = sorted((f"file:{tmp_path}/corpus/{p}", len(c.encode()), hashlib.sha256(c.encode()).hexdigest()) for p, c in rows)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, other.collect())) == want and got.dtypes == other.dtypes
    finally:
        spark.conf.set(key, was)
    monkeypatch.setattr(read, "TASK_FILES", 20)
    assert read.hash_files(spark, root, "*.png").rdd.getNumPartitions() == 10


def test_spans_of_a_text_stay_in_its_row_without_a_shuffle(spark, monkeypatch):
    fn = lambda text: [m.span() for m in re.finditer(r"\S+|\s+", text)]
    texts = ["a é  b", None, "", "x" * 50, "one two"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    monkeypatch.setattr(udf, "SPAN_BYTES", 8)
    got = udf.with_spans(df, fn)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert [[tuple(s) for s in r.spans] for r in got.orderBy("id").collect()] == [[(t[a:b], a, b) for a, b in fn(t)] if t else [] for t in texts]
    rows = df.lateralJoin(udf.token_spans(fn)(F.col("text").outer())).select("id", "token", "begin", "end").collect()
    assert sorted(map(tuple, rows)) == sorted((i, t[a:b], a, b) for i, t in enumerate(texts) for a, b in fn(t or ""))
    with pytest.raises(Exception, match="isn't inside a text of 6"):
        udf.with_spans(df, lambda text: [(0, 7)]).collect()


def test_token_spans_query_shuffles_no_more_than_the_texts(spark):
    from corpuslens.plans import QUERIES

    plan = QUERIES["udf04_token_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "collect_list" not in plan


def test_pieces_and_blocks_are_made_once(spark):
    from corpuslens.plans import QUERIES

    plan = QUERIES["chk12_build_chunks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if line.strip(" +-:").startswith("Filter")]
    assert filters and not any("Filter (size(" in f or "Filter ((size(" in f or "_b#" in f and "array_join" in f for f in filters)


def test_tokens_are_counted_as_the_pattern_finds_them(spark):
    texts = ["", "a b", " \t\n\x0b\f\rx", "a1_b-c é\u00a0\u2028 \U0001f600!", "w  w$1 \\", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.n_tokens(F.col("t")).alias("n"), F.regexp_count(F.coalesce("t", F.lit("")), F.lit(T.TOKEN)).alias("m")).collect()
    assert [r.n for r in got] == [r.m for r in got] and sum(r.n for r in got) > 10


def _codes_by_hand(lines):
    """Letters of the lines of a section, by a plain loop."""
    row, rule = lambda x: re.match(B.ROW, x), lambda x: re.match(B.RULE, x)
    blank, action = lambda x: x.strip(" ") == "", lambda x: re.match(B.ACTION, x)
    marked = lambda x, m: m in x and "--" in x.split(m)[0]
    caption = lambda x, w: re.match(rf"(?i)^[ \t*]*{w}[ \t]+[A-Z]?[0-9]", x)
    open_, blanks, captioned, out = None, 0, False, ""
    for i, x in enumerate(lines):
        at = lambda k, f: i + k < len(lines) and bool(f(lines[i + k]))
        heading, image, ruled = re.match("^#{1,6}[ \t]", x), re.match(B.IMAGE, x), rule(x) or row(x) and at(1, rule)
        then_text = i + 1 < len(lines) and not blank(lines[i + 1]) and not action(lines[i + 1])
        ends = image or heading or marked(x, "ASN1START") or ruled or blank(x) and (blanks >= 1 or captioned)
        goes_on = (
            open_ in ("asn1", "formula_block", "titles") or open_ == "table" and (row(x) or blank(x)) or open_ == "figure" and not ends
            or open_ == "action_list" and (action(x) or x.startswith(("    ", "\t")) or blank(x) and not then_text)
        )
        titles = caption(x, "table") and at(1, row) and (at(1, rule) or at(2, rule) or at(3, rule))
        fresh = next((n for n, t in (
            ("asn1", marked(x, "ASN1START")), ("figure", image), ("table", row(x) and (rule(x) or at(1, rule) or at(2, rule))), ("action_list", action(x)), ("formula_block", "$$" in x), ("titles", titles), ("heading", heading),
        ) if t), "paragraph")
        kind = ("table" if open_ == "titles" else open_) if goes_on else fresh
        letter = B.KINDS[{"titles": "table", "heading": "paragraph"}.get(kind, kind)]
        out += letter.upper() if i == 0 or not goes_on and (fresh != "paragraph" or open_ != "paragraph") else letter
        blanks, captioned = blanks + 1 if goes_on and blank(x) else 0, kind == "figure" and bool(goes_on and (captioned or caption(x, "figure")))
        shut = kind == "asn1" and marked(x, "ASN1STOP") or kind == "formula_block" and ("$$" in x if goes_on else x.count("$$") > 1) or kind == "heading"
        open_ = None if shut else kind
    return out


def test_lines_are_folded_as_by_a_plain_loop(spark):
    rng = random.Random(6)
    some = ["", "  ", "text", "| a | b |", "|---|---|", "![x](y.png)", "Figure 5.1-2: cap", "Table 5.1-2: cap", "- 1> do", "    more", "$$", "$$ a $$", "$$ a", "# head", "-- ASN1START", "-- ASN1STOP", "---", "\tmore"]
    rows = [(i, [rng.choice(some) for _ in range(rng.randrange(1, 25))]) for i in range(3000)]
    got = spark.createDataFrame(rows, "i int, x array<string>").select("i", B.block_codes(B.line_classes(F.col("x"))).alias("c"))
    assert {r.i: r.c for r in got.collect()} == {i: _codes_by_hand(x) for i, x in rows}


def test_a_body_is_made_once_and_the_fold_over_its_lines_is_small(spark):
    """No filter makes a body twice, and no part of the fold is written out again wherever it is used."""
    docs = spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, ""), (4, " \n ")], "spec_id int, t string").select("spec_id", F.concat("t", F.lit("\n# c")).alias("body"), "t")
    assert "Filter" not in B.blockize(docs.drop("t"))._jdf.queryExecution().optimizedPlan().toString()
    got = B.blockize(docs.select("spec_id", F.col("t").alias("body"))).collect()
    assert [(r.spec_id, r.block_ord, r.kind, r.text) for r in got] == [(1, 1, "paragraph", "a\n\nb")]
    assert B.block_codes(F.col("c"))._jc.toString().count("CASE") < 40
