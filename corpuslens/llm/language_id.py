"""Language identification by fusing evidence.

For each language l the log probability is the sum of

* text: the mean log likelihood of the text's byte trigrams under l, times the
  number of trigrams up to ``EFFECTIVE``; long texts are no surer than that,
  as trigrams aren't independent;
* markup: the declared language is right with probability ``DECLARED_RIGHT``;
* address: a country suffix whose language is l (``SUFFIX_RIGHT``);
* host: the prior of the host, smoothed towards that of its domain, that
  towards its address suffix, and that towards the whole corpus. The counts are
  grouped aggregates of the declared languages over all rows. A host without
  declared rows has the prior of the next wider level that has some.

Trigram models are fitted for every label, on a bounded sample of its rows: an
equal share of ``SAMPLE_ROWS``, but ``LEAST_ROWS`` at least, picked by a hash of
id and text, each text whole. A model keeps the buckets that its sample has, so
models stay small for rare labels, and a model doesn't depend on how many
labels there are. All else is computed over all rows.

A row is rejected (accepted = false) if its text has no letter of any alphabet,
if the trigrams are less likely under the best language than if all were alike
(it is written in none of the languages), if no language reaches ``MIN_CONFIDENCE``, or
if the language isn't among the wanted ones. Null and empty texts have no
letter. A null or unknown declaration or suffix is no evidence.

``page_evidence`` takes all of these from raw web pages: the markup's language,
the address's host, domain and suffix, and the text between the tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import name2codepoint
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm.common import BLOCK_BYTES, blocks, small_batches, stored
from corpuslens.llm.url_filter import url_host

SAMPLE_ROWS, LEAST_ROWS = 20_000, 200
BUCKETS = 1 << 14
#: Languages scored at a time, and scores (rows times languages) held at a time; both bound the memory of a block.
SCORED, SCORES = 32, 1 << 22
EFFECTIVE = 100
DECLARED_RIGHT, SUFFIX_RIGHT, MIN_CONFIDENCE = 0.9, 0.7, 0.5
#: Weight of the wider level, in rows, at each step of the host's prior.
KAPPA = 10.0
#: Priors (hosts times languages) up to which they are broadcast.
BROADCAST_PRIORS = 640_000

#: Languages that a country's address suffix speaks for.
SUFFIX_LANGUAGE = {
    "at": "de", "br": "pt", "cl": "es", "cn": "zh", "cz": "cs", "de": "de", "dk": "da", "es": "es", "fi": "fi", "fr": "fr",
    "gr": "el", "hu": "hu", "ie": "en", "it": "it", "jp": "ja", "kr": "ko", "mx": "es", "nl": "nl", "no": "no", "pl": "pl",
    "pt": "pt", "ro": "ro", "ru": "ru", "se": "sv", "tr": "tr", "ua": "uk", "uk": "en", "us": "en",
}


class Model(NamedTuple):
    """Log probability of each trigram bucket of a language's sample, and that of any other bucket."""

    buckets: np.ndarray
    logs: np.ndarray
    rest: float

    def dense(self) -> np.ndarray:
        out = np.full(BUCKETS, self.rest)
        out[self.buckets] = self.logs
        return out


_LETTER = re.compile(r"[^\W\d_]")


def language_tag(declared: Column) -> Column:
    """Primary language of a tag such as ``en-US``, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(declared.cast("string")), "^([A-Za-z]{2,3})([-_].*)?$", 1)), F.lit(""))


def _unescaped(text: Column) -> Column:
    """Character references of HTML 4, by name or number, as characters; others stay."""
    names = F.create_map(*[F.lit(x) for n, c in {**name2codepoint, "apos": 39}.items() for x in (n, chr(c))])

    def decoded(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("int")
        char = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        char = F.when(F.startswith(name, F.lit("#")), char).otherwise(F.try_element_at(names, name))
        return F.when(i == 0, part).otherwise(F.coalesce(F.concat(char, F.substr(part, F.length(name) + 2)), F.concat(F.lit("&"), part)))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), decoded), "")).otherwise(text)


def page_evidence(url: Column, page: Column) -> dict[str, Column]:
    """text, lang, host, domain and suffix of web pages.

    The domain is the last two labels of the host, or three where the second to
    last is a general one under a country (``co.uk``). A host of one label or of
    digits has neither domain nor suffix.
    """
    host = url_host(url)
    part = lambda pattern, group: F.nullif(F.regexp_extract(host, rf"^(?:.*\.)?{pattern}\.?$", group), F.lit(""))
    two = r"([^.]+\.([a-z][a-z0-9-]*))"
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return {
        "text": F.trim(F.regexp_replace(_unescaped(bare), r"\s+", " ")),
        "lang": F.nullif(F.regexp_extract(page, r"""(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([a-z][a-z0-9_-]*)""", 1), F.lit("")),
        "host": host, "domain": F.coalesce(part(r"([^.]+\.(?:ac|co|com|edu|gov|net|org)\.[a-z]{2})", 1), part(two, 1)), "suffix": part(two, 2),
    }


def trigrams(data: bytes) -> np.ndarray:
    """Bucket of each byte trigram; ASCII letters count as lower case."""
    b = np.frombuffer(data.lower(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)


def trigram_counts(data: bytes, piece: int = 1 << 20) -> np.ndarray:
    """How often each bucket occurs, piece by piece, so that memory doesn't grow with the text."""
    counts = np.zeros(BUCKETS, np.int64)
    for i in range(0, max(1, len(data) - 2), piece):
        counts += np.bincount(trigrams(data[i : i + piece + 2]), minlength=BUCKETS)
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each label with their counts; those of at most ``SCORED`` labels are held at a time."""
    counts: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for label, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["label", "bucket", "n"])
        counts.clear()

    for part in blocks(batches, 1):
        for label, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
            if label not in counts:
                if len(counts) == SCORED:
                    yield from counted()
                counts[label] = np.zeros(BUCKETS, np.int64)
            counts[label] += trigram_counts(text)
    yield from counted()


def sample(rows: DataFrame, text_col: str, label_col: str, sample_rows: int, id_cols: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Rows (label, text) to fit on, and all labels. Each label has the row of its smallest hash at least."""
    ids = [F.col(c) for c in id_cols if c in rows.columns]
    text = F.col(text_col).cast("string")
    labelled = rows.select(language_tag(F.col(label_col)).alias("label"), text.alias("text"), F.pmod(F.xxhash64(*ids, text), F.lit(1 << 40)).alias("_key")).where("label is not null and text is not null")
    found = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("least")).orderBy(F.desc("n"), "label").collect()
    if not found:
        return None, []
    quota = max(LEAST_ROWS, sample_rows // len(found))
    limits = [(r["label"], max(r["least"], int(min(1.0, quota / r["n"]) * (1 << 40)))) for r in found]
    up_to = rows.sparkSession.createDataFrame(limits, "label string, _up_to long")
    return labelled.join(F.broadcast(up_to), "label").where("_key <= _up_to").select("label", "text"), [r["label"] for r in found]


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "lang", sample_rows: int = SAMPLE_ROWS, id_cols: list[str] = ["doc_id"]) -> dict[str, Model]:
    """The trigram model of each language.

    What comes to the driver is a count for each bucket that a language's
    sample has: no more than the sampled rows have trigrams. A language whose
    sampled texts have no trigram has an even model.
    """
    small_batches(rows.sparkSession)
    picked, names = sample(rows, text_col, label_col, sample_rows, id_cols)
    if not names:
        return {}
    counted = picked.mapInArrow(_count, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    index = {n: i for i, n in enumerate(names)}
    label = np.array([index[x] for x in counted.column("label").to_pylist()], np.int64)
    order = np.argsort(label, kind="stable")
    bucket, n = counted.column("bucket").to_numpy()[order], counted.column("n").to_numpy()[order]
    ends = np.searchsorted(label[order], np.arange(len(names) + 1))
    models = {}
    for name, a, b in zip(names, ends, ends[1:]):
        total = n[a:b].sum() + 0.5 * BUCKETS
        models[name] = Model(bucket[a:b].copy(), np.log((n[a:b] + 0.5) / total), float(np.log(0.5 / total)))
    return models


def host_priors(rows: DataFrame, languages: list[str], levels: list[Column], declared: Column, kappa: float = KAPPA) -> DataFrame:
    """Prior of each host: columns _l0 … of the levels, narrowest first, _rows and _prior, an array by language.

    Every host of ``rows`` has one. A level is smoothed towards the next wider
    one, with ``kappa`` rows' weight; one without declared rows takes that as it is.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    counted = stored(
        rows.select(*[c.alias(n) for c, n in zip(levels, names)], F.when(declared.isin(languages), declared).alias("_d"))
        .groupBy(*names, "_d").agg(F.count(F.lit(1)).cast("double").alias("_n")), "hosts",
    )

    def counts(keys: list[str]) -> DataFrame:
        one = counted.groupBy(*keys, "_d").agg(F.sum("_n").alias("_n"))
        found = F.map_from_entries(F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("_d", "_n"))))
        every = F.transform(F.array(*[F.lit(x) for x in languages]), lambda x: F.coalesce(F.try_element_at("_found", x), F.lit(0.0)))
        return one.groupBy(*keys).agg(found.alias("_found"), F.sum("_n").cast("long").alias("_rows")).select(*keys, "_rows", every.alias("_k"))

    whole = {r["_d"]: r["_n"] for r in counted.groupBy("_d").agg(F.sum("_n").alias("_n")).collect()}
    ones = [whole.get(x, 0.0) + 1.0 for x in languages]
    prior = F.array(*[F.lit(x / sum(ones)) for x in ones])
    out = None
    for width in range(len(names)):  # widest level first
        keys = names[len(names) - 1 - width :]
        level = counts(keys)
        if out is not None:
            on = [level[k].eqNullSafe(out[k]) for k in keys[1:]]
            cond = on[0]
            for c in on[1:]:
                cond = cond & c
            level = level.join(out, cond, "left").select(*[level[k] for k in keys], level["_rows"], "_k", "_prior")
            prior = F.col("_prior")
        total = F.aggregate("_k", F.lit(0.0), lambda acc, x: acc + x)
        out = level.select(*keys, "_rows", F.zip_with("_k", prior, lambda k, p: (k + kappa * p) / (total + kappa)).alias("_prior"))
    return out


def with_priors(marked: DataFrame, priors: DataFrame, most: int) -> DataFrame:
    """Rows with columns _h0, _h1 and _h2, each with the _prior of its host.

    The priors of ``most`` hosts, those of most rows, are broadcast, and their
    rows stay where they are. Rows of the other hosts, of which none has a large
    share of all rows, are joined by host.
    """
    def joined(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        on = [F.col(f"_h{i}").eqNullSafe(F.col(f"_l{i}")) for i in range(3)]
        return rows.join(found, on[0] & on[1] & on[2], how).drop("_l0", "_l1", "_l2")

    if priors.count() <= most:
        return joined(marked, F.broadcast(priors.drop("_rows")), "left")
    priors = stored(priors, "priors")
    # one row for each number of rows that some host has, so the window is short
    sizes = priors.groupBy("_rows").agg(F.count(F.lit(1)).alias("_n"))
    reached = sizes.select("_rows", F.sum("_n").over(Window.orderBy(F.desc("_rows"))).alias("_upto"))
    least = reached.where(F.col("_upto") <= most).agg(F.min("_rows")).first()[0]
    large = F.broadcast(priors.where(F.lit(False) if least is None else F.col("_rows") >= least).drop("_rows").withColumn("_told", F.lit(True)))
    told = joined(marked, large, "left")
    near = told.where("_told").drop("_told")
    far = told.where("_told is null").drop("_told", "_prior")
    small = priors.where(F.lit(True) if least is None else F.col("_rows") < least).drop("_rows")
    return near.unionByName(joined(far, small, "left"))


def _score(models: dict[str, Model], at: dict[str, int], keep: int, schema_names: list[str], wanted: list[str] | None):
    names = list(models)
    index = {n: i for i, n in enumerate(names)}
    ok = np.array([wanted is None or n in wanted for n in names], bool)
    n_lang = max(1, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}

        def table(first: int) -> np.ndarray:
            """Models of ``SCORED`` languages; the only one if there are no more, else made anew."""
            if first not in tables:
                tables.clear()
                tables[first] = np.stack([models[x].dense() for x in names[first : first + SCORED]], 1)
            return tables[first]

        whole = blocks(batches, at["text"], max(1 << 16, BLOCK_BYTES // (2 * min(n_lang, SCORED))))
        most = max(1, SCORES // n_lang)
        for part in (block.slice(i, most) for block in whole for i in range(0, block.num_rows, most)):
            n = part.num_rows
            texts = part.column(at["text"]).to_pylist()
            coded = [(t or "").encode("utf-8", "replace") for t in texts]
            sizes = np.array([max(0, len(t) - 2) for t in coded])
            mean = np.zeros((n, len(names)))
            long = sizes > BUCKETS  # texts of more trigrams than there are buckets are counted by bucket
            counts = {i: trigram_counts(coded[i]) for i in np.flatnonzero(long)}
            has = np.flatnonzero((sizes > 0) & ~long)
            starts = np.cumsum(sizes[has]) - sizes[has]
            every = np.concatenate([trigrams(coded[i]) for i in has]) if len(has) else None
            for a in range(0, len(names), SCORED):
                for i, c in counts.items():
                    mean[i, a : a + SCORED] = c @ table(a) / sizes[i]
                if every is not None:
                    mean[has, a : a + SCORED] = np.add.reduceat(table(a)[every], starts, 0) / sizes[has, None]
            log = mean * np.minimum(sizes, EFFECTIVE)[:, None]
            for key, right in (("declared", DECLARED_RIGHT), ("suffix", SUFFIX_RIGHT)):
                for i, value in enumerate(part.column(at[key]).to_pylist()):
                    if value in index:
                        log[i] += np.log((1 - right) / max(1, n_lang - 1) + 1e-12)
                        log[i, index[value]] += np.log(right) - np.log((1 - right) / max(1, n_lang - 1) + 1e-12)
            for i, prior in enumerate(part.column(at["prior"]).to_pylist()):
                if prior is not None:
                    log[i] += np.log(prior)
            best, sure, fine = [None] * n, [0.0] * n, [False] * n
            if names:
                p = np.exp(log - log.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                top = p.argmax(1)
                for i in range(n):
                    if not _LETTER.search(texts[i] or ""):
                        continue
                    best[i], sure[i] = names[top[i]], float(p[i, top[i]])
                    known = not sizes[i] or mean[i].max() > -np.log(BUCKETS) + 1e-9
                    fine[i] = bool(known and sure[i] >= MIN_CONFIDENCE and ok[top[i]])
            yield pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(best, pa.string()), pa.array(sure, pa.float64()), pa.array(fine, pa.bool_())], schema_names)

    return run


def identify(
    rows: DataFrame, models: dict[str, np.ndarray], keep: list[str], text_col: str = "text", declared: Column | None = None,
    host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, wanted: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of every row, then detected (language), confidence, accepted.

    host, domain and suffix may be null columns or left out. Python sees each
    text once. Rows aren't shuffled as long as the hosts are few; beyond that
    only rows of hosts with few rows are (``with_priors``).
    """
    nothing = F.lit(None).cast("string")
    declared = language_tag(declared) if declared is not None else nothing
    levels = [nothing if c is None else c.cast("string") for c in (host, domain, suffix)]
    by_suffix = nothing
    for k, v in SUFFIX_LANGUAGE.items():
        by_suffix = F.when(levels[2] == k, v).otherwise(by_suffix)
    marked = rows.select(
        *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(text_col).cast("string").alias("_text"), declared.alias("_declared"), by_suffix.alias("_by"),
        *[c.alias(f"_h{i}") for i, c in enumerate(levels)],
    )
    if models and host is not None:
        marked = with_priors(marked, host_priors(rows, list(models), levels, declared), max(1, BROADCAST_PRIORS // len(models)))
    else:
        marked = marked.withColumn("_prior", F.lit(None).cast("array<double>"))
    n = len(keep)
    marked = marked.select(*[f"_keep{i}" for i in range(n)], "_text", "_declared", "_by", "_prior")
    at = {"text": n, "declared": n + 1, "suffix": n + 2, "prior": n + 3}
    schema = T.StructType([*marked.schema.fields[:n], T.StructField("detected", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    scored = marked.mapInArrow(_score(models, at, n, [f.name for f in schema.fields], wanted), schema)
    return scored.toDF(*keep, "detected", "confidence", "accepted")


def keep_identified(docs: DataFrame, text_col: str = "text", declared_col: str = "lang", host_col: str = "source", wanted: list[str] | None = None) -> DataFrame:
    """The accepted rows of ``docs``, with all their columns."""
    models = fit(docs, text_col, declared_col)
    names = docs.columns
    out = identify(docs, models, names, text_col, F.col(declared_col), F.col(host_col), wanted=wanted).toDF(*names, "_detected", "_confidence", "_accepted")
    return out.where("_accepted").select(*names)
