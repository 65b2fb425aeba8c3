"""Operators that call a function of the caller's: models, image readers, tokenisers.

The functions run inside tasks, on batches of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embed(df: DataFrame, fn: Callable[[list[str]], list[list[float]]], width: int, id_col: str = "chunk_id", text_col: str = "content", batch: int = 64) -> DataFrame:
    """Vectors of texts by ``fn``, ``batch`` texts at a time: (id, vec). A wrong number or width of vectors is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = fn(part[text_col].fillna("").tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
                if any(len(v) != width for v in vectors):
                    raise ValueError(f"a vector isn't {width} wide")
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "vec": [list(map(float, v)) for v in vectors]})

    schema = T.StructType([df.schema[id_col], T.StructField("vec", T.ArrayType(T.FloatType()))])
    return df.select(id_col, text_col).mapInPandas(run, schema)


def resolve(df: DataFrame, fn: Callable[[str, str], dict | None], fields: str, key: str, context: str) -> DataFrame:
    """``fn(key, context)`` of each row as a struct (told), null where it fails, with the error's text."""
    told = T.StructType.fromDDL(fields)
    names = told.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, errors = [], []
            for k, c in zip(frame[key], frame[context]):
                try:
                    got, error = fn(k, c), None
                except Exception as e:  # one row's failure is its own
                    got, error = None, f"{type(e).__name__}: {e}"
                out.append(None if got is None else {n: got.get(n) for n in names})
                errors.append(error)
            yield pd.DataFrame({key: frame[key].to_numpy(), "told": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)})

    schema = T.StructType([df.schema[key], T.StructField("told", told), T.StructField("error", T.StringType())])
    return df.select(key, context).mapInPandas(run, schema)


def score_pairs(df: DataFrame, fn: Callable[[str, list[str]], list[float]], most: int = 80) -> DataFrame:
    """Relevance of each query's candidates by ``fn(query, texts)``: (query_id, query, rank, chunk_id, content) → query_id, chunk_id, score.

    A query brings at most ``most`` candidates, those of the best ranks.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        scores = fn(frame["query"].iloc[0], frame["content"].fillna("").tolist())
        if len(scores) != len(frame):
            raise ValueError(f"{len(scores)} scores for {len(frame)} candidates")
        return pd.DataFrame({"query_id": frame["query_id"], "chunk_id": frame["chunk_id"], "score": [float(s) for s in scores]})

    schema = T.StructType([df.schema["query_id"], df.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    return df.where(F.col("rank") <= most).groupBy("query_id").applyInPandas(run, schema)


def token_counter(fn: Callable[[list[str]], list[int]]):
    """A column function that counts tokens with the caller's tokeniser, for batches of texts."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fn(texts.fillna("").tolist()))

    return count


def _spans(fn: Callable[[str], Iterable[tuple[int, int]]], text: str | None) -> Iterator[tuple[int, int]]:
    for begin, end in fn(text) if text is not None else ():
        if not 0 <= begin <= end <= len(text):
            raise ValueError(f"span {begin}:{end} isn't inside a text of {len(text)}")
        yield begin, end


def token_spans(fn: Callable[[str], Iterable[tuple[int, int]]]):
    """A table function of a text: its tokens by the caller's tokeniser, with their place.

    ``fn`` gives the spans of a text's tokens, in code points; the table has a row
    (n, token, begin, end) for each, from 0. Used by a lateral join::

        texts.lateralJoin(token_spans(fn)(F.col("text").outer()))

    A null text has no tokens. A span outside its text, or one that ends before it
    begins, is an error. What needs all tokens of a text together takes
    ``with_spans``, as bringing these rows together shuffles many times the text.
    """

    class Spans:
        def eval(self, text: str):
            for n, (begin, end) in enumerate(_spans(fn, text)):
                yield n, text[begin:end], begin, end

    return F.udtf(Spans, returnType="n int, token string, begin int, end int", useArrow=True)


#: Bytes of text whose tokens a Python worker holds at once; a longer text is alone.
SPAN_BYTES = 1 << 20


def with_spans(df: DataFrame, fn: Callable[[str], Iterable[tuple[int, int]]], text_col: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with the same tokens as an array of (token, begin, end) in their order, beside the text: nothing is shuffled.

    A null text has an empty array. A text's array is one value, so it must fit a task.
    """
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema, T.StructField(name, T.ArrayType(T.StructType.fromDDL("token string, begin int, end int")))])

    def spanned(part: pa.RecordBatch) -> pa.RecordBatch:
        offsets, tokens, begins, ends = [0], [], [], []
        for text in part.column(at).to_pylist():
            for begin, end in _spans(fn, text):
                tokens.append(text[begin:end])
                begins.append(begin)
                ends.append(end)
            offsets.append(len(tokens))
        rows = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["token", "begin", "end"])
        return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], [*part.schema.names, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + SPAN_BYTES, "right")))
                yield spanned(batch.slice(low, high - low))
                low = high

    return df.mapInArrow(run, schema)


def enrich_by_hash(refs: DataFrame, cache: DataFrame, dead: DataFrame, fn: Callable[[str, str], dict | None], fields: str) -> DataFrame:
    """One call of ``fn(sha256, path)`` for each distinct content, joined back to every reference.

    refs: (ref_id, sha256, path); cache: (sha256, told); dead: (sha256), not asked
    again. Returns ref_id, sha256, told and error.
    """
    asked = refs.groupBy("sha256").agg(F.min("path").alias("path")).join(dead.select("sha256").distinct(), "sha256", "left_anti").join(cache.select("sha256"), "sha256", "left_anti")
    new = resolve(asked, fn, fields, "sha256", "path")
    known = cache.select("sha256", F.col("told").cast(new.schema["told"].dataType).alias("told"), F.lit(None).cast("string").alias("error")).unionByName(new)
    return refs.join(known, "sha256", "left").select("ref_id", "sha256", "told", "error")
