"""SentencePiece encoding and decoding through a table of distinct chunks.

The encoder turns spaces into the mark U+2581 and puts one before the text. If
no piece of the vocabulary has the mark after another character, no merge goes
across the start of a marked word, so each distinct marked word is segmented
once in a task and its ids are joined back by position. New words of a block of
texts go to the library in one call. The table is bounded and starts anew when
full. A vocabulary with pieces that cross marks, or one
that rewrites its input, is used on whole texts instead.

Null counts as empty; an empty text has no ids. The model's file is named by a
path; executors read it from there, or from the bytes that the driver sends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import blocks, small_batches, unused

MARK = "▁"
#: A run of spaces and what follows up to the next one; spaces at the end stand alone.
_CHUNK = re.compile(r" *[^ ]+| +")
#: Chunks that one table holds, but for those of the block at hand.
TABLE_CHUNKS = 200_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def marks_only_lead(processor) -> bool:
    """Whether no piece crosses the start of a marked word and the text isn't rewritten."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    plain = processor.encode("  Åﬁ 　 ")  # kept only by a model that doesn't normalise
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and processor.decode(plain) == "  Åﬁ 　 "


class ChunkTable:
    """Ids and decoded text of each distinct chunk; a chunk starts with its spaces."""

    def __init__(self, processor):
        self.processor = processor
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids_text: list[str] = []
        self.decoded: list[str] = []
        self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def add(self, chunks: set[str]) -> None:
        if len(self.place) > TABLE_CHUNKS:
            self.clear()
        new = [c for c in chunks if c not in self.place]
        if not new:
            return
        # the encoder puts a mark before a text, but not before an empty one
        mark = [self.processor.piece_to_id(MARK)]
        found = [ids or mark for ids in self.processor.encode([c[1:] for c in new], num_threads=1)]
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        self.ids_text += [",".join(map(str, ids)) for ids in found]
        self.decoded += [c if " " + t == c else " " + t for c, t in zip(new, self.processor.decode(found, num_threads=1))]
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, found), np.int64, len(found))])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32)])

    def gather(self, places: np.ndarray) -> np.ndarray:
        """Ids of chunks one after another."""
        sizes = self.sizes[places]
        begin = (np.cumsum(self.sizes) - self.sizes)[places]
        out = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(begin - out, sizes) + np.arange(sizes.sum())]


def split(text: str) -> list[str]:
    """Marked words of a text, as the encoder sees them: with a space before the text."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return [" " + w for w in text.split(" ")]
    return _CHUNK.findall(" " + text)


@cache
def _processor(model: bytes):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    return p, marks_only_lead(p)


def encode_decode(texts: list[str], table: ChunkTable, whole: bool) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """Of a block of texts: number of ids of each, all ids one after another, ids in decimal form joined by commas, decoded texts."""
    if whole:
        found = table.processor.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.int32), [",".join(map(str, ids)) for ids in found], table.processor.decode(found, num_threads=1)
    parts = [split(t) for t in texts]
    table.add(set().union(*parts))
    places = [[*map(table.place.__getitem__, p)] for p in parts]
    flat = np.fromiter(chain.from_iterable(places), np.int64)
    each = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.concatenate([[0], np.cumsum(table.sizes[flat])])
    sizes = np.diff(ends[np.concatenate([[0], np.cumsum(each)])])
    ids_text = [",".join(map(table.ids_text.__getitem__, p)) for p in places]
    decoded = ["".join(map(table.decoded.__getitem__, p))[1:] for p in places]
    return sizes, table.gather(flat), ids_text, decoded


def _run(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, apart = _processor(model)
        table = ChunkTable(processor)
        for part in blocks(batches, 1, 2 << 20):
            sizes, ids, ids_text, decoded = encode_decode([t or "" for t in part.column(1).to_pylist()], table, not apart)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.array(ids_text, pa.string()), pa.array(decoded, pa.string())], ["id", "ids", "ids_text", "decoded"],
            )

    return run


def sentencepiece_codec(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: its id, ids (array of int), ids_text (decimal, joined by commas), decoded.

    One of these that is called as the id column is gets an underscore before its name.
    """
    small_batches(docs.sparkSession)
    with open(model or default_model(), "rb") as f:
        data = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(data), "id long, ids array<int>, ids_text string, decoded string").toDF(id_col, *[unused([id_col], n) for n in ("ids", "ids_text", "decoded")])
