"""Chat formatting from an event log.

Events of a conversation, sorted by sequence number, are folded into final
messages, which are then rendered with a template and a loss mask.

======================  =====================================================
event                   effect
======================  =====================================================
``delta``               appends its text to the message of its turn; a turn's
                        first event starts the message
``edit``                replaces the message of its turn by its text and drops
                        all later turns
``regenerate``          empties the message of its turn and drops all later
                        turns; deltas that follow fill it again
======================  =====================================================

So an event survives if no later ``edit`` or ``regenerate`` names its turn or
an earlier one. The output is one segment per message,

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and a conversation's text is its segments in order. A control string inside a
text gets a backslash: ``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` and so
on; in roles, backslashes and line feeds are escaped too. Both are undone on
reading. The mask covers each assistant's text: code points [loss_start,
loss_end) of its segment.

A null text counts as empty, a null role as ``""``. Events with a null
conversation form one conversation. Equal sequence numbers are ordered by
turn, role and text, so repeated rows give the same result in any order; a row
given twice counts twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import blocks

START, END = "<|im_start|>", "<|im_end|>"
_RESETS = ("edit", "regenerate")


def events_of_turns(rows: DataFrame) -> DataFrame:
    """A table of finished messages (conv_id, turn, role, text) as the event log of how they came about.

    An assistant's message was drafted, regenerated, and streamed in two deltas;
    another one was drafted and then edited.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("turn"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    step = lambda event, text: F.struct(F.lit(event).alias("event"), text.alias("text"))
    draft, text = F.lit("draft"), F.col("text")
    log = F.when(F.col("role") == "assistant", F.array(step("delta", draft), step("regenerate", F.lit(None).cast("string")), step("delta", F.left("text", half)), step("delta", F.substr(text, half + 1)))).otherwise(
        F.array(step("delta", draft), step("edit", text))
    )
    return numbered.select("conv_id", "turn", "role", F.posexplode(log).alias("at", "e")).select("conv_id", (F.col("turn") * 4 + F.col("at")).alias("seq"), "e.event", "turn", "role", "e.text")


def final_messages(events: DataFrame) -> DataFrame:
    """Fold a log (conv_id, seq, event, turn, role, text) into messages (conv_id, turn, role, text)."""
    # what comes after an event is what comes before it in the other direction, where the minimum runs along
    after = Window.partitionBy("conv_id").orderBy(*[F.col(c).desc() for c in ("seq", "turn", "role", "text")]).rowsBetween(Window.unboundedPreceding, -1)
    reset = F.when(F.col("event").isin(*_RESETS), F.col("turn"))
    alive = events.withColumn("_cut", F.min(reset).over(after)).where(F.col("_cut").isNull() | (F.col("_cut") > F.col("turn")))
    part = F.struct("seq", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    folded = alive.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return folded.select("conv_id", "turn", F.element_at("_parts", -1)["role"].alias("role"), F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def render(messages: DataFrame) -> DataFrame:
    """Segments (conv_id, turn, segment, loss_start, loss_end); the two are null where nothing is learnt."""
    role = F.replace(F.replace(escape_text(F.col("role")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = escape_text(F.col("text"))
    learnt = F.col("role") == "assistant"
    start = F.char_length("_head")
    return (
        messages.withColumn("_head", head).withColumn("_body", body)
        .select(
            "conv_id", "turn", F.concat("_head", "_body", F.lit(END + "\n")).alias("segment"),
            F.when(learnt, start).alias("loss_start"), F.when(learnt, start + F.char_length("_body")).alias("loss_end"),
        )
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Segments of every conversation of an event log, to be put together by turn."""
    return render(final_messages(events))


def unescape_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape_text(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment; an error if it isn't exactly one message."""
    if not segment.startswith(START) or not segment.endswith(END + "\n"):
        raise ValueError("not a segment")
    role, _, text = segment[len(START) : -len(END) - 1].partition("\n")
    if "<|" in role or "<|" in text:
        raise ValueError("a control string inside a message")
    return unescape_role(role), unescape_text(text)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations come one after another; their hashes take segments as they come, so none is held whole."""

    def rows():
        for part in blocks(batches, 1, 1 << 20):
            yield from zip(*(c.to_pylist() for c in part.columns))

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out: list[tuple] = []
    for conv, segments in groupby(rows(), key=lambda r: r[0]):
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = size = 0
        for _, segment, a, b in segments:
            role, text = read_segment(segment)
            turns.update(f"{role}\n{text}\n".encode())
            n, size = n + 1, size + len(segment)
            if a is not None:
                learnt = unescape_text(segment[a:b])
                loss.update(learnt.encode())
                chars += len(learnt)
        out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))
        if len(out) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], names)


def read_back(segments: DataFrame) -> DataFrame:
    """What each conversation's formatted text says when it is parsed again."""
    ordered = segments.select(F.col("conv_id").cast("long").alias("conv_id"), "segment", "loss_start", "loss_end", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn").drop("turn")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
