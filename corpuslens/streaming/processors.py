"""Streams with state of their own: daily quotas and runs, in the order of events, not of their arrival.

Users' days, or runs, are dealt into buckets by hash. A bucket is one group of a
state processor: its open rows are one small table, kept as Arrow bytes, and it has
one timer in event time, at the next time that something of it falls due. A batch
reads and writes a bucket once, whatever the number of days or runs that it touches.
A decision is sent once the watermark says that no earlier event may come, so
deliveries in any order, as far as the delay reaches, give the rows of the batch
form. State processors need the RocksDB state store, which is set for the session
that starts the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpuslens.operators.usage import run_event_fields

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of a stream, chosen when it is first started: the open rows of one must fit a task.
BUCKETS = 512


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


def _millis(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def _bucket(buckets: int, *columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int").alias("bucket")


class _Processor(StatefulProcessor):
    """Tables of a bucket by name, and its one timer."""

    SCHEMAS: dict[str, pa.Schema]

    def init(self, handle) -> None:
        self.handle = handle
        self.tables = {name: handle.getValueState(name, "rows binary") for name in self.SCHEMAS}

    def close(self) -> None:
        pass

    def load(self, name: str) -> pd.DataFrame:
        held = self.tables[name].get()
        return (self.SCHEMAS[name].empty_table() if held is None else pa.ipc.open_stream(bytes(held[0])).read_all()).to_pandas()

    def store(self, name: str, frame: pd.DataFrame) -> None:
        if not len(frame):
            self.tables[name].clear()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.SCHEMAS[name]) as out:
            out.write_table(pa.Table.from_pandas(frame, self.SCHEMAS[name], preserve_index=False))
        self.tables[name].update((sink.getvalue().to_pybytes(),))

    def add(self, name: str, table: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        new = frame[self.SCHEMAS[name].names]
        return pd.concat([table, new], ignore_index=True) if len(table) else new.reset_index(drop=True)

    def set_timer(self, due: int | None) -> None:
        """This timer in place of the one before."""
        held = list(self.handle.listTimers())
        for old in held:
            if old != due:
                self.handle.deleteTimer(old)
        if due is not None and due not in held:
            self.handle.registerTimer(due)


class DailyQuota(_Processor):
    """Of each user's local day: the ``limit + 1`` earliest requests, which settle both edges, and whether they were sent."""

    SCHEMAS = {"least": pa.schema([("who", pa.string()), ("local_day", pa.string()), ("closes", pa.int64()), ("at", pa.int64()), ("event_id", pa.int64()), ("sent", pa.bool_())])}

    def __init__(self, limit: int, slack: str):
        self.limit, self.slack = limit, _millis(slack)

    def _ordered(self, table: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
        """The earliest requests of each day in order, and their place."""
        table = table.sort_values(["who", "local_day", "at", "event_id"], ignore_index=True)
        n = table.groupby(["who", "local_day"], dropna=False, sort=False).cumcount() + 1
        near = n <= self.limit + 1
        return table[near], n[near]

    def _keep(self, table: pd.DataFrame, n: pd.Series) -> None:
        open_ = table["at"][((n == 1) | (n == self.limit + 1)) & ~table["sent"]] // 1000 + 1
        due = [int(x.min()) for x in (open_, table["closes"] + self.slack) if len(x)]
        self.store("least", table)
        self.set_timer(min(due) if due else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = self.load("least")
        for frame in rows:  # few rows are kept of each
            table, n = self._ordered(self.add("least", table, frame.assign(sent=False)))
        self._keep(table, n)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        table, n = self._ordered(self.load("least"))
        due = ((n == 1) | (n == self.limit + 1)) & ~table["sent"] & (table["at"] // 1000 < now)
        told = table[due].assign(n=n[due], edge=np.where(n[due] == 1, "first", "over"))[["who", "local_day", "event_id", "n", "edge"]]
        left = table["closes"] + self.slack > now
        self._keep(table.assign(sent=table["sent"] | due)[left], n[left])
        return iter([told] if len(told) else [])


def daily_quota(events: DataFrame, tz: str, limit: int, delay: str = "1 hour", slack: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Edges of daily quotas, each once: ``first`` and ``over``, sent when no earlier request may come (``delay``).

    A day's state ends ``slack`` after the local day does. Other roles than ``user``
    are exempt; a limit of nought or less is off.
    """
    use_state_store(events.sparkSession)
    ordinary = events.where((F.col("role") == "user") & F.lit(limit > 0)).withWatermark("ts", delay)
    day = F.to_date(F.from_utc_timestamp("ts", tz))
    closes = F.unix_millis(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), tz))
    keyed = ordinary.select(
        F.col("user_id").cast("string").alias("who"), F.date_format(day, "yyyy-MM-dd").alias("local_day"), closes.alias("closes"), F.unix_micros("ts").alias("at"), "event_id", "ts",
    )
    schema = "who string, local_day string, event_id long, n long, edge string"
    told = keyed.withColumn("bucket", _bucket(buckets, "who", "local_day")).groupBy("bucket").transformWithStateInPandas(DailyQuota(limit, slack), schema, "append", "EventTime")
    return told.select(F.col("who").cast("long").alias("user_id"), "local_day", "event_id", "n", "edge")


RUN = (
    "answer string, n_tokens long, node_durations array<struct<node:string,ms:bigint>>, chunks_hit string, chunks_rerank string, chunks_expanded string, "
    "citations string, confidence double, terminal string, error string"
)
_LISTS = ("chunks_hit", "chunks_rerank", "chunks_expanded")
_TERMINAL = ("final", "cancelled", "error")


class RunFold(_Processor):
    """Of each run: its tokens counted, the newest event (by seq) of each kind that matters, and its nodes' durations; and which runs were sent, and when."""

    SCHEMAS = {
        "open": pa.schema([
            ("run_id", pa.string()), ("event", pa.string()), ("seq", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("node", pa.string()), ("ms", pa.int64()), ("value", pa.string()),
            ("citations", pa.string()), ("confidence", pa.float64()),
        ]),
        "sent": pa.schema([("run_id", pa.string()), ("at", pa.int64())]),
    }

    def __init__(self, silence: str, memory: str):
        self.silence, self.memory = _millis(silence), _millis(memory)

    def _folded(self, table: pd.DataFrame) -> pd.DataFrame:
        """The durations, and one row of each run and other kind of event: the newest, with their number and last time."""
        node = table["event"] == "node_end"
        rest = table[~node].sort_values("seq", kind="stable")
        of = rest.groupby(["run_id", "event"], dropna=False, sort=False)
        rest = rest.assign(n=of["n"].transform("sum"), last=of["last"].transform("max")).drop_duplicates(["run_id", "event"], keep="last")
        return pd.concat([table[node], rest], ignore_index=True)

    def _close(self, table: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Rows of runs that are due, and the table without them."""
        code, runs = pd.factorize(table["run_id"], use_na_sentinel=False)
        due = self._due(table, code, len(runs)) <= now
        out, left = table[due[code]], table[~due[code]]
        if not len(out):
            return out, table
        code, runs = pd.factorize(out["run_id"], use_na_sentinel=False)

        def pick(event: str, column: str = "value") -> np.ndarray:
            values, at = np.full(len(runs), None, object), (out["event"] == event).to_numpy()
            values[code[at]] = out[column].to_numpy(object)[at]
            return values

        nodes: list[list[dict]] = [[] for _ in runs]
        durations = out.assign(code=code)[out["event"] == "node_end"].sort_values(["code", "seq", "node", "ms"])
        for at, node, ms in zip(durations["code"], durations["node"], durations["ms"]):
            nodes[at].append({"node": node, "ms": ms})
        terminal = np.where(pick("end") != None, "end", "incomplete").astype(object)  # noqa: E711
        ends = out.assign(code=code)[out["event"].isin(_TERMINAL)].sort_values("seq", kind="stable").drop_duplicates("code", keep="last")
        terminal[ends["code"]] = ends["event"]
        confidence = [0.0 if x is None or x != x else x for x in pick("final", "confidence")]
        return pd.DataFrame({
            "run_id": pd.Series(runs, dtype=object), "answer": [x or "" for x in pick("final")], "n_tokens": [x or 0 for x in pick("token", "n")], "node_durations": pd.Series(nodes, dtype=object),
            **{kind: pick(kind) for kind in _LISTS}, "citations": pick("final", "citations"), "confidence": confidence, "terminal": terminal, "error": pick("error"),
        }), left

    def _due(self, table: pd.DataFrame, code: np.ndarray, n: int) -> np.ndarray:
        """When each run is to be sent, if nothing more comes."""
        last, ended = np.full(n, -(1 << 62), np.int64), np.zeros(n, bool)
        np.maximum.at(last, code, table["last"].to_numpy())
        ended[code[table["event"].isin(_TERMINAL).to_numpy()]] = True
        return last + 1 + np.where(ended, 0, self.silence)

    def _keep(self, table: pd.DataFrame, sent: pd.DataFrame, told: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        """Keep what is open and which runs were sent, ``told`` among them, and send those."""
        if len(told):
            sent = self.add("sent", sent, told[["run_id"]].assign(at=now))
        self.store("open", table)
        self.store("sent", sent)
        code, runs = pd.factorize(table["run_id"], use_na_sentinel=False)
        due = [int(x.min()) for x in (self._due(table, code, len(runs)), sent["at"] + self.memory) if len(x)]
        self.set_timer(max(min(due), now + 1) if due else None)
        return iter([told] if len(told) else [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, sent = timerValues.getCurrentWatermarkInMs(), self.load("sent")
        told, table = self._close(self.load("open"), now)  # runs that ended before this batch, whose rows come before its timers
        over = set(sent["run_id"]) | set(told["run_id"])
        for frame in rows:
            table = self._folded(self.add("open", table, frame[~frame["run_id"].isin(over)]))  # a run may go on after its row was sent
        return self._keep(table, sent, told, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, sent = timerValues.getCurrentWatermarkInMs(), self.load("sent")
        told, table = self._close(self.load("open"), now)
        return self._keep(table, sent[sent["at"] + self.memory > now], told, now)


def fold_run_events(events: DataFrame, delay: str = "5 minutes", silence: str = "30 minutes", memory: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Runs (run_id, seq, event, data, ts) folded as by the batch form, each sent once.

    A run is sent when its terminal event has come and the watermark (``delay``) has
    passed its last event, or when it has been silent for ``silence`` more. What it
    still says in the time of ``memory`` after that is passed over.
    """
    use_state_store(events.sparkSession)
    fields = run_event_fields(events.withWatermark("ts", delay))
    ev, timed = F.col("event"), F.col("node").isNotNull() & F.col("ms").isNotNull()
    kind = F.when((ev == "node_end") & timed, ev).when(ev.isin("token", "end", *_LISTS, *_TERMINAL), ev).otherwise("")
    value = F.when(ev.isin(*_LISTS), F.col("chunks")).when(ev == "final", F.col("answer")).when(ev == "error", F.col("data")).when(ev == "end", "")
    rows = fields.select(
        F.col("run_id").cast("string").alias("run_id"), kind.alias("event"), F.col("seq").cast("long").alias("seq"), F.lit(1).cast("long").alias("n"), F.unix_millis("ts").alias("last"),
        F.when(timed, F.col("node")).alias("node"), F.coalesce("ms", F.lit(0)).cast("long").alias("ms"), value.alias("value"), "citations", "confidence", "ts", _bucket(buckets, "run_id"),
    )
    told = rows.groupBy("bucket").transformWithStateInPandas(RunFold(silence, memory), f"run_id string, {RUN}", "append", "EventTime")
    return told.withColumn("run_id", F.col("run_id").cast(events.schema["run_id"].dataType))
