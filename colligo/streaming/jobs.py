"""Structured Streaming forms of the stateful operators; each has a batch twin in operators.

Streams keep their state in typed variables of the RocksDB store: lists, values
with a time to live, timers in event time. A stream that starts anew takes its
state from a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colligo.operators.quota import kept_after_cooldown, quota_labels
from colligo.sources.tables import UpsertTable

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one and the state store that typed state needs; this one's own settings stay as they are."""
    own = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            own.conf.set(k, v)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return own


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder, or over a single file (as a pattern, which file streams take as well)."""
    schema = spark.read.parquet(path).schema
    return stream_session(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


class _Quota(StatefulProcessor):
    """Labels every request of a service by the ones in the seconds before it, which a list state holds until a timer lets them go."""

    def __init__(self, seconds: int, most_requests: int, most_tokens: int) -> None:
        self.micros, self.most_requests, self.most_tokens = seconds * 1_000_000, most_requests, most_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trail = handle.getListState("trail", "at long, tokens long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        held = sorted((int(a), int(n)) for a, n in self.trail.get())
        at = np.array([a for a, _ in held] + new["at"].tolist(), dtype=np.int64)
        tokens = np.array([n for _, n in held] + new["tokens"].tolist(), dtype=np.int64)
        order = np.argsort(at, kind="stable")
        at, tokens = at[order], tokens[order]
        own = new["at"].to_numpy(dtype=np.int64)
        # Requests of the same instant are not before each other.
        first, last = np.searchsorted(at, own - self.micros), np.searchsorted(at, own)
        sums = np.r_[0, np.cumsum(tokens)]
        n, used = last - first, sums[last] - sums[first]
        label = quota_labels(n, used, new["tokens"].to_numpy(), self.most_requests, self.most_tokens)
        yield pd.DataFrame({"service": key[0], "event_id": new["event_id"].to_numpy(), "n": n, "used": used, "label": label})
        # Rows may come as late as the watermark allows: what is a trail's length behind it can be in no window any more.
        self._keep(list(zip(at.tolist(), tokens.tolist(), strict=True)), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._keep([(int(a), int(n)) for a, n in self.trail.get()], timerValues.getCurrentWatermarkInMs())
        return iter(())

    def _keep(self, rows: list[tuple[int, int]], watermark: int) -> None:
        kept = [r for r in rows if r[0] >= watermark * 1000 - self.micros]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if kept:
            self.trail.put(kept)
            self.handle.registerTimer(max(a for a, _ in kept) // 1000 + self.micros // 1000 + 1)
        else:
            self.trail.clear()

    def close(self) -> None:
        pass


def quota_stream(requests: DataFrame, seconds: int = 60, most_requests: int = 15, most_tokens: int = 10_000_000, late: str = "0 seconds") -> DataFrame:
    """rolling_quota for a stream of requests (service, event_id, ts, tokens): every request gets the label of the batch form.

    The state of a service is its trailing window. Requests must come in order of
    time but for `late`; a later one is counted against the requests that came
    before it, not counted again into labels that are out already. Needs the
    RocksDB state store.
    """
    timed = requests.withColumn("stamp", F.col("ts").cast("timestamp")).withWatermark("stamp", late)
    rows = timed.select("service", "event_id", "tokens", "stamp", F.unix_micros("stamp").alias("at"))
    return rows.groupBy("service").transformWithStateInPandas(_Quota(seconds, most_requests, most_tokens), "service string, event_id long, n long, used long, label string", "Append", "EventTime")


class _Cooldown(StatefulProcessor):
    """Sends a notification unless its key sent one within the cooldown; the state is when that was."""

    def __init__(self, seconds: int, ttl_ms: int | None) -> None:
        self.seconds, self.ttl_ms = seconds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", self.ttl_ms)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.last.update((max(int(initialState["at"].max()), self.last.get()[0] if self.last.exists() else -(2**63)),))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Keys are many and short: plain arrays, and one question to the state.
        frames = list(rows)
        at, ids = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("at", "event_id"))
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        last = self.last.get()
        kept = np.array(kept_after_cooldown(at.tolist(), self.seconds, None if last is None else int(last[0])), dtype=bool)
        if not kept.any():
            return
        at, ids = at[kept], ids[kept]
        self.last.update((int(at[-1]),))
        yield pd.DataFrame({"event_id": ids, "level": key[0], "title": key[1], "at": at})

    def close(self) -> None:
        pass


def cooldown_stream(rows: DataFrame, seconds: int = 60, sent: DataFrame | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """Sent notifications (event_id, level, title, at in microseconds).

    sent: those that an earlier stream sent (level, title, at), which a new one goes
    on from. ttl_seconds: how long in processing time a key's state stays after its
    last notification; take it far above the cooldown, as a stream that stands
    still for longer forgets what it sent. Without it, state stays for ever. A stream
    with a time to live never runs out of batches: trigger it by time, or once.
    """
    timed = rows.select("event_id", "level", "title", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    known = None
    if sent is not None:
        # Read in the stream's own session, one row a key.
        known = sent.groupBy("level", "title").agg(F.max("at").alias("at")).groupBy("level", "title")
    processor = _Cooldown(seconds, ttl_seconds and ttl_seconds * 1000)
    return timed.groupBy("level", "title").transformWithStateInPandas(processor, "event_id long, level string, title long, at long", "Append", "ProcessingTime" if ttl_seconds else "None", initialState=known)


class _Expiry(StatefulProcessor):
    """Keeps the newest answer of a key and lets it go by a timer in event time."""

    def __init__(self, days: int) -> None:
        self.ms = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long, event_id long")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._keep(max(zip(initialState["at"].tolist(), initialState["event_id"].tolist(), strict=True)), timerValues)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self._keep(max(max(zip(pdf["at"].tolist(), pdf["event_id"].tolist(), strict=True)) for pdf in rows if len(pdf)), timerValues)
        return iter(())

    def _keep(self, new: tuple[int, int], timerValues: Any) -> None:
        old = tuple(self.newest.get()) if self.newest.exists() else None
        if old is not None and old >= new:
            return
        if old is not None:
            self.handle.deleteTimer(self._due(old))
        self.newest.update(new)
        self.handle.registerTimer(self._due(new))

    def _due(self, row: tuple[int, int]) -> int:
        return int(row[0]) // 1000 + self.ms

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.newest.exists():
            return
        at, event_id = self.newest.get()
        self.newest.clear()
        yield pd.DataFrame({"service": [key[0]], "query_key": [key[1]], "event_id": [event_id]})

    def close(self) -> None:
        pass


def cache_stream(answers: DataFrame, days: int = 30, late: str = "1 day", kept: DataFrame | None = None) -> DataFrame:
    """Expiries (service, query_key, event_id) of cached answers: the newest answer of a key leaves after the TTL in event time.

    kept: answers that are in the cache already (service, query_key, event_id, fetched_at).
    """
    timed = answers.withColumn("stamp", F.col("fetched_at").cast("timestamp")).withWatermark("stamp", late).withColumn("at", F.unix_micros("stamp"))
    known = None
    if kept is not None:
        known = kept.select("service", "query_key", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("at"), "event_id").groupBy("service", "query_key")
    return timed.groupBy("service", "query_key").transformWithStateInPandas(_Expiry(days), "service string, query_key string, event_id long", "Append", "EventTime", initialState=known)


def ledger_stream(results: DataFrame, table: UpsertTable, checkpoint: str, keep: int = 2) -> None:
    """Upsert a stream of results into an UpsertTable: a micro-batch is a version, copies the buckets it touches and may be run again."""

    def add(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number)
        table.vacuum(keep)

    results.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> DataFrame:
    """Run an append-mode stream over all that is there, in one batch if once, into Parquet files, and read them."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**({"once": True} if once else {"availableNow": True})).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
