"""State of bots and sessions from their event logs, as tables and as streams."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.columns import micros
from tidemark.streaming.streams import with_event_time


def liveness(beats: DataFrame, now: dt.datetime) -> DataFrame:
    """``(bot, last_ts, expired)``: expired if the last heartbeat and the time to live that it gave are past; 0 never
    expires. Of heartbeats of one time the longest to live counts."""
    last = beats.groupBy("bot").agg(F.max("ts").alias("last_ts"), F.max_by("ttl_micros", F.struct("ts", "ttl_micros")).alias("__ttl"))
    over = (F.col("__ttl") > 0) & (micros("last_ts") + F.col("__ttl") < micros(F.lit(now)))
    return last.select("bot", "last_ts", over.alias("expired"))


class LivenessProcessor(StatefulProcessor):
    """One bot: its last heartbeat, how long that holds, whether the bot is alive, and the timer at which it is not."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, ttl long, alive boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        ts = got["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        ttl = got["ttl_micros"].fillna(0).astype("int64").to_numpy()
        before = self.last.get() if self.last.exists() else None
        if before is not None:  # late ones don't count
            ts, ttl = ts[ts > before[0]], ttl[ts > before[0]]
        if not len(ts):
            return
        order = np.lexsort((ttl, ts))
        order = order[np.append(ts[order][1:] != ts[order][:-1], True)]
        ts, ttl = ts[order], ttl[order]
        if before is not None:
            ts, ttl = np.append(before[0], ts), np.append(before[1], ttl)
        ends = ts[:-1] + ttl[:-1]
        lapsed = (ttl[:-1] > 0) & (ends < ts[1:])  # between heartbeats
        told = lapsed.copy()
        if before is not None:
            told[:1] &= bool(before[2])
            born = np.empty(0, np.int64)
        else:
            born = ts[:1]
        revived = ts[1:][lapsed]
        if before is not None and ttl[0] > 0:
            timer_at(self.handle.deleteTimer, before[0] + before[1], before[2])
        self.last.update((int(ts[-1]), int(ttl[-1]), True))
        if ttl[-1] > 0:
            timer_at(self.handle.registerTimer, ts[-1] + ttl[-1], True)
        yield changes(key[0], [*((t, "alive") for t in (*born, *revived)), *((t, "expired") for t in ends[told])])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, ttl, alive = self.last.get()
        if alive:
            self.last.update((ts, ttl, False))
            yield changes(key[0], [(ts + ttl, "expired")])

    def close(self) -> None:
        pass


def timer_at(change, at: int, there: bool) -> None:
    """Register or delete the timer of the first millisecond after ``at``."""
    if there:
        change(int(at) // 1000 + 1)


def changes(bot, found: list[tuple[int, str]]) -> pd.DataFrame:
    at = pd.to_datetime(pd.Series([t for t, _ in found], dtype="int64"), unit="us")
    bots, states = (pd.Series(x, dtype="object") for x in ([bot] * len(found), [state for _, state in found]))
    return pd.DataFrame({"bot": bots, "ts": at, "state": states})


def stream_liveness(beats: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``(bot, ts, state)`` as it happens: ``alive`` at a bot's first heartbeat and at the first one after it expired,
    ``expired`` once event time is past its last heartbeat and the time to live that that gave; 0 never expires.

    ``beats(bot, ts, ttl_micros)``: heartbeats may be late by ``delay``; one that is older than the last is passed over.
    What comes out does not depend on how the stream is cut into batches: between heartbeats of one batch a bot expires
    as it does by its timer. Start it with the RocksDB state store (``streams.drained`` does).
    """
    kind = beats.schema["bot"].dataType.simpleString()
    timed = with_event_time(beats.select("bot", "ts", "ttl_micros"), delay)
    return timed.groupBy("bot").transformWithStateInPandas(
        LivenessProcessor(), f"bot {kind}, ts timestamp, state string", "Append", "EventTime"
    )


def latest_state(log: DataFrame) -> DataFrame:
    """Last payload of each bot and kind (``bot, seq, kind, payload``); an ``expired`` event drops what was before it."""
    gone = log.where("kind = 'expired'").groupBy("bot").agg(F.max("seq").alias("__gone"))
    rows = log.where("kind <> 'expired'").join(gone, "bot", "left").where("__gone is null or seq > __gone")
    return rows.groupBy("bot", "kind").agg(F.max_by("payload", "seq").alias("payload"), F.max("seq").alias("seq"))
