"""Books of order events that come out of order.

Events: ``topic, order_id, seq, ts, price, size, side``; ``seq`` is the order of
arrival. One with price, size and side creates an order, one with size alone
changes it, one without deletes it. An event is judged as it arrives:

* more than ``late`` behind its topic's clock, the latest time of the topic's
  events that arrived before it: ``late``;
* by what is known of its order: see ``RULES``. Changes and deletions of a live
  order count if they are newer than the last event that counted, and are
  ``outdated`` otherwise; a deletion of an unknown order marks it as gone;
* a deleted order is remembered until the clock is ``forget`` ahead of its
  deletion, and is unknown again from then on.

Every event yields one row with its outcome.

A snapshot says which orders of a topic there are at about its time. It arrives
as rows of one ``seq`` whose ``snapshot`` is true: one for each order, and one
without order id, so that an empty snapshot is one too. Snapshots that are no
newer than one before them are ignored. An order that two snapshots in a row
list, and that is not known, not even as gone, was ``missed`` and lives from then
on; a live one that a snapshot lacks, and that nothing has touched for ``linger``,
is ``lingering`` and gone. Each correction yields a row of event ``snapshot``.

The clock is a running maximum, so
it is set ahead, for all orders of a topic at once, in buckets of arrival
(``clocked``). What is left depends on one order alone: the stateful operator is
keyed by topic and a share of its orders, so a hot book is many tasks, and reads
the state of those orders only that have events. Crossing orders are not
matched here; see ``operators.book.match_orders``. For snapshots of a table see
``operators.book.reconciled``.

Deleted orders are forgotten by their topic's clock, not by the watermark of the
whole stream, by which a timer would go: each batch tells all shares of its
topics what the clock has come to, so that a share without events is swept too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.columns import UNIT_MICROS, micros
from tidemark.operators.running import with_running
from tidemark.sources.shared import shared_path

#: Defaults, in microseconds.
LATE, FORGET, LINGER = UNIT_MICROS["m"], 2 * UNIT_MICROS["m"], 10 * UNIT_MICROS["s"]
#: Shares of a topic's orders; a checkpoint is bound to their number.
SHARES = 64
#: Numbers of ``seq`` in one bucket of the running clock.
BUCKET = 1 << 16

OUTCOMES = "topic int, order_id long, seq long, ts timestamp, event string, outcome string"

#: Outcome of an event, by what is known of its order, and the order's state after it if it counts.
RULES = {
    ("unknown", "create"): ("accepted", "active"),
    ("unknown", "change"): ("unknown order", None),
    ("unknown", "delete"): ("unknown order", "removed"),
    ("active", "create"): ("already active", None),
    ("active", "change"): ("accepted", "active"),
    ("active", "delete"): ("accepted", "removed"),
    ("removed", "create"): ("already removed", None),
    ("removed", "change"): ("already removed", None),
    ("removed", "delete"): ("already removed", None),
}


def judged(known: tuple[int, bool] | None, event: str, ts: int, clock: int | None, late: int, forget: int) -> tuple[str, tuple[int, bool] | None]:
    """(outcome, what is known after it) of an event; known: time of the last event that counted, and whether the order lives."""
    if clock is not None and ts < clock - late:
        return "late", known
    if known and not known[1] and clock is not None and known[0] < clock - forget:
        known = None
    state = "unknown" if known is None else "active" if known[1] else "removed"
    outcome, after = RULES[state, event]
    if state == "active" and after and ts <= known[0]:
        return "outdated", known
    return outcome, known if after is None else (ts, after == "active")


def with_clock(events: DataFrame, before: DataFrame | None = None, width: int = BUCKET) -> DataFrame:
    """Events with ``clock``, the latest time (micros) of their topic's earlier arrivals, null for none.

    ``before(topic, clock)``: clocks that earlier events left.
    """
    bucket = F.floor(F.col("seq") / F.lit(width))
    out = with_running(events, ["topic"], ["seq"], {"clock": ("max", micros("ts"))}, bucket, include_current=False)
    if before is None:
        return out
    # a row a topic
    known = before.select(F.col("topic").alias("__topic"), F.col("clock").alias("__clock"))
    return out.join(known, F.col("topic") == F.col("__topic"), "left").withColumn("clock", F.greatest("clock", "__clock")).drop("__topic", "__clock")


def dealt(events: DataFrame) -> DataFrame:
    """Events with the ``share`` of their order; one without order goes to all shares of its topic."""
    own = F.array(F.pmod(F.xxhash64("order_id"), F.lit(SHARES)).cast("int"))
    return events.withColumn("share", F.explode(F.when(F.col("order_id").isNull(), F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(own)))


def clocked(events: DataFrame, folder: str, checkpoint: str, width: int = BUCKET) -> None:
    """Append all events there are now, with their clocks and shares, to a table; the topics' clocks are kept beside it.

    A batch writes folders of its own, over those of a run that was cut short.
    Batches must arrive in the order of ``seq``.
    """
    spark = events.sparkSession

    def clocks(batch_id: int) -> str:
        return f"{folder}-clocks/batch={batch_id}"

    def write(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(clocks(batch_id - 1)) if batch_id else None
        now = batch.groupBy("topic").agg(F.max(micros("ts")).alias("clock"))
        # a row without order a topic, after all others: what the clock has come to
        told = batch.groupBy("topic").agg(F.max("seq").alias("seq"), F.max("ts").alias("ts"), F.max(micros("ts")).alias("clock"))
        rows = dealt(with_clock(batch, before, width).unionByName(told, allowMissingColumns=True))
        # a share is one file, so that no order's events of a batch are read apart
        rows.repartition("topic", "share").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        both = now if before is None else now.unionByName(before).groupBy("topic").agg(F.max("clock").alias("clock"))
        both.write.mode("overwrite").parquet(clocks(batch_id))

    events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


class OrdersProcessor(StatefulProcessor):
    """The orders of one share of a topic: those that live and those that are gone, each with its time, and those that
    the last snapshot listed though they are not known."""

    def __init__(self, late: int, forget: int, linger: int):
        self.late, self.forget, self.linger = late, forget, linger

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = {alive: handle.getMapState(name, "id long", "ts long") for alive, name in ((True, "alive"), (False, "gone"))}
        self.suspects = handle.getMapState("suspects", "id long", "ts long")
        self.snapshot = handle.getValueState("snapshot", "ts long")
        self.swept = handle.getValueState("swept", "clock long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows))
        got = got.assign(rank=got["event"].map({"listed": 1, "tick": 2}).fillna(0)).sort_values(["seq", "rank"], kind="stable")
        times = got["ts"].astype("datetime64[us]").astype("int64").tolist()
        clocks = [None if c != c else int(c) for c in got["clock"]]
        found = list(zip(got["order_id"], got["seq"].tolist(), times, clocks, got["event"], strict=True))
        # a snapshot concerns all orders of the share
        known: dict[int, tuple[int, bool] | None] = self.everything() if "header" in set(got["event"]) else {}
        out = []
        for i, (order_id, seq, ts, clock, event) in enumerate(found):
            if event == "header":
                listed = {int(x[0]) for x in found[i + 1 :] if x[1] == seq and x[4] == "listed"}
                out += [(x, seq, ts, "snapshot", why) for x, why in self.reconcile(known, listed, ts, clock)]
            elif event not in ("listed", "tick"):
                order_id = int(order_id)
                if order_id not in known:
                    known[order_id] = self.stored(order_id)
                outcome, known[order_id] = judged(known[order_id], event, ts, clock, self.late, self.forget)
                out.append((order_id, seq, ts, event, outcome))
        for order_id, state in known.items():
            self.store(order_id, state)
        self.sweep(max((c for c in clocks if c is not None), default=0))
        done = pd.DataFrame(out, columns=["order_id", "seq", "ts", "event", "outcome"])
        done["ts"] = pd.to_datetime(done["ts"], unit="us")
        done.insert(0, "topic", key[0])
        yield done

    def reconcile(self, known: dict, listed: set[int], ts: int, clock: int | None) -> list[tuple[int, str]]:
        """What a snapshot corrects; ``known`` holds all orders of the share."""
        if self.snapshot.exists() and ts <= self.snapshot.get()[0]:
            return []
        self.snapshot.update((ts,))
        forgotten = lambda x: x is None or (not x[1] and clock is not None and x[0] < clock - self.forget)
        missing = {i for i in listed if forgotten(known.get(i))}
        before = {k[0] for k, _ in self.suspects.iterator()}
        missed = sorted(missing & before)
        lingering = sorted(i for i, x in known.items() if x and x[1] and i not in listed and x[0] <= ts - self.linger)
        for i in before - missing:
            self.suspects.removeKey((i,))
        for i in missing - before:
            self.suspects.updateValue((i,), (ts,))
        known.update({i: (ts, True) for i in missed} | {i: (ts, False) for i in lingering})
        return [(i, "missed") for i in missed] + [(i, "lingering") for i in lingering]

    def everything(self) -> dict[int, tuple[int, bool] | None]:
        return {k[0]: (v[0], alive) for alive, states in self.maps.items() for k, v in states.iterator()}

    def stored(self, order_id: int) -> tuple[int, bool] | None:
        for alive, states in self.maps.items():
            if states.containsKey((order_id,)):
                return states.getValue((order_id,))[0], alive
        return None

    def store(self, order_id: int, state: tuple[int, bool] | None) -> None:
        for alive, states in self.maps.items():
            if state is not None and state[1] == alive:
                states.updateValue((order_id,), (state[0],))
            else:
                states.removeKey((order_id,))

    def sweep(self, clock: int) -> None:
        """Drop deleted orders once the clock has gone on by the time that they are remembered."""
        last = self.swept.get()[0] if self.swept.exists() else 0
        if clock - last >= self.forget:
            for (order_id,), (ts,) in list(self.maps[False].iterator()):
                if ts < clock - self.forget:
                    self.maps[False].removeKey((order_id,))
            self.swept.update((clock,))

    def close(self) -> None:
        pass


def fuzzy_book(events: DataFrame, late: int = LATE, forget: int = FORGET, linger: int = LINGER) -> DataFrame:
    """Outcome of every event of a stream of ``clocked`` events, and what snapshots among them correct.

    Start it with the RocksDB state store (``streams.drained`` does).
    """
    listed = F.coalesce(F.col("snapshot"), F.lit(False)) if "snapshot" in events.columns else F.lit(False)
    event = (
        F.when(F.col("order_id").isNull(), F.when(listed, "header").otherwise("tick"))
        .when(listed, "listed")
        .when(F.col("size").isNull(), "delete")
        .when(F.col("price").isNull() | F.col("side").isNull(), "change")
        .otherwise("create")
    )
    keyed = events.select("topic", "share", "order_id", "seq", "ts", "clock", event.alias("event"))
    processor = OrdersProcessor(late, forget, linger)
    return keyed.groupBy("topic", "share").transformWithStateInPandas(processor, OUTCOMES, "Append", "None")


def in_arrival_order(events: DataFrame, files: int) -> str:
    """Events of a table as so many files, each of a range of ``seq``, one written after the other, for a stream to read."""
    folder = shared_path(events.sparkSession, "arrivals")
    ends = events.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    step = max(1, -(-(ends.hi - ends.lo + 1) // files)) if ends.lo is not None else 1
    for k in range(files):
        lo = (ends.lo or 0) + k * step
        events.where((F.col("seq") >= lo) & (F.col("seq") < lo + step)).coalesce(1).write.parquet(f"{folder}/part={k}")
    return folder
