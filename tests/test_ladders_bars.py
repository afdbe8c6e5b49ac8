"""Ladders at ticks and anchored bars against the same rows taken one at a time."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, book

T0 = dt.datetime(2024, 1, 1)
EVENTS = "topic int, seq long, order_id long, kind string, side string, price double, size double"


def draw(rnd, n, topics=2):
    out = []
    for seq in range(n):
        kind = rnd.choice(["open", "open", "change", "done", "received"])
        opens = kind == "open"
        size = rnd.choice([1.0, 2.0, 0.25, 0.1]) if kind in ("open", "change") else None
        out.append((rnd.randrange(topics), seq, rnd.randrange(25), kind, rnd.choice(["bid", "ask"]) if opens else None, float(rnd.randint(1, 12)) if opens else None, size))
    return out


def ladders(events, ticks, depth):
    """Of each (topic, tick) the rows of its ladder, from orders taken one event at a time."""
    out = {}
    for topic, tick in ticks:
        orders = {}
        for t, seq, order, kind, side, price, size in events:
            if t != topic or seq > tick:
                continue
            if kind == "open":
                orders[order] = (side, price, size)
            elif kind == "change" and order in orders:
                orders[order] = (*orders[order][:2], size)
            elif kind == "done":
                orders.pop(order, None)
        for side, way in (("ask", 1), ("bid", -1)):
            sums = {}
            for s, price, size in orders.values():
                if s == side:
                    sums[price] = sums.get(price, 0.0) + size
            for level, price in enumerate(sorted(sums, key=lambda p: way * p)[:depth]):
                out[topic, tick, side, level] = (price, sums[price])
    return out


@pytest.mark.parametrize(("seed", "together", "depth"), [(1, 1, 3), (2, 3, 2), (3, 64, 20)])
def test_ladders_at_ticks(spark, seed, together, depth):
    rnd = random.Random(seed)
    events = draw(rnd, 500)
    ticks = sorted({(rnd.randrange(3), rnd.randrange(-5, 520)) for _ in range(40)})
    frame, points = spark.createDataFrame(events, EVENTS).repartition(3), spark.createDataFrame(ticks * 2, "topic int, seq long")
    got = {(r.topic, r.seq, r.side, r.level): (r.price, pytest.approx(r.qty)) for r in book.ladder_at(frame, points, ["topic"], depth, together).collect()}
    assert got == ladders(events, ticks, depth)


def test_orders_that_never_end_are_two_rows_of_change_at_most(spark):
    events = [(0, i, i, "open", "bid", float(i % 5), 1.0) for i in range(400)]
    frame = spark.createDataFrame(events, EVENTS)
    assert book.level_changes(frame, ["topic"]).count() == 400
    got = book.ladder_at(frame, frame.select("topic", "seq"), ["topic"], 1).orderBy("seq").collect()
    assert [(r.price, r.qty) for r in got[4:]] == [(4.0, float((i + 1) // 5)) for i in range(4, 400)]


def test_ladders_of_nothing(spark):
    none = spark.createDataFrame([], EVENTS)
    ticks = spark.createDataFrame([(0, 3)], "topic int, seq long")
    some = spark.createDataFrame([(0, 9, 1, "open", "bid", 1.0, 1.0)], EVENTS)
    assert book.ladder_at(none, ticks, ["topic"], 3).count() == 0
    assert book.ladder_at(some, ticks, ["topic"], 3).count() == 0
    assert book.ladder_at(some, ticks.limit(0), ["topic"], 3).count() == 0


TICKS = "source string, topic string, datatype string, ts timestamp_ntz, seqid long, price double"


def folded(rows, step):
    out, series = [], {}
    for *path, ts, _, price in sorted(rows, key=lambda r: (str(r[:3]), r[3], r[4])):
        bar = series.get(tuple(path))
        if bar is None or ts > bar[3] + step:
            bar = series[tuple(path)] = [*path, ts, None, None, None, None]
            out.append(bar)
        if price is not None:
            bar[4:] = [price if bar[4] is None else bar[4], max(price, bar[5] or price), min(price, bar[6] or price), price]
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_anchored_bars_are_those_of_a_fold(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for topic, n, width in (("dense", 900, 3000), ("sparse", 80, 90_000), (None, 40, 2000), ("one", 1, 1)):
        at = sorted(rnd.randrange(width) for _ in range(n))
        rows += [("s", topic, "trades", T0 + dt.timedelta(seconds=t), i, rnd.choice([1.0, 2.0, 3.0, None])) for i, t in enumerate(at)]
    frame = spark.createDataFrame(rows, TICKS).repartition(3)
    got = bars.anchored_bars(frame, 60_000_000).collect()
    assert sorted(((r.source, r.topic, r.datatype, r.ts, r.open, r.high, r.low, r.close) for r in got), key=str) == folded(rows, dt.timedelta(minutes=1))


def test_a_series_without_pauses_is_many_tasks(spark):
    """A tick a second for a day: no pause ever cuts it; its rows meet in joins on time only."""
    n = 86_400
    frame = spark.range(n).select(
        F.lit("s").alias("source"), F.lit("t").alias("topic"), F.lit("trades").alias("datatype"),
        F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("ts"), F.col("id").alias("seqid"), F.col("id").cast("double").alias("price"),
    )
    got = bars.anchored_bars(frame, 90_000_000).orderBy("ts").collect()
    assert [(r.open, r.low, r.high, r.close) for r in got] == [(float(a), float(a), float(min(a + 90, n - 1)), float(min(a + 90, n - 1))) for a in range(0, n, 91)]
