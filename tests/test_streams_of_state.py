"""Books with snapshots and bots that expire, as streams, against the same rows taken one at a time."""

import datetime as dt
import random

import pandas as pd
import pytest

from tidemark.streaming import fuzzy, streams
from tidemark.streaming.state import liveness, stream_liveness

T0 = dt.datetime(2024, 1, 1)
S = 1_000_000
BASE = int((T0 - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))


def play(rows):
    """Outcomes of one topic's rows (seq, order or set of orders, micros, event), in order of arrival."""
    known, suspects, last, clock, out = {}, set(), None, None, []
    for seq, what, ts, event in rows:
        if event == "snapshot":
            if last is None or ts > last:
                last = ts
                unknown = {i for i in what if i not in known or (not known[i][1] and clock is not None and known[i][0] < clock - fuzzy.FORGET)}
                for i in sorted(unknown & suspects):
                    known[i] = (ts, True)
                    out.append((seq, i, "missed"))
                for i in sorted(i for i, (t, alive) in known.items() if alive and i not in what and t <= ts - fuzzy.LINGER):
                    known[i] = (ts, False)
                    out.append((seq, i, "lingering"))
                suspects = unknown
        else:
            outcome, state = fuzzy.judged(known.get(what), event, ts, clock, fuzzy.LATE, fuzzy.FORGET)
            out.append((seq, what, outcome))
            if state is None:
                known.pop(what, None)
            else:
                known[what] = state
        clock = ts if clock is None else max(clock, ts)
    return sorted(out)


ROWS = "topic int, order_id long, seq long, ts timestamp, price double, size double, side string, snapshot boolean"


@pytest.mark.parametrize("seed", range(2))
def test_snapshots_in_several_batches(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows, plain = [], {0: [], 1: []}
    for seq in range(900):
        topic, ts = seq % 2, seq * S // 2 + rnd.choice([0, -5, -90]) * S + BASE
        at = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=ts)
        if seq % 31 < 2:
            what = {rnd.randint(0, 60) for _ in range(rnd.choice([0, 10, 40]))}
            rows += [(topic, i, seq, at, None, None, None, True) for i in [None, *what]]
            plain[topic].append((seq, what, ts, "snapshot"))
        else:
            kind = rnd.random()
            event = "create" if kind < 0.4 else "change" if kind < 0.7 else "delete"
            values = (1.0, 2.0, "bid") if event == "create" else (None, 3.0, None) if event == "change" else (None, None, None)
            order = rnd.randint(0, 50)
            rows.append((topic, order, seq, at, *values, False))
            plain[topic].append((seq, order, ts, event))
    df = spark.createDataFrame(rows, ROWS)
    folder = fuzzy.in_arrival_order(df, 5)
    fuzzy.clocked(streams.stream_series(spark, folder, df.schema, each=1), str(tmp_path / "clocked"), str(tmp_path / "cp"), 50)
    whole = spark.read.parquet(str(tmp_path / "clocked" / "batch=0")).schema
    got = streams.drained(fuzzy.fuzzy_book(streams.stream_series(spark, str(tmp_path / "clocked"), whole, each=3))).collect()
    for topic in (0, 1):
        assert sorted((r.seq, r.order_id, r.outcome) for r in got if r.topic == topic) == play(plain[topic])
    assert {"missed", "lingering"} <= {r.outcome for r in got}


class Held(dict):
    """What the processor uses of a state variable, in memory."""

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        self.pop(k, None)

    def iterator(self):
        return iter(list(self.items()))

    def exists(self):
        return "x" in self

    def get(self):
        return self["x"]

    def update(self, v):
        self["x"] = v


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Held())

    getValueState = getMapState


def test_a_share_without_events_is_swept():
    p, handle = fuzzy.OrdersProcessor(fuzzy.LATE, fuzzy.FORGET, fuzzy.LINGER), Handle()
    p.init(handle)
    columns = ["order_id", "seq", "ts", "clock", "event"]
    at = lambda s: pd.Timestamp(T0) + pd.Timedelta(seconds=s)
    events = pd.DataFrame([(7.0, 1, at(0), None, "create"), (7.0, 2, at(1), BASE, "delete"), (8.0, 3, at(2), BASE + S, "create")], columns=columns)
    assert pd.concat(p.handleInputRows((0, 3), iter([events]), None)).outcome.tolist() == ["accepted"] * 3
    tick = lambda s: pd.DataFrame([(None, 9, at(s), BASE + s * S, "tick")], columns=columns)
    assert len(pd.concat(p.handleInputRows((0, 3), iter([tick(60)]), None))) == 0
    assert set(handle.states["gone"]) == {(7,)}
    list(p.handleInputRows((0, 3), iter([tick(130)]), None))
    assert set(handle.states["gone"]) == set() and set(handle.states["alive"]) == {(8,)}


BEATS = "bot string, ts timestamp, ttl_micros long"


def expiring(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(b, T0 + dt.timedelta(seconds=s), int(ttl * S)) for b, s, ttl in rows], BEATS)
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = streams.stream_series(spark, str(tmp_path / "in"), frame.schema, each=1)
    got = streams.drained(stream_liveness(stream)).collect()
    return sorted((r.bot, (r.ts - T0).total_seconds(), r.state) for r in got)


def test_a_heartbeat_holds_two_seconds(spark, tmp_path):
    """Alive at 2.5 seconds, as a heartbeat came at 1; gone at 3.5; each in a batch of its own."""
    got = expiring(spark, tmp_path, [[("a", 0, 2)], [("a", 1, 2)], [("clock", 2.5, 0)], [("clock", 3.5, 0)], [("a", 9, 2)], [("clock", 10, 0)]])
    assert got == [("a", 0.0, "alive"), ("a", 3.0, "expired"), ("a", 9.0, "alive"), ("clock", 2.5, "alive")]


def test_expiry_does_not_depend_on_batches(spark, tmp_path):
    rnd = random.Random(3)
    beats = sorted({(rnd.choice("abcd"), rnd.randint(0, 3000) / 10, rnd.choice([0, 1, 5, 20])) for _ in range(200)}, key=lambda b: b[1])
    beats = list({(b, s): (b, s, ttl) for b, s, ttl in beats}.values())
    want, now = [], beats[-1][1]
    for bot in "abcd":
        mine, alive, last = [x for x in beats if x[0] == bot], False, None
        for _, s, ttl in [*mine, (bot, now + 1e-9, None)]:
            if alive and last[1] and last[0] + last[1] < s:
                want.append((bot, pytest.approx(last[0] + last[1]), "expired"))
                alive = False
            if ttl is not None and not alive:
                want.append((bot, s, "alive"))
                alive = True
            last = (s, ttl)
    for i, cuts in enumerate(([0, 200], [0, 40, 41, 90, 150, 200])):
        got = expiring(spark, tmp_path / str(i), [beats[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        assert got == sorted(want, key=lambda x: (x[0], getattr(x[1], "expected", x[1]), x[2]))


def test_the_last_heartbeat_says_how_long_it_holds(spark):
    beats = spark.createDataFrame([("a", T0, 100 * S), ("a", T0 + dt.timedelta(seconds=1), 2 * S)], BEATS)
    assert liveness(beats, T0 + dt.timedelta(seconds=4)).first().expired
