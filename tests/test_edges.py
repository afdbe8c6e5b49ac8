"""Edge cases against small tables and row-at-a-time models."""

import dataclasses
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import paths as P
from tidemark.operators import analysis, asof, bars, book, fx, ladder, order, portfolio, positions, replay, report
from tidemark.sources import feeds
from tidemark.sources import series as stored
from tidemark.sources.shared import shared_path
from tidemark.streaming import fuzzy, state, streams, values

T0 = dt.datetime(2018, 11, 23, 23, 53)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def ticks(spark, rows):
    """(minute, price) or (minute, price, seqid) of one series."""
    data = [("s", "t", "trades", at(r[0]), float(r[1]), 1.0, r[2] if len(r) > 2 else i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "source string, topic string, datatype string, ts timestamp_ntz, price double, size double, seqid long")


def test_bars_gaps_boundaries_and_ties(spark):
    t = ticks(spark, [(7, 10), (7, 11), (12, 9), (31, 5)])  # minute 7 is 00:00 exactly
    got = bars.fill_gaps(bars.ohlcv(t, "5 minutes"), "5 minutes").orderBy("ts").collect()
    assert [(r.ts.hour * 60 + r.ts.minute, r.open, r.close, r.volume) for r in got] == [(0, 10, 11, 2), (5, 9, 9, 1), (10, 9, 9, 0), (15, 9, 9, 0), (20, 5, 5, 1)]
    assert bars.fill_gaps(bars.ohlcv(t.limit(0), "5 minutes"), "5 minutes").count() == 0


def test_anchored_bars(spark):
    t = ticks(spark, [(0, 1), (5, 2), (5.1, 3), (20, 4)])
    got = bars.anchored_bars(t, 5 * 60_000_000).orderBy("ts").collect()
    assert [(r.open, r.close) for r in got] == [(1, 2), (3, 3), (4, 4)]  # a tick at exactly one step stays
    assert bars.anchored_bars(t, 5 * 60_000_000, keep_last=False).count() == 2
    rnd = random.Random(1)
    minutes = sorted(rnd.randint(0, 9000) for _ in range(600))
    many = ticks(spark, [(m, rnd.randint(1, 99)) for m in minutes]).repartition(3)
    want, start = [], None
    for r in many.orderBy("ts", "seqid").collect():
        if start is None or (r.ts - start).total_seconds() > 1800:
            start = r.ts
            want.append([start, r.price, r.price, r.price, r.price])
        else:
            want[-1][2:] = [max(want[-1][2], r.price), min(want[-1][3], r.price), r.price]
    got = bars.anchored_bars(many, 1_800_000_000).orderBy("ts").collect()
    assert [[r.ts, r.open, r.high, r.low, r.close] for r in got] == want


def test_dedupes_differ(spark):
    seqs = [3, 3, 5, 3, 5, 6]
    t = ticks(spark, [(i, s) for i, s in enumerate(seqs)]).withColumn("seq", F.col("price").cast("long"))
    path, by = order.PATH, ["ts", "seqid"]
    run = lambda df: [r.seq for r in df.orderBy("ts").collect()]
    assert run(order.dedupe_increasing(t, path, by, "seq")) == [3, 5, 6]
    assert run(order.dedupe_consecutive(t, path, by, "seq")) == [3, 5, 3, 5, 6]
    assert run(order.drop_against_previous(t, path, by, "seq", unordered=True)) == [3, 5, 5, 6]
    assert run(order.drop_unordered(t, path, by, ["seq"])) == [3, 5, 6]
    assert run(order.last_rows(t, path, by, 2)) == [5, 6]


def test_numbering_across_days(spark):
    t = ticks(spark, [(i * 700, i) for i in range(9)])
    got = order.numbered(t.drop("seqid"), order.PATH, ["ts"]).orderBy("ts").collect()
    assert [r["index"] for r in got] == list(range(9))


def test_asof_ties_misses_and_keys(spark):
    right = ticks(spark, [(5, 1), (5, 2), (2000, 3)])
    left = spark.createDataFrame([("t", at(m), m) for m in (4, 5, 6, 1999, 2000)] + [("none", at(9), 9)], "topic string, ts timestamp_ntz, m int")
    got = asof.asof_join(left, right, ["topic"], "price", right_order=["seqid"]).orderBy("topic", "m").collect()
    assert [(r.topic, r.m, r.price) for r in got] == [("none", 9, None), ("t", 4, None), ("t", 5, 2.0), ("t", 6, 2.0), ("t", 1999, 2.0), ("t", 2000, 3.0)]
    near = asof.asof_join(left, right, ["topic"], "price", tolerance="1 hour").where("m = 1999").first()
    assert near.price is None


def test_overlap_join_is_the_theta_join(spark):
    rnd = random.Random(3)
    rows = [[(k % 2, i, a, a + rnd.randint(0, 40)) for i in range(60) for k in [i] for a in [rnd.randint(0, 300)]] for _ in range(2)]
    a, b = (spark.createDataFrame(r, "k int, id int, lo long, hi long") for r in rows)
    got = sorted((r.a_id, r.b_id) for r in asof.overlap_join(a, b, ["k"], 16).collect())
    want = sorted((x[1], y[1]) for x in rows[0] for y in rows[1] if x[0] == y[0] and x[2] < y[3] and y[2] < x[3] and x[2] < x[3] and y[2] < y[3])
    assert got == want


def replay_model(rows):
    """Row-at-a-time replay of (ts, is_snapshot, bundle, seqid)."""
    out, current, last = [], None, None
    for r in sorted(rows, key=lambda r: (r[0], not r[1], r[2], r[3])):
        _, snap, bundle, seq = r
        if snap:
            if current is None or bundle >= current[0]:
                current = (bundle, seq)
            else:
                continue
        elif current and bundle == current[0] and seq == current[1] + 1:
            current = (bundle, seq)
        else:
            continue
        if (bundle, seq) != last:
            out.append((bundle, seq))
        last = (bundle, seq)
    return out


def test_replay_against_the_model(spark):
    rnd = random.Random(11)
    rows = []
    for series in range(6):
        for bundle, start in ((-1, 0), (1, 30), (2, 50)):
            for seq in range(40):
                if rnd.random() > 0.12 or seq % 10 == 0:
                    rows.append((f"t{series}", start + seq, seq % 10 == 0, bundle, seq))
    data = [("s", t, "d", at(m), snap, b, q) for t, m, snap, b, q in rows]
    df = spark.createDataFrame(data, "source string, topic string, datatype string, ts timestamp_ntz, is_snapshot boolean, bundle long, seqid long")
    got = replay.replay(df)
    for series in range(6):
        mine = [(r.bundle, r.seqid) for r in got.where(F.col("topic") == f"t{series}").orderBy("ts", (~F.col("is_snapshot")).cast("int"), "bundle", "seqid").collect()]
        assert mine == replay_model([r[1:] for r in rows if r[0] == f"t{series}"])


def test_backfill_and_live_give_all_trades_once(spark):
    t = ticks(spark, [(i, i) for i in range(120)]).withColumn("id", F.col("seqid") + 1)
    live = t.where("id >= 86").withColumn("seqid", F.col("id") - 86)
    pages = t.where("id <= 105").drop("seqid")
    merged = stored.backfill_merge(live, pages, order.PATH, ["ts"])
    # overlap is resolved by the trade's id
    seen = order.dedupe_increasing(merged, order.PATH, ["ts", "seqid"], "id")
    assert [r.id for r in seen.orderBy("ts").collect()] == list(range(1, 121))
    back = pages.withColumn("page", F.floor((105 - F.col("id")) / 40))
    assert stored.page_order_errors(back, order.PATH, "page", ["ts"]).count() == 0


def test_series_store_round_trip(spark, tmp_path):
    t = ticks(spark, [(i * 60, i) for i in range(48)]).withColumn("bundle", F.lit(1).cast("long")).withColumn("is_snapshot", F.col("seqid") % 4 == 0)
    stored.write_series(t, str(tmp_path / "s"))
    got = stored.read_series(spark, str(tmp_path / "s"), "s", "t", "trades", at(600), at(1200))
    assert sorted(r.price for r in got.collect()) == [float(i) for i in range(10, 20)]
    seen = stored.read_series(spark, str(tmp_path / "s"), "s", "t", "trades", at(600), at(1200), replayed=True)
    assert sorted(r.price for r in seen.collect()) == [float(i) for i in range(10, 20)]
    with pytest.raises(ValueError):
        stored.read_series(spark, str(tmp_path / "s"), "s", "t", "trades", None, at(3))
    with pytest.raises(ValueError):
        P.validate_selection(at(5), at(3), at(9))


EVENTS = "k int, seq long, kind string, order_id string, side string, price double, size double"


def test_book_lifecycle(spark):
    rows = [
        (0, 1, "open", "a", "bid", 10.0, 5.0), (0, 2, "open", "b", "bid", 10.0, 4.0), (0, 3, "change", "a", None, None, 3.0),
        (0, 4, "done", "x", None, None, None), (0, 5, "open", "c", "ask", 11.0, 1.0), (0, 6, "done", "c", None, None, None),
        (0, 7, "open", "c", "ask", 12.0, 2.0), (0, 8, "change", "y", None, None, 9.0),
    ]
    b = book.book_at(spark.createDataFrame(rows, EVENTS), ["k"])
    got = {r.order_id: (r.side, r.price, r.size, r.prio_seq) for r in b.collect()}
    assert got == {"a": ("bid", 10.0, 3.0, 3), "b": ("bid", 10.0, 4.0, 2), "c": ("ask", 12.0, 2.0, 7)}
    best = book.best_prices(book.level_depth(b, ["k"]), ["k"]).first()
    assert (best.bid, best.ask, best.spread, best.crossed) == (10.0, 12.0, 2.0, False)
    one = book.best_prices(book.level_depth(b.where("side = 'bid'"), ["k"]), ["k"]).first()
    assert one.ask is None and one.spread is None and not one.crossed
    # queue: b stands before a, whose change sent it back
    taker = spark.createDataFrame([(0, "t", "sell", 5.0, None)], "k int, taker_id string, side string, size double, limit double")
    assert sorted((r.order_id, r.size) for r in book.match_orders(taker, b, ["k"]).collect()) == [("a", 1.0), ("b", 4.0)]


def test_walk_depth_limits_funds_and_shortage(spark):
    levels = spark.createDataFrame([(0, "ask", 10.0, 2.0), (0, "ask", 11.0, 2.0), (0, "bid", 9.0, 1.0)], "k int, side string, price double, qty double")
    o = spark.createDataFrame(
        [(0, 1, "buy", 2.0, None, None), (0, 2, "buy", 9.0, None, None), (0, 3, "buy", 3.0, None, 10.0), (0, 4, "buy", None, 31.0, None), (0, 5, "sell", 1.0, None, 9.5), (0, 6, "buy", 0.0, None, None)],
        "k int, order_id int, side string, size double, funds double, limit double",
    )
    fills = ladder.walk_depth(o, levels, ["k"])
    got = sorted((r.order_id, r.price, r.size) for r in fills.collect())
    assert got == [(1, 10.0, 2.0), (2, 10.0, 2.0), (2, 11.0, 2.0), (3, 10.0, 2.0), (4, 10.0, 2.0), (4, 11.0, 1.0)]
    sums = {r.order_id: (r.filled, r.unfilled) for r in ladder.fill_summary(o, fills, ["k"]).collect()}
    assert sums[2] == (4.0, 5.0) and sums[3] == (2.0, 1.0) and sums[4] == (3.0, 0.0) and sums[5] == (0.0, 1.0)


def test_ladder_diff_and_update_are_inverse(spark):
    schema = "k int, side string, price double, qty double"
    a = spark.createDataFrame([(0, "ask", 10.0, 2.0), (0, "ask", 11.0, 1.0)], schema)
    b = spark.createDataFrame([(0, "ask", 11.0, 1.0), (0, "ask", 12.0, 3.0)], schema)
    d = ladder.ladder_diff(a, b, ["k"])
    assert sorted((r.price, r.qty) for r in d.collect()) == [(10.0, 0.0), (12.0, 3.0)]
    assert ladder.ladder_diff(a, b, ["k"], only_changed=False).count() == 3
    back = ladder.update_levels(a, d.withColumn("seq", F.lit(1).cast("long")), ["k"])
    assert sorted(map(tuple, back.select("price", "qty").collect())) == sorted(map(tuple, b.select("price", "qty").collect()))


def position_model(fills):
    pos, entry, out = 0.0, None, []
    for side, size, price in fills:
        d, gain = (size if side == "buy" else -size), 0.0
        new = round(pos + d, 9)
        if pos and d * pos < 0:
            gain = (1 if pos > 0 else -1) * min(abs(d), abs(pos)) * (price - entry)
        if new == 0:
            entry = None
        elif pos == 0 or new * pos < 0:
            entry = price
        elif abs(new) > abs(pos):
            entry = (entry * abs(pos) + price * abs(d)) / abs(new)
        pos = new
        out.append((pos, entry, gain))
    return out


def test_positions_against_the_model(spark):
    rnd = random.Random(5)
    fills = [(rnd.choice(["buy", "sell"]), float(rnd.randint(1, 5)), float(rnd.randint(50, 60))) for _ in range(300)]
    df = spark.createDataFrame([(1, at(i * 100), i, *f) for i, f in enumerate(fills)], "account int, ts timestamp_ntz, i int, side string, size double, price double")
    got = positions.position_series(df, ["account"], ["ts", "i"]).orderBy("i").collect()
    for r, (pos, entry, gain) in zip(got, position_model(fills), strict=True):
        assert r.position == pos and r.realized == pytest.approx(gain, abs=1e-6)
        assert (r.entry is None) == (entry is None) and (entry is None or r.entry == pytest.approx(entry, rel=1e-9))


def test_positions_that_never_cross_zero(spark):
    """A running product of the shares that are left would come to nothing."""
    fills = [("buy", 1.0, 100.0)] + [(("buy", "sell")[i % 2], 1.0, 50.0 + i % 23) for i in range(5000)]
    df = spark.createDataFrame([(1, at(i * 400), i, *f) for i, f in enumerate(fills)], "account int, ts timestamp_ntz, i int, side string, size double, price double")
    got = positions.position_series(df, ["account"], ["ts", "i"]).orderBy("i").collect()
    assert df.selectExpr("max(year(ts)) - min(year(ts)) AS y").first().y >= 3
    for r, (pos, entry, gain) in zip(got, position_model(fills), strict=True):
        assert r.position == pos and r.entry == pytest.approx(entry, rel=1e-9) and r.realized == pytest.approx(gain, abs=1e-6)


def test_equity_after_each_change(spark):
    rnd = random.Random(8)
    changes = [(a, rnd.choice("xyz"), at(rnd.randint(0, 3000)), i, float(rnd.randint(-3, 3))) for i, a in enumerate([1] * 60 + [2] * 30)]
    prices = [(c, at(m), float(rnd.randint(1, 9))) for c in "xy" for m in sorted(rnd.sample(range(100, 3000), 40))]
    got = portfolio.equity_curve(spark.createDataFrame(changes, "account int, asset string, ts timestamp_ntz, i int, delta double"), spark.createDataFrame(prices, "asset string, ts timestamp_ntz, price double"), ["account"], ["ts", "i"])
    want = {}
    for account, _, ts, i, _ in changes:
        held = {}
        for a, c, t, j, d in changes:
            if a == account and (t, j) <= (ts, i):
                held[c] = held.get(c, 0) + d
        last = {c: max(((t, p) for x, t, p in prices if x == c and t <= ts), default=(None, 0.0))[1] for c in held}
        want[account, i] = sum(held[c] * last[c] for c in held)
    assert {(r.account, r.i): r.equity for r in got.collect()} == pytest.approx(want)


def test_chains_of_any_length(spark):
    m = spark.createDataFrame([("x", f"a{i}", f"a{i + 1}", 2.0) for i in range(9)], "exchange string, base string, quote string, price double")
    got = {r.asset: (r.n_hops, r.rate) for r in fx.rates_to(m, "a9").collect()}
    assert got == {f"a{i}": (9 - i, 2.0 ** (9 - i)) for i in range(10)}


def test_spreads_of_fine_quantities(spark):
    schema = "k int, side string, price double, qty double"
    left = spark.createDataFrame([(0, "ask", 10.0, 0.004), (0, "ask", 11.0, 0.004), (0, "bid", 8.0, 0.00000003), (0, "bid", 7.0, 0.0)], schema)
    right = spark.createDataFrame([(0, "bid", 9.0, 0.008), (0, "ask", 12.0, 0.00000001), (0, "ask", 13.0, 0.1)], schema)
    got = sorted((r.side, r.price, r.qty) for r in ladder.ladder_spread(left, right, ["k"]).collect())
    assert got == [("ask", 1.0, 0.004), ("ask", 2.0, 0.004), ("bid", -5.0, 0.00000002), ("bid", -4.0, 0.00000001)]


def test_rates_pegs_inverse_unreachable_and_ties(spark):
    m = spark.createDataFrame(
        [("x", "eth", "btc", 0.03), ("x", "btc", "usdt", 4000.0), ("x", "eur", "usd", 1.25), ("y", "ltc", "aaa", 2.0), ("x", "aaa", "usd", 10.0), ("x", "ltc", "btc", 0.01), ("z", "lost", "found", 1.0)],
        "exchange string, base string, quote string, price double",
    )
    got = {r.asset: r for r in fx.rates_to(m, "usd").collect()}
    assert got["eth"].rate == pytest.approx(120.0) and got["xbt"].rate == pytest.approx(4000.0) and got["usdc"].rate == 1.0
    assert got["eur"].rate == 1.25 and "lost" not in got
    assert got["ltc"].rate == pytest.approx(20.0)  # two chains of two hops: the first by path
    back = {r.asset: r.rate for r in fx.rates_to(m, "eur").collect()}
    assert back["usd"] == pytest.approx(0.8)


def test_columns(spark):
    df = spark.createDataFrame([("15m", "1.500", 1.005, -1.005), ("2d", "100", 1.0051, 2.5), ("7x", "1.00", 0.0, 1.0)], "d string, n string, x double, y double")
    got = df.select(C.duration_micros("d"), C.strip_zeroes("n"), C.round_half_down("x", 2), C.round_half_down("y", 2)).collect()
    assert [r[0] for r in got] == [900_000_000, 172_800_000_000, None]
    assert [r[1] for r in got] == ["1.5", "100", "1"]
    assert [r[2] for r in got] == [1.0, 1.01, 0.0] and got[0][3] == -1.0
    assert C.time_range("now,1h", 10) == (10, 3_600_000_010) and C.time_range("1s,now", 5_000_000) == (4_000_000, 5_000_000)
    with pytest.raises(ValueError):
        C.time_range("1h,2h", 0)
    text = spark.createDataFrame([("2014-11-07T22:19:28.5785449Z",), ("nonsense",)], "t string").select(C.iso_micros("t")).collect()
    assert text[0][0] % 1_000_000 == 578544 and text[1][0] is None
    with pytest.raises(Exception, match="units differ"):
        df.select(C.checked_sum(F.col("x"), F.lit("usd"), F.col("y"), F.lit("eur"))).collect()


def test_paths(spark):
    rows = spark.createDataFrame([("coinbase", "btc_usd", "trades"), ("coinbase", "btc_usd", "book")], "source string, topic string, datatype string")
    pats = spark.createDataFrame([("coinbase", "btc_usd", "book")], rows.schema)
    assert [r.datatype for r in P.resolve_pattern(rows, pats).collect()] == ["book"]
    kinds = spark.createDataFrame([("candles_1d",), ("ladder_10",), ("trades",)], "d string").select(*P.split_datatype("d")).collect()
    assert [tuple(r) for r in kinds] == [("candles", 86_400_000_000, None), ("ladder", None, 10), ("trades", None, None)]
    pair = spark.createDataFrame([("BTC-USD",), ("eth_btc",)], "s string").select(*P.split_pair("s")).collect()
    assert [tuple(r) for r in pair] == [("btc", "usd"), ("eth", "btc")]


def test_feed_quarantine(spark):
    lines = [
        '{"type":"open","product_id":"BTC-USD","sequence":1,"time":"2018-01-01T00:00:00.000001Z","order_id":"a","price":"1.5","size":"2","side":"buy"}',
        '{"type":"match","product_id":"BTC-USD","sequence":2,"time":"2018-01-01T00:00:01Z","trade_id":7,"price":"1.5","size":"1","side":"sell"}',
        '{"type":"open","sequence":3,"price":"cheap"}', '{"type":"open"}', '{"type":"dance","sequence":5}', "{broken",
    ]
    events, bad = feeds.parse_order_feed(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.seq: r for r in events.collect()}
    assert set(got) == {1, 2} and got[1].topic == "btc_usd" and got[1].side == "bid" and got[2].direction == "up"
    assert sorted(r.error for r in bad.collect()) == ["no message", "no number", "no sequence", "unknown type"]


MINUTE = 60_000_000


def play(events, late=MINUTE, forget=2 * MINUTE):
    """Row-at-a-time model of the out-of-order book: outcomes of (order, time, event) in order of arrival."""
    clock, alive, gone, out = None, {}, {}, []
    for order_id, ts, event in events:
        if order_id in gone and clock is not None and gone[order_id] < clock - forget:
            del gone[order_id]
        if clock is not None and clock - ts > late:
            out.append("late")
        elif order_id in gone:
            out.append("already removed")
        elif order_id not in alive:
            out.append("accepted" if event == "create" else "unknown order")
            if event == "create":
                alive[order_id] = ts
            elif event == "delete":
                gone[order_id] = ts
        elif event == "create":
            out.append("already active")
        elif ts <= alive[order_id]:
            out.append("outdated")
        else:
            out.append("accepted")
            alive[order_id] = ts
            if event == "delete":
                gone[order_id] = alive.pop(order_id)
        clock = ts if clock is None else max(clock, ts)
    return out


def test_fuzzy_rules():
    m = MINUTE
    steps = [
        (1, 5 * m, "create", "accepted"), (1, 5 * m, "create", "already active"), (1, 5 * m, "change", "outdated"), (1, 5 * m + 1, "change", "accepted"),
        (2, 4 * m, "create", "late"), (1, 6 * m, "delete", "accepted"), (1, 6 * m, "create", "already removed"), (3, 6 * m, "delete", "unknown order"),
        (4, 9 * m, "create", "accepted"), (3, 9 * m, "create", "accepted"), (5, 9 * m, "change", "unknown order"),
    ]
    clock, known = None, {}
    for order_id, ts, event, outcome in steps:
        got, known[order_id] = fuzzy.judged(known.get(order_id), event, ts, clock, m, 2 * m)
        assert got == outcome, (order_id, ts, event)
        clock = max(clock or 0, ts)
    assert play([x[:3] for x in steps]) == [x[3] for x in steps]


def test_fuzzy_stream_is_the_model(spark, tmp_path):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        kind = rnd.random()
        price, size, side = (1.0, 2.0, "bid") if kind < 0.5 else (None, 3.0, None) if kind < 0.75 else (None, None, None)
        rows.append((i % 2, rnd.randint(0, 40), i, at(i / 60 - rnd.choice([0, 0, 0, 0.3, 2])), price, size, side))
    schema = "topic int, order_id long, seq long, ts timestamp, price double, size double, side string"
    df = spark.createDataFrame(rows, schema)
    folder = fuzzy.in_arrival_order(df, 4)
    fuzzy.clocked(streams.stream_series(spark, folder, df.schema, each=1), str(tmp_path / "clocked"), str(tmp_path / "cp"), 50)
    whole = spark.read.parquet(str(tmp_path / "clocked" / "batch=0")).schema
    out = streams.drained(fuzzy.fuzzy_book(streams.stream_series(spark, str(tmp_path / "clocked"), whole, each=2)))
    got = {r.seq: r.outcome for r in out.collect()}
    want = {}
    for topic in (0, 1):
        mine = [r for r in rows if r[0] == topic]
        event = lambda r: "create" if r[4] else "change" if r[5] else "delete"
        times = [int((r[3] - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for r in mine]
        want |= dict(zip([r[2] for r in mine], play([(r[1], t, event(r)) for r, t in zip(mine, times, strict=True)]), strict=True))
    assert got == want and set(want.values()) == {"late", "outdated", "accepted", "unknown order", "already active", "already removed"}


def test_ingest_restarts_without_repeats(spark, tmp_path):
    df = spark.range(10).toDF("id")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = streams.stream_series(spark, str(tmp_path / "in"), df.schema)
        streams.ingest(s, str(tmp_path / "out"), str(tmp_path / "cp"), every=None).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(10))


def test_liveness_and_state(spark):
    beats = spark.createDataFrame([("a", at(1), 2_000_000), ("b", at(1), 0)], "bot string, ts timestamp, ttl_micros long")
    alive = lambda s: {r.bot: r.expired for r in state.liveness(beats, at(1) + dt.timedelta(seconds=s)).collect()}
    assert alive(1.5) == {"a": False, "b": False} and alive(2.5) == {"a": True, "b": False}
    log = [("a", 1, "config", "x"), ("a", 2, "expired", ""), ("a", 3, "config", "y"), ("b", 4, "config", "z"), ("b", 5, "config", "w")]
    got = state.latest_state(spark.createDataFrame(log, "bot string, seq long, kind string, payload string"))
    assert {r.bot: r.payload for r in got.collect()} == {"a": "y", "b": "w"}


def test_patterns_and_paths_that_are_patterns(spark):
    schema = "source string, topic string, datatype string"
    rules = spark.createDataFrame([("a", "x", "t", 1), ("*", "y", "t", 2), ("b", "*", "*", 3)], f"{schema}, rule int")
    rows = spark.createDataFrame([("a", "x", "t"), ("a", "y", "t"), ("b", "y", "t"), ("c", "z", "t"), ("a", "*", "t"), ("*", "*", "*")], schema)
    got = {tuple(r)[:3]: r.rule for r in P.pattern_join(rows, rules, "rule").collect()}
    assert got == {("a", "x", "t"): 1, ("a", "y", "t"): 2, ("b", "y", "t"): 2, ("a", "*", "t"): 1, ("*", "*", "*"): 1}
    assert P.enabled_paths(rows, rules).count() == 5 and P.resolve_pattern(rows, rules).count() == 3


def test_slices_match_all_ways(spark):
    values = (-1, 0, 1)
    rows = spark.createDataFrame([(b, s) for b in values for s in values], "bundle int, slice int")
    wanted = rows.selectExpr("bundle", "slice", "bundle AS b", "slice AS s")
    got = sorted(tuple(r) for r in P.slice_join(rows, wanted).collect())
    fits = lambda x, y: (x == y or -1 in (x, y)) and (x, y) != (-1, -1)
    assert got == sorted((b, s, c, t) for b in values for s in values for c in values for t in values if fits(b, c) and fits(s, t))


def test_hot_series_are_many_tasks(spark, tmp_path):
    """One series of nearly all rows is dealt out by days, and the store's files by position."""
    hot = spark.range(40_000).select(F.lit("s").alias("source"), F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("topic"), F.lit("trades").alias("datatype"),
        F.expr("timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id * 10)").alias("ts"), F.col("id").alias("seqid"), F.lit(1).cast("long").alias("bundle"), F.col("id").cast("double").alias("price"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        before = order.with_previous(hot.where("topic = 'hot'"), order.PATH, ["ts", "seqid"], ["price"])
        sizes = [r["count"] for r in before.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
        stored.write_series(hot, str(tmp_path / "s"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    files = spark.read.parquet(str(tmp_path / "s")).where("topic = 'hot' and date = '2020-01-02'").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1
    path = stored.read_series(spark, str(tmp_path / "s"), "s", "hot", "trades", dt.datetime(2020, 1, 1, 2), dt.datetime(2020, 1, 1, 3))
    plan = path._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "topic#" in plan.split("PartitionFilters")[1] and path.count() == 353


def test_symbols_must_be_unambiguous(spark):
    rows = spark.createDataFrame([("x", "btc", at(1), 1.0), ("x", "btc", at(2), 2.0), ("y", "eth", at(1), 3.0)], "exchange string, symbol string, ts timestamp_ntz, price double")
    assert {r.symbol: r.price for r in order.latest_price(rows, ["ts"]).collect()} == {"btc": 2.0, "eth": 3.0}
    with pytest.raises(Exception, match="ambiguous symbol: btc"):
        order.latest_price(rows.union(spark.createDataFrame([("z", "btc", at(3), 4.0)], rows.schema)), ["ts"]).collect()


def test_panels_take_one_series():
    assert report.concrete("a/b/c") == ("a", "b", "c")
    for path in ("a/*/c", "a/b", "a//c"):
        with pytest.raises(ValueError):
            report.concrete(path)


def test_runs_and_grids(spark):
    assert C.run_range("live", 7) == (7, None) and C.run_range("paper:1s", 5_000_000) == (4_000_000, None) and C.run_range("backtest", 7, (1, 2)) == (1, 2)
    for mode in ("backtest", "live:1h", "dance"):
        with pytest.raises(ValueError):
            C.run_range(mode, 7)
    a, b = F.lit(at(0)).cast("timestamp_ntz"), F.lit(at(120)).cast("timestamp_ntz")
    sizes = spark.range(1).select(F.size(C.tick_grid(a, b, "1 hour")), F.size(C.tick_grid(a, b, "1 hour", True)), F.size(C.tick_grid(b, a, "1 hour"))).first()
    assert tuple(sizes) == (2, 3, 0)


def test_store_on_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared_path(Session(), "x")


def test_plans_have_no_cartesian_product(spark):
    t = ticks(spark, [(1, 1)])
    plan = asof.asof_join(t.select("topic", "ts", "seqid"), t, ["topic"], "price")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_snapshots_reconcile(spark):
    sec = lambda n: T0 + dt.timedelta(seconds=n)
    shots = [(0, sec(t), i) for t, ids in ((100, [1, 7]), (120, [7, 8]), (121, [8, 9, 2])) for i in ids]
    known = [(0, 1, sec(100), True), (0, 2, sec(115), True), (0, 3, sec(115), True), (0, 4, sec(100), False), (0, 9, sec(1), False)]
    snapshots = spark.createDataFrame(shots, "k int, ts timestamp, order_id long")
    got = book.reconciled(spark.createDataFrame(known, "k int, order_id long, ts timestamp, alive boolean"), snapshots, ["k"])
    # 3 is too fresh, 7 has gone again, 9 is known as gone, 2 is there
    assert sorted((r.order_id, r.correction) for r in got.collect()) == [(1, "lingering"), (8, "missed")]


def test_named_values():
    v = {}
    assert values.apply(v, "update", "a", 1.0) is None
    assert values.apply(v, "default", "a", 2.0) == 2.0 and values.apply(v, "default", "a", 3.0) == 2.0
    assert values.apply(v, "update", "a", 4.0) == 4.0 and values.apply(v, "get", "a", None) == 4.0
    assert values.apply(v, "delete", "a", None) is None and v == {}


def test_book_snapshots_come_in_bounded_pages(spark, monkeypatch):
    from tidemark.plans import live

    seen, parse = [], live.feeds.parse_book_snapshot
    monkeypatch.setattr(live.feeds, "parse_book_snapshot", lambda lines, by: seen.append(lines) or parse(lines, by))
    n = live.book_snapshot_parsed(spark, "/root/testdata/sf0.1").count()
    sizes = [len(m["asks"]) + len(m["bids"]) for m in (json.loads(r.value) for r in seen[0].collect())]
    assert sum(sizes) == n and n > 8000 and max(sizes) < 2000


@dataclasses.dataclass(frozen=True)
class Settings:
    step: str
    depth: int = 5
    share: float = 0.5
    names: list = dataclasses.field(default_factory=list)


def test_parameters_are_checked():
    assert analysis.parameters(Settings, '{"step": "1 hour", "share": 1}') == Settings("1 hour", 5, 1)
    assert analysis.described(Settings)["step"] == {"type": "string", "required": True} and analysis.described(Settings)["names"] == {"type": "array", "default": []}
    for text in ("{}", '{"step": 1}', '{"step": "x", "depth": true}', '{"step": "x", "depth": 1.5}', '{"step": "x", "other": 1}', "[]", "{"):
        with pytest.raises(ValueError):
            analysis.parameters(Settings, text)
