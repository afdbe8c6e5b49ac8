"""Queries whose rows on the way must not grow beyond their input and result."""

import datetime as dt
import itertools
import re

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import book, portfolio
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_sums_changes_by_step(spark):
    changes = [("a", "x", day(i % 9), float(i)) for i in range(40)] + [("a", "y", day(20), 1.0), ("b", "x", day(3), None), (None, "x", day(2), 2.0), ("a", "x", None, 99.0)]
    df = spark.createDataFrame(changes, "account string, asset string, ts timestamp_ntz, delta double")
    for days in ([0, 4, 8, 30], [3], [0], [4, 4, 0], list(range(-3, 17))):
        grid = F.array(*[F.lit(day(n)).cast("timestamp_ntz") for n in days])
        got = sorted(map(repr, map(tuple, portfolio.portfolio_history(df, ["account"], grid).collect())))
        keys = {c[:2] for c in changes}
        rows = [
            (*k, day(n), float(sum(c[3] or 0 for c in changes if c[:2] == k and c[2] and c[2] <= day(n))))
            for k in keys for n in days if any(c[:2] == k and c[2] and c[2] <= day(n) for c in changes)
        ]
        assert got == sorted(map(repr, rows))
    assert portfolio.portfolio_history(df, ["account"], C.tick_grid(F.lit(day(2)), F.lit(day(1)), "1 day")).count() == 0


def test_history_reads_no_order_of_fills(spark):
    """Sums need no order within a step: the nine columns that order fills are neither read nor shuffled."""
    for name in ("portfolio_by_year", "equity_by_year"):
        assert "l_linenumber" not in plan(QUERIES[name](spark, SF)), name


def test_equity_moves_no_order_of_fills_with_assets(spark):
    """Rows of places and assets, many times the fills, hold a number in place of the columns that order fills."""
    got = plan(QUERIES["equity_through_chains"](spark, SF))
    specs = re.findall(r"windowspecdefinition\(([^()]*)", got)
    assert specs and not [s for s in specs if "fill_key" in s and "asset#" in s]


def test_equity_neither_shuffles_nor_sorts_places_with_assets(spark):
    """Changes are dealt out once, and what is laid over the places of a block goes straight to its rates and sums."""
    got = plan(QUERIES["equity_through_chains"](spark, SF)).splitlines()
    assert len([line for line in got if "REPARTITION_BY_COL" in line]) == 1
    above = got[: next(i for i, line in enumerate(got) if "Generate" in line)]
    assert any("BroadcastHashJoin" in line for line in above)
    assert not [line for line in above if any(x in line for x in ("Sort", "Window", "hashpartitioning"))]


def test_equity_over_years_is_the_plain_sum(spark):
    """Accounts that pause for years, places that several changes share, assets without price, null and late ones."""
    changes = [(a, f"s{(a + i) % 4}", day(i * 97 % 1500), i // 2, float(i % 7 - 3)) for a in (0, 1) for i in range(60)] + [(2, "s1", day(900), 1, 2.0), (2, "s2", day(9), 0, 1.0), (1, "s1", None, 0, 50.0)]
    prices = [(f"s{k}", day(n), float(k + n % 13)) for k, n in itertools.product((0, 1, 3), range(100, 1500, 150))]
    df = spark.createDataFrame(changes, "account int, asset string, ts timestamp_ntz, i int, delta double")
    got = portfolio.equity_curve(df, spark.createDataFrame(prices, "asset string, ts timestamp_ntz, price double"), ["account"], ["ts", "i"])

    def price(asset, ts):
        return max(((t, p) for a, t, p in prices if a == asset and t <= ts), default=(0, 0.0))[1]

    places = {(c[0], c[2], c[3]) for c in changes if c[2]}
    want = {p: sum(c[4] * price(c[1], p[1]) for c in changes if c[2] and c[0] == p[0] and c[2:4] <= p[1:]) for p in places}
    found = {(r.account, r.ts, r.i): r.equity for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-6 for p in want)


def test_equity_of_long_histories_and_many_blocks_is_the_plain_sum(spark, monkeypatch):
    for long, places in ((0, 64), (50, 3), (10_000, 1), (59, 7)):
        monkeypatch.setattr(portfolio, "LONG_HISTORY", long)
        monkeypatch.setattr(portfolio, "PLACES_TOGETHER", places)
        test_equity_over_years_is_the_plain_sum(spark)


def test_equity_of_places_with_several_times_and_changes_of_an_asset(spark, monkeypatch):
    """A place counts once, at its first time, however often an asset changes in it; -0.0 is 0.0."""
    monkeypatch.setattr(portfolio, "PLACES_TOGETHER", 2)
    changes = [("a", "x", day(3), 0.0, 1.0), ("a", "x", day(2), -0.0, 2.0), ("a", "y", day(4), 0.0, None), ("a", None, day(5), 1.0, 9.0), ("a", "y", day(6), 2.0, 4.0), ("a", "x", day(7), 3.0, -3.0), ("a", "x", day(8), 3.0, 1.0)]
    prices = [("x", day(n), float(n)) for n in range(10)] + [("y", day(6), 0.5)]
    df = spark.createDataFrame(changes, "account string, asset string, ts timestamp_ntz, i double, delta double")
    got = portfolio.equity_curve(df, spark.createDataFrame(prices, "asset string, ts timestamp_ntz, price double"), ["account"], ["i"]).collect()
    assert sorted((r.i, r.equity) for r in got) == [(0.0, 6.0), (1.0, 15.0), (2.0, 20.0), (3.0, 9.0)]


def test_rates_are_asked_for_without_accounts_where_times_are_few(spark):
    """All assets at all times since their first, if these are no more rows than the changes; else those of each account."""
    few = [(n % 50, f"s{n % 3}", day(n % 5 + (n % 3 == 2) * 3)) for n in range(300)]
    many = [(n % 2, f"s{n % 4}", day(n)) for n in range(30)] + [(None, "s9", day(40)), (None, "s8", day(41))]
    for rows, by_account in ((few, False), (many, True)):
        df = spark.createDataFrame(rows, "account int, asset string, ts timestamp_ntz")
        asked = portfolio.times_asked(df.select("account", "ts", F.expr("array(struct(asset, 1.0D AS delta))").alias("__moves")), ["account"])
        assert ("hashpartitioning(account" in plan(asked)) == by_account
        want = {(b[1], a[2]) for a in rows for b in rows if b[2] <= a[2] and (a[0] == b[0] or not by_account)}
        got = [tuple(r) for r in asked.collect()]
        assert len(got) == len(want) and set(got) == want


def test_equity_of_several_changes_a_row(spark):
    """Fills with all that they change as one row, an empty one and one without account among them."""
    rows = [("a", day(1), [("x", 1.0), ("y", -2.0)]), ("a", day(2), [("x", 2.0), ("x", 3.0)]), ("a", day(2), []), (None, day(3), [("x", 1.0)]), ("a", day(4), None), ("a", day(5), [("y", 1.0)])]
    df = spark.createDataFrame(rows, "account string, ts timestamp_ntz, moves array<struct<asset: string, delta: double>>")
    prices = spark.createDataFrame([(a, day(n), p * n) for a, p in (("x", 1.0), ("y", 10.0)) for n in range(9)], "asset string, ts timestamp_ntz, price double")
    got = portfolio.equity_curve(df, prices, ["account"], ["ts"]).collect()
    assert sorted((r.account or "", (r.ts - day(0)).days, r.equity) for r in got) == [("", 3, 3.0), ("a", 1, -19.0), ("a", 2, -28.0), ("a", 5, -20.0)]


def test_balances_deal_out_fills_once(spark):
    """No join on the account and asset of each change: what a year starts with is a row among its fills."""
    got = plan(QUERIES["balances_over_time"](spark, SF))
    assert not [line for line in got.splitlines() if "Join" in line and "__bucket" in line]
    changes = [(a, day(n * 100), n, "buy" if n % 3 else "sell", float(n), 1.0, 0.0) for a in ("a", "b", None) for n in range(12)]
    fills = spark.createDataFrame(changes, "account string, ts timestamp_ntz, i int, side string, size double, price double, fee double")
    held = {}
    for r in portfolio.running_balance(fills, ["account"], F.lit("x"), F.lit("y"), ["ts", "i"]).collect():
        held[r.account, r.asset, r.i] = r.balance
    for (account, asset, i), balance in held.items():
        total = sum(n if n % 3 else -n for n in range(i + 1))
        assert balance == (total if asset == "x" else -total)
    assert len(held) == 72


def test_incoming_orders_meet_only_places_that_they_reach(spark):
    """No join of all incoming orders with all of a book's side, and the fills are those of a plain walk down the queue."""
    got = plan(QUERIES["orders_matched"](spark, SF))
    joins = [line for line in got.splitlines() if "Join" in line and "side" in line]
    assert joins and all("place" in line or "want" in line for line in joins)

    orders = [("k" if i % 3 else "m", i, "bid" if i % 2 else "ask", None if i == 4 else float(i * 7 % 5), float(i % 4 + 1), i * 13 % 31) for i in range(40)]
    orders += [("k", 41, "ask", float("nan"), 2.0, 50), ("k", 43, "bid", float("nan"), 2.0, 51), (None, 45, "ask", 1.0, 9.0, 52)]
    sizes, limits = (0.5, 1.0, 7.0, 1000.0, None), (None, -1.0, 0.0, 2.0, 2.5, 9.0)
    taken = [(b, s, z, x) for b in ("k", "m", "z", None) for s in ("buy", "sell") for z in sizes for x in limits]
    taken = [(b, n, s, z, x) for n, (b, s, z, x) in enumerate(taken + taken[:40])]
    want = set()
    key = lambda p, sign: (p is not None, p != p if p is not None else False, sign * p if p == p and p is not None else 0)  # noqa: E731  nulls first, NaN last
    for book_of, taker, side, size, limit in taken:
        other = "ask" if side == "buy" else "bid"
        queue = sorted((o for o in orders if o[0] == book_of is not None and o[2] == other), key=lambda o: (key(o[3], 1 if other == "ask" else -1), o[5]))
        before = 0.0
        for o in queue:
            p = o[3]
            within = limit is None or (p is not None and ((p <= limit) if side == "buy" else (p != p or p >= limit)))
            if size is not None and before < size and within:
                want.add((book_of, taker, o[1], repr(p), min(o[4], size - before)))
            before += o[4]
    known = spark.createDataFrame(orders, "topic string, order_id int, side string, price double, size double, prio_seq int")
    incoming = spark.createDataFrame(taken, "topic string, taker_id int, side string, size double, limit double")
    rows = book.match_orders(incoming, known, ["topic"]).collect()
    assert len(rows) == len(want) and {(r.topic, r.taker_id, r.order_id, repr(r.price), r.size) for r in rows} == want


def test_a_message_is_parsed_once(spark):
    for name in ("order_feed_quarantine", "order_feed_parsed"):
        got = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert got.count("from_json") == 1, name


def test_costs_sum_up_only_ladders_that_orders_name(spark):
    """Each sum over line items is behind a semi join with the ladders of orders, on its own rows."""
    got = QUERIES["execution_costs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scans = [i for i, line in enumerate(got) if "l_extendedprice" in line and "Relation" in line]
    assert len(scans) >= 3
    for i in scans:
        above = [line for line in got[:i] if len(line) - len(line.lstrip(" :+-")) < len(got[i]) - len(got[i].lstrip(" :+-"))]
        nearest = [line for line in reversed(above) if "LeftSemi" in line or "Aggregate" in line]
        assert nearest and "LeftSemi" in nearest[0]
