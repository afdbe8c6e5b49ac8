"""Chains of markets: pegs of pegs, rates as of a time, equity through chains, against plain models."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fx, portfolio
from tidemark.operators.chains import PEGS, class_of, conversion_chains, peg_classes, rates_as_of

MARKETS = "exchange string, base string, quote string, price double"
T0 = dt.datetime(2024, 1, 1)


def rates(spark, rows, target):
    return {r.asset: (pytest.approx(r.rate), r.n_hops, r.path) for r in fx.rates_to(spark.createDataFrame(rows, MARKETS), target).collect()}


def test_pegs_of_pegs_cost_no_hop(spark):
    got = rates(spark, [("m", "x", "usdc", 2.0), ("m", "x", "z", 5.0), ("m", "z", "usd", 3.0)], "usdt")
    assert got["x"] == (2.0, 1, "x>usdc=usdt")  # not by z, at 15
    assert got["usdc"] == (1.0, 0, "usdc=usdt") and got["usd"] == (1.0, 0, "usd=usdt")
    got = rates(spark, [("m", "x", "usdc", 2.0)], "usdt")
    assert got["x"] == (2.0, 1, "x>usdc=usdt") and got["usdc"][1] == 0
    assert rates(spark, [("m", "x", "xbt", 2.0), ("n", "btc", "dai", 10.0)], "tusd")["x"] == (20.0, 2, "x>xbt=btc>dai=tusd")


def test_classes_are_what_pegs_connect(spark):
    assert set(peg_classes([("a", "b"), ("d", "c"), ("b", "c"), ("x", "y")]).items()) == {(c, "a") for c in "abcd"} | {("x", "x"), ("y", "x")}
    named = spark.createDataFrame([("usdt",), ("eur",), (None,)], "c string").select(class_of(F.col("c"))).collect()
    assert [r[0] for r in named] == ["bitusd", "eur", None]


def plain_rates(rows, target):
    """Walks over currencies, each peg a step without cost, shortest first."""
    equal = {c: {c} for a, b in PEGS for c in (a, b)}
    for _ in PEGS:
        for a, b in PEGS:
            equal[a] = equal[b] = equal[a] | equal[b]
    same = lambda c: equal.get(c, {c})
    ways = {}
    for exchange, base, quote, price in rows:
        if price and price > 0 and quote not in same(base):
            for way, rate, step in (((base, quote), price, (exchange, False)), ((quote, base), 1 / price, (exchange, True))):
                ways.setdefault(way, []).append((step, rate))
    best = {min(same(target)): (0, target, target, 1.0)}
    while True:
        new = {}
        for (src, dst), steps in ways.items():
            into = best.get(min(same(dst)))
            if into and min(same(src)) not in best:
                hops, path, entry, rate = into
                found = (hops + 1, f"{src}>" + (path if dst == entry else f"{dst}={path}"), src, min(steps)[1] * rate)
                new[min(same(src))] = min(found, new.get(min(same(src)), found))
        if not new:
            break
        best |= new
    named = {x for way in ways for x in way} | {target} | set(equal)
    return {a: (r, h, p if a == e else f"{a}={p}") for a in named if (x := best.get(min(same(a)))) for h, p, e, r in [x]}


def test_chains_are_those_of_a_plain_search(spark):
    rnd = random.Random(4)
    names = ["usd", "usdt", "usdc", "btc", "xbt", *"abcdefghij"]
    for _ in range(3):
        rows = [(rnd.choice("xyz"), *rnd.sample(names, 2), rnd.choice([2.0, 0.5, 4.0, 0.0, None])) for _ in range(16)]
        rows = list({(e, b, q): r for r in rows for e, b, q in [r[:3]]}.values())
        for target in ("usdt", "a"):
            assert rates(spark, rows, target) == plain_rates(rows, target)


def test_nothing_and_unknown_targets(spark):
    assert rates(spark, [], "q") == {"q": (1.0, 0, "q")}
    assert set(rates(spark, [("m", "a", "b", 2.0)], "usd")) == {c for pair in PEGS for c in pair if c not in ("btc", "xbt")}


PRICES = "exchange string, base string, quote string, ts timestamp_ntz, price double"


def test_rates_follow_the_prices_of_all_markets_of_a_chain(spark):
    day = lambda i: T0 + dt.timedelta(days=i)
    prices = spark.createDataFrame(
        [("m", "a", "b", day(1), 2.0), ("m", "c", "b", day(2), 4.0), ("n", "c", "eur", day(3), 10.0), ("m", "a", "b", day(5), 3.0), ("n", "c", "eur", day(6), 20.0), ("n", "c", "eur", day(7), 0.0)],
        PRICES,
    )
    markets = prices.where("price > 0").dropDuplicates(["exchange", "base", "quote"])
    chains = conversion_chains(markets, "eur")
    assert {r.asset: r.path for r in chains.collect() if r.asset in "abc"} == {"a": "a>b>c>eur", "b": "b>c>eur", "c": "c>eur"}
    points = spark.createDataFrame([("a", day(i)) for i in range(9)] * 2 + [("eur", day(0)), ("lost", day(8))], "asset string, ts timestamp_ntz")
    got = {(r.asset, (r.ts - T0).days): r.rate for r in rates_as_of(points, chains, prices).collect()}
    assert got == {("a", i): x for i, x in enumerate([None] * 3 + [5.0, 5.0, 7.5, 15.0, 15.0, 15.0])} | {("eur", 0): 1.0, ("lost", 8): None}


def test_equity_through_chains_is_that_of_a_plain_model(spark):
    rnd = random.Random(8)
    at = [T0 + dt.timedelta(hours=7 * i) for i in range(40)]
    market = {"a": ("a", "b"), "b": ("c", "b"), "c": ("c", "eur")}  # b is turned over
    prices = sorted({(*rnd.choice(list(market.values())), rnd.choice(at)): rnd.choice([1.0, 2.0, 4.0, 0.5]) for _ in range(40)}.items())
    changes = [(rnd.choice("pq"), rnd.choice("abc"), t, i // 2, float(rnd.randint(-3, 5))) for i, t in enumerate(x for x in at for _ in range(2))]
    frame = spark.createDataFrame([("m", b, q, t, p) for (b, q, t), p in prices], PRICES)
    chains = conversion_chains(frame.dropDuplicates(["base", "quote"]), "eur")
    moves = spark.createDataFrame(changes, "account string, asset string, ts timestamp_ntz, i int, delta double")
    got = portfolio.equity_curve(moves, frame, ["account"], ["ts", "i"], chains).collect()

    def price(pair, t):
        known = [(u, p) for (*x, u), p in prices if tuple(x) == pair and u <= t]
        return max(known)[1] if known else None

    def rate(asset, t):
        p = [price(market[x], t) for x in "abc"["abc".index(asset) :]]
        if None in p:
            return 0.0
        worth = 1.0
        for x, y in zip("abc"["abc".index(asset) :], p, strict=True):
            worth *= 1 / y if x == "b" else y
        return worth

    expected = {}
    for account, (_, _, t, i, _) in itertools.product("pq", changes):
        mine = [x for x in changes if x[0] == account and (x[2], x[3]) <= (t, i)]
        if any((x[2], x[3]) == (t, i) for x in mine):
            expected[account, i] = sum(x[4] * rate(x[1], t) for x in mine)
    assert {(r.account, r.i): r.equity for r in got} == pytest.approx(expected) and len(got) == len(expected)
