"""Positions by scans over ranges, against the same fills taken one at a time."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest

from tidemark.operators.positions import add, after, position_series, running

T0 = dt.datetime(2024, 1, 1)
FILLS = "account string, i long, ts timestamp_ntz, side string, size double, price double, position string, entry string"


@pytest.fixture
def many_ranges(spark):
    """Ranges of a few rows, which Spark doesn't put together again."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def one_at_a_time(fills):
    """In decimals, so that zero is zero."""
    state, out = {}, {}
    for account, i, _, side, size, price in sorted(fills, key=lambda f: (f[2], f[1])):
        pos, cost = state.get(account, (Decimal(0), 0.0))
        d = Decimal(str(size or 0)) * (1 if side == "buy" else -1)
        price, now, gain = price or 0.0, pos + d, 0.0
        entry = cost / float(abs(pos)) if pos else 0.0
        if pos and (pos > 0) != (d > 0):
            gain = float(min(abs(d), abs(pos))) * (price - entry) * (1 if pos > 0 else -1)
        if pos * now <= 0:
            cost = float(abs(now)) * price
        else:
            cost = cost + float(abs(d)) * price if abs(now) > abs(pos) else entry * float(abs(now))
        state[account] = now, cost
        out[account, i] = float(now), cost / float(abs(now)) if now else None, gain
    return out


def check(spark, fills):
    frame = spark.createDataFrame([(*f, "x", "y") for f in fills], FILLS).drop("position", "entry").repartition(3)
    got = position_series(frame, ["account"], ["ts", "i"]).collect()
    expected = one_at_a_time(fills)
    assert len(got) == len(expected)
    for r in got:
        position, entry, gain = expected[r.account, r.i]
        assert r.position == pytest.approx(position, rel=1e-9, abs=0) if position else r.position == 0
        assert (r.entry is None) == (entry is None) and r.entry == (None if entry is None else pytest.approx(entry, rel=1e-6))
        assert r.realized == pytest.approx(gain, rel=1e-6, abs=1e-12 * (r.size or 0))


def draw(rnd, account, n, sizes, start=0):
    at = [T0 + dt.timedelta(minutes=rnd.randint(0, 3000)) for _ in range(n)]
    return [(account, start + i, t, rnd.choice(["buy", "sell"]), rnd.choice(sizes), rnd.choice([1.5, 2.0, 7.0, None])) for i, t in enumerate(at)]


def test_tiny_sizes_are_positions(spark):
    check(spark, [("a", i, T0, "buy", 4e-10, 2.0 + i) for i in range(3)])
    check(spark, draw(random.Random(1), "a", 60, [1e-10, 3e-10, 2e-10]))


def test_decimals_that_sum_to_zero_are_none(spark):
    fills = [("a", 0, "buy", 0.1), ("a", 1, "buy", 0.2), ("a", 2, "sell", 0.3), ("a", 3, "buy", 0.0), ("a", 4, "buy", None), ("a", 5, "sell", 0.7), ("a", 6, "buy", 0.1), ("a", 7, "buy", 0.6)]
    check(spark, [(a, i, T0, side, size, 2.0 + i) for a, i, side, size in fills])


@pytest.mark.parametrize("seed", range(3))
def test_one_account_in_many_ranges_and_many_in_one(spark, many_ranges, seed):
    rnd = random.Random(seed)
    fills = draw(rnd, "hot", 900, [1.0, 2.0, 0.5, 0.1, 0.0, None])
    for k in range(40):
        fills += draw(rnd, f"a{k}" if k < 20 else f"z{k}", rnd.randint(1, 4), [1.0, 2.0, 0.3], 1000 * k)
    fills += draw(rnd, None, 30, [1.0, 3.0])
    check(spark, fills)


def test_growth_only_in_many_ranges(spark, many_ranges):
    check(spark, [("a", i, T0 + dt.timedelta(hours=i), "buy" if i % 3 else "sell", 1.0, 10.0 + i % 7) for i in range(2000)])


def test_no_fills(spark):
    got = position_series(spark.createDataFrame([], FILLS).drop("position", "entry"), ["account"], ["ts", "i"])
    assert got.collect() == [] and got.columns[-3:] == ["position", "entry", "realized"]


def test_doubling_is_a_scan():
    rnd = np.random.default_rng(0)
    first = np.maximum.accumulate(np.where(rnd.random(500) < 0.02, np.arange(500), 0))
    r, a = rnd.random(500), rnd.random(500)
    got_r, got_a = running(after, (r, a), first)
    (sums,) = running(add, (a,), first)
    f, s = (1.0, 0.0), 0.0
    for i in range(500):
        f, s = ((1.0, 0.0), 0.0) if first[i] == i else (f, s)
        f, s = (f[0] * r[i], r[i] * f[1] + a[i]), s + a[i]
        assert (got_r[i], got_a[i], sums[i]) == pytest.approx((*f, s))
