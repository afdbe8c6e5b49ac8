"""Column expressions: times, durations, numbers, sides, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds of each duration unit.
UNIT_MICROS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(col(ts).cast("timestamp"))


def from_micros(n: Column | str) -> Column:
    """The time of epoch microseconds, without zone."""
    return F.timestamp_micros(col(n)).cast("timestamp_ntz")


def iso_micros(text: Column | str) -> Column:
    """Epoch microseconds of an ISO-8601 text; finer digits are cut off, other text is null."""
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(col(text), r"(\.\d{6})\d+", "$1")))


def duration_micros(text: Column | str) -> Column:
    """Microseconds of ``15m``, ``1h`` and the like; null for other text."""
    number = F.regexp_extract(col(text), r"^(\d+)(ms|s|m|min|h|d)$", 1)
    unit = F.regexp_extract(col(text), r"^(\d+)(ms|s|m|min|h|d)$", 2)
    scale = F.lit(None).cast("long")
    for name, size in UNIT_MICROS.items():
        scale = F.when(unit == name, F.lit(size)).otherwise(scale)
    return F.when(number != "", number).cast("long") * scale


def duration_text(n: Column | str) -> Column:
    """The shortest text of a number of microseconds, in the largest unit that divides it."""
    out = F.lit(None).cast("string")
    for name in ("ms", "s", "m", "h", "d"):
        size = F.lit(UNIT_MICROS[name])
        out = F.when(col(n) % size == 0, F.concat((col(n) / size).cast("long").cast("string"), F.lit(name))).otherwise(out)
    return out


def strip_zeroes(number: Column | str) -> Column:
    """A decimal text without trailing zeroes behind the point."""
    return F.regexp_replace(F.regexp_replace(col(number), r"^(\d+)\.0+$", "$1"), r"^(\d+\.\d*?[1-9])0+$", "$1")


def round_half_down(x: Column | str, digits: Column | int) -> Column:
    """Rounded to ``digits`` (0 to 8) places; a half goes toward zero. Exact on decimals."""
    d = F.lit(digits) if isinstance(digits, int) else digits
    x = col(x).cast("decimal(30,12)")
    out = F.lit(None).cast("double")
    for n in range(9):
        scaled = F.abs(x) * F.lit(10**n).cast("decimal(10,0)")
        whole = F.ceil(scaled - F.lit("0.5").cast("decimal(2,1)"))
        out = F.when(d == n, F.signum(x) * whole.cast("double") / F.lit(float(10**n))).otherwise(out)
    return out


def taker_side(direction: Column | str) -> Column:
    """The side that took liquidity: up is a buy."""
    return F.when(col(direction) == "up", "buy").when(col(direction) == "down", "sell")


def maker_side(direction: Column | str) -> Column:
    return F.when(col(direction) == "up", "sell").when(col(direction) == "down", "buy")


def opposite(side: Column | str) -> Column:
    return F.when(col(side) == "buy", "sell").when(col(side) == "sell", "buy")


def side_of(size: Column | str) -> Column:
    """Side of a signed size: above zero buys."""
    return F.when(col(size) > 0, "buy").otherwise("sell")


def signed_size(side: Column | str, size: Column | str) -> Column:
    """The size, below zero for a sell; the reverse of ``side_of`` and the absolute value."""
    return F.when(col(side) == "buy", col(size)).otherwise(-col(size))


def tick_grid(start: Column, end: Column, step: str, inclusive: bool = False) -> Column:
    """Array of times from ``start`` by ``step``, up to but without ``end`` (``inclusive``: with it)."""
    times = F.when(start <= end, F.sequence(start, end, F.expr(f"INTERVAL {step}")))
    times = F.coalesce(times, F.array().cast("array<timestamp_ntz>"))
    return times if inclusive else F.filter(times, lambda t: t < end)


def checked_sum(a: Column, unit_a: Column, b: Column, unit_b: Column) -> Column:
    """a + b, an error if their units differ."""
    fits = F.assert_true(unit_a.eqNullSafe(unit_b), F.concat_ws(" ", F.lit("units differ:"), unit_a, unit_b))
    return F.when(fits.isNull(), a + b)


def priced(price: Column | None = None, close: Column | None = None, last: Column | None = None) -> Column:
    """The price of a row of any type: a trade's, a candle's close or a ticker's last."""
    return F.coalesce(*[c for c in (price, close, last) if c is not None])


def json_kind(value: Column, key: Column | str = "") -> Column:
    """number, string or time: how a panel shows a JSON value; values under ``time`` or ``micros`` are times."""
    kind = F.schema_of_variant(F.parse_json(value))
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    named = F.lit(key) if isinstance(key, str) else key
    return F.when(F.coalesce(named.isin("time", "micros"), F.lit(False)), "time").when(number, "number").otherwise("string")


def run_range(mode: str, now_micros: int, closed: tuple[int, int] | None = None) -> tuple[int, int | None]:
    """(from, to) of a run: ``live`` and ``paper`` from now on, ``paper:1h`` from a look-back on, without end; ``backtest`` over ``closed``."""
    name, _, lookback = mode.partition(":")
    if name == "backtest":
        if closed is None:
            raise ValueError("a backtest needs a closed range")
        return closed
    if name not in ("live", "paper") or (lookback and name == "live"):
        raise ValueError(f"unknown mode: {mode}")
    return (time_range(f"{lookback},now", now_micros)[0] if lookback else now_micros), None


def time_range(text: str, now_micros: int) -> tuple[int, int]:
    """(from, to) of ``instant,duration``, ``duration,instant`` or ``instant,instant``; an instant is ``now`` or ISO-8601."""
    import datetime as dt
    import re

    def part(t: str) -> tuple[str, int]:
        if m := re.fullmatch(r"(\d+)(ms|s|m|min|h|d)", t):
            return "span", int(m[1]) * UNIT_MICROS[m[2]]
        if t == "now":
            return "at", now_micros
        at = dt.datetime.fromisoformat(t)
        at = at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
        return "at", int((at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) / dt.timedelta(microseconds=1))

    (ka, a), (kb, b) = map(part, (x.strip() for x in text.split(",")))
    if (ka, kb) == ("span", "span"):
        raise ValueError(f"two durations: {text}")
    return (a, a + b) if kb == "span" else (b - a, b) if ka == "span" else (a, b)
