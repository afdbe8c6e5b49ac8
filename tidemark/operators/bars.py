"""Price bars: from trades and prices, rolled up, gaps filled, and signals on them.

Bars are aligned to the epoch and half-open; arrival order is (ts, position).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.order import PATH, last_rows
from tidemark.operators.running import null_safe_join, with_running
from tidemark.sources.shared import shared_path, written


def bar_start(ts: Column | str, step: str) -> Column:
    return F.window(ts, step)["start"]


def ohlcv(trades: DataFrame, step: str, by: list[str] = PATH, seq: str = "seqid", volume: Column | None = None) -> DataFrame:
    """Open, high, low, close and volume of each series and step; one shuffle of partial aggregates."""
    at = F.struct("ts", seq)
    volume = F.sum("size") if volume is None else volume
    return (
        trades.groupBy(*by, F.window("ts", step).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            volume.alias("volume"),
        )
        .select(*by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def ohlc(prices: DataFrame, step: str, by: list[str] = PATH, seq: str = "seqid") -> DataFrame:
    """Bars of priced rows that are no trades: volume 0."""
    return ohlcv(prices, step, by, seq, F.max(F.lit(0.0)))


def rollup_candles(candles: DataFrame, step: str, by: list[str] = PATH) -> DataFrame:
    """Bars of bars."""
    return (
        candles.groupBy(*by, F.window("ts", step).alias("w"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(*by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def fill_gaps(bars: DataFrame, step: str, by: list[str] = PATH) -> DataFrame:
    """Every bar between the first and the last; an empty one has the close before it and no volume."""
    ends = bars.groupBy(*by).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ends.select(*by, F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("ts"))
    full = grid.join(bars, [*by, "ts"], "left")
    w = Window.partitionBy(*by).orderBy("ts")
    close = F.last(F.when(F.col("close") > 0, F.col("close")), ignorenulls=True).over(w)
    empty = F.col("close").isNull() | (F.col("close") <= 0)
    prices = {c: F.when(empty, F.col("__close")).otherwise(F.col(c)) for c in ("open", "high", "low", "close")}
    return (
        full.withColumn("__close", close)
        .withColumns(prices | {"volume": F.when(empty, 0.0).otherwise(F.col("volume"))})
        .select(*by, "ts", "open", "high", "low", "close", "volume")
    )


def lookahead(bars: DataFrame, by: list[str] = PATH, sabotage: bool = False) -> DataFrame:
    """Signals that know the next bar: buy if its close is higher, sell if lower."""
    up, down = ("sell", "buy") if sabotage else ("buy", "sell")
    after = F.lead("close").over(Window.partitionBy(*by).orderBy("ts"))
    return bars.withColumn("next_close", after).withColumn(
        "signal", F.when(F.col("next_close") > F.col("close"), up).when(F.col("next_close") < F.col("close"), down)
    )


def last_bars(bars: DataFrame, n: int = 1000, by: list[str] = PATH) -> DataFrame:
    """The latest ``n`` bars of each series."""
    return last_rows(bars, by, ["ts"], n)


def anchored_bars(prices: DataFrame, step_micros: int, by: list[str] = PATH, seq: str = "seqid", keep_last: bool = True) -> DataFrame:
    """Bars that start at their first tick: a tick more than a step after a bar's start opens the next.

    For the epoch-aligned form see ``ohlcv``. Nulls in ``by`` are a series of
    their own; a null price opens a bar, but is none of its prices.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = prices.select(*by, seq, micros.alias("__t"), F.col("price").cast("double").alias("price"))
    starts = anchored_starts(rows.select(*by, F.col("__t").alias("t")).distinct(), step_micros, by)
    opened = starts.select(*by, F.col("t").alias("__t"), F.col("t").alias("__opens_at"))
    # a start stands before all ticks of its time
    both = rows.withColumn("__kind", F.lit(1)).unionByName(opened.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    bucket = F.floor(F.col("__t") / F.lit(86_400_000_000))
    known = with_running(both, by, ["__t", "__kind", seq], {"start": ("last", F.col("__opens_at"))}, bucket).where("__kind = 1")
    order = F.when(F.col("price").isNotNull(), F.struct("__t", seq))
    bars = known.groupBy(*by, "start").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
    )
    if not keep_last:
        last = bars.groupBy(*by).agg(F.max("start").alias("__last"))
        bars = null_safe_join(bars, last, by).where("start < __last")
    start = F.timestamp_micros("start").cast("timestamp_ntz").alias("ts")
    return bars.select(*by, start, "open", "high", "low", "close", F.lit(0.0).alias("volume"))


def anchored_starts(times: DataFrame, step_micros: int, by: list[str]) -> DataFrame:
    """Of distinct ``times(by, t)`` in micros those at which anchored bars start.

    A start leads to the next one, the first time more than a step after it. These pointers are found for all times at
    once, by a running value from the end, and squared round by round: starts known so far, from which pointers over
    2^k bars lead, are twice as many after round k. The first time of a series is a start, as is any that follows the
    one before it by more than a step, so that rounds grow as the logarithm of the longest stretch without such a pause.
    Every round is two joins on (by, t); no series is one task.
    """
    folder = shared_path(times.sparkSession, "starts")
    # from the end: the last time seen before a time's limit is the first one beyond it
    asked = times.select(*by, (-(F.col("t") + step_micros)).alias("at"), F.lit(0).alias("kind"), F.col("t").alias("of"))
    seen = times.select(*by, (-F.col("t")).alias("at"), F.lit(1).alias("kind"), F.col("t").alias("to"))
    both = asked.unionByName(seen, allowMissingColumns=True)
    bucket = F.floor(F.col("at") / F.lit(86_400_000_000))
    led = with_running(both, by, ["at", "kind"], {"next": ("last", F.col("to"))}, bucket).where("kind = 0")
    pointers = written(led.select(*by, F.col("of").alias("t"), F.col("next").alias("to")).where("to IS NOT NULL"), f"{folder}/pointers=0")

    before = with_running(times, by, ["t"], {"before": ("last", F.col("t"))}, F.floor(F.col("t") / F.lit(86_400_000_000)), include_current=False)
    sure = before.where((F.col("before").isNull()) | (F.col("t") - F.col("before") > step_micros)).select(*by, "t")
    starts = written(sure, f"{folder}/starts/round=0")
    rounds = 0
    while True:
        rounds += 1
        known = starts.sparkSession.read.schema(starts.schema).parquet(f"{folder}/starts").select(*by, "t")
        ahead = null_safe_join(known, pointers, [*by, "t"]).select(*by, F.col("to").alias("t")).distinct()
        found = written(null_safe_join(ahead, known, [*by, "t"], "left_anti"), f"{folder}/starts/round={rounds}")
        if found.isEmpty():
            return known
        further = pointers.select(*by, F.col("t").alias("to"), F.col("to").alias("further"))
        pointers = written(null_safe_join(pointers, further, [*by, "to"]).select(*by, "t", F.col("further").alias("to")), f"{folder}/pointers={rounds}")
