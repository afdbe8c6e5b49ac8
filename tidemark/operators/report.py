"""Report and panel queries: histograms, collections, values, bars of reports, tables for panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import micros
from tidemark.functions.paths import path_eq, time_range
from tidemark.operators.bars import fill_gaps, ohlcv
from tidemark.operators.book import top_levels
from tidemark.operators.order import numbered


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``(bin, share)`` of equal-width bins between the smallest and the largest value; empty bins are left out."""
    lo, hi, total = df.agg(F.min(value), F.max(value), F.count(value)).first()  # three numbers
    known = df.where(F.col(value).isNotNull())
    at = F.floor((F.col(value) - F.lit(lo)) / F.lit((hi - lo) / bins)) + 1 if total and hi > lo else F.lit(1)
    return known.groupBy(F.least(F.lit(bins), at).cast("int").alias("bin")).agg((F.count("*") / F.lit(float(total or 1))).alias("share"))


def collections(events: DataFrame) -> DataFrame:
    """Items of each session's named lists, with their place: rows of kind ``collection`` in order."""
    rows = events.where("kind = 'collection'")
    return numbered(rows, ["session_id", "key"], ["ts", "seq"], "place").select("session_id", "key", "place", "payload")


def report_values(events: DataFrame) -> DataFrame:
    """Last write of each session's values: ``put`` and ``update`` set, ``remove`` removes."""
    writes = events.where(F.col("kind").isin("put", "update", "remove"))
    last = writes.groupBy("session_id", "key").agg(F.max_by(F.struct("kind", "payload"), "seq").alias("last"))
    return last.where("last.kind <> 'remove'").select("session_id", "key", F.col("last.payload").alias("payload"))


def report_series(events: DataFrame) -> DataFrame:
    """Bars of each session's series: of additions and updates of one bar the last counts."""
    rows = events.where(F.col("kind").isin("candle_add", "candle_update"))
    return rows.groupBy("session_id", "key", "bar").agg(F.max_by("payload", "seq").alias("payload"))


def panel_trades(trades: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The newest trades as a panel's table: path, time in ms, then the other columns by name."""
    rest = sorted(c for c in trades.columns if c not in ("source", "topic", "datatype", "ts"))
    path = F.concat_ws("/", "source", "topic", "datatype").alias("path")
    newest = trades.orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest.select(path, F.expr("unix_millis(cast(ts AS timestamp))").alias("time"), *rest)


def concrete(path: str) -> tuple[str, str, str]:
    """The parts of a path that names one series; ValueError for a pattern."""
    parts = tuple(path.split("/"))
    if len(parts) != 3 or "*" in parts or "" in parts:
        raise ValueError(f"not one series: {path}")
    return parts


def panel_prices(trades: DataFrame, path: str, step: str, start=None, end=None, seq: str = "seqid") -> DataFrame:
    """``(key, close, time)``: bars of one series in [start, end) without gaps, times in ms."""
    source, topic, datatype = concrete(path)
    rows = trades.where(path_eq(source, topic, datatype) & time_range("ts", start, end))
    bars = fill_gaps(ohlcv(rows, step, ["source", "topic"], seq), step, ["source", "topic"])
    return bars.select(F.concat_ws(".", F.lit("local"), "source", "topic").alias("key"), "close", (micros("ts") / 1000).cast("long").alias("time"))


def panel_book(ladders: DataFrame, by: list[str], depth: int = 10) -> DataFrame:
    """The newest ladder of each book (``by, ts, side, price, qty``) as a panel's table: best levels first, asks before bids."""
    newest = ladders.groupBy(*by).agg(F.max("ts").alias("ts"))
    levels = top_levels(ladders.join(newest, [*by, "ts"]), by, depth)
    return levels.select(*by, "side", F.col("level").alias("place"), "price", "qty").orderBy(*by, "side", "place")


def tags(paths: DataFrame) -> DataFrame:
    """``(tag, value)``: what panels can filter by."""
    named = [F.struct(F.lit(c).alias("tag"), F.col(c).alias("value")) for c in ("source", "topic", "datatype")]
    return paths.select(F.inline(F.array(*named))).distinct()


def report_trades(events: DataFrame) -> DataFrame:
    """Trades of each session in order: rows of kind ``trade`` with their place."""
    rows = events.where("kind = 'trade'")
    return numbered(rows, ["session_id"], ["ts", "seq"], "place").select("session_id", "place", "ts", "payload")


def report_ends(events: DataFrame) -> DataFrame:
    """State of each session: ``running``, ``completed``, or ``failed`` with the error; the last such event counts."""
    over = F.col("kind").isin("complete", "error")
    last = events.groupBy("session_id").agg(F.max_by(F.struct("kind", "payload"), F.when(over, F.col("seq"))).alias("last"), F.count(F.when(F.col("kind") == "trade", 1)).alias("n_trades"))
    state = F.when(F.col("last.kind") == "complete", "completed").when(F.col("last.kind") == "error", "failed").otherwise("running")
    return last.select("session_id", state.alias("state"), F.when(state == "failed", F.col("last.payload")).alias("error"), "n_trades")


def bot_reports(ends: DataFrame, sessions: DataFrame) -> DataFrame:
    """All reports of each bot, of bots without any too: ``sessions(bot, session_id)``."""
    return sessions.join(ends, "session_id", "left").select("bot", "session_id", F.coalesce("state", F.lit("running")).alias("state"), "error", F.coalesce("n_trades", F.lit(0)).alias("n_trades"))


def json_lines(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts, without the fields that are null."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
