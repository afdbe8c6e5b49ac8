"""Row order within series: numbering, de-duplication, neighbours, merges, top rows.

``by`` names the columns of a series, ``order`` those of its total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import previous, with_running

PATH = ["source", "topic", "datatype"]


def window(by: list[str], order: list[str | Column]):
    return Window.partitionBy(*by).orderBy(*order)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "index", bucket: Column | None = None) -> DataFrame:
    """Zero-based position of each row in its series; ``bucket`` as for ``with_running``."""
    return with_running(df, by, order, {name: ("count", F.lit(1))}, bucket, include_current=False)


def dedupe_increasing(df: DataFrame, by: list[str], order: list[str], seq: str) -> DataFrame:
    """Rows whose ``seq`` is above that of all earlier rows and above -1."""
    seen = with_running(df, by, order, {"__seen": ("max", F.col(seq))}, include_current=False)
    return seen.where(F.col(seq) > F.coalesce("__seen", F.lit(-1))).drop("__seen")


def dedupe_consecutive(df: DataFrame, by: list[str], order: list[str], key: str, bucket: Column | None = None) -> DataFrame:
    """Rows that differ in ``key`` from the row right before them."""
    seen = with_running(df, by, order, {"__before": ("last", F.struct(F.col(key).alias("v")))}, bucket, include_current=False)
    return seen.where(F.col("__before").isNull() | ~F.col(key).eqNullSafe(F.col("__before.v"))).drop("__before")


def drop_unordered(df: DataFrame, by: list[str], order: list[str], keys: list[str]) -> DataFrame:
    """The first row, then rows whose composite key is above all before."""
    key = F.struct(*keys)
    seen = with_running(df, by, order, {"__seen": ("max", key)}, include_current=False)
    return seen.where(F.col("__seen").isNull() | (key > F.col("__seen"))).drop("__seen")


def drop_against_previous(df: DataFrame, by: list[str], order: list[str], key: str, unordered: bool = False) -> DataFrame:
    """Drop rows that equal (or, ``unordered``, do not exceed) the raw row before them."""
    before = F.col(f"__before.{key}")
    keep = before.isNull() | ((F.col(key) > before) if unordered else (F.col(key) != before))
    return previous(df, by, order, [key]).where(keep).drop("__before")


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """``prev_*`` columns of the row before, null at the start."""
    seen = previous(df, by, order, columns)
    return seen.withColumns({f"prev_{c}": F.col(f"__before.{c}") for c in columns}).drop("__before")


def last_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The latest ``n`` rows of each series."""
    w = window(by, [F.desc(c) for c in order])
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def snapshot_points(df: DataFrame, by: list[str], order: list[str], hours: int = 4) -> DataFrame:
    """Mark the first row of each epoch-aligned interval."""
    slot = F.floor(F.unix_micros(F.col(order[0]).cast("timestamp")) / F.lit(hours * 3_600_000_000))
    w = Window.partitionBy(*by, slot).orderBy(*order)
    return df.withColumn("is_snapshot", F.row_number().over(w) == 1)


def by_position(df: DataFrame) -> DataFrame:
    """Rows of a store in the order of their bundles and positions."""
    return df.orderBy("bundle", "seqid")


def after_first(df: DataFrame, by: list[str], order: list[str], marker: Column) -> DataFrame:
    """Rows from the first row on for which ``marker`` holds; series without one go."""
    at = F.struct(*order)
    starts = df.groupBy(*by).agg(F.min(F.when(marker, at)).alias("__start"))
    return df.join(starts, by).where(at >= F.col("__start")).drop("__start")


def until_fails(df: DataFrame, by: list[str], order: list[str], holds: Column) -> DataFrame:
    """Reverse scan: the latest rows of each series, back to the first for which ``holds`` is false."""
    at = F.struct(*order)
    ends = df.groupBy(*by).agg(F.max(F.when(~holds, at)).alias("__end"))
    return df.join(ends, by).where(F.col("__end").isNull() | (at > F.col("__end"))).drop("__end")


def merge_by_time(*series: DataFrame) -> DataFrame:
    """Many series as one, in order of time, path, bundle and position."""
    out = series[0]
    for s in series[1:]:
        out = out.unionByName(s)
    order = [c for c in ("ts", "source", "topic", "datatype", "bundle", "seqid", "id") if c in out.columns]
    return out.orderBy(*order)


def feed_order(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events and book snapshots by sequence; a snapshot stands before an event of the same one."""
    both = events.withColumn("is_event", F.lit(1)).unionByName(snapshots.withColumn("is_event", F.lit(0)), allowMissingColumns=True)
    return both.orderBy("seq", "is_event")


def latest_price(prices: DataFrame, order: list[str]) -> DataFrame:
    """Last price of each symbol (``symbol, exchange, price``); an error if two exchanges list a symbol."""
    last = prices.groupBy("symbol").agg(F.max_by("price", F.struct(*order)).alias("price"), F.min("exchange").alias("exchange"), F.max("exchange").alias("__other"))
    one = F.assert_true(F.col("exchange") == F.col("__other"), F.concat(F.lit("ambiguous symbol: "), F.col("symbol"))).isNull()
    return last.where(one).select("symbol", "exchange", "price")


def latest(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows, newest first."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
