"""Replaying stored snapshots and deltas, and stitching history to live rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.order import PATH, drop_unordered, window
from tidemark.operators.running import previous, with_running


def replay(rows: DataFrame, by: list[str] = PATH) -> DataFrame:
    """Rows of each series that a reader sees, in order of (ts, snapshots first, bundle, seqid).

    A snapshot counts unless a snapshot of a later bundle stands before it. A
    delta counts only in the bundle of the current snapshot and only if every
    position since that snapshot is there; so one gap silences a bundle until
    its next snapshot. A row of the same (bundle, seqid) as the one before goes.
    Snapshots bound segments, so those need no buckets; series have them.
    """
    order = ["ts", "__delta", "bundle", "seqid"]
    rows = rows.withColumn("__delta", (~F.col("is_snapshot")).cast("int"))
    shot = F.when(F.col("is_snapshot"), F.col("bundle"))
    current = with_running(rows, by, order, {"__current": ("max", shot)}).where(F.col("bundle") == F.col("__current"))
    opened = F.when(F.col("is_snapshot"), F.col("seqid"))
    counted = with_running(current, by, order, {"__segment": ("sum", F.col("is_snapshot").cast("long")), "__start": ("last", opened)})
    within = counted.where("__segment > 0")
    # deltas at or below the snapshot's position are in it already
    news = within.where(F.col("is_snapshot") | (F.col("seqid") > F.col("__start")))
    at = F.row_number().over(window([*by, "__segment"], ["__delta", "ts", "bundle", "seqid"])) - 1
    whole = news.withColumn("__at", at).where(F.col("is_snapshot") | (F.col("seqid") == F.col("__start") + F.col("__at")))
    # positions rise within a segment, so only its snapshot can repeat the row before, the last of an earlier segment
    place = F.struct("bundle", "seqid")
    last = whole.groupBy(*by, "__segment").agg(F.max_by(place, F.struct(*order)).alias("__place"), F.min("ts").alias("ts"))
    last = previous(last, by, ["ts", "__segment"], ["__place"]).select(*by, "__segment", F.col("__before.__place").alias("__last"))
    joined = whole.join(last, [*by, "__segment"])
    kept = joined.where(~F.col("is_snapshot") | F.col("__last").isNull() | (F.col("__last") != place))
    return kept.select(*[c for c in rows.columns if c != "__delta"])


def stitch(history: DataFrame, live: DataFrame, by: list[str] = PATH) -> DataFrame:
    """History, then live rows, each (bundle, seqid) above all before it."""
    both = history.withColumn("__live", F.lit(0)).unionByName(live.withColumn("__live", F.lit(1)))
    return drop_unordered(both, by, ["ts", "__live", "bundle", "seqid"], ["bundle", "seqid"]).drop("__live")
