"""Joins along time: the latest value at or before, and overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import with_running


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], value: str, ts: str = "ts", right_order: list[str] | None = None, tolerance: str | None = None
) -> DataFrame:
    """``left`` with ``value`` (and ``value_ts``) of the latest row of ``right`` at or before it.

    A right row at the same instant counts. Among right rows of one instant the
    last by ``right_order`` counts. ``tolerance``: an interval such as "1 hour"
    beyond which a value is too old. One union and a running value, no range
    join; hot keys are cut by day.
    """
    order = right_order or []
    payload = F.struct(F.col(value), F.col(ts).alias("at"))
    rights = right.select(*by, ts, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.lit(0).alias("__left"), payload.alias("__value"))
    row = F.struct(*left.columns)
    lefts = left.select(*by, ts, F.lit(1).alias("__left"), row.alias("__row"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    seen = with_running(both, by, [ts, "__left", *[f"__o{i}" for i in range(len(order))]], {"__seen": ("last", F.col("__value"))})
    out = seen.where("__left = 1").select("__row.*", F.col(f"__seen.{value}").alias(value), F.col("__seen.at").alias(f"{value}_ts"))
    if tolerance is None:
        return out
    fresh = F.col(f"{value}_ts") >= F.col(ts) - F.expr(f"INTERVAL {tolerance}")
    return out.withColumn(value, F.when(fresh, F.col(value))).withColumn(f"{value}_ts", F.when(fresh, F.col(f"{value}_ts")))


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], width: int, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Pairs of rows whose half-open intervals [lo, hi) overlap, columns prefixed ``a_`` and ``b_``.

    Both sides are exploded into buckets of ``width``, joined on (by, bucket),
    and a pair is kept in the bucket where its overlap starts: an equi-join
    without repeats.
    """

    def bucketed(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*by, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by])
        first, last = F.floor(F.col(f"{p}_{lo}") / width), F.floor((F.col(f"{p}_{hi}") - 1) / width)
        return named.where(F.col(f"{p}_{lo}") < F.col(f"{p}_{hi}")).withColumn("__bucket", F.explode(F.sequence(first, last)))

    pairs = bucketed(a, "a").join(bucketed(b, "b"), [*by, "__bucket"])
    start = F.greatest(f"a_{lo}", f"b_{lo}")
    meets: Column = (F.col(f"a_{lo}") < F.col(f"b_{hi}")) & (F.col(f"b_{lo}") < F.col(f"a_{hi}"))
    return pairs.where(meets & (F.col("__bucket") == F.floor(start / width))).drop("__bucket")
