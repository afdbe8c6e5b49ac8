"""Running values over a series of which one key may hold most rows.

A window by key is one task for each key. Here keys are cut into buckets of
consecutive time: each bucket is reduced to what it carries on (last value,
maximum, sum), the carries are combined over the few buckets of a key, and the
window runs within (key, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_of(ts: str = "ts") -> Column:
    return F.to_date(ts)


def previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], name: str = "__before") -> DataFrame:
    """Add a struct of the row right before, null at the start of a series; hot series are cut into buckets."""
    # a struct is there even where its fields are null
    return with_running(df, by, order, {name: ("last", F.struct(*columns))}, include_current=False)


def with_running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    bucket: Column | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Add running values: name -> (kind, expression), kind "last" (non-null), "max", "sum" or "count".

    ``bucket`` must not decrease along ``order``. Before the first row (with
    ``include_current`` off) "last" and "max" are null, "sum" and "count" 0.
    """
    df = df.withColumn("__bucket", bucket if bucket is not None else day_of(order[0]))
    at = F.struct(*order)
    carry = {
        "last": lambda e: F.max_by(e, F.when(e.isNotNull(), at)),
        "max": F.max,
        "sum": F.sum,
        "count": lambda e: F.count(e),
    }
    reduced = df.groupBy(*by, "__bucket").agg(*[carry[k](e).alias(f"__{n}") for n, (k, e) in values.items()])
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    over = {
        "last": lambda e, w: F.last(e, ignorenulls=True).over(w),
        "max": lambda e, w: F.max(e).over(w),
        "sum": lambda e, w: F.sum(e).over(w),
        "count": lambda e, w: F.sum(e).over(w),
    }
    prefix = reduced.select(*by, "__bucket", *[over[k](F.col(f"__{n}"), before).alias(f"__{n}") for n, (k, _) in values.items()])
    end = Window.currentRow if include_current else -1
    within = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    joined = df.alias("l").join(prefix.alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "__bucket")])
    joined = joined.select("l.*", *[f"r.__{n}" for n in values])
    inner = {
        "last": lambda e: F.last(e, ignorenulls=True).over(within),
        "max": lambda e: F.max(e).over(within),
        "sum": lambda e: F.sum(e).over(within),
        "count": lambda e: F.count(e).over(within),
    }
    both = {
        "last": lambda i, p: F.coalesce(i, p),
        "max": lambda i, p: F.when(p.isNull() | (i > p), i).otherwise(p),
        "sum": lambda i, p: F.coalesce(i, F.lit(0)) + F.coalesce(p, F.lit(0)),
        "count": lambda i, p: F.coalesce(i, F.lit(0)) + F.coalesce(p, F.lit(0)),
    }
    out = {n: both[k](inner[k](e), F.col(f"__{n}")) for n, (k, e) in values.items()}
    return joined.withColumns(out).drop("__bucket", *[f"__{n}" for n in values])


def null_safe_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; nulls in keys are equal."""
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in key]
    extra = [] if how in ("left_semi", "left_anti") else [f"r.{c}" for c in right.columns if c not in key]
    return left.alias("l").join(right.alias("r"), on, how).select("l.*", *extra)
