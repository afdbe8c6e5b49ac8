"""Paths ``source/topic/datatype``: parsing, matching, selections, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import duration_micros

PARTS = ("source", "topic", "datatype")


def split_path(path: Column | str) -> list[Column]:
    """Three columns of a ``source/topic/datatype`` text."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return [F.get(parts, i).alias(name) for i, name in enumerate(PARTS)]


def split_pair(symbol: Column | str) -> list[Column]:
    """Base and quote of ``BTC-USD`` or ``btc_usd``, in lower case."""
    c = F.lower(F.col(symbol) if isinstance(symbol, str) else symbol)
    parts = F.split(c, F.when(c.contains("-"), F.lit("-")).otherwise(F.lit("_")))
    return [F.get(parts, 0).alias("base"), F.get(parts, 1).alias("quote")]


def split_datatype(datatype: Column | str) -> list[Column]:
    """Kind, bar length in microseconds and ladder depth of ``candles_1d``, ``ladder_10``, ``trades``."""
    c = F.col(datatype) if isinstance(datatype, str) else datatype
    parts = F.split(c, "_")
    kind, last = F.get(parts, 0), F.element_at(parts, -1)
    step = F.when(kind.isin("candles", "series"), duration_micros(last))
    depth = F.when((kind == "ladder") & (F.size(parts) > 1), last.try_cast("int"))
    return [kind.alias("kind"), step.alias("step_micros"), depth.alias("depth")]


def path_eq(source: str, topic: str, datatype: str) -> Column:
    """Exactly one series; reaches the scan as partition filters."""
    return (F.col("source") == source) & (F.col("topic") == topic) & (F.col("datatype") == datatype)


def variants(paths: DataFrame) -> DataFrame:
    """``PARTS`` and all patterns that match them, as ``p_`` columns: each part itself or ``*``."""
    out = paths
    for p in PARTS:
        out = out.withColumn(f"p_{p}", F.explode(F.array_distinct(F.array(F.col(p), F.lit("*")))))
    return out


def matches(paths: DataFrame, patterns: DataFrame, both_ways: bool = False) -> DataFrame:
    """Pairs of distinct ``paths`` and ``patterns`` that match: ``PARTS``, then the pattern's other columns.

    A path has eight patterns, so this is an equi-join, whatever the number of
    patterns. ``both_ways``: paths may hold ``*`` as well and match as patterns.
    """
    extra = [c for c in patterns.columns if c not in PARTS]
    named = patterns.select(*[F.col(p).alias(f"p_{p}") for p in PARTS], *extra)
    found = variants(paths).join(named, [f"p_{p}" for p in PARTS]).select(*PARTS, *extra)
    if both_ways:
        turned = variants(patterns).withColumnsRenamed({p: f"x_{p}" for p in PARTS}).drop(*[f"x_{p}" for p in PARTS])
        wild = paths.where(" or ".join(f"{p} = '*'" for p in PARTS)).select(*[F.col(p).alias(f"p_{p}") for p in PARTS])
        other = wild.join(turned, [f"p_{p}" for p in PARTS]).select(*[F.col(f"p_{p}").alias(p) for p in PARTS], *extra)
        found = found.unionByName(other).distinct()
    return found


def resolve_pattern(catalog: DataFrame, patterns: DataFrame) -> DataFrame:
    """Paths of the catalog that any pattern matches, one way, as a set."""
    return matches(catalog.select(*PARTS).distinct(), patterns.select(*PARTS).distinct()).distinct()


def pattern_join(rows: DataFrame, rules: DataFrame, order: str) -> DataFrame:
    """Each row with the first rule, by ``order``, that matches its path; rows without one go.

    Rules meet the distinct paths only, whose number is that of the series, and
    the rows then meet their path's rule in an equi-join.
    """
    extra = [c for c in rules.columns if c not in PARTS]
    hit = matches(rows.select(*PARTS).distinct(), rules, both_ways=True)
    first = hit.groupBy(*PARTS).agg(F.min_by(F.struct(*extra), order).alias("rule__")).select(*PARTS, *[F.col(f"rule__.{c}").alias(c) for c in extra])
    return rows.join(first, list(PARTS))


def enabled_paths(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose path any rule matches."""
    on = matches(rows.select(*PARTS).distinct(), rules.select(*PARTS).distinct(), both_ways=True).distinct()
    return rows.join(on, list(PARTS), "left_semi")


def slice_join(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs of slices (``bundle, slice``, -1 for any) that match: both parts equal, or one of them any and the other concrete.

    The result has the columns of ``rows`` and the other columns of ``wanted``.
    An equi-join: a concrete part meets itself and those that are any, a part
    that is any meets concrete ones, under a number of their own.
    """
    fields = ("bundle", "slice")
    extra = [c for c in wanted.columns if c not in fields]
    keys = [f"__{f}" for f in fields]
    for f in fields:
        own, concrete = F.col(f), F.col(f) != -1
        rows = rows.withColumn(f"__{f}", F.explode(F.when(concrete, F.array(own, F.lit(-1))).otherwise(F.array(F.lit(-2)))))
        wanted = wanted.withColumn(f"__{f}", F.explode(F.when(concrete, F.array(own, F.lit(-2))).otherwise(F.array(F.lit(-1)))))
    return rows.join(wanted.select(*keys, *extra), keys).drop(*keys)


def adhoc_filter(filters: list[dict]) -> Column:
    """Panel filters ``{key, operator, value}``: only ``=`` on parts of the path counts."""
    out = F.lit(True)
    for f in filters:
        if f.get("operator") == "=" and f.get("key") in PARTS and f.get("value", "*") != "*":
            out = out & (F.col(f["key"]) == f["value"])
    return out


def time_range(ts: str, start=None, end=None) -> Column:
    """[start, end): inclusive, exclusive."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col(ts) >= start)
    if end is not None:
        out = out & (F.col(ts) < end)
    return out


def validate_selection(start, end, now) -> None:
    """ValueError for an end without start, a start in the future without end, or a start after the end."""
    if end is not None and start is None:
        raise ValueError("a selection with an end needs a start")
    if end is None and start is not None and start > now:
        raise ValueError("an endless selection can't start in the future")
    if start is not None and end is not None and start > end:
        raise ValueError("the start is after the end")
