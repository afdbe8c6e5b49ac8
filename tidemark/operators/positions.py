"""Positions after every fill, by associative scans over ranges of equal numbers of rows.

Fills are sorted by series and time and cut into ranges, whatever the series: a
series that holds most rows lies in many ranges, thousands of small ones in one.
A range's series but the first begin in it, so they are finished in the one pass
that follows the sort. What of a range's first series lies there, its head, may
begin earlier: heads wait until what precedes them is known, which is a few
numbers a range.

The cost of a position is an affine function of the cost before, C = r * C' + a
with r = 0 where a position opens, 1 where it grows, and the share left where it
shrinks. Functions of this kind compose, (r1, a1) then (r2, a2) being (r1 * r2,
r2 * a1 + a2), without any division: within a batch by doubling, across ranges
one composition a range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import null_safe_join
from tidemark.sources.shared import shared_path, written

#: A position is zero if it is not more than this share of the fill that made it: what is left of decimals that sum to zero.
FLAT = 1e-9


def position_series(fills: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Position after every fill: ``position``, average ``entry`` (null at 0), and profit ``realized`` by it.

    A fill that crosses zero closes the old position and opens a new one at its
    price; growth averages the entry by absolute sizes; a reduction realizes its
    part. Sizes are taken as they are, however small. A null size changes nothing
    and a null price counts as zero; nulls in ``by`` are a series of their own.
    """
    folder = shared_path(fills.sparkSession, "positions")
    signed = F.coalesce(F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size")).cast("double"), F.lit(0.0))
    rows = fills.withColumns({"__d": signed, "__price": F.coalesce(F.col("price").cast("double"), F.lit(0.0))})
    ordered = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    swept = written(ordered.mapInArrow(sweep(by), ", ".join([*given, SWEPT])), f"{folder}/swept")

    # ranges' heads, and what else of their series lies in earlier ranges: a few rows a range
    heads = swept.where("__head").select(*by, "__part").distinct()
    keys = F.broadcast(heads.select(*by).distinct())  # one series a range
    parts = (
        null_safe_join(swept, keys, by, "left_semi").groupBy(*by, "__part")
        .agg(F.max("__head").alias("__head"), *[F.max_by(c, "__place").alias(c) for c in ("__sum", "__scale", "__cost")])
    )
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    was = F.coalesce(F.sum("__sum").over(earlier), F.lit(0.0))
    parts = written(parts.withColumns({"__was_sum": was, "__was_scale": F.last("__scale", ignorenulls=True).over(earlier)}), f"{folder}/parts")
    starts = parts.where("__head").select("__part", "__was_sum", "__was_scale")
    waiting = swept.where("__head").drop("__position", "__was", "__cost", "__before").join(F.broadcast(starts), "__part")
    waiting = waiting.repartition("__part").sortWithinPartitions("__part", "__place")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in waiting.schema)
    composed = written(waiting.mapInArrow(compose, f"{kinds}, {COMPOSED}"), f"{folder}/composed")

    # the cost at the start of each head
    whole = composed.groupBy("__part").agg(F.max_by(F.struct("__r", "__a"), "__place").alias("__whole"))
    whole = parts.join(whole, "__part", "left").select(*by, "__part", "__head", "__cost", "__whole.*")
    costs = whole.groupBy(*by).applyInArrow(costs_at_start, "__part int, __start double")
    heads = composed.join(F.broadcast(costs), "__part").withColumns(
        {"__cost": F.col("__r") * F.col("__start") + F.col("__a"), "__before": F.col("__r0") * F.col("__start") + F.col("__a0")}
    )
    columns = [*fills.columns, "__position", "__was", "__cost", "__before", "__price", "__d"]
    found = swept.where("not __head").select(columns).unionByName(heads.select(columns))

    now, old = F.col("__position"), F.col("__was")
    shrinks = F.signum("__d") * F.signum(old) < 0
    closed = F.signum(old) * F.least(F.abs("__d"), F.abs(old))
    gain = F.when(shrinks, closed * (F.col("__price") - F.col("__before") / F.abs(old))).otherwise(0.0)
    return found.select(*fills.columns, now.alias("position"), F.when(now != 0, F.col("__cost") / F.abs(now)).alias("entry"), gain.alias("realized"))


#: What a pass over a range adds: its number, a row's place in it, whether the row is of its head, the sum of its series within it and the size
#: of the last fill that had one, and, if it is not of its head, positions and costs after and before.
SWEPT = (
    "__part int, __place long, __head boolean, __sum double, __scale double, "
    "__position double, __was double, __cost double, __before double"
)
#: What a pass over heads adds: positions after and before, and costs after and before as functions of that at the start.
COMPOSED = "__position double, __was double, __r double, __a double, __r0 double, __a0 double"


def running(step: Callable, values: tuple[np.ndarray, ...], first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values combined, in order and by doubling, with all before them from the row ``first`` on."""
    behind = np.arange(len(first)) - first
    reach = 1
    while (rows := np.nonzero(behind >= reach)[0]).size:
        new = step(tuple(v[rows - reach] for v in values), tuple(v[rows] for v in values))
        values = tuple(v.copy() for v in values)
        for v, x in zip(values, new, strict=True):
            v[rows] = x
        reach *= 2
    return values


def add(a: tuple, b: tuple) -> tuple:
    return (a[0] + b[0],)


def after(f: tuple, g: tuple) -> tuple:
    """The function f, then g."""
    return f[0] * g[0], g[0] * f[1] + g[1]


def latest(values: np.ndarray, here: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Of each row the value of the last row that is ``here``, from the row ``first`` on, else ``before``."""
    at = np.maximum.accumulate(np.where(here, np.arange(len(here)), -1))
    return np.where(at >= first, values[np.maximum(at, 0)], before)


def states(sums: np.ndarray, d: np.ndarray, scale: np.ndarray, first: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions after and before each fill. ``scale``: size of the last fill that had one; ``was``: before ``first``."""
    now = np.where(np.abs(sums) <= FLAT * scale, 0.0, sums)
    old = np.concatenate([[0.0], now[:-1]])
    return now, np.where(np.arange(len(d)) == first, was, old)


def costs(now: np.ndarray, old: np.ndarray, d: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cost after each fill as a function (r, a) of that before."""
    opens, grows, shrinks = now * old <= 0, d * old > 0, d * old < 0
    share = np.divide(np.abs(now), np.abs(old), out=np.ones_like(now), where=shrinks)
    return np.where(opens, 0.0, share), np.where(opens, np.abs(now) * price, np.where(grows, np.abs(d) * price, 0.0))


def firsts(batch: pa.RecordBatch, by: list[str], last: pa.RecordBatch | None) -> tuple[np.ndarray, bool]:
    """Of each row the first one of its series in the batch, and whether the series of the first row is that of ``last``."""
    row = pa.concat_batches([last, batch.select(by)]) if last is not None else batch.select(by)
    equal = np.ones(row.num_rows - 1, bool)
    for c in row.columns:
        a, b = c[1:], c[:-1]
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        equal &= pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)
    goes_on = last is not None and bool(equal[0])
    new = np.concatenate([[True], ~(equal[1:] if last is not None else equal)])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)), goes_on


def sweep(by: list[str]):
    """The pass over a range that is sorted by series and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, in_head = TaskContext.get().partitionId(), None, True
        total, scale, position, cost, place = 0.0, 0.0, 0.0, 0.0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            first, goes_on = firsts(batch, by, last)
            d, price = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__d", "__price"))
            start = goes_on & (first == 0)  # rows of the series that the last batch ended in
            head = start & in_head if last is not None else first == 0
            x = d.copy()
            x[0] += total if goes_on else 0.0
            (sums,) = running(add, (x,), first)
            sizes = latest(np.abs(d), d != 0, first, np.where(start, scale, 0.0))
            now, old = states(sums, d, sizes, first, np.where(start, position, 0.0))
            r, a = costs(now, old, d, price)
            a[0] += r[0] * cost if goes_on else 0.0
            _, after_ = running(after, (r, a), first)
            before = np.where(np.arange(len(d)) == first, np.where(start, cost, 0.0), np.concatenate([[0.0], after_[:-1]]))
            total, scale, position, cost = sums[-1], sizes[-1], now[-1], after_[-1]
            in_head, last = bool(head[-1]), batch.select(by).slice(batch.num_rows - 1)
            rest = [pa.array(v, pa.float64(), mask=head) for v in (now, old, after_, before)]
            seen = pa.array(sizes, pa.float64(), mask=sizes == 0)
            added = [pa.array(np.full(len(d), part, np.int32)), pa.array(place + np.arange(len(d))), pa.array(head), pa.array(sums), seen, *rest]
            place += len(d)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names_of(SWEPT)])

    return run


def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pass over heads, sorted by range and order, whose starts are known."""
    last, position, function = None, 0.0, (1.0, 0.0)
    for batch in batches:
        if not batch.num_rows:
            continue
        first, goes_on = firsts(batch, ["__part"], last)
        start = goes_on & (first == 0)
        d, price, sums, was = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__d", "__price", "__sum", "__was_sum"))
        scale, was_scale = (pc.fill_null(batch.column(c), 0.0).to_numpy(zero_copy_only=False) for c in ("__scale", "__was_scale"))
        at_start = np.where(np.abs(was) <= FLAT * was_scale, 0.0, was)
        now, old = states(was + sums, d, np.where(scale > 0, scale, was_scale), first, np.where(start, position, at_start))
        r, a = costs(now, old, d, price)
        if goes_on:
            r[0], a[0] = after(function, (r[0], a[0]))
        r, a = running(after, (r, a), first)
        fresh = np.arange(len(d)) == first
        r0 = np.where(fresh, np.where(start, function[0], 1.0), np.concatenate([[1.0], r[:-1]]))
        a0 = np.where(fresh, np.where(start, function[1], 0.0), np.concatenate([[0.0], a[:-1]]))
        last, position, function = batch.select(["__part"]).slice(batch.num_rows - 1), now[-1], (r[-1], a[-1])
        added = [pa.array(v, pa.float64()) for v in (now, old, r, a, r0, a0)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names_of(COMPOSED)])


def costs_at_start(parts: pa.Table) -> pa.Table:
    """Of one series that lies in several ranges, a row each, the cost at the start of each of its heads."""
    out, cost = [], 0.0
    for x in parts.sort_by("__part").to_pylist():
        if x["__head"]:
            out.append((x["__part"], cost))
            cost = x["__r"] * cost + x["__a"]
        else:
            cost = x["__cost"]
    numbers, starts = zip(*out, strict=True) if out else ((), ())
    return pa.table({"__part": pa.array(numbers, pa.int32()), "__start": pa.array(starts, pa.float64())})


def names_of(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]
