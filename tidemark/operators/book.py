"""Order books as tables of orders: state at an instant, levels, matching.

Events: ``seq, kind (open, change, done), order_id, side, price, size`` and the
columns of the book, ``by``. Sides are bid and ask.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import with_running
from tidemark.sources.shared import shared_path, written


def book_deltas(events: DataFrame) -> DataFrame:
    """Events that change a book."""
    return events.where(F.col("kind").isin("open", "change", "done"))


def trades_from_matches(events: DataFrame) -> DataFrame:
    """Matches as trades."""
    hits = events.where("kind = 'match'")
    return hits.select("source", "topic", "ts", F.col("trade_id").cast("string").alias("id"), "price", "size", "direction")


def episodes(events: DataFrame, by: list[str]) -> DataFrame:
    """Events with ``episode``, the opens of their order so far; an order's events before its first open go.

    An order is a short series, but a reused id may not be: opens are counted in
    buckets of the sequence.
    """
    opens = F.when(F.col("kind") == "open", F.lit(1))
    bucket = F.floor(F.col("seq") / F.lit(1 << 16))
    counted = with_running(book_deltas(events), [*by, "order_id"], ["seq"], {"episode": ("count", opens)}, bucket)
    return counted.where("episode > 0")


def book_at(events: DataFrame, by: list[str], at: Column | None = None) -> DataFrame:
    """Live orders after the events for which ``at`` holds: ``by, order_id, side, price, size, prio_seq``.

    An open of a live id replaces it; a change sets the size and sends the order
    to the back of its level's queue; done removes; events of unknown orders are
    ignored.
    """
    seen = events if at is None else events.where(at)
    last = Window.partitionBy(*by, "order_id")
    own = episodes(seen, by).withColumn("__last", F.max("episode").over(last)).where("episode = __last")
    queue = F.when(F.col("kind").isin("open", "change"), F.col("seq"))
    state = own.groupBy(*by, "order_id").agg(
        F.max_by("kind", "seq").alias("__kind"),
        F.max_by("side", F.when(F.col("kind") == "open", F.col("seq"))).alias("side"),
        F.max_by("price", F.when(F.col("kind") == "open", F.col("seq"))).alias("price"),
        F.max_by("size", F.when(F.col("size").isNotNull(), F.col("seq"))).alias("size"),
        F.max(queue).alias("prio_seq"),
        F.max(F.when(F.col("kind") == "done", F.lit(1))).alias("__done"),
    )
    return state.where("__done is null").drop("__kind", "__done")


def book_seed(snapshot: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """The book of a snapshot (open orders with its ``seq``) and the events after it."""
    base = snapshot.groupBy(*by).agg(F.max("seq").alias("__base"))
    later = events.join(base, by).where(F.col("seq") > F.col("__base")).drop("__base").dropDuplicates([*by, "seq"])
    opens = snapshot.withColumn("kind", F.lit("open"))
    return book_at(opens.unionByName(later, allowMissingColumns=True), by)


def level_depth(orders: DataFrame, by: list[str]) -> DataFrame:
    """Total size of each price level."""
    return orders.groupBy(*by, "side", "price").agg(F.sum("size").alias("qty"))


def top_levels(levels: DataFrame, by: list[str], depth: int) -> DataFrame:
    """The best ``depth`` levels of each side with their zero-based ``level``: asks rise, bids fall."""
    near = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    w = Window.partitionBy(*by, "side").orderBy(near)
    return levels.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= depth).withColumn("level", F.col("__rank") - 1).drop("__rank")


def ladder(orders: DataFrame, by: list[str], depth: int) -> DataFrame:
    """The depth ladder of a book."""
    return top_levels(level_depth(orders, by), by, depth)


def best_prices(levels: DataFrame, by: list[str]) -> DataFrame:
    """Best bid and ask, the spread (null if a side is empty), and whether they cross."""
    return levels.groupBy(*by).agg(
        F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("bid"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("ask")
    ).withColumns({"spread": F.col("ask") - F.col("bid"), "crossed": F.coalesce(F.col("bid") >= F.col("ask"), F.lit(False))})


def lifetimes(events: DataFrame, by: list[str]) -> DataFrame:
    """Stretches of sequence [lo, hi) in which an order stands with one size, for each order and size.

    One window over an order's events; those before its first open, and those after a done up to the next open, are
    no stretch.
    """
    w = Window.partitionBy(*by, "order_id").orderBy("seq")
    opens = F.col("kind") == "open"
    side, price = (F.last(F.when(opens, F.col(c)), ignorenulls=True).over(w) for c in ("side", "price"))
    opened, done = (F.max(F.when(F.col("kind") == k, F.col("seq"))).over(w) for k in ("open", "done"))
    spans = book_deltas(events).select(
        *by, "order_id", side.alias("side"), price.alias("price"), "size", opened.alias("opened"), done.alias("done"), F.col("seq").alias("lo"), F.lead("seq").over(w).alias("hi")
    )
    stands = F.col("opened").isNotNull() & (F.col("done").isNull() | (F.col("done") < F.col("opened")))
    return spans.where(stands & F.col("size").isNotNull()).drop("opened", "done")


#: Ticks whose ladders one group of ``ladder_at`` makes.
TICKS_TOGETHER = 64


def level_changes(events: DataFrame, by: list[str]) -> DataFrame:
    """``(by, seq, side, price, qty, orders)``: what events add to the size and the number of orders of each level.

    An order's stretch of one size is a change where it begins and one, of the other sign, where it ends; one that
    never ends is a single change.
    """
    size = F.col("size").cast("double")
    begins = F.struct(F.col("lo").alias("seq"), size.alias("qty"), F.lit(1).alias("orders"))
    ends = F.struct(F.col("hi").alias("seq"), (-size).alias("qty"), F.lit(-1).alias("orders"))
    both = F.when(F.col("hi").isNull(), F.array(begins)).otherwise(F.array(begins, ends))
    return lifetimes(events, by).select(*by, "side", "price", F.inline(both)).select(*by, "seq", "side", "price", "qty", "orders")


def ladder_at(events: DataFrame, ticks: DataFrame, by: list[str], depth: int, together: int = TICKS_TOGETHER) -> DataFrame:
    """The ladder of the book after each tick (``by, seq``), ``depth`` levels a side.

    Events are signed changes of their levels, summed up to the tick that first sees them. Ticks are taken ``together``
    in groups: a group's levels start with what all changes before it sum to, and each of its ticks shows the best that
    hold orders. So rows are a few an event, levels a group of ticks, and the result; an order that never ends is no
    more of them than one that does. A level stands as long as it holds orders, whatever rounding its size has.
    """
    schema = ", ".join(f"`{c}` {ticks.schema[c].dataType.simpleString()}" for c in by)
    schema += f", seq {ticks.schema['seq'].dataType.simpleString()}, side string, price double, qty double, level int"
    points = ticks.select(*by, "seq").distinct().withColumn("__tick", F.lit(1))
    both = level_changes(events, by).unionByName(points, allowMissingColumns=True).withColumn("__kind", F.coalesce("__tick", F.lit(0)))
    bucket = F.floor(F.col("seq") / F.lit(1 << 16))
    # a change is seen first by the tick of which as many are before it
    counted = with_running(both, by, ["seq", "__kind"], {"__n": ("count", F.col("__tick"))}, bucket, include_current=False)
    level = [*by, "side", "price"]
    sums = [F.sum("qty").alias("qty"), F.sum("orders").alias("orders")]
    # written once: a row a tick, and one for each level between two ticks that changes it
    tick = F.when(F.col("__tick") == 1, F.col("seq")).alias("seq")
    summed = written(counted.groupBy(*level, "__n", tick).agg(*sums), shared_path(events.sparkSession, "ladders"))
    changes = summed.where("seq is null").drop("seq")
    numbered = summed.where("seq is not null").select(*by, "__n", "seq")

    group = F.expr(f"__n DIV {together}")
    ends = numbered.groupBy(*by).agg(F.max(group).alias("__last"))
    of_group = changes.groupBy(*level, group.alias("__group")).agg(*sums)
    so_far = Window.partitionBy(*level).orderBy("__group")
    held = of_group.select(
        *level, "__group", F.lead("__group").over(so_far).alias("__next"), *[F.sum(c).over(so_far).alias(c) for c in ("qty", "orders")]
    )
    # what a level holds after a group's changes is what it starts with in the groups up to its next change
    held = held.where("orders > 0").join(ends, by)
    until = F.coalesce("__next", "__last")
    held = held.where(F.col("__group") < until).withColumn("__group", F.explode(F.sequence(F.col("__group") + 1, until)))
    opening = held.select(*level, "__group", (F.col("__group") * together - 1).alias("__n"), "qty", "orders")
    parts = opening.unionByName(changes.withColumn("__group", group)).unionByName(numbered.withColumn("__group", group), allowMissingColumns=True)
    return parts.groupBy(*by, "__group").applyInArrow(shown(by, depth, together), schema)


def shown(by: list[str], depth: int, together: int):
    """The ladders of one group of ticks, from its levels' sums at the start and their changes."""

    def run(rows: pa.Table) -> pa.Table:
        is_tick = pc.is_valid(rows.column("seq")).to_numpy()
        group = rows.column("__group")[0].as_py()
        column = rows.column("__n").to_numpy() - group * together + 1  # 0: at the start
        seqs = np.zeros(together + 1, np.int64)
        seen = np.zeros(together + 1, bool)
        seqs[column[is_tick]], seen[column[is_tick]] = rows.column("seq").filter(pa.array(is_tick)).to_numpy(), True
        of_levels = rows.filter(pa.array(~is_tick & (column <= together)))
        column = column[~is_tick & (column <= together)]
        ask = pc.equal(of_levels.column("side"), "ask").to_numpy(zero_copy_only=False)
        price = pc.cast(of_levels.column("price"), pa.float64()).to_numpy(zero_copy_only=False)
        # asks rise, bids fall
        levels, of = np.unique(np.stack([ask, np.where(ask, price, -price)], axis=1), axis=0, return_inverse=True)
        of = of.reshape(-1)
        table = []
        for c in ("qty", "orders"):
            sums = np.zeros((len(levels), together + 1))
            np.add.at(sums, (of, column), of_levels.column(c).to_numpy(zero_copy_only=False))
            table.append(np.cumsum(sums, axis=1))
        stands = (table[1] > 0) & seen
        asks = levels[:, 0] > 0
        rank = np.zeros(stands.shape, np.int64)
        for side in (asks, ~asks):
            rank[side] = np.cumsum(stands[side], axis=0) - 1
        at, tick = np.nonzero(stands & (rank < depth))
        keys = {c: pa.array([rows.column(c)[0].as_py()] * len(at), rows.schema.field(c).type) for c in by}
        sides, prices = np.where(asks[at], "ask", "bid"), np.where(asks[at], levels[at, 1], -levels[at, 1])
        found = {"seq": pa.array(seqs[tick], rows.schema.field("seq").type), "side": pa.array(sides.tolist(), pa.string()), "price": pa.array(prices)}
        return pa.table(keys | found | {"qty": pa.array(table[0][at, tick]), "level": pa.array(rank[at, tick].astype(np.int32))})

    return run


def match_orders(incoming: DataFrame, orders: DataFrame, by: list[str]) -> DataFrame:
    """Fills of incoming orders, each on its own, against the book's orders: best price, then queue order.

    ``incoming``: ``by, taker_id, side (buy, sell), size, limit (nullable)``.
    What stands in front of an order in the book is summed once. Incoming orders
    of one book, side, size and limit fill alike; how far down the queue they
    reach is found by sorting them among its orders, and places up to there are
    joined by equality: no row is made that is no fill.
    """
    near = F.when(F.col("side") == "ask", F.col("price")).otherwise(-F.col("price"))
    line = Window.partitionBy(*by, "side").orderBy(near, "prio_seq")
    before = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    queue = orders.withColumns({"before": before, "place": F.row_number().over(line) - 1})
    against = F.when(F.col("side") == "buy", "ask").otherwise("bid")
    wanted = incoming.select(*by, against.alias("side"), F.col("size").alias("want"), "limit").where("want is not null").distinct()

    marks = queue.select(*by, "side", F.col("before").alias("__sum"), F.col("price").alias("__price"), "place")
    asked = wanted.withColumns({"__sum": F.col("want"), "__price": F.col("limit")})
    side = Window.partitionBy(*by, "side")
    sums = side.orderBy("__sum", F.col("place").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rising, falling = (F.when(F.col("side") == s, F.col("__price")) for s in ("ask", "bid"))
    prices = side.orderBy(rising, falling.desc(), F.col("place").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asked.unionByName(marks, allowMissingColumns=True)
    both = both.withColumns({"__by_size": F.max("place").over(sums), "__by_price": F.max("place").over(prices)})
    last = F.when(F.col("limit").isNull(), F.col("__by_size")).when(F.col("__by_price").isNotNull(), F.least("__by_size", "__by_price"))
    reached = both.where("place is null").select(*by, "side", "want", "limit", last.alias("last")).where("last is not null")

    places = reached.withColumn("place", F.explode(F.sequence(F.lit(0), "last"))).drop("last")
    within = F.col("limit").isNull() | F.when(F.col("side") == "ask", F.col("price") <= F.col("limit")).otherwise(F.col("price") >= F.col("limit"))
    fill = F.least(F.col("size"), F.col("want") - F.col("before"))
    met = places.join(queue, [*by, "side", "place"]).where(within & (F.col("before") < F.col("want")))
    fills = met.select(*by, "side", "want", "limit", "order_id", "price", fill.alias("fill"))
    key = [F.col(f"i.{c}") == F.col(f"o.{c}") for c in by]
    same = [F.col("i.__against") == F.col("o.side"), F.col("i.size") == F.col("o.want"), F.col("i.limit").eqNullSafe(F.col("o.limit"))]
    pairs = incoming.withColumn("__against", against).alias("i").join(fills.alias("o"), [*key, *same])
    return pairs.select(*[F.col(f"i.{c}") for c in by], "taker_id", "order_id", F.col("o.price").alias("price"), F.col("fill").alias("size"))


def reconciled(book: DataFrame, snapshots: DataFrame, by: list[str], linger: str = "10 seconds") -> DataFrame:
    """What the latest snapshot of each book corrects: ``by, order_id, correction``.

    ``snapshots``: orders of snapshots (``by, ts, order_id``), of which the two
    latest count; ``book``: orders known (``by, order_id, ts, alive``), ts the
    time of their last event. An order in both snapshots that is not known, not
    even as gone, was ``missed``; a live one that the latest snapshot lacks, and
    that no event has touched for ``linger``, is ``lingering``.
    """
    times = snapshots.select(*by, "ts").distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts")))
    two = times.withColumn("__rank", rank).where("__rank <= 2")
    last = two.where("__rank = 1").select(*by, F.col("ts").alias("__now"))
    seen = snapshots.join(two, [*by, "ts"]).groupBy(*by, "order_id").agg(F.count_distinct("__rank").alias("__times"), F.min("__rank").alias("__newest"))
    key = [*by, "order_id"]
    missed = seen.where("__times = 2").join(book.select(*key), key, "left_anti").select(*key, F.lit("missed").alias("correction"))
    old = book.where("alive").join(last, by).where(F.col("ts") <= F.col("__now") - F.expr(f"INTERVAL {linger}"))
    return missed.unionByName(old.join(seen.where("__newest = 1"), key, "left_anti").select(*key, F.lit("lingering").alias("correction")))
