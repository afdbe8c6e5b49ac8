"""Depth ladders in long form (``by, side, price, qty``): walks, updates, differences, spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def toward(side: str = "side", price: str = "price") -> Column:
    """Order of levels from the best: asks rise, bids fall."""
    return F.when(F.col(side) == "ask", F.col(price)).otherwise(-F.col(price))


def cumulative(levels: DataFrame, by: list[str]) -> DataFrame:
    """Levels with the quantity and the cost of all better ones, ``q0`` and ``c0``."""
    w = Window.partitionBy(*by, "side").orderBy(toward()).rowsBetween(Window.unboundedPreceding, -1)
    return levels.withColumns(
        {"q0": F.coalesce(F.sum("qty").over(w), F.lit(0.0)), "c0": F.coalesce(F.sum(F.col("price") * F.col("qty")).over(w), F.lit(0.0))}
    )


def walk_depth(orders: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """Fills of orders against a ladder, best levels first, each order on its own.

    ``orders``: ``by, order_id, side (buy, sell), size or funds, limit``. Funds
    only buy and take no limit; a limit stops at the first worse price. Levels
    are accumulated once a ladder, not once an order.
    """
    against = F.when(F.col("i.side") == "buy", "ask").otherwise("bid")
    within = F.col("i.limit").isNull() | F.when(F.col("i.side") == "buy", F.col("l.price") <= F.col("i.limit")).otherwise(F.col("l.price") >= F.col("i.limit"))
    key = [F.col(f"i.{c}") == F.col(f"l.{c}") for c in by]
    # only levels that an order reaches
    reached = F.when(F.col("i.size").isNotNull(), F.col("l.q0") < F.col("i.size")).otherwise(F.col("l.c0") < F.col("i.funds"))
    pairs = orders.alias("i").join(cumulative(levels, by).alias("l"), [*key, F.col("l.side") == against, within, reached])
    by_size = F.least(F.col("l.qty"), F.col("i.size") - F.col("l.q0"))
    by_funds = F.least(F.col("l.qty"), (F.col("i.funds") - F.col("l.c0")) / F.col("l.price"))
    fill = F.when(F.col("i.size").isNotNull(), by_size).when(F.col("i.side") == "buy", by_funds)
    named = [F.col(f"i.{c}") for c in by]
    return pairs.select(*named, "order_id", F.col("i.side").alias("side"), F.col("l.price").alias("price"), fill.alias("size")).where("size > 0")


def fill_summary(orders: DataFrame, fills: DataFrame, by: list[str], fee: Column | None = None) -> DataFrame:
    """Of each order: filled size, cost, average price, fee, and what stays unfilled (of its size, or of its funds)."""
    sums = fills.groupBy(*by, "order_id").agg(
        F.sum("size").alias("filled"), F.sum(F.col("price") * F.col("size")).alias("cost")
    )
    out = orders.join(sums, [*by, "order_id"], "left").fillna({"filled": 0.0, "cost": 0.0})
    rest = F.when(F.col("size").isNotNull(), F.col("size") - F.col("filled")).otherwise(F.col("funds") - F.col("cost"))
    return out.select(
        *by,
        "order_id",
        "filled",
        "cost",
        (F.col("cost") / F.when(F.col("filled") > 0, F.col("filled"))).alias("vwap"),
        (F.col("cost") * (fee if fee is not None else F.lit(0.0))).alias("fee"),
        rest.alias("unfilled"),
    )


def update_levels(levels: DataFrame, deltas: DataFrame, by: list[str]) -> DataFrame:
    """A ladder after deltas (``seq``, quantity 0 removes a level)."""
    base = levels.withColumn("seq", F.lit(None).cast("long")).unionByName(deltas.select(*levels.columns, "seq"))
    last = base.groupBy(*by, "side", "price").agg(F.max_by("qty", F.coalesce("seq", F.lit(-(1 << 62)))).alias("qty"))
    return last.where("qty <> 0")


def ladder_diff(before: DataFrame, after: DataFrame, by: list[str], only_changed: bool = True) -> DataFrame:
    """Deltas from one ladder to the next: levels gone with quantity 0, the others with their new one."""
    key = [*by, "side", "price"]
    both = before.withColumnRenamed("qty", "__old").join(after.withColumnRenamed("qty", "__new"), key, "full_outer")
    kept = both.where(F.col("__new").isNull() | F.col("__old").isNull() | (F.col("__new") != F.col("__old"))) if only_changed else both
    return kept.select(*key, F.coalesce("__new", F.lit(0.0)).alias("qty"))


def ladder_convert(levels: DataFrame, price: Column, keep_value: bool = False) -> DataFrame:
    """Levels at new prices; ``keep_value`` rescales quantities so that price times quantity stays."""
    qty = F.col("qty") * F.col("price") / F.col("__price") if keep_value else F.col("qty")
    moved = levels.withColumn("__price", price).withColumn("qty", qty).withColumn("price", F.col("__price"))
    by = [c for c in levels.columns if c != "qty"]
    return moved.groupBy(*by).agg(F.sum("qty").alias("qty"))


def quantity_at(levels: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """Quantity at exact prices (``by, price``): asks first, then bids; none is 0."""
    sums = levels.groupBy(*by, "price").agg(
        F.coalesce(F.max(F.when(F.col("side") == "ask", F.col("qty"))), F.max(F.when(F.col("side") == "bid", F.col("qty")))).alias("qty")
    )
    return wanted.join(sums, [*by, "price"], "left").fillna({"qty": 0.0})


def ladder_spread(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """The ladder of left minus right: asks are left asks less right bids, bids left bids less right asks.

    Both sides are laid out by cumulative quantity, in exact decimals of 18
    digits behind the point; where two levels overlap there is a level of the
    price difference with the overlap's length. Equal differences are one.
    Levels without quantity are none.
    """
    exact = "decimal(38,18)"

    def laid(levels: DataFrame, flip: bool, name: str) -> DataFrame:
        """``(by, side, at, name)``: the price from a cumulative quantity on, null from the end on."""
        side = F.when(F.col("side") == "ask", "bid").otherwise("ask") if flip else F.col("side")
        q = F.col("qty").cast(exact)
        w = Window.partitionBy(*by, "side").orderBy(toward()).rowsBetween(Window.unboundedPreceding, -1)
        rows = levels.withColumn("__q", q).where("__q > 0")
        rows = rows.withColumn("at", F.coalesce(F.sum("__q").over(w), F.lit(0)).cast(exact))
        rows = rows.select(*by, side.alias("side"), "at", "__q", F.struct("price").alias(name))
        ends = rows.groupBy(*by, "side").agg(F.sum("__q").cast(exact).alias("at")).withColumn(name, F.struct(F.lit(None).cast("double").alias("price")))
        return rows.drop("__q").unionByName(ends)

    marks = laid(left, False, "a").unionByName(laid(right, True, "b"), allowMissingColumns=True)
    marks = marks.groupBy(*by, "side", "at").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    w = Window.partitionBy(*by, "side").orderBy("at")
    stands = {f"__{c}": F.last(c, ignorenulls=True).over(w) for c in ("a", "b")}
    spans = marks.withColumns(stands | {"__next": F.lead("at").over(w)})
    levels = spans.select(*by, "side", (F.col("__a.price") - F.col("__b.price")).alias("price"), (F.col("__next") - F.col("at")).alias("qty"))
    return levels.where("price is not null and qty > 0").groupBy(*by, "side", "price").agg(F.sum("qty").cast("double").alias("qty"))


def as_parts(levels: DataFrame, by: list[str]) -> DataFrame:
    """Packed ladders: an array of (price, qty) for each side, best first."""
    row = F.struct(toward().alias("o"), "price", "qty")

    def side(name: str) -> Column:
        packed = F.array_sort(F.collect_list(F.when(F.col("side") == name, row)))
        return F.transform(packed, lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty"))).alias(f"{name}s")

    return levels.groupBy(*by).agg(side("ask"), side("bid"))


def from_parts(packed: DataFrame, by: list[str]) -> DataFrame:
    """Packed ladders in long form again."""
    sides = [packed.select(*by, F.lit(s).alias("side"), F.inline(f"{s}s")) for s in ("ask", "bid")]
    return sides[0].unionByName(sides[1])


def ladder_or_book(ladders: DataFrame, from_books: DataFrame, by: list[str]) -> DataFrame:
    """Recorded ladders, and for series that have none those derived from their books."""
    missing = from_books.join(ladders.select(*by).distinct(), by, "left_anti")
    return ladders.unionByName(missing)
