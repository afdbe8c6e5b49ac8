"""Portfolios: settling fills, balances over time, positions, profit, equity, execution cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.chains import rates_as_of
from tidemark.operators.running import null_safe_join
from tidemark.sources.shared import shared_path, written

#: Maker and taker fee of each exchange.
FEES = [("coinbase", 0.0, 0.003), ("bitstamp", 0.0005, 0.0005), ("bitfinex", 0.001, 0.002)]

#: Changes of an account beyond which its history is cut by year.
LONG_HISTORY = 100_000

#: Places of a history whose balances are laid out together.
PLACES_TOGETHER = 64


def fees(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEES, "exchange string, maker double, taker double")


def with_fees(rows: DataFrame) -> DataFrame:
    """Rows with the ``maker`` and ``taker`` fee of their exchange, null for unknown ones."""
    return rows.join(F.broadcast(fees(rows.sparkSession)), "exchange", "left")  # a row an exchange, fixed


def moves(base: Column, quote: Column) -> Column:
    """The two legs of a fill, an array of ``asset`` and ``delta``: a buy adds the base and costs size * price / (1 - fee) of
    the quote, a sell takes the base and brings size * price * (1 - fee)."""
    value = F.col("size") * F.col("price")
    buys = F.col("side") == "buy"
    base_leg = F.struct(base.alias("asset"), F.when(buys, F.col("size")).otherwise(-F.col("size")).alias("delta"))
    quote_leg = F.struct(quote.alias("asset"), F.when(buys, -value / (1 - F.col("fee"))).otherwise(value * (1 - F.col("fee"))).alias("delta"))
    return F.array(base_leg, quote_leg)


def legs(fills: DataFrame, base: Column, quote: Column) -> DataFrame:
    """Two rows a fill, ``asset`` and ``delta``."""
    return fills.select("*", F.inline(moves(base, quote)))


def settle(fills: DataFrame, by: list[str], base: Column, quote: Column) -> DataFrame:
    """Change of each account's balances over all its fills."""
    return legs(fills, base, quote).groupBy(*by, "asset").agg(F.sum("delta").alias("delta"))


def running_balance(fills: DataFrame, by: list[str], base: Column, quote: Column, order: list[str]) -> DataFrame:
    """Balance of each account and asset after every fill that touches it; long histories are cut by year.

    What a year starts with is a row before its first, so that fills, with all their columns, are dealt out once.
    """
    rows = legs(fills, base, quote).withColumns({"__year": F.year(order[0]), "__opens": F.lit(0)})
    key = [*by, "asset"]
    w = Window.partitionBy(*key).orderBy("__year")
    sums = rows.groupBy(*key, "__year").agg(F.sum("delta").alias("delta"))
    opens = sums.select(*key, F.lead("__year").over(w).alias("__year"), F.sum("delta").over(w).alias("delta"), F.lit(1).alias("__opens"))
    within = Window.partitionBy(*key, "__year").orderBy(F.desc("__opens"), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(opens.where("__year is not null"), allowMissingColumns=True)
    summed = both.withColumn("balance", F.coalesce(F.sum("delta").over(within), F.lit(0)))
    return summed.where("__opens = 0").drop("__year", "__opens")


def pnl(size: Column, entry: Column, price: Column) -> Column:
    """Profit of a position at a price."""
    return size * (price - entry)


def close_positions(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Profit of closing ``positions(exchange, symbol, size, entry_price, settled_in)`` at ``prices(exchange,
    symbol, price)``, credited to the settlement asset."""
    gain = pnl(F.col("size"), F.col("entry_price"), F.col("price"))
    closed = positions.join(prices, ["exchange", "symbol"])
    return closed.groupBy("exchange", F.col("settled_in").alias("asset")).agg(F.sum(gain).alias("delta"))


def merge(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Both tables by key; where both have one, b's value."""
    both = a.withColumnRenamed(value, "__a").join(b.withColumnRenamed(value, "__b"), key, "full_outer")
    return both.select(*key, F.coalesce("__b", "__a").alias(value))


def difference(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows of a whose key and value are not in b."""
    return a.join(b.select(*key, value), [*key, value], "left_anti")


def without_exchange(rows: DataFrame, exchange: str) -> DataFrame:
    return rows.where(F.col("exchange") != exchange)


def equity(balances: DataFrame, rates: DataFrame, by: list[str], positions: DataFrame | None = None) -> DataFrame:
    """Value of balances (``by, asset, qty``) at ``rates(asset, rate)`` and of the profit of open positions (``by,
    asset, size, entry_price, price``; asset: what they settle in). Assets without rate count nothing. Losses keep their sign."""
    held = balances.select(*by, "asset", "qty")
    if positions is not None:
        profit = pnl(F.col("size"), F.col("entry_price"), F.col("price")).cast("double")
        held = held.withColumn("qty", F.col("qty").cast("double")).unionByName(positions.select(*by, "asset", profit.alias("qty")))
    return held.join(rates.select("asset", "rate"), "asset").groupBy(*by).agg(F.sum(F.col("qty") * F.col("rate")).alias("equity"))


def yearly(changes: DataFrame, by: list[str], long: int) -> DataFrame:
    """``changes`` (``__moves``) with the ``__year`` by which histories of more than ``long`` are cut, null for all others, and at
    each start of a year what a cut one holds of each asset by then, ``__opens``.

    What is done within (by, year) needs no other rows.
    """
    # a row an account of many changes, written, so that its size is known when the plan is made
    many = written(changes.groupBy(*by).count().where(F.col("count") > long).select(*by), shared_path(changes.sparkSession, "long"))
    cut = changes.alias("l").join(many.withColumn("__cut", F.lit(True)).alias("r"), [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], "left")
    rows = cut.select("l.*", F.when(F.col("__cut"), F.year("ts")).alias("__year"))
    sums = rows.where("__year is not null").select(*by, "__year", F.inline("__moves")).groupBy(*by, "asset", "__year").agg(F.sum("delta").alias("delta"))
    w = Window.partitionBy(*by, "asset").orderBy("__year")
    last = F.max("__year").over(Window.partitionBy(*by))
    held = sums.select(*by, "asset", "__year", F.sum("delta").over(w).alias("delta"), F.coalesce(F.lead("__year").over(w), last).alias("__until"))
    opens = held.where("__until > __year").select(*by, F.explode(F.sequence(F.col("__year") + 1, F.col("__until"))).alias("__year"), F.array(F.struct("asset", "delta")).alias("__moves"))
    return rows.withColumn("__opens", F.lit(False)).unionByName(opens.withColumn("__opens", F.lit(True)), allowMissingColumns=True)


def times_asked(changes: DataFrame, by: list[str]) -> DataFrame:
    """Distinct ``(asset, ts)`` at which ``changes`` (``__moves``) need a rate: those of the assets that an account held by then.

    Where all assets at all times since their first are no more rows than the changes, these are asked for: accounts need not be looked at.
    """
    moved = changes.select(*by, "ts", F.explode("__moves.asset").alias("asset"))
    n, times, assets, last = moved.agg(F.count("*"), F.approx_count_distinct("ts"), F.approx_count_distinct("asset"), F.max(F.year("ts"))).first()
    if times * assets <= n:
        since = moved.groupBy("asset").agg(F.min("ts").alias("__from"))
        since = since.withColumn("__year", F.explode(F.sequence(F.year("__from"), F.lit(last))))
        asked = changes.select("ts", F.year("ts").alias("__year")).distinct().join(since, "__year")
    else:
        since = moved.groupBy(*by, "asset").agg(F.min("ts").alias("__from"))
        asked = null_safe_join(changes.select(*by, "ts").distinct(), since, by)
    return asked.where(F.col("ts") >= F.col("__from")).select("asset", "ts").distinct()


def equity_curve(
    changes: DataFrame, prices: DataFrame, by: list[str], order: list[str], chains: DataFrame | None = None
) -> DataFrame:
    """Equity of each account after every change (``asset, delta, ts``) of a balance; a row may hold several as ``moves``.

    Each asset is valued at its latest price (``asset, ts, price``), at nothing
    before its first; the currency of account needs a price of 1. With
    ``chains``, as ``conversion_chains`` finds them, ``prices`` are those of
    markets, and an asset is valued at the product of its chain's latest prices,
    at nothing before the first of each. Changes of one place in ``order`` count
    together. A change is valued over the assets that its account has held so
    far, which are few; no tick is joined with the accounts that hold its asset.

    Changes are dealt out once, by account, and by year too where a history is
    long. Rows of places and assets, many times the changes, are neither
    shuffled nor sorted where the rates are few enough to be sent to all: a
    balance stands from a change to the next, and is laid over the places of
    its block only to be valued and summed.
    """
    spark = changes.sparkSession
    part = [*by, "__year"]
    each = F.col("moves") if "moves" in changes.columns else F.array(F.struct("asset", F.col("delta").cast("double").alias("delta")))
    known = changes.select(*by, *dict.fromkeys(["ts", *order]), each.alias("__moves")).where("ts is not null and size(__moves) > 0")
    known = written(known, shared_path(spark, "changes"))
    asked = times_asked(known, by)
    rates = asof_join(asked, prices, ["asset"], "price") if chains is None else rates_as_of(asked, chains, prices).withColumnRenamed("rate", "price")
    # a row an asset and time, often few enough to be sent to all
    rates = written(rates.select("asset", "ts", "price"), shared_path(spark, "rates"))

    # places are numbered from the last, so that what nothing follows stands until 1
    along = Window.partitionBy(*part).orderBy("__opens", *[F.desc(c) for c in order])
    n, new = F.dense_rank().over(along), F.rank().over(along) == F.row_number().over(along)
    dealt = yearly(known, by, LONG_HISTORY).repartition(*part).select("*", n.alias("__n"), new.alias("__new"))
    at = F.col("ts") if "ts" in order else F.min("ts").over(Window.partitionBy(*part, "__n"))
    dealt = dealt.select(*part, "__n", "__moves", F.when(F.col("__new"), F.struct("__n", at.alias("ts"), F.struct(*order).alias("at"))).alias("__place"))
    dealt = dealt.select(*part, "__n", "__place", F.posexplode("__moves").alias("__i", "__move"))
    dealt = dealt.select(*part, "__n", "__move.asset", "__move.delta", F.when(F.col("__i") == 0, F.col("__place")).alias("__place"))
    own = Window.partitionBy(*part, "asset").orderBy(F.desc("__n"))
    held = F.coalesce(F.sum("delta").over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0.0))
    stands = dealt.withColumns({"__held": held, "__end": F.coalesce(F.lead("__n").over(own) + 1, F.lit(1))})

    def block_of(place: Column) -> Column:
        return F.floor((place - 1) / PLACES_TOGETHER).cast("int")

    first, block = block_of(F.col("__n")), F.col("__block")
    stands = stands.withColumn("__block", F.explode(F.sequence(first, block_of(F.least("__end", "__n")))))
    lo, hi = F.greatest(F.col("__end"), block * PLACES_TOGETHER + 1), F.least(F.col("__n"), (block + 1) * PLACES_TOGETHER)
    here = F.struct("asset", F.col("__held").alias("held"), (lo - block * PLACES_TOGETHER).alias("lo"), (hi - lo + 1).alias("size"))
    cut = stands.select(*part, "__block", here.alias("__here"), F.when(block == first, F.col("__place")).alias("__place"))
    # of several changes of an asset in one place the last stands, and the others have no size
    here = F.collect_list(F.when(F.col("__here.size") > 0, F.col("__here"))).alias("__here")
    blocks = cut.groupBy(*part, "__block").agg(here, F.sort_array(F.collect_list("__place")).alias("__places"))
    laid = blocks.select(*part, "__places", F.inline("__here"))
    laid = laid.select(*part, "asset", "held", F.explode(F.slice("__places", F.col("lo"), F.col("size"))).alias("__place"))
    laid = laid.select(*part, "asset", "held", "__place.ts", F.col("__place.at").alias("__at")).where("ts is not null")
    valued = laid.join(rates, ["asset", "ts"], "left")
    out = valued.groupBy(*part, "__at").agg(F.sum(F.col("held") * F.coalesce("price", F.lit(0.0))).alias("equity"))
    return out.select(*by, *[F.col(f"__at.{c}").alias(c) for c in order], "equity")


def steps_before(grid: Column, ts: Column) -> Column:
    """How many times of ``grid``, an ascending array, are before ``ts``, by halving what is left of it."""
    halves = F.sequence(F.floor(F.log2(F.greatest(F.size(grid), F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))

    def further(at: Column, half: Column) -> Column:
        there = at + F.pow(F.lit(2), half).cast("int")
        return F.when((there <= F.size(grid)) & (F.get(grid, there - 1) < ts), there).otherwise(at)

    return F.aggregate(halves, F.lit(0), further)


def portfolio_history(changes: DataFrame, by: list[str], grid: Column) -> DataFrame:
    """Balances of every account and asset at each step of ``grid``, an array of times such as ``tick_grid`` gives, from its first change on.

    Changes are summed by the first step that sees them; what goes through the
    running sum is a row a step, account and asset, not a row a change.
    """
    key = [*by, "asset"]
    placed = changes.withColumn("__grid", F.sort_array(F.array_compact(grid))).where("ts is not null")
    placed = placed.withColumn("__step", steps_before(F.col("__grid"), F.col("ts"))).where("__step < size(__grid)")
    sums = placed.groupBy(*key, "__step").agg(F.sum("delta").alias("__sum"))
    w = Window.partitionBy(*key).orderBy("__step")
    held = sums.select(*key, "__step", F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("qty"), F.lead("__step").over(w).alias("__next"))
    # a balance stands until the step that sees the next change
    held = held.withColumn("__grid", F.sort_array(F.array_compact(grid)))
    stands = F.slice("__grid", F.col("__step") + 1, F.coalesce("__next", F.size("__grid")) - F.col("__step"))
    return held.select(*key, F.explode(stands).alias("ts"), "qty")


def equity_history(changes: DataFrame, prices: DataFrame, by: list[str], grid: Column) -> DataFrame:
    """Equity of every account at each step of ``grid``, assets at their latest prices (nothing before the first)."""
    valued = asof_join(portfolio_history(changes, by, grid), prices, ["asset"], "price")
    return valued.groupBy(*by, "ts").agg(F.sum(F.col("qty") * F.coalesce("price", F.lit(0.0))).alias("equity"))


def transactions(trades: DataFrame, deposits: DataFrame, withdrawals: DataFrame, start, exchange: str | None = None) -> DataFrame:
    """Trades, deposits and withdrawals since ``start``, in order of time."""
    kinds = (("trade", trades), ("deposit", deposits), ("withdraw", withdrawals))
    out = None
    for kind, df in kinds:
        rows = df.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    out = out.where(F.col("ts") >= F.lit(start))
    return (out.where(F.col("exchange") == exchange) if exchange else out).orderBy("ts", "kind")


def order_targets(targets: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """What each target asks for: ``post`` when new, ``none`` when equal to the one mounted, else ``replace``."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    same = F.col("price").eqNullSafe(F.lag("price").over(w)) & F.col("size").eqNullSafe(F.lag("size").over(w))
    return targets.withColumn("action", F.when(first, "post").when(same, "none").otherwise("replace"))


def latest_accounts(snapshots: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of the latest snapshot of every exchange but those that failed to load."""
    last = snapshots.groupBy("exchange").agg(F.max("snapshot").alias("snapshot"))
    newest = snapshots.join(last, ["exchange", "snapshot"])
    return newest.join(failed.select("exchange").distinct(), "exchange", "left_anti")


def order_links(received: DataFrame, opened: DataFrame, done: DataFrame) -> DataFrame:
    """Client id, exchange id and target of orders that are not done."""
    known = received.select("client_oid", "order_id", "target").join(opened.select("order_id").distinct(), "order_id", "left_semi")
    return known.join(done.select("order_id").distinct(), "order_id", "left_anti")


def execution_cost(orders: DataFrame, ladders: DataFrame, prices: DataFrame, by: list[str], latency: str, taker: Column) -> DataFrame:
    """What orders ``(by, order_id, ts, side, size or funds, limit)`` would have cost.

    An order takes effect ``latency`` after its time: against the latest ladder
    (``by, ts, side, price, qty``) there is by then, else at the last price.
    Funds are reduced by the taker fee before they buy; what is filled pays it.
    Of ladders and prices only those are looked at that some order names.
    """
    from tidemark.operators.ladder import fill_summary, walk_depth

    # written, so that its size is known when the plan is made: a small one goes below the sums of ladders and prices
    named = written(orders.select(*by).distinct(), shared_path(orders.sparkSession, "named"))
    ladders, prices = (rows.join(named, by, "left_semi") for rows in (ladders, prices))
    due = orders.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {latency}")).withColumn("funds", F.col("funds") * (1 - taker))
    stamps = ladders.select(*by, "ts").distinct().withColumn("ladder_ts", F.col("ts"))
    placed = asof_join(asof_join(due, stamps, by, "ladder_ts"), prices, by, "price").drop("ladder_ts_ts", "price_ts")
    key = [*by, "ladder_ts"]
    walked = walk_depth(placed.where("ladder_ts is not null"), ladders.withColumnRenamed("ts", "ladder_ts"), key)
    buys = F.col("side") == "buy"
    within = F.col("limit").isNull() | F.when(buys, F.col("price") <= F.col("limit")).otherwise(F.col("price") >= F.col("limit"))
    size = F.when(F.col("size").isNotNull(), F.col("size")).when(buys, F.col("funds") / F.col("price"))
    direct = placed.where("ladder_ts is null and price is not null").where(within).select(*by, "ladder_ts", "order_id", "side", "price", size.alias("size")).where("size > 0")
    fills = walked.unionByName(direct).drop("ladder_ts")
    return fill_summary(placed, fills, by, taker)
