"""Chains of markets: the shortest from every currency to one, and what they are worth at any time.

Equal and pegged currencies, on whatever exchange, convert at no cost. They are
contracted to classes first, pegs of pegs included, so that a search over
classes sees markets only, each of which is one hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.sources.shared import shared_path, written

#: Currencies held equal.
PEGS = [("usd", "usdt"), ("usd", "usdc"), ("usd", "dai"), ("usd", "tusd"), ("usd", "bitusd"), ("btc", "xbt")]

#: Hops that one job searches.
HOPS_TOGETHER = 4


def peg_classes(pegs: list[tuple[str, str]] = PEGS) -> dict[str, str]:
    """The class of each pegged currency, named after its first member: what pegs connect, over however many steps."""
    classes = {c: c for pair in pegs for c in pair}
    changed = True
    while changed:
        changed = False
        for a, b in pegs:
            first = min(classes[a], classes[b])
            for c in (a, b):
                changed |= classes[c] != first
                classes[c] = first
    return classes


def class_of(currency: Column, pegs: list[tuple[str, str]] = PEGS) -> Column:
    """The class of a currency; one without peg is a class by itself."""
    if not pegs:
        return currency
    table = F.create_map(*[F.lit(x) for item in sorted(peg_classes(pegs).items()) for x in item])
    return F.coalesce(F.try_element_at(table, currency), currency)


def conversion_chains(markets: DataFrame, target: str, pegs: list[tuple[str, str]] = PEGS) -> DataFrame:
    """``(asset, rate, n_hops, path, steps)``: the chain of fewest ``markets(exchange, base, quote, price)`` from every
    asset to ``target``.

    Of chains as short the first by path, as text, counts, and among markets of one pair that of the first exchange.
    All currencies of a class have the rate of its chain: an asset that its market does not name stands before it with
    ``=`` in the path. ``steps`` are the chain's markets, ``inverse`` where a quote is turned into a base. Markets
    without a price above zero and between equal currencies are left out, as are assets that can't be reached.

    A hop joins each class's best chain with the markets into it; a few hops are one job whose result is written, so
    the plan doesn't grow with the chains. The search ends when the last hop of a job reached nothing new.
    """
    spark = markets.sparkSession
    folder = shared_path(spark, "chains")
    on = markets.where("price > 0")

    def turned(src: str, dst: str, rate: Column, inverse: bool) -> DataFrame:
        step = F.struct("exchange", "base", "quote", F.lit(inverse).alias("inverse"))
        return on.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.struct(rate.cast("double").alias("rate"), step.alias("step")).alias("by"))

    ways = turned("base", "quote", F.col("price"), False).unionByName(turned("quote", "base", 1 / F.col("price"), True))
    ways = ways.groupBy("src", "dst").agg(F.min_by("by", "by.step").alias("by"))
    ways = ways.select(class_of(F.col("src"), pegs).alias("from"), class_of(F.col("dst"), pegs).alias("into"), "src", "dst", "by")
    ways = written(ways.where(F.col("from") != F.col("into")), f"{folder}/ways")

    named = spark.createDataFrame([(c,) for c in sorted({target, *(x for pair in pegs for x in pair)})], "asset string")
    assets = ways.select(F.col("src").alias("asset")).union(named).distinct().withColumn("class", class_of(F.col("asset"), pegs))
    # a chain may stay where it is, so that a hop keeps what was found before
    stay = assets.select(F.col("class").alias("from"), F.col("class").alias("into")).distinct()
    moves = written(ways.unionByName(stay, allowMissingColumns=True), f"{folder}/moves")

    kind = "struct<n_hops: int, path: string, asset: string, rate: double, steps: array<struct<exchange: string, base: string, quote: string, inverse: boolean>>>"
    start = F.struct(F.lit(0), F.lit(target), F.lit(target), F.lit(1.0), F.array()).cast(kind)
    found = spark.range(1).select(class_of(F.lit(target), pegs).alias("into"), start.alias("best"))
    rest = F.when(F.col("dst") == F.col("best.asset"), F.col("best.path")).otherwise(F.concat("dst", F.lit("="), "best.path"))
    longer = F.struct(
        (F.col("best.n_hops") + 1).alias("n_hops"), F.concat("src", F.lit(">"), rest).alias("path"), F.col("src").alias("asset"),
        (F.col("by.rate") * F.col("best.rate")).alias("rate"), F.concat(F.array("by.step"), "best.steps").alias("steps"),
    ).cast(kind)
    hops = 0
    while True:
        for _ in range(HOPS_TOGETHER):
            reached = found.join(moves, "into").select("from", F.when(F.col("src").isNull(), F.col("best")).otherwise(longer).alias("best"))
            found = reached.groupBy(F.col("from").alias("into")).agg(F.min_by("best", F.struct("best.n_hops", "best.path")).alias("best"))
        hops += HOPS_TOGETHER
        found = written(found, f"{folder}/hops={hops}")
        if found.where(F.col("best.n_hops") == hops).isEmpty():
            break
    path = F.when(F.col("asset") == F.col("best.asset"), F.col("best.path")).otherwise(F.concat("asset", F.lit("="), "best.path"))
    of_all = assets.join(found, assets["class"] == found["into"])
    return of_all.select("asset", "best.rate", "best.n_hops", path.alias("path"), "best.steps")


def rates_as_of(points: DataFrame, chains: DataFrame, prices: DataFrame) -> DataFrame:
    """``(asset, ts, rate)`` of distinct ``points(asset, ts)``: the product of the prices, turned over where the chain
    goes from quote to base, that each market of the asset's chain has at that time.

    ``prices(exchange, base, quote, ts, price)``: a market's latest price at or before a time counts. The rate is null
    as long as a market of the chain has none, and for assets without a chain.
    """
    asked = points.select("asset", "ts").distinct()
    steps = asked.join(chains.select("asset", "n_hops", "steps"), "asset", "left")
    steps = steps.select("asset", "ts", "n_hops", F.explode_outer("steps").alias("step")).select("asset", "ts", "n_hops", "step.*")
    market = ["exchange", "base", "quote"]
    priced = asof_join(steps, prices.select(*market, "ts", "price").where("price > 0"), market, "price")
    factor = F.when(F.col("inverse"), 1 / F.col("price")).otherwise(F.col("price"))
    rates = priced.groupBy("asset", "ts", "n_hops").agg(F.product(factor).alias("rate"), F.count("price").alias("known"))
    rate = F.when(F.col("n_hops") == 0, 1.0).when(F.col("known") == F.col("n_hops"), F.col("rate"))
    return rates.select("asset", "ts", rate.alias("rate"))
