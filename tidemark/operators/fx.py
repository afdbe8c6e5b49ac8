"""Currency conversion: pegs, markets, composed rates, cheapest chains of markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import round_half_down
from tidemark.operators.chains import conversion_chains, peg_classes

#: Decimal digits of base and quote amounts by pair, first match; * is any.
PRECISION = [("eur", "usd", 5, 5), ("xrp", "eur", 8, 5), ("xrp", "usd", 8, 5), ("*", "usd", 8, 2), ("*", "eur", 8, 2), ("*", "*", 8, 8)]


def digits(base: Column, quote: Column, of_quote: bool) -> Column:
    """Decimal digits that amounts of a pair's base, or quote, are kept to."""
    out = F.lit(8)
    for b, q, base_digits, quote_digits in reversed(PRECISION):
        hit = (F.lit(b == "*") | (base == b)) & (F.lit(q == "*") | (quote == q))
        out = F.when(hit, F.lit(quote_digits if of_quote else base_digits)).otherwise(out)
    return out


def rounded(amount: Column, base: Column, quote: Column, of_quote: bool) -> Column:
    """An amount at its pair's precision, halves toward zero."""
    return round_half_down(amount, digits(base, quote, of_quote))


def reversed_quote(quotes: DataFrame) -> DataFrame:
    """Best prices of a pair seen from the other side: bid and ask change places."""
    swap = {"bid_price": "ask_price", "ask_price": "bid_price", "bid_qty": "ask_qty", "ask_qty": "bid_qty"}
    return quotes.select(*[F.col(swap.get(c, c)).alias(c) for c in quotes.columns])


def peg_equivalents(assets: DataFrame, column: str = "security") -> DataFrame:
    """Each asset with itself and all that pegs, over however many steps, hold it equal to: ``equal_to``."""
    classes = peg_classes()
    equal = {c: sorted(x for x in classes if classes[x] == classes[c]) for c in classes}
    table = F.create_map(*[x for c, group in sorted(equal.items()) for x in (F.lit(c), F.array(*map(F.lit, group)))])
    return assets.withColumn("equal_to", F.explode(F.coalesce(F.try_element_at(table, F.col(column)), F.array(column))))


def find_market(wanted: DataFrame, instruments: DataFrame) -> DataFrame:
    """``wanted(exchange, base, quote)`` with the symbol whose security is base and that settles in quote."""
    found = instruments.select("exchange", F.col("security").alias("base"), F.col("settled_in").alias("quote"), "symbol")
    return wanted.join(found, ["exchange", "base", "quote"], "left")


def compose(p: DataFrame, q: DataFrame) -> DataFrame:
    """Rates joined where the quote of the first is, or is pegged to, the base of the second.

    ``(id, base, quote, rate)``; if they don't meet, the second, the first or
    both are turned over, tried in that order.
    """

    def turned(df: DataFrame, name: str) -> DataFrame:
        flat = df.select("id", F.col("base").alias("a"), F.col("quote").alias("b"), F.col("rate").alias("r"), F.lit(0).alias("turn"))
        over = df.select("id", F.col("quote").alias("a"), F.col("base").alias("b"), (1 / F.col("rate")).alias("r"), F.lit(1).alias("turn"))
        return flat.unionByName(over).select("id", *[F.col(c).alias(f"{name}_{c}") for c in ("a", "b", "r", "turn")])

    left = peg_equivalents(turned(p, "p"), "p_b")
    pairs = left.join(turned(q, "q"), ["id"]).where(F.col("equal_to") == F.col("q_a"))
    order = F.col("q_turn") + 2 * F.col("p_turn")
    w = Window.partitionBy("id").orderBy(order, F.when(F.col("equal_to") == F.col("p_b"), 0).otherwise(1))
    best = pairs.withColumn("__rank", F.row_number().over(w)).where("__rank = 1")
    return best.select("id", F.col("p_a").alias("base"), F.col("q_b").alias("quote"), (F.col("p_r") * F.col("q_r")).alias("rate"))


def rates_to(markets: DataFrame, target: str) -> DataFrame:
    """``(asset, rate, n_hops, path)`` of the chain of fewest markets from every asset to ``target``, as
    ``conversion_chains`` finds them: pegs, and pegs of pegs, cost no hop."""
    return conversion_chains(markets, target).drop("steps")


def rates_near(markets: DataFrame, target: str, exchanges: list[str]) -> DataFrame:
    """As ``rates_to``, by chains on the named exchanges where there are any, else on all."""
    near = rates_to(markets.where(F.col("exchange").isin(exchanges)), target)
    return near.unionByName(rates_to(markets, target).join(near.select("asset"), "asset", "left_anti"))


def all_accounts(instruments: DataFrame) -> DataFrame:
    """Every security and settlement currency of each exchange."""
    held = instruments.select("exchange", F.col("security").alias("asset"))
    return held.union(instruments.select("exchange", F.col("settled_in").alias("asset"))).distinct()


def tradable(configured: DataFrame, listed: DataFrame, topics: DataFrame) -> DataFrame:
    """Configured and listed instruments ``(exchange, symbol)`` whose symbol is a topic in use."""
    both = configured.select("exchange", "symbol").union(listed.select("exchange", "symbol")).distinct()
    return both.join(topics.select(F.col("topic").alias("symbol")).distinct(), "symbol", "left_semi").select("exchange", "symbol")
