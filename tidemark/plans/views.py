"""The given tables seen as market data: ticks, order feed, fills, ladders, instruments.

``events`` are trades and order events, ``lineitem`` joined with ``orders`` are
fills, ``customer`` holds balances. Only narrow columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.order import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades without positions in their series."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("source"),
        F.col("event_type").alias("topic"),
        F.lit("trades").alias("datatype"),
        "ts",
        F.col("event_id").alias("id"),
        F.col("value").alias("price"),
        k.alias("size"),
        F.when(F.col("event_id") % 2 == 0, "up").otherwise("down").alias("direction"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with ``seqid``, their zero-based position in the series."""
    return numbered(trades(spark, sf_dir), ["source", "topic", "datatype"], ["ts", "id"], "seqid")


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange order events: users are orders, four books."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    size = F.get_json_object("props", "$.k").cast("double") + 1
    return e.select(
        (F.col("user_id") % 4).cast("int").alias("topic"),
        F.col("user_id").alias("order_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.when(kind.isin("signup", "view"), "open")
        .when(kind == "click", "change")
        .when(kind == "purchase", "done")
        .otherwise("received")
        .alias("kind"),
        F.when(kind.isin("signup", "view"), F.round("value")).alias("price"),
        F.when(kind.isin("signup", "view", "click"), size).alias("size"),
        F.when(kind.isin("signup", "view"), F.when(F.floor(F.col("user_id") / 4) % 2 == 0, "bid").otherwise("ask")).alias("side"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills: account = customer, market = supplier. ``fill_key`` makes the order total."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("account"),
        F.col("l_suppkey").alias("market"),
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("size"),
        price.alias("price"),
        F.col("l_tax").alias("fee"),
        F.col("l_shipdate").alias("ts"),
        key.alias("fill_key"),
    )


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as a store of snapshots and deltas would hold them: three bundles, gaps, overlaps."""
    t = ticks(spark, sf_dir)
    day = F.dayofyear("ts")
    bundle = F.when(day % 3 == 0, -1).when(day % 3 == 1, 1).otherwise(2)
    four_hours = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(14_400_000_000))
    w = Window.partitionBy("topic", four_hours).orderBy("ts", "id")
    return (
        t.withColumn("is_snapshot", F.row_number().over(w) == 1)
        .where("is_snapshot or seqid % 17 <> 0")
        .withColumn("bundle", bundle.cast("long"))
    )


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A depth ladder for each part and side, from the sizes of its line items."""
    li = table(spark, sf_dir, "lineitem")
    return (
        li.select(
            F.col("l_partkey").alias("ladder"),
            F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid").alias("side"),
            F.round("l_extendedprice", -2).alias("price"),
            F.col("l_quantity").alias("qty"),
        )
        .groupBy("ladder", "side", "price")
        .agg(F.sum("qty").alias("qty"))
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currency pairs: nation against its region's unit on the region's exchange, and regions in a chain."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("r_name").alias("exchange"),
        F.lower("n_name").alias("base"),
        F.lower("r_name").alias("quote"),
        ((F.col("n_nationkey") + 2) / 4).alias("price"),
    )
    chain = r.alias("a").join(r.alias("b"), F.col("a.r_regionkey") + 1 == F.col("b.r_regionkey"))
    links = chain.select(
        F.lit("hub").alias("exchange"),
        F.lower("a.r_name").alias("base"),
        F.lower("b.r_name").alias("quote"),
        ((F.col("a.r_regionkey") + 3) / 2).alias("price"),
    )
    return pairs.unionByName(links)


def pegged_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations against a pegged currency of their region's exchange, and two markets between other pegged ones."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    units = F.array(*map(F.lit, ["usdc", "xbt", "tusd", "eur", "bitusd"]))
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("r_name").alias("exchange"),
        F.lower("n_name").alias("base"),
        F.element_at(units, F.col("r_regionkey") + 1).alias("quote"),
        ((F.col("n_nationkey") + 2) / 4).alias("price"),
    )
    links = r.where("r_regionkey < 2").select(
        F.lower("r_name").alias("exchange"),
        F.when(F.col("r_regionkey") == 0, "btc").otherwise("eur").alias("base"),
        F.lit("dai").alias("quote"),
        F.when(F.col("r_regionkey") == 0, 40.0).otherwise(1.25).alias("price"),
    )
    return pairs.unionByName(links)


def market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices of markets: nation against its region's unit, from line items; region's unit against hub, from
    orders of the region's customers; hub against eur, from all orders."""
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("n_nationkey", F.lower("n_name").alias("nation"), F.lower("r_name").alias("region"))
    sold = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("n_nationkey"), F.col("l_shipdate").alias("ts"))
    nations = sold.agg((F.max(F.col("l_extendedprice") / F.col("l_quantity")) / 1000).alias("price")).join(places, "n_nationkey")
    nations = nations.select(F.col("region").alias("exchange"), F.col("nation").alias("base"), F.col("region").alias("quote"), "ts", "price")
    bought = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    bought = bought.groupBy("region", F.col("o_orderdate").alias("ts")).agg((F.max("o_totalprice") / 100_000).alias("price"))
    regions = bought.select(F.lit("hub").alias("exchange"), F.col("region").alias("base"), F.lit("hub").alias("quote"), "ts", "price")
    all_ = o.groupBy(F.col("o_orderdate").alias("ts")).agg((F.max("o_totalprice") / 200_000).alias("price"))
    hub = all_.select(F.lit("hub").alias("exchange"), F.lit("hub").alias("base"), F.lit("eur").alias("quote"), "ts", "price")
    return nations.unionByName(regions).unionByName(hub)
