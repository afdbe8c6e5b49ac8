"""Exchange payloads as JSON text: order feed, trade pages, book snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import iso_micros, opposite
from tidemark.operators.order import dedupe_consecutive

#: Fields of a feed message; numbers arrive as strings.
FEED = (
    "type string, product_id string, sequence bigint, time string, order_id string, price string, size string, remaining_size string, "
    "new_size string, side string, reason string, trade_id bigint, maker_order_id string, client_oid string, order_type string"
)
KINDS = ("received", "open", "done", "match", "change")


def parse_order_feed(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, quarantine) of JSON lines.

    Bad JSON, unknown types and messages without sequence or with numbers that
    are none go to the quarantine with their reason. A match's direction is
    opposite to its maker's side: a maker who sold means the price went up.
    """
    # a filter on a message goes past no generator, so that a line is parsed once and not once for each use of a field
    m = lines.select("*", F.explode(F.array(F.from_json(text, FEED))).alias("m"))
    number = {c: F.col(f"m.{c}").try_cast("double") for c in ("price", "size", "remaining_size", "new_size")}
    broken = F.lit(False)
    for c, n in number.items():
        broken = broken | (F.col(f"m.{c}").isNotNull() & n.isNull())
    kind = F.col("m.type")
    error = (
        F.when(F.col("m").isNull() | kind.isNull(), "no message")
        .when(~kind.isin(*KINDS), "unknown type")
        .when(F.col("m.sequence").isNull(), "no sequence")
        .when(broken, "no number")
    )
    m = m.withColumn("error", error)
    bad = m.where("error is not null").select(text, "error")
    taker = opposite(F.col("m.side"))
    events = m.where("error is null").select(
        F.lower(F.regexp_replace("m.product_id", "-", "_")).alias("topic"),
        F.col("m.sequence").alias("seq"),
        F.timestamp_micros(iso_micros("m.time")).alias("ts"),
        F.when(kind == "match", "match").otherwise(kind).alias("kind"),
        "m.order_id",
        *[n.alias(c) for c, n in number.items()],
        F.when(F.col("m.side") == "buy", "bid").when(F.col("m.side") == "sell", "ask").alias("side"),
        "m.reason",
        "m.trade_id",
        "m.maker_order_id",
        F.when(kind == "match", F.when(taker == "buy", "up").otherwise("down")).alias("direction"),
        "m.client_oid",
        "m.order_type",
    )
    return events, bad


TRADES = "array<struct<time:string,trade_id:bigint,price:string,size:string,side:string>>"


def parse_trade_pages(pages: DataFrame, by: list[str], page: str = "page", text: str = "value") -> DataFrame:
    """Trades of pages ``(by, page, value)``, each a JSON array, newest first, each trade once.

    Runs of one trade id count once, and rows at the head of a page that the
    page before had already reached are dropped. ``side`` is the maker's.
    """
    rows = pages.select(*by, page, F.posexplode(F.from_json(text, TRADES)).alias("place", "t")).select(*by, page, "place", "t.*")
    once = dedupe_consecutive(rows, [*by, page], ["place"], "trade_id", F.lit(0))  # a page is one bucket
    last = once.groupBy(*by, page).agg(F.max_by("trade_id", "place").alias("__last"))
    reached = last.select(*by, (F.col(page) + 1).alias(page), "__last")
    joined = once.join(reached, [*by, page], "left")
    w = Window.partitionBy(*by, page).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.max(F.when(F.col("__last").isNull() | (F.col("trade_id") < F.col("__last")), 1)).over(w)
    out = joined.withColumn("__fresh", fresh).where("__fresh = 1")
    return out.select(
        *by,
        page,
        "place",
        F.col("trade_id").cast("string").alias("id"),
        F.timestamp_micros(iso_micros("time")).alias("ts"),
        F.col("price").cast("double").alias("price"),
        F.col("size").cast("double").alias("size"),
        F.when(F.col("side") == "sell", "up").otherwise("down").alias("direction"),
    )


BOOK = "sequence bigint, asks array<array<string>>, bids array<array<string>>"


def parse_book_snapshot(snapshots: DataFrame, by: list[str], text: str = "value") -> DataFrame:
    """Open orders of book snapshots: ``by, seq, side, order_id, price, size``."""
    m = snapshots.select(*by, F.from_json(text, BOOK).alias("m"))

    def side(name: str) -> DataFrame:
        rows = m.select(*by, F.col("m.sequence").alias("seq"), F.explode(f"m.{name}s").alias("o"))
        value: list[Column] = [F.get("o", 2).alias("order_id"), F.get("o", 0).cast("double").alias("price"), F.get("o", 1).cast("double").alias("size")]
        return rows.select(*by, "seq", F.lit(name).alias("side"), *value)

    return side("ask").unionByName(side("bid"))
