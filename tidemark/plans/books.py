"""Queries on order books and depth ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import book, ladder, order
from tidemark.plans import views
from tidemark.plans.register import OFF_TIES, registry

QUERIES, ORACLES, query = registry()

FEED = """feed AS (
  SELECT CAST(user_id % 4 AS INTEGER) AS topic, user_id AS order_id, event_id AS seq, ts,
    CASE WHEN event_type IN ('signup', 'view') THEN 'open' WHEN event_type = 'click' THEN 'change' WHEN event_type = 'purchase' THEN 'done' ELSE 'received' END AS kind,
    CASE WHEN event_type IN ('signup', 'view') THEN round(value) END AS price,
    CASE WHEN event_type IN ('signup', 'view', 'click') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 END AS size,
    CASE WHEN event_type IN ('signup', 'view') THEN CASE WHEN user_id // 4 % 2 = 0 THEN 'bid' ELSE 'ask' END END AS side
  FROM events)"""

#: The book by the last open of each order: done after it removes, changes after it resize.
BOOK = (
    FEED
    + """, o AS (SELECT topic, order_id, max(seq) AS opened FROM feed WHERE kind = 'open' GROUP BY ALL),
a AS (SELECT f.*, opened FROM feed f JOIN o USING (topic, order_id) WHERE f.seq >= opened AND kind <> 'received'),
book AS (
  SELECT topic, order_id, any_value(side) FILTER (kind = 'open') AS side, any_value(price) FILTER (kind = 'open') AS price,
    arg_max(size, seq) FILTER (size IS NOT NULL) AS size, max(seq) FILTER (kind <> 'done') AS prio_seq
  FROM a GROUP BY topic, order_id HAVING count(*) FILTER (kind = 'done') = 0)"""
)

LEVELS = (
    BOOK
    + """, levels AS (SELECT topic, side, price, sum(size) AS qty FROM book GROUP BY ALL)"""
)

#: Ladders of line items; the first 400 parts make one kind of walk, by size, limit or funds.
LADDERS = """ladders AS (
  SELECT l_partkey AS ladder, CASE WHEN l_linestatus = 'O' THEN 'ask' ELSE 'bid' END AS side, round(l_extendedprice, -2) AS price, sum(l_quantity) AS qty
  FROM lineitem GROUP BY ALL)"""
WALKERS = """walkers AS (
  SELECT CAST(o_custkey % 2000 + 1 AS BIGINT) AS ladder, o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 'sell' ELSE 'buy' END AS side,
    CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 90 + 1 AS DOUBLE) END AS size, CASE WHEN o_orderkey % 3 = 2 THEN o_totalprice END AS funds,
    CASE WHEN o_orderkey % 3 < 2 AND o_orderkey % 4 = 0 THEN o_totalprice / 4 END AS "limit"
  FROM orders)"""
WALK = f"""{LADDERS}, {WALKERS}, cum AS (
  SELECT *, coalesce(sum(qty) OVER w, 0) AS q0, coalesce(sum(price * qty) OVER w, 0) AS c0 FROM ladders
  WINDOW w AS (PARTITION BY ladder, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hits AS (
  SELECT w.ladder, order_id, w.side, c.price, CASE WHEN size IS NOT NULL THEN least(qty, size - q0) ELSE least(qty, (funds - c0) / price) END AS fill
  FROM walkers w JOIN cum c ON w.ladder = c.ladder AND c.side = CASE w.side WHEN 'buy' THEN 'ask' ELSE 'bid' END
    AND ("limit" IS NULL OR CASE w.side WHEN 'buy' THEN price <= "limit" ELSE price >= "limit" END)),
fills AS (SELECT * FROM hits WHERE fill > 0)"""


def the_book(spark, sf_dir):
    return book.book_at(views.order_feed(spark, sf_dir), ["topic"])


def walkers(spark, sf_dir):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    return views.table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 2000 + 1).alias("ladder"),
        k.alias("order_id"),
        F.when(k % 3 == 0, "sell").otherwise("buy").alias("side"),
        F.when(k % 3 < 2, (k % 90 + 1).cast("double")).alias("size"),
        F.when(k % 3 == 2, price).alias("funds"),
        F.when((k % 3 < 2) & (k % 4 == 0), price / 4).alias("limit"),
    )


@query(f"WITH {FEED} SELECT kind, count(*) AS n FROM feed WHERE kind IN ('open', 'change', 'done') GROUP BY kind")
def book_delta_kinds(spark, sf_dir):
    """events that change a book."""
    return book.book_deltas(views.order_feed(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {BOOK} SELECT topic, order_id, side, price, size, prio_seq FROM book")
def book_of_live_orders(spark, sf_dir):
    """B1: live orders, their size and queue priority."""
    return the_book(spark, sf_dir)


@query(
    f"""WITH {FEED}, s AS (SELECT topic, order_id, side, price, size, seq FROM (SELECT *, max(seq) OVER (PARTITION BY topic) AS m FROM feed WHERE kind = 'open' AND seq < 2000)),
    b AS (SELECT topic, max(seq) AS base FROM s GROUP BY topic),
    e AS (SELECT topic, order_id, seq, 'open' AS kind, side, price, size FROM s UNION ALL
      SELECT f.topic, order_id, seq, kind, side, price, size FROM feed f JOIN b ON f.topic = b.topic AND f.seq > base WHERE kind <> 'received'),
    o AS (SELECT topic, order_id, max(seq) AS opened FROM e WHERE kind = 'open' GROUP BY ALL),
    a AS (SELECT e.*, opened FROM e JOIN o USING (topic, order_id) WHERE e.seq >= opened)
    SELECT topic, order_id, any_value(side) FILTER (kind = 'open') AS side, any_value(price) FILTER (kind = 'open') AS price,
      arg_max(size, seq) FILTER (size IS NOT NULL) AS size, max(seq) FILTER (kind <> 'done') AS prio_seq
    FROM a GROUP BY topic, order_id HAVING count(*) FILTER (kind = 'done') = 0"""
)
def book_from_snapshot(spark, sf_dir):
    """B2: a snapshot and the events after it."""
    feed = views.order_feed(spark, sf_dir).drop("ts")
    snapshot = feed.where("kind = 'open' and seq < 2000").drop("kind")
    return book.book_seed(snapshot, feed, ["topic"])


@query(
    f"""WITH {LEVELS} SELECT topic, side, price, qty, level FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic, side
    ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) - 1 AS INTEGER) AS level FROM levels) WHERE level < 10"""
)
def book_ladder(spark, sf_dir):
    """The ten best levels of each side."""
    return book.ladder(the_book(spark, sf_dir), ["topic"], 10)


@query(
    f"""WITH {LEVELS}, b AS (SELECT topic, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask FROM levels GROUP BY topic)
    SELECT topic, bid, ask, ask - bid AS spread, coalesce(bid >= ask, false) AS crossed FROM b"""
)
def best_bid_ask(spark, sf_dir):
    """Best prices and spread."""
    return book.best_prices(book.level_depth(the_book(spark, sf_dir), ["topic"]), ["topic"])


@query(
    f"""WITH {FEED}, t AS (SELECT topic, seq FROM feed WHERE seq % 250 = 0),
    e AS (SELECT t.seq AS tick, f.* FROM t JOIN feed f ON f.topic = t.topic AND f.seq <= t.seq WHERE kind <> 'received'),
    o AS (SELECT tick, topic, order_id, max(seq) AS opened FROM e WHERE kind = 'open' GROUP BY ALL),
    a AS (SELECT e.*, opened FROM e JOIN o USING (tick, topic, order_id) WHERE e.seq >= opened),
    b AS (SELECT tick AS seq, topic, order_id, any_value(side) FILTER (kind = 'open') AS side, any_value(price) FILTER (kind = 'open') AS price,
      arg_max(size, a.seq) FILTER (size IS NOT NULL) AS size FROM a GROUP BY tick, topic, order_id HAVING count(*) FILTER (kind = 'done') = 0),
    l AS (SELECT topic, seq, side, price, sum(size) AS qty FROM b GROUP BY ALL)
    SELECT topic, seq, side, price, qty, level FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic, seq, side
      ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) - 1 AS INTEGER) AS level FROM l) WHERE level < 5"""
)
def ladders_over_time(spark, sf_dir):
    """The ladder of the book after every 250th event."""
    feed = views.order_feed(spark, sf_dir)
    return book.ladder_at(feed, feed.where("seq % 250 = 0").select("topic", "seq"), ["topic"], 5)


@query(f"WITH {WALK} SELECT ladder, order_id, side, price, fill AS size FROM fills")
def depth_walked(spark, sf_dir):
    """Orders filled against ladders, by size, limit or funds."""
    return ladder.walk_depth(walkers(spark, sf_dir), views.ladders(spark, sf_dir), ["ladder"])


@query(
    f"""WITH {WALK}, s AS (SELECT ladder, order_id, sum(fill) AS filled, sum(price * fill) AS cost FROM fills GROUP BY ALL)
    SELECT w.ladder, w.order_id, round(coalesce(filled, 0) + {OFF_TIES:.10f}, 4) AS filled, round(coalesce(cost, 0) + {OFF_TIES:.10f}, 4) AS cost,
      round(cost / CASE WHEN filled > 0 THEN filled END + {OFF_TIES:.10f}, 4) AS vwap, round(coalesce(cost, 0) * 0.003 + {OFF_TIES:.10f}, 4) AS fee,
      round(CASE WHEN size IS NOT NULL THEN size - coalesce(filled, 0) ELSE funds - coalesce(cost, 0) END + {OFF_TIES:.10f}, 4) AS unfilled
    FROM walkers w LEFT JOIN s USING (ladder, order_id)"""
)
def fills_summed_up(spark, sf_dir):
    """What each order got."""
    orders = walkers(spark, sf_dir)
    fills = ladder.walk_depth(orders, views.ladders(spark, sf_dir), ["ladder"])
    sums = ladder.fill_summary(orders, fills, ["ladder"], F.lit(0.003))
    return sums.withColumns({c: F.round(F.col(c) + OFF_TIES, 4) for c in ("filled", "cost", "vwap", "fee", "unfilled")})


@query(
    f"""WITH {BOOK}, i AS (SELECT CAST(o_orderkey % 4 AS INTEGER) AS topic, o_orderkey AS taker_id, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
      CAST(o_orderkey % 40 + 1 AS DOUBLE) AS size, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 300 AS DOUBLE) END AS "limit" FROM orders),
    p AS (SELECT i.topic, taker_id, order_id, b.price, b.size AS avail, i.size AS want,
      coalesce(sum(b.size) OVER (PARTITION BY i.topic, taker_id ORDER BY CASE WHEN i.side = 'buy' THEN b.price ELSE -b.price END, prio_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM i JOIN book b ON i.topic = b.topic AND b.side = CASE i.side WHEN 'buy' THEN 'ask' ELSE 'bid' END
        AND ("limit" IS NULL OR CASE i.side WHEN 'buy' THEN b.price <= "limit" ELSE b.price >= "limit" END))
    SELECT topic, taker_id, order_id, price, least(avail, want - before) AS size FROM p WHERE least(avail, want - before) > 0"""
)
def orders_matched(spark, sf_dir):
    """Incoming orders matched with the book's queue."""
    k = F.col("o_orderkey")
    incoming = views.table(spark, sf_dir, "orders").select(
        (k % 4).cast("int").alias("topic"),
        k.alias("taker_id"),
        F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"),
        (k % 40 + 1).cast("double").alias("size"),
        F.when(k % 5 == 0, (k % 300).cast("double")).alias("limit"),
    )
    return book.match_orders(incoming, the_book(spark, sf_dir), ["topic"])


def halves(spark, sf_dir):
    """Ladders of the line items of even and of odd orders."""
    li = views.table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid")
    levels = li.groupBy(
        (F.col("l_partkey") % 200).alias("ladder"), side.alias("side"), F.round("l_extendedprice", -3).alias("price"), (F.col("l_orderkey") % 2).alias("half")
    ).agg(F.sum("l_quantity").alias("qty"))
    return levels.where("half = 0").drop("half"), levels.where("half = 1").drop("half")


HALVES = """h AS (SELECT l_partkey % 200 AS ladder, CASE WHEN l_linestatus = 'O' THEN 'ask' ELSE 'bid' END AS side, round(l_extendedprice, -3) AS price,
    l_orderkey % 2 AS half, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL),
a AS (SELECT ladder, side, price, qty FROM h WHERE half = 0), b AS (SELECT ladder, side, price, qty FROM h WHERE half = 1)"""


@query(
    f"""WITH {HALVES}, d AS (SELECT ladder, side, price, CASE WHEN price % 3000 = 0 THEN 0 ELSE qty END AS qty FROM b)
    SELECT ladder, side, price, coalesce(d.qty, a.qty) AS qty FROM a FULL JOIN d USING (ladder, side, price) WHERE coalesce(d.qty, a.qty) <> 0"""
)
def levels_updated(spark, sf_dir):
    """A ladder after deltas."""
    a, b = halves(spark, sf_dir)
    deltas = b.withColumn("qty", F.when(F.col("price") % 3000 == 0, 0.0).otherwise(F.col("qty"))).withColumn("seq", F.lit(1).cast("long"))
    return ladder.update_levels(a, deltas, ["ladder"])


@query(
    f"""WITH {HALVES} SELECT ladder, side, price, coalesce(b.qty, 0) AS qty FROM a FULL JOIN b USING (ladder, side, price)
    WHERE a.qty IS NULL OR b.qty IS NULL OR a.qty <> b.qty"""
)
def ladders_compared(spark, sf_dir):
    """The deltas between two ladders."""
    return ladder.ladder_diff(*halves(spark, sf_dir), ["ladder"])


@query(f"WITH {LADDERS} SELECT ladder, side, price * 2 AS price, sum(qty) AS qty FROM ladders GROUP BY ladder, side, price")
def ladders_converted(spark, sf_dir):
    """Ladders at other prices."""
    return ladder.ladder_convert(views.ladders(spark, sf_dir), F.col("price") * 2)


@query(
    f"""WITH {HALVES}, ca AS (SELECT ladder, side, price, qty, coalesce(sum(qty) OVER (PARTITION BY ladder, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM a),
    cb AS (SELECT ladder, CASE WHEN side = 'ask' THEN 'bid' ELSE 'ask' END AS side, price, qty, coalesce(sum(qty) OVER (PARTITION BY ladder, side
      ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM b)
    SELECT ca.ladder, ca.side, ca.price - cb.price AS price, sum(least(ca.lo + ca.qty, cb.lo + cb.qty) - greatest(ca.lo, cb.lo)) AS qty
    FROM ca JOIN cb ON ca.ladder = cb.ladder AND ca.side = cb.side AND ca.lo < cb.lo + cb.qty AND cb.lo < ca.lo + ca.qty GROUP BY 1, 2, 3"""
)
def ladder_spreads(spark, sf_dir):
    """The spread of two ladders."""
    return ladder.ladder_spread(*halves(spark, sf_dir), ["ladder"])


@query(
    f"""WITH {LADDERS}, w AS (SELECT DISTINCT l_partkey AS ladder, round(l_extendedprice, -2) AS price FROM lineitem),
    q AS (SELECT ladder, price, coalesce(max(qty) FILTER (side = 'ask'), max(qty) FILTER (side = 'bid')) AS qty FROM ladders GROUP BY ALL)
    SELECT ladder, price, coalesce(qty, 0) AS qty FROM w LEFT JOIN q USING (ladder, price)"""
)
def quantities_at_prices(spark, sf_dir):
    """What stands at a price."""
    li = views.table(spark, sf_dir, "lineitem")
    wanted = li.select(F.col("l_partkey").alias("ladder"), F.round("l_extendedprice", -2).alias("price")).distinct()
    return ladder.quantity_at(views.ladders(spark, sf_dir), wanted, ["ladder"])


@query(f"WITH {LADDERS} SELECT ladder, side, price, qty FROM ladders")
def ladders_packed_and_unpacked(spark, sf_dir):
    """Packed ladders are the same in long form."""
    return ladder.from_parts(ladder.as_parts(views.ladders(spark, sf_dir), ["ladder"]), ["ladder"])


@query(
    f"""WITH {BOOK}, derived AS (SELECT topic, side, price, sum(size) AS qty FROM book GROUP BY ALL), recorded AS (SELECT topic, side, price, qty * 2 AS qty FROM derived WHERE topic < 2)
    SELECT * FROM recorded UNION ALL SELECT * FROM derived WHERE topic NOT IN (SELECT topic FROM recorded)"""
)
def ladders_recorded_or_derived(spark, sf_dir):
    """A ladder from the book where none is recorded."""
    derived = book.level_depth(the_book(spark, sf_dir), ["topic"])
    recorded = derived.where("topic < 2").withColumn("qty", F.col("qty") * 2)
    return ladder.ladder_or_book(recorded, derived, ["topic"])


def fine(spark, sf_dir):
    """The two ladders of ``halves`` with quantities of eight digits behind the point."""
    steps = F.col("qty").cast("decimal(12,0)") * (F.pmod(F.col("price").cast("long"), F.lit(97)) + 1).cast("decimal(3,0)")
    qty = steps * F.lit("0.00000001").cast("decimal(8,8)")
    return [x.withColumn("qty", qty.cast("decimal(28,8)").cast("double")) for x in halves(spark, sf_dir)]


@query(
    f"""WITH {HALVES}, x AS (SELECT *, CAST(qty AS DECIMAL(20, 0)) * CAST(CAST(price AS BIGINT) % 97 + 1 AS DECIMAL(10, 0)) * CAST(0.00000001 AS DECIMAL(8, 8)) AS q FROM h),
    c AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY half, ladder, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM x),
    ca AS (SELECT * FROM c WHERE half = 0), cb AS (SELECT * REPLACE (CASE WHEN side = 'ask' THEN 'bid' ELSE 'ask' END AS side) FROM c WHERE half = 1)
    SELECT ca.ladder, ca.side, ca.price - cb.price AS price, CAST(sum(least(ca.lo + ca.q, cb.lo + cb.q) - greatest(ca.lo, cb.lo)) AS DOUBLE) AS qty
    FROM ca JOIN cb ON ca.ladder = cb.ladder AND ca.side = cb.side AND ca.lo < cb.lo + cb.q AND cb.lo < ca.lo + ca.q GROUP BY 1, 2, 3"""
)
def ladder_spreads_of_fine_quantities(spark, sf_dir):
    """Spreads of ladders whose quantities have eight digits."""
    return ladder.ladder_spread(*fine(spark, sf_dir), ["ladder"])


@query(
    f"""WITH {FEED}, k AS (SELECT topic, order_id, max(seq) AS s, arg_max(kind, seq) <> 'done' AS alive, max(ts) AS ts FROM feed WHERE kind IN ('open', 'change', 'done') AND order_id % 3 <> 0 GROUP BY ALL),
    m AS (SELECT DISTINCT topic, date_trunc('day', ts) AS day, order_id FROM feed), d AS (SELECT DISTINCT topic, day FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY day DESC) AS n FROM d),
    now AS (SELECT m.* FROM m JOIN r USING (topic, day) WHERE n = 1), was AS (SELECT m.* FROM m JOIN r USING (topic, day) WHERE n = 2)
    SELECT topic, order_id, 'missed' AS correction FROM now SEMI JOIN was USING (topic, order_id) ANTI JOIN k USING (topic, order_id)
    UNION ALL SELECT k.topic, k.order_id, 'lingering' FROM k JOIN r ON k.topic = r.topic AND n = 1 AND k.ts <= day - INTERVAL 10 SECOND WHERE alive AND NOT EXISTS (SELECT 1 FROM now WHERE now.topic = k.topic AND now.order_id = k.order_id)"""
)
def snapshots_reconciled(spark, sf_dir):
    """What the latest of daily snapshots corrects in books that know two thirds of the orders."""
    feed = views.order_feed(spark, sf_dir)
    own = book.book_deltas(feed).where("order_id % 3 <> 0").groupBy("topic", "order_id")
    known = own.agg((F.max_by("kind", "seq") != "done").alias("alive"), F.max("ts").alias("ts"))
    shots = feed.select("topic", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "order_id").distinct()
    return book.reconciled(known, shots, ["topic"])


@query(f"WITH {FEED} SELECT 'exchange' AS source, CAST(topic AS VARCHAR) AS topic, ts, CAST(seq AS VARCHAR) AS id, price, size, CASE side WHEN 'bid' THEN 'down' ELSE 'up' END AS direction FROM feed WHERE kind = 'open'")
def trades_of_matches(spark, sf_dir):
    """matches of an order feed as trades."""
    feed = views.order_feed(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "open", "match").otherwise(F.col("kind")))
    named = feed.withColumns({"source": F.lit("exchange"), "topic": F.col("topic").cast("string"), "trade_id": F.col("seq"), "direction": F.when(F.col("side") == "bid", "down").otherwise("up")})
    return book.trades_from_matches(named)


@query(
    f"""WITH {FEED}, b AS (SELECT topic, seq, 1 AS is_event, kind FROM feed UNION ALL SELECT topic, seq, 0, 'snapshot' FROM feed WHERE seq % 100 = 0)
    SELECT topic, seq, is_event, kind, row_number() OVER (PARTITION BY topic ORDER BY seq, is_event) - 1 AS place FROM b"""
)
def feed_with_snapshots_in_order(spark, sf_dir):
    """O3: an order feed and its book snapshots; a snapshot stands before the event of its sequence."""
    feed = views.order_feed(spark, sf_dir).select("topic", "seq", "kind")
    shots = feed.where("seq % 100 = 0").withColumn("kind", F.lit("snapshot"))
    both = order.feed_order(feed, shots)
    return order.numbered(both, ["topic"], ["seq", "is_event"], "place", F.floor(F.col("seq") / 65536))
