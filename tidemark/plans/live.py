"""Queries that run as streams over the given tables until all of them is read, and parsed payloads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.plans import views
from tidemark.plans.books import FEED
from tidemark.plans.register import registry
from tidemark.plans.series import TICKS, TOPICS
from tidemark.sources import feeds
from tidemark.sources.shared import shared_path
from tidemark.streaming import fuzzy, streams, values

QUERIES, ORACLES, query = registry()

#: Orders, about, of a page of a book snapshot.
SNAPSHOT_PAGE = 1000


def event_stream(spark, sf_dir):
    return streams.stream_series(spark, sf_dir, views.table(spark, sf_dir, "events").schema, "events.parquet")


def trade_stream(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("double")
    return event_stream(spark, sf_dir).select(F.col("event_type").alias("topic"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"), k.alias("size"))


@query(
    f"""WITH {TICKS}, b AS (SELECT topic, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, (ts, id)) AS open, max(price) AS high, min(price) AS low,
      arg_max(price, (ts, id)) AS close, round(sum(size), 4) AS volume FROM ticks GROUP BY topic, time_bucket(INTERVAL '1 hour', ts))
    SELECT * FROM b WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks)"""
)
def streamed_bars(spark, sf_dir):
    """Closed bars of a stream."""
    out = streams.drained(streams.stream_ohlcv(trade_stream(spark, sf_dir), "1 hour", ["topic"]))
    return out.withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "volume": F.round("volume", 4)})


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_pairs_once(spark, sf_dir):
    """Each key of a stream once."""
    s = event_stream(spark, sf_dir).select("user_id", "event_type", "ts")
    return streams.drained(streams.stream_dedupe(s, ["user_id", "event_type"], "400 days")).select("user_id", "event_type")


@query("SELECT event_id AS id, event_type AS topic, value AS price FROM events")
def streams_first_come(spark, sf_dir):
    """A stream for each series, as one."""
    each = [trade_stream(spark, sf_dir).where(F.col("topic") == t).select("id", "topic", "price") for t in TOPICS]
    return streams.drained(streams.first_come(*each))


@query(
    """SELECT user_id % 20 AS session_id, 'k' || (event_id % 7) AS key, CASE WHEN arg_max(event_type, event_id) <> 'error' THEN arg_max(value, event_id) END AS payload
    FROM events WHERE event_type IN ('signup', 'click', 'error') GROUP BY ALL"""
)
def streamed_report(spark, sf_dir):
    """Values of reports that grow."""
    kind = F.col("event_type")
    e = event_stream(spark, sf_dir).select(
        (F.col("user_id") % 20).alias("session_id"),
        F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("key"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("payload"),
        F.when(kind == "signup", "put").when(kind == "click", "update").when(kind == "error", "remove").alias("kind"),
    )
    out = streams.drained(streams.stream_report(e), "update")
    return out.groupBy("session_id", "key").agg(F.max_by("payload", "batch").alias("payload"))


#: Order events as they arrive, eight an order: up to eight hours after their time, two thirds of them within ten minutes.
ARRIVALS = """arrivals AS (SELECT CAST(event_id // 8 % 4 AS INTEGER) AS topic, event_id // 8 AS order_id, ts,
  (epoch_us(ts) // 1000 + CASE WHEN event_id % 3 < 2 THEN event_id * 7919 % 600000 ELSE event_id * 104729 % 28800000 END) * 1048576 + event_id % 1048576 AS seq,
  CASE event_type WHEN 'click' THEN 'change' WHEN 'purchase' THEN 'delete' WHEN 'error' THEN 'delete' ELSE 'create' END AS event FROM events)"""
#: Time that an event may be late, and that deleted orders are remembered, for a table of a few events an hour.
LATE, FORGET = 3 * 3_600_000_000, 24 * 3_600_000_000


def arrivals(spark, sf_dir):
    k, kind = F.col("event_id"), F.col("event_type")
    new, change = kind.isin("signup", "view"), kind == "click"
    delay = F.when(k % 3 < 2, k * 7919 % 600_000).otherwise(k * 104_729 % 28_800_000)
    millis = F.floor(C.micros("ts") / 1000)
    return views.table(spark, sf_dir, "events").select(
        (F.expr("event_id div 8") % 4).cast("int").alias("topic"),
        F.expr("event_id div 8").alias("order_id"),
        ((millis + delay) * 1_048_576 + k % 1_048_576).alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(new, F.col("value")).alias("price"),
        F.when(new | change, F.get_json_object("props", "$.k").cast("double") + 1).alias("size"),
        F.when(new, F.lit("bid")).alias("side"),
    )


@query(
    f"""WITH RECURSIVE {ARRIVALS}, c AS (SELECT *, max(epoch_us(ts)) OVER (PARTITION BY topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock,
      row_number() OVER (PARTITION BY topic, order_id ORDER BY seq) AS n, epoch_us(ts) AS t FROM arrivals),
    s(topic, order_id, n, outcome, alive, time) AS (
      SELECT topic, order_id, CAST(0 AS BIGINT), '', CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT topic, order_id FROM c)
      UNION ALL
      SELECT topic, order_id, n, outcome, CASE WHEN takes THEN event <> 'delete' ELSE alive END, CASE WHEN takes THEN t ELSE time END FROM (
        SELECT *, outcome = 'accepted' OR (outcome = 'unknown order' AND event = 'delete') AS takes FROM (
          SELECT x.topic, x.order_id, c.n, c.t, c.event, x.alive, x.time,
            CASE WHEN c.t < c.clock - {LATE} THEN 'late'
              WHEN x.alive IS NULL OR (NOT x.alive AND x.time < c.clock - {FORGET}) THEN CASE c.event WHEN 'create' THEN 'accepted' ELSE 'unknown order' END
              WHEN NOT x.alive THEN 'already removed'
              WHEN c.event = 'create' THEN 'already active'
              WHEN c.t > x.time THEN 'accepted' ELSE 'outdated' END AS outcome
          FROM s x JOIN c ON c.topic = x.topic AND c.order_id = x.order_id AND c.n = x.n + 1)))
    SELECT c.topic, c.order_id, c.seq, epoch_us(c.ts) AS micros, c.event, s.outcome FROM s JOIN c USING (topic, order_id, n)"""
)
def out_of_order_book(spark, sf_dir):
    """Outcomes of order events that come out of order, judged as they arrive, in several batches."""
    folder = fuzzy.in_arrival_order(arrivals(spark, sf_dir), 3)
    schema = arrivals(spark, sf_dir).schema
    out, checkpoint = shared_path(spark, "clocked"), shared_path(spark, "checkpoints")
    an_hour = 3_600_000 * 1_048_576
    fuzzy.clocked(streams.stream_series(spark, folder, schema, each=1), out, checkpoint, an_hour)
    whole = spark.read.parquet(f"{out}/batch=0").schema
    outcomes = streams.drained(fuzzy.fuzzy_book(streams.stream_series(spark, out, whole, each=64), LATE, FORGET))
    return outcomes.select("topic", "order_id", "seq", F.unix_micros("ts").alias("micros"), "event", "outcome")


#: Every three days' start a snapshot of each topic, an hour after its time: orders with events in the four days before,
#: but every third, and, under negative numbers, every fifth of them as orders that no event names.
SNAPSHOTS = f"""{ARRIVALS}, days AS (SELECT DISTINCT topic, CAST(floor(epoch_us(ts) / 259200000000) * 259200000000 AS BIGINT) AS day FROM arrivals),
  listed AS (
    SELECT DISTINCT d.topic, d.day, CASE WHEN ghost = 1 THEN -a.order_id ELSE a.order_id END AS order_id FROM days d
    JOIN arrivals a ON a.topic = d.topic AND epoch_us(a.ts) >= d.day - 345600000000 AND epoch_us(a.ts) < d.day
    JOIN (VALUES (0), (1)) g(ghost) ON (ghost = 0 AND a.order_id % 3 <> 0) OR (ghost = 1 AND a.order_id % 5 = 0))"""


def with_snapshots(spark, sf_dir):
    events = arrivals(spark, sf_dir)
    three_days = 259_200_000_000
    day = (F.floor(C.micros("ts") / three_days) * three_days).alias("day")
    headers = events.select("topic", day).distinct()
    # an order is listed by the snapshots of the four days after each of its events: two at most
    ahead = F.explode(F.array(*[F.floor(C.micros("ts") / three_days) * three_days + k * three_days for k in (1, 2)])).alias("day")
    seen = events.select("topic", "order_id", C.micros("ts").alias("t"), ahead).where(F.col("t") >= F.col("day") - 345_600_000_000)
    named = F.array_compact(F.array(F.when(F.col("order_id") % 3 != 0, F.col("order_id")), F.when(F.col("order_id") % 5 == 0, -F.col("order_id"))))
    orders = seen.select("topic", "day", F.explode(named).alias("order_id")).distinct().join(headers, ["topic", "day"], "left_semi")
    shots = headers.unionByName(orders, allowMissingColumns=True).select(
        "topic", "order_id", ((F.col("day") / 1000 + 3_600_000).cast("long") * 1_048_576 + 1_048_575).alias("seq"), F.timestamp_micros("day").alias("ts"), F.lit(True).alias("snapshot")
    )
    return events.withColumn("snapshot", F.lit(False)).unionByName(shots, allowMissingColumns=True)


LINGER = 36 * 3_600_000_000


@query(
    f"""WITH RECURSIVE {SNAPSHOTS},
    shots AS (SELECT topic, day AS t, (day // 1000 + 3600000) * 1048576 + 1048575 AS seq, lag(day) OVER (PARTITION BY topic ORDER BY day) AS day_before FROM days),
    orders AS (SELECT topic, order_id FROM arrivals UNION SELECT topic, order_id FROM listed),
    moves AS (
      SELECT topic, order_id, seq, epoch_us(ts) AS t, event, false AS has, false AS had FROM arrivals
      UNION ALL
      SELECT o.topic, o.order_id, s.seq, s.t, 'snapshot', l.order_id IS NOT NULL, b.order_id IS NOT NULL FROM orders o JOIN shots s USING (topic)
      LEFT JOIN listed l ON l.topic = o.topic AND l.order_id = o.order_id AND l.day = s.t LEFT JOIN listed b ON b.topic = o.topic AND b.order_id = o.order_id AND b.day = s.day_before),
    clocks AS (SELECT topic, seq, max(max(t)) OVER (PARTITION BY topic ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM moves GROUP BY topic, seq),
    c AS (SELECT m.*, clock, row_number() OVER (PARTITION BY topic, order_id ORDER BY seq) AS n FROM moves m JOIN clocks USING (topic, seq)),
    s(topic, order_id, n, seq, t, event, outcome, alive, time, suspect) AS (
      SELECT topic, order_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '', CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT), false FROM orders
      UNION ALL
      SELECT topic, order_id, n, seq, t, event, outcome, CASE WHEN takes THEN event <> 'delete' AND outcome <> 'lingering' ELSE alive END, CASE WHEN takes THEN t ELSE time END,
        CASE WHEN event = 'snapshot' THEN has AND unknown ELSE suspect END FROM (
        SELECT *, outcome IN ('accepted', 'missed', 'lingering') OR (outcome = 'unknown order' AND event = 'delete') AS takes FROM (
          SELECT x.topic, x.order_id, c.n, c.seq, c.t, c.event, c.has, x.alive, x.time, x.suspect, x.alive IS NULL OR (NOT x.alive AND x.time < coalesce(c.clock, 0) - {FORGET}) AS unknown,
            CASE WHEN c.event = 'snapshot' THEN CASE WHEN unknown AND c.has AND x.suspect THEN 'missed' WHEN x.alive AND NOT c.has AND x.time <= c.t - {LINGER} THEN 'lingering' ELSE '' END
              WHEN c.t < c.clock - {LATE} THEN 'late'
              WHEN unknown THEN CASE c.event WHEN 'create' THEN 'accepted' ELSE 'unknown order' END
              WHEN NOT x.alive THEN 'already removed'
              WHEN c.event = 'create' THEN 'already active'
              WHEN c.t > x.time THEN 'accepted' ELSE 'outdated' END AS outcome
          FROM s x JOIN c ON c.topic = x.topic AND c.order_id = x.order_id AND c.n = x.n + 1)))
    SELECT topic, order_id, seq, t AS micros, event, outcome FROM s WHERE outcome <> ''"""
)
def book_with_snapshots(spark, sf_dir):
    """T4, T5: the out-of-order book corrected by snapshots among its events, in four batches."""
    both = with_snapshots(spark, sf_dir)
    folder = fuzzy.in_arrival_order(both, 4)
    out, checkpoint = shared_path(spark, "clocked"), shared_path(spark, "checkpoints")
    fuzzy.clocked(streams.stream_series(spark, folder, both.schema, each=1), out, checkpoint, 3_600_000 * 1_048_576)
    whole = spark.read.parquet(f"{out}/batch=0").schema
    outcomes = streams.drained(fuzzy.fuzzy_book(streams.stream_series(spark, out, whole, each=64), LATE, FORGET, LINGER))
    return outcomes.select("topic", "order_id", "seq", F.unix_micros("ts").alias("micros"), "event", "outcome")


def feed_lines(spark, sf_dir):
    """The order feed as an exchange's JSON messages, every 101st of them broken."""
    f = views.order_feed(spark, sf_dir)
    text = {c: F.col(c).cast("decimal(12,2)").cast("string") for c in ("price", "size")}
    message = F.struct(
        F.col("kind").alias("type"),
        F.concat(F.lit("BTC-"), F.col("topic").cast("string")).alias("product_id"),
        F.col("seq").alias("sequence"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
        F.col("order_id").cast("string").alias("order_id"),
        text["price"].alias("price"),
        F.when(F.col("kind") == "open", text["size"]).alias("size"),
        F.when(F.col("kind") == "change", text["size"]).alias("new_size"),
        F.when(F.col("side") == "bid", "buy").when(F.col("side") == "ask", "sell").alias("side"),
    )
    line = F.to_json(message)
    return f.select(F.when(F.col("seq") % 101 == 0, F.substring(line, 2, 1000)).when(F.col("seq") % 103 == 0, F.regexp_replace(line, '"open"', '"opens"')).otherwise(line).alias("value"))


@query(
    f"""WITH {FEED} SELECT 'btc_' || topic AS topic, seq, epoch_us(ts) AS micros, kind, CAST(order_id AS VARCHAR) AS order_id, price, CASE WHEN kind = 'open' THEN size END AS size,
      CASE WHEN kind = 'change' THEN size END AS new_size, side FROM feed WHERE seq % 101 <> 0 AND NOT (seq % 103 = 0 AND kind = 'open')"""
)
def order_feed_parsed(spark, sf_dir):
    """An exchange's messages as events."""
    events, _ = feeds.parse_order_feed(feed_lines(spark, sf_dir))
    return events.select("topic", "seq", F.unix_micros("ts").alias("micros"), "kind", "order_id", "price", "size", "new_size", "side")


@query(
    f"""WITH {FEED} SELECT CASE WHEN seq % 101 = 0 THEN 'no message' ELSE 'unknown type' END AS error, count(*) AS n FROM feed WHERE seq % 101 = 0 OR (seq % 103 = 0 AND kind = 'open') GROUP BY ALL"""
)
def order_feed_quarantine(spark, sf_dir):
    """Messages that can't be read, with the reason."""
    _, bad = feeds.parse_order_feed(feed_lines(spark, sf_dir))
    return bad.groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT event_type AS topic, CAST(event_id AS VARCHAR) AS id, round(value, 2) AS price, CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction FROM events")
def trade_pages_parsed(spark, sf_dir):
    """S3: overlapping pages of trades, newest first, each trade once."""
    t = views.ticks(spark, sf_dir)
    top = t.groupBy("topic").agg(F.max("seqid").alias("top"))
    # pages of 40, each beginning with the 5 oldest trades of the page before
    placed = t.join(top, "topic").withColumn("back", F.col("top") - F.col("seqid"))
    page = F.floor(F.col("back") / 40)
    twice = F.when((F.col("back") % 40 >= 35), F.array(page, page + 1)).otherwise(F.array(page))
    item = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
        F.col("id").alias("trade_id"),
        F.col("price").cast("decimal(12,2)").cast("string").alias("price"),
        F.col("size").cast("string").alias("size"),
        F.when(F.col("direction") == "up", "sell").otherwise("buy").alias("side"),
    )
    rows = placed.select("topic", F.explode(twice).alias("page"), (-F.col("id")).alias("o"), item.alias("item"))
    listed = rows.groupBy("topic", "page").agg(F.array_sort(F.collect_list(F.struct("o", "item"))).alias("items"))
    pages = listed.select("topic", "page", F.to_json(F.transform("items", lambda x: x["item"])).alias("value"))
    return feeds.parse_trade_pages(pages, ["topic"]).select("topic", "id", "price", "direction")


@query(
    f"""WITH {FEED} SELECT topic, max(seq) OVER (PARTITION BY topic) AS seq, side, CAST(order_id AS VARCHAR) || '-' || seq AS order_id, price, size FROM feed WHERE kind = 'open'"""
)
def book_snapshot_parsed(spark, sf_dir):
    """A book snapshot's open orders."""
    f = views.order_feed(spark, sf_dir).where("kind = 'open'")
    row = F.array(F.col("price").cast("string"), F.col("size").cast("string"), F.concat_ws("-", F.col("order_id").cast("string"), F.col("seq").cast("string")))
    sides = [F.collect_list(F.when(F.col("side") == s, row)).alias(f"{s}s") for s in ("ask", "bid")]
    # a topic's snapshot comes in pages of about SNAPSHOT_PAGE orders, each with the topic's sequence
    whole = f.groupBy("topic").agg(F.max("seq").alias("sequence"), F.ceil(F.count("*") / SNAPSHOT_PAGE).alias("pages"))
    paged = f.join(whole, "topic").withColumn("page", F.pmod(F.xxhash64("order_id", "seq"), F.col("pages")))
    lines = paged.groupBy("topic", "page").agg(F.max("sequence").alias("sequence"), *sides).select("topic", F.to_json(F.struct("sequence", "asks", "bids")).alias("value"))
    return feeds.parse_book_snapshot(lines, ["topic"])


@query(
    """WITH c AS (SELECT user_id AS session_id, event_id AS seq, 'v' || (event_id % 3) AS name, CASE event_type WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' ELSE 'get' END AS op, value FROM events),
    w AS (SELECT *, max(CASE WHEN op <> 'get' THEN seq END) OVER (PARTITION BY session_id, name ORDER BY seq) AS last FROM c)
    SELECT w.session_id, w.seq, w.name, CASE WHEN c.op = 'set' THEN c.value END AS value FROM w LEFT JOIN c ON c.session_id = w.session_id AND c.seq = w.last"""
)
def named_values_kept(spark, sf_dir):
    """Named values of each session after every command."""
    kind = F.col("event_type")
    commands = event_stream(spark, sf_dir).select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.when(kind.isin("signup", "purchase"), "set").when(kind == "error", "delete").otherwise("get").alias("op"),
        F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("name"),
        "value",
    )
    return streams.drained(values.named_values(commands))


@query("SELECT event_id AS id, event_type AS topic, value AS price FROM events")
def ingested_stream(spark, sf_dir):
    """A stream appended to a table, batch by batch."""
    folder = shared_path(spark, "ingested")
    s = trade_stream(spark, sf_dir).select("id", "topic", "price")
    streams.ingest(s, folder, shared_path(spark, "checkpoints"), every=None).awaitTermination()
    return spark.read.parquet(folder).select("id", "topic", "price")


def ticks_in_files(spark, sf_dir, files):
    """Trades as so many files, each later than the one before: (folder, schema)."""
    e = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("topic"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"), F.col("event_id").alias("seq"))
    return fuzzy.in_arrival_order(e, files), e.schema


@query(f"WITH {TICKS} SELECT topic, id, seqid, CAST(7 AS BIGINT) AS bundle FROM ticks")
def ingested_series(spark, sf_dir):
    """A stream appended to a store in three batches, each row with its bundle and position."""
    files, schema = ticks_in_files(spark, sf_dir, 3)
    folder = shared_path(spark, "ingested")
    s = streams.stream_series(spark, files, schema, each=1)
    streams.ingest_series(s, folder, shared_path(spark, "checkpoints"), 7, ["topic"], ["ts", "id"]).awaitTermination()
    return spark.read.parquet(folder).select("topic", "id", "seqid", "bundle")


@query("SELECT event_type AS topic, event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def streamed_since(spark, sf_dir):
    """A stream of a series from a look-back on."""
    s = streams.stream_series(spark, sf_dir, views.table(spark, sf_dir, "events").schema, "events.parquet", since=dt.datetime(2024, 1, 20))
    return streams.drained(s.select(F.col("event_type").alias("topic"), F.col("event_id").alias("id")))


@query(
    """WITH j AS (SELECT event_type AS topic, event_id AS id, CAST(event_id // 3 - (event_id % 7) * 2 AS BIGINT) AS n FROM events)
    SELECT topic, id, n FROM (SELECT *, max(n) OVER (PARTITION BY topic ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM j) WHERE n > coalesce(seen, -1)"""
)
def streamed_increasing(spark, sf_dir):
    """Rows of a stream, in four batches, above all before them."""
    files, schema = ticks_in_files(spark, sf_dir, 4)
    n = (F.floor(F.col("id") / 3) - (F.col("id") % 7) * 2).cast("long")
    s = streams.stream_series(spark, files, schema, each=1).select("topic", "id", n.alias("n"))
    folder = shared_path(spark, "increasing")
    bucket = F.floor(F.col("id") / F.lit(1 << 16))
    streams.dedupe_increasing(s, folder, shared_path(spark, "checkpoints"), "n", ["topic"], ["id"], bucket).awaitTermination()
    return spark.read.parquet(folder).select("topic", "id", "n")
