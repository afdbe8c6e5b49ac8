"""Queries on series: bars, order, joins in time, stored histories, paths."""

from __future__ import annotations

import dataclasses
import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import paths as P
from tidemark.operators import analysis, asof, bars, order, replay
from tidemark.plans import views
from tidemark.plans.register import registry
from tidemark.sources import series as stored
from tidemark.sources import plugin
from tidemark.sources.shared import shared_path
from tidemark.streaming import streams

QUERIES, ORACLES, query = registry()

BY, AT = ["topic"], ["ts", "id"]

#: Ticks in SQL: events as trades with their position in the series.
TICKS = """ticks AS (
  SELECT 'events' AS source, event_type AS topic, 'trades' AS datatype, ts, event_id AS id, value AS price,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size,
    CASE WHEN event_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seqid
  FROM events)"""

BARS = (
    TICKS
    + """, bars AS (
  SELECT topic, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, (ts, seqid)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, (ts, seqid)) AS close, sum(size) AS volume
  FROM ticks GROUP BY topic, time_bucket(INTERVAL '1 hour', ts))"""
)

STORED = (
    TICKS
    + """, stored AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY topic, epoch_us(ts) // 14400000000 ORDER BY ts, id) = 1 AS is_snapshot,
      CAST(CASE dayofyear(ts) % 3 WHEN 0 THEN -1 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS bundle
    FROM ticks) WHERE is_snapshot OR seqid % 17 <> 0)"""
)


def hourly(spark, sf_dir):
    # ids rise with positions, so they order arrivals without numbering them first
    return bars.ohlcv(views.trades(spark, sf_dir), "1 hour", BY, seq="id")


def money(df, *names):
    """Sums rounded, as both engines add in their own order."""
    return df.withColumns({n: F.round(n, 4) for n in names})


@query(f"WITH {BARS} SELECT topic, ts, open, high, low, close, round(volume, 4) AS volume FROM bars")
def ohlcv_hourly(spark, sf_dir):
    """A1: hourly bars of every series."""
    return money(hourly(spark, sf_dir), "volume")


@query(
    f"""WITH {TICKS} SELECT topic, time_bucket(INTERVAL '15 minutes', ts) AS ts, arg_min(price, (ts, seqid)) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, (ts, seqid)) AS close, CAST(0 AS DOUBLE) AS volume FROM ticks GROUP BY ALL"""
)
def ohlc_quarter_hourly(spark, sf_dir):
    """A2: bars of prices without volume."""
    return bars.ohlc(views.trades(spark, sf_dir), "15 minutes", BY, seq="id")


@query(
    f"""WITH {BARS} SELECT topic, time_bucket(INTERVAL '1 day', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, ts) AS close, round(sum(volume), 4) AS volume FROM bars GROUP BY topic, time_bucket(INTERVAL '1 day', ts)"""
)
def candles_rolled_up_daily(spark, sf_dir):
    """A3: daily bars from hourly bars."""
    return money(bars.rollup_candles(hourly(spark, sf_dir), "1 day", BY), "volume")


FILLED = f"""{BARS}, grid AS (
  SELECT topic, unnest(generate_series(min(ts), max(ts), INTERVAL '1 hour')) AS ts FROM bars GROUP BY topic),
filled AS (
  SELECT grid.topic, grid.ts, open, high, low, bars.close AS own,
    last_value(bars.close IGNORE NULLS) OVER (PARTITION BY grid.topic ORDER BY grid.ts) AS close, coalesce(volume, 0) AS volume
  FROM grid LEFT JOIN bars USING (topic, ts))"""


@query(
    f"""WITH {FILLED} SELECT topic, ts, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close,
    round(volume, 4) AS volume FROM filled"""
)
def bars_gaps_filled(spark, sf_dir):
    """A4: hourly bars without gaps."""
    return money(bars.fill_gaps(hourly(spark, sf_dir), "1 hour", BY), "volume")


@query(
    f"""WITH RECURSIVE {TICKS}, t AS (SELECT topic, epoch_us(ts) AS t, seqid, price FROM ticks),
    s(topic, seqid, start) AS (
      SELECT topic, seqid, t FROM t WHERE seqid = 0
      UNION ALL
      SELECT t.topic, t.seqid, CASE WHEN s.start + 21600000000 < t.t THEN t.t ELSE s.start END FROM s JOIN t ON t.topic = s.topic AND t.seqid = s.seqid + 1)
    SELECT topic, make_timestamp(start) AS ts, arg_min(price, seqid) AS open, max(price) AS high, min(price) AS low, arg_max(price, seqid) AS close,
      CAST(0 AS DOUBLE) AS volume FROM s JOIN t USING (topic, seqid) GROUP BY topic, start"""
)
def bars_anchored(spark, sf_dir):
    """A5: six-hour bars that start at their first tick."""
    return bars.anchored_bars(views.trades(spark, sf_dir), 21_600_000_000, BY, seq="id")


@query(
    f"""WITH {BARS} SELECT topic, ts, close, next_close, CASE WHEN next_close > close THEN 'buy' WHEN next_close < close THEN 'sell' END AS signal
    FROM (SELECT *, lead(close) OVER (PARTITION BY topic ORDER BY ts) AS next_close FROM bars)"""
)
def lookahead_signals(spark, sf_dir):
    """What a trader who knows the next bar would do."""
    return bars.lookahead(hourly(spark, sf_dir), BY).select("topic", "ts", "close", "next_close", "signal")


@query(
    f"""WITH {BARS} SELECT topic, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY topic ORDER BY ts DESC) <= 100"""
)
def last_hundred_bars(spark, sf_dir):
    """The latest bars of each series."""
    return bars.last_bars(hourly(spark, sf_dir), 100, BY).select("topic", "ts", "close")


@query(f"WITH {TICKS} SELECT topic, id, seqid FROM ticks")
def numbered_ticks(spark, sf_dir):
    """Positions in each series."""
    return views.ticks(spark, sf_dir).select("topic", "id", "seqid")


#: A sequence that goes back and repeats, in order of the ids.
JUMPY = """jumpy AS (SELECT event_type AS topic, ts, event_id AS id, CAST(event_id // 3 - (event_id % 7) * 2 AS BIGINT) AS seq FROM events)"""


def jumpy(spark, sf_dir):
    seq = (F.floor(F.col("id") / 3) - (F.col("id") % 7) * 2).cast("long")
    return views.trades(spark, sf_dir).select("topic", "ts", "id", seq.alias("seq"))


@query(
    f"""WITH {JUMPY} SELECT topic, id, seq FROM (SELECT *, max(seq) OVER (PARTITION BY topic ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS seen FROM jumpy) WHERE seq > coalesce(seen, -1)"""
)
def increasing_only(spark, sf_dir):
    """Rows above all before them."""
    return order.dedupe_increasing(jumpy(spark, sf_dir), BY, AT, "seq").select("topic", "id", "seq")


@query(
    """WITH k AS (SELECT user_id % 10 AS grp, ts, event_id AS id, event_type AS kind FROM events)
    SELECT grp, id, kind FROM (SELECT *, lag(kind) OVER w AS before, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY grp ORDER BY ts, id))
    WHERE n = 1 OR kind IS DISTINCT FROM before"""
)
def consecutive_repeats_dropped(spark, sf_dir):
    """A row equal to the one right before it goes."""
    e = views.table(spark, sf_dir, "events")
    k = e.select((F.col("user_id") % 10).alias("grp"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return order.dedupe_consecutive(k, ["grp"], AT, "kind").select("grp", "id", "kind")


@query(
    f"""WITH {JUMPY}, k AS (SELECT *, seq // 5 AS bundle FROM jumpy)
    SELECT topic, id, bundle, seq FROM (SELECT *, max((bundle, seq)) OVER (PARTITION BY topic ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS seen FROM k) WHERE seen IS NULL OR (bundle, seq) > seen"""
)
def unordered_dropped(spark, sf_dir):
    """Rows above all before them by a composite key."""
    k = jumpy(spark, sf_dir).where("true").withColumn("bundle", F.expr("seq div 5"))
    return order.drop_unordered(k, BY, AT, ["bundle", "seq"]).select("topic", "id", "bundle", "seq")


@query(
    f"""WITH {JUMPY} SELECT topic, id, seq FROM (SELECT *, lag(seq) OVER (PARTITION BY topic ORDER BY ts, id) AS before FROM jumpy)
    WHERE before IS NULL OR seq > before"""
)
def unordered_against_previous(spark, sf_dir):
    """Rows above the raw row before them."""
    return order.drop_against_previous(jumpy(spark, sf_dir), BY, AT, "seq", unordered=True).select("topic", "id", "seq")


@query(
    """SELECT event_type AS topic, event_id AS id, value AS price, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS prev_price FROM events"""
)
def scan_with_previous(spark, sf_dir):
    """Each row with the one before it."""
    return order.with_previous(views.trades(spark, sf_dir), BY, AT, ["price"]).select("topic", "id", "price", "prev_price")


@query(
    f"""WITH {TICKS} SELECT topic, id, row_number() OVER (PARTITION BY topic, epoch_us(ts) // 14400000000 ORDER BY ts, id) = 1 AS is_snapshot FROM ticks"""
)
def snapshot_marks(spark, sf_dir):
    """The first row of every four hours is a snapshot."""
    return order.snapshot_points(views.trades(spark, sf_dir), BY, AT).select("topic", "id", "is_snapshot")


@query(
    f"""WITH {TICKS} SELECT topic, id FROM ticks JOIN (SELECT topic, min((ts, id)) AS s FROM ticks WHERE price > 300 GROUP BY topic) USING (topic)
    WHERE (ts, id) >= s"""
)
def after_first_marker(spark, sf_dir):
    """rows from the first marker on."""
    return order.after_first(views.trades(spark, sf_dir), BY, AT, F.col("price") > 300).select("topic", "id")


@query(
    f"""WITH {TICKS}, s AS (SELECT topic, max((ts, id)) AS s FROM ticks WHERE NOT price < 200 GROUP BY topic)
    SELECT ticks.topic, id FROM ticks LEFT JOIN s USING (topic) WHERE s IS NULL OR (ts, id) > s"""
)
def reverse_scan_while(spark, sf_dir):
    """The latest rows back to the first that fails."""
    return order.until_fails(views.trades(spark, sf_dir), BY, AT, F.col("price") < 200).select("topic", "id")


@query(f"WITH {TICKS} SELECT topic, ts, id, price FROM ticks ORDER BY ts DESC, id DESC LIMIT 50")
def latest_trades(spark, sf_dir):
    """The newest trades."""
    return order.latest(views.trades(spark, sf_dir), AT, 50).select("topic", "ts", "id", "price")


#: All series of the table of events.
TOPICS = ("signup", "click", "view", "purchase", "error")


@query("SELECT event_type AS topic, ts, event_id AS id, value AS price, event_type AS series FROM events")
def merged_by_time(spark, sf_dir):
    """All series as one."""
    t = views.trades(spark, sf_dir).select("topic", "ts", "id", "price")
    return order.merge_by_time(*[t.where(F.col("topic") == x).withColumn("series", F.lit(x)) for x in TOPICS])


@query(
    """WITH p AS (SELECT event_type AS topic, ts, event_id AS id, value AS price FROM events WHERE event_id % 5 = 0),
    l AS (SELECT event_type AS topic, ts, event_id AS id FROM events WHERE event_id % 5 <> 0)
    SELECT l.topic, l.id, p.price, p.ts AS price_ts FROM l ASOF LEFT JOIN (SELECT topic, ts, arg_max(price, id) AS price FROM p GROUP BY topic, ts) p
    ON l.topic = p.topic AND l.ts >= p.ts"""
)
def price_as_of(spark, sf_dir):
    """The latest price at or before each event."""
    t = views.trades(spark, sf_dir)
    left = t.where("id % 5 <> 0").select("topic", "ts", "id")
    right = t.where("id % 5 = 0").select("topic", "ts", "price", F.col("id").alias("rid"))
    return asof.asof_join(left, right, BY, "price", right_order=["rid"]).select("topic", "id", "price", "price_ts")


@query(
    """WITH p AS (SELECT event_type AS topic, ts, value AS price, event_id AS id FROM events WHERE event_id % 50 = 0),
    l AS (SELECT event_type AS topic, ts, event_id AS id FROM events WHERE event_id % 50 <> 0),
    j AS (SELECT l.topic, l.id, l.ts, p.price, p.ts AS price_ts FROM l ASOF LEFT JOIN (SELECT topic, ts, arg_max(price, id) AS price FROM p GROUP BY topic, ts) p
    ON l.topic = p.topic AND l.ts >= p.ts)
    SELECT topic, id, CASE WHEN price_ts >= ts - INTERVAL 1 HOUR THEN price END AS price FROM j"""
)
def price_as_of_within_hour(spark, sf_dir):
    """J1 with a tolerance."""
    t = views.trades(spark, sf_dir)
    left = t.where("id % 50 <> 0").select("topic", "ts", "id")
    right = t.where("id % 50 = 0").select("topic", "ts", "price", F.col("id").alias("rid"))
    return asof.asof_join(left, right, BY, "price", right_order=["rid"], tolerance="1 hour").select("topic", "id", "price")


#: Intervals of events, in seconds since the first of January 2024.
SPANS = """spans AS (SELECT event_type AS topic, event_id AS id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + 60 + event_id % 600 AS hi FROM events)"""


@query(
    f"""WITH {SPANS} SELECT a.topic, a.id AS a_id, b.id AS b_id FROM spans a JOIN spans b ON a.topic = b.topic AND a.id % 2 = 0 AND b.id % 2 = 1
    AND a.lo < b.hi AND b.lo < a.hi"""
)
def overlapping_intervals(spark, sf_dir):
    """Intervals of one series that overlap."""
    t = views.trades(spark, sf_dir)
    lo = F.floor(C.micros("ts") / 1_000_000)
    s = t.select("topic", "id", lo.alias("lo"), (lo + 60 + F.col("id") % 600).alias("hi"))
    return asof.overlap_join(s.where("id % 2 = 0"), s.where("id % 2 = 1"), BY, 300).select("topic", "a_id", "b_id")


@query(
    f"""WITH {STORED}, o AS (
      SELECT *, max(CASE WHEN is_snapshot THEN bundle END) OVER (PARTITION BY topic ORDER BY ts, NOT is_snapshot, bundle, seqid) AS cur FROM stored),
    c AS (SELECT *, sum(CAST(is_snapshot AS INTEGER)) OVER (PARTITION BY topic ORDER BY ts, NOT is_snapshot, bundle, seqid) AS seg FROM o WHERE bundle = cur),
    s AS (SELECT topic, seg, seqid AS start FROM c WHERE is_snapshot),
    w AS (SELECT c.*, start FROM c JOIN s USING (topic, seg) WHERE is_snapshot OR seqid > start),
    n AS (SELECT *, row_number() OVER (PARTITION BY topic, seg ORDER BY NOT is_snapshot, ts, bundle, seqid) - 1 AS pos FROM w),
    k AS (SELECT * FROM n WHERE is_snapshot OR seqid = start + pos),
    d AS (SELECT *, lag((bundle, seqid)) OVER (PARTITION BY topic ORDER BY ts, NOT is_snapshot, bundle, seqid) AS before FROM k)
    SELECT topic, id, bundle, seqid FROM d WHERE before IS NULL OR before IS DISTINCT FROM (bundle, seqid)"""
)
def replayed_history(spark, sf_dir):
    """What a reader sees of snapshots and deltas with gaps and competing bundles."""
    return replay.replay(views.stored_rows(spark, sf_dir)).select("topic", "id", "bundle", "seqid")


@query(
    f"""WITH {TICKS}, b AS (SELECT topic, ts, id, CAST(1 AS BIGINT) AS bundle, seqid, 0 AS live FROM ticks WHERE id % 10 < 8
      UNION ALL SELECT topic, ts, id, 1, seqid, 1 FROM ticks WHERE id % 10 > 5),
    s AS (SELECT *, max((bundle, seqid)) OVER (PARTITION BY topic ORDER BY ts, live, bundle, seqid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b)
    SELECT topic, id, seqid FROM s WHERE seen IS NULL OR (bundle, seqid) > seen"""
)
def stitched_history(spark, sf_dir):
    """History and live rows that overlap, each once."""
    t = views.ticks(spark, sf_dir).select("topic", "ts", "id", "seqid").withColumn("bundle", F.lit(1).cast("long"))
    return replay.stitch(t.where("id % 10 < 8"), t.where("id % 10 > 5"), BY).select("topic", "id", "seqid")


@query(f"WITH {STORED} SELECT DISTINCT bundle, source, topic, datatype FROM stored")
def series_catalog(spark, sf_dir):
    """Bundles and their paths."""
    return stored.catalog(views.stored_rows(spark, sf_dir))


@query(
    f"""WITH {STORED} SELECT bundle, min(CASE WHEN is_snapshot THEN ts END) AS first_snapshot, max(ts) AS last_ts, count(*) AS n FROM stored GROUP BY bundle"""
)
def stored_bundle_ranges(spark, sf_dir):
    """What each bundle covers."""
    return stored.bundle_ranges(views.stored_rows(spark, sf_dir))


@query(
    """SELECT event_type AS topic, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value, count(*) AS n
    FROM events GROUP BY event_type"""
)
def series_first_last_size(spark, sf_dir):
    """Ends and size of each series."""
    return stored.series_ends(views.trades(spark, sf_dir), BY, AT, "price")


@query("SELECT event_id AS id, event_type AS topic, value AS price FROM events WHERE event_id = 77")
def series_find_key(spark, sf_dir):
    """A row by its exact key."""
    return stored.series_find(views.trades(spark, sf_dir), "id", 77).select("id", "topic", "price")


#: Rules, first match first: purchases for a day, signups for twelve hours, the rest for ten days.
RULES = [("events", "purchase", "trades", "1d", 1), ("*", "signup", "*", "12h", 2), ("*", "*", "*", "10d", 3)]


def rules(spark):
    return spark.createDataFrame(RULES, "source string, topic string, datatype string, ttl string, rule int")


@query(
    """SELECT event_type AS topic, event_id AS id FROM events
    WHERE ts >= TIMESTAMP '2024-04-10' - CASE event_type WHEN 'purchase' THEN INTERVAL 80 DAY ELSE INTERVAL 90 DAY END"""
)
def retention_by_default(spark, sf_dir):
    """Rows whose path has no rule of its own are kept for the default time."""
    own = rules(spark).where("rule = 1").withColumn("ttl", F.lit("80d"))
    return stored.apply_retention(views.trades(spark, sf_dir), own, dt.datetime(2024, 4, 10)).select("topic", "id")


@query(
    """SELECT event_type AS topic, event_id AS id FROM events
    WHERE ts >= TIMESTAMP '2024-01-20' - CASE event_type WHEN 'purchase' THEN INTERVAL 1 DAY WHEN 'signup' THEN INTERVAL 12 HOUR ELSE INTERVAL 10 DAY END"""
)
def retention_applied(spark, sf_dir):
    """Rows that their path's rule still keeps."""
    kept = stored.apply_retention(views.trades(spark, sf_dir), rules(spark), dt.datetime(2024, 1, 20))
    return kept.select("topic", "id")


@query(
    """SELECT event_type AS topic, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS rule, count(*) AS n FROM events GROUP BY ALL"""
)
def rule_of_each_path(spark, sf_dir):
    """The first rule that matches a row's path."""
    ruled = P.pattern_join(views.trades(spark, sf_dir), rules(spark), "rule")
    return ruled.groupBy("topic", "rule").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'events' AS source, event_type AS topic, 'trades' AS datatype FROM events WHERE event_type IN ('click', 'view')")
def patterns_resolved(spark, sf_dir):
    """paths that any pattern matches."""
    patterns = spark.createDataFrame([("*", "click", "*"), ("events", "view", "trades"), ("other", "*", "*")], "source string, topic string, datatype string")
    return P.resolve_pattern(views.trades(spark, sf_dir), patterns)


@query("SELECT event_type AS topic, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type")
def enabled_rows(spark, sf_dir):
    """F8: rows whose path is enabled."""
    on = spark.createDataFrame([("events", "click", "*"), ("*", "error", "trades")], "source string, topic string, datatype string")
    return P.enabled_paths(views.trades(spark, sf_dir), on).groupBy("topic").agg(F.count("*").alias("n"))


@query("SELECT event_id AS id, value AS price FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'")
def one_path_in_range(spark, sf_dir):
    """One series in [from, to)."""
    t = views.trades(spark, sf_dir).where(P.path_eq("events", "click", "trades"))
    return t.where(P.time_range("ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9))).select("id", "price")


@query("SELECT event_id AS id FROM events WHERE event_type = 'view'")
def panel_filters(spark, sf_dir):
    """the panel's ad-hoc filters."""
    wanted = [{"key": "topic", "operator": "=", "value": "view"}, {"key": "source", "operator": "=", "value": "*"}, {"key": "topic", "operator": "!=", "value": "x"}]
    return views.trades(spark, sf_dir).where(P.adhoc_filter(wanted)).select("id")


@query(
    f"""WITH {TICKS}, l AS (SELECT topic, ts, id, seqid FROM ticks WHERE seqid >= 20), f AS (SELECT topic, min(seqid) AS first FROM l GROUP BY topic),
    p AS (SELECT topic, ts, id FROM ticks WHERE seqid < 40),
    q AS (SELECT topic, ts, id, least(0, coalesce(first, 0)) + row_number() OVER (PARTITION BY topic ORDER BY ts, id) - 1 - count(*) OVER (PARTITION BY topic) AS seqid
      FROM p LEFT JOIN f USING (topic))
    SELECT topic, id, seqid FROM l UNION ALL SELECT topic, id, seqid FROM q"""
)
def backfill_merged(spark, sf_dir):
    """Backfilled rows get positions below the live ones."""
    t = views.ticks(spark, sf_dir).select("topic", "ts", "id", "seqid")
    pages = t.where("seqid < 40").drop("seqid")
    return stored.backfill_merge(t.where("seqid >= 20"), pages, BY, AT).select("topic", "id", "seqid")


@query(
    """SELECT event_type AS topic, event_id AS id, CAST(1 + sum(CASE WHEN ts > before + INTERVAL 2 HOUR THEN 1 ELSE 0 END)
      OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS bundle
    FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)"""
)
def bundles_assigned(spark, sf_dir):
    """A pause opens a new bundle."""
    return stored.assign_bundles(views.trades(spark, sf_dir), BY, AT, "2 hours").select("topic", "id", "bundle")


@query("SELECT event_type AS symbol, 'events' AS exchange, arg_max(value, (ts, event_id)) AS price FROM events GROUP BY event_type")
def latest_price(spark, sf_dir):
    """The last price of every market, whose symbol must name one exchange."""
    t = views.trades(spark, sf_dir).withColumnsRenamed({"topic": "symbol", "source": "exchange"})
    return order.latest_price(t, AT)


@query(f"WITH {STORED} SELECT bundle, coalesce(min(CASE WHEN is_snapshot THEN seqid END), 0) AS earliest FROM stored GROUP BY bundle")
def earliest_position(spark, sf_dir):
    """The first stored position of a bundle."""
    shots = F.min(F.when(F.col("is_snapshot"), F.col("seqid")))
    return views.stored_rows(spark, sf_dir).groupBy("bundle").agg(F.coalesce(shots, F.lit(0)).alias("earliest"))


@query(
    """WITH r AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS total FROM events)
    SELECT CAST(least(40, 1 + floor((value - lo) / ((hi - lo) / 40))) AS INTEGER) AS bin, count(*) / CAST(any_value(total) AS DOUBLE) AS share FROM events, r GROUP BY 1"""
)
def value_histogram(spark, sf_dir):
    """Forty equal bins, relative frequency."""
    from tidemark.operators.report import histogram

    return histogram(views.trades(spark, sf_dir), "price", 40)


@query(
    """SELECT event_id AS id, epoch_us(ts) AS micros, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS taker,
      CASE WHEN event_id % 2 = 0 THEN 'sell' ELSE 'buy' END AS maker, (event_id % 48 + 1) * 1800000000 AS step,
      CASE WHEN (event_id % 48 + 1) * 30 % 1440 = 0 THEN ((event_id % 48 + 1) * 30 // 1440) || 'd'
        WHEN (event_id % 48 + 1) % 2 = 0 THEN ((event_id % 48 + 1) // 2) || 'h' ELSE ((event_id % 48 + 1) * 30) || 'm' END AS step_text,
      sign(value) * ceil(CAST(abs(CAST(value AS DECIMAL(20, 6))) * 10 AS DECIMAL(20, 6)) - 0.5) / 10.0 AS rounded FROM events"""
)
def column_expressions(spark, sf_dir):
    """Times, durations, sides, rounding with halves toward zero."""
    t = views.trades(spark, sf_dir)
    minutes = ((F.col("id") % 48 + 1) * 30).cast("string")
    step = C.duration_micros(F.concat(minutes, F.lit("m")))
    return t.select(
        "id",
        C.micros("ts").alias("micros"),
        C.taker_side("direction").alias("taker"),
        C.maker_side("direction").alias("maker"),
        step.alias("step"),
        C.duration_text(step).alias("step_text"),
        C.round_half_down("price", 1).alias("rounded"),
    )


@query(
    """SELECT event_id AS id, 'events' AS source, event_type AS topic, 'candles' AS kind, (event_id % 9 + 1) * 60000000 AS step_micros, lower(event_type) AS base, 'usd' AS quote FROM events"""
)
def texts_of_paths_parsed(spark, sf_dir):
    """Paths, datatypes and pairs as text."""
    t = views.trades(spark, sf_dir)
    path = F.concat_ws("/", "source", "topic", F.concat(F.lit("candles_"), (F.col("id") % 9 + 1).cast("string"), F.lit("m")))
    parts = t.select("id", *P.split_path(path), F.concat(F.upper("topic"), F.lit("-USD")).alias("pair"))
    return parts.select("id", "source", "topic", *P.split_datatype("datatype")[:2], *P.split_pair("pair"))


@query(
    """WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE event_id % 3 END AS bundle, CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id % 2 END AS slice FROM events)
    SELECT a.id FROM s a WHERE (a.bundle = 1 OR a.bundle = -1) AND (a.slice = 0 OR a.slice = -1)"""
)
def slices_matched(spark, sf_dir):
    """slices that match (1, 0), -1 matching any."""
    k = F.col("id")
    s = views.trades(spark, sf_dir).select("id", F.when(k % 5 == 0, -1).otherwise(k % 3).alias("bundle"), F.when(k % 7 == 0, -1).otherwise(k % 2).alias("slice"))
    wanted = spark.createDataFrame([(1, 0)], "bundle long, slice long")
    return P.slice_join(s, wanted).select("id")


@query(
    """SELECT event_id AS id, epoch_us(ts) AS micros, CASE WHEN event_id % 4 = 3 THEN CAST(event_id * 10 AS VARCHAR)
      ELSE event_id || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.5' ELSE '.025' END END AS stripped FROM events"""
)
def iso_times_and_numbers(spark, sf_dir):
    """ISO times with nine digits; numbers with zeroes behind the point, behind a fraction, and without a point."""
    t = views.trades(spark, sf_dir)
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z"))
    k = F.col("id")
    ends = F.when(k % 4 == 0, ".000").when(k % 4 == 1, ".50").when(k % 4 == 2, ".025000").otherwise("0")
    return t.select("id", C.iso_micros(iso).alias("micros"), C.strip_zeroes(F.concat(k.cast("string"), ends)).alias("stripped"))


def store(spark, rows):
    """Rows written as a store of series in the shared folder."""
    folder = shared_path(spark, "series")
    stored.write_series(rows, folder)
    return folder


@query(
    "SELECT event_id AS id, value AS price FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09'"
)
def stored_path_in_range(spark, sf_dir):
    """One series of a store in [from, to); only its days are read."""
    rows = views.ticks(spark, sf_dir).withColumn("bundle", F.lit(1).cast("long"))
    now = dt.datetime(2025, 1, 1)
    return stored.read_series(spark, store(spark, rows), "events", "click", "trades", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9), now).select("id", "price")


@query(
    f"""WITH {STORED}, f AS (SELECT * FROM stored WHERE topic = 'view' AND ts >= TIMESTAMP '2024-01-10 02:00:00' - INTERVAL 4 HOUR AND ts < TIMESTAMP '2024-01-14'),
    o AS (SELECT *, max(CASE WHEN is_snapshot THEN bundle END) OVER (ORDER BY ts, NOT is_snapshot, bundle, seqid) AS cur FROM f),
    c AS (SELECT *, sum(CAST(is_snapshot AS INTEGER)) OVER (ORDER BY ts, NOT is_snapshot, bundle, seqid) AS seg FROM o WHERE bundle = cur),
    w AS (SELECT c.*, s.seqid AS start FROM c JOIN (SELECT seg, seqid FROM c WHERE is_snapshot) s USING (seg) WHERE is_snapshot OR c.seqid > s.seqid),
    n AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY NOT is_snapshot, ts, bundle, seqid) - 1 AS pos FROM w)
    SELECT id, bundle, seqid FROM n WHERE (is_snapshot OR seqid = start + pos) AND ts >= TIMESTAMP '2024-01-10 02:00:00'"""
)
def stored_path_replayed(spark, sf_dir):
    """A series of snapshots and deltas, read with a look-back for a snapshot, replayed and trimmed."""
    folder = store(spark, views.stored_rows(spark, sf_dir))
    start, end = dt.datetime(2024, 1, 10, 2), dt.datetime(2024, 1, 14)
    return stored.read_series(spark, folder, "events", "view", "trades", start, end, dt.datetime(2025, 1, 1), replayed=True).select("id", "bundle", "seqid")


@query("SELECT event_type AS topic, event_id AS id, value AS price FROM events")
def backfilled_store_converges(spark, sf_dir):
    """Live rows and overlapping pages of history, stored and read back, are each trade once."""
    t = views.ticks(spark, sf_dir).withColumn("bundle", F.lit(1).cast("long"))
    half = t.groupBy("topic").agg(F.max("seqid").alias("last"))
    placed = t.join(half, "topic")
    live = placed.where("seqid * 3 >= last").drop("last")
    pages = placed.where("seqid * 2 <= last").drop("last", "seqid")
    folder = store(spark, stored.backfill_merge(live, pages, order.PATH, AT))
    # overlap is resolved by the trade's id
    return order.dedupe_increasing(spark.read.parquet(folder).drop("date"), order.PATH, [*AT, "seqid"], "id").select("topic", "id", "price")


@query(f"WITH {STORED} SELECT topic, id, bundle, seqid, row_number() OVER (PARTITION BY topic ORDER BY bundle, seqid) - 1 AS place FROM stored")
def stored_rows_by_position(spark, sf_dir):
    """O2: the rows of each series in order of their bundles and positions."""
    rows = order.by_position(views.stored_rows(spark, sf_dir))
    return order.numbered(rows, order.PATH, ["bundle", "seqid"], "place", F.col("bundle")).select("topic", "id", "bundle", "seqid", "place")


@query(
    """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value * 2 ELSE value * 4 END AS price, CASE WHEN event_id % 5 < 2 THEN 'sell' ELSE 'buy' END AS side,
      CAST(CASE WHEN event_id % 5 < 2 THEN 2 - event_id % 5 ELSE event_id % 5 - 1 END AS BIGINT) AS qty, epoch_us(ts) AS micros, make_timestamp(epoch_us(ts)) AS ts,
      CASE WHEN event_id % 11 IN (3, 4) THEN 'time' WHEN event_id % 3 = 0 THEN 'number' ELSE 'string' END AS kind, CASE WHEN event_id % 7 = 0 THEN '{"id":' || event_id || '}' ELSE '{"id":' || event_id || ',"topic":"' || event_type || '"}' END AS line,
      value + value * 2 AS total FROM events"""
)
def values_of_rows(spark, sf_dir):
    """Prices of rows of several types, signed sizes, times, JSON without nulls, kinds of JSON values, sums of one unit."""
    k, v = F.col("event_id"), F.col("value")
    e = views.table(spark, sf_dir, "events")
    signed = F.when(k % 5 < 2, k % 5 - 2).otherwise(k % 5 - 1)
    price = C.priced(F.when(k % 3 == 0, v), F.when(k % 3 == 1, v * 2), v * 4)
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.lit('"text"')).otherwise(F.lit("true"))
    line = F.to_json(F.struct(k.alias("id"), F.when(k % 7 != 0, F.col("event_type")).alias("topic")))
    unit = F.lit("usd")
    key = F.when(k % 11 == 3, "time").when(k % 11 == 4, "micros").when(k % 11 == 5, "price")
    return e.select(
        k.alias("id"), price.alias("price"), C.side_of(signed).alias("side"), F.abs(signed).alias("qty"), C.micros("ts").alias("micros"), C.from_micros(C.micros("ts")).alias("ts"),
        C.json_kind(text, key).alias("kind"), line.alias("line"), C.checked_sum(v, unit, v * 2, unit).alias("total"),
    )


@query(f"WITH {TICKS} SELECT topic, unnest(generate_series(min(date_trunc('day', ts)), max(ts), INTERVAL '6 hours')) AS ts FROM ticks GROUP BY topic")
def grids_of_series(spark, sf_dir):
    """C14: a grid of six hours over the time of each series."""
    t = views.trades(spark, sf_dir).groupBy("topic").agg(F.min(F.date_trunc("day", "ts")).cast("timestamp_ntz").alias("a"), F.max("ts").alias("b"))
    return t.select("topic", F.explode(C.tick_grid(F.col("a"), F.col("b"), "6 hours", inclusive=True)).alias("ts"))


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY")
def rows_of_a_paper_run(spark, sf_dir):
    """Rows that a paper run with a look-back of five days begins with."""
    now = dt.datetime(2024, 1, 20)
    start, end = C.run_range("paper:5d", int((now - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)))
    since = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=start)
    P.validate_selection(since, end, now)
    return views.trades(spark, sf_dir).where(P.time_range("ts", since, end)).select("id")


@dataclasses.dataclass(frozen=True)
class Closes:
    step: str
    least_volume: float = 0.0


CLOSES = analysis.Analysis(("events/click/*", "*/view/trades"), lambda rows, p: bars.ohlcv(rows, p.step, BY, seq="id").where(F.col("volume") >= p.least_volume), Closes)


@query(f"WITH {BARS} SELECT topic, ts, close FROM bars WHERE topic IN ('click', 'view') AND volume >= 100")
def analysis_of_paths(spark, sf_dir):
    """An analysis over declared paths with parameters as JSON, given rows of its caller's choice."""
    found = analysis.analysed(CLOSES, views.trades(spark, sf_dir), '{"step": "1 hour", "least_volume": 100}')
    return found.select("topic", "ts", "close")


@query("SELECT event_type AS topic, count(*) AS n, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY event_type")
def stored_first_last_size(spark, sf_dir):
    """Paths of a store, their ends and sizes, from the files' footers."""
    rows = views.ticks(spark, sf_dir).withColumn("bundle", F.lit(1).cast("long"))
    return stored.stored_ends(spark, store(spark, rows), "price").select("topic", "n", "first_value", "last_value")


@query("SELECT event_type AS topic, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY ALL")
def stored_days(spark, sf_dir):
    """The days of each path of a store and their sizes, from listing and footers."""
    folder = store(spark, views.ticks(spark, sf_dir).withColumn("bundle", F.lit(1).cast("long")))
    days = stored.stored_files(spark, folder).select(*order.PATH, "date").distinct()
    return days.join(stored.stored_sizes(spark, folder), [*order.PATH, "date"]).select("topic", F.col("date").cast("string").alias("date"), "n")


@query(
    """SELECT event_type AS topic, event_id AS id, value AS price FROM events
    WHERE ts >= TIMESTAMP '2024-01-20 07:00:00' - CASE event_type WHEN 'purchase' THEN INTERVAL 1 DAY WHEN 'signup' THEN INTERVAL 12 HOUR ELSE INTERVAL 10 DAY END"""
)
def retention_enforced(spark, sf_dir):
    """What is left in a store after its expired days are deleted, twice."""
    folder = store(spark, views.ticks(spark, sf_dir).withColumn("bundle", F.lit(1).cast("long")))
    for _ in range(2):
        stored.enforce_retention(spark, folder, rules(spark), dt.datetime(2024, 1, 20, 7))
    return spark.read.parquet(folder).select("topic", "id", "price")


@query("SELECT event_type AS topic, event_id AS id, value AS price, ts FROM events")
def own_source_converges(spark, sf_dir):
    """History by pages and live rows by offsets, from a source of a user's own, are each trade once."""
    t = views.ticks(spark, sf_dir).select("topic", F.col("ts").cast("timestamp").alias("ts"), "id", "price", "seqid")
    last = t.groupBy("topic").agg(F.max("seqid").alias("last"))
    placed = t.join(last, "topic")
    folder = shared_path(spark, "recorded")
    plugin.record(placed.where("seqid * 8 <= last * 7").drop("last", "seqid"), placed.where("seqid * 8 >= last * 5").drop("last", "seqid"), folder, 1000, 700, AT)
    spark.dataSource.register(plugin.Recorded)
    schema = t.select(F.col("topic").alias("topic_name"), "ts", "id", "price").schema
    options = {"path": folder, "schema": schema.json(), "rows_per_partition": "500"}
    pages = spark.read.format("recorded").options(**options).load()
    live = streams.drained(spark.readStream.format("recorded").options(**options).load())
    once = pages.unionByName(live).dropDuplicates(["topic_name", "id"])
    return once.select(F.col("topic_name").alias("topic"), "id", "price", F.col("ts").cast("timestamp_ntz").alias("ts"))
