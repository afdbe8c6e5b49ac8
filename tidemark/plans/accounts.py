"""Queries on instruments, accounts and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import fx, portfolio, positions, report
from tidemark.operators.chains import conversion_chains
from tidemark.plans import views
from tidemark.plans.register import OFF_TIES, registry
from tidemark.plans.series import FILLED, TICKS
from tidemark.streaming import fuzzy, streams
from tidemark.streaming.state import stream_liveness

QUERIES, ORACLES, query = registry()

FILLS = """fills AS (
  SELECT o_custkey AS account, l_suppkey AS market, l_orderkey AS order_id, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
    l_quantity AS size, l_extendedprice / l_quantity AS price, l_tax AS fee, l_shipdate AS ts,
    (l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS fill_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
LEGS = (
    FILLS
    + """, legs AS (
  SELECT account, market, ts, fill_key, 'base' AS asset, CASE side WHEN 'buy' THEN size ELSE -size END AS delta FROM fills
  UNION ALL
  SELECT account, market, ts, fill_key, 'quote', CASE side WHEN 'buy' THEN -size * price / (1 - fee) ELSE size * price * (1 - fee) END FROM fills)"""
)
MARKETS = """markets AS (
  SELECT lower(r_name) AS exchange, lower(n_name) AS base, lower(r_name) AS quote, (n_nationkey + 2) / CAST(4 AS DOUBLE) AS price FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'hub', lower(a.r_name), lower(b.r_name), (a.r_regionkey + 3) / CAST(2 AS DOUBLE) FROM region a JOIN region b ON a.r_regionkey + 1 = b.r_regionkey)"""
RATES = (
    MARKETS
    + """, steps AS (SELECT base AS src, quote AS dst, price AS rate FROM markets UNION ALL SELECT quote, base, 1 / price FROM markets),
walks(asset, rate, n_hops, path, seen) AS (
  SELECT 'asia', CAST(1 AS DOUBLE), 0, 'asia', ['asia']
  UNION ALL
  SELECT src, steps.rate * walks.rate, n_hops + 1, src || '>' || path, list_append(seen, src) FROM walks JOIN steps ON dst = asset WHERE NOT list_contains(seen, src)),
rates AS (SELECT asset, arg_min(rate, (n_hops, path)) AS rate, min(n_hops) AS n_hops, arg_min(path, (n_hops, path)) AS path FROM walks GROUP BY asset)"""
)

def leg_assets():
    return F.lit("base"), F.lit("quote")


def years():
    """Every 365 days of the time that line items span."""
    start, end = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (1992, 1999))
    return C.tick_grid(start, end, "365 days", inclusive=True)


def rates(spark, sf_dir):
    return fx.rates_to(views.instruments(spark, sf_dir), "asia")


@query(f"WITH {LEGS} SELECT account, asset, round(sum(delta), 4) AS delta FROM legs GROUP BY account, asset")
def fills_settled(spark, sf_dir):
    """Change of balances by fills."""
    out = portfolio.settle(views.fills(spark, sf_dir), ["account"], *leg_assets())
    return out.withColumn("delta", F.round("delta", 4))


@query(
    f"""WITH {LEGS} SELECT account, asset, CAST(fill_key[1] AS BIGINT) AS order_id, ts, round({OFF_TIES:.10f} + sum(delta) OVER (PARTITION BY account, asset ORDER BY ts, fill_key
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS balance FROM legs"""
)
def balances_over_time(spark, sf_dir):
    """Balances after every fill."""
    out = portfolio.running_balance(views.fills(spark, sf_dir), ["account"], *leg_assets(), ["ts", "fill_key"])
    return out.select("account", "asset", "order_id", "ts", F.round(F.col("balance") + OFF_TIES, 3).alias("balance"))


@query(
    f"""WITH RECURSIVE {FILLS}, n AS (SELECT *, row_number() OVER (PARTITION BY account, market ORDER BY ts, fill_key) AS i,
      CASE side WHEN 'buy' THEN size ELSE -size END AS d FROM fills),
    s(account, market, i, order_id, pos, entry, realized) AS (
      SELECT account, market, i, order_id, d, CASE WHEN d <> 0 THEN price END, CAST(0 AS DOUBLE) FROM n WHERE i = 1
      UNION ALL
      SELECT n.account, n.market, n.i, n.order_id, pos + d,
        CASE WHEN pos + d = 0 THEN NULL WHEN pos = 0 OR sign(pos + d) <> sign(pos) THEN price
          WHEN abs(pos + d) > abs(pos) THEN (entry * abs(pos) + price * abs(d)) / abs(pos + d) ELSE entry END,
        CASE WHEN pos = 0 OR sign(d) = sign(pos) THEN 0 ELSE sign(pos) * least(abs(d), abs(pos)) * (price - entry) END
      FROM s JOIN n ON s.account = n.account AND s.market = n.market AND n.i = s.i + 1)
    SELECT account, market, order_id, pos AS position, round(entry + {OFF_TIES:.10f}, 4) AS entry, round(realized + {OFF_TIES:.10f}, 3) AS realized FROM s"""
)
def positions_over_time(spark, sf_dir):
    """Positions, average entry and realized profit after every fill."""
    out = positions.position_series(views.fills(spark, sf_dir), ["account", "market"], ["ts", "fill_key"])
    return out.select("account", "market", "order_id", "position", F.round(F.col("entry") + OFF_TIES, 4).alias("entry"), F.round(F.col("realized") + OFF_TIES, 3).alias("realized"))


@query(
    """WITH p AS (SELECT CAST(s_nationkey AS BIGINT) AS nation, s_suppkey % 7 - 3 AS size, s_acctbal AS entry, s_suppkey FROM supplier)
    SELECT r_name AS exchange, n_name AS asset, round(sum(size * (100.0 + n_nationkey - entry)), 3) AS delta
    FROM p JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def positions_closed(spark, sf_dir):
    """Profit of closing every position, credited to its settlement asset."""
    s, n, r = (views.table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    positions = s.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("exchange"), F.col("n_name").alias("symbol"), (F.col("s_suppkey") % 7 - 3).alias("size"),
        F.col("s_acctbal").alias("entry_price"), F.col("n_name").alias("settled_in"),
    )
    prices = places.select(F.col("r_name").alias("exchange"), F.col("n_name").alias("symbol"), (100.0 + F.col("n_nationkey")).alias("price"))
    return portfolio.close_positions(positions, prices).withColumn("delta", F.round("delta", 3))


@query(f"WITH RECURSIVE {RATES} SELECT asset, round(rate, 6) AS rate, n_hops, path FROM rates")
def conversion_rates(spark, sf_dir):
    """The cheapest chain of markets from every asset."""
    return rates(spark, sf_dir).withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH RECURSIVE {RATES}, near(asset, rate, n_hops, path, seen) AS (
      SELECT 'asia', CAST(1 AS DOUBLE), 0, 'asia', ['asia'] UNION ALL
      SELECT src, e.rate * near.rate, n_hops + 1, src || '>' || path, list_append(seen, src) FROM near
      JOIN (SELECT base AS src, quote AS dst, price AS rate FROM markets WHERE exchange IN ('asia', 'europe') UNION ALL SELECT quote, base, 1 / price FROM markets WHERE exchange IN ('asia', 'europe')) e
      ON dst = asset WHERE NOT list_contains(seen, src)),
    n AS (SELECT asset, arg_min(rate, (n_hops, path)) AS rate, min(n_hops) AS n_hops, arg_min(path, (n_hops, path)) AS path FROM near GROUP BY asset)
    SELECT asset, round(rate, 6) AS rate, n_hops, path FROM n UNION ALL SELECT asset, round(rate, 6), n_hops, path FROM rates WHERE asset NOT IN (SELECT asset FROM n)"""
)
def conversion_rates_near(spark, sf_dir):
    """Chains on two exchanges first, then on all."""
    return fx.rates_near(views.instruments(spark, sf_dir), "asia", ["asia", "europe"]).withColumn("rate", F.round("rate", 6))


@query(
    """WITH RECURSIVE pegs(a, b) AS (VALUES ('usd', 'usdt'), ('usd', 'usdc'), ('usd', 'dai'), ('usd', 'tusd'), ('usd', 'bitusd'), ('btc', 'xbt')),
    both_ways AS (SELECT a, b FROM pegs UNION SELECT b, a FROM pegs),
    equal(a, b) AS (SELECT a, a FROM both_ways UNION SELECT equal.a, both_ways.b FROM equal JOIN both_ways ON equal.b = both_ways.a),
    markets AS (
      SELECT lower(n_name) AS base, (['usdc', 'xbt', 'tusd', 'eur', 'bitusd'])[r_regionkey + 1] AS quote, (n_nationkey + 2) / CAST(4 AS DOUBLE) AS price
      FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION ALL SELECT CASE r_regionkey WHEN 0 THEN 'btc' ELSE 'eur' END, 'dai', CASE r_regionkey WHEN 0 THEN CAST(40 AS DOUBLE) ELSE 1.25 END FROM region WHERE r_regionkey < 2),
    steps AS (SELECT base AS src, quote AS dst, price AS rate FROM markets UNION ALL SELECT quote, base, 1 / price FROM markets),
    walks(asset, rate, n_hops, path, seen) AS (
      SELECT 'usdt', CAST(1 AS DOUBLE), 0, 'usdt', (SELECT list(b) FROM equal WHERE a = 'usdt')
      UNION ALL
      SELECT src, s.rate * w.rate, n_hops + 1, src || '>' || CASE WHEN dst = asset THEN '' ELSE dst || '=' END || path,
        list_concat(seen, coalesce((SELECT list(b) FROM equal WHERE a = src), [src]))
      FROM walks w JOIN steps s ON (dst = asset OR (dst, asset) IN (SELECT a, b FROM equal)) AND NOT list_contains(seen, src)),
    best AS (
      SELECT coalesce((SELECT min(b) FROM equal WHERE a = asset), asset) AS class, arg_min(asset, (n_hops, path)) AS entry, arg_min(rate, (n_hops, path)) AS rate,
        min(n_hops) AS n_hops, arg_min(path, (n_hops, path)) AS path FROM walks GROUP BY 1),
    named AS (SELECT a AS asset FROM equal UNION SELECT src FROM steps)
    SELECT asset, round(rate, 6) AS rate, n_hops, CASE WHEN asset = entry THEN '' ELSE asset || '=' END || path AS path
    FROM named JOIN best ON class = coalesce((SELECT min(b) FROM equal WHERE a = asset), asset)"""
)
def conversion_rates_pegged(spark, sf_dir):
    """Chains through currencies that pegs of pegs hold equal, at no hop."""
    rates = fx.rates_to(views.pegged_instruments(spark, sf_dir), "usdt")
    return rates.withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH RECURSIVE {RATES} SELECT c_mktsegment AS account, round(sum(c_acctbal * rate), 2) AS equity
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN rates ON asset = lower(n_name) GROUP BY c_mktsegment"""
)
def equity_by_segment(spark, sf_dir):
    """Balances of all customers in one currency."""
    c, n = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "nation")
    held = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    balances = held.select(F.col("c_mktsegment").alias("account"), F.lower("n_name").alias("asset"), F.col("c_acctbal").alias("qty"))
    return portfolio.equity(balances, rates(spark, sf_dir), ["account"]).withColumn("equity", F.round("equity", 2))


@query(f"WITH {MARKETS} SELECT DISTINCT exchange, base AS asset FROM markets UNION SELECT DISTINCT exchange, quote FROM markets")
def accounts_of_exchanges(spark, sf_dir):
    """All assets of each exchange."""
    m = views.instruments(spark, sf_dir).select("exchange", F.col("base").alias("security"), F.col("quote").alias("settled_in"))
    return fx.all_accounts(m)


@query(
    f"""WITH {MARKETS}, w AS (SELECT DISTINCT lower(n_name) AS base, lower(r_name) AS quote FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON c_custkey % 5 = r_regionkey)
    SELECT w.base, w.quote, w.quote AS exchange, m.base || '_' || m.quote AS symbol FROM w LEFT JOIN markets m ON m.exchange = w.quote AND m.base = w.base AND m.quote = w.quote"""
)
def markets_found(spark, sf_dir):
    """The market of a pair on an exchange."""
    c, n, r = (views.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    m = views.instruments(spark, sf_dir)
    listed = m.select("exchange", F.col("base").alias("security"), F.col("quote").alias("settled_in"), F.concat_ws("_", "base", "quote").alias("symbol"))
    name = F.lower("r_name")
    asked = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("c_custkey") % 5 == F.col("r_regionkey"))
    wanted = asked.select(F.lower("n_name").alias("base"), name.alias("exchange"), name.alias("quote")).distinct()
    return fx.find_market(wanted, listed)


@query(
    """WITH n AS (SELECT n_nationkey AS id, lower(n_name) AS own, CAST(n_nationkey + 1 AS DOUBLE) AS r1, CASE WHEN n_nationkey % 2 = 0 THEN 0.5 ELSE CAST(4 AS DOUBLE) END AS r2 FROM nation)
    SELECT id, own AS base, 'eur' AS quote,
      CASE id % 4 WHEN 0 THEN r1 * r2 WHEN 1 THEN r1 / r2 WHEN 2 THEN r2 / r1 ELSE 1 / (r1 * r2) END AS rate FROM n"""
)
def rates_composed(spark, sf_dir):
    """Two rates joined: as they are, the second turned over, the first, or both; usdc and usdt are held equal."""
    n = views.table(spark, sf_dir, "nation")
    k, own = F.col("n_nationkey"), F.lower("n_name")
    turn = k % 4
    first, second = turn.isin(0, 1), turn.isin(0, 2)  # as it is, not turned over
    p = n.select(k.alias("id"), F.when(first, own).otherwise("usdc").alias("base"), F.when(first, "usdc").otherwise(own).alias("quote"), (k + 1).cast("double").alias("rate"))
    q = n.select(
        k.alias("id"), F.when(second, "usdt").otherwise("eur").alias("base"), F.when(second, "eur").otherwise("usdt").alias("quote"),
        F.when(k % 2 == 0, 0.5).otherwise(4.0).alias("rate"),
    )
    return fx.compose(p, q)


BALANCES = """a AS (SELECT c_nationkey AS exchange, c_mktsegment AS security, sum(c_acctbal) AS qty FROM customer WHERE c_custkey % 3 <> 0 GROUP BY ALL),
b AS (SELECT c_nationkey AS exchange, c_mktsegment AS security, sum(c_acctbal) AS qty FROM customer WHERE c_custkey % 3 <> 1 AND c_nationkey % 2 = 0 GROUP BY ALL)"""


def two_portfolios(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("exchange"), F.col("c_mktsegment").alias("security"), "c_acctbal", "c_custkey")
    qty = F.sum("c_acctbal").alias("qty")
    a = c.where("c_custkey % 3 <> 0").groupBy("exchange", "security").agg(qty)
    return a, c.where("c_custkey % 3 <> 1 and exchange % 2 = 0").groupBy("exchange", "security").agg(qty)


@query(f"WITH {BALANCES} SELECT exchange, security, round(coalesce(b.qty, a.qty), 3) AS qty FROM a FULL JOIN b USING (exchange, security)")
def portfolios_merged(spark, sf_dir):
    """The second portfolio over the first."""
    merged = portfolio.merge(*two_portfolios(spark, sf_dir), ["exchange", "security"], "qty")
    return merged.withColumn("qty", F.round("qty", 3))


@query(
    f"""WITH {BALANCES} SELECT exchange, security, round(a.qty, 3) AS qty FROM a LEFT JOIN b USING (exchange, security)
    WHERE b.qty IS NULL OR round(a.qty, 3) <> round(b.qty, 3)"""
)
def portfolios_compared(spark, sf_dir):
    """What the first has and the second has not, or differently."""
    a, b = (x.withColumn("qty", F.round("qty", 3)) for x in two_portfolios(spark, sf_dir))
    return portfolio.difference(a, b, ["exchange", "security"], "qty")


@query(f"WITH {BALANCES} SELECT exchange, security, round(qty, 3) AS qty FROM a WHERE exchange <> 3")
def portfolio_without_exchange(spark, sf_dir):
    """P5: one exchange left out."""
    return portfolio.without_exchange(two_portfolios(spark, sf_dir)[0], 3).withColumn("qty", F.round("qty", 3))


@query(
    """WITH t AS (SELECT o_custkey AS target, o_orderdate AS ts, o_orderkey AS id, round(o_totalprice, -5) AS price, CAST(o_orderkey % 2 AS DOUBLE) AS size FROM orders)
    SELECT target, id, CASE WHEN row_number() OVER w = 1 THEN 'post' WHEN price = lag(price) OVER w AND size = lag(size) OVER w THEN 'none' ELSE 'replace' END AS action
    FROM t WINDOW w AS (PARTITION BY target ORDER BY ts, id)"""
)
def order_target_actions(spark, sf_dir):
    """Whether a target changes the order that stands."""
    o = views.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    t = o.select(F.col("o_custkey").alias("target"), F.col("o_orderdate").alias("ts"), k.alias("id"), F.round("o_totalprice", -5).alias("price"), (k % 2).cast("double").alias("size"))
    return portfolio.order_targets(t, ["target"], ["ts", "id"]).select("target", "id", "action")


@query(
    """WITH s AS (SELECT c_nationkey AS exchange, c_mktsegment AS security, c_custkey % 5 AS snapshot, sum(c_acctbal) AS qty FROM customer GROUP BY ALL)
    SELECT exchange, security, snapshot, round(qty, 3) AS qty FROM s WHERE snapshot = (SELECT max(snapshot) FROM s x WHERE x.exchange = s.exchange) AND exchange % 6 <> 0"""
)
def accounts_synced(spark, sf_dir):
    """The latest snapshot of every exchange that could be loaded."""
    c = views.table(spark, sf_dir, "customer")
    s = c.groupBy(F.col("c_nationkey").alias("exchange"), F.col("c_mktsegment").alias("security"), (F.col("c_custkey") % 5).alias("snapshot")).agg(F.sum("c_acctbal").alias("qty"))
    failed = c.where("c_nationkey % 6 = 0").select(F.col("c_nationkey").alias("exchange"))
    return portfolio.latest_accounts(s, failed).withColumn("qty", F.round("qty", 3))


@query(
    f"""WITH {LEGS}, g AS (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1999-01-01', INTERVAL '365 days')) AS ts),
    h AS (SELECT account, asset, ts, sum(delta) OVER (PARTITION BY account, asset ORDER BY ts, fill_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS qty, fill_key FROM legs),
    l AS (SELECT account, asset, ts, arg_max(qty, fill_key) AS qty FROM h GROUP BY ALL),
    p AS (SELECT account, asset, g.ts FROM (SELECT account, asset, min(ts) AS s FROM l GROUP BY ALL) JOIN g ON g.ts >= s)
    SELECT p.account, p.asset, p.ts, round(qty, 2) AS qty FROM p ASOF LEFT JOIN l ON p.account = l.account AND p.asset = l.asset AND p.ts >= l.ts"""
)
def portfolio_by_year(spark, sf_dir):
    """Balances at the start of every year."""
    changes = portfolio.legs(views.fills(spark, sf_dir), *leg_assets())
    out = portfolio.portfolio_history(changes, ["account"], years())
    return out.select("account", "asset", "ts", F.round("qty", 2).alias("qty"))


@query(
    """SELECT 'trade' AS kind, o_orderdate AS ts, o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01'
    UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'withdraw' ELSE 'deposit' END, o_orderdate, o_orderkey, o_totalprice FROM orders
    WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1997-01-01'"""
)
def transaction_history(spark, sf_dir):
    """Trades, deposits and withdrawals since a date."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), "o_orderpriority", "o_orderstatus")
    traded, gone = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") == "F"
    parts = [o.where(c).select("ts", "id", "amount") for c in (traded, ~traded & ~gone, ~traded & gone)]
    return portfolio.transactions(*parts, dt.datetime(1997, 1, 1))


@query(
    f"""WITH {TICKS} SELECT source || '/' || topic || '/' || datatype AS path, epoch_us(ts) // 1000 AS time, direction, id, price, seqid, size FROM ticks ORDER BY ts DESC, id DESC LIMIT 100"""
)
def panel_newest_trades(spark, sf_dir):
    """R2: the trades panel."""
    return report.panel_trades(views.ticks(spark, sf_dir), 100, ["ts", "id"])


@query(f"WITH {FILLED} SELECT 'local.events.click' AS key, close, epoch_us(ts) // 1000 AS time FROM filled WHERE topic = 'click'")
def panel_price_series(spark, sf_dir):
    """The price panel of one series, without gaps."""
    return report.panel_prices(views.trades(spark, sf_dir), "events/click/trades", "1 hour", seq="id")


#: Report events: events of 20 sessions put, update and remove values and append to lists.
REPORT = """report AS (SELECT user_id % 20 AS session_id, event_id AS seq, ts, 'k' || (event_id % 7) AS key, CAST(value AS VARCHAR) AS payload,
  CASE event_type WHEN 'signup' THEN 'put' WHEN 'click' THEN 'update' WHEN 'error' THEN 'remove' WHEN 'view' THEN 'collection' ELSE 'candle_add' END AS kind,
  event_id // 500 AS bar FROM events)"""


def report_events(spark, sf_dir):
    e, kind = views.table(spark, sf_dir, "events"), F.col("event_type")
    return e.select(
        (F.col("user_id") % 20).alias("session_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string")).alias("key"),
        F.col("value").alias("payload"),
        F.when(kind == "signup", "put").when(kind == "click", "update").when(kind == "error", "remove").when(kind == "view", "collection").otherwise("candle_add").alias("kind"),
        F.expr("event_id div 500").alias("bar"),
    )


@query(
    f"""WITH {REPORT} SELECT session_id, key, row_number() OVER (PARTITION BY session_id, key ORDER BY ts, seq) - 1 AS place, CAST(payload AS DOUBLE) AS payload
    FROM report WHERE kind = 'collection'"""
)
def report_collections(spark, sf_dir):
    """Lists of each session."""
    return report.collections(report_events(spark, sf_dir))


@query(
    f"""WITH {REPORT} SELECT session_id, key, CAST(arg_max(payload, seq) AS DOUBLE) AS payload FROM report WHERE kind IN ('put', 'update', 'remove')
    GROUP BY session_id, key HAVING arg_max(kind, seq) <> 'remove'"""
)
def report_last_values(spark, sf_dir):
    """Values of each session, last write wins."""
    return report.report_values(report_events(spark, sf_dir))


@query(
    f"""WITH {REPORT} SELECT session_id, key, bar, CAST(arg_max(payload, seq) AS DOUBLE) AS payload FROM report WHERE kind = 'candle_add' GROUP BY ALL"""
)
def report_last_bars(spark, sf_dir):
    """Of additions and updates of a bar the last."""
    return report.report_series(report_events(spark, sf_dir))


@query("SELECT DISTINCT 'events/' || event_type || '/trades' AS target FROM events")
def panel_targets(spark, sf_dir):
    """What a panel can search."""
    return views.trades(spark, sf_dir).select(F.concat_ws("/", "source", "topic", "datatype").alias("target")).distinct()


@query(
    """SELECT user_id AS bot, max(ts) AS last_ts, max(ts) + INTERVAL 1 DAY * (user_id % 3) < TIMESTAMP '2024-01-31' AND user_id % 3 > 0 AS expired FROM events GROUP BY user_id"""
)
def bots_expired(spark, sf_dir):
    """Bots whose last heartbeat is older than their time to live; 0 is never."""
    from tidemark.streaming.state import liveness

    e = views.table(spark, sf_dir, "events")
    beats = e.select(F.col("user_id").alias("bot"), "ts", ((F.col("user_id") % 3) * 86_400_000_000).alias("ttl_micros"))
    return liveness(beats, dt.datetime(2024, 1, 31))


@query(
    """WITH b AS (SELECT CAST(user_id % 200 AS INTEGER) AS bot, epoch_us(ts) AS t, max((event_id % 5) * 7200000000) AS ttl FROM events GROUP BY ALL),
    n AS (SELECT *, lead(t) OVER w AS later, lag(t) OVER w AS earlier, lag(t + ttl) OVER w AS held, lag(ttl) OVER w AS ttl_before FROM b WINDOW w AS (PARTITION BY bot ORDER BY t))
    SELECT bot, t AS micros, 'alive' AS state FROM n WHERE earlier IS NULL OR (ttl_before > 0 AND held < t)
    UNION ALL SELECT bot, t + ttl, 'expired' FROM n WHERE ttl > 0 AND t + ttl < coalesce(later, (SELECT max(t) // 1000 * 1000 FROM b))"""
)
def bots_expiring(spark, sf_dir):
    """Bots as they come alive and expire, from a stream of heartbeats in five batches."""
    e = views.table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq")
    folder = fuzzy.in_arrival_order(e, 5)
    beats = streams.stream_series(spark, folder, e.schema, each=1).select(
        (F.col("user_id") % 200).cast("int").alias("bot"), "ts", (F.col("seq") % 5 * 7_200_000_000).alias("ttl_micros")
    )
    return streams.drained(stream_liveness(beats)).select("bot", F.unix_micros("ts").alias("micros"), "state")


@query(
    f"""WITH {TICKS}, c AS (SELECT CAST(user_id % 10 AS INTEGER) AS account, event_type AS asset, ts, event_id AS id, CAST(event_id % 5 - 2 AS DOUBLE) AS delta FROM events WHERE event_id % 2 = 1),
    p AS (SELECT event_type AS asset, ts, arg_max(value, event_id) AS price FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
    e AS (SELECT a.account, a.ts, a.id, b.asset, sum(b.delta) AS held FROM c a JOIN c b ON a.account = b.account AND (b.ts, b.id) <= (a.ts, a.id) GROUP BY ALL),
    v AS (SELECT e.*, p.price FROM e ASOF LEFT JOIN p ON e.asset = p.asset AND e.ts >= p.ts)
    SELECT account, ts, id, round(sum(held * coalesce(price, 0)) + {OFF_TIES:.10f}, 3) AS equity FROM v GROUP BY ALL"""
)
def equity_after_changes(spark, sf_dir):
    """Equity after every change of a balance, assets at their own prices."""
    t = views.trades(spark, sf_dir)
    e = views.table(spark, sf_dir, "events")
    changes = e.where("event_id % 2 = 1").select(
        (F.col("user_id") % 10).cast("int").alias("account"), F.col("event_type").alias("asset"), "ts", F.col("event_id").alias("id"), (F.col("event_id") % 5 - 2).cast("double").alias("delta")
    )
    prices = t.where("id % 2 = 0").groupBy(F.col("topic").alias("asset"), "ts").agg(F.max_by("price", "id").alias("price"))
    out = portfolio.equity_curve(changes, prices, ["account"], ["ts", "id"])
    return out.select("account", "ts", "id", F.round(F.col("equity") + OFF_TIES, 3).alias("equity"))


@query(
    f"""WITH {FILLS}, places AS (SELECT n_nationkey, lower(n_name) AS nation, lower(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
    c AS (
      SELECT account, nation AS asset, region, ts, fill_key, CASE side WHEN 'buy' THEN size ELSE -size END AS delta
      FROM fills JOIN supplier ON market = s_suppkey JOIN places ON s_nationkey = n_nationkey
      UNION ALL
      SELECT account, region, region, ts, fill_key, CASE side WHEN 'buy' THEN -size * price / (1 - fee) ELSE size * price * (1 - fee) END
      FROM fills JOIN supplier ON market = s_suppkey JOIN places ON s_nationkey = n_nationkey),
    e AS (
      SELECT a.account, a.ts, a.fill_key, b.asset, b.region, sum(b.delta) AS held FROM (SELECT DISTINCT account, ts, fill_key FROM c) a
      JOIN c b ON a.account = b.account AND (b.ts, b.fill_key) <= (a.ts, a.fill_key) GROUP BY ALL),
    p1 AS (SELECT nation AS asset, l_shipdate AS ts, max(l_extendedprice / l_quantity) / 1000 AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = n_nationkey GROUP BY ALL),
    p2 AS (SELECT region, o_orderdate AS ts, max(o_totalprice) / 100000 AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey GROUP BY ALL),
    p3 AS (SELECT o_orderdate AS ts, max(o_totalprice) / 200000 AS p FROM orders GROUP BY ALL),
    v AS (
      SELECT e.*, CASE WHEN e.asset = e.region THEN 1 ELSE p1.p END * p2.p * p3.p AS rate FROM e
      ASOF LEFT JOIN p1 ON e.asset = p1.asset AND e.ts >= p1.ts ASOF LEFT JOIN p2 ON e.region = p2.region AND e.ts >= p2.ts ASOF LEFT JOIN p3 ON e.ts >= p3.ts)
    SELECT account, ts, CAST(fill_key[1] AS BIGINT) AS order_id, CAST(fill_key[2] AS INTEGER) AS line, round(sum(held * coalesce(rate, 0)) + {OFF_TIES:.10f}, 2) AS equity
    FROM v GROUP BY account, ts, fill_key"""
)
def equity_through_chains(spark, sf_dir):
    """Equity after every fill in a currency that no asset trades in directly, at rates as of then."""
    fills, supplier = views.fills(spark, sf_dir), views.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # table by table, so that the size of each is known when the plan is made
    fills = fills.join(supplier, F.col("market") == F.col("s_suppkey")).join(views.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    fills = fills.join(views.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumns({"base": F.lower("n_name"), "quote": F.lower("r_name")})
    changes = fills.select("account", "ts", "fill_key", portfolio.moves(F.col("base"), F.col("quote")).alias("moves"))
    prices = views.market_prices(spark, sf_dir)
    found = conversion_chains(prices.groupBy("exchange", "base", "quote").agg(F.max_by("price", "ts").alias("price")), "eur")
    out = portfolio.equity_curve(changes, prices, ["account"], ["ts", "fill_key"], found)
    line = [F.col("fill_key.l_orderkey").alias("order_id"), F.col("fill_key.l_linenumber").alias("line")]
    return out.select("account", "ts", *line, F.round(F.col("equity") + OFF_TIES, 2).alias("equity"))


@query(
    f"""WITH o AS (SELECT o_orderkey AS order_id, CAST(o_custkey % 2000 + 1 AS BIGINT) AS ladder, o_orderdate + INTERVAL 1 DAY AS ts, CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
      CASE WHEN o_orderkey % 4 <> 2 THEN CAST(o_orderkey % 60 + 1 AS DOUBLE) END AS size, CASE WHEN o_orderkey % 4 = 2 THEN o_totalprice * (1 - 0.003::DOUBLE) END AS funds,
      CASE WHEN o_orderkey % 4 <> 2 AND o_orderkey % 5 = 0 THEN o_totalprice / 4 END AS "limit" FROM orders),
    l AS (SELECT l_partkey AS ladder, date_trunc('year', l_shipdate) AS ts, CASE WHEN l_linestatus = 'O' THEN 'ask' ELSE 'bid' END AS side, round(l_extendedprice, -2) AS price, sum(l_quantity) AS qty
      FROM lineitem GROUP BY ALL),
    s AS (SELECT DISTINCT ladder, ts FROM l),
    p AS (SELECT CAST(l_orderkey % 2000 + 1 AS BIGINT) AS ladder, l_shipdate AS ts, max(round(l_extendedprice, 0)) AS last FROM lineitem GROUP BY ALL),
    j AS (SELECT o.*, s.ts AS lts, p.last FROM o ASOF LEFT JOIN s ON o.ladder = s.ladder AND o.ts >= s.ts ASOF LEFT JOIN p ON o.ladder = p.ladder AND o.ts >= p.ts),
    c AS (SELECT *, coalesce(sum(qty) OVER w, 0) AS q0, coalesce(sum(price * qty) OVER w, 0) AS c0 FROM l
      WINDOW w AS (PARTITION BY ladder, ts, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    h AS (SELECT j.ladder, order_id, c.price, CASE WHEN size IS NOT NULL THEN least(qty, size - q0) WHEN j.side = 'buy' THEN least(qty, (funds - c0) / price) END AS fill
      FROM j JOIN c ON j.ladder = c.ladder AND j.lts = c.ts AND c.side = CASE j.side WHEN 'buy' THEN 'ask' ELSE 'bid' END
        AND ("limit" IS NULL OR CASE j.side WHEN 'buy' THEN c.price <= "limit" ELSE c.price >= "limit" END)
      UNION ALL SELECT ladder, order_id, last, CASE WHEN size IS NOT NULL THEN size WHEN side = 'buy' THEN funds / last END FROM j
        WHERE lts IS NULL AND last IS NOT NULL AND ("limit" IS NULL OR CASE side WHEN 'buy' THEN last <= "limit" ELSE last >= "limit" END)),
    f AS (SELECT ladder, order_id, sum(fill) AS filled, sum(price * fill) AS cost FROM h WHERE fill > 0 GROUP BY ALL)
    SELECT j.ladder, j.order_id, round(coalesce(filled, 0) + {OFF_TIES:.10f}, 4) AS filled, round(coalesce(cost, 0) + {OFF_TIES:.10f}, 4) AS cost, round(coalesce(cost, 0) * 0.003 + {OFF_TIES:.10f}, 4) AS fee,
      round(CASE WHEN size IS NOT NULL THEN size - coalesce(filled, 0) ELSE funds - coalesce(cost, 0) END + {OFF_TIES:.10f}, 4) AS unfilled FROM j LEFT JOIN f USING (ladder, order_id)"""
)
def execution_costs(spark, sf_dir):
    """What orders, by size or funds, with and without limit, would have cost a day later against the ladder there was, or at the last price."""
    k = F.col("o_orderkey")
    by_size = k % 4 != 2
    orders = views.table(spark, sf_dir, "orders").select(
        k.alias("order_id"), (F.col("o_custkey") % 2000 + 1).alias("ladder"), F.col("o_orderdate").alias("ts"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"),
        F.when(by_size, (k % 60 + 1).cast("double")).alias("size"), F.when(~by_size, F.col("o_totalprice")).alias("funds"), F.when(by_size & (k % 5 == 0), F.col("o_totalprice") / 4).alias("limit"),
    )
    li = views.table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid").alias("side")
    year = F.date_trunc("year", "l_shipdate").cast("timestamp_ntz").alias("ts")
    ladders = li.groupBy(F.col("l_partkey").alias("ladder"), year, side, F.round("l_extendedprice", -2).alias("price")).agg(F.sum("l_quantity").alias("qty"))
    prices = li.groupBy((F.col("l_orderkey") % 2000 + 1).alias("ladder"), F.col("l_shipdate").alias("ts")).agg(F.max(F.round("l_extendedprice", 0)).alias("price"))
    costs = portfolio.execution_cost(orders, ladders, prices, ["ladder"], "1 day", F.lit(0.003))
    return costs.select("ladder", "order_id", *[F.round(F.col(c) + OFF_TIES, 4).alias(c) for c in ("filled", "cost", "fee", "unfilled")])


@query(
    """SELECT 'c' || o_orderkey AS client_oid, o_orderkey AS order_id, o_custkey AS target FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'"""
)
def order_ids_linked(spark, sf_dir):
    """Client and exchange ids of orders that are open and not done."""
    o = views.table(spark, sf_dir, "orders")
    received = o.select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("client_oid"), F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("target"))
    opened = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("order_id"))
    done = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"))
    return portfolio.order_links(received, opened, done)


@query(
    f"""WITH {MARKETS} SELECT DISTINCT exchange, base || '_' || quote AS symbol FROM markets
    WHERE base IN (SELECT lower(n_name) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9900)"""
)
def instruments_tradable(spark, sf_dir):
    """listed instruments whose topic is in use."""
    m = views.instruments(spark, sf_dir).select("exchange", F.concat_ws("_", "base", "quote").alias("symbol"), "base")
    c, n = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "nation")
    rich = c.where("c_acctbal > 9900").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("base")).distinct()
    topics = m.join(rich, "base").select(F.col("symbol").alias("topic"))
    return fx.tradable(m.where("exchange = 'hub'"), m, topics)


@query(
    """WITH p AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'eur' WHEN 1 THEN 'xrp' WHEN 2 THEN 'btc' ELSE 'eth' END AS base,
      CASE WHEN event_id % 3 = 0 THEN 'usd' WHEN event_id % 3 = 1 THEN 'eur' ELSE 'btc' END AS quote, CAST(value AS DECIMAL(20, 6)) / 8 AS x FROM events),
    d AS (SELECT *, CASE WHEN base = 'eur' AND quote = 'usd' THEN 5 WHEN base = 'xrp' AND quote IN ('usd', 'eur') THEN 5 WHEN quote IN ('usd', 'eur') THEN 2 ELSE 8 END AS n FROM p)
    SELECT id, n AS digits, ceil(CAST(CAST(x AS DECIMAL(20, 9)) * CAST(pow(10, n) AS DECIMAL(12, 0)) AS DECIMAL(30, 9)) - 0.5) / pow(10, n) AS amount FROM d"""
)
def amounts_rounded(spark, sf_dir):
    """Amounts at the precision of their pair."""
    k = F.col("id")
    t = views.trades(spark, sf_dir).select(
        "id",
        F.when(k % 4 == 0, "eur").when(k % 4 == 1, "xrp").when(k % 4 == 2, "btc").otherwise("eth").alias("base"),
        F.when(k % 3 == 0, "usd").when(k % 3 == 1, "eur").otherwise("btc").alias("quote"),
        (F.col("price") / 8).alias("x"),
    )
    base, quote = F.col("base"), F.col("quote")
    return t.select("id", fx.digits(base, quote, True).alias("digits"), fx.rounded(F.col("x"), base, quote, True).alias("amount"))


@query(
    """SELECT event_type AS topic, ask AS bid_price, bid AS ask_price, aq AS bid_qty, bq AS ask_qty FROM
    (SELECT event_type, min(value) AS bid, max(value) AS ask, count(*) AS bq, count(*) + 1 AS aq FROM events GROUP BY event_type)"""
)
def quotes_reversed(spark, sf_dir):
    """quotes from the other side."""
    t = views.trades(spark, sf_dir)
    q = t.groupBy("topic").agg(F.min("price").alias("bid_price"), F.max("price").alias("ask_price"), F.count("*").alias("bid_qty"), (F.count("*") + 1).alias("ask_qty"))
    return fx.reversed_quote(q)


@query(
    """WITH l AS (SELECT user_id % 50 AS bot, event_id AS seq, event_type AS kind, value AS payload FROM events),
    g AS (SELECT bot, max(seq) AS gone FROM l WHERE kind = 'error' GROUP BY bot)
    SELECT l.bot, kind, arg_max(payload, seq) AS payload, max(seq) AS seq FROM l LEFT JOIN g ON l.bot = g.bot WHERE kind <> 'error' AND (gone IS NULL OR seq > gone) GROUP BY l.bot, kind"""
)
def bot_states(spark, sf_dir):
    """The state of every bot since it last expired."""
    from tidemark.streaming.state import latest_state

    kind = F.when(F.col("event_type") == "error", "expired").otherwise(F.col("event_type")).alias("kind")
    log = views.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("bot"), F.col("event_id").alias("seq"), kind, F.col("value").alias("payload"))
    return latest_state(log)


@query("SELECT n_name AS exchange, 'coinbase' AS rules, 0.0::DOUBLE AS maker, 0.003::DOUBLE AS taker, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0 GROUP BY n_name UNION ALL SELECT n_name, 'bitstamp', 0.0005, 0.0005, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 1 GROUP BY n_name UNION ALL SELECT n_name, 'bitfinex', 0.001, 0.002, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 2 GROUP BY n_name")
def fees_of_accounts(spark, sf_dir):
    """P10: the fees that accounts trade at."""
    c, n = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "nation")
    k = F.col("c_custkey") % 3
    on = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("place"), F.when(k == 0, "coinbase").when(k == 1, "bitstamp").otherwise("bitfinex").alias("exchange"))
    return portfolio.with_fees(on).groupBy(F.col("place").alias("exchange"), F.col("exchange").alias("rules"), "maker", "taker").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {RATES}, held AS (SELECT c_mktsegment AS account, lower(n_name) AS asset, c_acctbal AS qty FROM customer JOIN nation ON c_nationkey = n_nationkey
      UNION ALL SELECT CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'other' END, lower(n_name), (s_suppkey % 7 - 3) * (100.0::DOUBLE + n_nationkey - s_acctbal) FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT account, round(sum(qty * rate) + {OFF_TIES:.10f}, 2) AS equity FROM held JOIN rates USING (asset) GROUP BY account"""
)
def equity_with_positions(spark, sf_dir):
    """Balances and the profit of open positions in one currency; losses keep their sign."""
    c, s, n = (views.table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    asset, k = F.lower("n_name").alias("asset"), F.col("s_suppkey")
    balances = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("account"), asset, F.col("c_acctbal").alias("qty"))
    positions = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(k % 3 == 0, "BUILDING").when(k % 3 == 1, "MACHINERY").otherwise("other").alias("account"),
        asset, (k % 7 - 3).alias("size"), F.col("s_acctbal").alias("entry_price"), (100.0 + F.col("n_nationkey")).alias("price"),
    )
    out = portfolio.equity(balances, rates(spark, sf_dir), ["account"], positions)
    return out.withColumn("equity", F.round(F.col("equity") + OFF_TIES, 2))


@query(
    f"""WITH {FILLS}, legs AS (SELECT account % 50 AS account, 'm' || (market % 10) AS asset, ts, fill_key, CASE side WHEN 'buy' THEN size ELSE -size END AS delta FROM fills),
    g AS (SELECT unnest(generate_series(TIMESTAMP '1992-01-01', TIMESTAMP '1999-01-01', INTERVAL '365 days')) AS ts),
    h AS (SELECT account, asset, ts, sum(sum(delta)) OVER (PARTITION BY account, asset ORDER BY ts) AS qty FROM legs GROUP BY account, asset, ts),
    p AS (SELECT account, asset, g.ts FROM (SELECT account, asset, min(ts) AS s FROM h GROUP BY ALL) JOIN g ON g.ts >= s),
    q AS (SELECT p.*, qty FROM p ASOF LEFT JOIN h ON p.account = h.account AND p.asset = h.asset AND p.ts >= h.ts),
    v AS (SELECT 'm' || (l_suppkey % 10) AS asset, l_shipdate AS ts, max(round(l_extendedprice / l_quantity, 2)) AS price FROM lineitem GROUP BY ALL)
    SELECT account, q.ts, round(sum(qty * coalesce(price, 0)) + {OFF_TIES:.10f}, 2) AS equity FROM q ASOF LEFT JOIN v ON q.asset = v.asset AND q.ts >= v.ts GROUP BY account, q.ts"""
)
def equity_by_year(spark, sf_dir):
    """Equity of every account at the start of every year."""
    market = F.concat(F.lit("m"), (F.col("market") % 10).cast("string"))
    changes = views.fills(spark, sf_dir).select((F.col("account") % 50).alias("account"), market.alias("asset"), "ts", "fill_key", C.signed_size("side", "size").alias("delta"))
    li = views.table(spark, sf_dir, "lineitem")
    prices = li.groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")).alias("asset"), F.col("l_shipdate").alias("ts")).agg(F.max(F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)).alias("price"))
    out = portfolio.equity_history(changes, prices, ["account"], years())
    return out.withColumn("equity", F.round(F.col("equity") + OFF_TIES, 2))


@query(
    """WITH l AS (SELECT l_suppkey % 20 AS book, date_trunc('month', l_shipdate) AS ts, CASE WHEN l_linestatus = 'O' THEN 'ask' ELSE 'bid' END AS side, round(l_extendedprice, -2) AS price, sum(l_quantity) AS qty
      FROM lineitem GROUP BY ALL), n AS (SELECT * FROM l WHERE ts = (SELECT max(ts) FROM l x WHERE x.book = l.book))
    SELECT book, side, CAST(place AS INTEGER) AS place, price, qty FROM (SELECT *, row_number() OVER (PARTITION BY book, side ORDER BY CASE WHEN side = 'ask' THEN price ELSE -price END) - 1 AS place FROM n) WHERE place < 10"""
)
def panel_order_books(spark, sf_dir):
    """The newest ladder of each book, asks then bids."""
    li = views.table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_linestatus") == "O", "ask").otherwise("bid").alias("side")
    month = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("ts")
    ladders = li.groupBy((F.col("l_suppkey") % 20).alias("book"), month, side, F.round("l_extendedprice", -2).alias("price")).agg(F.sum("l_quantity").alias("qty"))
    return report.panel_book(ladders, ["book"])


@query("SELECT DISTINCT tag, value FROM (SELECT 'source' AS tag, 'events' AS value FROM events UNION ALL SELECT 'topic', event_type FROM events UNION ALL SELECT 'datatype', 'trades' FROM events)")
def panel_tags(spark, sf_dir):
    """Tags of panels and their values."""
    return report.tags(views.trades(spark, sf_dir).select("source", "topic", "datatype").distinct())


#: Events of 1000 sessions: trades, and some that complete or fail.
SESSIONS = """s AS (SELECT user_id % 1000 AS session_id, event_id AS seq, ts, CAST(value AS VARCHAR) AS payload,
  CASE WHEN event_type IN ('click', 'view') THEN 'trade' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'complete' WHEN event_type = 'error' AND event_id % 4 = 0 THEN 'error' ELSE 'put' END AS kind FROM events)"""


def session_events(spark, sf_dir):
    e, kind, k = views.table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    named = F.when(kind.isin("click", "view"), "trade").when((kind == "purchase") & (k % 3 == 0), "complete").when((kind == "error") & (k % 4 == 0), "error").otherwise("put")
    return e.select((F.col("user_id") % 1000).alias("session_id"), k.alias("seq"), "ts", F.col("value").alias("payload"), named.alias("kind"))


@query(f"WITH {SESSIONS} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) - 1 AS place, ts, CAST(payload AS DOUBLE) AS payload FROM s WHERE kind = 'trade'")
def report_trades_in_order(spark, sf_dir):
    """The trades of each report."""
    return report.report_trades(session_events(spark, sf_dir))


@query(
    f"""WITH {SESSIONS}, e AS (SELECT session_id, arg_max(kind, seq) FILTER (kind IN ('complete', 'error')) AS last, CAST(arg_max(payload, seq) FILTER (kind IN ('complete', 'error')) AS DOUBLE) AS payload,
      count(*) FILTER (kind = 'trade') AS n_trades FROM s GROUP BY session_id),
    b AS (SELECT DISTINCT c_custkey % 30 AS bot, c_custkey % 1200 AS session_id FROM customer)
    SELECT bot, b.session_id, CASE last WHEN 'complete' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, CASE WHEN last = 'error' THEN payload END AS error, coalesce(n_trades, 0) AS n_trades
    FROM b LEFT JOIN e USING (session_id)"""
)
def reports_of_bots(spark, sf_dir):
    """All reports of all bots, with their completion or error."""
    k = F.col("c_custkey")
    sessions = views.table(spark, sf_dir, "customer").select((k % 30).alias("bot"), (k % 1200).alias("session_id")).distinct()
    return report.bot_reports(report.report_ends(session_events(spark, sf_dir)), sessions)
