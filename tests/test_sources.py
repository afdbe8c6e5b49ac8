"""A data source of a user's own, retention that deletes, and what files' metadata say of a store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import order
from tidemark.sources import plugin
from tidemark.sources import series as stored
from tidemark.sources.shared import shared_path
from tidemark.streaming import streams

T0 = dt.datetime(2024, 1, 1)
TRADES = "topic string, id long, ts timestamp, price double"


class Exchange(plugin.MarketDataSource):
    """120 trades a minute apart: history up to 105 in pages of 40, newest first, live ones from 86 on."""

    @classmethod
    def name(cls):
        return "exchange"

    def schema(self):
        return TRADES

    def topics(self):
        return ["btc_usd", "eth_usd"]

    def trades(self, topic):
        return [(topic, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), float(i)) for i in range(1, 121)]

    def page(self, topic, cursor):
        count = int(cursor or 0)
        history = self.trades(topic)[:105]
        page = history[: len(history) - count][-40:][::-1]
        return page, str(count + 40) if count + 40 < len(history) else None

    def latest(self, topic):
        return 35

    def live(self, topic, start, end):
        return self.trades(topic)[85:][start:end]


def test_backfill_and_live_give_every_trade_once(spark):
    spark.dataSource.register(Exchange)
    history = spark.read.format("exchange").load()
    assert history.rdd.getNumPartitions() == 2  # a topic each
    assert history.groupBy("topic").count().collect()[0]["count"] == 105
    live = streams.drained(spark.readStream.format("exchange").option("rows_per_partition", 10).load())
    assert live.count() == 70
    by = ["topic"]
    placed = order.numbered(live, by, ["ts", "id"], "seqid")
    merged = stored.backfill_merge(placed, history, by, ["ts", "id"])
    once = order.dedupe_increasing(merged, by, ["ts", "id", "seqid"], "id")
    got = [(r.topic, r.id) for r in once.orderBy("topic", "ts").collect()]
    assert got == [(t, i) for t in ("btc_usd", "eth_usd") for i in range(1, 121)]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    spark.dataSource.register(Exchange)
    for _ in range(2):
        s = spark.readStream.format("exchange").load().writeStream.option("checkpointLocation", str(tmp_path / "cp"))
        s.format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 70


def test_cursors_that_come_back_are_an_error():
    class Circle(Exchange):
        def page(self, topic, cursor):
            return [], "1" if cursor != "1" else "2" if cursor is None else "1"

    with pytest.raises(ValueError, match="came back twice"):
        list(plugin.History(Circle({})).read(plugin.Topic("x")))


def test_recorded_pages_and_parts(spark, tmp_path):
    rows = spark.createDataFrame([(t, i, T0 + dt.timedelta(minutes=i), float(i)) for t in ("a", "b") for i in range(25)], TRADES)
    plugin.record(rows, rows.where("topic = 'a'"), str(tmp_path / "r"), 10, 7, ["ts", "id"])
    schema = rows.select(F.col("topic").alias("topic_name"), "id", "price").schema
    source = plugin.Recorded({"path": str(tmp_path / "r"), "schema": schema.json()})
    page, cursor = source.page("b", None)
    assert cursor == "1" and sorted(x for b in page for x in b.column("id").to_pylist()) == list(range(15, 25))
    page, cursor = source.page("b", "2")
    assert cursor is None and sorted(x for b in page for x in b.column("id").to_pylist()) == list(range(5))
    assert (source.latest("a"), source.latest("b")) == (25, 0)
    for start, end in [(0, 25), (3, 9), (6, 7), (7, 14), (13, 25), (24, 25), (5, 5)]:
        assert sorted(x for b in source.live("a", start, end) for x in b.column("id").to_pylist()) == list(range(start, end))


def test_the_list_of_a_recorded_source_does_not_grow_with_its_files(spark, tmp_path):
    rows = spark.createDataFrame([(t, i, T0 + dt.timedelta(minutes=i), float(i)) for t in ("a", "b") for i in range(600)], TRADES)
    schema = rows.select(F.col("topic").alias("topic_name"), "id", "price").schema
    sizes = []
    for n in (60, 600):
        path = tmp_path / str(n)
        plugin.record(rows.where(f"id < {n}"), rows.where(f"id < {n} and topic = 'b'"), str(path), 20, 7, ["ts", "id"])
        sizes.append((path / "topics.json").stat().st_size)
        source = plugin.Recorded({"path": str(path), "schema": schema.json()})
        assert (source.latest("a"), source.latest("b")) == (0, n)
        assert sorted(x for b in source.live("b", n - 20, n) for x in b.column("id").to_pylist()) == list(range(n - 20, n))
        page, cursor = source.page("a", str(n // 20 - 1))
        assert cursor is None and sorted(x for b in page for x in b.column("id").to_pylist()) == list(range(20))
    assert sizes[1] <= sizes[0] + 10


STORED = "source string, topic string, datatype string, ts timestamp_ntz, seqid long, bundle long, price double"


@pytest.fixture
def folder(spark):
    rnd = random.Random(1)
    rows = []
    for topic, n in (("old", 60), ("new", 80), ("none", 3)):
        at = sorted(T0 + dt.timedelta(hours=rnd.randint(0, 24 * 9)) for _ in range(n))
        rows += [("s", topic, "trades", t, i, 1, float(i)) for i, t in enumerate(at)]
    path = shared_path(spark, "series")
    stored.write_series(spark.createDataFrame(rows, STORED), path)
    return path


RULES = "source string, topic string, datatype string, ttl string, rule int"


def files(spark, path):
    return sorted(tuple(r) for r in stored.stored_files(spark, path).select("topic", "date", "bytes").collect())


def test_expired_days_go_and_a_second_run_changes_nothing(spark, folder):
    now = T0 + dt.timedelta(days=8, hours=7)
    rules = spark.createDataFrame([("s", "old", "*", "36h", 1), ("*", "none", "*", "1m", 2)], RULES)
    before = spark.read.parquet(folder)
    expected = sorted((r.topic, r.seqid) for r in stored.apply_retention(before, rules, now).collect())
    stored.enforce_retention(spark, folder, rules, now)
    left = spark.read.parquet(folder)
    assert sorted((r.topic, r.seqid) for r in left.collect()) == expected and 0 < len(expected) < 143
    listed = files(spark, folder)
    assert min(x[1] for x in listed if x[0] == "old") == (now - dt.timedelta(hours=36)).date()
    names = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path").collect())
    stored.enforce_retention(spark, folder, rules, now)
    assert names == sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path").collect())


def test_sizes_are_the_footers(spark, folder, capsys):
    sizes = {(r.topic, r.date): (r.first_seqid, r.last_seqid, r.n) for r in stored.stored_sizes(spark, folder).collect()}
    rows = spark.read.parquet(folder).groupBy("topic", "date").agg(F.min("seqid"), F.max("seqid"), F.count("*")).collect()
    assert sizes == {(r[0], r[1]): tuple(r[2:]) for r in rows}
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    days = own.read.parquet(folder).groupBy("source", "topic", "datatype", "date").agg(F.min("seqid"), F.count("*"))
    days.explain("formatted")
    assert "PushedAggregation: [MIN(seqid), COUNT(*)]" in capsys.readouterr().out


def test_ends_of_a_store(spark, folder):
    got = {r.topic: (r.first_value, r.last_value, r.n) for r in stored.stored_ends(spark, folder, "price").collect()}
    assert got == {"old": (0.0, 59.0, 60), "new": (0.0, 79.0, 80), "none": (0.0, 2.0, 3)}
