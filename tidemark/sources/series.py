"""Stored series: reading one path, catalog and ends from files' metadata, retention, backfill."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import duration_micros, micros
from tidemark.functions.paths import PARTS, path_eq, pattern_join, time_range, validate_selection
from tidemark.operators.order import numbered
from tidemark.operators.replay import replay
from tidemark.operators.running import previous, with_running
from tidemark.sources.shared import shared_path, written

#: Stored series have a snapshot at least this often.
SNAPSHOT_INTERVAL = dt.timedelta(hours=4)


def write_series(df: DataFrame, path: str, mode: str = "append") -> None:
    """Typed Parquet, partitioned by path and day, sorted by position so that row groups can be skipped.

    Rows are dealt out by ranges of path, day and position, so a day of a hot path is as many files as it needs.
    """
    place = ("source", "topic", "datatype", "date", "bundle", "seqid")
    days = df.withColumn("date", F.to_date("ts"))
    (
        days.repartitionByRange(*place)
        .sortWithinPartitions(*place)
        .write.mode(mode)
        .partitionBy("source", "topic", "datatype", "date")
        .parquet(path)
    )


def read_series(
    spark: SparkSession,
    path: str,
    source: str,
    topic: str,
    datatype: str,
    start: dt.datetime | None = None,
    end: dt.datetime | None = None,
    now: dt.datetime | None = None,
    replayed: bool = False,
) -> DataFrame:
    """Rows of one series in [start, end).

    Filters on path and date prune partitions. ``replayed`` looks back one
    snapshot interval, replays snapshots and deltas, and trims.
    """
    validate_selection(start, end, now or dt.datetime.now())
    rows = spark.read.parquet(path).where(path_eq(source, topic, datatype))
    begin = start - SNAPSHOT_INTERVAL if replayed and start else start
    if begin is not None:
        rows = rows.where(F.col("date") >= F.lit(begin.date()))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end.date()))
    rows = rows.where(time_range("ts", begin, end)).drop("date")
    return replay(rows).where(time_range("ts", start)) if replayed else rows


def catalog(rows: DataFrame) -> DataFrame:
    """The path of each bundle."""
    return rows.select("bundle", *PARTS).distinct()


def bundle_ranges(rows: DataFrame) -> DataFrame:
    """Of each bundle the start of its first snapshot, the time of its last row, and its rows."""
    return rows.groupBy("bundle").agg(
        F.min(F.when(F.col("is_snapshot"), F.col("ts"))).alias("first_snapshot"), F.max("ts").alias("last_ts"), F.count("*").alias("n")
    )


def series_ends(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """First and last value and size of each series."""
    at = F.struct(*order)
    return rows.groupBy(*by).agg(
        F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.count("*").alias("n")
    )


def series_find(rows: DataFrame, key: str, wanted) -> DataFrame:
    """The row of an exact key; none if it is missing."""
    return rows.where(F.col(key) == F.lit(wanted)).limit(1)


#: How long rows are kept whose path no rule matches.
DEFAULT_TTL = "90d"


def with_ttl(rows: DataFrame, rules: DataFrame, order: str) -> DataFrame:
    """Rows with ``__ttl``, the micros that the first rule for their path, or the default, keeps them."""
    kind = rules.schema[order].dataType
    last = rules.agg((F.coalesce(F.max(order), F.lit(0)) + 1).cast(kind).alias(order))
    rest = last.select(*[F.lit("*").alias(p) for p in PARTS], F.lit(DEFAULT_TTL).alias("ttl"), order)
    given = rules.select(*PARTS, "ttl", order).unionByName(rest)
    return pattern_join(rows, given.withColumn("__ttl", duration_micros("ttl")).drop("ttl"), order)


def apply_retention(rows: DataFrame, rules: DataFrame, now: dt.datetime, order: str = "rule") -> DataFrame:
    """Rows not older than the first rule (``source, topic, datatype, ttl, rule``) for their path allows, or the default."""
    ruled = with_ttl(rows, rules, order)
    age = micros(F.lit(now)) - micros("ts")
    return ruled.where(age <= F.col("__ttl")).select(*rows.columns)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """``(source, topic, datatype, date, folder, bytes)``: a row for each file of a store, from the listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return listed.select(*PARTS, "date", folder.alias("folder"), F.col("length").alias("bytes"))


def stored_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(source, topic, datatype, date, first_seqid, last_seqid, n)`` of each day of a store.

    Smallest, largest and number are aggregates that Parquet's footers answer: no data column is read. Such aggregates
    are pushed down by the second version of file sources only, which a session of its own has switched on; what it
    finds, a row a day, is written for this one.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    days = own.read.parquet(path).groupBy(*PARTS, "date")
    found = days.agg(F.min("seqid").alias("first_seqid"), F.max("seqid").alias("last_seqid"), F.count("*").alias("n"))
    target = shared_path(spark, "sizes")
    found.write.parquet(target)
    return spark.read.schema(found.schema).parquet(target)


def stored_ends(spark: SparkSession, path: str, value: str) -> DataFrame:
    """First and last value and size of each path of a store whose positions rise with time.

    Sizes and positions are the footers'; of the data only the row groups with the first position of a path's first day
    and the last of its last are read.
    """
    days = stored_sizes(spark, path)
    sums = days.groupBy(*PARTS).agg(
        F.min_by(F.struct("date", F.col("first_seqid").alias("seqid")), "date").alias("first"),
        F.max_by(F.struct("date", F.col("last_seqid").alias("seqid")), "date").alias("last"),
        F.sum("n").alias("n"),
    )
    asked = sums.select(*PARTS, F.explode(F.array_distinct(F.array("first", "last"))).alias("at")).select(*PARTS, "at.*")
    key = [*PARTS, "date", "seqid"]
    rows = spark.read.parquet(path).select(*key, F.col(value).alias("value")).join(asked, key)
    at = F.struct("date", "seqid")
    values = rows.groupBy(*PARTS).agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))
    return values.join(sums.select(*PARTS, "n"), [*PARTS])


def enforce_retention(spark: SparkSession, path: str, rules: DataFrame, now: dt.datetime, order: str = "rule") -> None:
    """Delete from a store what ``apply_retention`` would not keep.

    Days that are past as a whole are found in the listing and their folders deleted. Days in which a rule's limit lies
    are read, and where rows are past, what is kept is written over the day. A second run changes nothing; one that is
    cut short is made good by the next.
    """
    days = stored_files(spark, path).select(*PARTS, "date", "folder").distinct()
    ruled = with_ttl(days, rules, order).withColumn("__cut", micros(F.lit(now)) - F.col("__ttl"))
    day = F.unix_date("date").cast("long") * 86_400_000_000
    ruled = written(ruled.select(*PARTS, "date", "folder", "__cut", day.alias("__day")), shared_path(spark, "retention"))
    past = F.col("__day") + 86_400_000_000 <= F.col("__cut")
    delete_folders(spark, [r.folder for r in ruled.where(past).select("folder").toLocalIterator()])
    edge = ruled.where(~past & (F.col("__day") < F.col("__cut")))
    if edge.isEmpty():
        return
    stored = spark.read.parquet(path)
    rows = stored.join(edge.select(*PARTS, "date", "folder", "__cut"), [*PARTS, "date"])
    kept = F.sum((micros("ts") >= F.col("__cut")).cast("long"))
    found = rows.groupBy(*PARTS, "date", "folder").agg(kept.alias("__kept"), F.count("*").alias("__n"))
    found = written(found, shared_path(spark, "retention"))
    partly = found.where("__kept > 0 AND __kept < __n").select(*PARTS, "date")
    left = rows.join(partly, [*PARTS, "date"], "left_semi").where(micros("ts") >= F.col("__cut")).select(*stored.columns)
    place = ("source", "topic", "datatype", "date", "bundle", "seqid")
    ordered = left.repartitionByRange(*place).sortWithinPartitions(*place)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place[:4]).parquet(path)
    delete_folders(spark, [r.folder for r in found.where("__kept = 0").select("folder").toLocalIterator()])


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def backfill_merge(live: DataFrame, pages: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Backfilled rows in front of live ones, with positions below the earliest stored (0 if none).

    ``pages`` may come in any order of arrival; each series' rows are placed by
    time. Overlap with live rows is resolved when the history is read.
    """
    first = live.groupBy(*by).agg(F.min("seqid").alias("__first"))
    # a row a series
    below = pages.groupBy(*by).agg(F.count("*").alias("__n")).join(first, by, "left")
    below = below.select(*by, (F.least(F.lit(0), F.coalesce("__first", F.lit(0))) - F.col("__n")).alias("__below"))
    placed = numbered(pages, by, order, "__at").join(below, by).withColumn("seqid", F.col("__below") + F.col("__at"))
    return live.unionByName(placed.drop("__below", "__at"), allowMissingColumns=True)


def page_order_errors(pages: DataFrame, by: list[str], page: str, order: list[str]) -> DataFrame:
    """Pages whose newest row is not older than the oldest of the page before: backfill must go back in time."""
    at = F.struct(*order)
    ends = pages.groupBy(*by, page).agg(F.min(at).alias("oldest"), F.max(at).alias("newest"))
    before = F.lag("oldest").over(Window.partitionBy(*by).orderBy(page))
    return ends.withColumn("__before", before).where(F.col("newest") > F.col("__before")).drop("__before")


def assign_bundles(rows: DataFrame, by: list[str], order: list[str], gap: str) -> DataFrame:
    """Number the uninterrupted stretches of static files: a pause of more than ``gap`` opens a bundle."""
    pause = F.col(order[0]) > F.col(f"__before.{order[0]}") + F.expr(f"INTERVAL {gap}")
    opened = previous(rows, by, order, [order[0]]).withColumn("__opens", F.coalesce(pause, F.lit(False)).cast("long")).drop("__before")
    return with_running(opened, by, order, {"bundle": ("sum", F.col("__opens"))}).withColumn("bundle", F.col("bundle") + 1).drop("__opens")
