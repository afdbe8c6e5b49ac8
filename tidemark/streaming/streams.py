"""Streams: reading a table's directory, ingest, bars, de-duplication, live reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.order import numbered
from tidemark.operators.running import with_running
from tidemark.sources.shared import shared_path


def stream_series(spark: SparkSession, folder: str, schema: StructType, files: str = "*.parquet", each: int = 64, since: dt.datetime | None = None) -> DataFrame:
    """History and what follows as one stream: files there at first, then new ones, ``each`` at most a batch.

    ``since``: rows from that time on, such as now less a look-back.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", each).option("recursiveFileLookup", True).parquet(folder)
    return stream if since is None else stream.where(F.col("ts") >= F.lit(since))


def with_event_time(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Watermarks need timestamps with a zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_ohlcv(trades: DataFrame, step: str, by: list[str], delay: str = "10 minutes", seq: str = "id") -> DataFrame:
    """Bars as they grow (update mode) or once closed (append mode)."""
    at = F.struct("ts", seq)
    return (
        with_event_time(trades, delay)
        .groupBy(*by, F.window("ts", step).alias("w"))
        .agg(
            F.min_by("price", at).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", at).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select(*by, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def stream_dedupe(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Each key once, as long as repeats come within the delay."""
    return with_event_time(stream, delay).dropDuplicatesWithinWatermark(keys)


def stream_report(events: DataFrame) -> DataFrame:
    """Values of growing reports, for update mode: last write of each session's keys."""
    writes = events.where(F.col("kind").isin("put", "update", "remove"))
    last = writes.groupBy("session_id", "key").agg(F.max_by(F.struct("kind", "payload"), "seq").alias("last"))
    return last.select("session_id", "key", F.when(F.col("last.kind") != "remove", F.col("last.payload")).alias("payload"))


def first_come(*streams: DataFrame) -> DataFrame:
    """Streams as one, without order."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def increasing_only(rows: DataFrame, seq: str, before: DataFrame | None, by: list[str], order: list[str], bucket) -> DataFrame:
    """Rows of a batch whose ``seq`` is above that of all earlier rows of their series, ``before(by, seen)`` from earlier batches included."""
    seen = with_running(rows, by, order, {"__seen": ("max", F.col(seq))}, bucket, include_current=False)
    if before is not None:
        seen = seen.join(before, by, "left").withColumn("__seen", F.greatest("__seen", "seen")).drop("seen")
    return seen.where(F.col(seq) > F.coalesce("__seen", F.lit(-1))).drop("__seen")


def dedupe_increasing(stream: DataFrame, folder: str, checkpoint: str, seq: str, by: list[str], order: list[str], bucket=None):
    """Append the rows of a stream that are above all before them; of each series the highest is kept beside the table.

    Each batch is written in folders of its own, over those of a run that was cut short.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{folder}-seen/batch={batch_id - 1}") if batch_id else None
        increasing_only(batch, seq, before, by, order, bucket).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        now = batch.groupBy(*by).agg(F.max(seq).alias("seen"))
        both = now if before is None else now.unionByName(before).groupBy(*by).agg(F.max("seen").alias("seen"))
        both.write.mode("overwrite").parquet(f"{folder}-seen/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def ingest_series(stream: DataFrame, folder: str, checkpoint: str, bundle: int, by: list[str], order: list[str]):
    """Append a stream to a store of series: each row gets the bundle and its zero-based position in it.

    Batches go on where the one before ended; what each series has reached is
    kept beside the table. A batch that runs again writes the same positions.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = numbered(batch, by, order, "seqid")
        sizes = batch.groupBy(*by).agg(F.count("*").alias("n"))
        if batch_id:
            before = spark.read.parquet(f"{folder}-sizes/batch={batch_id - 1}")
            placed = placed.join(before, by, "left").withColumn("seqid", F.col("seqid") + F.coalesce("n", F.lit(0))).drop("n")
            sizes = sizes.unionByName(before).groupBy(*by).agg(F.sum("n").alias("n"))
        placed.withColumn("bundle", F.lit(bundle).cast("long")).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        sizes.write.mode("overwrite").parquet(f"{folder}-sizes/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def ingest(stream: DataFrame, folder: str, checkpoint: str, every: str | None = "1 second"):
    """Append a stream to a table. A batch has a folder of its own, written over if the batch runs again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; a stream takes its settings along when it starts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    folder, checkpoint = shared_path(spark, "streams"), shared_path(spark, "checkpoints")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with rocksdb(spark):
        if mode == "append":
            q = writer.format("parquet").option("path", folder).start()
        else:
            q = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/batch={i}")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder) if mode == "append" else spark.read.parquet(folder)
