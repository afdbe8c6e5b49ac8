"""Data sources of a user's own: topics, pages back in time, live rows.

A source is a subclass of ``MarketDataSource`` that says which topics it has,
gives a topic's pages from the newest back, and gives live rows by offset.
Registered with ``spark.dataSource.register``, it is read by its name:
``spark.read.format(name)`` is its history, a partition a topic, as a page's
cursor is known by the page after it only; ``spark.readStream.format(name)`` its
live rows, whose offsets Spark keeps and asks for again after a failure, in
partitions of at most ``rows_per_partition``.

Rows are tuples, or Arrow batches, of the source's ``schema()``.
"""

from __future__ import annotations

import json
from abc import abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Live rows that one task reads; the option ``rows_per_partition`` is another number.
ROWS_PER_PARTITION = 100_000


class MarketDataSource(DataSource):
    """What a source must say; ``self.options`` are those of the reader."""

    @abstractmethod
    def topics(self) -> list[str]:
        """The topics there are now."""

    @abstractmethod
    def page(self, topic: str, cursor: str | None) -> tuple[Iterable[tuple | pa.RecordBatch], str | None]:
        """A page of history and the cursor of the one before it in time. No cursor asks for the newest; none comes back
        from the oldest."""

    @abstractmethod
    def latest(self, topic: str) -> int:
        """How many live rows there have been."""

    @abstractmethod
    def live(self, topic: str, start: int, end: int) -> Iterable[tuple | pa.RecordBatch]:
        """Live rows from the offset ``start`` up to, without, ``end``; the same ones whenever asked."""

    def reader(self, schema) -> DataSourceReader:
        return History(self)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Live(self)


@dataclass
class Topic(InputPartition):
    topic: str


@dataclass
class Stretch(InputPartition):
    topic: str
    start: int
    end: int


class History(DataSourceReader):
    def __init__(self, source: MarketDataSource):
        self.source = source

    def partitions(self) -> list[Topic]:
        return [Topic(t) for t in self.source.topics()]

    def read(self, partition: Topic) -> Iterator[tuple | pa.RecordBatch]:
        cursor, asked = None, set()
        while True:
            rows, cursor = self.source.page(partition.topic, cursor)
            yield from rows
            if cursor is None:
                return
            if cursor in asked:
                raise ValueError(f"{partition.topic}: cursor {cursor} came back twice, so its pages would never end")
            asked.add(cursor)


class Live(DataSourceStreamReader):
    def __init__(self, source: MarketDataSource):
        self.source = source
        self.most = int(source.options.get("rows_per_partition", ROWS_PER_PARTITION))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {t: self.source.latest(t) for t in self.source.topics()}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(t, i, min(i + self.most, n)) for t, n in end.items() for i in range(start.get(t, 0), n, self.most)]

    def read(self, partition: Stretch) -> Iterator[tuple | pa.RecordBatch]:
        yield from self.source.live(partition.topic, partition.start, partition.end)


class Recorded(MarketDataSource):
    """A source whose pages and live rows are files: ``path/pages/topic=T/page=N``, the newest page 0, and
    ``path/live/topic=T/part=N``, Parquet of the columns of option ``schema`` (JSON); ``path/topics.json`` holds for each
    topic the number of its pages, of its live rows, and of those in a live part, the last one excepted; so it is as short
    however many files there are. ``record`` writes them. It stands in for an exchange in tests."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schema"]))

    def files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.options["path"])

    def listed(self) -> dict:
        filesystem, root = self.files()
        with filesystem.open_input_stream(f"{root}/topics.json") as f:
            return json.loads(f.read())

    def batches(self, folder: str) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset
        from pyspark.sql.pandas.types import to_arrow_schema

        filesystem, root = self.files()
        target = to_arrow_schema(self.schema())
        found = dataset.dataset(f"{root}/{folder}", format="parquet", filesystem=filesystem)
        for batch in found.to_batches(columns=target.names):
            yield from pa.Table.from_batches([batch]).cast(target).to_batches()

    def topics(self) -> list[str]:
        return sorted(self.listed())

    def page(self, topic: str, cursor: str | None):
        number = int(cursor or 0)
        pages = self.listed()[topic]["pages"]
        rows = self.batches(f"pages/topic={topic}/page={number}") if number < pages else ()
        return rows, str(number + 1) if number + 1 < pages else None

    def latest(self, topic: str) -> int:
        return self.listed()[topic]["live"]

    def live(self, topic: str, start: int, end: int):
        size = self.listed()[topic]["part_rows"]
        for part in range(start // size, -(-end // size) if start < end else 0):
            at = part * size
            for batch in self.batches(f"live/topic={topic}/part={part}"):
                yield batch.slice(max(start - at, 0), max(min(end - at, batch.num_rows) - max(start - at, 0), 0))
                at += batch.num_rows


def record(history, live, path: str, page_rows: int, part_rows: int, order: list[str]) -> None:
    """Write ``history`` and ``live``, with a column ``topic``, as ``Recorded`` reads them; ``topic`` is a column of both."""
    from pyspark.sql import functions as F

    from tidemark.operators.order import numbered

    found: dict[str, dict] = {}
    for kind, rows, size in (("pages", history, page_rows), ("live", live, part_rows)):
        part = "page" if kind == "pages" else "part"
        placed = numbered(rows, ["topic"], order, "__at")
        counts = rows.groupBy("topic").agg(F.count("*").alias("__n"))
        if kind == "pages":  # the newest page is 0
            placed = placed.join(counts, "topic").withColumn("__at", F.col("__n") - 1 - F.col("__at")).drop("__n")
        cut = placed.withColumn(part, F.expr(f"__at DIV {size}")).withColumn("__topic", F.col("topic"))
        files = cut.repartition("topic", part).sortWithinPartitions("topic", part, "__at").withColumnRenamed("topic", "copy").withColumnRenamed("__topic", "topic")
        files.drop("__at").withColumnRenamed("copy", "topic_name").write.partitionBy("topic", part).parquet(f"{path}/{kind}")
        for r in counts.collect():  # a row a topic
            of = found.setdefault(r.topic, {"pages": 0, "live": 0, "part_rows": part_rows})
            of[kind] = -(-r["__n"] // size) if kind == "pages" else r["__n"]
    spark = history.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/topics.json")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
