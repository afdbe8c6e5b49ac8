"""Shards of exact size in uniformly random order, by a hypergeometric communication matrix.

``shuffle_into_shards`` gives each row a shard and a slot in it, as if all rows
had been put in one random order that is then cut into shards whose counts
differ by one at most. No task sees more than its own rows:

1. each input partition's rows are counted;
2. how many rows each partition sends to each shard is drawn exactly, from the
   multivariate hypergeometric distribution whose row sums are the partitions'
   counts and whose column sums are the shards' sizes;
3. each partition permutes its rows and cuts them by its row of that matrix;
4. the rows are exchanged, and permuted again within their shard.

The matrix is never held: partitions stand in a binary tree, a node's rows are
dealt to its two halves, and a partition draws the nodes on its own way down,
each from a seed of its own, so that all partitions see the same draws. Their
counts, eight bytes a partition, are all that is sent to each. Within a shard the
second permutation is an order by hash, so a shard is numbered in as many ranges
of hashes as its size asks for and never in one task.

A permutation is an order by hash of the seed and a row's values: a lost task
draws it again alike. Defined results: sizes are UTF-8 bytes of the text plus
``OVERHEAD`` (a null text has no bytes), ``text_crc32`` is null for a null
text; a null id is a value like any other; equal rows are rows of their own, of
which it is not told apart which takes which place; copies of a text are spread
like all rows; fewer rows than shards leave shards empty, and an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Bytes of a row besides its text.
OVERHEAD = 16
#: Rows, about, that are numbered together in a shard.
RANGE_ROWS = 50_000
#: Standard deviations around the mean that a draw's distribution is laid out over; what is beyond has a share below 1e-30.
REACH = 12


def uniform(seed: str) -> float:
    """A number in [0, 1), a function of the seed."""
    return int.from_bytes(hashlib.sha256(seed.encode()).digest()[:7], "big") / float(1 << 56)


def hypergeometric(drawn: int, marked: int, total: int, u: float) -> int:
    """How many of ``drawn`` balls out of ``total`` are among the ``marked``: the inverse of its distribution at ``u``.

    Probabilities are ratios to that of the mode, multiplied outwards from it, so that numbers beyond 10^9 are as exact
    as small ones.
    """
    least, most = max(0, drawn + marked - total), min(drawn, marked)
    if least == most:
        return least
    mean = drawn * (marked / total)
    deviation = np.sqrt(max(mean * (1 - marked / total) * (total - drawn) / max(total - 1, 1), 0))
    reach = int(REACH * deviation) + 20
    a, b = max(least, int(mean) - reach), min(most, int(mean) + reach)
    k = np.arange(a, b, dtype=np.float64)  # from k to k + 1
    steps = np.log(marked - k) + np.log(drawn - k) - np.log(k + 1) - np.log(total - marked - drawn + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    share = np.cumsum(np.exp(logs - logs.max()))
    return a + min(int(np.searchsorted(share, u * share[-1], side="right")), b - a)


def split(sizes: list[int], left: int, seed: str) -> list[int]:
    """How many of each column's rows are among ``left`` that are drawn from all."""
    total, out = sum(sizes), []
    for j, size in enumerate(sizes):
        out.append(hypergeometric(left, size, total, uniform(f"{seed}/{j}")) if left else 0)
        left, total = left - out[-1], total - size
    return out


def matrix_row(partition: int, before: np.ndarray, sizes: list[int], seed: str) -> list[int]:
    """The rows that a partition sends to each shard. ``before``: rows of all partitions before each, and of all."""
    first, last = 0, len(before) - 1
    while last - first > 1:
        middle = (first + last) // 2
        left = split(sizes, int(before[middle] - before[first]), f"{seed}/{first}-{last}")
        if partition < middle:
            last, sizes = middle, left
        else:
            first, sizes = middle, [a - b for a, b in zip(sizes, left, strict=True)]
    return sizes


def shard_sizes(n_rows: int, n_shards: int) -> list[int]:
    """Sizes that differ by one at most; the first shards are the larger ones."""
    return [n_rows // n_shards + (i < n_rows % n_shards) for i in range(n_shards)]


def communication_matrix(counts: DataFrame, n_shards: int, seed: str) -> DataFrame:
    """``(part, n)``, a row a partition, to ``(part, ends)``: where each shard's rows end in the partition's order."""
    found = sorted(counts.collect())  # a row a partition, whatever its rows
    parts = np.array([p for p, _ in found], np.int64)
    before = np.concatenate([[0], np.cumsum([n for _, n in found])]).astype(np.int64)
    sizes = shard_sizes(int(before[-1]), n_shards)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.searchsorted(parts, batch.column(0).to_numpy())
            ends = [np.cumsum(matrix_row(int(i), before, sizes, seed)) for i in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.list_(pa.int64()))], names=["part", "ends"])

    return counts.select("part").mapInArrow(draw, "part long, ends array<long>")


def order(seed: str, *columns: str) -> Column:
    """60 bits that are random, but a function of the seed and the values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 4)


def shuffle_into_shards(
    docs: DataFrame, n_shards: int = 40, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot)`` for each row: shards counted from 0 whose numbers of rows differ by one
    at most, slots from 0 without gaps in each."""
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.spark_partition_id().cast("long").alias("part"),
    )
    # partitions are what was written, however often a later stage is run
    slim = materialize(slim)
    counts = materialize(slim.groupBy("part").agg(F.count("*").alias("n")))
    n_rows = counts.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, n_rows // n_shards // RANGE_ROWS)

    local = Window.partitionBy("part").orderBy(order(f"{seed}/1", id_col, "size", "text_crc32"))
    shard = F.size(F.filter("ends", lambda end: end < F.col("place")))
    dealt = slim.withColumn("place", F.row_number().over(local)).join(communication_matrix(counts, n_shards, seed), "part")
    dealt = dealt.withColumn("shard", shard).withColumn("key", order(f"{seed}/2", "part", "place"))
    bucket = F.least((F.col("key") / float(1 << 60) * ranges).cast("int"), F.lit(ranges - 1))
    dealt = materialize(dealt.select(id_col, "size", "text_crc32", "shard", "key", bucket.alias("bucket")))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key"))
    return (
        dealt.withColumn("within", within)
        .join(offsets, ["shard", "bucket"])
        .select(id_col, "size", "text_crc32", "shard", (F.col("offset") + F.col("within") - 1).alias("slot"))
    )


def write_shards(
    docs: DataFrame, path: str, n_shards: int = 40, seed: str = "shards", id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write ``docs``, whose ids are distinct, in a folder a shard under ``path``, each in the order of its slots.

    A shard of several tasks has several files, whose names' order is that of their slots.
    """
    dealt = shuffle_into_shards(docs, n_shards, seed, id_col, text_col).select(id_col, "shard", "slot")
    ordered = docs.join(dealt, id_col).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
