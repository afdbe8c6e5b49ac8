"""Passages that repeat across documents, by sparse suffix arrays.

A passage is a run of at least ``MIN_WORDS`` words (split at white space) that
also stands elsewhere, in another document or earlier in the same one. Of the
suffixes of all texts those are retained that start at minimisers: positions
whose ``KEY_WORDS``-word hash is the smallest of ``WINDOW`` in a row. Every run
of MIN_WORDS words contains one, chosen by content alone, so both occurrences
retain it. Retained suffixes whose key is unique go. Of those whose
surroundings are equal the one of smallest (id, position) stands for all, and
the others are repeats of it. These representatives are sorted by what follows
and each is compared with its neighbour: the match is extended left and right
and counts if it has MIN_WORDS words; the greater (id, position) is the repeat.
Where three or more representatives share a key, neighbours alone could miss
the first occurrence; there all MIN_WORDS-word runs around the suffix are
looked up as well, so every repeated run is found.

The sort deals out rows by ranges of the whole sort key, which is unique, so a
passage that millions of documents share is spread over tasks; the two rows at
each range's ends are compared in a step of their own. Lookups take minima
that are combined before the shuffle, and joins that can be split.

Defined results: null, empty and shorter texts have no passages; rows that
repeat an id are the same document, whose spans are those of all its texts; a
row without id has no passages and is left as it is; runs that repeat within one
text count from their second occurrence on; a word counts as repeated exactly if
it is in a run of MIN_WORDS words that also stands at a smaller (id, position),
so a first occurrence stays whole, and a repeat of fewer words, or with a word
changed every MIN_WORDS words, is none; an empty table gives an empty result.
Only the two named columns are read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, map_batches, materialize, small

MIN_WORDS, KEY_WORDS = 50, 25
WINDOW = MIN_WORDS - KEY_WORDS + 1
#: Words of context on either side of a minimiser that decide whether a passage holds it.
LEFT, RIGHT = WINDOW - 1, MIN_WORDS
#: Distinct words whose hashes a task remembers, in some 11 MB.
REMEMBERED_WORDS = 1 << 16
#: Odd, so that it has an inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode(), 7)
        return h

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Powers:
    """Powers of BASE and of its inverse modulo 2 ** 64, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)])
                for b in (np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64)))
            )
        return self.up[:n], self.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def run_hashes(words: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Hashes of all runs of ``size`` words: differences of prefix sums, shifted to power zero."""
    up, down = powers.upto(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    return mix((sums[size:] - sums[:-size]) * down[: len(words) - size + 1])


def minimisers(words: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, keys) of the retained suffixes, and the (start, end) of runs that repeat themselves.

    Where a text goes in circles its minimisers have one key at a constant gap.
    All that stands a gap and more after the first of them repeats what stands
    a gap before; so of such a streak only the first two suffixes and those
    whose key could reach beyond its end are retained.
    """
    if len(words) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)
    keys = run_hashes(words, KEY_WORDS, powers)
    least = np.lib.stride_tricks.sliding_window_view(keys, WINDOW).argmin(axis=1)
    at = np.unique(least + np.arange(len(least)))
    keys = keys[at]
    gap = np.diff(at)
    linked = (keys[1:] == keys[:-1]) & (gap <= KEY_WORDS)
    if not linked.any():
        return at, keys, np.zeros((0, 2), np.int64)
    turn = np.r_[False, linked[1:] & linked[:-1] & (gap[1:] != gap[:-1])]
    starts = np.nonzero(np.r_[True, ~linked | turn])[0]
    sizes = np.diff(np.r_[starts, len(at)])
    first, last = np.repeat(starts, sizes), np.repeat(at[starts + sizes - 1], sizes)
    kept = (np.arange(len(at)) - first < 2) | (at > last - KEY_WORDS)
    circles = starts[sizes > 1]
    spans = np.stack([at[circles + 1], at[circles + sizes[sizes > 1] - 1] + KEY_WORDS], 1)
    return at[kept], keys[kept], spans[spans[:, 1] - spans[:, 0] >= MIN_WORDS]


def retained(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, key, end)``: all retained suffixes (end null), and runs pos..end - 1 that repeat
    what stands right before them (key null)."""

    def work():
        known, powers = WordHashes(), Powers()

        def step(batch):
            found = [minimisers(known.of(t or ""), powers) for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(at) for at, _, _ in found])
            runs = np.repeat(np.arange(len(found)), [len(x) for _, _, x in found])
            spans = np.concatenate([x for _, _, x in found]).astype(np.int32)
            none = [None] * len(runs)
            return {
                id_col: batch.column(0).take(pa.array(np.concatenate([rows, runs]))),
                "pos": np.concatenate([*(at for at, _, _ in found), spans[:, 0]]).astype(np.int32),
                "key": pa.array([*np.concatenate([k for _, k, _ in found]).view(np.int64).tolist(), *none], pa.int64()),
                "end": pa.array([None] * len(rows) + spans[:, 1].tolist(), pa.int32()),
            }

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], work, f"`{id_col}` {kind}, pos int, key long, end int")


def contexts(docs: DataFrame, shared: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The words around each suffix of ``shared(id, pos, key)`` as 4-byte hashes: ``after``
    from the suffix on, ``before`` going back from it."""
    # of a text as many as it has minimisers
    wanted = materialize(shared.groupBy(id_col).agg(F.array_sort(F.collect_set("pos")).alias("at")))
    texts = docs.select(id_col, text_col).join(small(wanted), id_col)

    def work():
        known, powers = WordHashes(), Powers()

        def step(batch):
            rows, out = [], {"pos": [], "key": [], "after": [], "before": []}
            for row, (text, at) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = known.of(text)
                keys = run_hashes(words, KEY_WORDS, powers).view(np.int64)
                short = (words >> np.uint64(32)).astype(">u4")
                back = short[::-1]
                n = len(words)
                for p in at:
                    if p < len(keys):  # a repeated id may bring another, shorter text
                        rows.append(row)
                        out["pos"].append(p)
                        out["key"].append(keys[p])
                        out["after"].append(short[p : p + RIGHT].tobytes())
                        out["before"].append(back[n - p : n - p + LEFT].tobytes())
            return {id_col: batch.column(0).take(pa.array(rows, pa.int64())), **out}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        texts, [id_col, text_col, "at"], work, f"`{id_col}` {kind}, pos int, key long, after binary, before binary"
    )


def common_words(a: list[bytes], b: list[bytes], most: int) -> np.ndarray:
    """Words at the start that each pair has in common."""
    x, y = (np.frombuffer(b"".join(s.ljust(4 * most, pad) for s in side), ">u4").reshape(-1, most) for side, pad in ((a, b"\0"), (b, b"\1")))
    same = np.concatenate([x == y, np.zeros((len(a), 1), bool)], axis=1)
    return same.argmin(axis=1)


SPAN = "doc long, start int, end int, other long, edge int, part int, pos int, key long, after binary, before binary"


def compare_neighbours(ordered: DataFrame) -> DataFrame:
    """Repeats found between consecutive rows of each partition (edge 0), and the
    partition's first and last row (edge 1 and 2)."""

    def run(batches):
        part = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if last is None:
                yield as_edge(rows.slice(0, 1), 1, part)
            else:
                rows = pa.concat_tables([last, rows])
            last = rows.slice(rows.num_rows - 1)
            yield matches(rows, part)
        if last is not None:
            yield as_edge(last, 2, part)

    return ordered.select("doc", "pos", "key", "after", "before").mapInArrow(run, SPAN)


def as_edge(row: pa.Table, edge: int, part: int) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int32())
    columns = [row["doc"], none, none, pa.nulls(1, pa.int64()), pa.array([edge], pa.int32()), pa.array([part], pa.int32())]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in [*columns, *(row[c] for c in ("pos", "key", "after", "before"))]]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SPAN.split(", ")])


def matches(rows: pa.Table, part: int) -> pa.RecordBatch:
    key, doc, pos = (rows[c].to_numpy() for c in ("key", "doc", "pos"))
    i = np.nonzero((key[1:] == key[:-1]) & ((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])))[0]
    after, before = rows["after"], rows["before"]
    right, left = (
        common_words(c.take(i).to_pylist(), c.take(i + 1).to_pylist(), n) if len(i) else np.zeros(0, np.int64)
        for c, n in ((after, RIGHT), (before, LEFT))
    )
    long = left + right >= MIN_WORDS
    i, left, right = i[long], left[long], right[long]
    later = np.where((doc[i] > doc[i + 1]) | ((doc[i] == doc[i + 1]) & (pos[i] > pos[i + 1])), i, i + 1)
    n = len(i)
    columns = {
        "doc": doc[later],
        "start": (pos[later] - left).astype(np.int32),
        "end": (pos[later] + right).astype(np.int32),
        "other": doc[i + i + 1 - later],
        "edge": np.zeros(n, np.int32),
        "part": np.full(n, part, np.int32),
        "pos": pos[later].astype(np.int32),
        "key": key[i],
    }
    arrays = [pa.array(v) for v in columns.values()] + [pa.nulls(n, pa.binary())] * 2
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SPAN.split(", ")])


def runs_around(reps: DataFrame) -> DataFrame:
    """``(run, doc, start)``: hashes of all MIN_WORDS-word runs that hold the suffix's start and key."""

    def work():
        def step(batch):
            rows, out = [], {"run": [], "start": []}
            columns = (batch.column(c).to_pylist() for c in (1, 2, 3))
            for row, (pos, after, before) in enumerate(zip(*columns, strict=True)):
                left = len(before) // 4
                words = np.frombuffer(before, ">u4")[::-1].tobytes() + after
                for i in range(len(words) // 4 - MIN_WORDS + 1):
                    rows.append(row)
                    out["run"].append(xxhash.xxh3_64_intdigest(words[4 * i : 4 * (i + MIN_WORDS)]) - (1 << 63))
                    out["start"].append(pos - left + i)
            return {"doc": batch.column(0).take(pa.array(rows, pa.int64())), **out}

        return step

    return map_batches(reps, ["doc", "pos", "after", "before"], work, "run long, doc long, start int")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, start, end, other)``: words start..end - 1 of the text stand elsewhere, in ``other``.
    Overlapping and touching spans of a text are one; ids are longs."""
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).where(F.col(id_col).isNotNull())
    both_kinds = materialize(retained(docs, id_col, text_col))
    suffixes = both_kinds.where("end is null").drop("end")
    circles = both_kinds.where("end is not null").select(F.col(id_col).alias("doc"), F.col("pos").alias("start"), "end", F.col(id_col).alias("other"))
    # written first, so that the joins have plain shuffles on both sides, which can be split
    twice = materialize(suffixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    shared = suffixes.join(twice, "key")
    around = contexts(docs, shared, id_col, text_col).withColumnRenamed(id_col, "doc")
    around = materialize(around.withColumn("context", F.xxhash64("key", "after", "before")))
    circles = materialize(circles)
    discard(both_kinds, twice)

    firsts = materialize(around.groupBy("context").agg(F.min(F.struct("doc", "pos")).alias("first")))
    both = around.join(firsts, "context")
    same = F.col("first") == F.struct("doc", "pos")
    words = {c: (F.octet_length(c) / 4).cast("int") for c in ("before", "after")}
    copies = both.where(~same).select(
        "doc", (F.col("pos") - words["before"]).alias("start"), (F.col("pos") + words["after"]).alias("end"), F.col("first.doc").alias("other")
    )
    copies = materialize(copies)
    reps = materialize(both.where(same).select("doc", "pos", "key", "after", "before"))
    discard(around, firsts)

    by = ["key", "after", "doc", "pos"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = materialize(compare_neighbours(reps.repartitionByRange(parts, *by).sortWithinPartitions(*by)))
    # two rows for each partition
    ends = compared.where("edge > 0").select("doc", "edge", "part", "pos", "key", "after", "before")
    between = compare_neighbours(ends.repartition(1).sortWithinPartitions("part", "edge"))
    neighbours = compared.unionByName(between).where("edge = 0").select("doc", "start", "end", "other")

    many = materialize(reps.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").select("key"))
    runs = materialize(runs_around(reps.join(many, "key")))
    discard(reps, many)
    seen = runs.groupBy("run").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"))
    earliest = materialize(seen.where("n > 1").drop("n"))
    later = runs.join(earliest, "run").where(F.col("first") < F.struct("doc", "start"))
    looked_up = later.select("doc", "start", (F.col("start") + MIN_WORDS).alias("end"), F.col("first.doc").alias("other"))
    found = materialize(merged(copies.union(neighbours).union(looked_up).union(circles)).withColumnRenamed("doc", id_col))
    discard(circles, copies, compared, runs, earliest)
    return found


def merged(spans: DataFrame) -> DataFrame:
    """Spans of each document joined where they overlap or touch; at most its length in spans."""
    starts = spans.groupBy("doc", "start").agg(F.max("end").alias("end"), F.min("other").alias("other"))
    own = Window.partitionBy("doc").orderBy("start")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = starts.withColumn("__new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    islands = fresh.withColumn("__island", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc", "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other")).drop("__island")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space after each of them; empty if no word is left."""
    at = [m.start() for m in re.finditer(r"\S+", text)] + [len(text)]
    out, done = [], 0
    for start, end in spans:
        out.append(text[done : at[start]])
        done = at[min(end, len(at) - 1)]
    left = "".join(out) + text[done:]
    return left if left.strip() else ""


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each passage kept at its first occurrence only. A document of which
    no word is left goes; all other rows stay, those without repeats untouched.
    ``size_col``, if the table has it, gets the new text's length."""
    spans = repeats(docs, id_col, text_col).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))
    spans = materialize(spans)
    joined = docs.join(small(spans.withColumnRenamed(id_col, "__id")), docs[id_col].cast("long") == F.col("__id"), "left").drop("__id")

    @F.pandas_udf("string")
    def shortened(texts, lists):
        pairs = zip(texts, lists, strict=True)
        return pd.Series([None if t is None else cut(t, [(x["start"], x["end"]) for x in s]) for t, s in pairs])

    hit = F.col("__spans").isNotNull()
    changed = shortened(F.when(hit, F.col(text_col)), F.col("__spans"))
    out = joined.withColumn(text_col, F.when(hit, changed).otherwise(F.col(text_col)))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.when(hit, F.length(text_col).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col)))
    return out.where(~hit | (F.col(text_col) != "")).select(*docs.columns)
