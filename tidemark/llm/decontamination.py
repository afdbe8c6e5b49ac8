"""Benchmark decontamination by size-partitioned MinHash containment search.

A document is contaminated by an item when it holds at least ``threshold`` of
the item's distinct word shingles. Items are far smaller than documents, so
sketches are of the items: an item's MinHash sketch is the set of its smallest
shingle hashes. Items are partitioned by their number of shingles into classes
[2^c, 2^(c+1)); a class sets the sketch size, one more than the shingles that
an item of the class may lack, so a document over the threshold holds at least
one hash of the sketch: no such pair is missed. A document is searched only for
classes that it is large enough to contain. Candidates are verified by exact
containment of the shingles' text.

DataFrame functions throughout. Sketches and shingles of items are broadcast
while they take few enough bytes, and are shuffled against the documents' beyond.

Defined results: an item of fewer words than a shingle is one shingle, its whole
sequence; null, empty or wordless texts have none and contain, or are found,
nothing; rows that repeat an id count as one document (or item) with the
shingles of all; documents without id are told apart by their texts (by XXH64)
and found with a null id; an item without id counts as one item; a containment
equal to the threshold counts; equal items are each found; empty tables give
empty results. Words are runs of letters and digits in lower case. Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small

def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def positions(size: Column, width: int) -> Column:
    return F.when(size >= width, F.sequence(F.lit(0), size - width))


def shingle_texts(ws: Column, width: int) -> Column:
    return F.transform(positions(F.size(ws), width), lambda i: F.concat_ws(" ", F.slice(ws, i + 1, width)))


def shingle_hashes(ws: Column, width: int) -> Column:
    return F.transform(positions(F.size(ws), width), lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(width))))


def lacking(n: Column, threshold: float) -> Column:
    """Shingles that an item of n may lack."""
    return (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9))).cast("int")


def sketches(hashed: DataFrame, threshold: float) -> DataFrame:
    """``hashed(item, w, hs)`` to ``(h, item, w, least)``; least: shingles that a document needs for the class."""
    lower = F.pow(F.lit(2.0), F.floor(F.log2(F.size("hs").cast("double"))))
    keep = lacking(F.lit(2) * lower - F.lit(1), threshold) + F.lit(1)
    least = F.ceil(lower * F.lit(threshold) - F.lit(1e-9)).cast("int")
    sketch = F.slice(F.array_sort("hs"), F.lit(1), keep)
    return hashed.select("item", "w", least.alias("least"), F.explode(sketch).alias("h"))


def keyed(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, text)``; doc holds the id, and for rows without one a hash of the text that tells them apart."""
    other = F.when(F.col(id_col).isNull(), F.coalesce(F.xxhash64(text_col), F.lit(0)))
    return table.select(F.struct(F.col(id_col).alias("id"), other.alias("other")).alias("doc"), F.col(text_col).alias("text"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``(id, item, n_shared, n_shingles, containment)`` for every document and item over the threshold."""
    found = containments(keyed(docs, id_col, text_col), items, width, threshold, item_col, item_text_col)
    return found.select(F.col("doc.id").alias(id_col), *[c for c in found.columns if c != "doc"])


def containments(docs: DataFrame, items: DataFrame, width: int, threshold: float, item_col: str, item_text_col: str) -> DataFrame:
    """As ``contained_items``, by ``doc`` of ``keyed`` documents."""
    ws = F.col("ws")
    # within a struct, ids that are null are equal
    items = items.select(F.struct(F.col(item_col).alias("id")).alias("item"), words(F.col(item_text_col)).alias("ws")).where(F.size("ws") > 0)
    # an item of fewer words than a shingle is one shingle of its own width
    items = materialize(items.withColumn("w", F.least(F.size("ws"), F.lit(width))))
    widths = [r.w for r in items.select("w").distinct().orderBy("w").collect()]  # at most ``width`` numbers
    per_width = [items.where(F.col("w") == w).select("item", "w", F.explode(shingle_texts(ws, w)).alias("s")) for w in widths]
    hashed = [items.where(F.col("w") == w).select("item", "w", F.explode(shingle_hashes(ws, w)).alias("h")) for w in widths]
    if not widths:
        per_width, hashed = ([items.select("item", "w", F.lit(None).cast(kind).alias(n))] for n, kind in (("s", "string"), ("h", "long")))
    parts = materialize(together(per_width).distinct())
    totals = parts.groupBy("item").agg(F.count("*").cast("int").alias("n_shingles"))
    sketch = materialize(sketches(together(hashed).groupBy("item", "w").agg(F.collect_set("h").alias("hs")), threshold))

    split = docs.select("doc", words(F.col("text")).alias("ws"))
    probes = [split.where(F.size("ws") >= w).select("doc", F.lit(w).alias("w"), (F.size("ws") - (w - 1)).alias("n"), F.explode(shingle_hashes(ws, w)).alias("h")) for w in widths]
    if not probes:
        probes = [split.select("doc", F.lit(width).alias("w"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("h")).where("false")]
    candidates = materialize(together([p.join(small(sketch), ["w", "h"]).where("n >= least").select("doc", "item") for p in probes]).distinct())

    suspects = materialize(candidates.select("doc").distinct())
    hits = docs.join(small(suspects), "doc", "left_semi").select("doc", words(F.col("text")).alias("ws"))
    held = [hits.select("doc", F.lit(w).alias("w"), F.explode(F.array_distinct(shingle_texts(ws, w))).alias("s")) for w in widths or [width]]
    shared = together([h.join(small(parts), ["w", "s"]) for h in held]).join(small(candidates), ["doc", "item"])
    counted = shared.groupBy("doc", "item").agg(F.count_distinct("s").cast("int").alias("n_shared")).join(totals, "item")
    return counted.where(F.col("n_shared") >= F.col("n_shingles") * threshold - 1e-9).select(
        "doc", F.col("item.id").alias(item_col), "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    )


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_items(
    docs: DataFrame,
    items: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``docs`` without those that contain an item, rows without id by their own text."""
    found = materialize(containments(keyed(docs, id_col, text_col), items, width, threshold, item_col, item_text_col).select("doc").distinct())
    nameless = found.where("doc.id is null").select(F.col("doc.other").alias("__other"))
    named = found.where("doc.id is not null").select(F.col("doc.id").alias(id_col))
    left = docs.join(small(named), id_col, "left_anti")
    text = F.when(F.col(id_col).isNull(), F.coalesce(F.xxhash64(text_col), F.lit(0)))
    return left.withColumn("__text", text).join(small(nameless), F.col("__text") == F.col("__other"), "left_anti").select(*docs.columns)
