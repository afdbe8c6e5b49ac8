"""Near copies by exact word-shingle Jaccard similarity, with prefix filtering.

Two documents link when the Jaccard similarity of their sets of distinct word
shingles is at least ``threshold``. A set of n shingles that is to share that
much with another may lack n - ceil(threshold * n) of its own, so in any common
order the first one more than that of both sets share a shingle: no linked pair
is missed. Two sets of known sizes must share a number of shingles that follows
from both, so that a pair's own prefixes are shorter; the smaller set's is about
half as long, whatever set it meets, and only such keys bring pairs together. Shingles that many documents hold, counted over all documents, come
last in the order, so that keys of few documents are what most prefixes consist
of: the pairs of a key that comes first are bounded by a number for each of its
rows, however large the groups are that share a passage. The order never changes
a result. Sets of widely differing size
and parity sketches (of 256 bits; their difference is at most that of the sets)
rule most candidates out, as do keys that no other set has in its prefix: up to
the end of the prefix that ends first, sets that similar share many more shingles
than long documents do that have a passage in common. The others are verified on
their texts.

Documents with one set are a single point. SimHash comes first: links between
fingerprints that differ in few bits are candidates, verified like all others.
What it leaves apart is found by prefixes: candidates are the stars around each
key's smallest document, and then pairs of a key that links so far leave in
different components. So a large group of copies takes links, not pairs.

Defined results: a text of fewer words than a shingle is one shingle; null and
wordless texts have the empty set and are copies of each other; rows that repeat
an id are the same document, linked by any of its texts; rows without id stay
and link nothing; a similarity equal to the threshold links; an empty table
gives an empty result. Words end at white space, in lower case as of A-Z.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import discard, give_back, give_back_on_driver, map_batches, materialize, small
from tidemark.llm.components import connected_components

#: Documents that make a shingle common: the lowest of these that leaves at least seven of eight marks free.
COMMON = (8, 64, 512)
#: Marks are of the first bits of hashes; shingles are counted by ranges of hashes, and by so many bits in each.
MARK_BITS, RANGE_BITS, COUNTED_BITS = 26, 10, 32
SKETCH = ("s0", "s1", "s2", "s3")
#: Shingles beyond which a sketch of 4096 bits is kept too.
LONG = 400


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``width`` words, ascending."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(len(words) - width + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts, ends[-n:].tolist(), strict=True)), np.uint64, n))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes by their first byte."""
    odd = np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(hashes: np.ndarray) -> bytes | None:
    """As ``sketch``, by the first twelve bits; none for small sets."""
    if len(hashes) <= LONG:
        return None
    odd = np.bincount((hashes >> np.uint64(52)).astype(np.int64), minlength=4096) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def common_shingles(docs: DataFrame, width: int, id_col: str, text_col: str) -> np.ndarray:
    """A bit for each ``MARK_BITS`` first bits of a hash: whether a shingle that begins so is in many documents.

    All documents are counted. Tasks send a list of four-byte numbers for each range of hashes; of the ranges' bits the
    driver gets those of one number of documents, 8 MB whatever the size of the input.
    """
    of_range = MARK_BITS - RANGE_BITS

    def work():
        def step(batch):
            hashes = np.sort(np.concatenate([shingles(t, width) for t in batch.column(0).to_pylist()]))
            ranges = (hashes >> np.uint64(64 - RANGE_BITS)).astype(np.int32)
            low = (hashes >> np.uint64(64 - RANGE_BITS - COUNTED_BITS)).astype(np.uint32)
            at = np.concatenate([[0], np.nonzero(np.diff(ranges))[0] + 1, [len(ranges)]]) if len(ranges) else np.zeros(1, int)
            return {"range": ranges[at[:-1]], "low": [low[i:j].tobytes() for i, j in zip(at, at[1:])]}

        return step

    def count(lists: pa.Table) -> pa.Table:
        low = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in lists.column("low")]))
        starts = np.concatenate([[0], np.nonzero(np.diff(low))[0] + 1])
        held = np.diff(np.append(starts, len(low)))
        out = {"range": [lists.column("range")[0].as_py()]}
        for n in COMMON:
            bits = np.zeros(1 << of_range, bool)
            bits[low[starts[held >= n]] >> np.uint32(COUNTED_BITS - of_range)] = True
            out[f"c{n}"] = [np.packbits(bits, bitorder="little").tobytes()]
            out[f"set{n}"] = [int(bits.sum())]
        give_back()
        kinds = [x for n in COMMON for x in ((f"c{n}", pa.binary()), (f"set{n}", pa.int64()))]
        return pa.table(out, schema=pa.schema([("range", pa.int32()), *kinds]))

    lists = map_batches(docs, [text_col], work, "range int, low binary")
    counted = lists.groupBy("range").applyInArrow(count, ", ".join(["range int", *[f"c{n} binary, set{n} long" for n in COMMON]]))
    counted = materialize(counted)
    filled = counted.agg(*[F.sum(f"set{n}") for n in COMMON]).first()
    level = next((n for n, x in zip(COMMON, filled, strict=True) if (x or 0) <= 1 << MARK_BITS - 3), COMMON[-1])
    marks = np.zeros((1 << RANGE_BITS, 1 << of_range - 3), np.uint8)
    for r in counted.select("range", f"c{level}").toLocalIterator():
        marks[r[0]] = np.frombuffer(r[1], np.uint8)
    discard(counted)
    give_back_on_driver(docs.sparkSession)
    return marks.reshape(-1)


def described(docs: DataFrame, common: np.ndarray, width: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``(rep, same, n, s0..s3, wide, hs, late, last)``: each document's id, the hash of its set, and the set's size,
    sketches, prefix, and the place in the common order where the prefix ends."""

    def work():
        def prefix(hashes: np.ndarray) -> tuple[list[int], bool, int]:
            mark = hashes >> np.uint64(64 - MARK_BITS)
            late = (common[mark >> np.uint64(3)] >> (mark & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            n = len(hashes)
            length = n - int(np.ceil(threshold * n - 1e-9)) + 1 if n else 0
            ordered = np.concatenate([hashes[~late], hashes[late]])[:length]
            last = int(ordered[-1]) - (1 << 63) if length else 0  # signed, in the order of hashes
            return ordered.view(np.int64).tolist(), length > n - late.sum(), last

        def step(batch):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            marks = np.stack([sketch(s) for s in sets])
            hs, late, last = zip(*map(prefix, sets), strict=True)
            return {
                "rep": batch.column(0),
                "same": [xxhash.xxh128_digest(s.tobytes()) for s in sets],
                "n": np.array([len(s) for s in sets], np.int32),
                **{c: marks[:, k] for k, c in enumerate(SKETCH)},
                "wide": [wide_sketch(s) for s in sets],
                "hs": hs,
                "late": late,
                "last": last,
            }

        return step

    kinds = "rep long, same binary, n int, s0 long, s1 long, s2 long, s3 long, wide binary, hs array<long>, late boolean, last long"
    return map_batches(docs, [id_col, text_col], work, kinds)


def plausible(a: str, b: str, threshold: float):
    """Whether sizes and sketches of two rows allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differing = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))
    near = differing <= (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return near & (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-6) & enough_shared(a, b, threshold)


def must_share(n, m, threshold: float):
    """Shingles that sets of ``n`` and ``m`` share if they are similar."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def in_own_prefixes(a: str, b: str, threshold: float):
    """Whether two rows of one key have it in the prefixes, at place ``i``, that the sizes of both ask for.

    Of similar sets the first key that both have is such a one: a set's keys before it are none of the other's.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    must = must_share(n, m, threshold)
    return (F.col(f"{a}.i") <= n - must) & (F.col(f"{b}.i") <= m - must)


def enough_shared(a: str, b: str, threshold: float):
    """Whether two rows have as many keys that some other prefix has too, ``n_shared``, as the similarity asks for.

    All shingles up to the end of the prefix that ends first are in both prefixes. Of that prefix's ``n_keys`` the other
    set lacks no more than its own set's shingles beyond what the two must share, so the rest are keys of both.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    must = must_share(n, m, threshold)
    ends = [F.struct(F.col(f"{x}.late"), F.col(f"{x}.last")) for x in (a, b)]
    keys = F.when(ends[0] <= ends[1], F.col(f"{a}.n_keys") - n).otherwise(F.col(f"{b}.n_keys") - m) + must
    return F.least(f"{a}.n_shared", f"{b}.n_shared") >= keys


def without_unlike(pairs: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """``pairs(src, dst)`` without those whose wide sketches rule the similarity out."""
    pairs = materialize(pairs)
    a = facts.select(F.col("rep").alias("src"), F.col("n").alias("n_a"), F.col("wide").alias("a"))
    b = facts.select(F.col("rep").alias("dst"), F.col("n").alias("n_b"), F.col("wide").alias("b"))

    def work():
        def allowed(a, b, n) -> bool:
            if a is None or b is None:
                return True
            differing = np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum()
            return differing <= n * ((1 - threshold) / (1 + threshold)) + 1e-6

        def step(batch):
            columns = [c.to_pylist() for c in batch.columns[2:]]
            keep = np.array([allowed(a, b, n + m) for a, b, n, m in zip(*columns, strict=True)])
            return {"src": batch.column(0).to_numpy()[keep], "dst": batch.column(1).to_numpy()[keep]}

        return step

    joined = a.join(small(pairs), "src").join(b, "dst")
    out = materialize(map_batches(joined, ["src", "dst", "a", "b", "n_a", "n_b"], work, "src long, dst long").distinct())
    discard(pairs)
    return out


def verified(docs: DataFrame, pairs: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Those of ``pairs(src, dst)`` (materialized) whose texts are similar."""

    def work():
        def step(batch):
            known: dict = {}

            def of(text):
                if text not in known:
                    known[text] = shingles(text, width)
                return known[text]

            texts = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = np.array([similar(of(a), of(b), threshold) for a, b in texts])
            return {"src": batch.column(0).to_numpy()[keep], "dst": batch.column(1).to_numpy()[keep]}

        return step

    first = docs.select(F.col(id_col).alias("src"), F.col(text_col).alias("a")).join(small(pairs), "src")
    ends = small(materialize(pairs.select("dst").distinct()))
    second = docs.select(F.col(id_col).alias("dst"), F.col(text_col).alias("b")).join(ends, "dst", "left_semi")
    return materialize(map_batches(first.join(second, "dst"), ["src", "dst", "a", "b"], work, "src long, dst long").distinct())


def by_fingerprints(docs: DataFrame, table: DataFrame, width: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``(src, dst)``: links that SimHash proposes, verified; the smallest document of a fingerprint stands for it."""
    of_points = docs.select(id_col, text_col).join(small(materialize(table.select(F.col("rep").alias(id_col)).distinct())), id_col, "left_semi")
    marked = materialize(simhash.fingerprints(of_points, id_col=id_col, text_col=text_col).select(F.col(id_col).alias("rep"), "fp"))
    points = materialize(marked.groupBy("fp").agg(F.min("rep").alias("low")))
    near = simhash.links(points.select("fp"))
    ends = [points.select(F.col("fp").alias(end), F.col("low").alias(f"low_{end}")) for end in ("src", "dst")]
    apart = near.join(ends[0], "src").join(ends[1], "dst").select(F.col("low_src").alias("a"), F.col("low_dst").alias("b"))
    equal = marked.join(points, "fp").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    tried = apart.unionByName(equal).where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    tried = materialize(tried)
    out = verified(docs, tried, width, threshold, id_col, text_col)
    discard(marked, points, near, tried)
    give_back_on_driver(docs.sparkSession)
    return out


def links(docs: DataFrame, table: DataFrame, width: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(src, dst)``: links that span the components of "similar", of the documents of ``table`` (materialized), whose sets differ."""
    keys = table.select("rep", F.posexplode("hs").alias("i", "h"))
    shared = materialize(keys.groupBy("h").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("h"))
    held = keys.join(small(shared), "h")
    facts = table.select("rep", "n", *SKETCH, "late", "last", F.size("hs").alias("n_keys"))
    counted = held.groupBy("rep").agg(F.count("*").alias("n_shared"))
    keyed = materialize(held.join(facts.join(counted, "rep"), "rep"))
    discard(shared)

    alike = by_fingerprints(docs, table, width, threshold, id_col, text_col)
    parts = connected_components(alike)

    row = F.struct("rep", *[c for c in keyed.columns if c not in ("rep", "h", "i")])
    stars = keyed.join(keyed.groupBy("h").agg(F.min(row).alias("c")), "h").alias("x").where("c.rep < rep")
    tried = stars.where(plausible("x", "c", threshold)).select(F.col("c.rep").alias("src"), F.col("rep").alias("dst")).distinct()
    tried = without_unlike(between(tried, parts), table, threshold)
    discard(parts)
    # a copy of many is tried against one of them first, and against those only that this leaves in another component
    once = materialize(tried.groupBy("dst").agg(F.min("src").alias("src")).select("src", "dst"))
    found = materialize(alike.unionByName(verified(docs, once, width, threshold, id_col, text_col)))
    discard(alike)
    give_back_on_driver(docs.sparkSession)
    parts = connected_components(found)
    rest = materialize(between(tried.join(once, ["src", "dst"], "left_anti"), parts))
    found = materialize(found.unionByName(verified(docs, rest, width, threshold, id_col, text_col)))
    discard(once, rest, parts)
    give_back_on_driver(docs.sparkSession)

    parts = connected_components(found)
    placed = keyed.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h")
    placed = materialize(placed.join(several, "h"))
    # the smaller set brings the key, from the prefix that it has even for a set of its own size
    early = placed.where(F.col("i") <= F.col("n") - must_share(F.col("n"), F.col("n"), threshold))
    smaller = F.struct("x.n", "x.rep") < F.struct("y.n", "y.rep")
    apart = (F.col("x.h") == F.col("y.h")) & smaller & (F.col("x.component") != F.col("y.component"))
    others = early.alias("x").join(placed.alias("y"), apart & in_own_prefixes("x", "y", threshold) & plausible("x", "y", threshold))
    others = others.select(F.least("x.rep", "y.rep").alias("src"), F.greatest("x.rep", "y.rep").alias("dst")).distinct()
    others = others.join(tried, ["src", "dst"], "left_anti")
    others = without_unlike(others, table, threshold)
    more = verified(docs, others, width, threshold, id_col, text_col)
    discard(keyed, placed, tried, others, parts)
    give_back_on_driver(docs.sparkSession)
    return found.unionByName(more)


def between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of ``pairs(src, dst)`` whose ends are in different components."""
    for end in ("src", "dst"):
        named = parts.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
        pairs = pairs.join(named, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
    return pairs.where("c_src <> c_dst").select("src", "dst")


def first_of_each(
    docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without those that have a smaller id in their component; rows without id stay."""
    common = common_shingles(docs, width, id_col, text_col)
    marked = described(docs.where(F.col(id_col).isNotNull()), common, width, threshold, id_col, text_col)
    # written right away: a number is the row's own from then on
    marked = materialize(marked.withColumn("at", F.monotonically_increasing_id()))
    firsts = marked.groupBy("same").agg(F.min(F.struct("rep", "at")).alias("f"))
    points = materialize(firsts.select("same", F.col("f.rep").alias("first"), F.col("f.at").alias("at")))
    table = materialize(marked.drop("same").join(small(points.select("at")), "at", "left_semi").drop("at"))
    found = links(docs, table, width, threshold, id_col, text_col)
    ids = marked.select(F.col("rep").alias("id"), "same")
    # an id with several texts links their classes
    several = ids.groupBy("id").agg(F.min("same").alias("a"), F.max("same").alias("b")).where("a <> b").select("id")
    others = ids.join(several, "id").join(points, "same").select(F.col("id").alias("src"), F.col("first").alias("dst")).where("src <> dst").distinct()
    parts = connected_components(found.unionByName(others))
    classes = points.join(parts, F.col("first") == F.col("node"), "left").select("same", F.coalesce("component", "first").alias("component"))
    later = ids.join(classes, "same").where("component < id").select(F.col("id").alias(id_col)).distinct()
    later = materialize(later)
    discard(marked, points, table)
    give_back_on_driver(docs.sparkSession)
    return docs.join(small(later), id_col, "left_anti").select(*docs.columns)
