"""SimHash near-duplicates by vantage-point trees.

Fingerprints of two documents link when they differ in at most ``radius`` bits.
The 64 bits are cut into blocks so that a linked pair differs in at most
``radius // blocks`` bits of one block (pigeonhole); each block, under its own
Hamming metric, gets a vantage-point tree. Inner nodes split by the distance to
a vantage point; by the triangle bound a fingerprint whose ball reaches over
the boundary is sent to both sides, so every linked pair meets in the home leaf
of its smaller member. Leaves are the shards that Spark deals out, as many as
their size asks for; within one, the search goes on as a vantage-point tree of
its own, down to groups that are compared outright. Results are exact: medians,
of a bounded sample, only set where boundaries lie. Nodes beyond the sampled
levels split at half of the block's bits, the median of random distances.

Copies of one fingerprint are a single point. Leaves that hold many points are
dealt out as pairs of chunks, and a task gives back a spanning forest of its
links, never all pairs of a group.

Defined results: a null or wordless text has fingerprint zero, linked like any
other; rows that repeat an id are the same document, so fingerprints that share
an id are in one component; a row without id has the component of its
fingerprint, null if no row with an id is in it, and links nothing by itself;
an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, hashed_sample, map_batches, materialize, small
from tidemark.llm.components import connected_components

#: Fingerprints at most that the tree boundaries are set by.
SAMPLE = 65_536
#: Levels that the sample sets boundaries of.
SAMPLED_LEVELS = 12
#: Points at home in a leaf that the tree depth aims at; home points and members of one task at most.
LEAF, HOME_CHUNK, MEMBER_CHUNK = 1 << 14, 1 << 15, 1 << 18
#: Pairs that are compared outright within a task.
OUTRIGHT = 1 << 16


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, n
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # sums of up to 255 bits fit a byte
        bits = np.unpackbits(hashes[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)``, fp as a signed long of the 64 bits."""

    def work():
        def step(batch):
            fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
            return {id_col: batch.column(0), "fp": fps.view(np.int64)}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], work, f"`{id_col}` {kind}, fp long")


def block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in pairwise(edges)]


def vantages(nodes: np.ndarray, seed: int) -> np.ndarray:
    """A vantage point for each node: 64 mixed bits of its number."""
    x = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BlockTree:
    """Vantage-point tree over one block; node k has children 2k + 1 and 2k + 2."""

    def __init__(self, mask: int, reach: int, depth: int, sample: np.ndarray, seed: int):
        self.mask, self.reach, self.depth, self.seed = np.uint64(mask), reach, depth, seed
        self.half = (mask.bit_count() - 1) // 2
        # a bound needs a few sampled points
        sampled = max(0, min(depth, SAMPLED_LEVELS, int(math.log2(max(len(sample), 8) / 8))))
        self.bound = np.full((1 << sampled) - 1, self.half, np.int64)
        at = np.zeros(len(sample), np.int64)
        for k in range(len(self.bound)):
            own = at == k
            d = self.distance(sample[own], np.full(own.sum(), k))
            self.bound[k] = balanced(d, mask.bit_count())
            at[own] = 2 * k + 1 + (d > self.bound[k])

    def distance(self, fps: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.bitwise_count((fps ^ vantages(node, self.seed)) & self.mask).astype(np.int64)

    def leaves(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, at home) for each leaf that a ball of ``reach`` around a row meets."""
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
        for level in range(self.depth):
            d = self.distance(fps[row], node)
            t = self.bound[node] if (2 << level) - 1 <= len(self.bound) else self.half
            left, right = d - self.reach <= t, d + self.reach > t
            row = np.concatenate([row[left], row[right]])
            home = np.concatenate([(home & (d <= t))[left], (home & (d > t))[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node, home


def balanced(d: np.ndarray, bits: int) -> int:
    """The bound that splits the distances most evenly."""
    if not len(d):
        return bits // 2
    below = np.cumsum(np.bincount(d, minlength=bits + 1))
    return int(np.argmin(np.abs(below - len(d) / 2)))


def close_pairs(home: np.ndarray, member: np.ndarray, mask: np.uint64, reach: int, radius: int):
    """Index pairs (home, member) within ``radius``, by a vantage-point search under the block's metric."""
    todo = [(np.arange(len(home)), np.arange(len(member)))]
    while todo:
        h, m = todo.pop()
        if not len(h) or not len(m):
            continue
        if len(h) * len(m) > OUTRIGHT:
            vantage = home[h[len(h) // 2]]
            dh = np.bitwise_count((home[h] ^ vantage) & mask).astype(np.int64)
            dm = np.bitwise_count((member[m] ^ vantage) & mask).astype(np.int64)
            t = balanced(dh, 64)
            near = dh <= t
            if 0 < near.sum() < len(h):
                todo.append((h[near], m[dm <= t + reach]))
                todo.append((h[~near], m[dm > t - reach]))
                continue
        for i in range(0, len(h), step := max(1, (1 << 22) // len(m))):
            part = h[i : i + step]
            a, b = np.nonzero(np.bitwise_count(home[part][:, None] ^ member[m][None, :]) <= radius)
            yield part[a], m[b]


def spanning(pairs, n: int) -> dict[int, int]:
    """Spanning stars of the pairs' components: node -> smallest node."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if (p := find(a)) != (q := find(b)):
            parent[max(p, q)] = min(p, q)
    return {x: r for x in range(n) if (r := find(x)) != x}


def link_task(mask: int, reach: int, radius: int, points: pa.Table) -> pa.Table:
    """Links of one task's home points with its members, as a spanning forest of fingerprints."""
    home = points["home"].to_numpy()
    names, code = np.unique(points["fp"].to_numpy().view(np.uint64), return_inverse=True)
    ch, cm = code[home], code[~home]
    found: set = set()
    for a, b in close_pairs(names[ch], names[cm], np.uint64(mask), reach, radius):
        a, b = ch[a], cm[b]
        keep = a != b
        found.update(zip(np.minimum(a, b)[keep].tolist(), np.maximum(a, b)[keep].tolist(), strict=True))
        if len(found) > 4 * len(names) + 1000:
            found = set(spanning(found, len(names)).items())
    star = spanning(found, len(names))
    src, dst = (np.fromiter(x, np.int64, len(star)) for x in (star.keys(), star.values()))
    return pa.table({"src": names[src].view(np.int64), "dst": names[dst].view(np.int64)})


def links(points: DataFrame, radius: int = 4, blocks: int = 3, leaf: int = LEAF) -> DataFrame:
    """``points(fp)``, distinct, to ``(src, dst)``: links that span the components of
    "differs in at most ``radius`` bits". ``points`` should be materialized."""
    n = points.count()
    reach = radius // blocks
    sample = hashed_sample(points, "fp", SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
    masks = block_masks(blocks)
    trees = [BlockTree(mask, reach, depth, sample, seed) for seed, mask in enumerate(masks)]

    def deal():
        def step(batch):
            fps = batch.column(0).to_numpy().view(np.uint64)
            parts = [(k, *tree.leaves(fps)) for k, tree in enumerate(trees)]
            return {
                "block": np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts]),
                "leaf": np.concatenate([p[2] for p in parts]),
                "home": np.concatenate([p[3] for p in parts]),
                "fp": fps[np.concatenate([p[1] for p in parts])].view(np.int64),
            }

        return step

    dealt = materialize(map_batches(points, ["fp"], deal, "block int, leaf long, home boolean, fp long"))
    sizes = materialize(dealt.groupBy("block", "leaf").agg(
        F.ceil(F.sum(F.col("home").cast("int")) / HOME_CHUNK).alias("homes"), F.ceil(F.count("*") / MEMBER_CHUNK).alias("chunks")
    ))
    sized = dealt.join(small(sizes), ["block", "leaf"]).where("homes > 0")
    spread = F.pmod(F.xxhash64("fp"), F.col("homes")).alias("i"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).alias("j")
    as_home = sized.where("home").select(
        "block", "leaf", spread[0], F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(True).alias("home"), "fp"
    )
    as_member = sized.select(
        "block", "leaf", F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("i"), spread[1], F.lit(False).alias("home"), "fp"
    )

    def compare(key, table):
        return link_task(masks[key[0].as_py()], reach, radius, table)

    tasks = as_home.unionByName(as_member)
    found = materialize(tasks.groupBy("block", "leaf", "i", "j").applyInArrow(compare, "src long, dst long"))
    discard(dealt, sizes)
    return found


def near_duplicates(
    docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF
) -> DataFrame:
    """``(id, fp, component_id)``: one row per row; component_id is the smallest id reachable by links."""
    marked = materialize(fingerprints(docs, width, id_col, text_col))
    named = marked.where(F.col(id_col).isNotNull())
    points = materialize(named.groupBy("fp").agg(F.min(id_col).alias("rep")))
    found = links(points.select("fp"), radius, leaf=leaf)
    # an id with several fingerprints links them
    several = named.groupBy(id_col).agg(F.min("fp").alias("dst"), F.max("fp").alias("top")).where("dst < top").drop("top")
    same = named.join(several, id_col).select(F.col("fp").alias("src"), "dst").where("src <> dst").distinct()
    parts = connected_components(found.unionByName(same)).withColumnRenamed("node", "fp")
    placed = points.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = materialize(placed.join(smallest, "component").select("fp", "component_id"))
    discard(points, found)
    return marked.join(classes, "fp", "left").select(id_col, "fp", "component_id")


def first_of_each(docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that have a smaller id in their component; rows without id stay."""
    found = near_duplicates(docs, width, radius, id_col, text_col)
    later = materialize(found.where(f"component_id <> `{id_col}`").select(id_col).distinct())
    return docs.join(small(later), id_col, "left_anti").select(*docs.columns)
