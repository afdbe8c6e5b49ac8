"""Embedding near-duplicates by a random-projection tree forest.

Vectors of one label link when their cosine is at least ``threshold``. Every
tree of the forest splits by random directions at median projections, again and
again, down to leaves of about ``leaf`` points; vectors within a margin of a
boundary spill to both sides. Leaves of all trees are the groups within which
all pairs are compared exactly, in double precision; links of all leaves unite
to components. Medians come from a bounded sample. Where a node holds too few
sampled points for a median of its own, those of its last well-sampled ancestor
set the split, so trees are as deep as the data asks for, at any size.

A tree parts a linked pair only where the pair's difference, projected, is
larger than twice the margin and straddles the boundary, and a pair counts as
found if any tree keeps it together, so with ``TREES`` trees misses are rare.
A pair that shares several leaves is counted in the first of them alone: for
the points that have links a task looks up their other leaves in the forest,
so link counts need no list of pairs and dealt rows carry no list of leaves.

Equal vectors are one point with a multiplicity. Large leaves are dealt out as
pairs of chunks; a task returns a count for each point and a spanning forest.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and those without label, link with nothing and stand for
themselves; only vectors of one length are compared (lengths beyond the
``LENGTHS`` commonest without trees, in chunks); rows of equal id are points of
their own with that id, linked only if their vectors are; rows without id link
with nothing and have a null component; an empty table gives an empty result.
Only the three named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, hash_share, map_batches, materialize
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import spanning

TREES = 8
#: Bytes of vectors, about, that split points are set by; vector lengths that trees are grown for.
SAMPLE_BYTES, LENGTHS = 16 << 20, 64
#: Points that a leaf aims at, and points of one chunk at most.
LEAF, CHUNK = 512, 1024
#: Sampled points that a median is taken of at least.
FEW = 16
#: Margin on either side of a boundary, in standard deviations of a linked pair's projected difference.
MARGIN = 0.75


def points_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(id, label, dim, vec)`` of the vectors that can link; vec: components as 4-byte floats if
    the column holds such, else as 8-byte ones."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col, vector_col)}
    kind = float_kind(kinds[vector_col])

    def work():
        def step(batch):
            rows, dims, out = [], [], []
            for i, v in enumerate(batch.column(2).to_pylist()):
                if not v or None in v:
                    continue
                x = np.array(v, kind)
                if np.isfinite(x).all() and x.any():
                    rows.append(i)
                    dims.append(len(x))
                    out.append(x.tobytes())
            at = pa.array(rows, pa.int64())
            return {id_col: batch.column(0).take(at), "label": batch.column(1).take(at), "dim": dims, "vec": out}

        return step

    schema = f"`{id_col}` {kinds[id_col]}, label {kinds[label_col]}, dim int, vec binary"
    able = vectors.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return map_batches(able, [id_col, label_col, vector_col], work, schema)


def float_kind(column: str) -> type:
    return np.float32 if column == "array<float>" else np.float64


def unit(vectors: list[bytes], kind: type) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Tree:
    """Random directions, one a level, and where they split. Node k has children 2k + 1 and 2k + 2.

    ``split`` holds a value for each node of the first ``sampled`` levels,
    ``further`` one for each node at level ``sampled`` and level below.
    """

    def __init__(self, dim: int, depth: int, margin: float, sample: np.ndarray, seed: int):
        self.dim, self.depth, self.margin, self.seed = dim, depth, margin, seed
        self.sampled = max(0, min(depth, int(math.log2(max(len(sample) / FEW, 1)))))
        self.split = np.zeros((1 << self.sampled) - 1)
        self.further = np.zeros((1 << self.sampled, depth - self.sampled))
        at = np.zeros(len(sample), np.int64)
        directions = self.directions()
        projected = sample @ directions.T if depth else np.zeros((len(sample), 0))
        for level in range(self.sampled):
            p = projected[:, level]
            base = (1 << level) - 1
            self.split[base : 2 * base + 1] = medians(p, at - base, 1 << level)
            at = 2 * at + 1 + (p > self.split[at])
        own = at - ((1 << self.sampled) - 1)
        for j in range(depth - self.sampled):
            self.further[:, j] = medians(projected[:, self.sampled + j], own, 1 << self.sampled)

    def directions(self) -> np.ndarray:
        d = np.random.default_rng((self.seed, self.dim)).standard_normal((self.depth, self.dim))
        return d / np.linalg.norm(d, axis=1, keepdims=True)

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) for each node at the row's depth that the row spills into."""
        projected = x @ self.directions().T
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        root = np.zeros(len(x), np.int64)  # place among the nodes at level ``sampled``
        done = []
        for level in range(self.depth):
            end = depth[row] <= level
            done.append((row[end], node[end]))
            row, node, root = row[~end], node[~end], root[~end]
            if level == self.sampled:
                root = node - ((1 << level) - 1)
            split = self.split[node] if level < self.sampled else self.further[root, level - self.sampled]
            p = projected[row, level]
            left, right = p <= split + self.margin, p > split - self.margin
            row, node, root = np.r_[row[left], row[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2], np.r_[root[left], root[right]]
        done.append((row, node))
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def medians(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The median of each group's values; 0 for a group without any."""
    order = np.lexsort((values, group))
    sizes = np.bincount(group, minlength=groups)
    ends = np.cumsum(sizes)
    low, high = ends - sizes + (sizes - 1) // 2, ends - sizes + sizes // 2
    ranked = np.r_[values[order], 0.0]
    return np.where(sizes > 0, (ranked[np.clip(low, 0, len(values))] + ranked[np.clip(high, 0, len(values))]) / 2, 0.0)


def grow(points: DataFrame, threshold: float, kind: type) -> dict[int, list[Tree]]:
    """The forest for each vector length that fills more than one leaf, from a bounded sample."""
    deep = points.groupBy("dim").agg(F.count("*").alias("n"), F.max("depth").alias("depth")).where("depth > 0")
    # as many rows as trees are grown for
    wanted = {r.dim: (r.n, r.depth) for r in deep.orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    share = F.lit(0.0)
    for dim, (n, _) in wanted.items():
        share = F.when(F.col("dim") == dim, max(64.0, SAMPLE_BYTES / (8 * dim * len(wanted))) / n).otherwise(share)
    out = {}
    rows = points.where(hash_share("vec") < share).select("dim", "vec").toPandas() if wanted else None
    for dim, (_, depth) in wanted.items():
        sample = unit(rows["vec"][rows["dim"] == dim].tolist(), kind)
        margin = MARGIN * math.sqrt(max(2 - 2 * threshold, 0) / dim)
        out[dim] = [Tree(dim, depth, margin, sample, seed) for seed in range(TREES)]
    return out


def leaves_of(trees: list[Tree], x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) over all trees of a forest; without trees all rows are in leaf 0."""
    if not trees:
        return np.arange(len(x)), np.zeros(len(x), np.int64)
    parts = [(t, *tree.leaves(x, np.minimum(depth, tree.depth))) for t, tree in enumerate(trees)]
    # where there is but one leaf, one tree is enough
    keep = [r[depth[r] > 0] if t else r for t, r, _ in parts]
    codes = [(n[depth[r] > 0] if t else n) << 4 | t for t, r, n in parts]
    return np.concatenate(keep), np.concatenate(codes)


def compare(first: pa.Table, second: pa.Table | None, leaf: int, threshold: float, trees: list[Tree], kind: type) -> dict[str, list]:
    """Counts of links by point, and a spanning forest, among the points of one or between those of two chunks."""
    rows = first if second is None else pa.concat_tables([first, second])
    n, cut = rows.num_rows, first.num_rows
    x = unit(rows["vec"].to_pylist(), kind)
    key, mult = rows["key"].to_numpy(), rows["mult"].to_numpy()
    same = x @ x.T
    # a product of rows decides; the matrix product may differ in the last bit
    i, j = np.nonzero(np.triu(np.abs(same - threshold) < 1e-9, 1))
    same[i, j] = same[j, i] = np.einsum("ij,ij->i", x[i], x[j])
    link = same >= threshold
    np.fill_diagonal(link, False)
    if second is not None:
        link[:cut, :cut] = link[cut:, cut:] = False
    hit = np.nonzero(link.any(axis=1))[0]
    if not len(hit):
        return {"key": key[:0], "n": mult[:0], "root": key[:0]}
    link = link[np.ix_(hit, hit)]
    if trees:
        at, code = leaves_of(trees, x[hit], rows["depth"].to_numpy()[hit])
        at, code = at[code < leaf], code[code < leaf]
        if len(code):
            names, place = np.unique(code, return_inverse=True)
            held = np.zeros((len(hit), len(names)), np.float32)
            held[at, place] = 1
            link &= (held @ held.T) == 0
    counts = link @ mult[hit]
    a, b = np.nonzero(np.triu(link, 1))
    star = spanning(zip(a.tolist(), b.tolist(), strict=True), len(hit))
    own = np.nonzero(counts)[0]
    return {"key": key[hit[own]], "n": counts[own], "root": key[hit[[star.get(k, k) for k in own.tolist()]]]}


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    leaf: int = LEAF,
) -> DataFrame:
    """``(id, n_links, component_id, kept)``: one row per vector."""
    float_of = float_kind(vectors.schema[vector_col].dataType.simpleString())
    able = materialize(points_of(vectors, id_col, vector_col, label_col))
    points = able.groupBy("label", "dim", "vec").agg(F.min(F.col(id_col).cast("long")).alias("rep"), F.count("*").alias("mult"))
    # written right away: a key is the point's own from then on
    points = materialize(points.withColumn("key", F.monotonically_increasing_id()))
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("n"))
    deep = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / leaf))).cast("int").alias("depth")
    sized = materialize(points.join(sizes.select("label", "dim", deep), ["label", "dim"]))
    forest = grow(sized, threshold, float_of)

    def deal():
        def step(batch):
            dim, depth = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            row, leaves = [], []
            for d in np.unique(dim):
                own = np.nonzero(dim == d)[0]
                r, node = leaves_of(forest.get(int(d), []), unit(batch.column(5).take(pa.array(own)).to_pylist(), float_of), depth[own])
                row.append(own[r])
                leaves.append(node)
            at = pa.array(np.concatenate(row))
            names = ("label", "dim", "depth", "key", "mult", "vec")
            return {n: batch.column(k).take(at) for k, n in enumerate(names)} | {"leaf": np.concatenate(leaves)}

        return step

    kind = able.schema["label"].dataType.simpleString()
    schema = f"label {kind}, dim int, depth int, key long, mult long, vec binary, leaf long"
    dealt = materialize(map_batches(sized, ["label", "dim", "depth", "key", "mult", "vec"], deal, schema))
    by = ["label", "dim", "leaf"]
    chunks = dealt.groupBy(*by).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    spread = F.pmod(F.xxhash64("key", F.lit(3)), F.col("chunks"))
    chunked = dealt.join(chunks, by).withColumn("own", spread)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    tasks = chunked.select("*", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def task(key, table):
        own, i, j = table["own"].to_numpy(), key[3].as_py(), key[4].as_py()
        first = table.filter(pa.array(own == i))
        second = table.filter(pa.array(own == j)) if i != j else None
        return pa.table(compare(first, second, key[2].as_py(), threshold, forest.get(key[1].as_py(), []), float_of), schema=target)

    target = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])
    found = materialize(tasks.groupBy(*by, "i", "j").applyInArrow(task, "key long, n long, root long"))
    discard(dealt, sized)
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(F.col("key").alias("src"), F.col("root").alias("dst")).where("src <> dst"))
    known = points.join(counts, "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    known = known.withColumn("component", F.coalesce("component", "key"))
    smallest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = known.join(smallest, "component").select("label", "dim", "vec", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = able.join(classes, ["label", "dim", "vec"]).select(id_col, "n_links", "component_id")
    alone = unable(vectors, id_col, vector_col, label_col)
    alone = alone.select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def unable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that ``points_of`` leaves out."""
    v = F.col(vector_col)
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    zero = F.forall(v, lambda c: c == 0)
    return vectors.where(F.col(id_col).isNull() | F.col(label_col).isNull() | F.coalesce(bad, F.lit(True)) | F.coalesce(zero, F.lit(False)))
