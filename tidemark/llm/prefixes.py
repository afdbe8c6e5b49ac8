"""Trie of conversations' prefixes, rolled up by bands of depth.

``prefix_trie`` takes conversations as rows of turns and gives one row per
distinct sequence of first turns: its members, its children, and sums over its
subtree. ``shared_openings`` rebuilds conversations so that they begin with
turns of another one.

A node's name is the exclusive or of 256 bits a turn, SHA-256 of place, role and
text, over its turns: sums over a window, in chunks of ``CHUNK`` turns, give the
names of all prefixes of a conversation of any length. Texts are left behind
after the first pass.

Sums over subtrees go by bands of ``BAND`` depths. Each node adds its own values
to its ancestors within its band, at most ``BAND`` of them, which completes sums
within bands. Band roots are themselves a trie, ``BAND`` times as flat, whose
sums are completed in the same manner; a completed band root is then added to the
ancestors, within the band above, of the node that it hangs from. Rounds grow
as the logarithm of the depth, rows as the nodes.

Defined results: rows without conversation id belong to none and are left out; a
null role or text is empty; turns are ordered by turn (null first), then by role
and by the SHA-256 of the text; repeated rows are turns of their own. A table
without conversations has no node, not even a root. Only the named columns are
read, so other columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Depths of a band.
BAND = 8
#: Turns of a conversation that are taken together.
CHUNK = 1024
#: Bytes, about, of members' ids that are joined to one text on their way to a node's digest.
ENDS_BYTES = 1 << 16
#: The parts of a node's name.
NAME = ["k0", "k1", "k2", "k3"]
#: Those of its parent's.
PARENT = ["p0", "p1", "p2", "p3"]
#: Words of a text: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def turns(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, rank, digest, n_words)``: turns in order, ranks from 1, digests of role and text.

    Rows are sorted into ranges, so that a conversation of any length is ranked by many tasks: a turn's rank is its
    place within the range and the conversation's turns in the ranges before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("text_digest"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
    )
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text_digest")]
    slim = materialize(slim.repartitionByRange(*by).withColumn("part", F.spark_partition_id()))
    sizes = slim.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*by[1:]))
    ranked = slim.withColumn("place", place).join(sizes, ["conv_id", "part"])
    return ranked.select("conv_id", (F.col("before") + F.col("place")).alias("rank"), "digest", "n_words")


def shared_openings(ranked: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation ``c - c % group`` (all if there are fewer, none without
    it), then c's own after its first h, where h is CRC-32 of c in decimal modulo ``most``.

    ``ranked`` is materialized. Returns rebuilt turns ``(conv_id, depth, digest, n_words)`` and ``(conv_id, n_turns)``
    of every conversation, those without turns included.
    """
    share = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    counts = ranked.groupBy("conv_id").agg(F.max("rank").alias("own"))
    bases = counts.select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = counts.withColumn("h", share).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(bases, "base", "left")
    opening = F.least("h", F.coalesce("of_base", F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "h", "own", opening.alias("opening")))
    heads = (
        ranked.where((F.col("rank") < most) & (F.col("conv_id") % group == 0))
        .withColumnRenamed("conv_id", "base")
        .join(convs, "base")
        .where(F.col("rank") <= F.col("h"))
        .select("conv_id", F.col("rank").alias("depth"), "digest", "n_words")
    )
    own = ranked.join(convs, "conv_id").where(F.col("rank") > F.col("h"))
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("opening")).alias("depth"), "digest", "n_words")
    n_turns = F.col("opening") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return heads.union(own), convs.select("conv_id", n_turns.alias("n_turns"))


def name_of(digest: Column, depth: Column) -> list[Column]:
    """256 bits of a turn at its place, as four numbers."""
    whole = F.sha2(F.concat(depth.cast("string"), F.lit(":"), digest), 256)
    # each sixteen digits as a signed number
    halves = [F.conv(F.substring(whole, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(8)]
    return [F.shiftleft(halves[2 * i], 32).bitwiseXOR(halves[2 * i + 1]) for i in range(4)]


def prefixes(rebuilt: DataFrame, convs: DataFrame) -> DataFrame:
    """``(conv_id, depth, n_words, k0..k3, p0..p3)``: every prefix of every conversation, the empty one included, with
    its last turn's words, its name, and the name of the prefix without its last turn."""
    names = [c.alias(k) for c, k in zip(name_of(F.col("digest"), F.col("depth")), NAME, strict=True)]
    turn = materialize(rebuilt.select("conv_id", "depth", "n_words", F.expr(f"(depth - 1) DIV {CHUNK}").alias("chunk"), *names))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = turn.groupBy("conv_id", "chunk").agg(*[F.bit_xor(k).alias(k) for k in NAME])
    before = chunks.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(k).over(earlier), F.lit(0)).alias(f"before_{k}") for k in NAME])
    so_far = turn.withColumns({f"chunk_{k}": F.bit_xor(k).over(within) for k in NAME}).join(before, ["conv_id", "chunk"])
    name = {k: F.col(f"chunk_{k}").bitwiseXOR(F.col(f"before_{k}")) for k in NAME}
    parent = [name[k].bitwiseXOR(F.col(k)).alias(p) for k, p in zip(NAME, PARENT, strict=True)]
    named = so_far.select("conv_id", "depth", "n_words", *[c.alias(k) for k, c in name.items()], *parent)
    zero = F.lit(0).cast("long")
    return named.union(convs.select("conv_id", *[zero.alias(c) for c in named.columns[1:]]))


def trie_nodes(prefix: DataFrame) -> DataFrame:
    """``(depth, k0..k3, conv_id, n_convs, n_words, n_children, parent_conv_id)`` of each node."""
    node = prefix.groupBy("depth", *NAME).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.max("n_words").alias("n_words"),
        *[F.max(p).alias(p) for p in PARENT],
    )
    node = materialize(node)
    above = [(F.col("depth") - 1).alias("depth"), *[F.col(p).alias(k) for p, k in zip(PARENT, NAME, strict=True)]]
    children = node.where("depth > 0").select(*above).groupBy("depth", *NAME).agg(F.count("*").alias("n_children"))
    parents = node.select(
        (F.col("depth") + 1).alias("depth"), *[F.col(k).alias(p) for k, p in zip(NAME, PARENT, strict=True)], F.col("conv_id").alias("parent_conv_id")
    )
    return (
        node.join(children, ["depth", *NAME], "left")
        .join(parents, ["depth", *PARENT], "left")
        .select("depth", *NAME, "conv_id", "n_convs", "n_words", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"))
    )


def subtree_sums(nodes: DataFrame, prefix: DataFrame, values: list[str], deepest: int, band: int = BAND, stride: int = 1) -> DataFrame:
    """``(depth, k0..k3, values)``: the sums of ``values`` over each node's subtree, its top included.

    ``nodes(depth, k0..k3, conv_id, values)`` are those at depths divisible by ``stride`` and ``prefix`` all prefixes,
    both materialized; ``deepest`` is the largest depth.
    """
    key, high = ["depth", *NAME], stride * band
    line = F.sort_array(F.collect_list(F.struct(*key)))  # one conversation's prefixes within a band: ``band`` at most
    lines = prefix.where(F.col("depth") % stride == 0).groupBy("conv_id", F.expr(f"depth DIV {high}").alias("band")).agg(line.alias("line"))
    lines = materialize(lines)

    def spread(of: DataFrame, ancestors: Column) -> DataFrame:
        return of.select(F.explode(ancestors).alias("x"), *values).select("x.*", *values)

    def summed(of: DataFrame) -> DataFrame:
        return of.groupBy(*key).agg(*[F.sum(v).alias(v) for v in values])

    own = nodes.withColumn("band", F.expr(f"depth DIV {high}")).join(lines, ["conv_id", "band"])
    within = summed(spread(own, F.slice("line", 1, F.expr(f"cast(depth % {high} DIV {stride} + 1 AS INT)"))))
    if high > deepest:
        return within
    within = materialize(within)
    of_conv = nodes.where(F.col("depth") % high == 0).select(*key, "conv_id")
    tops = materialize(within.where(F.col("depth") % high == 0).join(of_conv, key))
    done = subtree_sums(tops, prefix, values, deepest, band, high).join(of_conv, key).where("depth > 0")
    hung = done.withColumn("band", F.expr(f"depth DIV {high} - 1")).join(lines, ["conv_id", "band"])
    return summed(within.union(spread(hung, F.col("line")).select(*within.columns)))


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(name, depth, conv_id)`` of conversations' ends to ``(name, depth, ends_sha256)``: SHA-256 of a node's ids in
    decimal, in ascending order, joined by commas.

    Ids are sorted into ranges, and each range's ids of a node become texts of bounded length; these, a few of even a
    large node, pass in order through one digest, which can't be computed in parts.
    """
    keys = ["depth", *NAME]
    by_node = ends.select(*keys, "conv_id").repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, ids, size, out = None, None, [], 0, []
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            for *key, conv in rows:
                if key != node or size > ENDS_BYTES:
                    if ids:
                        out.append((*node, first, ",".join(ids)))
                    node, first, ids, size = key, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield batch_of(out, chunk_schema)
                out = []
        if ids:
            yield batch_of([(*node, first, ",".join(ids))], chunk_schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if out:
                yield batch_of(out, digest_schema)
        if node:
            yield batch_of([(*node, state.hexdigest())], digest_schema)

    numbers = [(k, pa.int64()) for k in keys]
    chunk_schema = pa.schema([*numbers, ("first", pa.int64()), ("ids", pa.string())])
    digest_schema = pa.schema([*numbers, ("ends_sha256", pa.string())])
    ddl = ", ".join(f"{k} long" for k in keys)
    chunks = by_node.mapInArrow(join, f"{ddl}, first long, ids string")
    return chunks.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, f"{ddl}, ends_sha256 string")


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def prefix_trie(rebuilt: DataFrame, convs: DataFrame, band: int = BAND) -> DataFrame:
    """A row a node of the trie of ``rebuilt(conv_id, depth, digest, n_words)``, depths from 1 without gaps, of the
    conversations ``convs(conv_id, n_turns)``.

    ``conv_id``: smallest member; ``depth``; ``parent_conv_id``; ``n_convs``: members; ``n_children``; ``n_leaves``:
    nodes of the subtree without children; ``saved_tokens``: over the subtree, members but one times the words of a
    node's last turn; ``ends_sha256``: of the ids of members that end there; and the node's name ``k0..k3``.
    """
    key = ["depth", *NAME]
    prefix = materialize(prefixes(rebuilt, convs))
    nodes = materialize(trie_nodes(prefix))
    own = nodes.select(
        *key,
        "conv_id",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"),
    )
    deepest = prefix.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(own, prefix, ["n_leaves", "saved_tokens"], deepest, band)
    ends = prefix.join(convs.withColumnRenamed("n_turns", "depth"), ["conv_id", "depth"])
    out = nodes.join(sums, key).join(ends_digests(ends), key, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"), *NAME,
    )
