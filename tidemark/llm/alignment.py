"""Alignment of two tokenizers' tokens over the same bytes, by galloping intersection.

``align`` cuts every text into the smallest groups of tokens of a tokenizer A
(a ``tokenizers`` file) and a tokenizer B (a ``sentencepiece`` model) that
cover the same bytes, and links each A token with the B tokens whose bytes it
overlaps. ``score_links`` then counts, over the whole corpus, how many
documents hold each linked pair of identifiers, and scores every document.

A token is given by the byte offset at which it ends. The shorter of two lists
of ends drives an exponential and then a binary search into the longer; ends
that are met in both cut groups, and the difference of two ends' ranks is the
range of tokens that one token overlaps.

Both vocabularies keep a space at the head of a token, so a text is encoded
piece by piece between its single spaces; pieces met before are remembered.
Documents are taken in blocks of about ``BLOCK_BYTES`` of text. A block's pairs
stand once in its dictionary, to which its documents refer by number: what is
shuffled to count pairs is a block's distinct pairs, not every link.

Defined results: B puts a space in front of a text, so A encodes a space and
the text. A text that is null or empty, or whose tokens of A or of B do not
join to exactly those bytes, has no tokens: all numbers are zero and ``groups``
is empty. Strings of special tokens inside texts are plain text. A repeated row
counts as a document of its own. Only the two named columns are read, so other
columns of any name do no harm. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidemark.llm.common import give_back, materialize, pieces, small_batches
from tidemark.llm.tokens import byte_symbols

#: Bytes, about, of the texts of a block; a longer text is a block alone.
BLOCK_BYTES = 8 << 20
#: Pairs of a block's dictionary in one row.
CHUNK = 1 << 15
#: Pieces of text, and bytes of them, that a task remembers; beyond it the memory starts anew.
REMEMBERED, REMEMBERED_BYTES = 600_000, 32 << 20
#: Pieces that are encoded as one text.
TOGETHER = 512

#: A single space between two characters that are none: no token of either vocabulary goes across its head.
CUT = re.compile(r"(?<=\S) (?=\S)")


def gallop(keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """For each of the increasing ``keys`` the first index of the increasing ``into`` that is not less.

    Every 16th key starts from the place of the 256th before it, and so on: a
    search starts where an earlier key was found, doubles its step until it is
    past its key, and halves the last step. Keys of a level go together.
    """
    found = np.zeros(len(keys), np.int64)
    for stride in (4096, 256, 16, 1):
        at = np.arange(0, len(keys), stride)
        found[at] = gallop_from(found[at // (stride * 16) * (stride * 16)], keys[at], into)
    return found


def gallop_from(start: np.ndarray, keys: np.ndarray, into: np.ndarray) -> np.ndarray:
    """As ``gallop``, from places that are known not to be beyond each key's."""
    low, step = start.copy(), np.ones(len(keys), np.int64)
    going = np.arange(len(keys))
    while len(going):  # all before low is less than the key
        ahead = low[going] + step[going]
        inside = ahead <= len(into)
        going, ahead = going[inside], ahead[inside]
        less = into[ahead - 1] < keys[going]
        going, ahead = going[less], ahead[less]
        low[going] = ahead
        step[going] *= 2
    high = np.minimum(low + step - 1, len(into))
    going = np.nonzero(low < high)[0]
    while len(going):
        middle = (low[going] + high[going]) >> 1
        less = into[middle] < keys[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two increasing lists with the same last end: the indices of ends in common, in each list, and the links
    (index of the A token, index of the B token), in order."""
    swapped = len(ends_a) > len(ends_b)
    short, long = (ends_b, ends_a) if swapped else (ends_a, ends_b)
    last = gallop(short, long)
    common = long[last] == short
    first = np.zeros(len(short), np.int64)
    first[1:] = last[:-1] + common[:-1]
    many = last - first + 1
    of_short = np.repeat(np.arange(len(short)), many)
    of_long = np.arange(len(of_short)) - np.repeat(np.cumsum(many) - many, many) + first[of_short]
    own = np.nonzero(common)[0]
    return (last[own], own, of_long, of_short) if swapped else (own, last[own], of_short, of_long)


class Vocabularies:
    """Both tokenizers, loaded from the contents of their files, and what their tokens' bytes are."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte_of = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        by_id = {i: token for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [
            bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
            for t in (by_id.get(i, "") for i in range(max(by_id) + 1))
        ]
        self.bytes_b = [
            bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()
            for i, t in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))
        ]
        inner = any("▁" in t.lstrip("▁") for t in map(self.b.id_to_piece, range(self.b.vocab_size())))
        self.cut = (lambda text: [text]) if inner else cut_pieces
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, bool]:
        """Identifiers by A, of a space and each text, and by B, of each text, laid end to end, and whether
        both join to the bytes of the texts with a space before each."""
        encoded = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        a = [i for x in encoded for i in x.ids]
        b = [i for x in self.b.encode(texts, num_threads=1) for i in x]
        whole = b"".join(b" " + t.encode() for t in texts)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
        return np.array(a, np.int32), np.array(b, np.int32), same


def cut_pieces(text: str) -> list[str]:
    return text.split(" ") if "  " not in text and not text.startswith(" ") and not text.endswith(" ") else CUT.split(text)


class Encoder:
    """Identifiers of texts by both tokenizers, as numpy arrays, by way of remembered pieces."""

    def __init__(self, vocabularies: Vocabularies):
        self.of = vocabularies
        self.lengths = (vocabularies.length_a, vocabularies.length_b)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # a piece's number, -1 if it loses bytes
        self.held = 0
        self.ids = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]  # of each number's identifiers

    def learn(self, words: list[str]) -> None:
        """Encode pieces. Those without white space at an end go many to a text, with single spaces between."""
        alone = [w for w in words if not w or w[0].isspace() or w[-1].isspace()]
        rest = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        groups = [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        ids, starts = [[x] for x in self.ids], [[x] for x in self.starts]
        number = len(self.starts[0]) - 1
        while groups or alone:
            group = groups.pop() if groups else [alone.pop()]
            *found, same = self.of.encode([" ".join(group)])
            if not same and len(group) > 1:
                groups += [[w] for w in group]
                continue
            self.known.update(zip(group, range(number, number + len(group)) if same else [-1] * len(group), strict=True))
            size = np.array([len(w.encode()) + 1 for w in group], np.int64)
            self.held += int(size.sum())
            if same:
                number += len(group)
                for side in (0, 1):
                    ends = np.cumsum(self.lengths[side][found[side]])
                    after = np.searchsorted(ends, np.cumsum(size)) + 1
                    ids[side].append(found[side])
                    starts[side].append(starts[side][-1][-1] + after)
        self.ids, self.starts = [np.concatenate(x) for x in ids], [np.concatenate(x) for x in starts]

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For A and for B: all texts' identifiers laid end to end, and how many each text has."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        parts = [self.of.cut(t) if t else [] for t in texts]
        words = list(chain.from_iterable(parts))
        if fresh := list(set(words).difference(self.known)):
            self.learn(fresh)
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        text_of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        lost = np.unique(text_of[numbers < 0])  # a piece loses bytes, and with it its text
        if len(lost):
            keep = ~np.isin(text_of, lost)
            numbers, text_of = numbers[keep], text_of[keep]
        ids, many = [], []
        for side in (0, 1):
            starts = self.starts[side]
            length = starts[numbers + 1] - starts[numbers]
            at = np.arange(length.sum()) + np.repeat(starts[numbers] - (np.cumsum(length) - length), length)
            ids.append(self.ids[side][at])
            many.append(np.bincount(text_of, length, len(texts)).astype(np.int64))
        return ids, many


class Block:
    """The pairs of a block's documents: each once, with its number and how many documents hold it."""

    def __init__(self):
        self.pairs = np.empty(0, np.int64)
        self.numbers = np.empty(0, np.int64)
        self.documents = np.empty(0, np.int64)  # by number
        self.bytes = 0

    def number(self, pairs: np.ndarray) -> np.ndarray:
        """Numbers of pairs, one document's each once; new ones are entered."""
        distinct, inverse = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.pairs, distinct)
        inside = at < len(self.pairs)
        new = np.ones(len(distinct), bool)
        new[inside] = self.pairs[at[inside]] != distinct[inside]
        fresh = len(self.documents) + np.arange(new.sum())
        self.pairs = np.insert(self.pairs, at[new], distinct[new])
        self.numbers = np.insert(self.numbers, at[new], fresh)
        self.documents = np.concatenate([self.documents, np.zeros(len(fresh), np.int64)])
        numbers = self.numbers[np.searchsorted(self.pairs, distinct)][inverse]
        self.documents += np.bincount(numbers, minlength=len(self.documents))
        return numbers

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The dictionary by number, in chunks: first number, pairs, documents that hold them."""
        by_number = np.empty(len(self.pairs), np.int64)
        by_number[self.numbers] = self.pairs
        for i in range(0, len(by_number), CHUNK):
            yield i, by_number[i : i + CHUNK], self.documents[i : i + CHUNK]


class Writer:
    """Texts of groups: ``a1,a2|b1;a3|b2,b3``, identifiers in decimal."""

    def __init__(self, n_a: int, n_b: int):
        self.strings = [f"{i}{end}" for i in range(n_a) for end in ",|"] + [f"{i}{end}" for i in range(n_b) for end in ",;"]
        self.b_from = 2 * n_a

    def __call__(self, ids: list[np.ndarray], common: list[np.ndarray], many: np.ndarray) -> list[str]:
        """The groups of each text, of which ``many`` says how many tokens it has in all."""
        placed = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side, at_least in ((0, 0), (1, 1)):
            last = np.zeros(len(ids[side]), np.int64)
            last[common[side]] = 1
            group = np.cumsum(last) - last
            others = np.concatenate([[0], common[1 - side] + 1])  # tokens of the other side up to each group
            placed[np.arange(len(group)) + others[group + at_least]] = self.b_from * side + 2 * ids[side] + last
        ends = np.cumsum(many)
        codes = placed.tolist()
        get = self.strings.__getitem__
        return ["".join(map(get, codes[a:b]))[:-1] for a, b in zip((ends - many).tolist(), ends.tolist(), strict=True)]


def align(
    docs: DataFrame,
    a_path: str,
    b_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Aligned documents and the dictionaries of their blocks.

    A document's row: ``id, n_a, n_b, n_groups, n_links``, ``groups`` (text), and the links' pairs as ``numbers``
    of the dictionary of its ``block`` with their ``times``. A dictionary's row, whose ``pairs`` is not null:
    ``block, first`` (the number of its first pair), ``pairs`` (A's identifier times 2^32 plus B's) and
    ``documents`` (how many of the block's hold each). Rows are one pass over the texts; materialize them before
    they are used twice, as a block's number is that of the task that read it.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, numbers array<int>, "
        "times array<int>, block long, first int, pairs array<long>, documents array<int>"
    )
    target = to_arrow_schema(_parse_datatype_string(schema))
    a_json, b_model = Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays(
            [
                x if isinstance(x := columns.get(f.name), pa.Array) else pa.nulls(n, f.type) if x is None else pa.array(x, f.type)
                for f in target
            ],
            schema=target,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = Vocabularies(a_json, b_model)
        encode = Encoder(vocabularies)
        write = Writer(len(vocabularies.bytes_a), len(vocabularies.bytes_b))
        number, block = TaskContext.get().partitionId() << 32, Block()

        def dictionary() -> Iterator[pa.RecordBatch]:
            for first, pairs, documents in block.rows():
                yield rows(block=[number], first=[first], pairs=[pairs], documents=[documents])

        for batch in batches:
            for piece in pieces(batch):
                texts = [t or "" for t in piece.column(1).to_pylist()]
                if block.bytes and block.bytes + piece.nbytes > block_bytes:
                    yield from dictionary()
                    number, block = number + 1, Block()
                block.bytes += piece.nbytes
                ids, many = encode(texts)
                common_a, common_b, of_a, of_b = overlaps(
                    np.cumsum(vocabularies.length_a[ids[0]]), np.cumsum(vocabularies.length_b[ids[1]])
                )
                text_of = np.repeat(np.arange(len(texts)), many[0])
                pairs = ids[0][of_a].astype(np.int64) << 32 | ids[1][of_b]
                # a link's pair and document as one number: pairs of the piece, numbered in order, times documents
                distinct, inverse = np.unique(pairs, return_inverse=True)
                keys, times = np.unique(text_of[of_a] * np.int64(len(distinct) or 1) + inverse, return_counts=True)
                owner, pair = np.divmod(keys, np.int64(len(distinct) or 1))
                numbers = block.number(distinct[pair])
                offsets = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
                yield rows(
                    id=piece.column(0),
                    n_a=many[0],
                    n_b=many[1],
                    n_groups=np.bincount(text_of[common_a], minlength=len(texts)),
                    n_links=np.bincount(text_of[of_a], minlength=len(texts)),
                    groups=write(ids, [common_a, common_b], many[0] + many[1]),
                    numbers=pa.ListArray.from_arrays(offsets, pa.array(numbers.astype(np.int32))),
                    times=pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
                    block=np.full(len(texts), number),
                )
        yield from dictionary()
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n_docs, best)`` of each linked pair of identifiers: how many documents hold it, and whether no pair
    of the same A identifier is in more. ``aligned`` is materialized."""
    held = aligned.where("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "documents")).alias("x"))
    counts = held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.documents").alias("n_docs"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", 32)))
    most = counts.groupBy("a").agg(F.max("n_docs").alias("most"))  # a row for each identifier of A: bounded by its vocabulary
    return counts.join(F.broadcast(most), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links``, the ``carried`` columns, ``n_best`` (links whose pair is in as many
    documents as any of its A identifier) and ``count_sum`` (over links, the documents of their pair).

    ``aligned`` is what ``align`` returns, materialized. A block's documents meet their dictionary's counts in one
    group, whose size the block's bytes bound.
    """
    entries = aligned.where("pairs IS NOT NULL").select("block", "first", F.posexplode("pairs").alias("at", "pair"))
    counts = (
        entries.join(pair_counts(aligned), "pair")
        .select(F.col("block").alias("of_block"), (F.col("first") + F.col("at")).alias("number"), "n_docs", "best")
    )
    names = ["id", "n_a", "n_b", "n_groups", "n_links", *carried]
    documents = aligned.where("pairs IS NULL").select(*names, "numbers", "times", "block")
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names) + ", n_best long, count_sum long"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        n_docs, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        number = right.column("number").to_numpy()
        n_docs[number] = right.column("n_docs").to_numpy()
        best[number] = right.column("best").to_numpy()
        sums = np.zeros((2, left.num_rows), np.int64)
        row = 0
        for batch in left.select(["numbers", "times"]).to_batches():
            numbers, times = batch.column(0), batch.column(1)
            length = np.diff(numbers.offsets.to_numpy())
            at, weight = numbers.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            owner = row + np.repeat(np.arange(len(length)), length)
            for i, values in enumerate((best, n_docs)):
                np.add.at(sums[i], owner, values[at] * weight)
            row += len(length)
        out = left.select(names)
        return out.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1]))

    return documents.groupBy("block").cogroup(counts.groupBy("of_block")).applyInArrow(score, schema)
