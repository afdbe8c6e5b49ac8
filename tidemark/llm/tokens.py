"""Token counts by heap-and-linked-list byte-pair merging.

``count_tokens`` counts what a byte-level BPE tokenizer would emit, without
emitting identifiers: a word of n symbols in which m merges happen has n - m
tokens. The vocabulary file is read once on the driver (its size is bounded by
the vocabulary) and its merge table goes to the tasks.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special
strings of the file inside a text count one token each, as the library does by
default; repeated rows are counted each. Only the two named columns are read,
so other columns of any name do no harm.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush
from itertools import pairwise

import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import map_batches

#: Fixed value: the published split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words whose counts a task remembers; beyond it the memory starts anew.
REMEMBERED_WORDS = 600_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """Merge table: for each left symbol a lookup from right symbol to rank, and
    for each rank its left, right and merged symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.ranks: dict[int, dict[int, int]] = {}
        self.left, self.right, self.merged = [], [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocab[left], {})[vocab[right]] = rank
            self.left.append(vocab[left])
            self.right.append(vocab[right])
            self.merged.append(vocab[left + right])
        self.symbols = max(vocab.values()) + 1
        self.byte_ids = [vocab[s] for s in byte_symbols()]
        self.specials = [x["content"] for x in spec.get("added_tokens", [])]


def length_counter(merges: Merges):
    """A function from a word's bytes to the symbols left after all its merges.

    The lowest-rank adjacent pair is merged again and again (ties: leftmost). A
    heap holds the candidate pairs as one integer of rank and position, two
    lists link each live symbol with its neighbours; entries that another merge
    made stale are skipped when popped.
    """
    none = {}.get
    rank_of = [merges.ranks[s].get if s in merges.ranks else none for s in range(merges.symbols)] + [none]
    lefts, rights, merged_of = merges.left, merges.right, merges.merged
    byte_id = merges.byte_ids.__getitem__

    def length(word: bytes) -> int:
        symbols = list(map(byte_id, word))
        n = len(symbols)
        shift = n.bit_length()
        heap = [r << shift | i for i, (a, b) in enumerate(pairwise(symbols)) if (r := rank_of[a](b)) is not None]
        if not heap:
            return n
        heapify(heap)
        mask = (1 << shift) - 1
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        symbols.append(-1)  # stands behind the last symbol and, as [-1], before the first
        while heap:
            entry = heappop(heap)
            i = entry & mask
            r = entry >> shift
            j = after[i]
            if symbols[i] != lefts[r] or symbols[j] != rights[r]:
                continue
            m = symbols[i] = merged_of[r]
            symbols[j] = -1
            n -= 1
            k = after[i] = after[j]
            before[k] = i
            if (r := rank_of[m](symbols[k])) is not None:
                heappush(heap, r << shift | i)
            h = before[i]
            if (r := rank_of[symbols[h]](m)) is not None:
                heappush(heap, r << shift | h)
        return n

    return length


class Remembered(dict):
    """Values of a function, computed when first asked for."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key):
        value = self[key] = self.of(key)
        return value


def text_counter(merges: Merges, remembered: int = REMEMBERED_WORDS):
    """A function from a text to its token count.

    The pattern puts a single space at the head of what follows it, so a text
    without double spaces can be counted piece by piece between its spaces;
    each distinct piece is split by the pattern and merged once.
    """
    words = regex.compile(PATTERN).findall
    specials = sorted(merges.specials, key=len, reverse=True)
    cut = regex.compile("|".join(map(regex.escape, specials))).split if specials else lambda text: [text]
    length = length_counter(merges)
    word_tokens = Remembered(lambda word: length(word.encode()))
    piece_tokens = Remembered(lambda piece: sum(map(word_tokens.__getitem__, words(" " + piece))))

    def whole(text: str) -> int:
        return sum(map(word_tokens.__getitem__, words(text)))

    def count(text: str) -> int:
        for known in (word_tokens, piece_tokens):
            if len(known) > remembered:
                known.clear()
        parts = cut(text)
        total = len(parts) - 1
        for part in parts:
            if "  " in part or part[-1:] == " ":
                total += whole(part)
            else:
                first, *rest = part.split(" ")
                total += whole(first) + sum(map(piece_tokens.__getitem__, rest))
        return total

    return count


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every whole text, one row per row."""
    merges = Merges(tokenizer_path)

    def work():
        count = text_counter(merges)

        def step(batch):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [count(t) for t in texts]
            return {
                id_col: batch.column(0),
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, [id_col, text_col], work, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
