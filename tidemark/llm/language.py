"""Language identification by averaged hashed subword embeddings.

A text's letters, in lower case, give character n-grams within words and at
their boundaries; each hashes to an embedding, the embeddings are averaged, and
a linear softmax over the average gives the languages' probabilities. Trained
by stochastic gradient descent in numpy on a bounded sample of labelled
documents (``TRAIN_DOCS`` of up to ``PASSAGES`` passages of ``PASSAGE_CHARS``
characters), drawn by language in equal shares, so that rare ones are learned.
A fifth of the sample is kept back to calibrate: one temperature for the
probabilities, and the probability below which a prediction counts as rejected,
set so that accepted ones are right ``ACCEPTED_RIGHT`` of the time.

The layers are linear, so their product, a row of logits for each n-gram, is
all that scoring looks up; it covers every n-gram of every whole text (texts
beyond ``PIECE`` characters in pieces that overlap by the longest n-gram less
one). A text that is null or without letters is ``und`` with score 0; without
labelled rows all are ``und``; ties go to the language that sorts first; rows
that repeat, or have no id, are each scored; an id that repeats is learned from
once; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches
from tidemark.llm.sampling import held_out, stratified_sample

#: Bounds of the sample that the model is trained on.
TRAIN_DOCS, PASSAGES, PASSAGE_CHARS = 3000, 4, 250
BITS, WIDTH, NGRAMS = 16, 12, (2, 3, 4)
ACCEPTED_RIGHT = 0.99
#: Characters that are looked up at once.
PIECE = 1 << 19


class Letters:
    """Lower-case letters of a text as code points, 0 for anything else."""

    def __init__(self):
        self.low = np.zeros(0x10000, np.uint32)
        for c in range(0x10000):
            if (s := chr(c)).isalpha():
                self.low[c] = ord(s.lower()[0])

    def of(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.low[np.minimum(codes, 0xFFFF)]
        for c in np.unique(codes[codes > 0xFFFF]):
            out[codes == c] = c if chr(c).isalpha() else 0
        return out


def ngram_buckets(codes: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each position; the last one, 1 << BITS, where it holds a
    boundary inside or nothing but boundaries."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = np.full(size, n, np.uint32)
    inside = np.ones(size, bool)
    for j in range(n):
        part = codes[j : j + size]
        h = (h ^ part) * np.uint32(0x01000193)
        if 0 < j < n - 1:
            inside &= part > 0
    if n == 2:
        inside = (codes[:-1] > 0) | (codes[1:] > 0)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.where(inside, h >> np.uint32(32 - BITS), 1 << BITS).astype(np.int64)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Languages, a row of logits for each bucket (and a last one of zeros), calibration."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.langs, self.table, self.bias, self.temperature, self.least = langs, table, bias, temperature, least

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Logits summed over the n-grams, and their number."""
        total = np.zeros(self.table.shape[1])
        for i in range(0, len(codes), PIECE):
            for n in NGRAMS:
                piece = codes[i : i + PIECE + n - 1]  # n-grams that begin in the piece
                counts = np.bincount(ngram_buckets(piece, n), minlength=len(self.table)) if len(piece) > 1 << 14 else None
                total += counts @ self.table if counts is not None else self.table[ngram_buckets(piece, n)].sum(axis=0)
        return total

    def logits(self, texts: list[str | None], letters: Letters) -> tuple[np.ndarray, np.ndarray]:
        """(logits of each text, whether it has letters)."""
        codes = [letters.of(f" {t} ") if t else np.zeros(0, np.uint32) for t in texts]
        has = np.array([bool(c.any()) for c in codes], bool)
        sums = np.stack([self.sums(c) for c in codes])
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias, has

    def predict(self, texts: list[str | None], letters: Letters) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, has = self.logits(texts, letters)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(has, p.max(axis=1), 0.0)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], score, ~has | (score < self.least)


def train(texts: list[list[str]], labels: np.ndarray, langs: list[str], epochs: int = 4, rate: float = 20.0, size: int = 32, seed: int = 1) -> Model:
    """``texts``: passages of each document; ``labels``: indexes into ``langs``."""
    rng, letters = np.random.default_rng(seed), Letters()
    grams = []
    for passages in texts:
        codes = np.concatenate([letters.of(f" {p} ") for p in passages])
        ids = np.concatenate([ngram_buckets(codes, n) for n in NGRAMS])
        grams.append(ids[ids < 1 << BITS])
    kept = np.arange(len(grams)) % 5 == 0
    usable = np.array([len(g) > 0 for g in grams])
    embed = rng.uniform(-1, 1, (1 << BITS, WIDTH)).astype(np.float32) / WIDTH
    weight, bias = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    mine = np.nonzero(usable & ~kept)[0]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(mine)
        for i in range(0, len(order), size):
            part = order[i : i + size]
            flat = np.concatenate([grams[k] for k in part])
            counts = np.array([len(grams[k]) for k in part])
            mean = np.add.reduceat(embed[flat], np.cumsum(counts) - counts, axis=0) / counts[:, None]
            d = softmax(mean @ weight + bias)
            d[np.arange(len(part)), labels[part]] -= 1
            d /= len(part)
            back = (d @ weight.T) / counts[:, None]
            weight -= step * (mean.T @ d)
            bias -= 0.01 * step * d.sum(axis=0)
            np.subtract.at(embed, flat, (step * np.repeat(back, counts, axis=0)).astype(np.float32))
    table = np.zeros(((1 << BITS) + 1, len(langs) + 1), np.float32)
    table[:-1, :-1], table[:-1, -1] = embed @ weight, 1
    return calibrated(Model(langs, table, bias), [" ".join(t) for t in texts], labels, kept & usable)


def calibrated(model: Model, texts: list[str], labels: np.ndarray, kept: np.ndarray) -> Model:
    chosen = np.nonzero(kept)[0]
    if not len(chosen):
        return model
    logits, _ = model.logits([texts[k] for k in chosen], Letters())
    y = labels[chosen]
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    p = softmax(logits / model.temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum((p.argmax(axis=1) == y)[order]) / np.arange(1, len(y) + 1)
    good = np.nonzero(right >= ACCEPTED_RIGHT)[0]
    model.least = float(p.max(axis=1)[order][good[-1]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on a bounded sample of the rows with a language that are not held out."""
    wanted = docs.select(id_col, F.col(lang_col).alias("label")).where(F.col("label").isNotNull())
    rows = stratified_sample(docs, wanted, TRAIN_DOCS, PASSAGES, PASSAGE_CHARS, id_col, text_col)
    if not len(rows):
        return Model([], np.zeros((1, 1), np.float32), np.zeros(0, np.float32))
    langs = sorted(rows["label"].unique())
    index = {x: i for i, x in enumerate(langs)}
    return train(list(map(list, rows["passages"])), rows["label"].map(index).to_numpy(np.int64), langs)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score, rejected)`` for every whole text."""

    def work():
        letters = Letters()

        def step(batch):
            langs, score, rejected = model.predict(batch.column(1).to_pylist(), letters)
            return {id_col: batch.column(0), "held_out": batch.column(2), "lang_pred": langs, "score": score, "rejected": rejected}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    marked = docs.select(id_col, text_col, held_out(id_col).alias("__held"))
    schema = f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    return map_batches(marked, [id_col, text_col, "__held"], work, schema)
