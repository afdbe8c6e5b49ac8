"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a sequence of words; a word's input is a hashed word embedding plus
the mean of hashed embeddings of its character n-grams. Overlapping windows of
``WINDOW`` words go through a forward and a backward gated recurrent layer,
attention pools their states, and a linear layer gives the window's logit. The
document's logit is the largest of all its windows; Platt scaling makes it a
probability. It is fitted on the logits of the whole texts, scored in Spark
tasks, of a fifth of the sample that the network was not trained on.

The network is trained in numpy on a bounded sample of labelled documents
(``TRAIN_DOCS`` of up to ``PASSAGES`` passages of ``PASSAGE_CHARS`` characters).
A document's label first holds for all its windows; then training goes on with
the windows that score highest within each document.

Scoring covers all windows of every whole text, and all n-grams of every word,
however long (a long one is hashed in pieces). A text that is null or without
words scores 0; without any labelled row, or with one class only, the score is
the share of label 1 (0 without labels); a score equal to the threshold is
toxic; rows that repeat, or have no id, are each scored; an id that repeats is
learned from once; an empty table gives an empty result. Only the two named
columns are read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import give_back_on_driver, map_batches, pieces, small_batches
from tidemark.llm.sampling import balanced_sample, held_out, map_texts, of_ids, platt, sigmoid

#: Bounds of the sample that the network is trained on.
TRAIN_DOCS, PASSAGES, PASSAGE_CHARS = 4500, 8, 800
WINDOW, STRIDE = 32, 24
HIDDEN, INPUT = 8, 12
WORD_BUCKETS, CHAR_BUCKETS = 1 << 14, 1 << 15
NGRAMS = (3, 4, 5)
#: Words whose inputs a task remembers; windows, words, and characters of one word that are worked on at once.
REMEMBERED_WORDS, AT_ONCE, WORDS_AT_ONCE, CHARS_AT_ONCE = 150_000, 2048, 8192, 1 << 16

find_words = re.compile(r"\w+").findall


def windows_of(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows over word ids; 0 pads."""
    n = max(1, 1 + -(-(len(ids) - WINDOW) // STRIDE))
    out = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
    out[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[::STRIDE]


def word_buckets(words: list[str]) -> np.ndarray:
    return np.array([1 + zlib.crc32(w.encode()) % (WORD_BUCKETS - 1) for w in words], np.int64)


def char_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram buckets of all words, one after the other; how many each word has)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(chars))
    grid = np.full((len(chars), len(NGRAMS)), -1, np.int64)
    for k, n in enumerate(NGRAMS):
        h = np.full(max(len(chars) - n + 1, 0), n, np.uint64)
        for j in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ chars[j : j + len(h)]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
        own = at[: len(h)] + n <= ends[: len(h)]
        grid[: len(h), k] = np.where(own, h.astype(np.int64), -1)
    counts = np.add.reduceat((grid >= 0).sum(axis=1), np.cumsum(sizes) - sizes)
    flat = grid.ravel()
    return flat[flat >= 0], counts


def piece_buckets(marked: str, start: int, end: int) -> np.ndarray:
    """Buckets of the n-grams that begin at start..end - 1 of one marked word."""
    longest = max(NGRAMS)
    chars = np.frombuffer(marked[start : end + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = []
    for n in NGRAMS:
        size = min(end - start, len(chars) - n + 1)
        h = np.full(max(size, 0), n, np.uint64)
        for j in range(n):
            h = (h * np.uint64(0x100000001B3)) ^ chars[j : j + len(h)]
        found.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)).astype(np.int64))
    return np.concatenate(found)


def grouped_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``counts`` (none zero) at a time."""
    return np.add.reduceat(values, np.cumsum(counts) - counts, axis=0)


def logistic(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """Weights, and the passes through them. Word row 0 is padding: it leaves states as they are."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        h, d = HIDDEN, INPUT
        self.w = {
            "word": np.zeros((WORD_BUCKETS, d), np.float32),
            "char": rng.normal(0, 0.1, (CHAR_BUCKETS, d)).astype(np.float32),
            "attend": np.zeros(2 * h, np.float32),
            "out": rng.normal(0, 0.3, 2 * h).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.w["x" + side] = rng.normal(0, d**-0.5, (d, 3 * h)).astype(np.float32)
            self.w["u" + side] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
            self.w["c" + side] = np.repeat(np.float32([1, 0, 0]), h)  # update gates start rather closed

    def inputs_of(self, words: list[str]) -> np.ndarray:
        """Inputs of words of any length, a long one's n-grams summed piece by piece."""
        short = [w if len(w) <= CHARS_AT_ONCE else w[:8] for w in words]
        out = np.concatenate([
            self.inputs(word_buckets(part), *char_buckets(part)) for i in range(0, len(short), WORDS_AT_ONCE) for part in [short[i : i + WORDS_AT_ONCE]]
        ])
        for i, word in enumerate(words):
            if len(word) > CHARS_AT_ONCE:
                marked, total, count = f"<{word}>", np.zeros(INPUT), 0
                for a in range(0, len(marked), CHARS_AT_ONCE):
                    grams = piece_buckets(marked, a, a + CHARS_AT_ONCE)
                    total += self.w["char"][grams].sum(axis=0, dtype=np.float64)
                    count += len(grams)
                out[i] = self.w["word"][word_buckets([word])[0]] + total / count
        return out

    def inputs(self, words: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = self.w["word"][words]
        ends = np.cumsum(counts)
        for i in range(0, len(words), WORDS_AT_ONCE):
            own = counts[i : i + WORDS_AT_ONCE]
            part = chars[ends[i] - counts[i] : ends[i] + own[1:].sum()]
            out[i : i + WORDS_AT_ONCE] += grouped_sums(self.w["char"][part], own) / own[:, None].astype(np.float32)
        return out

    def project(self, x: np.ndarray) -> dict[str, list[np.ndarray]]:
        """By side: what the inputs add to update gate, reset gate and candidate, each an array of its own."""
        out = {s: x @ self.w["x" + s] + self.w["c" + s] for s in "fb"}
        return {s: [np.ascontiguousarray(p) for p in np.split(g, 3, axis=1)] for s, g in out.items()}

    def padded(self, gates: dict[str, list[np.ndarray]]) -> dict[str, list[np.ndarray]]:
        stay = [np.full((1, HIDDEN), v, np.float32) for v in (40, 0, 0)]
        return {s: [np.concatenate(pair) for pair in zip(stay, g, strict=True)] for s, g in gates.items()}

    def states(self, ids: np.ndarray, gates: dict[str, list[np.ndarray]], keep: dict | None = None) -> np.ndarray:
        """States of both layers at each word, (steps, windows, 2 * HIDDEN)."""
        steps, h = ids.shape[1], HIDDEN
        out = np.empty((steps, len(ids), 2 * h), np.float32)
        turned = np.ascontiguousarray(ids.T)
        for k, side in enumerate("fb"):
            uz, ur, un = (np.ascontiguousarray(u) for u in np.split(self.w["u" + side], 3, axis=1))
            gz, gr, gn = gates[side]
            state = np.zeros((len(ids), h), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                at = turned[t]
                z = logistic(np.add(x := gz.take(at, axis=0), state @ uz, out=x))
                r = logistic(np.add(x := gr.take(at, axis=0), state @ ur, out=x))
                hun = state @ un
                x = gn.take(at, axis=0)
                x += r * hun
                x += x
                n = logistic(x)
                n += n
                n -= 1
                new = state - n
                new *= z
                new += n
                if keep is not None:
                    keep[side, t] = (z, r, n, hun, state)
                state = out[t, :, k * h : k * h + h] = new
        return out

    def pool(self, ids: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = out @ self.w["attend"]
        score[ids.T == 0] = -1e9
        score -= score.max(axis=0)
        a = np.exp(score)
        a /= a.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", a, out)
        return a, pooled, pooled @ self.w["out"] + self.w["bias"][0]

    def logits(self, ids: np.ndarray, gates: dict[str, np.ndarray]) -> np.ndarray:
        """A logit for each window."""
        parts = [ids[i : i + AT_ONCE] for i in range(0, len(ids), AT_ONCE)]
        return np.concatenate([self.pool(p, self.states(p, gates))[2] for p in parts])

    def gradients(self, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray, gates: dict) -> tuple[dict, dict]:
        """Of the weighted logistic loss: by weight, and by step and window of each side's gates."""
        keep: dict = {}
        h, steps = HIDDEN, ids.shape[1]
        out = self.states(ids, gates, keep)
        a, pooled, logit = self.pool(ids, out)
        d = ((sigmoid(logit) - labels) * weights / weights.sum()).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dpool = d[:, None] * self.w["out"]
        along = np.einsum("tbh,bh->tb", out, dpool)
        dscore = a * (along - (a * along).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", dscore, out)
        dout = a[:, :, None] * dpool + dscore[:, :, None] * self.w["attend"]
        dgates = {}
        for k, side in enumerate("fb"):
            u = self.w["u" + side]
            du, carry = np.zeros_like(u), np.zeros((len(ids), h), np.float32)
            dx = np.empty((steps, len(ids), 3 * h), np.float32)
            for t in range(steps - 1, -1, -1) if side == "f" else range(steps):
                z, r, n, hun, before = keep[side, t]
                dh = dout[t, :, k * h : k * h + h] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (before - n) * z * (1 - z)
                dr = dn * hun * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dn], 1)
                dhu = np.concatenate([dz, dr, dn * r], 1)
                du += before.T @ dhu
                carry = dh * z + dhu @ u.T
            g["u" + side], dgates[side] = du, dx
        return g, dgates


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        size = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (x - m)
            v += 0.001 * (x * x - v)
            self.weights[k] -= size * m / (np.sqrt(v) + 1e-8)


class Trainer:
    """The sample's windows, and the fitting of a network to them."""

    def __init__(self, rows, seed: int = 1):
        self.rng = np.random.default_rng(seed)
        self.net = Network(seed)
        self.adam = Adam(self.net.w, 0.02)
        index: dict[str, int] = {}
        docs, owner = [], []
        for i, pieces in enumerate(rows["passages"]):
            for piece in pieces:
                ids = np.array([index.setdefault(w, len(index) + 1) for w in find_words(piece.lower())], np.int32)
                if len(ids):
                    docs.append(windows_of(ids))
                    owner += [i] * len(docs[-1])
        self.ids = np.concatenate(docs) if docs else np.zeros((0, WINDOW), np.int32)
        self.owner = np.array(owner, np.int64)
        words = list(index)
        self.words = word_buckets(words)
        self.chars, self.counts = char_buckets(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.starts = np.cumsum(self.counts) - self.counts

    def gates(self) -> dict[str, np.ndarray]:
        return self.net.padded(self.net.project(self.net.inputs(self.words, self.chars, self.counts)))

    def batch(self, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        net = self.net
        used, local = np.unique(ids, return_inverse=True)
        local = local.reshape(ids.shape)
        if used[0] != 0:
            used, local = np.r_[0, used], local + 1
        own = used[1:] - 1
        counts = self.counts[own]
        flat = np.repeat(self.starts[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        chars, words = self.chars[flat], self.words[own]
        x = net.inputs(words, chars, counts)
        g, dgates = net.gradients(local, labels, weights, net.padded(net.project(x)))
        dx = np.zeros_like(x)
        turned = local.T.ravel()
        order = np.argsort(turned, kind="stable")
        sizes = np.bincount(turned, minlength=len(own) + 1)
        for side in "fb":
            d = grouped_sums(dgates[side].reshape(len(order), -1)[order][sizes[0] :], sizes[1:])
            g["x" + side], g["c" + side] = x.T @ d, d.sum(axis=0)
            dx += d @ net.w["x" + side].T
        g["word"], g["char"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["char"])
        np.add.at(g["word"], words, dx)
        np.add.at(g["char"], chars, np.repeat(dx / counts[:, None].astype(np.float32), counts, axis=0))
        self.adam.step(g)

    def epoch(self, chosen: np.ndarray, labels: np.ndarray, size: int = 256) -> None:
        chosen = self.rng.permutation(chosen)
        y = labels[self.owner[chosen]].astype(np.float32)
        up = np.float32(min(8.0, max(1.0, (y == 0).sum() / max(1, (y == 1).sum()))) ** 0.5)
        for i in range(0, len(chosen), size):
            part = y[i : i + size]
            self.batch(self.ids[chosen[i : i + size]], part, np.where(part > 0, up, np.float32(1)))

    def highest(self, scores: np.ndarray, each: int) -> np.ndarray:
        """The ``each`` windows of every document that score highest."""
        order = np.lexsort((-scores, self.owner))
        owner = self.owner[order]
        first = np.r_[True, owner[1:] != owner[:-1]]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return order[rank < each]

    def fit(self, labels: np.ndarray, trained: np.ndarray, rounds: int = 5, least_steps: int = 160) -> None:
        mine = trained[self.owner]
        repeat = max(1, -(-least_steps * 256 // max(1, 4 * int(trained.sum()) * (rounds + 1))))
        for k in range(rounds + 1):
            scores = self.net.logits(self.ids, self.gates()) if k else self.rng.random(len(self.ids))
            top = self.highest(scores, 3 if k == 0 else 2)
            random = self.highest(self.rng.random(len(self.ids)), 2)
            random = random[labels[self.owner[random]] == 0] if k else random
            chosen = np.union1d(top, random)
            chosen = chosen[mine[chosen]]
            for _ in range(min(repeat, 12)):
                self.epoch(chosen, labels)


class Model:
    """A fitted network with its calibration, or a constant score."""

    def __init__(self, net: Network | None, scale: float, offset: float, prior: float):
        self.net, self.scale, self.offset, self.prior = net, scale, offset, prior

    def scorer(self):
        """A function from a list of texts to their scores; it remembers words."""
        if self.net is None:
            return lambda texts: np.full(len(texts), self.prior)
        logits = self.judge()

        def score(texts: list[str | None]) -> np.ndarray:
            best = logits(texts)
            return np.where(np.isfinite(best), sigmoid(self.scale * best + self.offset), 0.0)

        return score

    def judge(self):
        """A function from a list of texts to the largest logit of each one's windows (none: minus infinity)."""
        net = self.net
        index: dict[str, int] = {}
        rows = net.padded({s: [np.zeros((1023, HIDDEN), np.float32)] * 3 for s in "fb"})

        class Ids(dict):
            def __missing__(self, word):
                fresh.append(word)
                n = self[word] = len(self) + 1
                return n

        ids, fresh = Ids(), []

        def judged(texts: list[str | None]) -> np.ndarray:
            if len(ids) > REMEMBERED_WORDS:
                ids.clear()
            known = len(ids)
            spans = [windows_of(np.fromiter(map(ids.__getitem__, w), np.int32, len(w))) if (w := find_words((t or "").lower())) else None for t in texts]
            if fresh:
                gates = net.project(net.inputs_of(fresh))
                for s in "fb":
                    for k in range(3):
                        if len(rows[s][k]) < len(ids) + 1:
                            rows[s][k] = np.concatenate([rows[s][k], np.zeros((len(ids) + 1, HIDDEN), np.float32)])
                        rows[s][k][known + 1 : len(ids) + 1] = gates[s][k]
                fresh.clear()
            counts = np.array([0 if x is None else len(x) for x in spans])
            out = np.full(len(texts), -np.inf)
            if counts.sum():
                logits = net.logits(np.concatenate([x for x in spans if x is not None]), rows)
                has = counts > 0
                out[has] = np.maximum.reduceat(logits, (np.cumsum(counts) - counts)[has])
            return out

        return judged


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on a bounded sample of the labelled rows that are not held out."""
    wanted = labels.select(id_col, F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    rows, shares = balanced_sample(docs, wanted, TRAIN_DOCS, PASSAGES, PASSAGE_CHARS, id_col, text_col)
    y = rows["label"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    if len(np.unique(y)) < 2:
        return Model(None, 1.0, 0.0, shares)
    trainer = Trainer(rows)
    trained = np.arange(len(rows)) % 5 != 0
    trainer.fit(y, trained)
    kept = rows[~trained]
    if kept["label"].nunique() < 2:
        kept = rows
    model, kept = Model(trainer.net, 1.0, 0.0, shares), kept[[id_col, "label"]]
    # the driver works on from here, so what training took goes first
    del trainer, rows
    give_back_on_driver(docs.sparkSession)

    def of():
        judge = model.judge()
        return lambda text: (float(judge([text])[0]),)

    judged = map_texts(of_ids(docs, kept[id_col].tolist(), id_col, text_col), of, "logit double", id_col, text_col).toPandas()
    judged = kept.merge(judged, on=id_col)
    judged = judged[np.isfinite(judged["logit"])]
    model.scale, model.offset = platt(judged["logit"].to_numpy(), judged["label"].to_numpy(np.float64))
    # the sample holds more of the rarer label than the table
    model.offset += np.log(shares / (1 - shares)) - np.log(y.mean() / (1 - y.mean()))
    return model


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` for every whole text."""

    def work():
        score = model.scorer()

        def step(batch):
            scores = score(batch.column(1).to_pylist())
            return {id_col: batch.column(0), "held_out": batch.column(2), "score": scores, "predicted": (scores >= threshold).astype(np.int32)}

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    marked = docs.select(id_col, text_col, held_out(id_col).alias("__held"))
    return map_batches(marked, [id_col, text_col, "__held"], work, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the texts that score ``threshold`` or more."""
    at = docs.columns.index(text_col)
    small_batches(docs.sparkSession)

    def run(batches):
        score = model.scorer()
        for batch in batches:
            for piece in pieces(batch):
                yield piece.filter(score(piece.column(at).to_pylist()) < threshold)

    return docs.mapInArrow(run, docs.schema)
