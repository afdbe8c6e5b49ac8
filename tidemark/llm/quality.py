"""Quality classification by co-training two views of a document.

The text view sees hashed words, the hashed shapes of words and a few ratios of
the whole text; the metadata view sees hashed source, language and size. Each is
a logistic regression trained in numpy. They start from the labelled sample; in
every round both views score all unlabelled documents in Spark, and of the
``CONFIDENT`` share that a view is most sure of, at either end, a hashed sample
of up to ``HANDED`` documents joins the other view's training set with that
label. Both are then calibrated on labelled documents that neither was trained
on, and the calibrated logits, weighted by a last logistic fit, give the score.

Fitting uses a bounded sample of ``LABELLED`` labelled documents; Spark tasks
make feature vectors from whole texts, which is all that the driver sees; rows
held out by id are never learned from. Scoring covers every whole text. Defined
results: null and empty texts have the features of an empty text; nulls in the
metadata are values of their own; without labels of both kinds the score is the
share of label 1 (1 without labels); rows that repeat, or have no id, are each
scored, and an id that repeats is learned from once; an empty table gives an
empty result. Only the named columns are read; metadata columns that the table
lacks count as null.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, hash_share, map_batches, materialize
from tidemark.llm.sampling import balanced_sample, held_out, one_each, platt, sigmoid, with_passages

#: Bound of the labelled sample that the views are fitted on.
LABELLED = 3000
BUCKETS = 1 << 16
#: Rounds; share of the unlabelled documents that a view is confident of, of each label; how many of them it hands over.
ROUNDS, CONFIDENT, HANDED = 2, 0.02, 150
REMEMBERED_WORDS = 400_000
METADATA = ("source", "lang", "n_chars")

letters = re.compile(r"[^\W\d_]+").sub
digits = re.compile(r"\d+").sub


def word_features(word: str) -> tuple[int, int]:
    """Buckets of the word and of its shape."""
    shape = digits("0", letters("a", word))
    return zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(b"shape " + shape.encode()) % BUCKETS


def text_ratios(text: str, words: list[str]) -> np.ndarray:
    n, chars = max(len(words), 1), max(len(text), 1)
    lines = text.split("\n")
    return np.array([
        np.log1p(len(words)) / 10,
        min(chars / n, 40) / 20,
        1 - len(set(lines)) / len(lines),
        len(set(words)) / n,
        (text.count(".") + text.count(",")) / n,
        text.count("|") / n,
        1.0,
    ])


def metadata_features(source, lang, size) -> tuple[int, ...]:
    band = "null" if size is None or size != size else str(int(np.log2(max(float(size), 0) + 1) * 2))
    parts = (f"source {source}", f"lang {lang}", f"size {band}", f"lang {lang} size {band}")
    return tuple(zlib.crc32(p.encode()) % BUCKETS for p in parts)


class View:
    """Logistic regression over the mean of hashed features and dense ratios."""

    def __init__(self, dense: int):
        self.w, self.d = np.zeros(BUCKETS), np.zeros(dense)

    def fit(self, flat: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray, y: np.ndarray, seed: int, epochs: int = 12, size: int = 64) -> View:
        rng = np.random.default_rng(seed)
        sw, sd = np.full(BUCKETS, 1e-3), np.full(len(self.d), 1e-3)
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(order), size):
                part = order[i : i + size]
                ids, scale = (np.concatenate([flat[k][x] for k in part]) for x in range(2))
                owner = np.repeat(np.arange(len(part)), [len(flat[k][0]) for k in part])
                z = np.bincount(owner, self.w[ids] * scale, len(part)) + dense[part] @ self.d
                e = (sigmoid(z) - y[part]) * weight[part]
                g = np.bincount(ids, e[owner] * scale, BUCKETS) + 1e-6 * self.w
                sw += g * g
                self.w -= 1.0 * g / np.sqrt(sw)
                gd = e @ dense[part] / len(part)
                sd += gd * gd
                self.d -= 0.2 * gd / np.sqrt(sd)
        return self

    def logits(self, flat: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray) -> np.ndarray:
        return np.array([self.w[ids] @ shares for ids, shares in flat]) + dense @ self.d


def text_features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, their counts, and ratios of a whole text."""
    words = text.split()
    ids, counts = np.unique(np.array([b for w in words for b in word_features(w)], np.int32), return_counts=True)
    return ids, counts.astype(np.int32), text_ratios(text, words)


OF_TEXTS = text_features, "ids array<int>, counts array<int>, ratios array<double>"


def features(rows: pd.DataFrame) -> tuple[list, np.ndarray, list, np.ndarray]:
    """Of rows with the columns of ``OF_TEXTS``: (buckets, shares) and ratios of the text, and of the metadata."""
    flat = [(np.asarray(i, np.int64), np.asarray(c, float) / max(np.sum(c), 1)) for i, c in zip(rows["ids"], rows["counts"], strict=True)]
    dense = np.array([np.asarray(r, float) for r in rows["ratios"]]).reshape(len(rows), 7)
    meta = [np.array(metadata_features(*r)) for r in rows[list(METADATA)].itertuples(index=False)]
    return flat, dense, [(m, np.full(len(m), 1 / len(m))) for m in meta], np.ones((len(rows), 1))


class Model:
    """Two views with their calibration and weights, or a constant score."""

    def __init__(self, prior: float, text: View | None = None, meta: View | None = None, scales=None, blend=None):
        self.prior, self.text, self.meta, self.scales, self.blend = prior, text, meta, scales, blend

    def combined(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the text view, of the metadata view, and of both."""
        (a, b), (c, d) = self.scales
        t, m = a * text + b, c * meta + d
        return sigmoid(t), sigmoid(m), sigmoid(self.blend[0] * t + self.blend[1] * m + self.blend[2])


class Unlabelled:
    """The documents that may be learned from and have no label."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str):
        facts = with_metadata(docs, id_col, text_col)
        self.docs, self.free = docs, facts.where(F.col(id_col).isNotNull() & ~held_out(id_col))
        self.labels, self.id_col, self.text_col = labels, id_col, text_col

    def confident(self, text: View, meta: View) -> list[dict[int, pd.DataFrame]]:
        """For each view, by label, the documents (with features) that it hands over."""
        id_col = self.id_col
        kind = self.free.schema[id_col].dataType.simpleString()
        extra = ", ".join(f"{c} {self.free.schema[c].dataType.simpleString()}" for c in METADATA)

        def work():
            judge = judged(text, meta)

            def step(batch):
                t, m = judge(batch.column(1).to_pylist(), [batch.column(k).to_pylist() for k in (2, 3, 4)])
                return {id_col: batch.column(0), **{c: batch.column(2 + k) for k, c in enumerate(METADATA)}, "t": t, "m": m}

            return step

        scored = map_batches(self.free, [id_col, self.text_col, *METADATA], work, f"`{id_col}` {kind}, {extra}, t double, m double")
        scored = materialize(scored)
        unlabelled = materialize(scored.join(self.labels.select(id_col), id_col, "left_anti"))
        n, *ends = unlabelled.agg(F.count("*"), *[F.percentile_approx(v, [CONFIDENT, 1 - CONFIDENT], 10000) for v in "tm"]).first()
        out = []
        for v, edge in zip("tm", ends, strict=True):
            out.append({})
            if not n or edge[0] == edge[1]:
                continue
            for label, sure in ((0, F.col(v) <= edge[0]), (1, F.col(v) >= edge[1])):
                rows = unlabelled.where(sure)
                share = HANDED / max(rows.agg(F.approx_count_distinct(id_col)).first()[0], 1)
                rows = one_each(rows.where(hash_share(id_col) < share).select(id_col, *METADATA), id_col).toPandas()
                out[-1][label] = with_passages(self.docs, rows, 0, 0, id_col, self.text_col, OF_TEXTS)
        discard(scored, unlabelled)
        return out


def co_train(labelled: pd.DataFrame, unlabelled: Unlabelled, prior: float) -> Model:
    n = len(labelled)
    flat, dense, meta, ones = features(labelled)
    y = labelled["label"].to_numpy(float)
    kept = np.arange(n) % 4 == 0
    start, at = np.nonzero(~kept)[0], np.nonzero(kept)[0]
    if len(np.unique(y[start])) < 2 or len(np.unique(y[at])) < 2:
        return Model(prior)
    # what each view learns from: sparse and dense features, labels
    sides = [
        [[f[i] for i in start], d[start], y[start]] for f, d in ((flat, dense), (meta, ones))
    ]
    known = [set(), set()]

    def fitted(round_: int) -> list[View]:
        return [View(d.shape[1]).fit(f, d, label, seed=round_) for f, d, label in sides]

    for r in range(ROUNDS):
        for k, by_label in enumerate(unlabelled.confident(*fitted(r))):
            other = 1 - k
            for label, rows in by_label.items():
                rows = rows[~rows[unlabelled.id_col].isin(known[other])].reset_index(drop=True)
                if len(rows):
                    known[other] |= set(rows[unlabelled.id_col])
                    parts = features(rows)
                    f, d = parts[2 * other], parts[2 * other + 1]
                    side = sides[other]
                    side[0], side[1], side[2] = side[0] + f, np.concatenate([side[1], d]), np.r_[side[2], np.full(len(rows), float(label))]
    views = fitted(ROUNDS)
    logits = [v.logits([f[i] for i in at], d[at]) for v, (f, d) in zip(views, ((flat, dense), (meta, ones)), strict=True)]
    # the sample holds more of the rarer label than the table
    shift = np.log(prior / (1 - prior)) - np.log(y.mean() / (1 - y.mean()))
    scales = [(a, b + shift) for a, b in (platt(x, y[at]) for x in logits)]
    model = Model(prior, *views, scales, (1.0, 0.0, 0.0))
    t, m = (s * x + o for (s, o), x in zip(scales, logits, strict=True))
    model.blend = blended(np.stack([t, m - np.log(prior / (1 - prior))], 1), y[at], shift)
    model.blend = (*model.blend[:2], model.blend[2] - model.blend[1] * np.log(prior / (1 - prior)))
    return model


def blended(x: np.ndarray, y: np.ndarray, shift: float, steps: int = 300) -> tuple[float, float, float]:
    """Weights of the two calibrated logits, not below zero, and an offset."""
    w = np.array([1.0, 1.0, 0.0])
    full = np.concatenate([x, np.ones((len(x), 1))], 1)
    for _ in range(steps):
        w -= 0.5 * (full.T @ (sigmoid(full @ w - shift) - y) / len(y) + 1e-3 * (w - [1, 1, 0]))
        w[:2] = np.maximum(w[:2], 0)
    return float(w[0]), float(w[1]), float(w[2])


def with_metadata(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    lacking = [F.lit(None).cast("string").alias(c) for c in METADATA if c not in docs.columns]
    return docs.select(id_col, text_col, *[c for c in METADATA if c in docs.columns], *lacking)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Co-train on a bounded sample of labelled documents and all unlabelled ones."""
    wanted = labels.select(id_col, F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    facts = with_metadata(docs, id_col, text_col).drop(text_col)
    # ids of labelled rows that exist as documents, with their metadata
    labelled, prior = balanced_sample(docs, wanted.join(facts, id_col), LABELLED, 0, 0, id_col, text_col, OF_TEXTS)
    if not len(labelled) or labelled["label"].nunique() < 2:
        return Model(prior if len(labelled) else 1.0)
    return co_train(labelled, Unlabelled(docs, wanted, id_col, text_col), prior)


class WordWeights(dict):
    """Sum of a word's two feature weights."""

    def __init__(self, w: np.ndarray):
        super().__init__()
        self.w = w

    def __missing__(self, word: str) -> float:
        a, b = word_features(word)
        x = self[word] = float(self.w[a] + self.w[b])
        return x


def judged(text: View, meta: View):
    """A function from texts and columns of metadata to the logits of both views; it remembers words."""
    known = WordWeights(text.w)

    def text_logit(content: str) -> float:
        words = content.split()
        total = sum(map(known.__getitem__, words)) / (2 * len(words)) if words else 0.0
        return total + text_ratios(content, words) @ text.d

    def judge(texts: list[str | None], facts: list[list]) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        metas = [meta.w[list(metadata_features(*f))].mean() + meta.d[0] for f in zip(*facts, strict=True)]
        return np.array([text_logit(t or "") for t in texts]), np.array(metas)

    return judge


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, text_score, metadata_score, score, kept)`` for every whole text."""

    def work():
        judge = judged(model.text, model.meta) if model.text else None

        def step(batch):
            if judge is None:
                text = meta = score = np.full(batch.num_rows, model.prior)
            else:
                text, meta, score = model.combined(*judge(batch.column(1).to_pylist(), [batch.column(k).to_pylist() for k in (2, 3, 4)]))
            return {
                id_col: batch.column(0),
                "held_out": batch.column(5),
                "text_score": text,
                "metadata_score": meta,
                "score": score,
                "kept": np.asarray(score) >= threshold,
            }

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    marked = with_metadata(docs, id_col, text_col).select(id_col, text_col, *METADATA, held_out(id_col).alias("__held"))
    schema = f"`{id_col}` {kind}, held_out boolean, text_score double, metadata_score double, score double, kept boolean"
    return map_batches(marked, marked.columns, work, schema)
