"""Bounded samples of labelled documents, which models are fitted on."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hash_share, map_batches


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def passages(text: str, count: int, size: int) -> list[str]:
    """The whole text if ``count * size`` characters hold it, else as many pieces spread evenly over it."""
    if len(text) <= count * size:
        return [text]
    return [text[i : i + size] for i in np.linspace(0, len(text) - size, count).astype(int)]


def one_each(wanted: DataFrame, id_col: str) -> DataFrame:
    """One row for each id that a model may learn from: the smallest by the other columns."""
    rest = [c for c in wanted.columns if c != id_col]
    free = wanted.where(F.col(id_col).isNotNull() & ~held_out(id_col))
    return free.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("row")).select(id_col, *[F.col(f"row.{c}").alias(c) for c in rest])


def drawn(wanted: DataFrame, quotas: dict, id_col: str) -> pd.DataFrame:
    """Of each label about ``quotas[label] = (rows wanted, ids there)``, those of smallest hash, on the driver.

    Ids are chosen by their hash before rows are made one for each id, so tasks
    send little more than the sample, and an id that repeats without end is one row.
    """
    share = F.lit(0.0)
    for label, (most, there) in quotas.items():
        share = F.when(F.col("label") == label, min(1.0, 1.2 * (most + 50) / max(there, 1))).otherwise(share)
    rows = one_each(wanted.where(hash_share(id_col) < share), id_col)
    own = Window.partitionBy("label").orderBy(F.xxhash64(id_col), id_col)
    most = F.lit(0)
    for label, (n, _) in quotas.items():
        most = F.when(F.col("label") == label, n).otherwise(most)
    return rows.withColumn("__rank", F.row_number().over(own)).where(F.col("__rank") <= most).drop("__rank").toPandas()


#: Labels at most that a sample is drawn for, those of the most ids.
LABELS = 200


def stratified_sample(docs: DataFrame, wanted: DataFrame, bound: int, count: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> pd.DataFrame:
    """At most ``bound`` rows of ``wanted(id, label)``, as many of each label as there are up to an equal
    share, with at most ``count`` passages of ``size`` characters of each one's text, on the driver.

    So a rare label is learned too. Labels beyond the ``LABELS`` commonest are not drawn.
    """
    ids = F.approx_count_distinct(id_col).alias("n")
    counts = wanted.where(~held_out(id_col)).groupBy("label").agg(ids).orderBy(F.desc("n"), "label").limit(LABELS).collect()
    quotas = {r.label: (max(bound // len(counts), 1), r.n) for r in counts}
    chosen = drawn(wanted, quotas, id_col) if quotas else pd.DataFrame({id_col: [], "label": []})
    return with_passages(docs, chosen, count, size, id_col, text_col)


def balanced_sample(docs: DataFrame, wanted: DataFrame, bound: int, count: int, size: int, id_col: str = "doc_id", text_col: str = "text", of_texts=None) -> tuple[pd.DataFrame, float]:
    """At most ``bound`` rows of ``wanted(id, label, ...)``, labels 0 and 1, up to a third of them with
    label 1, in hash order. Also the share of label 1 among all ids that may be learned from.

    The bounds hold at any size of ``docs``; rows of equal id come once. ``of_texts``,
    (function of a text to a tuple, its schema), takes the place of the passages: it
    sees whole texts, in Spark tasks.
    """
    counts = wanted.where(~held_out(id_col)).groupBy("label").agg(F.approx_count_distinct(id_col).alias("n")).collect()
    there = {r.label: r.n for r in counts}
    quotas = {k: (m, there[k]) for k, m in ((1, bound // 3), (0, bound - bound // 3)) if k in there}
    n = sum(there.values())
    rows = drawn(wanted, quotas, id_col)
    return with_passages(docs, rows, count, size, id_col, text_col, of_texts), float(there.get(1, 0) / n) if n else 0.0


def of_ids(docs: DataFrame, ids: list, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` of the given ids (a bounded list); of rows that repeat an id the smallest text counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([(x,) for x in ids], f"`{id_col}` {kind}")
    # as many ids as the sample's bound
    found = docs.select(id_col, text_col).join(F.broadcast(wanted), id_col, "left_semi")
    return found.groupBy(id_col).agg(F.min(text_col).alias(text_col))


def map_texts(texts: DataFrame, of, schema: str, id_col: str, text_col: str) -> DataFrame:
    """``(id, ...)``: what ``of()(text)``, a tuple, gives for each whole text."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work():
        one = of()

        def step(batch):
            found = [one(t or "") for t in batch.column(1).to_pylist()]
            return {id_col: batch.column(0), **{c: [x[k] for x in found] for k, c in enumerate(names)}}

        return step

    kind = texts.schema[id_col].dataType.simpleString()
    return map_batches(texts, [id_col, text_col], work, f"`{id_col}` {kind}, {schema}")


def with_passages(docs: DataFrame, chosen: pd.DataFrame, count: int, size: int, id_col: str, text_col: str, of_texts=None) -> pd.DataFrame:
    of, schema = of_texts or (lambda t: (passages(t, count, size),), "passages array<string>")
    texts = of_ids(docs, chosen[id_col].tolist(), id_col, text_col)
    rows = chosen.merge(map_texts(texts, lambda: of, schema, id_col, text_col).toPandas(), on=id_col)
    order = [zlib.crc32(str(x).encode()) for x in rows[id_col]]
    return rows.iloc[np.argsort(order, kind="stable")].reset_index(drop=True)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def platt(logits: np.ndarray, labels: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Scale and offset by which sigmoid(scale * logit + offset) fits the labels (damped Newton steps, lightly regularised)."""
    if not len(logits):
        return 1.0, 0.0
    x = np.stack([logits, np.ones_like(logits)], 1).astype(np.float64)

    def loss(w):
        s = x @ w
        return np.logaddexp(0, s).sum() - (labels * s).sum() + 0.05 * w @ w

    w = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (p - labels) + 0.1 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])
