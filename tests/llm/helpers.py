"""Small corpora with nulls, empty and long texts, copies, repeated rows and columns of clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, label int, key string, copy string"


def words(rnd, n, vocabulary=4000):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus(spark, extra=(), n=60, seed=1):
    """``n`` random texts, then an empty, a null, a blank and a long one, copies, and ``extra`` texts."""
    rnd = random.Random(seed)
    texts = [" ".join(words(rnd, rnd.randint(1, 120))) for _ in range(n)]
    texts += ["", None, " \n\t", " ".join(words(rnd, 4000)), texts[3], texts[3], texts[5] + " more", *extra]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x", 1, "k", "c") for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
