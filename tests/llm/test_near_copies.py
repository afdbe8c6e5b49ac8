"""The pipeline's near-copy stage against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import corpus, empty, words
from tests.llm.test_copies import classes
from tidemark.llm import near_copies


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, min(len(w), 1)))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_drops_all_pairs_of_five_word_jaccard(spark):
    rnd = random.Random(4)
    line = " ".join(words(rnd, 12))
    extra = [f"{line} {' '.join(words(rnd, 20))}" for _ in range(30)]
    for n in (8, 30, 60, 200, 1200):
        base = words(rnd, n)
        for _ in range(8):
            w = list(base)
            for _ in range(rnd.randint(1, max(1, n // 60))):
                w[rnd.randrange(n)] = "changed"
            extra += [" ".join(w), " ".join(w[: n - rnd.randint(0, n // 5)])]
    df = corpus(spark, extra)
    sets = {r.doc_id: shingles(r.text) for r in df.collect()}
    ids = sorted(sets)
    part = classes([(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8], ids)
    want = sorted(r.doc_id for r in df.collect() if part[r.doc_id] == r.doc_id)
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == want and got.columns == df.columns
    assert corpus_pipeline.drop_near_copies(spark, empty(spark), "").count() == 0


def test_ids_that_repeat_and_ids_that_lack(spark):
    rnd = random.Random(12)
    a, b, c = (" ".join(words(rnd, 80)) for _ in range(3))
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (9, b, 4), (None, c, 5), (None, c, 6), (11, None, 7), (12, "", 8), (13, c, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int")
    assert sorted(r.place for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()) == [1, 5, 6, 7, 9]


def test_shingles_of_a_group_come_last_however_large_the_corpus(spark):
    """A passage that 25 of 50,000 documents share is no key of them, so they are not tried against one another."""
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.concat_ws("_", F.lit("u"), F.col("doc_id"), k)), " ")
    docs = spark.range(50_000).select(F.col("id").alias("doc_id")).withColumn("text", own)
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2003 == 0, F.concat(F.lit("p0 p1 p2 p3 p4 p5 p6 "), F.col("text"))).otherwise(F.col("text")))
    common = near_copies.common_shingles(docs, 5, "doc_id", "text")
    group = docs.where("doc_id % 2003 = 0")
    passage = set(near_copies.shingles("p0 p1 p2 p3 p4 p5 p6", 5).view(np.int64).tolist())
    rows = near_copies.described(group, common, 5, 0.8, "doc_id", "text").select("hs").collect()
    assert len(rows) == 25 and all(len(r.hs) == 3 and not passage & set(r.hs) for r in rows)


def test_family_below_the_threshold_is_not_tried_in_pairs(spark, monkeypatch):
    """Couples of copies with 300 words in common with all others, at 0.75: no key of two couples is in their own prefixes."""
    rnd = random.Random(8)
    base = words(rnd, 300)
    texts = []
    for k in range(30):
        text = " ".join(base + [f"own{k}x{i}" for i in range(50)])
        texts += [text, f"{text} end{k}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    assert jaccard(sets[0], sets[1]) >= 0.8 > jaccard(sets[0], sets[2]) > 0.74
    tried, ruled_out = [], near_copies.without_unlike

    def counted(pairs, *args):
        tried.append(pairs.count())
        return ruled_out(pairs, *args)

    monkeypatch.setattr(near_copies, "without_unlike", counted)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert got == list(range(0, 60, 2)) and tried[-1] == 0


def test_smaller_and_larger_sets_meet(spark):
    """A text and its first four fifths and a little more, among many that have the same beginning."""
    rnd = random.Random(9)
    base = words(rnd, 120)
    texts = [" ".join(base[:60] + [f"t{k}x{i}" for i in range(n)]) for k in range(12) for n in (160, 181, 205)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    ids = list(range(len(texts)))
    part = classes([(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8], ids)
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert got == sorted(x for x in ids if part[x] == x) and len(got) < len(ids)


def test_driver_gets_one_number_of_marks(spark, monkeypatch):
    """Marks are of the shingles in as many documents; of the three numbers of documents the driver gets one's bits."""
    texts = [f"a b c d e {'f' if k < 9 else k}" for k in range(40)]
    got, frame = [], type(spark.range(0))

    def sent(rows):
        for r in rows:
            got.append(sum(len(x) for x in r if isinstance(x, (bytes, bytearray))))
            yield r

    for name in ("collect", "toLocalIterator"):
        monkeypatch.setattr(frame, name, lambda self, *a, f=getattr(frame, name): list(sent(f(self, *a))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = near_copies.common_shingles(df, 5, "doc_id", "text")
    common = [t for t in ("a b c d e", "b c d e f")]
    bits = {int(near_copies.shingles(t, 5)[0] >> np.uint64(64 - near_copies.MARK_BITS)) for t in common}
    assert set(np.nonzero(np.unpackbits(marks, bitorder="little"))[0].tolist()) == bits
    assert max(got) == 1 << near_copies.MARK_BITS - near_copies.RANGE_BITS - 3
