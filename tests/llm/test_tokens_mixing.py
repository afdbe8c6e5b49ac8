import hashlib
import math
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import corpus, empty
from tidemark.llm import mixing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["<|endoftext|> a <|endoftext|>b", " \n\n x  y ", "x" * 3000, "日本語 'tis don't I'LL 👍🏽 ½", "a\n b \n c", "  two", "tab\tand  more ", " nb　sp"]


def test_counts_are_the_librarys(spark):
    t = Tokenizer.from_file(PATH)
    df = corpus(spark, ODD)
    got = tokens.count_tokens(df, PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == df.count()
    by_id = {r.doc_id: r for r in got.collect()}
    for r in df.collect():
        text = r.text or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        assert (by_id[r.doc_id].n_bytes, by_id[r.doc_id].n_tokens, by_id[r.doc_id].over_limit) == (len(text.encode()), n, n > 512)
    assert tokens.count_tokens(empty(spark), PATH).count() == 0


def test_counts_of_random_texts():
    t, count = Tokenizer.from_file(PATH), tokens.text_counter(tokens.Merges(PATH), remembered=50)
    rnd = random.Random(4)
    alphabet = "abcdeé ß'\n\t .,12345日 S  "
    for _ in range(400):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
        assert count(text) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2**52


def poisson(rate, seed, key):
    parts = max(1, math.ceil(rate / mixing.LARGEST_MEAN))
    total = 0
    for j in range(1, parts + 1):
        u, n, p = uniform(seed, key, j), 0, math.exp(-rate / parts)
        c = p
        while c <= u and n < 1000:
            n += 1
            p *= rate / parts / n
            c += p
        total += n
    return total


def test_mixing_is_the_poisson_draw(spark):
    df = corpus(spark).where("doc_id <> 7")
    targets = {"s0": 8.0, "s1": 1.0, "nowhere": 5.0}
    got = mixing.mix_sources(df, targets, scale=3.0, unit="docs")
    mass = Counter(r.source for r in df.collect())
    named = {s: w for s, w in targets.items() if s in mass}
    want = Counter()
    for r in df.collect():
        if r.source in named:
            rate = named[r.source] / sum(named.values()) * sum(mass[s] for s in named) * 3.0 / mass[r.source]
            want[r.doc_id] += poisson(rate, "mix", r.doc_id)
    assert Counter(r.doc_id for r in got.collect()) == +want
    assert [c for c in got.columns if c not in ("copy", "shuffle_key")] == [c for c in df.columns if c != "copy"]


def test_mixing_large_means_null_sources_and_empty(spark):
    df = spark.createDataFrame([(i, "abcd", None if i < 5 else "b") for i in range(50)], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, scale=130.0, alpha=1.0)
    assert got.count() == pytest.approx(50 * 130, rel=0.1)
    assert got.where("source is null").count() == pytest.approx(5 * 130, rel=0.2)
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_rows_without_id_spread_by_their_texts(spark):
    df = spark.createDataFrame([(None, f"text {i}", "a") for i in range(200)] + [(None, None, "a")], "doc_id long, text string, source string")
    got = mixing.mix_sources(df, scale=3.0, alpha=1.0).collect()
    assert len({r.shuffle_key for r in got}) == len(got) and 450 < len(got) < 750
    assert len({r.text for r in got}) > 150
