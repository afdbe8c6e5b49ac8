"""Cross-tokenizer alignment, exact shards and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import public_tokenizers
import pytest

from tests.llm.helpers import corpus, empty
from tidemark.llm import alignment, prefixes, sharding
from tidemark.llm.common import materialize
from tidemark.llm.queries import op11_alignment, op12_sharding, op13_prefixes

A, B = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# --- alignment


def encode_plainly(texts):
    """Identifiers and bytes of tokens, by the libraries over whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    out = []
    for text in texts:
        if not text:
            out.append(([], [], [], []))
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_x = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in x]
        of_y = [bytes([int(t[3:5], 16)]) if b.is_byte(i) else t.replace("▁", " ").encode() for i, t in ((i, b.id_to_piece(i)) for i in y)]
        same = b"".join(of_x) == b"".join(of_y) == (" " + text).encode()
        out.append((x, y, of_x, of_y) if same else ([], [], [], []))
    return out


def align_plainly(texts):
    """(n_a, n_b, groups, links) of each text, by walking its bytes."""
    out = []
    for x, y, of_x, of_y in encode_plainly(texts):
        owner = [[i for i, t in enumerate(tokens) for _ in t] for tokens in (of_x, of_y)]
        links = [(x[i], y[j]) for i, j in sorted(set(zip(*owner, strict=True)))]
        ends = [set(np.cumsum([len(t) for t in tokens]).tolist()) for tokens in (of_x, of_y)]
        groups, start = [], 0
        for end in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[i]) for i in sorted(set(o[start:end]))) for ids, o in zip((x, y), owner, strict=True)))
            start = end
        out.append((len(x), len(y), groups, links))
    return out


TEXTS = [
    "plain words, some of them uncommonly lengthy", " leading and  double   spaces ", "tabs\tand\n\nlines \n mixed \r\n", "<|endoftext|> <s> </s>",
    "é ü 漢字 и кириллица 😀😀  nbsp", "ﬁ ligature ① Å Å", "▁ under bars ▁▁", "x" * 3000, "\x00\x07 control", "don't we'll  'S", "12345 67890 3.14",
    " ", "\n", "a", "　wide space", "word " * 2000, "é combining", "\x1c\x1d x \x85 y", "tail\n",
]


def plain_scores(texts):
    found = align_plainly(texts)
    counts = Counter(pair for *_, links in found for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [
        (n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), ";".join(groups))
        for n_a, n_b, groups, links in found
    ]


@pytest.mark.parametrize("block_bytes", [1, 1 << 30])
def test_alignment_is_that_of_a_walk_over_bytes(spark, block_bytes):
    docs = corpus(spark, extra=TEXTS).repartition(3)
    found = materialize(alignment.align(docs, A, B, block_bytes=block_bytes))
    rows = alignment.score_links(found, carried=("groups",)).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    expected = sorted((i, *x) for (i, _), x in zip(texts, plain_scores([t for _, t in texts]), strict=True))
    assert sorted((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows) == expected
    assert any(x[1] for x in expected) and any(not x[1] for x in expected)


def test_alignment_of_nothing_and_without_ids(spark):
    found = materialize(alignment.align(empty(spark), A, B))
    assert alignment.score_links(found).count() == 0
    docs = spark.createDataFrame([(None, "same words"), (None, "same words"), (1, None)], "doc_id long, text string")
    rows = alignment.score_links(materialize(alignment.align(docs, A, B))).collect()
    assert sorted((r.id or 0, r.n_links, r.n_best, r.count_sum) for r in rows) == [(0, 2, 2, 4), (0, 2, 2, 4), (1, 0, 0, 0)]


def test_galloping_is_a_search(spark):
    rnd = np.random.default_rng(0)
    for n, m in [(1, 1), (5, 3), (400, 20_000), (20_000, 400), (9000, 9000)]:
        keys, into = (np.sort(rnd.choice(10 * (n + m), k, replace=False)) for k in (n, m))
        assert (alignment.gallop(keys, into) == np.searchsorted(into, keys)).all()


def test_remembered_pieces_start_anew(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    with open(B, "rb") as f:
        vocabularies = alignment.Vocabularies(open(A, encoding="utf-8").read(), f.read())
    encode = alignment.Encoder(vocabularies)
    for text, (x, y, *_) in zip(TEXTS, encode_plainly(TEXTS), strict=True):
        ids, many = encode([text])
        assert [i.tolist() for i in ids] == [x, y] and [m.tolist() for m in many] == [[len(x)], [len(y)]]


def test_alignment_query(spark):
    found = op11_alignment(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    expected = sorted(
        (d.doc_id, *x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "")
        for d, x in zip(docs, plain_scores([d.text for d in docs]), strict=True)
    )
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r) for r in found.select(columns).collect()) == expected


# --- shards


def assert_exact(rows, n_shards):
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    sizes = [len(by_shard[i]) for i in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())


def test_shards_have_exact_sizes_and_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 3)
    docs = corpus(spark).union(spark.createDataFrame([(None, None, None, None, None, None, None, None, None)] * 40, corpus(spark).schema))
    rows = sharding.shuffle_into_shards(docs.repartition(5), 7).collect()
    assert_exact(rows, 7)
    crc = lambda t: None if t is None else zlib.crc32(t.encode())
    expected = Counter((d.doc_id, len((d.text or "").encode()) + 16, crc(d.text)) for d in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    assert_exact(sharding.shuffle_into_shards(docs.limit(3), 7).collect(), 7)
    assert sharding.shuffle_into_shards(empty(spark), 7).count() == 0


def test_shards_are_the_same_again(spark):
    docs = corpus(spark).dropDuplicates(["doc_id"]).repartition(4, "doc_id")
    first, second = (set(map(tuple, sharding.shuffle_into_shards(docs, 5).collect())) for _ in range(2))
    assert first == second
    assert first != set(map(tuple, sharding.shuffle_into_shards(docs, 5, seed="other").collect()))


def test_draws_follow_the_hypergeometric_distribution():
    for drawn, marked, total in [(3, 4, 9), (5, 5, 6), (10, 1, 30), (20, 20, 40), (0, 3, 5), (5, 5, 5)]:
        pmf = [comb(marked, k) * comb(total - marked, drawn - k) / comb(total, drawn) if 0 <= drawn - k <= total - marked else 0 for k in range(marked + 1)]
        cdf = np.cumsum(pmf)
        for u in np.linspace(0, 0.9999, 97):
            if np.abs(cdf - u).min() > 1e-9:
                assert sharding.hypergeometric(drawn, marked, total, u) == np.searchsorted(cdf, u, side="right")
    total, marked, drawn = 50_000_000_000, 1_250_000_000, 25_000_000_000
    deviation = (drawn * marked / total * (1 - marked / total) * (total - drawn) / total) ** 0.5
    middle = sharding.hypergeometric(drawn, marked, total, 0.5)
    assert abs(middle - 625_000_000) < 2
    assert abs(sharding.hypergeometric(drawn, marked, total, 0.8413447) - middle - deviation) < 0.001 * deviation


def test_matrix_has_the_sums_asked_for_and_their_distribution():
    counts, sizes = [3, 0, 5, 2], [4, 3, 3]
    before, seen = np.concatenate([[0], np.cumsum(counts)]), Counter()
    for seed in range(3000):
        matrix = [sharding.matrix_row(i, before, sizes, str(seed)) for i in range(4)]
        assert [sum(r) for r in matrix] == counts and np.sum(matrix, axis=0).tolist() == sizes
        seen[tuple(matrix[0])] += 1
    for row, n in seen.items():
        share = np.prod([comb(s, k) for s, k in zip(sizes, row, strict=True)]) / comb(10, 3)
        assert abs(n - 3000 * share) < 5 * (3000 * share) ** 0.5 + 5


def test_every_row_is_as_likely_in_every_slot(spark):
    docs = spark.createDataFrame([(i, str(i)) for i in range(6)], "doc_id long, text string").repartition(2, "doc_id")
    seen = Counter()
    for seed in range(60):
        rows = sharding.shuffle_into_shards(docs, 3, seed=str(seed)).collect()
        seen.update((r.doc_id, r.shard, r.slot) for r in rows)
    assert len(seen) == 36 and sum((n - 10) ** 2 / 10 for n in seen.values()) < 60  # 25 degrees of freedom: p is 1e-4


def test_shards_written_keep_their_order(spark, tmp_path):
    docs = corpus(spark).dropDuplicates(["doc_id"]).repartition(3, "doc_id")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    expected = sharding.shuffle_into_shards(docs, 4).collect()
    for shard in range(4):
        files = sorted((tmp_path / "out" / f"shard={shard}").glob("*.parquet"))
        slots = [r.slot for f in files for r in spark.read.parquet(str(f)).select("slot").collect()]
        assert slots == list(range(sum(r.shard == shard for r in expected)))


def test_sharding_query(spark):
    rows = op12_sharding(spark, "/root/testdata/sf0.001").collect()
    assert_exact(rows, 40)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)} and len(rows) == 200


# --- trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, k0 string"


def trie_plainly(rows, group=20, most=4):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            digest = hashlib.sha256((text or "").encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, role or "", digest, text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in turns.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        rebuilt[c] = turns.get(c - int(np.fmod(c, group)), [])[:h] + own[h:]
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p))))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest())
        for p, m in members.items()
    )


def trie_of(spark, rows, **options):
    table = spark.createDataFrame(rows, CONVERSATIONS).repartition(3)
    rebuilt, convs = prefixes.shared_openings(materialize(prefixes.turns(table)))
    found = prefixes.prefix_trie(rebuilt, convs, **options).fillna(-1).collect()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)


def conversations(seed, n=70, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-40, 120), n):
        for t in range(rnd.randint(1, longest)):
            text = rnd.choice(["", None, "one two", "three", " \t", "a b c d"])
            rows.append((c, rnd.choice([t, None, 3]), rnd.choice(["user", None, "x"]), text, 1, "k"))
    return rows + [rows[0], rows[0], (None, 1, "user", "lost", 1, "k")]


@pytest.mark.parametrize("band", [2, 3, 8])
def test_trie_is_that_of_plain_prefixes(spark, band):
    rows = conversations(band)
    assert trie_of(spark, rows, band=band) == trie_plainly(rows)


def test_long_and_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "CHUNK", 5)
    monkeypatch.setattr(prefixes, "ENDS_BYTES", 10)
    rows = [(3, t, "user", f"turn {t}", 1, "k") for t in range(60)]
    rows += [(c, t, "user", f"same {t}", 1, "k") for c in range(100, 140) for t in range(3)]
    assert trie_of(spark, rows, band=2) == trie_plainly(rows)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "lost", 1, "k")]) == []


def test_prefix_query(spark):
    found = op13_prefixes(spark, "/root/testdata/sf0.001").fillna(-1).collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in found) == trie_plainly(rows)
