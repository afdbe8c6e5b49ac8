import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import corpus, empty, words
from tidemark.llm import components, embeddings, simhash, suffixes


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rnd = random.Random(8)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = components.connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    proper = [p for p in pairs if None not in p and p[0] != p[1]]
    want = classes(proper, {x for p in proper for x in p})
    assert {r.node: r.component for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    rnd = random.Random(3)
    for n in (0, 1, 3, 4, 5, 300, 700):
        text = " ".join(words(rnd, n))
        assert simhash.fingerprint(text, 4) == slow_fingerprint(text)
    assert simhash.fingerprint("A b É\x0bX y", 4) == slow_fingerprint("a b É\x0bx Y")


def test_near_copies_against_all_pairs(spark):
    rnd = random.Random(6)
    base = words(rnd, 400)
    near = []
    for i in range(6):
        w = list(base)
        w[i * 9] = "changed"
        near.append(" ".join(w))
    df = corpus(spark, near)
    got = simhash.near_duplicates(df)
    assert got.count() == df.count()
    fps = {r.doc_id: slow_fingerprint(r.text) for r in df.collect()}
    ids = sorted(fps)
    want = classes([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], ids)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
    kept = simhash.first_of_each(df)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id != 7) == sorted(i for i in ids if want[i] == i and i != 7) and kept.columns == df.columns
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_vantage_search_finds_every_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 64, 300, np.uint64)
    fps = set(centres.tolist())
    for c in centres[:120].tolist():
        x = c
        for bit in rng.choice(64, 4, replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    for _ in range(400):  # a dense ball
        x = int(centres[0])
        for bit in rng.choice(64, rng.integers(1, 9), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    place = {fp: i for i, fp in enumerate(signed)}
    monkeypatch.setattr(simhash, "SAMPLED_LEVELS", 3)  # the tree goes on below what is sampled
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = classes([(place[r.src], place[r.dst]) for r in simhash.links(points, leaf=16).collect()], range(len(fps)))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert got == classes(pairs, range(len(fps)))


def test_ids_that_repeat_and_ids_that_lack(spark):
    rnd = random.Random(12)
    a, b, c = (" ".join(words(rnd, 80)) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (9, b), (None, c), (None, b), (11, None), (None, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3), (5, 3), (5, 3), (9, 3), (None, None), (None, 3), (11, 11), (None, 11), (12, 11)], key=str)


def comparisons(n, leaf=1 << 9, outright=1 << 12):
    """Pairs of ``n`` random fingerprints that one block's tree leaves to compare, over 24 of its leaves."""
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 1 << 64, n, np.uint64)
    mask = simhash.block_masks(3)[0]
    tree = simhash.BlockTree(mask, 1, max(0, int(np.ceil(np.log2(n / leaf)))), fps[:4096], 0)
    row, node, home = tree.leaves(fps)
    order = np.argsort(node, kind="stable")
    ends = np.nonzero(np.diff(node[order]))[0] + 1
    groups = np.split(order, ends)
    tried = homes = 0
    for g in groups[:: max(1, len(groups) // 24)]:
        todo = [(fps[row[g]][home[g]], fps[row[g]])]
        homes += home[g].sum()
        while todo:
            h, m = todo.pop()
            if len(h) and len(h) * len(m) > outright:
                dh, dm = (np.bitwise_count((x ^ h[len(h) // 2]) & np.uint64(mask)).astype(int) for x in (h, m))
                t = simhash.balanced(dh, 64)
                if 0 < (dh <= t).sum() < len(h):
                    todo += [(h[dh <= t], m[dm <= t + 1]), (h[dh > t], m[dm > t - 1])]
                    continue
            tried += len(h) * len(m)
    return tried / homes * n


def test_comparisons_grow_slower_than_pairs():
    small, large = comparisons(1 << 14), comparisons(1 << 18)
    assert np.log(large / small) / np.log(16) < 1.5


def covered(rows):
    """Words in a run of 50 that stands at a smaller (id, position)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = (text or "").split()
        for k in range(len(w) - suffixes.MIN_WORDS + 1):
            run = tuple(w[k : k + suffixes.MIN_WORDS])
            if run in seen:
                out.setdefault(i, set()).update(range(k, k + suffixes.MIN_WORDS))
            seen.add(run)
    return out


def test_repeats_against_all_runs(spark):
    rnd = random.Random(9)
    passage, circle = words(rnd, 70), ["round", "and"] * 90
    extra = [" ".join(words(rnd, rnd.randint(0, 60)) + passage[rnd.randint(0, 15) : 70 - rnd.randint(0, 8)] + words(rnd, rnd.randint(0, 60))) for _ in range(25)]
    extra += [" ".join(words(rnd, 9) + circle + words(rnd, 5)), " ".join(circle[1:121]), " ".join(["spam"] * 200), " ".join(["spam"] * 51)]
    extra += ["\n\t" + " ".join(passage), "\xa0" + " ".join(passage) + "\n"]  # nothing is left of these but white space
    extra += [" ".join(passage[:49]), " ".join(words(rnd, 20) + passage + words(rnd, 3) + passage)]
    df = corpus(spark, extra)
    rows = {r.doc_id: r.text for r in df.collect()}
    got = {}
    for r in suffixes.repeats(df).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    want = covered(rows.items())
    assert got == want
    kept = suffixes.without_repeats(df)
    assert kept.columns == df.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    for i, text in rows.items():
        rest = [w for k, w in enumerate((text or "").split()) if k not in want.get(i, ())]
        if i not in want:
            assert texts[i] == (text, len(text or ""))
        elif rest:
            assert texts[i][0].split() == rest and texts[i][1] == len(texts[i][0])
        else:
            assert i not in texts
    assert suffixes.repeats(empty(spark)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, dim string, n string"


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            v = rng.standard_normal(16)
            for _ in range(rng.integers(1, 5)):
                rows.append((k, (v + rng.normal(0, 0.09, 16)).tolist(), label, "d", "n"))
                k += 1
    rows += [(k, rows[0][1], 0, "d", "n"), (k + 1, [x * 2 for x in rows[0][1]], 0, "d", "n"), (k + 2, None, 0, "d", "n"), (k + 3, [], 1, "d", "n"), (k + 4, [0.0] * 16, 1, "d", "n")]
    rows += [(k + 5, [float("nan")] * 16, 1, "d", "n"), (k + 6, [None] * 16, 1, "d", "n"), (k + 7, [1.0, 2.0], 1, "d", "n"), (k + 8, [1e-30] * 16, 1, "d", "n"), (k + 9, [1e30] * 16, 1, "d", "n")]
    df = spark.createDataFrame(rows, VECTORS)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}

    def able(r):
        v = r.embedding
        return v and r.label is not None and None not in v and np.isfinite(v).all() and np.any(v)

    data = {r.vec_id: r for r in df.collect()}
    ok = [i for i, r in data.items() if able(r)]
    unit = {i: (x := np.array(data[i].embedding, np.float64) / np.abs(data[i].embedding).max()) / np.linalg.norm(x) for i in ok}
    pairs = [(a, b) for a in ok for b in ok if a < b and data[a].label == data[b].label and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    parts = classes(pairs, data)
    n = {i: sum(i in p for p in pairs) for i in data}
    assert got == {i: (n[i], parts[i], parts[i] == i) for i in data}
    assert embeddings.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def planted(rng, n, dim, cone):
    """Unit vectors, some of them at a cosine just above 0.98 to one before."""
    out = [rng.standard_normal(dim) + (np.r_[6.0, np.zeros(dim - 1)] if cone else 0) for _ in range(n)]
    for k in range(0, n - 1, 7):
        v = out[k] / np.linalg.norm(out[k])
        w = rng.standard_normal(dim)
        w -= (w @ v) * v
        out[k + 1] = 0.981 * v + np.sqrt(1 - 0.981**2) * w / np.linalg.norm(w)
    return np.array(out)


@pytest.mark.parametrize("cone", [False, True])
def test_forest_finds_planted_pairs(spark, cone, monkeypatch):
    rng = np.random.default_rng(4 + cone)
    x = planted(rng, 1400, 24, cone).astype(np.float32)
    monkeypatch.setattr(embeddings, "SAMPLE_BYTES", 8 * 24 * 150)  # fewer than the leaves ask for
    rows = [(k, v.tolist(), 7) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    seen = {}
    grow = embeddings.grow
    monkeypatch.setattr(embeddings, "grow", lambda *a: seen.update(grow(*a)) or seen)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, leaf=48).collect()}
    tree = seen[24][0]
    assert tree.depth >= 4 and tree.depth > tree.sampled
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = np.triu(u @ u.T >= 0.98, 1)
    pairs = list(zip(*map(list, np.nonzero(near)), strict=True))
    n = near.sum(axis=0) + near.sum(axis=1)
    parts = classes([(int(a), int(b)) for a, b in pairs], range(len(x)))
    right = np.mean([got[k] == (n[k], parts[k]) for k in range(len(x)) if n[k]])
    assert len(pairs) > 150 and right >= 0.99
    assert all(got[k][0] <= n[k] for k in range(len(x)))


def test_embeddings_of_repeated_and_missing_ids(spark):
    e, f = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(5, e, 0), (5, f, 0), (6, [1.0, 0.01, 0.0], 0), (7, [0.01, 1.0, 0.0], 0), (None, e, 0), (8, e, None), (9, [2.0, 0.0, 0.0], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str)
    want = [(5, 2, 5, True), (5, 1, 5, True), (6, 2, 5, False), (7, 1, 5, False), (None, 0, None, True), (8, 0, 8, True), (9, 2, 5, False)]
    assert found == sorted(want, key=str)


def test_a_cosine_equal_to_the_threshold_links(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [0.8, 0.6], 0), (3, [0.79, 0.6131068], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.8).collect()
    assert {r.vec_id: r.n_links for r in got} == {1: 1, 2: 2, 3: 1}


def test_vectors_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LENGTHS", 1)
    rows = [(k, [1.0] * (1 + k % 5) + [0.0], k % 2) for k in range(60)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), leaf=2).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(k, 5, k % 10) for k in range(60)}


def test_spans_are_joined_where_they_touch(spark):
    spans = [(1, 0, 50, 7), (1, 50, 90, 3), (1, 91, 95, 9), (1, 10, 20, 2), (1, 93, 94, 8), (2, 5, 60, 1), (2, 5, 70, 4)]
    got = suffixes.merged(spark.createDataFrame(spans, "doc long, start int, end int, other long"))
    assert sorted((r.doc, r.start, r.end, r.other) for r in got.collect()) == [(1, 0, 90, 2), (1, 91, 95, 8), (2, 5, 70, 1)]
