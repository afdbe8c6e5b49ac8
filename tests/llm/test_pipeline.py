"""The whole pipeline against a plain version of each stage."""

from collections import Counter
from pathlib import Path

import corpus_pipeline
from tests.llm.test_copies import classes, covered
from tests.llm.test_near_copies import jaccard
from tests.llm.test_near_copies import shingles as word_shingles
from tests.llm.test_tokens_mixing import poisson
from tests.llm.test_warc_items import shingles
from tidemark.llm import common, suffixes, toxicity

SF = "/root/testdata/sf0.001"


def test_run_is_the_plain_pipeline(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    score = toxicity.fit(docs, labels).scorer()
    rows = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    kept = {i: x for i, x in rows.items() if score([x[0]])[0] < 0.3}

    sets = {i: word_shingles(t) for i, (t, _) in kept.items()}
    ids = sorted(sets)
    part = classes([(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= 0.8], ids)
    kept = {i: x for i, x in kept.items() if part[i] == i}

    spans = covered([(i, t) for i, (t, _) in kept.items()])
    shorter = {}
    for i, (text, source) in kept.items():
        if i in spans:
            at = sorted(spans[i])
            runs, start = [], at[0]
            for a, b in zip(at, [*at[1:], None], strict=True):
                if b != a + 1:
                    runs.append((start, a + 1))
                    start = b
            text = suffixes.cut(text, runs)
        if i not in spans or text.strip():
            shorter[i] = (text, source)

    items = [s for r in bench.collect() if (s := shingles(r.text))]
    clean = {i: x for i, x in shorter.items() if not any(len(s & shingles(x[0])) >= 0.8 * len(s) - 1e-9 for s in items)}

    mass = Counter()
    for text, source in clean.values():
        mass[source] += len(text or "")
    mass = {s: m for s, m in mass.items() if m}
    weights = {s: float(m) ** 0.5 for s, m in mass.items()}
    want = Counter()
    for i, (_, source) in clean.items():
        if source in mass:
            want[i] = poisson(weights[source] / sum(weights.values()) * sum(mass.values()) / mass[source], "mix", i)

    tables = Path(common.shared_dir(spark), "tables")
    before = set(tables.glob("*")) if tables.exists() else set()
    got = corpus_pipeline.run(spark, SF)
    assert {str(p) for p in set(tables.glob("*")) - before} == {got.written_to}  # nothing but the result is left
    assert Counter(r.doc_id for r in got.collect()) == +want
    assert all(r.text == clean[r.doc_id][0] and r.n_chars == len(r.text) for r in got.collect())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]


def test_stages_keep_columns_and_stand_empty_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and set(empty.columns) <= set(out.columns), name
