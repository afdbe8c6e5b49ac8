"""SimHash is a step of the pipeline's near-copy stage, and its candidates are verified."""

import corpus_pipeline
from tidemark.llm import near_copies, simhash


def test_stage_goes_through_fingerprints(spark, monkeypatch):
    base = [f"w{i * 7919 % 1000}" for i in range(400)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:399], "other"])), (2, "nothing in common with any of them")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    proposed = []
    links = simhash.links

    def spied(points, *args, **kinds):
        proposed.append(points.count())
        return links(points, *args, **kinds)

    monkeypatch.setattr(simhash, "links", spied)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert proposed and proposed[0] >= 2 and kept == {0, 2}


def test_fingerprints_propose_and_texts_decide(spark):
    """Of texts of equal fingerprints only those link whose sets are similar; an equal fingerprint alone is no link."""
    base = [f"w{i}" for i in range(300)]
    rows = [(2, " ".join(base)), (7, " ".join([*base, "x"])), (9, "a b"), (11, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = df.selectExpr("doc_id AS rep")
    found = near_copies.by_fingerprints(df, near_copies.materialize(table), 5, 0.8, "doc_id", "text").collect()
    assert {(r.src, r.dst) for r in found} <= {(2, 7)}
