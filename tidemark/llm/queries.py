"""The corpus operators applied, with production parameters, to the corpus tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    alignment,
    decontamination,
    embeddings,
    language,
    mixing,
    prefixes,
    quality,
    sharding,
    simhash,
    suffixes,
    tokens,
    toxicity,
    warc,
)
from tidemark.llm.common import materialize, read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive_pages(read(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = alignment.align(read(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = materialize(found.withColumn("groups_sha256", digest).drop("groups"))
    return alignment.score_links(found, carried=("groups_sha256",)).withColumnRenamed("id", "doc_id")


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shuffle_into_shards(read(spark, sf_dir, "documents"))
    return found.select("*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = materialize(prefixes.turns(read(spark, sf_dir, "conversations")))
    return prefixes.prefix_trie(*prefixes.shared_openings(ranked)).drop(*prefixes.NAME)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_suffixes": op2_suffixes,
    "op3_mixing": op3_mixing,
    "op4_simhash": op4_simhash,
    "op5_embeddings": op5_embeddings,
    "op6_tokens": op6_tokens,
    "op7_warc": op7_warc,
    "op8_language": op8_language,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_sharding": op12_sharding,
    "op13_prefixes": op13_prefixes,
}

ORACLES: dict[str, str] = {
    "op5_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.v, p.b FROM reach JOIN p ON reach.r = p.a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT v AS vec_id, min(r) AS component_id FROM reach GROUP BY v) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a) USING (vec_id)
""",
    "op3_mixing": """
WITH RECURSIVE m AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS mass FROM documents GROUP BY source),
w AS (SELECT source, mass, pow(CAST(mass AS DOUBLE), 0.5) AS weight FROM m WHERE mass > 0),
t AS (SELECT CAST(sum(mass) AS DOUBLE) AS total, sum(weight) AS weights FROM w),
r AS (SELECT source, weight / weights * total * 1.0 / CAST(mass AS DOUBLE) AS rate FROM w, t),
p AS (SELECT source, greatest(1, CAST(ceil(rate / 50.0) AS INTEGER)) AS parts, rate FROM r),
q AS (SELECT source, parts, rate / parts AS mean FROM p),
cdf(source, mean, n, pr, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM q
  UNION ALL
  SELECT source, mean, n + 1, pr * mean / CAST(n + 1 AS DOUBLE), c + pr * mean / CAST(n + 1 AS DOUBLE)
  FROM cdf WHERE n < CAST(ceil(mean + 12.0 * sqrt(mean) + 20.0) AS INTEGER)),
d AS (SELECT doc_id, source, unnest(range(1, parts + 1)) AS j FROM documents JOIN q USING (source)),
u AS (SELECT doc_id, source, CAST('0x' || substr(md5('mix:' || doc_id || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0 AS x FROM d),
k AS (SELECT doc_id, count(*) AS n FROM u JOIN cdf ON u.source = cdf.source AND cdf.c <= u.x GROUP BY doc_id),
e AS (SELECT doc_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM k)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, e.copy,
  CAST('0x' || substr(md5('mix/order:' || e.doc_id || ':' || e.copy), 1, 13) AS BIGINT) AS shuffle_key
FROM documents d JOIN e ON d.doc_id = e.doc_id
""",
    "op9_decontamination": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(len(ws), 5) AS w FROM b WHERE len(ws) > 0),
ds AS (SELECT DISTINCT doc_id, w, array_to_string(ws[i:i + w - 1], ' ') AS s FROM (SELECT doc_id, w, ws, unnest(range(1, len(ws) - w + 2)) AS i FROM d, (SELECT DISTINCT w FROM i))),
bs AS (SELECT DISTINCT item_id, w, array_to_string(ws[i:i + w - 1], ' ') AS s FROM (SELECT item_id, w, ws, unnest(range(1, len(ws) - w + 2)) AS i FROM i)),
n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS n_shared FROM ds JOIN bs USING (w, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_shingles, CAST(n_shared AS DOUBLE) / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= n_shingles * 0.8 - 1e-9
""",
    "op13_prefixes": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS rank,
    sha256(length(role) || ':' || role || text) AS digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS own,
    xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 4 AS h
  FROM r GROUP BY conv_id),
o AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS opening FROM c LEFT JOIN c b ON c.base = b.conv_id),
rebuilt AS (
  SELECT o.conv_id, r.rank AS depth, digest, words FROM o JOIN r ON r.conv_id = o.base AND r.rank <= o.h
  UNION ALL SELECT o.conv_id, r.rank - o.h + o.opening, digest, words FROM o JOIN r ON r.conv_id = o.conv_id AND r.rank > o.h),
p AS (
  SELECT conv_id, depth, words, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS key FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM o),
n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY depth, key),
k AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (
  SELECT left(n.key, 64 * e) AS key, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM n) n LEFT JOIN k ON n.key = k.key GROUP BY 1),
d AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
s AS (
  SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256 FROM p JOIN d USING (conv_id, depth) GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN v USING (key) LEFT JOIN k USING (key) LEFT JOIN s USING (key)
LEFT JOIN n m ON n.depth > 0 AND m.depth = n.depth - 1 AND m.key = left(n.key, 64 * (n.depth - 1))
""",
}
