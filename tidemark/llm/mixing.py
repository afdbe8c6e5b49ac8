"""Mixing sources to target weights by Poisson replication.

The mean repetition rate of a source is its target mass over its present mass.
Every document draws a count from the Poisson distribution with that mean, by
inverting the distribution function at a uniform number hashed from seed and
document id; it is repeated count times and all copies are dealt out in the
order of another hash. Only DataFrame functions are used; per-source tables
have one row a source, and the sum over all sources is one number.

Defined results: null sources form one source of their own; a row without id
hashes as its text's MD5 (nothing for a null text), so such rows draw and
spread each by its text; a null text has no mass but may be drawn (unit "docs"
counts it); rows that repeat an id repeat its draw; sources of no mass or of
weight zero, and those that ``targets`` doesn't name, are dropped; an empty
table gives an empty result. Other columns are carried along; columns named as
the two that are added give way to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Means above this are drawn as sums of independent parts, so that exp(-mean) keeps its precision.
LARGEST_MEAN = 50.0


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the first 52 bits of the parts' MD5."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return hashed(*texts) / F.lit(float(1 << 52))


def hashed(*texts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts).cast("binary")), 1, 13), 16, 10).cast("long")


def source_rates(
    docs: DataFrame, targets: dict[str, float] | None, alpha: float, scale: float, unit: str, source_col: str, text_col: str
) -> DataFrame:
    """``(source, mass, rate)``: one row for each source that has mass."""
    mass = F.coalesce(F.length(F.col(text_col)), F.lit(0)) if unit == "chars" else F.lit(1)
    masses = materialize(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(mass.cast("long")).alias("mass")))
    if targets is None:
        weighted = masses.withColumn("weight", F.pow(F.col("mass").cast("double"), F.lit(alpha)))
    else:
        rows = [(k, float(v)) for k, v in targets.items()]
        wanted = docs.sparkSession.createDataFrame(rows, "source string, weight double").withColumnRenamed("source", "s")
        weighted = masses.join(wanted, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    weighted = weighted.where("mass > 0 and weight > 0")
    # two numbers, whatever the number of sources
    total, weights = weighted.agg(F.sum("mass"), F.sum("weight")).first()
    share = F.col("weight") / F.lit(float(weights or 1.0))
    rate = share * F.lit(float(total or 0)) * F.lit(float(scale)) / F.col("mass").cast("double")
    return weighted.select("source", "mass", rate.alias("rate"))


def distribution(rate: Column) -> tuple[Column, Column]:
    """Parts that the mean is split into, and the distribution function of one part
    as an array, long enough that what is left is below 1e-12."""
    parts = F.greatest(F.lit(1), F.ceil(rate / F.lit(LARGEST_MEAN))).cast("int")
    mean = rate / parts
    last = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(20.0)).cast("int")
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("cdf"))

    def add(acc: Column, n: Column) -> Column:
        p = acc["p"] * mean / n.cast("double")
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["cdf"], F.array(c)).alias("cdf"))

    return parts, F.aggregate(F.sequence(F.lit(1), last), first, add, lambda acc: acc["cdf"])


def mix_sources(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    alpha: float = 0.5,
    scale: float = 1.0,
    seed: str = "mix",
    unit: str = "chars",
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """Replicate ``docs`` so that sources meet their target shares in expectation.

    ``targets``: weight by source; without it the weight is mass ** alpha
    (temperature sampling). ``scale``: mass of the result over mass of the
    input. Adds ``copy`` (1..count) and ``shuffle_key``, whose hash deals out
    the rows and whose order they have within a partition.
    """
    rates = source_rates(docs, targets, alpha, scale, unit, source_col, text_col)
    parts, cdf = distribution(F.col("rate"))
    rates = materialize(rates.select(F.col("source").alias("__source"), parts.alias("__parts"), cdf.alias("__cdf")))
    kept = docs.drop("copy", "shuffle_key")
    columns = kept.columns
    named = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary")), F.lit(""))
    draws = F.aggregate(
        F.sequence(F.lit(1), F.col("__parts")),
        F.lit(0),
        lambda n, j: n + F.size(F.filter("__cdf", lambda c: c <= uniform(seed, named, j))),
    )
    drawn = (
        kept.join(rates, F.col(source_col).eqNullSafe(F.col("__source")))
        .withColumn("__count", draws)
        .where("__count > 0")
        .select(*columns, F.explode(F.sequence(F.lit(1), F.col("__count"))).alias("copy"))
    )
    key = hashed(F.lit(seed + "/order"), named, F.col("copy").cast("string"))
    return drawn.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
