"""Mixing sources to target weights by Poisson replication. Native.

A source's mean repetition rate is its target share of the bytes times the total,
over its own bytes. A document's count is the inverse of the Poisson distribution
with that mean at a uniform number hashed from seed and id, so a rerun, another
cluster or another order of the rows gives the same mixture. Documents are
exploded by their counts and dealt out by a hash that also orders them: a global
shuffle.

A rate above :data:`PART` is a sum of Poisson numbers of rate PART at most, each
with a hash of its own, so that exp(-rate) never underflows.

Defined results: a null source is a source of its own; a null or empty text
weighs 1 byte, as each document weighs its bytes plus 1; rows that repeat an id
get the same count; a source with target weight 0 or without one gets rate 0, and
so do weights under 0, infinite, no number, or under 5e-19 of the largest one
(shares are decimals of 18 digits, so that their sum has no order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vellum.sources.scratch import Scratch

#: The largest mean that is inverted in one piece.
PART = 64
#: Exponent of a source's bytes in the default target weights: 1 keeps the corpus's own mixture, 0 makes sources equal.
ALPHA = 0.7


def uniform(id_col: str, seed: int, part: Column) -> Column:
    """A number in (0, 1) from 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), part.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The least k with u <= P(X <= k), for a mean of PART at most; the tail past ``last`` is under 2^-33, finer than u."""
    last = F.ceil(mean + 8 * F.sqrt(mean) + 16).cast("int")
    start = F.struct(F.exp(-mean).alias("mass"), F.exp(-mean).alias("below"), F.lit(0).alias("k"))
    end = F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda a, i: F.when(u <= a["below"], a).otherwise(
            F.struct((a["mass"] * mean / i).alias("mass"), (a["below"] + a["mass"] * mean / i).alias("below"), i.alias("k"))
        ),
        lambda a: a["k"],
    )
    return F.when(mean > 0, end).otherwise(0)


def poisson_count(id_col: str, mean: Column, seed: int) -> Column:
    parts = F.greatest(F.ceil(mean / PART), F.lit(1)).cast("int")
    drawn = F.transform(F.sequence(F.lit(1), parts), lambda p: uniform(id_col, seed, p))
    return F.aggregate(drawn, F.lit(0), lambda n, u: n + poisson_inverse(u, mean / parts))


def source_rates(docs: DataFrame, weights: DataFrame | None, source_col: str = "source", text_col: str = "text", alpha: float = ALPHA) -> DataFrame:
    """(source, docs, bytes, rate), a row for each source.

    ``weights``: (source, weight), in any unit; None: bytes to the power alpha.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1
    sums = docs.select(F.col(source_col).alias("source"), size.alias("size")).groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("bytes"))
    if weights is None:
        weighed = sums.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(alpha)))
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight")).groupBy("_source").agg(F.sum("weight").alias("weight"))
        weighed = sums.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        finite = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight"))
        weighed = weighed.withColumn("weight", F.coalesce(finite, F.lit(0.0)))
    total = weighed.agg(F.sum("bytes").alias("bytes"), F.max("weight").alias("most")).first()
    if not total.most:
        return weighed.select("source", "docs", "bytes", F.lit(0.0).alias("rate"))
    # over the greatest weight, so that any unit will do, and as decimals, whose sum has no order
    share = (F.col("weight") / F.lit(total.most)).cast("decimal(38,18)")
    weighed = weighed.withColumn("share", share)
    shares = weighed.agg(F.sum("share").cast("double")).first()[0]
    rate = F.col("share").cast("double") / F.lit(shares) * F.lit(total.bytes) / F.col("bytes")
    return weighed.select("source", "docs", "bytes", rate.alias("rate"))


def replicate(
    docs: DataFrame, weights: DataFrame | None = None, seed: int = 20, alpha: float = ALPHA, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with copy (from 0), copies, rate and shuffle_key; in shuffled order."""
    spark = docs.sparkSession
    with Scratch(spark, "mixing") as scratch:
        rates = scratch.write(source_rates(docs, weights, source_col, text_col, alpha).select(F.col("source").alias("_source"), "rate"), "rates", keep=True)
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_of"))
    rated = marked.join(rates, F.col("_of").eqNullSafe(F.col("_source")))
    counted = rated.withColumn("copies", poisson_count("_id", F.col("rate"), seed)).where("copies > 0")
    copied = counted.select("row", "_id", "rate", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    keyed = copied.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("copy").cast("string")).cast("binary")))
    return keyed.drop("_id").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mixture with the columns of ``docs``."""
    return replicate(docs, **options).select("row.*")  # type: ignore[arg-type]
