"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n rows and target share w of a mix of `total` rows has the mean
repetition rate total * w / n. Each row's count inverts the Poisson
distribution of that rate at a uniform number taken from an md5 of seed and
id, so the same row always gets the same count, whatever the partitioning.
Rates above MOST are split into equal parts with a draw each (a sum of Poisson
counts is Poisson), so the distribution never underflows. Every row is exploded
by its count and dealt by a second hash, which shuffles globally.

The rate table has one row per source; Spark broadcasts it only below
spark.sql.autoBroadcastJoinThreshold, and otherwise splits skewed sources.

Defined results: a null source is a source of its own; rows without an id draw
as the id ''; repeated rows draw alike; an empty table gives an empty table;
texts are never looked at; columns of the input that are called like the two
added ones are replaced, all other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import staged

#: Largest rate inverted in one draw; exp(-MOST) is far from underflow.
MOST = 256.0


def uniform(seed: int, *parts: Column) -> Column:
    """A double in [0, 1) with 52 random bits from an md5 of the parts."""
    return hashed(seed, *parts).cast("double") / F.lit(float(2**52))


def hashed(seed: int, *parts: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, total: int | None = None, source_col: str = "source") -> DataFrame:
    """source, rate, parts and cdf. Without weights a source's weight is its row count to the power exponent.

    A source missing from weights has weight 0. total defaults to the number of rows.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(exponent))))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        counts = counts.join(given.withColumnRenamed("source", "_given"), F.col("source").eqNullSafe(F.col("_given")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    counts = staged(counts, "counts")
    rows, all_w = counts.agg(F.sum("n"), F.sum("w")).first()
    size = float(total if total is not None else rows or 0)
    found = counts.withColumn("rate", F.lit(size) * F.col("w") / F.lit(all_w or 1.0) / F.col("n"))
    found = found.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST)).cast("int"))
    lam = F.col("rate") / F.col("parts")
    last = F.ceil(lam + 12 * F.sqrt(lam) + 24).cast("int")
    start = F.struct(F.exp(-lam).alias("p"), F.array(F.exp(-lam)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * lam / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])
    return found.select("source", "rate", "parts", cdf.alias("cdf"))


def poisson_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", copy_col: str = "copy", key_col: str = "shuffle_key") -> DataFrame:
    """Every row of docs as often as its Poisson count says, with copy (from 0) and shuffle_key, in a global random order."""
    table = staged(rates(docs, weights, exponent, total, source_col), "rates").select(F.col("source").alias("_source"), F.struct("parts", "cdf").alias("_rate"))
    keep = [c for c in docs.columns if c not in (copy_col, key_col)]
    boxed = docs.select(F.struct(*keep).alias("_row"), F.col(source_col).cast("string").alias("_own"), F.col(id_col).alias("_id"))
    drawn = boxed.join(table, F.col("_own").eqNullSafe(F.col("_source")))

    def draw(part: Column) -> Column:
        return F.size(F.filter(F.col("_rate.cdf"), lambda c: c <= uniform(seed, F.col("_id"), part)))

    times = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_rate.parts")), draw), F.lit(0), lambda a, b: a + b)
    drawn = drawn.withColumn("_times", times).where("_times > 0")
    copies = drawn.select("_row", "_id", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("_copy"))
    keyed = copies.withColumn("_key", hashed(seed, F.lit("order"), F.col("_id"), F.col("_copy")))
    return keyed.repartition(F.col("_key")).sortWithinPartitions("_key", "_copy").select("_row.*", F.col("_copy").alias(copy_col), F.col("_key").alias(key_col))
