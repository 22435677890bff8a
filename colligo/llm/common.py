"""Shared helpers: staged tables in the cluster's shared folder, null-safe text, clash-free columns."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and the session runs on this machine alone, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/colligo-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Rows of long texts that a staged write hands to a Python worker at once; Spark's own number holds ten times the memory in either process.
TEXT_ROWS = 1000


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and survives lost executors.

    batch_rows: rows at most in an Arrow batch of this write's pandas functions.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(key))
    if batch_rows is not None and not 0 < given <= batch_rows:
        spark.conf.set(key, batch_rows)
    try:
        # Such tables are read once or twice: the smaller codec costs less than the disk it saves.
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, given)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    """The column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc32_mod(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % n


def with_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, no_id and text for pandas functions: an absent id is 0 with no_id set, as pandas would turn ids beside a null into floats."""
    given = F.col(id_col).cast("long")
    return docs.select(F.coalesce(given, F.lit(0)).alias("doc_id"), given.isNull().alias("no_id"), text_or_empty(text_col).alias("text"))


def ids_back(ids: pd.Series, no_id: pd.Series) -> pd.Series:
    """The ids of with_ids as nullable whole numbers."""
    return ids.astype("Int64").mask(no_id.astype(bool))


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int, counted: DataFrame | None = None) -> DataFrame:
    """Inner join of left with right on key, for keys that may hold a large share of left.

    Rows of such a key are dealt over tasks by the column `by`, about `rows` to a
    part, and its rows of right are repeated for each part. counted: a stored
    table with the keys of left, where left itself is not one.
    """
    parts = (left if counted is None else counted).groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts"))
    dealt = left.join(parts, key).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")).drop("_parts")
    copied = right.join(parts, key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def hot_join(left: DataFrame, right: DataFrame, key: str, by: str, rows: int, counted: DataFrame | None = None) -> DataFrame:
    """spread_join of which only keys with more than `rows` rows are told their parts, so that no task takes all rows of a key for that.

    These are at most one for each `rows` rows of left; they are stored, so that the planner broadcasts them while they are
    few and neither side is shuffled for its parts. The join itself is a merge join at every size.
    """
    counts = (left if counted is None else counted).groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts"))
    hot = staged(counts.where("_parts > 1"), "hot")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    copied = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied.hint("merge"), [key, "_part"]).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
