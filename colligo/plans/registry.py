"""Where queries and their SQL twins are registered."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colligo.sources.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Derived tables over one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Tables as a query; sql may name derived tables."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of the cluster, removed when the application ends; a local one only for a session on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(t: Tables, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, for a table that a query uses more than once and that is small beside what it takes to make it."""
    path = scratch(t.spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return t.spark.read.schema(df.schema).parquet(path)
