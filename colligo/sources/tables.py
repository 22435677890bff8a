"""Stored tables that are written again and again: an upsert table by key buckets, and a sink by status.

Both are Parquet folders. What a write adds is seen only once its version is
committed, and a write that is run again with the same version number puts the
same files in place of its own, so a job may be repeated after any failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from colligo.operators.scan import safe_name, upsert

BUCKETS = 32
#: Stands for the version before in a version's map.
BEFORE = -1


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The committed versions below a folder of v=N folders, in order; a version is committed once its writer's mark is there."""
    path, files = _path(spark, folder)
    found = [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []
    made = [int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and files.exists(_path(spark, f"{p}/_SUCCESS")[0])]
    return sorted(made)


def _drop(spark: SparkSession, text: str) -> None:
    path, files = _path(spark, text)
    files.delete(path, True)


class UpsertTable:
    """Newest row per key, in hash buckets of which a write copies only those that it touches.

    data/v=N/bucket=B holds bucket B as version N left it, map/v=N says for every
    bucket which version holds it (at most `buckets` rows, and one that names the
    version before) and is written last: it commits the version. Bytes written grow with the buckets that a batch touches,
    not with the table.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), keys, order, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _map(self, version: int | None) -> dict[int, int]:
        return {b: at for b, at in self._entries(version).items() if b != BEFORE}

    def _entries(self, version: int | None) -> dict[int, int]:
        if version is None:
            return {}
        return {r.bucket: r.at for r in self.spark.read.schema("bucket int, at long").parquet(f"{self.folder}/map/v={version}").collect()}

    def latest(self) -> int | None:
        return max(versions(self.spark, f"{self.folder}/map"), default=None)

    def _rows(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/v={at}/bucket={b}" for b, at in sorted(places.items())])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, by default the latest."""
        return self._rows(self._map(self.latest() if version is None else version))

    def upsert(self, batch: DataFrame, version: int) -> list[int]:
        """Merge batch into the version before and commit it as `version`; gives the buckets written.

        A version that exists already is written again from the one before it, which
        must not have been removed.
        """
        known = versions(self.spark, f"{self.folder}/map")
        last = max((v for v in known if v < version), default=None)
        if version in known and self._entries(version).get(BEFORE) != last:
            raise ValueError(f"version {version} was made from one that has been removed")
        before = self._map(last)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows = batch.select(*self.schema.fieldNames())
        touched = sorted(r.b for r in rows.select(bucket.alias("b")).distinct().collect())
        old = self._rows({b: before[b] for b in touched if b in before})
        first = upsert(rows.limit(0), rows, self.keys, self.order)
        merged = upsert(old, first, self.keys, self.order).withColumn("bucket", bucket)
        # What a failed attempt of this version left is replaced as a whole.
        merged.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/data/v={version}")
        after = before | dict.fromkeys(touched, version)
        entries = [*after.items(), *([(BEFORE, last)] if last is not None else [])]
        made = self.spark.createDataFrame(sorted(entries), "bucket int, at long")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/map/v={version}")
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Remove versions but the last `keep`, and the bucket files that none of those names; gives the number of files' folders removed."""
        known = versions(self.spark, f"{self.folder}/map")
        kept = known[-keep:]
        needed = {(at, b) for v in kept for b, at in self._map(v).items()}
        for v in known[:-keep]:
            _drop(self.spark, f"{self.folder}/map/v={v}")
        gone = 0
        for v in versions(self.spark, f"{self.folder}/data"):
            if kept and v > kept[-1]:
                continue
            path, files = _path(self.spark, f"{self.folder}/data/v={v}")
            names = [s.getPath().getName() for s in files.listStatus(path)]
            held = [int(n[7:]) for n in names if n.startswith("bucket=")]
            idle = [b for b in held if (v, b) not in needed]
            gone += len(idle)
            for b in idle if len(idle) < len(held) else []:
                _drop(self.spark, f"{path}/bucket={b}")
            if len(idle) == len(held):
                _drop(self.spark, str(path))
        return gone


def write_by_status(rows: DataFrame, folder: str, version: int = 0) -> None:
    """Write rows (app_id, album_name, status, ...) with their item name, one folder per status and version.

    Only the partitions of this version's statuses are overwritten, so repeating a
    version changes nothing; the statuses of a version are committed last, and
    readers see no others. A null status is a partition of its own.
    """
    spark = rows.sparkSession
    made = rows.withColumn("item", safe_name(F.col("app_id"), F.col("album_name"))).withColumn("version", F.lit(version))
    # The statuses come from the write itself; an absent or empty one is the same partition.
    written = Observation()
    seen = made.observe(written, F.collect_set(F.coalesce("status", F.lit(""))).alias("statuses"))
    seen.write.partitionBy("status", "version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/items")
    statuses = [(s,) for s in sorted(written.get["statuses"])]
    spark.createDataFrame(statuses, "status string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/v={version}")


def read_by_status(spark: SparkSession, folder: str, status: str | None = None, version: int | None = None) -> DataFrame:
    """Items of a committed version (the latest by default), of one status if given; other partitions are not read."""
    last = max(versions(spark, f"{folder}/commits"), default=None) if version is None else version
    if last is None:
        raise ValueError(f"no committed version in {folder}")
    held = {r.status for r in spark.read.schema("status string").parquet(f"{folder}/commits/v={last}").collect()}
    wanted = sorted(held if status is None else held & {status})
    rows = spark.read.option("basePath", f"{folder}/items").parquet(f"{folder}/items") if held else spark.createDataFrame([], "app_id long, album_name string, item string, status string, version int")
    chosen = F.col("status").isin(*[s for s in wanted if s]) if any(wanted) else F.lit(False)
    return rows.where((F.col("version") == last) & (chosen | F.col("status").isNull() if "" in wanted else chosen))
