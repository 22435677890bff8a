"""Sources, table maintenance, scan selection and enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colligo.functions.text import blank_to_null

# Accepted audio extensions, and formats kept without loss.
EXTENSIONS = ("flac", "wav", "mp3", "ogg", "aac", "m4a", "aiff", "aif")
LOSSLESS = ("flac", "wav", "aiff", "alac", "aif")


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and extension of accepted files below folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return list_media(files.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))))


def list_media(files: DataFrame, path: str = "path", ext: str = "ext") -> DataFrame:
    """Rows with an accepted extension that are neither hidden nor in an archive's junk folder."""
    flat = F.translate(F.col(path), "\\", "/")
    return files.where(F.lower(F.col(ext)).isin(*EXTENSIONS) & ~flat.rlike(r"(^|/)\.[^/]*$") & ~flat.contains("/__MACOSX/"))


def normalize_path(c: Column) -> Column:
    """X:\\a\\b to /mnt/x/a/b, other backslashes to slashes; absolute and empty paths stay."""
    drive = F.regexp_extract(c, r"^([A-Za-z]):[\\/]?(.*)$", 1)
    rest = F.translate(F.regexp_extract(c, r"(?s)^([A-Za-z]):[\\/]?(.*)$", 2), "\\", "/")
    return F.when(c.startswith("/"), c).when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), rest)).otherwise(F.translate(c, "\\", "/"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("app_id long, content_type string, app_type string, name string, install_dir string, last_updated timestamp").json(path)


def payload_field(payload: Column, field: str, kind: str = "long") -> Column:
    """A field of a JSON payload, null where the payload or the field is malformed."""
    return F.try_variant_get(F.try_parse_json(payload), f"$.{field}", kind)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace by key: the row that is last by order, new rows winning ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in [*order, "_new"]])
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def cache_lookup(wanted: DataFrame, cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """wanted (service, query_key) with its latest response of at most the given age, null on a miss."""
    last = Window.partitionBy("service", "query_key").orderBy(F.desc("fetched_at"), F.desc("event_id"))
    latest = cache.withColumn("_n", F.row_number().over(last)).where("_n = 1").where(F.col("fetched_at") >= now - F.expr(f"interval {days} days"))
    return wanted.join(latest.drop("_n"), ["service", "query_key"], "left").withColumn("hit", F.col("fetched_at").isNotNull())


def safe_name(app_id: Column, name: Column) -> Column:
    return F.concat(app_id.cast("string"), F.lit("_"), F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_"))


def output_path(disc: Column, title: Column, fmt: Column) -> Column:
    ext = F.when(fmt.isin(*LOSSLESS), "aiff").otherwise("mp3")
    return F.concat(F.lit("disc_"), disc.cast("string"), F.lit("/"), title, F.lit("."), ext)


def is_soundtrack(m: DataFrame) -> DataFrame:
    name = F.lower("name")
    return m.where((F.col("content_type") == "3") | F.lower("app_type").isin("music", "soundtrack") | name.contains("soundtrack") | name.contains(" ost"))


def target_filter(m: DataFrame, targets: DataFrame) -> DataFrame:
    """Listed ids only; the list replaces every other choice."""
    return m.join(targets.select("app_id").distinct(), "app_id", "left_semi")


def unprocessed(m: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    return m if force else m.join(ledger.select("app_id").distinct(), "app_id", "left_anti")


def scan_limit(m: DataFrame, n: int) -> DataFrame:
    return m.orderBy("app_id").limit(n)


def install_dir(options: DataFrame, existing: DataFrame) -> DataFrame:
    """First existing folder (app_id, rank, dir) of an app, else its first."""
    seen = options.join(existing.select("dir").distinct().withColumn("there", F.lit(1)), "dir", "left")
    return seen.groupBy("app_id").agg(F.min_by("dir", F.struct(F.when(F.col("there") == 1, 0).otherwise(1), "rank")).alias("dir"))


def tag_labels(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of each app in order, unknown ids dropped, as one text."""
    found = ids.join(labels, "tag_id")
    return found.groupBy("app_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), ", ").alias("labels"))


def parent_enrich(albums: DataFrame, tags: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Parent name, tags, genres and first genre of every album; an album without a known parent keeps nulls.

    tags (app_id, labels) are local ones, which come before those of the cache
    (app_id, cached_labels, genres as an array), if one is given.
    """
    parents = albums.select(F.col("app_id").alias("parent_app_id"), F.col("name").alias("parent_name"))
    own = tags.select(F.col("app_id").alias("parent_app_id"), F.col("labels").alias("_local"))
    wide = albums.join(parents, "parent_app_id", "left").join(own, "parent_app_id", "left")
    if cache is None:
        return wide.withColumnRenamed("_local", "parent_tags")
    kept = cache.select(F.col("app_id").alias("parent_app_id"), F.col("cached_labels").alias("_cached"), F.col("genres").alias("parent_genres"))
    wide = wide.join(kept, "parent_app_id", "left").withColumn("parent_tags", F.coalesce(blank_to_null(F.col("_local")), F.col("_cached")))
    return wide.withColumn("parent_genre", F.try_element_at("parent_genres", F.lit(1))).drop("_local", "_cached")


#: Where header images of applications with a logo stand.
IMAGES = "https://img.example.com/apps/"
#: Roles of credits in their order, with the names under which they are listed.
ROLES = {"artist": "Artist", "composer": "Composer", "othercredits": "Othercredits"}


def enrich_tiers(t: DataFrame) -> DataFrame:
    """A tier fills a field only if earlier tiers left it blank."""
    pick = lambda *c: F.coalesce(*[blank_to_null(F.col(x)) for x in c])
    image = F.coalesce(blank_to_null(F.col("cached_image")), F.when(blank_to_null(F.col("local_logo")).isNotNull(), F.concat(F.lit(IMAGES), F.col("app_id").cast("string"), F.lit("/header.jpg"))))
    return t.select("app_id", pick("cached_name", "store_name", "local_name").alias("name"), pick("cached_genre", "local_genre").alias("genre"), pick("cached_date", "local_date").alias("release_date"), image.alias("header_image_url"))


def fold_tiers(rows: DataFrame, scalars: tuple[str, ...] = ("name", "genre", "release_date", "header_image_url"), lists: tuple[str, ...] = ("developers", "publishers", "tags"), key: str = "app_id") -> DataFrame:
    """One row per key: every field from the first tier (smallest `tier`) that has something in it.

    rows is the union of any number of tier tables; fields that a tier lacks are
    null. A scalar counts unless it is blank, a list unless it has no entry but
    blank ones, which are left out. One aggregation, one shuffle.
    """
    entries = lambda c: F.filter(F.col(c), lambda x: blank_to_null(x).isNotNull())
    first = lambda value, there: F.min_by(value, F.when(there, F.col("tier")))
    found = [first(F.col(c), blank_to_null(F.col(c)).isNotNull()).alias(c) for c in scalars]
    found += [first(entries(c), F.size(entries(c)) > 0).alias(c) for c in lists]
    return rows.groupBy(key).agg(*found)


def union_tiers(tiers: list[DataFrame]) -> DataFrame:
    """Tier tables, in their order of precedence, as one with a tier number."""
    numbered = [t.withColumn("tier", F.lit(i)) for i, t in enumerate(tiers)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def flatten_tracklist(t: DataFrame) -> DataFrame:
    """Numbered-key track lists to rows in numeric key order."""
    entry = "map<string,struct<discnumber:string,tracknumber:int,originalname:string,s:string>>"
    rows = t.select("app_id", F.explode(F.map_entries(F.from_json("tracks_json", entry))).alias("e")).select("app_id", F.col("e.key").try_cast("int").alias("k"), "e.value.*")
    n = Window.partitionBy("app_id").orderBy("k")
    return rows.select("app_id", (F.row_number().over(n) - 1).alias("v_idx"), F.coalesce(F.col("discnumber").try_cast("int"), F.lit(1)).alias("disc"), F.col("tracknumber").alias("number"), F.col("originalname").alias("title"), F.col("s").try_cast("double").alias("seconds"))


def credits_text(t: DataFrame) -> DataFrame:
    """One line for each role that has a text in the wanted language, else in English; label in its own column."""
    def role(name: str) -> Column:
        return F.coalesce(*[blank_to_null(F.col(c)) for c in (f"{name}_local", f"{name}_en") if c in t.columns])

    lines = [F.concat(F.lit(f"{title}: "), role(name)) for name, title in ROLES.items() if {f"{name}_local", f"{name}_en"} & set(t.columns)]
    return t.select("app_id", F.concat_ws("\n", *lines).alias("credits"), role("label").alias("label"))


def candidate_union(search: DataFrame, suggested: DataFrame, by_recording: DataFrame, most: int = 20) -> DataFrame:
    """(app_id, mbid, tier): search hits, suggested releases not among them, recording hits where both are empty; at most `most` each."""
    first = search.select("app_id", "mbid").distinct().withColumn("tier", F.lit(0))
    second = suggested.select("app_id", "mbid").distinct().join(first, ["app_id", "mbid"], "left_anti").withColumn("tier", F.lit(1))
    known = first.unionByName(second)
    third = by_recording.select("app_id", "mbid").distinct().join(known.select("app_id").distinct(), "app_id", "left_anti").withColumn("tier", F.lit(2))
    n = F.row_number().over(Window.partitionBy("app_id").orderBy("tier", "mbid"))
    return known.unionByName(third).withColumn("n", n).where(F.col("n") <= most)
