"""Track normalisation and grouping."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligo.functions.text import blank_to_null, first_int, junk_to_null, norm_stem, strip_zeros

# Formats from best to worst.
FORMATS = ("flac", "alac", "aiff", "wav", "mp3", "m4a", "ogg")
LOSSLESS = ("flac", "wav", "aiff", "alac", "aif")
GROUP = ("app_id", "disc", "norm_stem")


def disc_number(tag: Column, path: Column) -> Column:
    """n of an n/N tag, else 1; if that is 1, the number of the innermost path part that names a disc."""
    own = F.coalesce(first_int(tag), F.lit(1))
    parts = F.filter(F.reverse(F.split(F.translate(path, "\\", "/"), "/")), lambda p: p.rlike("(?i)(?:disc|cd)[ ]*[0-9]+"))
    named = F.regexp_extract(F.try_element_at(parts, F.lit(1)), "(?i)(?:disc|cd)[ ]*([0-9]+)", 1).try_cast("int")
    return F.when(own == 1, F.coalesce(named, own)).otherwise(own)


def track_number(stem: Column, tag: Column) -> Column:
    """Leading digits of the stem without zeros (0 if none are left), else the tag's first number."""
    lead = F.nullif(F.regexp_extract(stem, "^([0-9]+)", 1), F.lit(""))
    return F.coalesce(strip_zeros(lead).try_cast("int"), first_int(tag))


def format_rank(fmt: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.lower(fmt))
    return F.when(place > 0, place).otherwise(999).cast("int")


def with_stems(files: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """local files with norm_stem and track_no."""
    return files.withColumn("norm_stem", norm_stem(F.col("stem"))).withColumn("track_no", track_number(F.col("stem"), F.lit(None).cast("string")))


def group_tracks_exact(files: DataFrame) -> DataFrame:
    """One group per (app_id, disc, norm_stem)."""
    return with_stems(files).groupBy("app_id", "disc", "norm_stem").agg(F.count("*").alias("variants"), F.min("file_no").alias("first_file"))


class Groups:
    """Groups of one album in the order in which files open them; each file joins the first group that fits.

    A group fits on the same disc if its first file has the same stem, or lasts
    nearly as long and has the same track number or a like stem. Groups are looked
    up by stem and by second, so a file meets only those that may fit.
    """

    def __init__(self, within: float = 1.0, alike: float = 0.85) -> None:
        self.within, self.alike, self.count = within, alike, 0
        self.by_stem: dict[tuple, int] = {}
        self.by_second: dict[tuple, list[tuple]] = {}

    def place(self, disc: int, stem: str, no: int | None, length: float | None) -> int:
        found = [self.by_stem[disc, stem]] if (disc, stem) in self.by_stem else []
        if length is not None:
            at, reach = floor(length), ceil(self.within)
            found += [g for k in range(at - reach, at + reach + 1) for g, *first in self.by_second.get((disc, k), ()) if self.fits(stem, no, length, *first)]
        if found:
            return min(found)
        g = self.count
        self.count += 1
        self.by_stem.setdefault((disc, stem), g)
        if length is not None:
            self.by_second.setdefault((disc, floor(length)), []).append((g, stem, no, length))
        return g

    def fits(self, stem: str, no: int | None, length: float, s: str, n: int | None, first: float) -> bool:
        if abs(length - first) >= self.within:
            return False
        if no is not None and n == no:
            return True
        # The ratio can't exceed what the lengths of both allow.
        possible = 2 * min(len(stem), len(s)) >= self.alike * (len(stem) + len(s))
        return possible and SequenceMatcher(None, stem, s).ratio() >= self.alike


def group_tracks(files: DataFrame) -> DataFrame:
    """app_id, file_no and group_no of every file, in path order.

    Albums lie whole and sorted in one task; batches of rows hold many of them,
    and the groups of the album at a batch's end carry over to the next.
    """
    rows = with_stems(files).select("app_id", F.col("file_no").cast("long").alias("file_no"), F.col("disc").cast("long").alias("disc"), F.coalesce("norm_stem", F.lit("")).alias("norm_stem"), "track_no", F.col("duration_s").cast("double").alias("duration_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        album, groups = None, Groups()
        for batch in batches:
            out = []
            for app, disc, stem, no, length in zip(*[batch.column(c).to_pylist() for c in ("app_id", "disc", "norm_stem", "track_no", "duration_s")], strict=True):
                if (app,) != album:
                    album, groups = (app,), Groups()
                out.append(groups.place(disc, stem, no, length))
            yield pa.RecordBatch.from_arrays([batch.column("app_id"), batch.column("file_no"), pa.array(out, pa.int64())], ["app_id", "file_no", "group_no"])

    return rows.repartition("app_id").sortWithinPartitions("app_id", "file_no").mapInArrow(run, "app_id long, file_no long, group_no long")


def split_groups(files: DataFrame) -> DataFrame:
    """Groups of several track numbers are split: the stem gets the number, or unnum and a running number."""
    group = Window.partitionBy("app_id", "disc", "norm_stem")
    rows = with_stems(files).withColumn("numbers", F.size(F.collect_set("track_no").over(group)))
    turn = F.row_number().over(Window.partitionBy("app_id", "disc", "norm_stem", F.col("track_no").isNull()).orderBy("file_no"))
    name = F.when(F.col("numbers") <= 1, F.col("norm_stem")).when(F.col("track_no").isNotNull(), F.concat_ws(" ", "norm_stem", F.col("track_no").cast("string"))).otherwise(F.concat_ws(" ", "norm_stem", F.lit("unnum"), turn.cast("string")))
    return rows.select("app_id", "file_no", "disc", name.alias("group_stem"))


def adopt_format(files: DataFrame) -> DataFrame:
    """The best variant of each group by format, then file number, and its tier."""
    order = Window.partitionBy("app_id", "disc", "norm_stem").orderBy(format_rank(F.col("fmt")), "file_no")
    tier = F.when(F.col("fmt").isin(*LOSSLESS), "lossless").when(F.col("fmt") != "mp3", "lossy").otherwise("mp3")
    return with_stems(files).withColumn("variant_rank", F.row_number().over(order)).where("variant_rank = 1").select("app_id", "disc", "norm_stem", "file_no", "fmt", tier.alias("tier"))


def variants(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Files with their tags and their rank in their group."""
    order = Window.partitionBy("app_id", "disc", "norm_stem").orderBy(format_rank(F.col("fmt")), "file_no")
    return with_stems(files).join(tags, ["app_id", "file_no"], "left").withColumn("variant_rank", F.row_number().over(order))


def merge_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Per group and tag the first value in variant order that means something."""
    def first(c: str) -> Column:
        value = junk_to_null(F.col(c))
        return F.min_by(value, F.when(value.isNotNull(), F.col("variant_rank"))).alias(c)

    return variants(files, tags).groupBy("app_id", "disc", "norm_stem").agg(*[first(c) for c in ("title", "artist", "track_number", "disc_number", "year_tag")])


def evidence_weight(files: DataFrame, tags: DataFrame) -> DataFrame:
    """strong for several variants with tags, moderate for one, critical_missing without tags; mean duration."""
    some = F.bool_or(F.coalesce(*[junk_to_null(F.col(c)) for c in ("title", "artist", "track_number", "disc_number", "year_tag")]).isNotNull())
    weight = F.when(~some, "critical_missing").when(F.count("*") > 1, "strong").otherwise("moderate")
    return variants(files, tags).groupBy("app_id", "disc", "norm_stem").agg(weight.alias("weight"), F.round(F.avg("duration_s"), 2).alias("mean_s"))


def commonest(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent non-junk value of each key; of equal counts, the one seen first."""
    seen = rows.select(key, junk_to_null(F.col(value)).alias(value), order).where(F.col(value).isNotNull())
    counts = seen.groupBy(key, value).agg(F.count("*").alias("c"), F.min(order).alias("o"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("c"), "o")).alias(value))


def album_consensus(tags: DataFrame, values: tuple[str, ...] = ("artist", "year_tag")) -> DataFrame:
    """The commonest value of each tag among an album's files; null where no file has one that means something."""
    found = [commonest(tags, "app_id", v, "file_no") for v in values]
    return reduce(lambda a, b: a.join(b, "app_id", "full_outer"), found)


def track_titles(files: DataFrame, tags: DataFrame, heard: DataFrame | None = None) -> DataFrame:
    """(app_id, disc, norm_stem, title, title_from, mean_ms): what the fingerprint says, else the first tag in variant order, else the file's name without leading numbers.

    heard: (app_id, disc, norm_stem, title, artist) of groups that a fingerprint knows.
    """
    rows = variants(files, tags)
    tag = junk_to_null(F.col("title"))
    named = F.trim(F.regexp_replace("stem", r"^(?:[0-9]++[\s.-]++)++", ""))
    made = rows.groupBy(*GROUP).agg(F.min_by(tag, F.when(tag.isNotNull(), F.col("variant_rank"))).alias("_tag"), F.min_by(named, "variant_rank").alias("_file"), F.floor(F.avg("duration_s") * 1000).cast("long").alias("mean_ms"))
    if heard is not None:
        made = made.join(heard.select(*GROUP, F.col("title").alias("_heard")), list(GROUP), "left")
    else:
        made = made.withColumn("_heard", F.lit(None).cast("string"))
    heard_title = blank_to_null(F.col("_heard"))
    source = F.when(heard_title.isNotNull(), "fingerprint").when(F.col("_tag").isNotNull(), "tag").when(blank_to_null(F.col("_file")).isNotNull(), "file")
    return made.select(*GROUP, F.coalesce(heard_title, "_tag", blank_to_null(F.col("_file"))).alias("title"), source.alias("title_from"), "mean_ms")


def baseline(files: DataFrame, tags: DataFrame, heard: DataFrame | None = None) -> DataFrame:
    """The commonest album, artist and year of an album.

    Groups that a fingerprint knows give its artist and none of their tags; the
    others give the tags of all their variants. Of equal counts, the first seen counts.
    """
    rows = variants(files, tags).select(*GROUP, "album", "artist", "year_tag", "file_no")
    if heard is not None:
        known = heard.where(blank_to_null(F.col("title")).isNotNull()).select(*GROUP, F.col("artist").alias("_artist"), F.lit(True).alias("_known"))
        rows = rows.join(known, list(GROUP), "left")
        first = F.row_number().over(Window.partitionBy(*GROUP).orderBy("file_no")) == 1
        # One vote a group, at the place of its first file.
        own = F.when(F.col("_known") & first, F.col("_artist"))
        rows = rows.withColumn("_own", own).withColumns({"album": F.when(F.col("_known").isNull(), F.col("album")), "year_tag": F.when(F.col("_known").isNull(), F.col("year_tag")), "artist": F.when(F.col("_known").isNull(), F.col("artist")).otherwise(F.col("_own"))})
    return album_consensus(rows.select("app_id", "album", "artist", "year_tag", "file_no"), ("album", "artist", "year_tag"))


def total_discs(files: DataFrame, store: DataFrame) -> DataFrame:
    both = files.select("app_id", "disc").unionByName(store.select("app_id", "disc"))
    return both.groupBy("app_id").agg(F.greatest(F.coalesce(F.max("disc"), F.lit(1)), F.lit(1)).alias("total_discs"))


def tier_by_size(files: DataFrame) -> DataFrame:
    n = F.count("*")
    return files.groupBy("app_id").agg(n.alias("files"), F.when(n <= 50, "small").when(n <= 100, "medium").otherwise("large").alias("tier"))
