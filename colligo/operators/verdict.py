"""Integrity checks and the verdict on every album.

Tag rows: app_id, disc_number, track_number, title. All checks are aggregates of
one shuffle on app_id; the commonest title comes from a window on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligo.functions.text import strip_zeros


def strategy_badges(strategy: Column, trusted: Column, single: Column, fingerprint: Column) -> Column:
    badge = F.when(trusted | (strategy == "STEAM_BASED"), "Steam Trust").when((strategy == "LOCAL_BASED") & single, "Fallback (Single)").when(strategy == "LOCAL_BASED", "Steam Fallback").when(strategy.isin("MBZ_BASED", "FINGERPRINT_BASED"), "MBZ Match").when(strategy == "HYBRID", "Hybrid (MBZ+Steam)")
    badges = F.array_compact(F.array(badge, F.when(fingerprint, "AcoustID")))
    return F.when(F.size(badges) > 0, F.concat(F.lit("["), F.array_join(badges, "+"), F.lit("]"))).otherwise("")


def title_is_dirty(title: Column, track: Column) -> Column:
    """A leading number that is no decimal and repeats the track number or is followed by . or -."""
    number, sign = F.regexp_extract(title, r"^([0-9]+)([ .-]+)", 1), F.regexp_extract(title, r"^([0-9]+)([ .-]+)", 2)
    decimal = title.rlike(r"^[0-9]+[.][0-9]")
    return F.coalesce((number != "") & ~decimal & ((strip_zeros(number) == strip_zeros(track.cast("string"))) | sign.rlike("[.-]")), F.lit(False))


def tag_facts(tags: DataFrame) -> DataFrame:
    """Counts of every check per album, in one aggregation."""
    titled = F.when(F.trim("title") != "", F.trim("title"))
    same = F.count(titled).over(Window.partitionBy("app_id", titled))
    key = F.struct(F.split_part(F.coalesce(F.col("disc_number").cast("string"), F.lit("1")), F.lit("/"), F.lit(1)), F.split_part(F.coalesce(F.col("track_number").cast("string"), F.lit("0")), F.lit("/"), F.lit(1)))
    dirty = title_is_dirty(F.col("title"), F.col("track_number"))
    if "official" in tags.columns:
        dirty = dirty & ~F.coalesce("official", F.lit(False))
    return tags.withColumn("same", F.coalesce(same, F.lit(0))).groupBy("app_id").agg(F.count("*").alias("tracks"), F.count_if(F.col("track_number").cast("string") == "0").alias("zero"), F.count_if(F.coalesce(F.col("title"), F.lit("")).isin("", "Unknown")).alias("unknown"), F.count_if(dirty).alias("dirty"), (F.count("*") - F.countDistinct(key)).alias("duplicates"), F.max("same").alias("repeated"))


def official(tags: DataFrame, titles: DataFrame) -> DataFrame:
    """tags with a flag for titles that (app_id, title) lists, in any case."""
    known = titles.select("app_id", F.lower("title").alias("_k")).distinct().withColumn("official", F.lit(True))
    return tags.withColumn("_k", F.lower("title")).join(known, ["app_id", "_k"], "left").drop("_k")


def check_audio(props: DataFrame) -> DataFrame:
    issue = F.when(F.bool_or("failed"), "CRITICAL: Audio Source Error").when(F.bool_or("had_warning"), "Audio quality warning")
    return props.groupBy("app_id").agg(issue.alias("audio"))


def score_gate(confidence: Column, quality: Column, archive_share: Column, strategy: Column, trusted: Column) -> Column:
    """At most one of three messages."""
    need = F.when(trusted & (confidence >= 100), 75).otherwise(95)
    text = lambda c: c.cast("long").cast("string")
    wants = (archive_share < 50) | (strategy == "REVIEW_REQUIRED")
    return F.when(~((confidence >= 100) & (quality >= need)) & wants, "LLM's decision (Low Confidence/Ratio)").when(quality < need, F.concat(F.lit("Quality too low ("), text(quality), F.lit("%)"))).when(confidence < 100, F.concat(F.lit("Confidence too low ("), text(confidence), F.lit("%)")))


def tag_issues() -> list[Column]:
    """The issues of tag_facts in their fixed order, null where there is none."""
    text = lambda c: F.col(c).cast("string")
    return [
        F.when(F.col("zero") > 0, F.concat(F.lit("Track#0 x"), text("zero"))),
        F.when(F.col("unknown") > 0, F.concat(F.lit("Unknown Title x"), text("unknown"))),
        F.when(F.col("dirty") > 0, F.concat(F.lit("Dirty Tags x"), text("dirty"))),
        F.when(F.col("duplicates") > 0, F.concat(F.lit("Duplicates ("), text("duplicates"), F.lit(")"))),
        F.when((F.col("tracks") > 3) & (2 * F.col("repeated") >= F.col("tracks")), F.concat(F.lit("Duplicate Titles ("), text("repeated"), F.lit("/"), text("tracks"), F.lit(")"))),
    ]


def verdict(facts: DataFrame, *more: Column) -> DataFrame:
    """archive without an issue, else review with the bracketed issues; more: further issues, after those of the tags."""
    issues = F.array_compact(F.array(*tag_issues(), *more))
    return facts.select("app_id", F.when(F.size(issues) > 0, "review").otherwise("archive").alias("status"), F.when(F.size(issues) > 0, F.concat(F.lit("["), F.array_join(issues, ", "), F.lit("]"))).otherwise("Success").alias("message"))


def early_review(albums: DataFrame, responses: DataFrame, files: DataFrame) -> DataFrame:
    """skip without audio; review without an answer or with a low confidence; else null."""
    n = files.groupBy("app_id").agg(F.count("*").alias("n"))
    rows = albums.select("app_id").join(n, "app_id", "left").join(responses, "app_id", "left")
    cause = F.when(F.col("n").isNull(), "no_audio").when(F.col("confidence").isNull(), "response_missing").when(F.col("confidence") < 100, "low_confidence")
    return rows.select("app_id", F.when(cause == "no_audio", "skip").when(cause.isNotNull(), "review").alias("status"), cause.alias("cause"))
