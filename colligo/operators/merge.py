"""Field-level merge: every final tag from its sources by priority.

Input is one row per file with the sources side by side: file (stem,
filename_track, disc), embedded tags (e_*), store (s_*), release (r_*) and album.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.functions.text import blank_to_null, clean_title, first_int, fold, four_digits, junk_to_null

# Default priorities of the sources of each tag, and the trusted ones.
PRIORITY = {"title": ("MBZ", "PICS_API", "FILE", "EMBED"), "artist": ("MBZ", "PICS_API", "EMBED"), "track": ("PICS_API", "MBZ", "FILE", "EMBED"), "disc": ("PICS_API", "EMBED", "MBZ"), "year": ("MBZ", "EMBED"), "label": ("MBZ", "PICS_API")}
TRUSTED = ("MBZ", "PICS_API")
OVERRIDE, FOLDER = "LLM_OVERRIDE", "VDF"
CREDITS = (r"Composer:[ \t]*([^\n]*)", r"Music by[ \t]*([^\n]*)", r"Music:[ \t]*([^\n]*)", r"Sound by[ \t]*([^\n]*)", r"Soundtrack by[ \t]*([^\n]*)")


def match_store_track(files: DataFrame, store: DataFrame) -> DataFrame:
    """Store track of files (app_id, file_no, stem, action, matched_v_idx): by index for the store action, by folded title or prefix for the fingerprint one."""
    return placed(files, store).select("app_id", "file_no", "v_idx")


def placed(files: DataFrame, store: DataFrame) -> DataFrame:
    """match_store_track with what the store has of the track (s_title and, where given, s_number and s_disc); files and store meet once, by album."""
    given = {f"s_{c}": c for c in ("title", "number", "disc") if c in store.columns}
    s = store.select(F.col("app_id").alias("s_app"), "v_idx", *[F.col(c).alias(k) for k, c in given.items()], fold(F.col("title")).alias("key"))
    by_index = F.col("action") == "use_steam"
    own = files.where("action in ('use_steam', 'use_fingerprint')").withColumn("own", fold(F.col("stem")))
    exact = F.col("own") == F.col("key")
    prefix = F.startswith(F.lower("stem"), F.concat(F.lower("s_title"), F.lit(" ")))
    met = own.join(s, (F.col("app_id") == F.col("s_app")) & F.when(by_index, F.col("matched_v_idx") == F.col("v_idx")).otherwise(exact | prefix))
    rank = F.struct(F.when(by_index | exact, 0).otherwise(1), "v_idx")
    # Claims of an index are each kept, titles have one track.
    best = met.groupBy("app_id", "file_no", "action", F.when(by_index, F.col("matched_v_idx"))).agg(F.min_by(F.struct("v_idx", *given), rank).alias("b"))
    return best.select("app_id", "file_no", "b.*")


def match_release_track(files: DataFrame, chosen: DataFrame, release_tracks: DataFrame) -> DataFrame:
    """Release track of fingerprint files: the chosen album's track at the action's index (from 0)."""
    r = release_tracks.select(F.col("mbid").alias("release_id"), "position", F.col("title").alias("r_title"), F.col("disc").alias("r_disc"))
    own = files.where("action = 'use_fingerprint'").join(chosen.select("app_id", "release_id"), "app_id")
    return own.join(r, (own["release_id"] == r["release_id"]) & (F.col("position") == F.col("matched_v_idx") + 1)).select("app_id", "file_no", "position", "r_title", "r_disc")


def by_priority(tag: str, sources: dict[str, Column]) -> Column:
    return F.coalesce(*[sources[s] for s in PRIORITY[tag] if s in sources])


def merge_title() -> Column:
    """struct(value, source): the judge's override, else the first non-blank title, of which a long pair joined by ' / ' is cut to its first half, else the folder's."""
    sources = {"MBZ": "r_title", "PICS_API": "s_title", "FILE": "stem", "EMBED": "e_title"}
    given = F.when(F.col("override_title") != "", F.struct(F.trim("override_title").alias("value"), F.lit(OVERRIDE).alias("source")))
    picked = by_priority("title", {k: F.when(blank_to_null(F.col(c)).isNotNull(), F.struct(F.col(c).alias("value"), F.lit(k).alias("source"))) for k, c in sources.items()})
    value = F.when((F.length(picked["value"]) > 60) & F.contains(picked["value"], F.lit(" / ")), F.split_part(picked["value"], F.lit(" / "), F.lit(1))).otherwise(picked["value"])
    folder = F.struct(F.trim(F.coalesce("v_title", F.lit(""))).alias("value"), F.lit(FOLDER).alias("source"))
    return F.coalesce(given, F.when(picked.isNotNull(), F.struct(F.trim(value).alias("value"), picked["source"].alias("source"))), folder)


def merge_artist() -> Column:
    named = F.nullif(F.trim(F.regexp_extract("store_credits", r"(?i)artist:[ ]*([^\n]*)", 1)), F.lit(""))
    return F.coalesce(by_priority("artist", {"MBZ": blank_to_null(F.col("r_artist")), "PICS_API": F.coalesce(named, F.col("developer")), "EMBED": F.col("e_artist")}), F.col("developer"), F.lit("Various Artists"))


def merge_track_no() -> Column:
    usable = lambda c: F.nullif(c.cast("int"), F.lit(0))
    return F.coalesce(usable(F.col("override_track")), by_priority("track", {"PICS_API": usable(F.col("s_number")), "MBZ": usable(F.col("r_position")), "FILE": usable(F.col("filename_track")), "EMBED": usable(first_int(F.col("e_track")))}), F.lit(0))


def merge_disc_no() -> tuple[Column, Column]:
    """(disc, total): the judge's override, else by priority, n/N texts split; the total is the largest number seen."""
    disc = F.coalesce(F.nullif(F.col("override_disc").cast("int"), F.lit(0)), by_priority("disc", {"PICS_API": F.col("s_disc").cast("int"), "EMBED": first_int(F.col("e_disc")), "MBZ": F.col("r_disc").cast("int")}), F.col("disc").cast("int"), F.lit(1))
    return disc, F.greatest(disc, F.coalesce(first_int(F.col("e_disc"), 2), F.lit(1)), F.coalesce(F.col("disc").cast("int"), F.lit(1)))


def merge_year() -> Column:
    return F.coalesce(by_priority("year", {"MBZ": four_digits(F.col("r_date")), "EMBED": four_digits(F.col("e_year"))}), four_digits(F.col("release_date")), F.lit("0000"))


def merge_label() -> Column:
    """First label that means something, else developer and publisher, without the missing ones."""
    return F.coalesce(junk_to_null(F.col("r_label")), junk_to_null(F.col("s_label")), F.concat_ws(", ", "developer", "publisher"))


def merge_composer() -> Column:
    found = [F.nullif(F.trim(F.regexp_extract("store_credits", f"(?i){p}", 1)), F.lit("")) for p in CREDITS]
    return F.coalesce(F.col("r_composer"), *found, F.col("developer"), F.lit("Unknown"))


def trusted_clean(title: Column, source: Column, track: Column) -> Column:
    return F.when(source.isin(*TRUSTED, OVERRIDE), title).otherwise(clean_title(title, track))


def merge_genre(own: Column, parent: Column) -> Column:
    return F.concat(F.lit("STEAM VGM, "), F.coalesce(blank_to_null(own), blank_to_null(parent), F.lit("Soundtrack")))


def build_comment(name: Column, tags: Column, app_id: Column, existing: Column, site: str = "https://store.example.com/app/") -> Column:
    """name, [tags], id, url; tags is an array."""
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("["), F.array_join(tags, "/ "), F.lit("]"))).otherwise("")
    new = F.concat(name, F.lit(", "), listed, F.lit(", "), app_id.cast("string"), F.lit(", "), F.lit(site), app_id.cast("string"))
    return F.when(blank_to_null(existing).isNotNull(), F.concat(existing, F.lit(", "), new)).otherwise(new)


def utf16_size(c: Column) -> Column:
    """Bytes in UTF-16 with a byte-order mark."""
    return F.octet_length(F.encode(c, "UTF-16"))


def prune_comment(tags: Column, most: int = 2000, between: str = "/ ") -> Column:
    """The longest prefix of the tags whose joined text fits."""
    fits = F.filter(F.sequence(F.size(tags), F.lit(0), F.lit(-1)), lambda n: utf16_size(F.array_join(F.slice(tags, 1, n), between)) <= most)
    return F.slice(tags, 1, F.element_at(fits, 1))


def final_tags(rows: DataFrame, language: str = "eng") -> DataFrame:
    """All tags of every file; comment and grouping speak of the parent, where one is known (parent_name), and its tags."""
    disc, total = merge_disc_no()
    about = F.coalesce("parent_name", "name")
    tags = F.coalesce(F.when(F.size("parent_tags") > 0, F.col("parent_tags")), F.col("tags"), F.array().cast("array<string>"))
    made = rows.withColumn("t", merge_title()).withColumn("track_no", merge_track_no())
    return made.select("app_id", "file_no", trusted_clean(F.col("t.value"), F.col("t.source"), F.col("track_no")).alias("title"), F.col("t.source").alias("title_source"), merge_artist().alias("artist"), F.col("name").alias("album"), F.col("developer").alias("album_artist"), F.col("track_no").alias("track_number"), disc.alias("disc_number"), total.alias("total_discs"), merge_year().alias("year"), merge_label().alias("label"), merge_composer().alias("composer"), merge_genre(F.col("genre"), F.col("parent_genre")).alias("genre"), build_comment(about, tags, F.coalesce(F.when(F.col("parent_name").isNotNull(), F.col("parent_app_id")), F.col("app_id")), F.col("e_comment")).alias("comment"), F.concat(about, F.lit(", Store")).alias("grouping"), F.lit(language).alias("language"), F.col("action"))


def artwork_source(rows: DataFrame) -> DataFrame:
    """Per album which source gives the artwork, by priority MBZ, PICS_API, WEB_API, EMBED; for EMBED the first file that has one."""
    flags = rows.groupBy("app_id").agg(F.bool_or("has_mbz").alias("m"), F.bool_or("has_pics").alias("p"), F.min(F.when(F.col("has_embedded"), F.col("file_no"))).alias("file_no"))
    source = F.when(F.col("m"), "MBZ").when(F.col("p"), "PICS_API").when(F.col("file_no").isNotNull(), "EMBED")
    return flags.select("app_id", source.alias("source"), F.when(source == "EMBED", F.col("file_no")).alias("file_no"))


def conversion_plan(props: DataFrame) -> DataFrame:
    """Target container, rate and depth of every file; rate and depth only where they exceed the caps."""
    fmt = F.col("sample_fmt")
    named = F.when(F.contains(fmt, F.lit("16")), 16).when(F.contains(fmt, F.lit("24")), 24).when(F.contains(fmt, F.lit("32")) | F.contains(fmt, F.lit("flt")), 32).when(F.contains(fmt, F.lit("dbl")) | F.contains(fmt, F.lit("64")), 64).otherwise(0)
    depth = F.when(F.col("bits") > 0, F.col("bits")).otherwise(named)
    lossless = F.lower("fmt").isin("flac", "wav", "aiff", "alac", "aif")
    return props.select("app_id", "file_no", F.when(lossless, "aiff").otherwise("mp3").alias("container"), F.when(lossless & (F.col("sample_rate") > 48000), 48000).alias("to_rate"), F.when(lossless & (depth > 24), 24).alias("to_depth"))
