"""Virtual albums: one uniform track table per source, votes for releases, and binding by duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell editions apart.
KEYWORDS = ("instrumental", "off vocal", "karaoke", "remix", "arrange")


def v_store(store: DataFrame) -> DataFrame:
    ms = F.when(F.col("duration_s") > 0, (F.col("duration_s") * 1000).cast("long"))
    return store.select("app_id", "v_idx", "disc", F.col("number").alias("track_num"), "title", ms.alias("duration_ms"), F.lit("store").alias("source"))


def v_local(groups: DataFrame) -> DataFrame:
    """Groups (app_id, disc, title, track_num, duration_s) as uniform rows, unnumbered ones last."""
    order = Window.partitionBy("app_id").orderBy("disc", F.coalesce("track_num", F.lit(999)), "title", "file_no")
    return groups.select("app_id", (F.row_number().over(order) - 1).alias("v_idx"), "disc", "track_num", "title", F.round(F.col("duration_s") * 1000).cast("long").alias("duration_ms"), F.lit("local").alias("source"))


def flatten_hits(hits: DataFrame) -> DataFrame:
    """Nested fingerprint responses of tracks (app_id, track_no) to recordings with score, title, first artist and release; failed responses give nothing."""
    kind = "struct<status:string,results:array<struct<score:double,recordings:array<struct<id:string,title:string,artists:array<struct<name:string>>,releases:array<struct<id:string>>>>>>>"
    parsed = hits.select("app_id", "track_no", F.from_json("response_data", kind).alias("r")).where("r.status = 'ok'")
    recordings = parsed.select("app_id", "track_no", F.explode_outer("r.results").alias("x")).select("app_id", "track_no", "x.score", F.explode_outer("x.recordings").alias("rec"))
    # Releases without an id are none.
    releases = F.filter("rec.releases.id", lambda x: x.isNotNull())
    artist = F.try_element_at("rec.artists.name", F.lit(1))
    return recordings.select("app_id", "track_no", "score", F.col("rec.id").alias("recording_id"), F.col("rec.title").alias("title"), artist.alias("artist"), F.explode_outer(releases).alias("release_id"))


def best_recording(hits: DataFrame) -> DataFrame:
    """The recording with the highest score of each track; ties by recording."""
    return hits.groupBy("app_id", "track_no").agg(F.min_by(F.struct("recording_id", "acoustid_score"), F.struct(-F.col("acoustid_score"), "recording_id")).alias("b")).select("app_id", "track_no", "b.*")


def sample_tracks(tracks: DataFrame, order: str, full: bool = False) -> DataFrame:
    """First, middle and last track of albums of more than three; all if full."""
    w = Window.partitionBy("app_id")
    rows = tracks.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    keep = F.lit(full) | (F.col("_n") <= 3) | (F.col("_i") == 0) | (F.col("_i") == F.floor(F.col("_n") / 2)) | (F.col("_i") == F.col("_n") - 1)
    return rows.where(keep).drop("_i", "_n")


def release_votes(hits: DataFrame) -> DataFrame:
    return hits.groupBy("app_id", "release_id").agg((10 * F.count("*")).alias("votes"))


def named_words(title: Column) -> Column:
    """The keywords in a title as bits, the first one lowest."""
    text = F.lower(title)
    return sum((F.when(F.contains(text, F.lit(k)), 1 << i).otherwise(0) for i, k in enumerate(KEYWORDS)), F.lit(0))


def album_facts(local: DataFrame) -> DataFrame:
    """(app_id, n, words): how many titles an album has, and the keywords that stand in any of them."""
    return local.select("app_id", named_words(F.col("title")).alias("words")).groupBy("app_id").agg(F.count("*").alias("n"), F.bit_or("words").alias("words"))


def release_facts(releases: DataFrame) -> DataFrame:
    return releases.select(F.col("mbid").alias("release_id"), "tracks", named_words(F.col("title")).alias("r_words"))


def release_bonus() -> Column:
    """50 for an equal track count, 30 for each keyword in both names."""
    return F.when(F.col("tracks") == F.col("n"), 50).otherwise(0) + 30 * F.bit_count(F.col("words").bitwiseAND(F.col("r_words")))


def best_release(scored: DataFrame) -> DataFrame:
    """The release of the highest score of each album; ties by release."""
    return scored.groupBy("app_id").agg(F.min_by(F.struct("release_id", "score"), F.struct(-F.col("score"), "release_id")).alias("b")).select("app_id", "b.*")


def release_winner(votes: DataFrame, local: DataFrame, releases: DataFrame) -> DataFrame:
    """Best release per album: votes, 50 for an equal track count, 30 for each keyword in both names; ties by release."""
    scored = votes.join(release_facts(releases), "release_id").join(album_facts(local), "app_id")
    return best_release(scored.select("app_id", "release_id", (F.col("votes") + release_bonus()).alias("score")))


def heard_winner(heard: DataFrame, holders: DataFrame, local: DataFrame, releases: DataFrame) -> DataFrame:
    """release_winner of hits that are not yet put together: recordings heard in an album (app_id, recording_id) and the releases that hold them (recording_id, release_id).

    Facts of albums and of releases go along on either side, each in proportion to
    its own rows, so that the hits, which are many times as many, are shuffled once.
    """
    mine = heard.select("app_id", "recording_id").join(album_facts(local), "app_id")
    theirs = holders.select("recording_id", "release_id").join(release_facts(releases), "release_id")
    hits = mine.join(theirs, "recording_id").select("app_id", "release_id", release_bonus().cast("int").alias("bonus"))
    scored = hits.repartition("app_id").groupBy("app_id", "release_id").agg((10 * F.count("*") + F.max("bonus")).alias("score"))
    return best_release(scored)


def release_common(hits: DataFrame) -> DataFrame:
    """Releases in the hit list of every track of the album that has hits."""
    tracks = hits.select("app_id", "track_no").distinct().groupBy("app_id").agg(F.count("track_no").alias("n"))
    # Both counts of an album are made where its hits are, which are shuffled once.
    met = hits.select("app_id", "release_id", "track_no").repartition("app_id").groupBy("app_id", "release_id").agg(F.countDistinct("track_no").alias("c"))
    return met.join(tracks, "app_id").where("c = n").select("app_id", "release_id")


def credits_pivot(credits: DataFrame) -> DataFrame:
    """Names of each role of a recording, comma-joined, null if none."""
    roles = ["composer", "lyricist", "arranger", "remixer"]
    names = F.array_join(F.array_sort(F.collect_set("name")), ", ")
    made = credits.groupBy("mbid", "recording_id").pivot("role", roles).agg(names)
    return made.select("mbid", "recording_id", *[F.nullif(F.col(r), F.lit("")).alias(r) for r in roles])


def bind_by_duration(local: DataFrame, chosen: DataFrame, release_tracks: DataFrame, within_ms: int = 3000) -> DataFrame:
    """Each local track (app_id, v_idx, duration_ms) with the release track of the smallest gap under within_ms, first on ties; nulls if none.

    The tracks of the chosen release come to the album as a list, so that local tracks are not shuffled by release.
    """
    r = release_tracks.groupBy(F.col("mbid").alias("release_id")).agg(F.collect_list(F.struct("position", "recording_id", F.col("duration_ms").alias("r_ms"))).alias("r_tracks"))
    albums = chosen.select("app_id", "release_id").join(r, "release_id", "left")
    gaps = F.transform("r_tracks", lambda x: F.struct(F.abs(F.col("duration_ms") - x["r_ms"]).alias("gap_ms"), x["position"].alias("position"), x["recording_id"].alias("recording_id")))
    best = F.array_min(F.filter(gaps, lambda x: x["gap_ms"] < within_ms))
    tracks = local.select("app_id", "v_idx", "duration_ms").join(albums, "app_id").select("app_id", "v_idx", "release_id", best.alias("b"))
    return tracks.select("app_id", "v_idx", "release_id", "b.position", "b.recording_id", "b.gap_ms")


def match_ratio(bound: DataFrame) -> DataFrame:
    share = F.round(F.count("position") * 100.0 / F.count("*"), 1).cast("double")
    return bound.groupBy("app_id").agg(share.alias("match_pct"), F.when(F.count("position") * 100.0 / F.count("*") > 80, "HIGH").otherwise("LOW").alias("level"))


def v_search(ranked: DataFrame, release_tracks: DataFrame, least: int = 250) -> DataFrame:
    """Tracks of the top candidate, if it scores at least `least`; all on disc 1."""
    top = ranked.where((F.col("rank") == 1) & (F.col("score") >= least)).select("app_id", "mbid", "score")
    return top.join(release_tracks, "mbid").select("app_id", "mbid", F.lit(1).alias("disc"), F.col("position").alias("track_num"), "title", "duration_ms")


def cross_verify(fingerprint: DataFrame, search: DataFrame) -> DataFrame:
    """One row per source album; where both winners agree, one of source VERIFIED.

    If search has evidence (an array of notes), rows carry it: a verified album has the
    search's with one note more, a fingerprint album none.
    """
    noted = "evidence" in search.columns
    f, s = fingerprint.select("app_id", F.col("release_id").alias("f_id")), search.select("app_id", F.col("mbid").alias("s_id"), *(["evidence"] if noted else []))
    both = f.join(s, "app_id", "full_outer")
    notes = F.coalesce("evidence", F.array().cast("array<string>")) if noted else F.array().cast("array<string>")
    row = lambda source, of, evidence: F.struct(F.lit(source).alias("source"), F.col(of).alias("id"), evidence.alias("evidence"))
    one = row("VERIFIED", "f_id", F.concat(notes, F.array(F.lit("audio_and_text_agree"))))
    two = F.array_compact(F.array(F.when(F.col("f_id").isNotNull(), row("FINGERPRINT", "f_id", F.array().cast("array<string>"))), F.when(F.col("s_id").isNotNull(), row("SEARCH", "s_id", notes))))
    rows = F.when(F.col("f_id") == F.col("s_id"), F.array(one)).otherwise(two)
    out = both.select("app_id", F.explode(rows).alias("r")).select("app_id", "r.*")
    return out if noted else out.drop("evidence")


def candidate_for_merge(fingerprint: DataFrame, search: DataFrame) -> DataFrame:
    """Fingerprint album with the fixed score 1000, else the search album."""
    f, s = fingerprint.select("app_id", F.col("release_id").alias("f_id")), search.select("app_id", "mbid", "score")
    return f.join(s, "app_id", "full_outer").select("app_id", F.coalesce("f_id", "mbid").alias("id"), F.when(F.col("f_id").isNotNull(), 1000).otherwise(F.col("score")).cast("long").alias("score"))
