"""Judging of albums, instruction mapping and the resolution of clashing indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from colligo.functions.text import fold

RESPONSE = "struct<identity_confidence:double,integrity_quality:double,strategy:string>"


def payload_sample(tracks: DataFrame, most: int = 20, head: int = 15, tail: int = 5) -> DataFrame:
    """Album payload of (app_id, v_idx, disc, number, title, and credits where given) as JSON.

    Long albums keep first and last tracks and say between them how many are left out.
    """
    w = Window.partitionBy("app_id")
    rows = tracks.withColumn("i", F.row_number().over(w.orderBy("v_idx"))).withColumn("n", F.count("*").over(w))
    kept = rows.where((F.col("n") <= most) | (F.col("i") <= head) | (F.col("i") > F.col("n") - tail))
    given = ["v_idx", "disc", "number", "title", *(["credits"] if "credits" in tracks.columns else [])]
    # The gap's note follows the last track of the head; absent fields are left out of the JSON.
    gap = F.when((F.col("n") > most) & (F.col("i") == head), F.concat(F.lit("... "), (F.col("n") - head - tail).cast("string"), F.lit(" tracks left out ...")))
    made = kept.groupBy("app_id").agg(F.max("n").alias("tracks"), (F.max("n") - F.count("*")).alias("omitted"), F.array_sort(F.collect_list(F.struct(*given, gap.alias("then")))).alias("rows"))
    return made.select("app_id", "tracks", "omitted", F.to_json("rows").alias("payload"))


def chunk_size(base: int, adaptive: bool = False, predict: int = 0, ratio: float = 0.8, tokens_per_track: int = 100) -> int:
    return max(1, min(base, int(predict * ratio) // tokens_per_track)) if adaptive else max(1, base)


def chunk_plan(tracks: DataFrame, size: int, order: str = "v_idx") -> DataFrame:
    i = F.row_number().over(Window.partitionBy("app_id").orderBy(order)) - 1
    return tracks.withColumn("chunk", F.floor(i / size).cast("long"))


def token_estimate(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 3)).cast("long")


def is_cut(done_reason: Column, error: Column) -> Column:
    """Whether a response was cut, by the reason it ended for or the text of its error."""
    return F.lower(done_reason).isin("length", "max_tokens") | F.coalesce(F.lower(error).rlike("truncat|max_tokens|length"), F.lit(False))


def rechunk_truncated(chunks: DataFrame, responses: DataFrame, size: int) -> DataFrame:
    """Chunks (app_id, chunk, v_idx) whose response was cut are split again at half the size."""
    bad = responses.where(is_cut(F.col("done_reason"), F.col("error"))).select("app_id", "chunk")
    i = F.row_number().over(Window.partitionBy("app_id", "chunk").orderBy("v_idx")) - 1
    return chunks.join(bad, ["app_id", "chunk"], "left_semi").withColumn("part", F.floor(i / max(1, size // 2)).cast("long"))


def rechunk_until_whole(tracks: DataFrame, size: int, respond: Callable[[DataFrame], DataFrame], stage: Callable[[DataFrame], DataFrame], order: str = "v_idx") -> DataFrame:
    """Chunks of tracks whose responses came whole: tracks with start, size and round, and the response's columns.

    respond takes tracks with (app_id, start, size) and gives one row (app_id,
    start, done_reason, error, ...) for each chunk; cut ones go again at half the
    size. A chunk of one track stays as it is, cut or not. Sizes halve each round,
    so there are at most floor(log2(size)) + 1 rounds. stage writes a table and
    reads it back, which cuts the lineage between rounds and asks no chunk twice.
    """
    i = (F.row_number().over(Window.partitionBy("app_id").orderBy(order)) - 1).cast("long")
    left = stage(tracks.withColumn("i", i).withColumn("start", (F.floor(F.col("i") / size) * size).cast("long")).withColumn("size", F.lit(size)).withColumn("round", F.lit(0)))
    done: DataFrame | None = None
    number = 0
    while True:
        answered = stage(respond(left))
        bad = answered.where(is_cut(F.col("done_reason"), F.col("error"))).select("app_id", "start")
        bad = bad.limit(0) if size == 1 else bad
        whole = left.join(answered.join(bad, ["app_id", "start"], "left_anti"), ["app_id", "start"])
        done = whole if done is None else done.unionByName(whole)
        if size == 1:
            return done.drop("i")
        size, number = size // 2, number + 1
        again = left.join(bad, ["app_id", "start"], "left_semi")
        left = stage(again.withColumns({"start": (F.col("start") + F.floor((F.col("i") - F.col("start")) / size) * size).cast("long"), "size": F.lit(size), "round": F.lit(number)}))
        if left.isEmpty():
            return done.drop("i")


def salvage_json(raw: Column, kind: str = RESPONSE) -> Column:
    """The object in a model's answer: fences and thoughts dropped, first { to last }, no trailing commas."""
    plain = F.regexp_replace(F.regexp_replace(raw, "(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    return F.from_json(F.regexp_replace(F.regexp_extract(plain, r"(?s)(\{.*\})", 1), r",\s*([}\]])", "$1"), kind)


def parsed_responses(responses: DataFrame) -> DataFrame:
    return responses.select("app_id", salvage_json(F.col("raw")).alias("r")).select("app_id", "r.*")


def default_judge(facts: DataFrame) -> DataFrame:
    """Rule-based verdict of (app_id, store_n, local_n, match_pct): confidence by binding and count agreement."""
    same = (F.col("store_n") == F.col("local_n")) & (F.col("store_n") > 0)
    conf = F.when(same & (F.coalesce("match_pct", F.lit(0.0)) > 80), 100).when(same, 90).when(F.coalesce("match_pct", F.lit(0.0)) > 80, 80).otherwise(50)
    strategy = F.when(same, "STEAM_BASED").when(F.coalesce("match_pct", F.lit(0.0)) > 80, "FINGERPRINT_BASED").otherwise("LOCAL_BASED")
    return facts.select("app_id", conf.alias("confidence"), strategy.alias("strategy"))


def judge_albums(payloads: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 64) -> DataFrame:
    """A user's judge over batches of at most `most` payloads; adds the column error.

    judge takes a frame of payloads and gives one of schema, which begins with the
    payloads' keys of the same names. Where it fails on a batch, halves of the batch are
    judged by themselves, down to the payload that it fails on: that one gets a row with
    its keys, nulls and the error's text, and the job goes on. schema must not name error.
    """
    made = StructType.fromDDL(schema)
    names = made.fieldNames()
    keys = [c for c in names if c in payloads.columns]

    texts = [f.name for f in made.fields if isinstance(f.dataType, StringType)] + ["error"]

    def plain(pdf: pd.DataFrame) -> pd.DataFrame:
        # Texts as objects, however the judge made them: chunked ones do not go back to Spark.
        return pdf.astype(dict.fromkeys(texts, object)).where(pdf.notna(), None) if len(pdf) else pdf

    def judged(pdf: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return [plain(judge(pdf)[names].assign(error=None))]
        except Exception as e:  # noqa: BLE001
            if len(pdf) > 1:
                return judged(pdf.iloc[: len(pdf) // 2]) + judged(pdf.iloc[len(pdf) // 2 :])
            return [plain(pdf[keys].reindex(columns=names).assign(error=f"{type(e).__name__}: {e}"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), most):
                yield from judged(pdf.iloc[at : at + most])

    return payloads.mapInPandas(run, StructType(made.fields).add("error", "string"))


def archive_ratio(share: Column) -> Column:
    """The share of archive in a verdict, in per cent; without one all is for review."""
    return F.coalesce(share.cast("double"), F.lit(0.0))


def structural_trust(a: DataFrame) -> DataFrame:
    """Equal, positive counts lift a confidence under 100, unless a fingerprint exists and it is under 80; a lift replaces archive share, strategy and reason."""
    lift = (F.col("store_n") == F.col("local_n")) & (F.col("local_n") > 0) & (F.col("confidence") < 100) & (~F.col("has_fingerprint") | (F.col("confidence") >= 80))
    return a.select("app_id", F.when(lift, 100.0).otherwise(F.col("confidence")).alias("confidence"), F.when(lift, "STEAM_BASED").otherwise(F.col("strategy")).alias("strategy"), F.when(lift, 100.0).otherwise(archive_ratio(F.col("archive_share"))).alias("archive_share"), F.when(lift, F.concat(F.lit("SYSTEM: STEAM-TRUST, "), F.col("local_n").cast("string"), F.lit(" tracks"))).otherwise(F.col("reason")).alias("reason"), lift.alias("trusted"))


def confidence_gate(confidence: Column) -> tuple[Column, Column]:
    """(percentage, early review): fractions strictly between 0 and 1 are scaled; below 100 goes to review."""
    pct = F.when((confidence > 0) & (confidence < 1), confidence * 100).otherwise(F.coalesce(confidence, F.lit(0.0)))
    return pct, pct < 100


def strict_gate(confidence: Column, archive_share: Column, strategy: Column) -> Column:
    return (confidence < 100) | (archive_share < 90) | (strategy == "REVIEW_REQUIRED")


def structural_hint(store_n: Column, local_n: Column) -> Column:
    return F.when((store_n == 1) & (local_n == 1), "single track on both sides").when((store_n == local_n) & (store_n > 0), "equal track counts")


def explode_instructions(answers: DataFrame, local: DataFrame, refs: DataFrame | None = None, album_tags: DataFrame | None = None) -> DataFrame:
    """Instruction maps by index or exact title to rows of local tracks (app_id, v_idx, title); others are dropped.

    refs (app_id, action, matched_v_idx, catalogue_idx) resolves the index that an
    action of a source gives into the catalogue's; album_tags (app_id and tags) are
    copied to every row of their album.
    """
    rows = answers.select("app_id", F.explode(F.from_json("instructions", "map<string,struct<action:string,matched_v_idx:int>>")).alias("k", "x")).select("app_id", "k", "x.*")
    by_index = rows.where(F.col("k").rlike("^[0-9]+$")).select("app_id", F.col("k").try_cast("long").alias("v_idx"), "action", "matched_v_idx").join(local.select("app_id", "v_idx"), ["app_id", "v_idx"])
    titles = local.groupBy("app_id", "title").agg(F.min("v_idx").alias("v_idx"))
    by_title = rows.where(~F.col("k").rlike("^[0-9]+$")).withColumnRenamed("k", "title").join(titles, ["app_id", "title"]).select("app_id", "v_idx", "action", "matched_v_idx")
    found = by_index.select("app_id", "v_idx", "action", "matched_v_idx").unionByName(by_title)
    if refs is not None:
        found = found.join(refs, ["app_id", "action", "matched_v_idx"], "left")
    return found if album_tags is None else found.join(album_tags, "app_id", "left")


def number_conflict(rows: DataFrame, order: str = "file_no") -> DataFrame:
    """The first claimant of (disc, override_track) keeps its override."""
    n = F.row_number().over(Window.partitionBy("app_id", "disc", "override_track").orderBy(order))
    return rows.withColumn("override_track", F.when(n == 1, F.col("override_track")))


def fast_track(local: DataFrame, release: DataFrame, strong: DataFrame) -> DataFrame:
    """Direct mapping of albums with strong evidence (app_id, mbid), equal counts and only titles that the release has."""
    mine = local.withColumn("key", fold(F.col("title")))
    theirs = release.withColumn("key", fold(F.col("title"))).groupBy("mbid", "key").agg(F.min("position").alias("position"))
    n = local.groupBy("app_id").agg(F.count("*").alias("n"))
    m = release.groupBy("mbid").agg(F.count("*").alias("m"))
    rows = strong.join(n, "app_id").join(m, "mbid").where("n = m").select("app_id", "mbid").join(mine.select("app_id", "v_idx", "key"), "app_id").join(theirs, ["mbid", "key"], "left")
    good = rows.groupBy("app_id", "mbid").agg(F.bool_and(F.col("position").isNotNull()).alias("ok")).where("ok").select("app_id", "mbid")
    return rows.join(good, ["app_id", "mbid"], "left_semi").select("app_id", "mbid", "v_idx", "position")


def _claims(rows: DataFrame) -> DataFrame:
    """Store claims with how many tracks, and how many discs, claim the same index."""
    w = Window.partitionBy("app_id", "matched_v_idx")
    return rows.where("action = 'use_steam' and matched_v_idx is not null").withColumn("claimants", F.count("*").over(w)).withColumn("discs", F.size(F.collect_set("disc").over(w)))


def _same_or_prefix(stem: Column, title: Column) -> Column:
    return (F.lower(title) == F.lower(stem)) | F.startswith(F.lower(title), F.concat(F.lower(stem), F.lit(" "))) | F.startswith(F.lower(stem), F.concat(F.lower(title), F.lit(" ")))


def dup_disc_realign(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Tracks of several discs that claim one index go to the first like store track of their own disc; null if there is none."""
    clash = _claims(rows).where("claimants > 1 and discs > 1")
    s = store.select(F.col("app_id").alias("s_app"), F.col("disc").alias("s_disc"), "v_idx", "title")
    joined = clash.join(s, (F.col("app_id") == F.col("s_app")) & (F.col("disc") == F.col("s_disc")) & _same_or_prefix(F.col("stem"), F.col("title")), "left")
    return joined.groupBy("app_id", "file_no").agg(F.max("matched_v_idx").alias("claimed"), F.min("v_idx").alias("realigned"))


def dup_name_recover(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Tracks of one disc that claim one index go to the first like store track other than the claimed one."""
    clash = _claims(rows).where("claimants > 1 and discs = 1")
    s = store.select(F.col("app_id").alias("s_app"), F.col("disc").alias("s_disc"), "v_idx", "title")
    joined = clash.join(s, (F.col("app_id") == F.col("s_app")) & (F.col("disc") == F.col("s_disc")) & (F.col("v_idx") != F.col("matched_v_idx")) & _same_or_prefix(F.col("stem"), F.col("title")), "left")
    return joined.groupBy("app_id", "file_no").agg(F.max("matched_v_idx").alias("claimed"), F.min("v_idx").alias("recovered"))


def dup_sequence(rows: DataFrame, store: DataFrame) -> DataFrame:
    """Clashing claims of an index that begins a long enough run of store tracks named like it are dealt out along the run."""
    clash = _claims(rows).where("claimants > 1").withColumn("turn", F.row_number().over(Window.partitionBy("app_id", "matched_v_idx").orderBy("file_no")) - 1)
    base = store.select("app_id", F.col("v_idx").alias("matched_v_idx"), F.col("title").alias("base"))
    s = store.select(F.col("app_id").alias("s_app"), F.col("v_idx").alias("s_idx"), "title")
    starts = clash.select("app_id", "matched_v_idx", "claimants").distinct().join(base, ["app_id", "matched_v_idx"])
    after = starts.join(s, (F.col("app_id") == F.col("s_app")) & (F.col("s_idx") >= F.col("matched_v_idx")) & (F.col("s_idx") < F.col("matched_v_idx") + F.col("claimants")) & _same_or_prefix(F.col("base"), F.col("title")))
    runs = after.groupBy("app_id", "matched_v_idx", "claimants").agg(F.count("*").alias("run")).where("run = claimants").select("app_id", "matched_v_idx")
    return clash.join(runs, ["app_id", "matched_v_idx"]).select("app_id", "file_no", F.col("matched_v_idx").alias("claimed"), (F.col("matched_v_idx") + F.col("turn")).alias("dealt"))


def context_budget(chars: Column, tracks: Column | None = None) -> Column:
    need = F.floor(chars / 2.5) + (500 if tracks is None else 100 * tracks)
    return F.when(need <= 2048, 2048).when(need <= 4096, 4096).otherwise(8192)
