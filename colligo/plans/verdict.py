"""Queries of validation and verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from colligo.operators import judging as J
from colligo.operators import verdict as V
from colligo.plans.judging import PARSED
from colligo.plans.registry import query

TAGS = "tgs as (select app_id, disc as disc_number, coalesce(filename_track, 0) as track_number, trim(regexp_replace(replace(stem, ' (Official)', ''), '^[0-9]+ - ', '')) as title, stem from local_files)"
LEAD = "regexp_extract(stem, '^([0-9]+)', 1)"
FACTS = TAGS + ", top as (select app_id, max(n) as repeated from (select app_id, title, count(*) as n from tgs group by app_id, title) z group by app_id), fac as (select t.app_id, count(*) as tracks, sum(case when track_number = 0 then 1 else 0 end) as zero, count(*) - count(distinct disc_number * 1000 + track_number) as duplicates, max(repeated) as repeated from tgs t join top using (app_id) group by t.app_id)"
ISSUES = "case when zero > 0 then 'Track#0 x' || zero end, case when duplicates > 0 then 'Duplicates (' || duplicates || ')' end, case when tracks > 3 and repeated * 2 >= tracks then 'Duplicate Titles (' || repeated || '/' || tracks || ')' end"
AUDIO = "aud as (select app_id, case when bool_or(failed) then 'CRITICAL: Audio Source Error' when bool_or(had_warning) then 'Audio quality warning' end as audio from audio_props group by app_id)"
GATE = "case when not (confidence >= 100 and quality >= case when strategy = 'STEAM_BASED' and confidence >= 100 then 75 else 95 end) and quality < 50 then 'LLM''s decision (Low Confidence/Ratio)' when quality < case when strategy = 'STEAM_BASED' and confidence >= 100 then 75 else 95 end then 'Quality too low (' || quality || '%)' when confidence < 100 then 'Confidence too low (' || confidence || '%)' end"


def tags(t):
    title = F.trim(F.regexp_replace(F.replace("stem", F.lit(" (Official)"), F.lit("")), "^[0-9]+ - ", ""))
    return t.local_files.select("app_id", F.col("disc").alias("disc_number"), F.coalesce("filename_track", F.lit(0)).alias("track_number"), title.alias("title"))


def stems(t):
    return t.local_files.select("app_id", F.col("disc").alias("disc_number"), F.col("filename_track").alias("track_number"), F.col("stem").alias("title"))


def answers(t):
    return J.parsed_responses(t.judge_responses).select("app_id", F.col("identity_confidence").alias("confidence"), F.col("integrity_quality").alias("quality"), "strategy")


@query("strategy_badges", f"with {PARSED} select app_id, '[' || case strategy when 'STEAM_BASED' then 'Steam Trust' when 'LOCAL_BASED' then 'Steam Fallback' when 'HYBRID' then 'Hybrid (MBZ+Steam)' else 'MBZ Match' end || case when app_id % 3 = 0 then '+AcoustID' else '' end || ']' as badge from par")
def _(t):
    return answers(t).select("app_id", V.strategy_badges(F.col("strategy"), F.lit(False), F.lit(False), F.col("app_id") % 3 == 0).alias("badge"))


@query("check_zero_unknown", f"with {FACTS} select app_id, zero::bigint as zero, 0::bigint as unknown from fac")
def _(t):
    return V.tag_facts(tags(t)).select("app_id", "zero", "unknown")


@query("check_dirty", f"select l.app_id, sum(case when {LEAD} <> '' and not exists (select 1 from store_tracks s where s.app_id = l.app_id and lower(s.title) = lower(l.stem)) then 1 else 0 end)::bigint as dirty from local_files l group by l.app_id")
def _(t):
    return V.tag_facts(V.official(stems(t), t.store_tracks)).select("app_id", "dirty")


@query("check_duplicates", "select app_id, sum(n - 1)::bigint as duplicates from (select app_id, disc, coalesce(filename_track, 0) as no, count(*) as n from local_files group by all) z group by app_id")
def _(t):
    return V.tag_facts(tags(t)).select("app_id", "duplicates")


@query("check_repeated_title", f"with {FACTS} select app_id, repeated, tracks > 3 and repeated * 2 >= tracks as flagged from fac")
def _(t):
    return V.tag_facts(tags(t)).select("app_id", "repeated", ((F.col("tracks") > 3) & (2 * F.col("repeated") >= F.col("tracks"))).alias("flagged"))


@query("check_audio", f"with {AUDIO} select app_id, audio from aud")
def _(t):
    return V.check_audio(t.audio_props)


@query("score_gate", f"with {PARSED} select app_id, {GATE} as issue from par")
def _(t):
    return answers(t).select("app_id", V.score_gate(F.col("confidence"), F.col("quality"), F.col("quality"), F.col("strategy"), F.col("strategy") == "STEAM_BASED").alias("issue"))


@query("album_verdict", f"with {FACTS} select app_id, case when concat_ws(', ', {ISSUES}) = '' then 'archive' else 'review' end as status, case when concat_ws(', ', {ISSUES}) = '' then 'Success' else '[' || concat_ws(', ', {ISSUES}) || ']' end as message from fac")
def album_verdict(t):
    return V.verdict(V.tag_facts(tags(t)))


@query("album_verdict_full", f"with {FACTS}, {AUDIO}, {PARSED}, g as (select app_id, concat_ws(', ', {ISSUES}, audio, {GATE}) as issues from fac join aud using (app_id) join par using (app_id)) select app_id, case when issues = '' then 'archive' else 'review' end as status, case when issues = '' then 'Success' else '[' || issues || ']' end as message from g")
def _(t):
    rows = V.tag_facts(tags(t)).join(V.check_audio(t.audio_props), "app_id").join(answers(t), "app_id")
    gate = V.score_gate(F.col("confidence"), F.col("quality"), F.col("quality"), F.col("strategy"), F.col("strategy") == "STEAM_BASED")
    return V.verdict(rows, F.col("audio"), gate)


@query("early_review", f"with {PARSED}, n as (select distinct app_id from local_files), c as (select a.app_id, case when n.app_id is null then 'no_audio' when confidence is null then 'response_missing' when confidence < 100 then 'low_confidence' end as cause from albums a left join n on n.app_id = a.app_id left join par on par.app_id = a.app_id) select app_id, case when cause = 'no_audio' then 'skip' when cause is not null then 'review' end as status, cause from c")
def _(t):
    return V.early_review(t.albums, answers(t).select("app_id", "confidence"), t.local_files)
