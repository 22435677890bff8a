"""Queries of ledger analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from colligo.operators import ledger as L
from colligo.plans.registry import query, scratch
from colligo.plans.scoring import FACTS, evidence

CAUSE = "case when lower(confidence_reason) like '%timeout%' or (tracks_len = 0 and confidence_score >= 90) then 'timeout' when confidence_score < 90 then 'low_confidence' else 'validator' end"


def titled(t):
    names = t.local_files.groupBy("app_id").agg(F.min("stem").alias("title"))
    return t.ledger.where("status = 'archive'").join(names, "app_id").select("app_id", "album_name", "title")


@query("status_counts", "select status, count(*) as albums from ledger group by status")
def _(t):
    return L.status_counts(t.ledger)


@query("status_share", "select status, count(*) as albums, round(100.0 * count(*) / (select count(*) from ledger), 1)::double as pct from ledger group by status")
def _(t):
    return L.status_share(t.ledger)


@query("history_top", "select app_id, status, album_name, processed_at, confidence_score from ledger order by processed_at desc, app_id desc limit 20")
def _(t):
    return L.history_top(t.ledger)


@query("album_detail", "select l.app_id, l.status, f.file_no, f.filename_track as track_number, f.stem as title from ledger l left join (select app_id, file_no, coalesce(filename_track, 0) as filename_track, stem from local_files where coalesce(filename_track, 0) = 0) f on f.app_id = l.app_id where l.app_id = 7")
def _(t):
    tags = t.local_files.select("app_id", "file_no", F.coalesce("filename_track", F.lit(0)).alias("track_number"), F.col("stem").alias("title"))
    return L.album_detail(t.ledger, tags, 7)


@query("recent_window", "select app_id, status, processed_at from ledger where processed_at >= (select max(processed_at) from ledger) - interval 2400 hour")
def _(t):
    return L.recent_window(t.ledger, F.lit(t.ledger.agg(F.max("processed_at")).first()[0]), 2400)


@query("review_causes", f"with r as (select *, {CAUSE} as cause from ledger where status <> 'archive'), f as (select *, row_number() over (partition by cause order by app_id) as n from r) select cause, count(*) as albums, string_agg(album_name, '; ' order by app_id) filter (where n <= 3) as names from f group by cause")
def _(t):
    return L.review_causes(t.ledger)


@query("archive_audit", "select case when confidence_reason like '%STEAM-TRUST%' then 'trust' else 'other' end as path, count(*) as archives, count(*) filter (where confidence_score < 95) as below_95 from ledger where status = 'archive' group by 1")
def _(t):
    return L.archive_audit(t.ledger)


@query("issue_histogram", "with i as (select app_id, unnest(string_split(trim(message, '[]'), ', ')) as i from ledger where message <> '') select trim(regexp_replace(i, ' x[0-9]+$| \\([^)]*\\)$', '')) as issue, count(distinct app_id) as albums from i group by 1")
def _(t):
    return L.issue_histogram(t.ledger)


@query("odd_archives")
def _(t):
    return L.odd_archives(titled(t))


@query("odd_archives_lev", "with x as (select l.app_id, album_name, min(stem) as title from ledger l join local_files f on f.app_id = l.app_id where status = 'archive' group by l.app_id, album_name) select app_id, album_name, title, round(1.0::double - levenshtein(lower(album_name), lower(title)) / greatest(length(album_name), length(title))::double, 4) as likeness from x where round(1.0::double - levenshtein(lower(album_name), lower(title)) / greatest(length(album_name), length(title))::double, 4) < 0.4")
def _(t):
    return L.odd_archives(titled(t), exact=False)


@query("odd_reviews", "select count(*) filter (where confidence_score >= 100) as odd, count(*) as reviews, round(count(*) filter (where confidence_score >= 100) * 100.0 / count(*), 1)::double as pct from ledger where status = 'review'")
def _(t):
    return L.odd_reviews(t.ledger)


@query("cause_codes", "select status, coalesce(nullif(confidence_reason, ''), 'none') as code, count(*) as albums, count(*) filter (where status = 'review' and message = '') as without_message from ledger group by 1, 2")
def _(t):
    return L.cause_codes(t.ledger)


def _code(path):
    return f"coalesce(nullif(case when json_valid(payload) then json_extract_string(payload, '$.{path}') end, ''), 'none')"


@query("payload_codes", f"select status, {_code('strategy')} as strategy, {_code('diagnostics.review_cause_code')} as cause, {_code('diagnostics.upstream_cause_code')} as upstream, count(*) as albums, count(*) filter (where status = 'review' and {_code('message')} = 'none') as without_message, count(*) filter (where payload is not null and not json_valid(payload)) as malformed from ledger_json group by all")
def _(t):
    path = scratch(t.spark, "ledger")
    L.stored_payloads(t.ledger_json).write.parquet(path)
    return L.payload_codes(t.spark.read.parquet(path))


@query("notification_fields", f"with {FACTS} select l.app_id, case when status = 'review' then 'warning' else 'info' end as level, 'ID: ' || confidence_score || '% / Qual: ' || (l.app_id * 13 % 101) || '%' as identity, 'Arch ' || case when l.app_id % 2 = 0 then l.app_id % 101 else 0 end || '% : Rev ' || (100 - case when l.app_id % 2 = 0 then l.app_id % 101 else 0 end) || '%' as ratio, b.title || ' (' || b.mbid || ', score ' || b.score || ')' as top_candidate, message, confidence_reason as reason from ledger l left join (select * from bst where rank = 1) b on b.app_id = l.app_id where tracks_len > 0")
def _(t):
    judged = t.ledger.withColumns({"quality": F.col("app_id") * 13 % 101, "archive_share": F.when(F.col("app_id") % 2 == 0, F.col("app_id") % 101)})
    return L.notification_rows(judged, t.ledger.where("tracks_len = 0"), evidence(t).where("rank = 1"))


@query("review_list", "select app_id, album_name, message from ledger where status = 'review'")
def _(t):
    return L.review_list(t.ledger)


@query("track_report", "select app_id, file_no, disc_number, track_number, row_number() over (partition by app_id order by coalesce(try_cast(split_part(disc_number, '/', 1) as int), 99), coalesce(try_cast(split_part(track_number, '/', 1) as int), 99), file_no) as place from embedded_tags")
def _(t):
    return L.track_report(t.embedded_tags).select("app_id", "file_no", "disc_number", "track_number", "place")


@query("notification_rows", "select app_id, case when status = 'review' then 'warning' else 'info' end as level, 'ID: ' || confidence_score || '%' as identity, message, confidence_reason as reason from ledger where tracks_len > 0")
def _(t):
    return L.notification_rows(t.ledger, t.ledger.where("tracks_len = 0"))


@query("ledger_vs_output", "select app_id, 'no_output' as kind from ledger where status = 'review' and app_id not in (select app_id from store_tracks where app_id % 3 = 0) union all select distinct app_id, 'no_review' from store_tracks where app_id % 3 = 0 and app_id not in (select app_id from ledger where status = 'review')")
def _(t):
    return L.ledger_vs_output(t.ledger, t.store_tracks.where("app_id % 3 = 0"))
