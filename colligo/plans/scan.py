"""Queries of scan, sources and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from colligo.operators import scan as S
from colligo.plans.registry import query, scratch
from colligo.sources import tables as T

NOW = "timestamp '2024-06-01 00:00:00'"


@query("list_media", "select app_id, file_no, win_path, fmt from local_files where fmt in ('flac','wav','mp3','ogg','aac','m4a','aiff','aif') and not regexp_matches(win_path, '\\\\\\.[^\\\\]*$') and win_path not like '%__MACOSX%'")
def _(t):
    return S.list_media(t.local_files, "win_path", "fmt").select("app_id", "file_no", "win_path", "fmt")


@query("normalize_path", "select app_id, file_no, '/mnt/' || lower(left(win_path, 1)) || '/' || replace(substr(win_path, 4), chr(92), '/') as path from local_files")
def _(t):
    return t.local_files.select("app_id", "file_no", S.normalize_path(F.col("win_path")).alias("path"))


@query("manifest_source", "select app_id, content_type, nullif(app_type, '') as app_type, name from manifests")
def _(t):
    return t.manifests.select("app_id", "content_type", S.blank_to_null(F.col("app_type")).alias("app_type"), "name")


@query("payload_extract", "select event_id, service, try_cast(json_extract_string(response_data, '$.k') as bigint) as k from api_cache")
def _(t):
    return t.api_cache.select("event_id", "service", S.payload_field(F.col("response_data"), "k").alias("k"))


@query("ledger_upsert", "with n as (select app_id, 'archive' as status, album_name, processed_at + interval 1 day as processed_at from ledger where app_id % 5 = 0) select app_id, status, album_name, processed_at from ledger where app_id % 5 <> 0 union all select * from n")
def _(t):
    old = t.ledger.select("app_id", "status", "album_name", "processed_at")
    new = old.where("app_id % 5 = 0").withColumn("status", F.lit("archive")).withColumn("processed_at", F.col("processed_at") + F.expr("interval 1 day"))
    return S.upsert(old, new, ["app_id"], ["processed_at"])


@query("store_upsert", "select app_id, case when app_id % 4 = 0 then 2 else 1 end as change_number, tracks_json from tracklist_json")
def _(t):
    old = t.tracklist_json.select("app_id", F.lit(1).alias("change_number"), "tracks_json")
    new = old.where("app_id % 4 = 0 and tracks_json <> ''").withColumn("change_number", F.lit(2))
    return S.upsert(old, new, ["app_id"], ["change_number"])


@query("cache_upsert", "select service, query_key, max(event_id) as event_id from (select *, max(fetched_at) over (partition by service, query_key) as m from api_cache) x where fetched_at = m group by service, query_key")
def _(t):
    c = t.api_cache.select("service", "query_key", "event_id", "fetched_at")
    return S.upsert(c.where("event_id % 2 = 0"), c.where("event_id % 2 = 1"), ["service", "query_key"], ["fetched_at", "event_id"]).select("service", "query_key", "event_id")


@query("cache_lookup", "with l as (select distinct on (service, query_key) service, query_key, response_data, fetched_at from api_cache order by service, query_key, fetched_at desc, event_id desc), w as (select distinct service, query_key from api_cache), m as (select max(fetched_at) as now from api_cache) select w.service, w.query_key, l.response_data, l.fetched_at is not null as hit from w left join (select l.* from l, m where fetched_at >= now - interval 30 day) l on l.service = w.service and l.query_key = w.query_key")
def _(t):
    now = F.lit(t.api_cache.agg(F.max("fetched_at")).first()[0])
    return S.cache_lookup(t.api_cache.select("service", "query_key").distinct(), t.api_cache, now).select("service", "query_key", "response_data", "hit")


@query("write_by_status", "select app_id, status, app_id || '_' || regexp_replace(album_name, '[^\\p{L}\\p{N}._-]', '_', 'g') as item from ledger where status in ('archive','review') and app_id % 3 > 0")
def _(t):
    folder = scratch(t.spark, "items")
    done = t.ledger.where("status in ('archive', 'review')")
    T.write_by_status(done, folder, version=0)
    for _ in range(2):
        T.write_by_status(done.where("app_id % 3 > 0"), folder, version=1)
    parts = [T.read_by_status(t.spark, folder, s) for s in ("archive", "review")]
    return parts[0].unionByName(parts[1]).select("app_id", "status", "item")


@query("upsert_table", "with h as (select app_id, status, processed_at, app_id % 3 as wave from ledger) select app_id, case when wave = 1 and app_id % 2 = 0 then 'archive' else status end as status, case when wave = 1 and app_id % 2 = 0 then processed_at + interval 1 day else processed_at end as processed_at from h")
def _(t):
    rows = t.ledger.select("app_id", "status", "processed_at")
    table = T.UpsertTable(t.spark, scratch(t.spark, "table"), "app_id long, status string, processed_at timestamp_ntz", ["app_id"], ["processed_at"])
    later = rows.where("app_id % 3 = 1 and app_id % 2 = 0").withColumns({"status": F.lit("archive"), "processed_at": F.col("processed_at") + F.expr("interval 1 day")})
    for version, batch in enumerate([rows.where("app_id % 3 > 0"), later, rows, later]):
        table.upsert(batch.select("app_id", "status", F.col("processed_at").cast("timestamp_ntz").alias("processed_at")), version)
    table.vacuum(keep=1)
    return table.read()


@query("output_path", "select app_id, file_no, 'disc_' || disc || '/' || stem || case when fmt in ('flac','wav','aiff','alac','aif') then '.aiff' else '.mp3' end as path from local_files")
def _(t):
    return t.local_files.select("app_id", "file_no", S.output_path(F.col("disc"), F.col("stem"), F.col("fmt")).alias("path"))


@query("is_soundtrack", "select app_id, name from manifests where content_type = '3' or app_type in ('Music','Soundtrack') or name ilike '%soundtrack%' or name ilike '% ost%'")
def _(t):
    return S.is_soundtrack(t.manifests).select("app_id", "name")


@query("target_filter", "select app_id, name from manifests where app_id in (select app_id from ledger where status = 'review')")
def _(t):
    return S.target_filter(t.manifests, t.ledger.where("status = 'review'")).select("app_id", "name")


@query("unprocessed", "select app_id, name from manifests m where not exists (select 1 from ledger l where l.app_id = m.app_id and l.status <> 'skip')")
def _(t):
    return S.unprocessed(t.manifests, t.ledger.where("status <> 'skip'")).select("app_id", "name")


@query("scan_limit", "select app_id, name from manifests where content_type = '3' or app_type = 'Music' or name like '%Soundtrack%' or name like '% OST%' order by app_id limit 50")
def _(t):
    return S.scan_limit(S.is_soundtrack(t.manifests), 50).select("app_id", "name")


@query("install_dir", "with o as (select app_id, r, 'dir' || ((app_id + r) % 7) as dir from manifests, range(4) x(r)), e as (select 'dir' || r as dir from range(3) x(r)) select app_id, coalesce(min_by(dir, r) filter (dir in (select dir from e)), min_by(dir, r)) as dir from o group by app_id")
def _(t):
    options = t.manifests.select("app_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank")).withColumn("dir", F.concat(F.lit("dir"), ((F.col("app_id") + F.col("rank")) % 7).cast("string")))
    existing = t.spark.range(3).select(F.concat(F.lit("dir"), F.col("id").cast("string")).alias("dir"))
    return S.install_dir(options, existing)


@query("tag_labels", "select app_id, string_agg(label, ', ' order by pos, label) as labels from tag_ids join tag_labels using (tag_id) group by app_id")
def _(t):
    return S.tag_labels(t.tag_ids, t.tag_labels)


@query("parent_enrich", "with g as (select app_id, string_agg(label, ', ' order by pos, label) as labels from tag_ids join tag_labels using (tag_id) group by app_id) select a.app_id, a.name, p.name as parent_name, coalesce(case when g.app_id % 2 = 0 then g.labels end, 'cached ' || c.app_id) as parent_tags, c.cached_genre || ', ' || c.local_genre as parent_genres, c.cached_genre as parent_genre from albums a left join albums p on p.app_id = a.parent_app_id left join g on g.app_id = a.parent_app_id left join (select * from tier_fields where cached_genre is not null) c on c.app_id = a.parent_app_id")
def _(t):
    cache = t.tier_fields.where("cached_genre is not null").select("app_id", F.concat(F.lit("cached "), F.col("app_id").cast("string")).alias("cached_labels"), F.array("cached_genre", "local_genre").alias("genres"))
    made = S.parent_enrich(t.albums, S.tag_labels(t.tag_ids, t.tag_labels).where("app_id % 2 = 0"), cache)
    return made.select("app_id", "name", "parent_name", "parent_tags", F.array_join("parent_genres", ", ").alias("parent_genres"), "parent_genre")


@query("enrich_tiers", "select app_id, coalesce(nullif(cached_name, ''), nullif(store_name, ''), local_name) as name, coalesce(nullif(cached_genre, ''), local_genre) as genre, coalesce(cached_date, local_date) as release_date, coalesce(cached_image, case when local_logo is not null then 'https://img.example.com/apps/' || app_id || '/header.jpg' end) as header_image_url from tier_fields")
def _(t):
    return S.enrich_tiers(t.tier_fields)


def _tier(c):
    return f"min_by({c}, tier) filter (trim({c}) <> '') as {c}"


def _tier_list(c):
    return f"array_to_string(list_filter(string_split(min_by({c}, tier) filter (trim({c}) <> ''), '|'), lambda x: trim(x) <> ''), '|') as {c}"


@query("fold_tiers", f"select app_id, {', '.join(map(_tier, ('name', 'genre', 'release_date', 'header_image_url')))}, {', '.join(map(_tier_list, ('developers', 'publishers', 'tags')))} from tier_rows group by app_id")
def _(t):
    lists = ("developers", "publishers", "tags")
    split = t.tier_rows.withColumns({c: F.split(c, r"\|") for c in lists})
    tiers = [split.where(F.col("tier") == k).drop("tier", *dropped) for k, dropped in enumerate([(), ("publishers", "tags", "header_image_url"), ("genre", "release_date"), ()])]
    return S.fold_tiers(S.union_tiers(tiers)).withColumns({c: F.array_join(c, "|") for c in lists})


@query("flatten_tracklist", "select app_id, case k when '9' then 0 else 1 end as v_idx, coalesce(try_cast(json_extract_string(tracks_json, '$.' || '\"' || k || '\"' || '.discnumber') as int), 1) as disc, cast(k as int) as number, json_extract_string(tracks_json, '$.' || '\"' || k || '\"' || '.originalname') as title, cast(json_extract_string(tracks_json, '$.' || '\"' || k || '\"' || '.s') as double) as seconds from tracklist_json, (values ('9'), ('10')) x(k)")
def _(t):
    return S.flatten_tracklist(t.tracklist_json)


@query("credits_text", "select app_id, concat_ws(chr(10), 'Artist: ' || coalesce(artist_local, artist_en), 'Composer: ' || coalesce(composer_local, composer_en), 'Othercredits: ' || othercredits_en) as credits, label_en as label from tracklist_json")
def _(t):
    return S.credits_text(t.tracklist_json)


@query("candidate_union", "with s as (select distinct app_id, mbid from candidates where app_id % 3 = 0), g as (select distinct app_id, release_id as mbid from fingerprint_hits where acoustid_score > 0.9 and app_id % 3 < 2), k as (select *, 0 as tier from s union all select *, 1 from (select * from g except select * from s) y), r as (select distinct app_id, release_id as mbid, 2 as tier from fingerprint_hits where acoustid_score > 0.95 and app_id not in (select app_id from k)), u as (select * from k union all select * from r) select app_id, mbid, tier, n from (select *, row_number() over (partition by app_id order by tier, mbid) as n from u) z where n <= 20")
def _(t):
    hits = t.fingerprint_hits.select("app_id", F.col("release_id").alias("mbid"), "acoustid_score")
    return S.candidate_union(t.candidates.where("app_id % 3 = 0"), hits.where("acoustid_score > 0.9 and app_id % 3 < 2"), hits.where("acoustid_score > 0.95"))
