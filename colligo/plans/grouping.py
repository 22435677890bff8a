"""Queries of track normalisation and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from colligo.functions.text import norm_stem
from colligo.operators import grouping as G
from colligo.plans.registry import query

#: Stems and numbers of the derived files: a leading number and " (Official)" are all that they add to a title.
STEMS = "s as (select *, lower(trim(regexp_replace(regexp_replace(regexp_replace(stem, '^[0-9]+ - ', ''), '\\(Official\\)', ''), '[^a-zA-Z0-9]+', ' ', 'g'))) as norm_stem, try_cast(regexp_extract(stem, '^([0-9]+)', 1) as int) as track_no from local_files)"
RANKED = STEMS + ", v as (select s.*, e.title, e.artist, e.track_number, e.disc_number, e.year_tag, e.album, row_number() over (partition by s.app_id, disc, norm_stem order by case fmt when 'flac' then 1 when 'wav' then 4 else 5 end, s.file_no) as r from s left join embedded_tags e on e.app_id = s.app_id and e.file_no = s.file_no)"


@query("disc_number", "select l.app_id, l.file_no, case when coalesce(try_cast(split_part(e.disc_number, '/', 1) as int), 1) <> 1 then try_cast(split_part(e.disc_number, '/', 1) as int) else l.disc end as disc_no from local_files l join embedded_tags e on e.app_id = l.app_id and e.file_no = l.file_no")
def _(t):
    both = t.local_files.join(t.embedded_tags, ["app_id", "file_no"])
    return both.select("app_id", "file_no", G.disc_number(F.col("disc_number"), F.col("win_path")).alias("disc_no"))


@query("norm_stem", f"with {STEMS} select app_id, file_no, norm_stem from s")
def _(t):
    return t.local_files.select("app_id", "file_no", norm_stem(F.col("stem")).alias("norm_stem"))


@query("track_number", "select l.app_id, l.file_no, coalesce(try_cast(regexp_extract(stem, '^([0-9]+)', 1) as int), try_cast(split_part(track_number, '/', 1) as int)) as track_no from local_files l join embedded_tags e on e.app_id = l.app_id and e.file_no = l.file_no")
def _(t):
    both = t.local_files.join(t.embedded_tags, ["app_id", "file_no"])
    return both.select("app_id", "file_no", G.track_number(F.col("stem"), F.col("track_number")).alias("track_no"))


@query("group_tracks_exact", f"with {STEMS} select app_id, disc, norm_stem, count(*) as variants, min(file_no) as first_file from s group by all")
def _(t):
    return G.group_tracks_exact(t.local_files)


@query("group_tracks")
def _(t):
    return G.group_tracks(t.local_files)


@query("split_groups", f"with {STEMS}, c as (select app_id, disc, norm_stem, count(distinct track_no) as n from s group by all) select app_id, file_no, disc, case when n <= 1 then norm_stem when track_no is not null then norm_stem || ' ' || track_no else norm_stem || ' unnum ' || row_number() over (partition by app_id, disc, norm_stem, track_no is null order by file_no) end as group_stem from s join c using (app_id, disc, norm_stem)")
def _(t):
    return G.split_groups(t.local_files)


@query("adopt_format", f"with {RANKED} select app_id, disc, norm_stem, file_no, fmt, case fmt when 'mp3' then 'mp3' else 'lossless' end as tier from v where r = 1")
def _(t):
    return G.adopt_format(t.local_files)


def _first(c):
    return f"first({c} order by r) filter (where {c} is not null and lower(trim({c})) not in ('', 'none', 'unknown', '0')) as {c}"


@query("merge_tags", f"with {RANKED} select app_id, disc, norm_stem, {', '.join(map(_first, ('title', 'artist', 'track_number', 'disc_number', 'year_tag')))} from v group by app_id, disc, norm_stem")
def _(t):
    return G.merge_tags(t.local_files, t.embedded_tags)


@query("evidence_weight", f"with {RANKED} select app_id, disc, norm_stem, case when max(year_tag) is null and max(title) is null then 'critical_missing' when count(*) > 1 then 'strong' else 'moderate' end as weight, round(avg(duration_s::double), 2) as mean_s from v group by app_id, disc, norm_stem")
def _(t):
    return G.evidence_weight(t.local_files.withColumn("duration_s", F.col("duration_s").cast("double")), t.embedded_tags)


def _common(c):
    return f"(select app_id, {c} from (select app_id, {c}, row_number() over (partition by app_id order by count(*) desc, min(file_no)) as r from embedded_tags where {c} is not null group by app_id, {c}) where r = 1)"


@query("album_consensus", f"select coalesce(a.app_id, y.app_id) as app_id, artist, year_tag from {_common('artist')} a full join {_common('year_tag')} y on a.app_id = y.app_id")
def _(t):
    return G.album_consensus(t.embedded_tags)


#: Groups that a fingerprint knows, derived from the recordings of the album's own tracks.
HEARD = "hrd as (select app_id, disc, norm_stem, case when min(file_no) % 3 = 0 then 'Heard ' || norm_stem when min(file_no) % 3 = 1 then ' ' end as title, case when min(file_no) % 2 = 0 then 'Heard artist' end as artist from s group by app_id, disc, norm_stem)"


def heard(t):
    groups = G.with_stems(t.local_files).groupBy(*G.GROUP).agg(F.min("file_no").alias("f"))
    title = F.when(F.col("f") % 3 == 0, F.concat(F.lit("Heard "), F.col("norm_stem"))).when(F.col("f") % 3 == 1, " ")
    return groups.select(*G.GROUP, title.alias("title"), F.when(F.col("f") % 2 == 0, "Heard artist").alias("artist"))


@query("track_titles", f"with {RANKED}, {HEARD}, g as (select app_id, disc, norm_stem, first(title order by r) filter (where title is not null) as tag, first(trim(regexp_replace(stem, '^[0-9]+ - ', '')) order by r) as named, cast(floor(avg(duration_s::double) * 1000) as bigint) as mean_ms from v group by app_id, disc, norm_stem) select g.app_id, g.disc, g.norm_stem, coalesce(case when trim(title) <> '' then title end, tag, named) as title, case when trim(title) <> '' then 'fingerprint' when tag is not null then 'tag' else 'file' end as title_from, mean_ms from g join hrd h on h.app_id = g.app_id and h.disc = g.disc and h.norm_stem = g.norm_stem")
def _(t):
    return G.track_titles(t.local_files.withColumn("duration_s", F.col("duration_s").cast("double")), t.embedded_tags, heard(t))


def _vote(c):
    return f"(select app_id, {c} from (select app_id, {c}, row_number() over (partition by app_id order by count(*) desc, min(file_no)) as r from vts where {c} is not null and lower({c}) <> 'unknown' group by app_id, {c}) where r = 1)"


@query("baseline", f"with {RANKED}, {HEARD}, vts as (select v.app_id, v.file_no, case when k.app_id is null then v.album end as album, case when k.app_id is null then v.year_tag end as year_tag, case when k.app_id is null then v.artist when row_number() over (partition by v.app_id, v.disc, v.norm_stem order by v.file_no) = 1 then k.artist end as artist from v left join (select * from hrd where trim(title) <> '') k on k.app_id = v.app_id and k.disc = v.disc and k.norm_stem = v.norm_stem), ids as (select app_id from {_vote('album')} union select app_id from {_vote('artist')} union select app_id from {_vote('year_tag')}) select app_id, album, artist, year_tag from ids left join {_vote('album')} b using (app_id) left join {_vote('artist')} a using (app_id) left join {_vote('year_tag')} y using (app_id)")
def _(t):
    return G.baseline(t.local_files, t.embedded_tags, heard(t))


@query("total_discs", "select app_id, max(disc) as total_discs from (select app_id, disc from local_files union all select app_id, disc from store_tracks) x group by app_id")
def _(t):
    return G.total_discs(t.local_files, t.store_tracks)


@query("tier_by_size", "select l_orderkey as app_id, count(*) as files, case when count(*) <= 50 then 'small' when count(*) <= 100 then 'medium' else 'large' end as tier from lineitem group by l_orderkey")
def _(t):
    return G.tier_by_size(t.local_files)
