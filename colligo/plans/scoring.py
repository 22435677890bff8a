"""Queries of candidate scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from colligo.operators import scoring as S
from colligo.plans.registry import query

C = "c as (select distinct app_id, mbid from candidates)"
LINKS = "lnk as (select c.app_id, mbid, max(case when url = 'https://store.example.com/app/' || c.app_id then 500 else 0 end) + max(case when url <> 'https://store.example.com/app/' || c.app_id and url = 'https://store.example.com/app/' || parent_app_id then 300 else 0 end) + max(case when url2 = 'https://db.example.com/app/' || c.app_id then 500 else 0 end) + max(case when url2 <> 'https://db.example.com/app/' || c.app_id and url2 = 'https://db.example.com/app/' || parent_app_id then 300 else 0 end) + max(case when contains(url2, 'shop.example.com') then 100 else 0 end) as points from candidates c join albums a on a.app_id = c.app_id group by c.app_id, mbid)"
LABEL = "lab as (select c.app_id, mbid, max(case when contains(lower(publisher), lower(label)) or contains(lower(label), lower(publisher)) then 100 else 0 end) as points from candidates c join albums a on a.app_id = c.app_id group by c.app_id, mbid)"
COUNT = "cnt as (select c.app_id, c.mbid, cast(case when coalesce(n, 0) = coalesce(m, 0) then 50 when coalesce(m, 0) > 0 then -least(300, 20 * abs(coalesce(n, 0) - m)) else 0 end as bigint) as points from (select distinct app_id, mbid from candidates) c left join (select app_id, count(*) as n from local_files group by app_id) x on x.app_id = c.app_id left join (select mbid, count(*) as m from release_tracks group by mbid) y on y.mbid = c.mbid)"
DIGITAL = "dig as (select app_id, mbid, max(case when medium_format ilike '%digital%' then 30 else 0 end) as points from candidates group by app_id, mbid)"
YEAR = "yr as (select c.app_id, mbid, cast(max(case when release_year = cast(left(release_date, 4) as int) then 20 else -least(100, 20 * abs(release_year - cast(left(release_date, 4) as int))) end) as bigint) as points from candidates c join albums a on a.app_id = c.app_id group by c.app_id, mbid)"
RANK = ", ".join((LINKS, LABEL, COUNT, DIGITAL, YEAR)) + ", tot as (select app_id, mbid, cast(sum(points) as bigint) as score from (select * from lnk union all select * from lab union all select * from cnt union all select * from dig union all select * from yr) u group by app_id, mbid), rnk as (select *, row_number() over (partition by app_id order by score desc, mbid) as rank from tot)"


#: Every kind of points in a column of its own, null where a candidate lacks it.
FACTS = """hit as (select distinct app_id, release_id from fingerprint_hits), myr as (select distinct app_id, recording_id from fingerprint_hits), thr as (select distinct mbid, recording_id from release_tracks),
sha as (select c.app_id, c.mbid, count(*) as shared from (select distinct app_id, mbid from candidates) c join thr on thr.mbid = c.mbid join myr on myr.app_id = c.app_id and myr.recording_id = thr.recording_id group by c.app_id, c.mbid),
fct as materialized (select c.app_id, c.mbid, c.title, c.label, release_year as year, coalesce(m, 0) as tracks, medium_format ilike '%digital%' as digital,
  case when h.release_id is not null then 1000 end as p1, case when shared > 0 then 1000 end as p2, shared,
  case when url = 'https://store.example.com/app/' || c.app_id then 500 end as p3, case when url <> 'https://store.example.com/app/' || c.app_id and url = 'https://store.example.com/app/' || parent_app_id then 300 end as p4,
  case when url2 = 'https://db.example.com/app/' || c.app_id then 500 end as p5, case when url2 <> 'https://db.example.com/app/' || c.app_id and url2 = 'https://db.example.com/app/' || parent_app_id then 300 end as p6,
  case when contains(url2, 'shop.example.com') then 100 end as p7, case when contains(lower(publisher), lower(c.label)) or contains(lower(c.label), lower(publisher)) then 100 end as p8,
  case when coalesce(n, 0) = coalesce(m, 0) then 50 when coalesce(m, 0) > 0 then -least(300, 20 * abs(coalesce(n, 0) - m)) end as p9, case when medium_format ilike '%digital%' then 30 end as p10,
  case when release_year = cast(left(release_date, 4) as int) then 20 else -least(100, 20 * abs(release_year - cast(left(release_date, 4) as int))) end as p11
  from candidates c join albums a on a.app_id = c.app_id left join (select app_id, count(*) as n from local_files group by app_id) x on x.app_id = c.app_id left join (select mbid, count(*) as m from release_tracks group by mbid) y on y.mbid = c.mbid
  left join hit h on h.app_id = c.app_id and h.release_id = c.mbid left join sha on sha.app_id = c.app_id and sha.mbid = c.mbid),
evd as materialized (select *, (coalesce(p1, 0) + coalesce(p2, 0) + coalesce(p3, 0) + coalesce(p4, 0) + coalesce(p5, 0) + coalesce(p6, 0) + coalesce(p7, 0) + coalesce(p8, 0) + coalesce(p9, 0) + coalesce(p10, 0) + coalesce(p11, 0))::bigint as score,
  concat_ws(';', case when p1 is not null then 'release_hit' end, case when p2 is not null then 'recording_hit(' || shared || ')' end, case when p3 is not null then 'own_link:store' end, case when p4 is not null then 'parent_link:store' end, case when p5 is not null then 'own_link:db' end, case when p6 is not null then 'parent_link:db' end, case when p7 is not null then 'shop_link' end, case when p8 is not null then 'label' end,
    case when p9 > 0 then 'track_count' else 'track_count(' || p9 || ')' end, case when p10 is not null then 'digital' end, case when p11 > 0 then 'year' else 'year(' || p11 || ')' end) as evidence from fct),
bst as materialized (select * from (select *, row_number() over (partition by app_id order by score desc, mbid) as rank from evd) z where rank <= 5)"""


def evidence(t, hits=True):
    return S.ranked_evidence(S.candidate_evidence(t.candidates, t.albums, t.local_files, t.release_tracks, t.fingerprint_hits if hits else None, urls=("url", "url2")))


def ranked(t):
    return evidence(t, hits=False).select("app_id", "mbid", "score", "rank")


def titles(t):
    return t.store_tracks.select("app_id", "v_idx", "title", (F.col("duration_s") * 1000).cast("long").alias("duration_ms"))


@query("score_release_hit", f"with {C} select app_id, mbid, case when exists (select 1 from fingerprint_hits h where h.app_id = c.app_id and h.release_id = c.mbid) then 1000 else 0 end as points from c")
def _(t):
    return S.score_release_hit(t.candidates, t.fingerprint_hits)


@query("score_recording_hit", f"with {C}, h as (select distinct app_id, recording_id from fingerprint_hits), q as (select distinct mbid, recording_id from release_tracks), s as (select c.app_id, c.mbid, count(*) as shared from c join q on q.mbid = c.mbid join h on h.app_id = c.app_id and h.recording_id = q.recording_id group by c.app_id, c.mbid) select c.app_id, c.mbid, coalesce(shared, 0) as shared, case when shared > 0 then 1000 else 0 end as points from c left join s on s.app_id = c.app_id and s.mbid = c.mbid")
def _(t):
    return S.score_recording_hit(t.candidates, t.fingerprint_hits, t.release_tracks)


@query("score_links", f"with {LINKS} select * from lnk")
def _(t):
    return S.score_links(t.candidates, t.albums, urls=("url", "url2"))


@query("score_label", f"with {LABEL} select * from lab")
def _(t):
    return S.score_label(t.candidates, t.albums)


@query("score_track_count", f"with {COUNT} select * from cnt")
def _(t):
    return S.score_track_count(t.candidates, t.local_files, t.release_tracks)


@query("score_digital", f"with {DIGITAL} select * from dig")
def _(t):
    return S.score_digital(t.candidates)


@query("score_year", f"with {YEAR} select * from yr")
def _(t):
    return S.score_year(t.candidates, t.albums)


@query("set_similarity")
def _(t):
    return S.set_similarity(t.candidates, titles(t), t.release_tracks)


@query("set_similarity_lev", f"""with recursive {C}, p as (select c.app_id, c.mbid, s.v_idx, r.position, 1.0::double - levenshtein(lower(s.title), lower(r.title)) / greatest(length(s.title), length(r.title), 1)::double as sim
from c join store_tracks s on s.app_id = c.app_id join release_tracks r on r.mbid = c.mbid and abs(cast(s.duration_s * 1000 as bigint) - r.duration_ms) < 2000),
o as materialized (select app_id, mbid, row_number() over (partition by app_id, mbid order by v_idx) as k, list(position order by sim desc, position) as opts from p where sim > 0.8 group by app_id, mbid, v_idx),
g as (select app_id, mbid, 0::bigint as k, [0::bigint] as taken from (select distinct app_id, mbid from o) union all select g.app_id, g.mbid, o.k, list_concat(taken, list_slice(list_filter(opts, lambda x: not list_contains(taken, x)), 1, 1)) from g join o on o.app_id = g.app_id and o.mbid = g.mbid and o.k = g.k + 1),
w as (select app_id, mbid, max(len(taken)) - 1 as matched from g group by app_id, mbid)
select c.app_id, c.mbid, cast(floor(coalesce(matched, 0) / greatest(n, m)::double * 200) as bigint) as points from c join (select app_id, count(*) as n from store_tracks group by app_id) x on x.app_id = c.app_id join (select mbid, count(*) as m from release_tracks group by mbid) y on y.mbid = c.mbid left join w on w.app_id = c.app_id and w.mbid = c.mbid""")
def _(t):
    return S.set_similarity(t.candidates, titles(t), t.release_tracks, edits=True)


@query("title_coverage")
def _(t):
    return S.title_coverage(t.candidates, titles(t), t.release_tracks)


@query("title_coverage_exact", f"with {C}, m as (select mbid, count(*) as m from release_tracks group by mbid), k as (select c.app_id, c.mbid, count(distinct lower(s.title)) as k from c join store_tracks s on s.app_id = c.app_id join release_tracks r on r.mbid = c.mbid and lower(r.title) = lower(s.title) group by c.app_id, c.mbid) select c.app_id, c.mbid, round(coalesce(k, 0) / m::double, 4) as coverage, case when coalesce(k, 0) / m::double >= 0.8 then 200 else 0 end as points from c join m on m.mbid = c.mbid left join k on k.app_id = c.app_id and k.mbid = c.mbid")
def _(t):
    return S.title_coverage(t.candidates, titles(t), t.release_tracks, exact=True)


@query("rank_candidates", f"with {RANK} select app_id, mbid, score, rank from rnk where rank <= 5")
def _(t):
    return ranked(t)


@query("candidate_evidence", f"with {FACTS} select app_id, mbid, rank, score, evidence, title, label, year, tracks, digital from bst")
def _(t):
    return evidence(t).withColumn("evidence", F.array_join("evidence", ";"))


@query("strong_candidates", f"with {FACTS} select app_id, mbid from bst where rank = 1 and (contains(evidence, 'own_link:') or contains(evidence, 'recording_hit('))")
def _(t):
    return S.strong_candidates(evidence(t))


@query("source_matrix", f"with {RANK} select app_id, 'store' as source, 0 as rank, name as title, null::bigint as tracks, cast(left(release_date, 4) as int) as year from albums union all select app_id, 'local', 0, null, count(*), null from local_files group by app_id union all select r.app_id, 'search', rank, 'Album ' || r.mbid, m, year(o_orderdate) from rnk r join orders on o_orderkey = r.mbid left join (select mbid, count(*) as m from release_tracks group by mbid) x on x.mbid = r.mbid where rank <= 5")
def _(t):
    return S.source_matrix(t.albums, t.local_files, evidence(t, hits=False), t.candidates, t.release_tracks)
