"""Queries of the field-level merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from colligo.functions.text import clean_title
from colligo.operators import merge as M
from colligo.plans.albums import WINNER, winner
from colligo.plans.registry import query, staged

FOLD = "lower(regexp_replace({0}, '[^a-zA-Z0-9]', '', 'g'))"
STORE = f"sto as materialized (select i.app_id, i.file_no, i.matched_v_idx as v_idx from instructions i join store_tracks s on s.app_id = i.app_id and s.v_idx = i.matched_v_idx where action = 'use_steam' union all select app_id, file_no, v_idx from (select i.app_id, file_no, v_idx, row_number() over (partition by i.app_id, file_no order by case when {FOLD.format('stem')} = {FOLD.format('title')} then 0 else 1 end, v_idx) as r from instructions i join store_tracks s on s.app_id = i.app_id and ({FOLD.format('stem')} = {FOLD.format('title')} or starts_with(lower(stem), lower(title) || ' ')) where action = 'use_fingerprint') z where r = 1)"
RELEASE = WINNER + ", iwn as materialized (select i.app_id, file_no, matched_v_idx + 1 as position, release_id from instructions i join win w on w.app_id = i.app_id where action = 'use_fingerprint'), rls as materialized (select n.app_id, n.file_no, n.position, r.title as r_title, r.disc as r_disc from iwn n join release_tracks r on r.mbid = n.release_id and r.position = n.position)"
LABELS = "lbl as materialized (select app_id, string_agg(label, '/ ' order by pos, label) as tags from tag_ids join tag_labels using (tag_id) group by app_id)"
#: What is known of files and of albums is joined apart, so that a query of few columns has no other order of joins.
FILES = "fil as materialized (select l.app_id, l.file_no, l.disc, l.stem, filename_track, e.title as e_title, e.artist as e_artist, e.track_number as e_track, e.disc_number as e_disc, e.year_tag as e_year, action from local_files l join embedded_tags e on e.app_id = l.app_id and e.file_no = l.file_no join instructions i on i.app_id = l.app_id and i.file_no = l.file_no)"
ALBUMS = "abm as materialized (select a.app_id, a.name, a.developer, a.publisher, a.release_date, a.store_credits, a.parent_app_id, r_artist, r_date, r_label, r_composer, tj.label_en as s_label, p.name as parent_name, tf.cached_genre as genre, tp.cached_genre as parent_genre, go.tags as own_tags, gp.tags as parent_tags from albums a left join win w on w.app_id = a.app_id left join releases rel on rel.mbid = w.release_id left join tracklist_json tj on tj.app_id = a.app_id left join albums p on p.app_id = a.parent_app_id left join tier_fields tf on tf.app_id = a.app_id left join tier_fields tp on tp.app_id = a.parent_app_id left join lbl go on go.app_id = a.app_id left join lbl gp on gp.app_id = a.parent_app_id)"
PLACED = "plc as materialized (select x.app_id, x.file_no, s.title as s_title, s.number as s_number, s.disc as s_disc from sto x join store_tracks s on s.app_id = x.app_id and s.v_idx = x.v_idx)"
FACTS = f"{STORE}, {RELEASE}, {LABELS}, {FILES}, {ALBUMS}, {PLACED}, fct as materialized (select fil.*, s_title, s_number, s_disc, r_title, position as r_position, r_disc, override_title, override_track, override_disc, abm.* exclude (app_id) from fil join abm on abm.app_id = fil.app_id left join plc s on s.app_id = fil.app_id and s.file_no = fil.file_no left join rls r on r.app_id = fil.app_id and r.file_no = fil.file_no left join overrides o on o.app_id = fil.app_id and o.file_no = fil.file_no)"
TITLE = "coalesce(override_title, r_title, s_title, stem, e_title)"
SOURCE = "case when override_title is not null then 'LLM_OVERRIDE' when r_title is not null then 'MBZ' when s_title is not null then 'PICS_API' else 'FILE' end"
TRACK = "coalesce(nullif(override_track, 0), nullif(s_number, 0), nullif(r_position, 0), nullif(filename_track, 0), nullif(try_cast(split_part(e_track, '/', 1) as int), 0), 0)::int"
DISC = "coalesce(nullif(override_disc, 0), s_disc, try_cast(split_part(e_disc, '/', 1) as int), r_disc, disc)::int"
TOTAL = f"greatest({DISC}, coalesce(try_cast(split_part(e_disc, '/', 2) as int), 1), disc)::int"


ARTIST = "coalesce(r_artist, trim(regexp_extract(store_credits, 'Artist: *([^\\n]*)', 1)))"
YEAR = "coalesce(left(r_date, 4), e_year, left(release_date, 4))"
LABEL = "coalesce(case when r_label <> 'Unknown' then r_label end, s_label, developer || ', ' || publisher)"
COMPOSER = "coalesce(r_composer, trim(regexp_extract(store_credits, 'Music by *([^\\n]*)', 1)))"
GENRE = "'STEAM VGM, ' || coalesce(genre, parent_genre, 'Soundtrack')"
ABOUT = "coalesce(parent_name, name)"
COMMENT = f"{ABOUT} || ', ' || coalesce('[' || coalesce(parent_tags, own_tags) || ']', '') || ', ' || case when parent_name is not null then parent_app_id else app_id end || ', https://store.example.com/app/' || case when parent_name is not null then parent_app_id else app_id end"


def _clean(title: str, track: str) -> str:
    lead = f"regexp_extract({title}, '^([0-9]+)([ .-]+)', 1)"
    return f"case when {lead} <> '' and not regexp_matches({title}, '^[0-9]+[.][0-9]') and ltrim({lead}, '0') = ltrim(cast({track} as varchar), '0') then trim(regexp_replace({title}, '^([0-9]+)([ .-]+)', '')) else trim({title}) end"


def facts(t):
    # Asked for three times, and far smaller than what it takes to make them.
    i = staged(t, t.instructions.select("app_id", "file_no", "stem", "action", "matched_v_idx"), "instructions")
    s = M.placed(i, t.store_tracks).drop("v_idx")
    won = staged(t, winner(t), "winner")
    r = M.match_release_track(i, won, t.release_tracks).withColumnRenamed("position", "r_position")
    e = t.embedded_tags.withColumnsRenamed({"title": "e_title", "artist": "e_artist", "track_number": "e_track", "disc_number": "e_disc", "year_tag": "e_year"})
    won = won.select("app_id", F.col("release_id").alias("mbid")).join(t.releases, "mbid").drop("mbid")
    tags = t.tag_ids.join(t.tag_labels, "tag_id").groupBy("app_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("tags"))
    own = staged(t, t.tier_fields.select("app_id", F.col("cached_genre").alias("genre")).join(tags, "app_id", "full_outer"), "own")
    # Facts of an album are put together once for each album, then joined to its files.
    albums = t.albums.join(won, "app_id", "left").join(t.tracklist_json.select("app_id", F.col("label_en").alias("s_label")), "app_id", "left").join(own, "app_id", "left")
    parents = t.albums.select(F.col("app_id").alias("parent_app_id"), F.col("name").alias("parent_name")).join(own.withColumnsRenamed({"app_id": "parent_app_id", "genre": "parent_genre", "tags": "parent_tags"}), "parent_app_id", "full_outer")
    rows = t.local_files.join(e, ["app_id", "file_no"]).join(i.drop("stem"), ["app_id", "file_no"]).join(t.overrides, ["app_id", "file_no"], "left")
    rows = rows.join(s, ["app_id", "file_no"], "left").join(r, ["app_id", "file_no"], "left")
    none = F.lit(None).cast("string")
    return rows.join(albums.join(parents, "parent_app_id", "left"), "app_id").withColumns({"e_comment": none, "v_title": F.col("stem")})


@query("clean_title", "select app_id, file_no, " + _clean("stem", "filename_track") + " as title from local_files")
def _(t):
    return t.local_files.select("app_id", "file_no", clean_title(F.col("stem"), F.col("filename_track")).alias("title"))


@query("match_store_track", f"with {STORE} select app_id, file_no, v_idx from sto")
def _(t):
    return M.match_store_track(t.instructions, t.store_tracks)


@query("match_release_track", f"with {RELEASE} select app_id, file_no, position, r_title, r_disc from rls")
def _(t):
    return M.match_release_track(t.instructions, winner(t), t.release_tracks)


@query("merge_title", f"with {FACTS} select app_id, file_no, {TITLE} as title, {SOURCE} as source from fct")
def _(t):
    return facts(t).withColumn("t", M.merge_title()).select("app_id", "file_no", F.col("t.value").alias("title"), "t.source")


@query("merge_artist", f"with {FACTS} select app_id, file_no, {ARTIST} as artist from fct")
def _(t):
    return facts(t).select("app_id", "file_no", M.merge_artist().alias("artist"))


@query("merge_track_no", f"with {FACTS} select app_id, file_no, {TRACK} as track_no from fct")
def _(t):
    return facts(t).select("app_id", "file_no", M.merge_track_no().alias("track_no"))


@query("merge_disc_no", f"with {FACTS} select app_id, file_no, {DISC} as disc_no, {TOTAL} as total from fct")
def _(t):
    disc, total = M.merge_disc_no()
    return facts(t).select("app_id", "file_no", disc.alias("disc_no"), total.alias("total"))


@query("merge_year", f"with {FACTS} select app_id, file_no, {YEAR} as year from fct")
def _(t):
    return facts(t).select("app_id", "file_no", M.merge_year().alias("year"))


@query("merge_label", f"with {FACTS} select app_id, file_no, {LABEL} as label from fct")
def _(t):
    return facts(t).select("app_id", "file_no", M.merge_label().alias("label"))


@query("merge_composer", f"with {FACTS} select app_id, file_no, {COMPOSER} as composer from fct")
def _(t):
    return facts(t).select("app_id", "file_no", M.merge_composer().alias("composer"))


@query("trusted_clean", f"with {FACTS} select app_id, file_no, case when {SOURCE} = 'FILE' then {_clean(TITLE, TRACK)} else {TITLE} end as title from fct")
def _(t):
    rows = facts(t).withColumn("t", M.merge_title())
    return rows.select("app_id", "file_no", M.trusted_clean(F.col("t.value"), F.col("t.source"), M.merge_track_no()).alias("title"))


@query("merge_genre", "select f.app_id, 'STEAM VGM, ' || coalesce(f.cached_genre, p.cached_genre, 'Soundtrack') as genre from tier_fields f left join tier_fields p on p.app_id = f.parent_app_id")
def _(t):
    parent = t.tier_fields.select(F.col("app_id").alias("parent_app_id"), F.col("cached_genre").alias("parent_genre"))
    return t.tier_fields.join(parent, "parent_app_id", "left").select("app_id", M.merge_genre(F.col("cached_genre"), F.col("parent_genre")).alias("genre"))


@query("build_comment", "with g as (select app_id, string_agg(label, '/ ' order by pos, label) as tags from tag_ids join tag_labels using (tag_id) group by app_id) select a.app_id, a.name || ', ' || coalesce('[' || tags || ']', '') || ', ' || a.app_id || ', https://store.example.com/app/' || a.app_id as comment from albums a left join g using (app_id)")
def _(t):
    tags = t.tag_ids.join(t.tag_labels, "tag_id").groupBy("app_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("tags"))
    rows = t.albums.join(tags, "app_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return rows.select("app_id", M.build_comment(F.col("name"), F.col("tags"), F.col("app_id"), F.lit(None).cast("string")).alias("comment"))


@query("prune_comment", "with k as (select app_id, label, row_number() over (partition by app_id order by pos, label) as n, 2 + 2 * (sum(length(label)) over (partition by app_id order by pos, label rows unbounded preceding) + 2 * (row_number() over (partition by app_id order by pos, label) - 1)) as size from tag_ids join tag_labels using (tag_id)) select app_id, coalesce(string_agg(label, '/ ' order by n) filter (where size <= 100), '') as tags from k group by app_id")
def _(t):
    tags = t.tag_ids.join(t.tag_labels, "tag_id").groupBy("app_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("tags"))
    return tags.select("app_id", F.array_join(M.prune_comment(F.col("tags"), most=100), "/ ").alias("tags"))


@query("final_tags", f"with {FACTS} select app_id, file_no, case when {SOURCE} = 'FILE' then {_clean(TITLE, TRACK)} else {TITLE} end as title, {SOURCE} as title_source, {ARTIST} as artist, name as album, developer as album_artist, {TRACK} as track_number, {DISC} as disc_number, {TOTAL} as total_discs, {YEAR} as year, {LABEL} as label, {COMPOSER} as composer, {GENRE} as genre, {COMMENT} as comment, {ABOUT} || ', Store' as grouping, 'eng' as language, action from fct")
def _(t):
    return M.final_tags(facts(t))


@query("artwork_source", "select app_id, case when max(case when app_id % 5 = 0 then 1 end) = 1 then 'MBZ' when max(case when app_id % 3 = 0 then 1 end) = 1 then 'PICS_API' when min(case when title is not null then file_no end) is not null then 'EMBED' end as source, case when app_id % 5 <> 0 and app_id % 3 <> 0 then min(case when title is not null then file_no end) end as file_no from embedded_tags group by app_id")
def _(t):
    return M.artwork_source(t.embedded_tags.select("app_id", "file_no", (F.col("app_id") % 5 == 0).alias("has_mbz"), (F.col("app_id") % 3 == 0).alias("has_pics"), F.col("title").isNotNull().alias("has_embedded")))


@query("conversion_plan", "with d as (select p.*, l.fmt, case when bits > 0 then bits when sample_fmt like '%16%' then 16 when sample_fmt like '%24%' then 24 when sample_fmt like '%32%' or sample_fmt like '%flt%' then 32 when sample_fmt = 'dbl' then 64 else 0 end as depth from audio_props p join local_files l on l.app_id = p.app_id and l.file_no = p.file_no) select app_id, file_no, case when fmt = 'mp3' then 'mp3' else 'aiff' end as container, case when fmt <> 'mp3' and sample_rate > 48000 then 48000 end as to_rate, case when fmt <> 'mp3' and depth > 24 then 24 end as to_depth from d")
def _(t):
    return M.conversion_plan(t.audio_props.join(t.local_files.select("app_id", "file_no", "fmt"), ["app_id", "file_no"]))
