"""Queries of judging and instruction mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from colligo.operators import judging as J
from colligo.plans.albums import BOUND, bound
from colligo.operators.scoring import strong_candidates
from colligo.plans.registry import query, scratch
from colligo.plans.scoring import FACTS, evidence

PARSED = "par as (select app_id, app_id * 7 % 101 as confidence, case app_id % 4 when 0 then 'STEAM_BASED' when 1 then 'LOCAL_BASED' when 2 then 'HYBRID' else 'MBZ_BASED' end as strategy, app_id * 13 % 101 as quality from judge_responses)"
COUNTS = "sn as (select app_id, count(*) as store_n from store_tracks group by app_id), ln as (select app_id, count(*) as local_n from local_files group by app_id)"
LIKE = "(lower(title) = lower(stem) or starts_with(lower(title), lower(stem) || ' ') or starts_with(lower(stem), lower(title) || ' '))"
CLAIMS = "clm as (select *, count(*) over (partition by app_id, matched_v_idx) as claimants, min(disc) over (partition by app_id, matched_v_idx) <> max(disc) over (partition by app_id, matched_v_idx) as discs from instructions where action = 'use_steam')"

#: The same with halved indexes, so that claims of one disc clash too.
HALVED = CLAIMS.replace("select *, count", "select app_id, disc, file_no, stem, action, matched_v_idx, count").replace("from instructions", "from (select app_id, disc, file_no, stem, action, matched_v_idx // 2 as matched_v_idx from instructions) h")


def counts(t):
    store = t.store_tracks.groupBy("app_id").agg(F.count("*").alias("store_n"))
    return store.join(t.local_files.groupBy("app_id").agg(F.count("*").alias("local_n")), "app_id")


def judged(t):
    p = J.parsed_responses(t.judge_responses).select("app_id", F.col("identity_confidence").alias("confidence"), "strategy", F.when(F.col("app_id") % 2 == 0, F.col("integrity_quality")).alias("archive_share"), F.concat(F.lit("judge "), F.col("app_id").cast("string")).alias("reason"))
    seen = t.fingerprint_hits.select("app_id").distinct().withColumn("f", F.lit(True))
    return counts(t).join(p, "app_id").join(seen, "app_id", "left").withColumn("has_fingerprint", F.coalesce("f", F.lit(False)))


@query("payload_sample", "with z as (select *, row_number() over (partition by app_id order by v_idx) as i, count(*) over (partition by app_id) as n from store_tracks) select app_id, count(*) as tracks, case when count(*) > 5 then count(*) - 5 else 0 end as omitted, sum(case when n <= 5 or i <= 3 or i > n - 2 then length(title) else 0 end)::bigint as chars, string_agg(case when n <= 5 or i <= 3 or i > n - 2 then 'by ' || number end, ',' order by v_idx) as credits, max(case when n > 5 and i = 3 then '... ' || (n - 5) || ' tracks left out ...' end) as gap from z group by app_id")
def _(t):
    made = J.payload_sample(t.store_tracks.withColumn("credits", F.concat(F.lit("by "), F.col("number").cast("string"))), most=5, head=3, tail=2)
    kept = F.from_json("payload", "array<struct<title:string,credits:string,then:string>>")
    gap = F.array_max(F.transform(kept, lambda x: x["then"]))
    return made.select("app_id", "tracks", "omitted", F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + F.length(x["title"])).alias("chars"), F.array_join(F.transform(kept, lambda x: x["credits"]), ",").alias("credits"), gap.alias("gap"))


@query("chunk_plan", "select app_id, v_idx, cast((row_number() over (partition by app_id order by v_idx) - 1) // 3 as bigint) as chunk from store_tracks")
def _(t):
    return J.chunk_plan(t.store_tracks, J.chunk_size(3)).select("app_id", "v_idx", "chunk")


@query("token_estimate", "select conv_id, sum(greatest(1, length(text) // 3))::bigint as tokens from conversations group by conv_id")
def _(t):
    c = t.spark.read.parquet(f"{t.sf_dir}/conversations.parquet")
    return c.groupBy("conv_id").agg(F.sum(J.token_estimate(F.length("text"))).alias("tokens"))


@query("rechunk_truncated", "with k as (select app_id, v_idx, (row_number() over (partition by app_id order by v_idx) - 1) // 4 as chunk from store_tracks), b as (select app_id from judge_responses where done_reason = 'length') select app_id, chunk::bigint as chunk, v_idx, ((row_number() over (partition by app_id, chunk order by v_idx) - 1) // 2)::bigint as part from k where chunk = 0 and app_id in (select app_id from b)")
def _(t):
    responses = t.judge_responses.select("app_id", F.lit(0).cast("long").alias("chunk"), "done_reason", F.lit(None).cast("string").alias("error"))
    return J.rechunk_truncated(J.chunk_plan(t.store_tracks, 4).select("app_id", "chunk", "v_idx"), responses, 4)


@query("salvage_json", f"with {PARSED} select app_id, confidence::double as identity_confidence, quality::double as integrity_quality, strategy from par")
def _(t):
    return J.parsed_responses(t.judge_responses)


@query("default_judge", f"with {COUNTS}, {BOUND}, pct as (select app_id, round(count(position) * 100.0::double / count(*), 2) as match_pct from bnd group by app_id) select app_id, case when store_n = local_n and coalesce(match_pct, 0) > 80 then 100 when store_n = local_n then 90 when coalesce(match_pct, 0) > 80 then 80 else 50 end as confidence, case when store_n = local_n then 'STEAM_BASED' when coalesce(match_pct, 0) > 80 then 'FINGERPRINT_BASED' else 'LOCAL_BASED' end as strategy from sn join ln using (app_id) left join pct using (app_id)")
def _(t):
    share = bound(t).groupBy("app_id").agg(F.round(F.count("position") * 100.0 / F.count("*"), 2).alias("match_pct"))
    return J.default_judge(counts(t).join(share, "app_id", "left"))


def toy_judge(pdf):
    """A judge without a model: confidence by the payload's length, and no answer for some albums."""
    if (pdf["app_id"] % 97 == 0).any():
        raise ValueError("no answer")
    size = pdf["payload"].str.len()
    return pdf[["app_id"]].assign(confidence=(size % 101).astype(float), strategy=["LOCAL_BASED" if n > 200 else "HYBRID" for n in size])


@query("judge_albums", "with p as (select app_id, string_agg(title, '|' order by v_idx) as payload from store_tracks group by app_id) select app_id, case when app_id % 97 > 0 then (length(payload) % 101)::double end as confidence, case when app_id % 97 > 0 then case when length(payload) > 200 then 'LOCAL_BASED' else 'HYBRID' end end as strategy, case when app_id % 97 = 0 then 'ValueError: no answer' end as error from p")
def _(t):
    titles = F.transform(F.array_sort(F.collect_list(F.struct("v_idx", "title"))), lambda x: x["title"])
    payloads = t.store_tracks.groupBy("app_id").agg(F.array_join(titles, "|").alias("payload"))
    return J.judge_albums(payloads, toy_judge, "app_id long, confidence double, strategy string")


def short_judge(pdf):
    """A judge whose answers hold 40 letters of titles."""
    return pdf[["app_id", "start"]].assign(done_reason=["length" if n > 40 else "stop" for n in pdf["letters"]])


@query("rechunk_until_whole", """with recursive s as (select app_id, row_number() over (partition by app_id order by v_idx) - 1 as i, length(title) as n from store_tracks), a as materialized (select app_id, count(*) as n, list(n order by i) as ns from s group by app_id),
k as (select app_id, unnest(range(0, n, 4)) as start, 4 as size, 0 as round from a union all select k.app_id, unnest(range(start, least(start + size, n), size // 2)), size // 2, round + 1 from k join a on a.app_id = k.app_id where size > 1 and list_sum(ns[start + 1:start + size]) > 40)
select k.app_id, start, size, round, len(ns[start + 1:start + size]) as tracks, list_sum(ns[start + 1:start + size])::bigint as letters, list_sum(ns[start + 1:start + size]) > 40 as still_cut from k join a on a.app_id = k.app_id where size = 1 or list_sum(ns[start + 1:start + size]) <= 40""")
def _(t):
    def stage(df):
        path = scratch(t.spark, "round")
        df.write.parquet(path)
        return t.spark.read.schema(df.schema).parquet(path)

    def respond(rows):
        payloads = rows.groupBy("app_id", "start").agg(F.sum(F.length("title")).alias("letters"))
        return J.judge_albums(payloads, short_judge, "app_id long, start long, done_reason string")

    whole = J.rechunk_until_whole(t.store_tracks.select("app_id", "v_idx", "title"), 4, respond, stage)
    return whole.groupBy("app_id", "start", "size", "round").agg(F.count("*").alias("tracks"), F.sum(F.length("title")).alias("letters"), F.bool_or(F.col("done_reason") == "length").alias("still_cut"))


@query("structural_trust", f"with {PARSED}, {COUNTS}, j as (select par.app_id, confidence, strategy, quality, local_n, store_n = local_n and confidence < 100 and (confidence >= 80 or not exists (select 1 from fingerprint_hits h where h.app_id = par.app_id)) as lift from par join sn using (app_id) join ln using (app_id)) select app_id, case when lift then 100.0 else confidence end::double as confidence, case when lift then 'STEAM_BASED' else strategy end as strategy, (case when lift then 100.0 when app_id % 2 = 0 then quality else 0 end)::double as archive_share, case when lift then 'SYSTEM: STEAM-TRUST, ' || local_n || ' tracks' else 'judge ' || app_id end as reason, lift as trusted from j")
def _(t):
    return J.structural_trust(judged(t))


@query("confidence_gate", f"with {PARSED} select app_id, (case when app_id % 3 = 0 and confidence between 1 and 99 then (confidence / 100.0::double) * 100 else confidence end)::double as pct, (case when app_id % 2 = 0 then quality else 0 end)::double as archive, (case when app_id % 2 = 0 then 100 - quality else 100 end)::double as review, confidence < 100 as early_review from par")
def _(t):
    c = F.when((F.col("app_id") % 3 == 0) & F.col("identity_confidence").between(1, 99), F.col("identity_confidence") / 100).otherwise(F.when(F.col("identity_confidence") == 1, 1.0).otherwise(F.col("identity_confidence")))
    pct, early = J.confidence_gate(c)
    share = J.archive_ratio(F.when(F.col("app_id") % 2 == 0, F.col("integrity_quality")))
    return J.parsed_responses(t.judge_responses).select("app_id", pct.alias("pct"), share.alias("archive"), (100 - share).alias("review"), early.alias("early_review"))


@query("strict_gate", f"with {PARSED} select app_id, confidence < 100 or quality < 90 as early from par")
def _(t):
    return J.parsed_responses(t.judge_responses).select("app_id", J.strict_gate(F.col("identity_confidence"), F.col("integrity_quality"), F.col("strategy")).alias("early"))


@query("structural_hint", f"with {COUNTS} select app_id, case when store_n = 1 and local_n = 1 then 'single track on both sides' when store_n = local_n then 'equal track counts' end as hint from sn join ln using (app_id)")
def _(t):
    return counts(t).select("app_id", J.structural_hint(F.col("store_n"), F.col("local_n")).alias("hint"))


@query("explode_instructions", "with t1 as (select app_id, title from store_tracks where v_idx = 1), x as (select app_id, v_idx, 'use_local' as action, 0 as matched_v_idx from store_tracks where v_idx = 0 union all select app_id, min(s.v_idx), 'use_steam', 1 from store_tracks s join t1 using (app_id, title) group by app_id) select x.app_id, x.v_idx, action, matched_v_idx, case when action = 'use_steam' then p.number end as catalogue_idx, c.confidence::double as confidence, c.strategy from x left join store_tracks p on p.app_id = x.app_id and p.v_idx = x.matched_v_idx left join (select app_id, app_id * 7 % 101 as confidence, case app_id % 4 when 0 then 'STEAM_BASED' when 1 then 'LOCAL_BASED' when 2 then 'HYBRID' else 'MBZ_BASED' end as strategy from judge_responses) c on c.app_id = x.app_id")
def _(t):
    second = t.store_tracks.where("v_idx = 1").select("app_id", F.col("title").alias("t1"))
    ids = t.store_tracks.select("app_id").distinct().join(second, "app_id", "left")
    text = F.concat(F.lit('{"0": {"action": "use_local", "matched_v_idx": 0}, "999": {"action": "use_local", "matched_v_idx": 1}'), F.coalesce(F.concat(F.lit(', "'), F.col("t1"), F.lit('": {"action": "use_steam", "matched_v_idx": 1}')), F.lit("")), F.lit("}"))
    refs = t.store_tracks.select("app_id", F.lit("use_steam").alias("action"), F.col("v_idx").cast("int").alias("matched_v_idx"), F.col("number").alias("catalogue_idx"))
    tags = J.parsed_responses(t.judge_responses).select("app_id", F.col("identity_confidence").alias("confidence"), "strategy")
    return J.explode_instructions(ids.select("app_id", text.alias("instructions")), t.store_tracks, refs, tags)


@query("number_conflict", "select app_id, file_no, disc, case when row_number() over (partition by app_id, disc, matched_v_idx order by file_no) = 1 then matched_v_idx end as override_track from instructions")
def _(t):
    return J.number_conflict(t.instructions.withColumnRenamed("matched_v_idx", "override_track").select("app_id", "file_no", "disc", "override_track"))


@query("fast_track", "with c as (select distinct app_id, mbid from candidates union select distinct l_orderkey, l_orderkey from lineitem), sk as (select app_id, v_idx, lower(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) as k, count(*) over (partition by app_id) as n from store_tracks), rk as (select mbid, k, min(position) as position from (select mbid, position, lower(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) as k from release_tracks) z group by mbid, k), rn as (select mbid, count(*) as m from release_tracks group by mbid), r as (select c.app_id, c.mbid, v_idx, position, count(*) over (partition by c.app_id, c.mbid) as many, count(position) over (partition by c.app_id, c.mbid) as found from c join rn on rn.mbid = c.mbid join sk on sk.app_id = c.app_id and sk.n = rn.m left join rk on rk.mbid = c.mbid and rk.k = sk.k) select app_id, mbid, v_idx, position from r where many = found")
def _(t):
    strong = t.candidates.select("app_id", "mbid").union(t.local_files.select("app_id", F.col("app_id").alias("mbid"))).distinct()
    return J.fast_track(t.store_tracks, t.release_tracks, strong)


@query("fast_track_evidence", f"with {FACTS}, c as (select app_id, mbid from bst where rank = 1 and (contains(evidence, 'own_link:') or contains(evidence, 'recording_hit('))), sk as (select app_id, v_idx, lower(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) as k, count(*) over (partition by app_id) as n from store_tracks), rk as (select mbid, k, min(position) as position from (select mbid, position, lower(regexp_replace(title, '[^a-zA-Z0-9]', '', 'g')) as k from release_tracks) z group by mbid, k), rn as (select mbid, count(*) as m from release_tracks group by mbid), r as (select c.app_id, c.mbid, v_idx, position, count(*) over (partition by c.app_id, c.mbid) as many, count(position) over (partition by c.app_id, c.mbid) as found from c join rn on rn.mbid = c.mbid join sk on sk.app_id = c.app_id and sk.n = rn.m left join rk on rk.mbid = c.mbid and rk.k = sk.k) select app_id, mbid, v_idx, position from r where many = found")
def _(t):
    return J.fast_track(t.store_tracks, t.release_tracks, strong_candidates(evidence(t)))


@query("dup_disc_realign", f"with {HALVED} select c.app_id, c.file_no, max(matched_v_idx) as claimed, min(v_idx) as realigned from clm c left join store_tracks s on s.app_id = c.app_id and s.disc = c.disc and {LIKE} where claimants > 1 and discs group by c.app_id, c.file_no")
def _(t):
    return J.dup_disc_realign(t.instructions.withColumn("matched_v_idx", F.floor(F.col("matched_v_idx") / 2)), t.store_tracks)


@query("dup_name_recover", f"with {HALVED} select c.app_id, c.file_no, max(matched_v_idx) as claimed, min(v_idx) as recovered from clm c left join store_tracks s on s.app_id = c.app_id and s.disc = c.disc and s.v_idx <> c.matched_v_idx and {LIKE} where claimants > 1 and not discs group by c.app_id, c.file_no")
def _(t):
    return J.dup_name_recover(t.instructions.withColumn("matched_v_idx", F.floor(F.col("matched_v_idx") / 2)), t.store_tracks)


@query("dup_sequence", f"with {HALVED}, s as (select c.app_id, c.matched_v_idx, c.claimants, count(*) as run from (select distinct app_id, matched_v_idx, claimants from clm where claimants > 1) c join store_tracks b on b.app_id = c.app_id and b.v_idx = c.matched_v_idx join store_tracks x on x.app_id = c.app_id and x.v_idx >= c.matched_v_idx and x.v_idx < c.matched_v_idx + c.claimants and (lower(x.title) = lower(b.title) or starts_with(lower(x.title), lower(b.title) || ' ') or starts_with(lower(b.title), lower(x.title) || ' ')) group by all) select c.app_id, file_no, c.matched_v_idx as claimed, c.matched_v_idx + row_number() over (partition by c.app_id, c.matched_v_idx order by file_no) - 1 as dealt from clm c join s on s.app_id = c.app_id and s.matched_v_idx = c.matched_v_idx and run = s.claimants")
def _(t):
    return J.dup_sequence(t.instructions.withColumn("matched_v_idx", F.floor(F.col("matched_v_idx") / 2)), t.store_tracks)


@query("context_budget", "select app_id, case when floor(length(raw) / 2.5) + 100 * tracks <= 2048 then 2048 when floor(length(raw) / 2.5) + 100 * tracks <= 4096 then 4096 else 8192 end as context from judge_responses join (select app_id, count(*) as tracks from local_files group by app_id) using (app_id)")
def _(t):
    n = t.local_files.groupBy("app_id").agg(F.count("*").alias("tracks"))
    return t.judge_responses.join(n, "app_id").select("app_id", J.context_budget(F.length("raw"), F.col("tracks")).alias("context"))
