"""Queries of quotas, cooldowns and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from colligo.operators import quota as Q
from colligo.operators import scan as S
from colligo.plans.registry import query, scratch
from colligo.sources.tables import UpsertTable
from colligo.streaming import jobs

SENT = "with recursive k as (select event_id, ts, level, title, row_number() over (partition by level, title order by ts, event_id) as n from notifications), s as (select *, ts as last, true as sent from k where n = 1 union all select k.*, case when k.ts - s.last >= interval 1 hour then k.ts else s.last end, k.ts - s.last >= interval 1 hour from s join k on k.level = s.level and k.title = s.title and k.n = s.n + 1) select event_id, level, title from s where sent"


def logged(t):
    """Requests with their service."""
    return t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(F.col("event_type").alias("service"), "event_id", "ts", F.floor(F.col("value") / 3.0).cast("long").alias("tokens"))


@query("rolling_quota", "with r as (select event_type as service, event_id, ts, cast(floor(value / 3.0) as bigint) as tokens from events), w as (select *, count(*) over p as n, coalesce(sum(tokens) over p, 0)::bigint as used from r window p as (partition by service order by ts range between interval 3600 second preceding and interval 1 microsecond preceding)) select service, event_id, n, used, case when n / 10.0 >= 0.9 then 'wait' when n / 10.0 >= 0.7 then 'jitter' when used + tokens > 0.9 * 300 then 'token_limited' else 'free' end as label from w")
def _(t):
    return Q.rolling_quota(logged(t), seconds=3600, most_requests=10, most_tokens=300)


@query("daily_quota", "select strftime(ts, '%Y-%m-%d') as day, count(*) as requests, count(*) > 300 as over from events group by 1")
def _(t):
    return Q.daily_quota(t.requests, most=300)


@query("cooldown", SENT)
def _(t):
    return Q.cooldown(t.notifications, seconds=3600)


def slices(t, n, name="in"):
    """The events in n files of a scratch folder, in order of time, as a log would leave them."""
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    low, high = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    folder = scratch(t.spark, name)
    place = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(low)) * n / (high - low + 1))
    for k in range(n):
        events.where(place == k).coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("stream_quota", "with r as (select event_type as service, event_id, ts, cast(floor(value / 3.0) as bigint) as tokens from events), w as (select *, count(*) over p as n, coalesce(sum(tokens) over p, 0)::bigint as used from r window p as (partition by service order by ts range between interval 3600 second preceding and interval 1 microsecond preceding)) select service, event_id, n, used, case when n / 10.0 >= 0.9 then 'wait' when n / 10.0 >= 0.7 then 'jitter' when used + tokens > 0.9 * 300 then 'token_limited' else 'free' end as label from w")
def _(t):
    rows = jobs.read_events(t.spark, slices(t, 4)).select(F.col("event_type").alias("service"), "event_id", "ts", F.floor(F.col("value") / 3.0).cast("long").alias("tokens"))
    return jobs.drain(jobs.quota_stream(rows, seconds=3600, most_requests=10, most_tokens=300), scratch(t.spark, "labels"), scratch(t.spark, "state"))


def notices(t, folder, files=1):
    return jobs.read_events(t.spark, folder, files).select("event_id", "ts", F.col("event_type").alias("level"), F.col("user_id").alias("title"))


@query("stream_cooldown", SENT)
def _(t):
    stream = jobs.cooldown_stream(notices(t, f"{t.sf_dir}/events.parquet"), seconds=3600)
    return jobs.drain(stream, scratch(t.spark, "sent"), scratch(t.spark, "state")).select("event_id", "level", "title")


@query("stream_cooldown_restart", SENT)
def _(t):
    # The second stream knows nothing of the first but what that one sent.
    events = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    middle = F.lit(events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0])
    early = F.unix_micros(F.col("ts").cast("timestamp")) < middle
    sent = None
    for part in (early, ~early):
        folder = scratch(t.spark, "in")
        events.where(part).write.parquet(folder)
        # A half is one batch, in whose order of files nothing lies.
        rows = notices(t, folder, files=1_000_000_000)
        known = None if sent is None else rows.sparkSession.read.parquet(sent)
        out = scratch(t.spark, "sent")
        made = jobs.drain(jobs.cooldown_stream(rows, seconds=3600, sent=known), out, scratch(t.spark, "state")).select("event_id", "level", "title")
        both = made if sent is None else t.spark.read.parquet(sent).select("event_id", "level", "title").unionByName(t.spark.read.parquet(out).select("event_id", "level", "title"))
        sent = out
    return both


@query("stream_ledger", "select app_id, status, processed_at from (select o_custkey as app_id, o_orderstatus as status, o_orderdate as processed_at, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) z where r = 1")
def _(t):
    rows = jobs.read_events(t.spark, f"{t.sf_dir}/orders.parquet").select(F.col("o_custkey").alias("app_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("processed_at"), "o_orderkey")
    table = UpsertTable(t.spark, scratch(t.spark, "ledger"), rows.schema.simpleString()[7:-1], ["app_id"], ["processed_at", "o_orderkey"])
    jobs.ledger_stream(rows, table, scratch(t.spark, "state"))
    return table.read().select("app_id", "status", "processed_at")


@query("cache_expired", "with l as (select distinct on (service, query_key) service, query_key, event_id, fetched_at from api_cache order by service, query_key, fetched_at desc, event_id desc) select service, query_key, event_id from l where fetched_at < (select max(fetched_at) from api_cache) - interval 3 day")
def _(t):
    now = F.lit(t.api_cache.agg(F.max("fetched_at")).first()[0])
    kept = S.cache_lookup(t.api_cache.select("service", "query_key").distinct(), t.api_cache, now, days=3).where("hit").select("service", "query_key")
    newest = t.api_cache.groupBy("service", "query_key").agg(F.max_by("event_id", F.struct("fetched_at", "event_id")).alias("event_id"))
    return newest.join(kept, ["service", "query_key"], "left_anti")


@query("stream_cache", "with l as (select distinct on (service, query_key) service, query_key, event_id, fetched_at from api_cache order by service, query_key, fetched_at desc, event_id desc) select service, query_key, event_id from l where fetched_at < (select max(fetched_at) from api_cache) - interval 3 day")
def _(t):
    rows = jobs.read_events(t.spark, f"{t.sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("service"), F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query_key"), F.col("ts").alias("fetched_at"))
    return jobs.drain(jobs.cache_stream(rows, days=3, late="0 seconds"), scratch(t.spark, "expired"), scratch(t.spark, "state"))
