"""Audits of request logs and notifications: trailing quotas, daily quotas and cooldowns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_quota(requests: DataFrame, seconds: int = 60, most_requests: int = 15, most_tokens: int = 10_000_000) -> DataFrame:
    """Label of every request (service, event_id, ts, tokens) by the load of the trailing window, the request itself left out.

    Windows are partitioned by service, so no single task sees all requests.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("service").orderBy("at").rangeBetween(-seconds * 1_000_000, -1)
    rows = requests.withColumn("at", at).withColumn("n", F.count("*").over(w)).withColumn("used", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    load = F.col("n") / F.lit(float(most_requests))
    label = F.when(load >= 0.9, "wait").when(load >= 0.7, "jitter").when(F.col("used") + F.col("tokens") > 0.9 * most_tokens, "token_limited").otherwise("free")
    return rows.select("service", "event_id", "n", "used", label.alias("label"))


def quota_labels(n: np.ndarray, used: np.ndarray, tokens: np.ndarray, most_requests: int, most_tokens: int) -> np.ndarray:
    """The labels of rolling_quota from the requests and tokens of the trailing windows."""
    load = n / float(most_requests)
    return np.select([load >= 0.9, load >= 0.7, used + tokens > 0.9 * most_tokens], ["wait", "jitter", "token_limited"], "free").astype(object)


def daily_quota(requests: DataFrame, most: int = 1500) -> DataFrame:
    n = F.count("*")
    return requests.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(n.alias("requests"), (n > most).alias("over")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "requests", "over")


def kept_after_cooldown(times: list[int], seconds: int, last: int | None = None) -> list[bool]:
    """Which of the increasing times (microseconds) are sent: those a cooldown or more after the last one sent."""
    out = []
    for t in times:
        send = last is None or t - last >= seconds * 1_000_000
        out.append(send)
        last = t if send else last
    return out


def cooldown(rows: DataFrame, seconds: int = 60) -> DataFrame:
    """Notifications (event_id, ts, level, title) that are sent; the others repeat a key within the cooldown of the last one sent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "event_id"])
        return pdf[kept_after_cooldown(pdf["at"].tolist(), seconds)][["event_id", "level", "title"]]

    timed = rows.select("event_id", "level", "title", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy("level", "title").applyInPandas(run, "event_id long, level string, title long")
