"""Analysis of the ledger of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligo.operators.scoring import similarity


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("albums"))


def status_share(ledger: DataFrame) -> DataFrame:
    """Counts with percentages; the window runs over one row per status."""
    n = ledger.groupBy("status").agg(F.count("*").alias("albums"))
    return n.withColumn("pct", F.round(100.0 * F.col("albums") / F.sum("albums").over(Window.partitionBy()), 1).cast("double"))


def history_top(ledger: DataFrame, n: int = 20) -> DataFrame:
    return ledger.orderBy(F.desc("processed_at"), F.desc("app_id")).limit(n).select("app_id", "status", "album_name", "processed_at", "confidence_score")


def album_detail(ledger: DataFrame, tags: DataFrame, app_id: int) -> DataFrame:
    """One album's record beside its tracks numbered 0 or untitled."""
    bad = tags.where((F.col("app_id") == app_id) & ((F.col("track_number") == 0) | F.coalesce("title", F.lit("Unknown")).isin("", "Unknown")))
    return ledger.where(F.col("app_id") == app_id).select("app_id", "status").join(bad, "app_id", "left")


def recent_window(ledger: DataFrame, now: Column, hours: int) -> DataFrame:
    return ledger.where(F.col("processed_at") >= now - F.expr(f"interval {hours} hours")).select("app_id", "status", "processed_at")


def cause() -> Column:
    slow = F.contains(F.lower("confidence_reason"), F.lit("timeout")) | ((F.col("tracks_len") == 0) & (F.col("confidence_score") >= 90))
    return F.when(slow, "timeout").when(F.col("confidence_score") < 90, "low_confidence").otherwise("validator")


def review_causes(ledger: DataFrame, examples: int = 3) -> DataFrame:
    """Causes of rows that are no archive, with the first names of each."""
    rows = ledger.where("status <> 'archive'").withColumn("cause", cause())
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("cause").orderBy("app_id"))).where(F.col("n") <= examples)
    names = first.groupBy("cause").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("app_id", "album_name"))), lambda x: x["album_name"]), "; ").alias("names"))
    return rows.groupBy("cause").agg(F.count("*").alias("albums")).join(names, "cause")


def archive_audit(ledger: DataFrame) -> DataFrame:
    trust = F.when(F.contains("confidence_reason", F.lit("STEAM-TRUST")), "trust").otherwise("other")
    return ledger.where("status = 'archive'").groupBy(trust.alias("path")).agg(F.count("*").alias("archives"), F.count_if(F.col("confidence_score") < 95).alias("below_95"))


def issue_histogram(ledger: DataFrame) -> DataFrame:
    """Albums per kind of issue; counts and percentages are stripped."""
    issue = F.explode(F.split(F.regexp_replace("message", r"^\[|\]$", ""), ", "))
    kinds = ledger.where("message <> ''").select("app_id", issue.alias("i")).select("app_id", F.trim(F.regexp_replace("i", r" x[0-9]+$| \([^)]*\)$", "")).alias("issue"))
    return kinds.groupBy("issue").agg(F.countDistinct("app_id").alias("albums"))


def odd_archives(rows: DataFrame, least: float = 0.4, exact: bool = True) -> DataFrame:
    """Archives (app_id, album_name, title) whose title is unlike the album's name; by edit distance if not exact."""
    a, b = F.lower("album_name"), F.lower("title")
    like = similarity(a, b) if exact else 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return rows.withColumn("likeness", F.round(like, 4)).where(F.col("likeness") < least)


def odd_reviews(ledger: DataFrame) -> DataFrame:
    reviews = F.col("status") == "review"
    odd = F.count_if(reviews & (F.col("confidence_score") >= 100))
    return ledger.agg(odd.alias("odd"), F.count_if(reviews).alias("reviews"), F.round(odd * 100.0 / F.count_if(reviews), 1).cast("double").alias("pct"))


def cause_codes(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status", F.coalesce(F.nullif("confidence_reason", F.lit("")), F.lit("none")).alias("code")).agg(F.count("*").alias("albums"), F.count_if((F.col("status") == "review") & (F.col("message") == "")).alias("without_message"))


def stored_payloads(ledger: DataFrame) -> DataFrame:
    """The ledger with its JSON payload as a VARIANT, null where it is malformed, and `malformed` to tell that from an absent one."""
    v = F.try_parse_json("payload")
    return ledger.withColumn("malformed", F.col("payload").isNotNull() & v.isNull()).withColumn("payload", v)


def payload_codes(stored: DataFrame) -> DataFrame:
    """Albums by status, strategy, cause and upstream code as the payload's typed paths give them; reviews without a message, and malformed payloads."""
    at = lambda path: F.coalesce(F.nullif(F.try_variant_get("payload", f"$.{path}", "string"), F.lit("")), F.lit("none"))
    codes = {"strategy": "strategy", "cause": "diagnostics.review_cause_code", "upstream": "diagnostics.upstream_cause_code"}
    silent = (F.col("status") == "review") & (at("message") == "none")
    return stored.groupBy("status", *[at(path).alias(c) for c, path in codes.items()]).agg(F.count("*").alias("albums"), F.count_if(silent).alias("without_message"), F.count_if("malformed").alias("malformed"))


def review_list(ledger: DataFrame) -> DataFrame:
    return ledger.where("status = 'review'").select("app_id", "album_name", "message")


def track_report(tags: DataFrame) -> DataFrame:
    """Tag rows with their place by (disc, track); what is no number comes last as 99."""
    d = F.coalesce(F.split_part(F.col("disc_number").cast("string"), F.lit("/"), F.lit(1)).try_cast("int"), F.lit(99))
    n = F.coalesce(F.split_part(F.col("track_number").cast("string"), F.lit("/"), F.lit(1)).try_cast("int"), F.lit(99))
    return tags.withColumn("place", F.row_number().over(Window.partitionBy("app_id").orderBy(d, n, "file_no")))


def notification_rows(ledger: DataFrame, early: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """A message per album that did not return early: level by status, reason cut at 1000.

    Where the ledger has quality and archive_share they are told, and best (app_id,
    mbid, title, score: the first candidate of each album) adds the top candidate.
    """
    reason = F.when(F.length("confidence_reason") > 1000, F.concat(F.substring("confidence_reason", 1, 997), F.lit("..."))).otherwise(F.col("confidence_reason"))
    rows = ledger.join(early.select("app_id").distinct(), "app_id", "left_anti")
    per_cent = lambda c: F.concat(F.coalesce(c, F.lit(0)).cast("int").cast("string"), F.lit("%"))
    identity = F.concat(F.lit("ID: "), F.col("confidence_score").cast("string"), F.lit("%"))
    extra = []
    if "quality" in ledger.columns:
        identity = F.concat(identity, F.lit(" / Qual: "), per_cent(F.col("quality")))
    if "archive_share" in ledger.columns:
        share = F.coalesce("archive_share", F.lit(0))
        extra.append(F.concat(F.lit("Arch "), per_cent(share), F.lit(" : Rev "), per_cent(100 - share)).alias("ratio"))
    if best is not None:
        rows = rows.join(best.select("app_id", F.concat(F.col("title"), F.lit(" ("), F.col("mbid").cast("string"), F.lit(", score "), F.col("score").cast("string"), F.lit(")")).alias("top_candidate")), "app_id", "left")
        extra.append(F.col("top_candidate"))
    return rows.select("app_id", F.when(F.col("status") == "review", "warning").otherwise("info").alias("level"), identity.alias("identity"), *extra, "message", reason.alias("reason"))


def ledger_vs_output(ledger: DataFrame, output: DataFrame) -> DataFrame:
    """Review rows without an output item, and items without a review row."""
    a = ledger.where("status = 'review'").select(F.col("app_id").alias("l"))
    b = output.select(F.col("app_id").alias("o")).distinct()
    return a.join(b, F.col("l") == F.col("o"), "full_outer").where("l is null or o is null").select(F.coalesce("l", "o").alias("app_id"), F.when(F.col("o").isNull(), "no_output").otherwise("no_review").alias("kind"))
