"""Exact link components among members of candidate buckets, without listing all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import TEXT_ROWS, spread_join, staged
from colligo.llm.components import components

#: Members of a bucket that are compared with all of it in one task, about.
BUCKET_ROWS = 2048


def bucket_components(
    probes: DataFrame,
    confirm: Callable[[DataFrame], DataFrame],
    plausible: Callable[[str, str], Column],
    details: Callable[[DataFrame], DataFrame] | None = None,
    close: Callable[[str, str], Column] | None = None,
    texts: DataFrame | None = None,
) -> DataFrame:
    """(u, v): v is the smallest id linked with u, for every u that is not itself the smallest of its component.

    probes: (key, id, n); two ids are compared if they share a key and
    plausible holds; confirm keeps the true links of a table of pairs (u, v).
    details(ids) may add a column x for the ids that are still apart after the
    first round, and close, over both sides' columns, must hold for any link;
    plausible and close get the suffixes of the two sides. texts: a table by doc_id;
    its rows of ids that share a bucket are stored once and are the second argument
    of confirm and details.

    Bucket mates are not paired. Each member is first compared with the most
    central leader of its buckets (the one that shares most buckets with
    others, as the origin of a group of edited copies does), then with every
    leader of its buckets; members of one component need no further
    comparison. What still stands apart is compared pair by pair across
    components, close being part of the join, so no link is lost.
    """
    close = close or (lambda a, b: F.lit(True))
    # Buckets of two distinct members; the numbers are of all columns, so that this and the join read one exchange.
    dealt = probes.repartition("key")
    ends = [f("id").alias(f"{f.__name__}_id") for f in (F.min, F.max)] + [f("n").alias(f"{f.__name__}_n") for f in (F.min, F.max)]
    sizes = dealt.groupBy("key").agg(F.count("*").alias("members"), *ends).where("min_id < max_id or min_n < max_n").select("key", "members")
    # Merge joins where the smaller side grows with the data as well: broadcast, it would only do while that is small.
    hits = staged(dealt.join(sizes.hint("merge"), "key"), "hits")
    if texts is not None:
        held = staged(texts.join(hits.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "held")
        confirm, details = partial(confirm, texts=held), details and partial(details, texts=held)
    hub = hits.groupBy("id").agg((-F.sum("members")).alias("rank"))
    hits = staged(hits.drop("members").join(hub.hint("merge"), "id"), "ranked")

    def with_leaders(found: DataFrame, extra: list[str]) -> DataFrame:
        lead = F.min_by(F.struct("id", "n", "comp", "rank", *extra), F.struct("rank", "id"))
        leaders = found.groupBy("key").agg(lead.alias("lead")).select("key", *[F.col(f"lead.{c}").alias(f"{c}_v") for c in ("id", "n", "comp", "rank", *extra)])
        own = found.select("key", *[F.col(c).alias(f"{c}_u") for c in ("id", "n", "comp", *extra)])
        return own.join(leaders, "key").where("comp_u <> comp_v").where(plausible("_u", "_v"))

    first = with_leaders(hits.withColumn("comp", F.col("id")), []).groupBy(F.col("id_u").alias("u")).agg(F.min_by("id_v", F.struct("rank_v", "id_v")).alias("v"))
    labels = components(staged(confirm(first), "confirmed", TEXT_ROWS))

    def apart(extra: DataFrame | None) -> DataFrame:
        now = hits.join(labels.withColumnsRenamed({"u": "id", "v": "comp"}).hint("merge"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        spread = now.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("key")
        now = now.join(spread, "key", "left_semi")
        return staged(now.join(extra, "id") if extra is not None else now, "apart")

    left = apart(None)
    extra = staged(details(left.select("id").distinct()), "details", TEXT_ROWS) if details else None
    columns = ["x"] if details else []
    left = left.join(extra, "id") if details else left
    pairs = with_leaders(left, columns).where(close("_u", "_v")).select(F.col("id_u").alias("u"), F.col("id_v").alias("v")).distinct()
    labels = components(labels.union(staged(confirm(pairs), "confirmed", TEXT_ROWS)))
    left = apart(extra)
    # A pair with several common keys is met at the first of them only; keys are compared whole, as parts of two may be alike.
    left = staged(left.join(left.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys")), "id"), "rest")
    columns = ["id", "n", "comp", "keys", *columns]
    a = left.select("key", *[F.col(c).alias(f"{c}_u") for c in columns])
    b = left.select("key", *[F.col(c).alias(f"{c}_v") for c in columns])
    first = F.element_at(F.array_intersect("keys_u", "keys_v"), 1) == F.col("key")
    # Members of a large bucket are dealt over tasks; each meets all the others there.
    rest = spread_join(a, b, "key", "id_u", BUCKET_ROWS).where((F.col("comp_u") < F.col("comp_v")) & plausible("_u", "_v") & close("_u", "_v") & first)
    return components(labels.union(staged(confirm(rest.select(F.col("id_u").alias("u"), F.col("id_v").alias("v")).distinct()), "confirmed", TEXT_ROWS)))
