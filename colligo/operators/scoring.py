"""Candidate scoring: every function gives (app_id, mbid, points)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce
from operator import add, or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from colligo.functions.text import fold

# The default weights.
WEIGHTS = {"release_hit": 1000, "recording_hit": 1000, "own_link": 500, "parent_link": 300, "shop_link": 100, "label": 100, "count_equal": 50, "count_step": 20, "count_most": 300, "digital": 30, "year_equal": 20, "year_step": 20, "year_most": 100, "coverage": 200}
KEY = ["app_id", "mbid"]
#: Sites whose links name an album, and the shop that only sells it.
SITES = {"store": "store.example.com/app/", "db": "db.example.com/app/"}
SHOP = "shop.example.com"


@lru_cache(maxsize=1 << 16)
def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two texts; it depends on their order."""
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def may_be_like(a: Column, b: Column, least: float) -> Column:
    """False only for texts whose ratio can't be over least.

    Matching blocks are a common subsequence, of at most (|a| + |b| - edit distance) / 2
    letters, so the ratio is at most 1 - edit distance / (|a| + |b|).
    """
    most = (1.0 - least) * (F.length(a) + F.length(b)) + 1e-9
    # An edit distance is no less than the gap of the lengths, which costs nothing to tell.
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b) <= most))


def pairs(candidates: DataFrame) -> DataFrame:
    return candidates.select(*KEY).distinct()


def score_release_hit(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    seen = hits.select("app_id", F.col("release_id").alias("mbid")).distinct().withColumn("hit", F.lit(1))
    return pairs(candidates).join(seen, KEY, "left").select(*KEY, F.when(F.col("hit") == 1, WEIGHTS["release_hit"]).otherwise(0).alias("points"))


def score_recording_hit(candidates: DataFrame, hits: DataFrame, release_tracks: DataFrame) -> DataFrame:
    mine = hits.select("app_id", "recording_id").distinct()
    theirs = release_tracks.select("mbid", "recording_id").distinct()
    shared = pairs(candidates).join(theirs, "mbid").join(mine, ["app_id", "recording_id"]).groupBy(*KEY).agg(F.count("*").alias("shared"))
    return pairs(candidates).join(shared, KEY, "left").select(*KEY, F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), F.when(F.col("shared") > 0, WEIGHTS["recording_hit"]).otherwise(0).alias("points"))


def with_links(rows: DataFrame, urls: tuple[str, ...], sites: dict[str, str] = SITES, shop: str = SHOP) -> DataFrame:
    """rows with what their links (the columns `urls`) name, a column for each link and site, in place of the links: each link is read once."""
    numbers = {f"_{site}{i}": _number_after(sites[site], F.col(u)) for site in sites for i, u in enumerate(urls)}
    shops = reduce(or_, [F.coalesce(F.contains(u, F.lit(shop)), F.lit(False)) for u in urls])
    return rows.withColumns({**numbers, "_shop": shops}).drop(*urls)


def _number_after(site: str, url: Column) -> Column:
    # Most links are of one site only; the pattern is tried where its site stands.
    return F.when(F.contains(url, F.lit(site)), F.regexp_extract(url, site.replace(".", r"\.") + "([0-9]+)", 1).try_cast("long"))


def link_flags(app_id: Column, parent: Column, links: int, sites: dict[str, str] = SITES) -> dict[str, tuple[str, Column]]:
    """Note -> (weight, whether any of the links that with_links has read is of that kind); a link counts for the parent only if it is not the album's own."""
    out = {}
    for name in sites:
        numbers = [F.col(f"_{name}{i}") for i in range(links)]
        out[f"own_link:{name}"] = "own_link", reduce(or_, [F.coalesce(n == app_id, F.lit(False)) for n in numbers])
        out[f"parent_link:{name}"] = "parent_link", reduce(or_, [F.coalesce((n == parent) & (n != app_id), F.lit(False)) for n in numbers])
    out["shop_link"] = "shop_link", F.col("_shop")
    return out


def score_links(candidates: DataFrame, parents: DataFrame, sites: dict[str, str] = SITES, shop: str = SHOP, urls: tuple[str, ...] = ("url",)) -> DataFrame:
    """Points of the links in the columns `urls`; each kind of link counts once for each site."""
    c = with_links(candidates.select(*KEY, *urls), urls, sites, shop).join(parents.select("app_id", "parent_app_id"), "app_id", "left")
    flags = link_flags(F.col("app_id"), F.col("parent_app_id"), len(urls), sites)
    points = [F.max(F.when(cond, WEIGHTS[w]).otherwise(0)) for w, cond in flags.values()]
    return c.groupBy(*KEY).agg(reduce(add, points).alias("points"))


def score_label(candidates: DataFrame, albums: DataFrame) -> DataFrame:
    c = candidates.join(albums.select("app_id", "publisher"), "app_id")
    return c.groupBy(*KEY).agg(F.max(F.when(label_like(F.col("publisher"), F.col("label")), WEIGHTS["label"]).otherwise(0)).alias("points"))


def score_track_count(candidates: DataFrame, files: DataFrame, release_tracks: DataFrame) -> DataFrame:
    own = files.groupBy("app_id").agg(F.count("*").alias("n"))
    theirs = release_tracks.groupBy("mbid").agg(F.count("*").alias("m"))
    c = pairs(candidates).join(own, "app_id", "left").join(theirs, "mbid", "left")
    return c.select(*KEY, F.coalesce(count_points(F.col("n"), F.col("m")), F.lit(0)).cast("long").alias("points"))


def count_points(n: Column, m: Column) -> Column:
    """Points of n local tracks against m of the release; null if the release has none to compare."""
    n, m = F.coalesce(n, F.lit(0)), F.coalesce(m, F.lit(0))
    return F.when(n == m, WEIGHTS["count_equal"]).when(m > 0, -F.least(F.lit(WEIGHTS["count_most"]), WEIGHTS["count_step"] * F.abs(n - m)))


def year_points(release: Column, own: Column) -> Column:
    """Points of two years; null if either is absent."""
    gap = F.abs(release - own)
    return F.when(gap == 0, WEIGHTS["year_equal"]).when(gap > 0, -F.least(F.lit(WEIGHTS["year_most"]), WEIGHTS["year_step"] * gap))


def label_like(publisher: Column, label: Column) -> Column:
    p, x = F.lower(publisher), F.lower(label)
    return F.contains(p, x) | F.contains(x, p)


def own_year(date: str = "release_date") -> Column:
    return F.regexp_extract(date, "([0-9]{4})", 1).try_cast("int")


def score_digital(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(*KEY).agg(F.when(F.bool_or(F.contains(F.lower("medium_format"), F.lit("digital"))), WEIGHTS["digital"]).otherwise(0).alias("points"))


def score_year(candidates: DataFrame, albums: DataFrame) -> DataFrame:
    c = candidates.join(albums.select("app_id", own_year().alias("y")), "app_id", "left")
    points = F.coalesce(year_points(F.col("release_year"), F.col("y")), F.lit(0))
    return c.groupBy(*KEY).agg(F.max(points).cast("long").alias("points"))


def edit_likeness(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer text."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def assigned(rated: DataFrame, least: float) -> DataFrame:
    """(app_id, mbid, n, m, matched): how many v_idx get a position of their own, in their order, each the free one with the highest sim over least (ties by position).

    Rows of a candidate stand together, in order of v_idx; one without options has a
    row without v_idx. They are passed through once, many candidates to an Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        taken: set[int] = set()
        open_v, best = None, None
        done: list[tuple] = []
        for batch in batches:
            for *key, v, position, sim in zip(*(batch[c].to_pylist() for c in (*KEY, "n", "m", "v_idx", "position", "sim")), strict=True):
                if key != at or v != open_v:
                    if best is not None:
                        taken.add(best[1])
                    if key != at:
                        if at is not None:
                            done.append((*at, len(taken)))
                        at, taken = key, set()
                    open_v, best = v, None
                if sim is not None and sim > least and position not in taken and (best is None or (-sim, position) < best):
                    best = (-sim, position)
            if len(done) > 10_000:
                yield _counts(done)
                done = []
        if at is not None:
            done.append((*at, len(taken) + (best is not None)))
        yield _counts(done)

    longs = [F.col(c).cast("long") for c in (*KEY, "n", "m", "v_idx", "position")]
    return rated.select(*longs, "sim").mapInArrow(run, "app_id long, mbid long, n long, m long, matched long")


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["app_id", "mbid", "n", "m", "matched"])


def set_similarity(candidates: DataFrame, local: DataFrame, release_tracks: DataFrame, within_ms: int = 2000, least: float = 0.8, edits: bool = False) -> DataFrame:
    """Greedy one-to-one matches in local order by name, durations being near; ratio over the larger count times 200, cut.

    local: app_id, v_idx, title, duration_ms. edits: names are compared by edit
    distance, which Spark has itself, instead of by matching blocks.
    """
    a, b = F.lower("title").alias("title"), F.col("duration_ms").alias("ms")
    theirs = release_tracks.groupBy("mbid").agg(F.count("*").alias("m"), F.collect_list(F.struct("position", a, b)).alias("theirs"))
    mine = local.groupBy("app_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("v_idx", a, b))).alias("mine"))
    wide = by_album(candidates, mine, theirs)

    def options(x: Column) -> Column:
        near = lambda y: (F.abs(x["ms"] - y["ms"]) < within_ms) | x["ms"].isNull() | y["ms"].isNull()
        # Edit distance over the longer text is no less than over both.
        met = F.filter("theirs", lambda y: near(y) & may_be_like(x["title"], y["title"], least))
        return F.transform(met, lambda y: F.struct(x["v_idx"].alias("v_idx"), y["position"].alias("position"), x["title"].alias("title"), y["title"].alias("r_title")))

    rows = wide.select(*KEY, "n", "m", F.explode_outer(F.flatten(F.transform("mine", options))).alias("o")).select(*KEY, "n", "m", "o.*")
    sim = edit_likeness(F.col("title"), F.col("r_title")) if edits else likeness(F.col("title"), F.col("r_title"))
    out = assigned(rows.withColumn("sim", sim), least)
    return out.select(*KEY, F.floor(F.col("matched") / F.greatest("n", "m") * 200).cast("long").alias("points"))


def likeness(a: Column, b: Column) -> Column:
    """similarity; equal texts don't go to Python."""
    return F.when(a == b, 1.0).otherwise(similarity(F.when(a != b, a), b))


def like_count(least: float) -> Callable[[Column], Column]:
    """How many lists of texts have one that is more like their first than least."""

    @F.pandas_udf(LongType())
    def count(lists: pd.Series) -> pd.Series:
        return pd.Series([0 if x is None else sum(any(_ratio(texts[0], other) > least for other in texts[1:]) for texts in x) for x in lists], dtype="int64")

    return count


def by_album(candidates: DataFrame, mine: DataFrame, theirs: DataFrame, how: str = "inner") -> DataFrame:
    """Distinct candidates with the lists of their release (by mbid) and their album (by app_id): a candidate is one row on its way, however many tracks either side has."""
    return candidates.select(*KEY).repartition("mbid").distinct().join(theirs, "mbid").join(mine, "app_id", how)


def title_coverage(candidates: DataFrame, local: DataFrame, release_tracks: DataFrame, least: float = 0.85, exact: bool = False) -> DataFrame:
    """Local titles (app_id, title) with a like title in the release, over the release's tracks; 200 points from 0.8 up."""
    if exact:
        m = release_tracks.groupBy("mbid").agg(F.count("*").alias("m"))
        mine = local.select("app_id", F.lower("title").alias("title")).distinct()
        theirs = release_tracks.select("mbid", F.lower("title").alias("r_title")).distinct()
        c = pairs(candidates)
        like = c.join(theirs, "mbid").join(mine, (mine["app_id"] == c["app_id"]) & (F.col("title") == F.col("r_title"))).select(c["app_id"], "mbid", "title")
        out = c.join(m, "mbid").join(like.groupBy(*KEY).agg(F.countDistinct("title").alias("covered")), KEY, "left")
    else:
        mine = local.groupBy("app_id").agg(F.collect_set(F.lower("title")).alias("mine"))
        theirs = release_tracks.groupBy("mbid").agg(F.count("*").alias("m"), F.collect_set(F.lower("title")).alias("theirs"))
        wide = by_album(candidates, mine, theirs, "left")
        # Titles that the release has as they are need no measure; of the others those that may be like one of its.
        others = F.array_except("mine", "theirs")
        options = F.transform(others, lambda a: F.concat(F.array(a), F.filter("theirs", lambda b: may_be_like(a, b, least))))
        rows = wide.select(*KEY, "m", F.size(F.array_intersect("mine", "theirs")).alias("same"), F.filter(options, lambda o: F.size(o) > 1).alias("options"))
        out = rows.withColumn("covered", F.col("same") + like_count(least)(F.when(F.size("options") > 0, F.col("options"))))
    ratio = F.coalesce("covered", F.lit(0)) / F.col("m")
    return out.select(*KEY, F.round(ratio, 4).alias("coverage"), F.when(ratio >= 0.8, WEIGHTS["coverage"]).otherwise(0).alias("points"))


def candidate_evidence(candidates: DataFrame, albums: DataFrame, files: DataFrame, release_tracks: DataFrame, hits: DataFrame | None = None, more: dict[str, DataFrame] | None = None, urls: tuple[str, ...] = ("url",)) -> DataFrame:
    """One row per candidate with score, the ordered evidence (an array of notes), title, label, year, tracks and digital.

    All kinds of points are worked out in one pass over candidates: facts of its
    release, its album and the album's hits, put together by release and by album,
    are joined to a candidate's rows, which are then folded without another shuffle;
    score and notes come from one list of (note, points). A kind that
    a candidate lacks leaves no note. more: further scores (app_id, mbid, points)
    by name, such as set_similarity's, noted with their points.

    A candidate with several rows has the smallest of its titles and labels, no
    label being `Unknown`, and its best year's points.
    """
    rows = with_links(candidates.select(*KEY, "title", "label", "release_year", F.contains(F.lower("medium_format"), F.lit("digital")).alias("digital"), *urls), urls)
    # Candidates meet their release first, then all that is known of their album, by which they stay until they are ranked.
    released = [F.count("*").alias("m"), *([F.collect_set("recording_id").alias("_theirs")] if hits is not None else [])]
    rows = rows.join(release_tracks.groupBy("mbid").agg(*released), "mbid", "left")
    rows = rows.join(albums.select("app_id", "parent_app_id", "publisher", own_year().alias("y")), "app_id", "left")
    rows = rows.join(files.groupBy("app_id").agg(F.count("*").alias("n")), "app_id", "left")
    found = {}
    if hits is not None:
        rows = rows.join(hits.groupBy("app_id").agg(F.collect_set("recording_id").alias("_mine"), F.collect_set("release_id").alias("_releases")), "app_id", "left")
        found = {"shared": F.coalesce(F.size(F.array_intersect("_theirs", "_mine")), F.lit(0)), "hit": F.coalesce(F.array_contains("_releases", F.col("mbid")), F.lit(False))}
    flags = link_flags(F.col("app_id"), F.col("parent_app_id"), len(urls))
    year = F.struct(year_points(F.col("release_year"), F.col("y")).alias("points"), F.col("release_year").alias("year"))
    facts = {"best": F.when(year["points"].isNotNull(), year), "like": label_like(F.col("publisher"), F.col("label")), **{f"link{i}": cond for i, (_, cond) in enumerate(flags.values())}, **found}
    wide = rows.select(*KEY, "title", "label", "release_year", "digital", "m", "n", *[c.alias(k) for k, c in facts.items()]).groupBy(*KEY).agg(
        F.min("title").alias("title"),
        F.coalesce(F.min("label"), F.lit("Unknown")).alias("label"),
        F.max("best").alias("best"),
        F.min("release_year").alias("any_year"),
        F.bool_or("like").alias("like"),
        F.coalesce(F.bool_or("digital"), F.lit(False)).alias("digital"),
        *[F.bool_or(f"link{i}").alias(f"link{i}") for i in range(len(flags))],
        *[F.max(c).alias(c) for c in ("m", "n", *found)],
    )
    parts: list[tuple[Column, Column]] = []
    if hits is not None:
        parts += [(F.lit("release_hit"), F.when(F.col("hit"), WEIGHTS["release_hit"])), (_noted("recording_hit", F.col("shared")), F.when(F.col("shared") > 0, WEIGHTS["recording_hit"]))]
    parts += [(F.lit(note), F.when(F.col(f"link{i}"), WEIGHTS[w])) for i, (note, (w, _)) in enumerate(flags.items())]
    parts.append((F.lit("label"), F.when(F.col("like"), WEIGHTS["label"])))
    for note, points in (("track_count", count_points(F.col("n"), F.col("m"))), ("year", F.col("best.points"))):
        parts.append((F.when(points > 0, F.lit(note)).otherwise(_noted(note, points)), points))
    parts.insert(-1, (F.lit("digital"), F.when(F.col("digital"), WEIGHTS["digital"])))
    for name, points in (more or {}).items():
        wide = wide.join(points.select(*KEY, F.col("points").alias(name)), KEY, "left")
        parts.append((_noted(name, F.col(name)), F.nullif(F.col(name), F.lit(0))))
    score = reduce(add, [F.coalesce(p, F.lit(0)) for _, p in parts])
    evidence = F.array_compact(F.array(*[F.when(p.isNotNull(), note) for note, p in parts]))
    return wide.select(*KEY, "title", "label", F.coalesce("best.year", "any_year").alias("year"), F.coalesce("m", F.lit(0)).alias("tracks"), "digital", score.cast("long").alias("score"), evidence.alias("evidence"))


def _noted(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}("), value.cast("string"), F.lit(")"))


def ranked_evidence(scored: DataFrame, keep: int = 5) -> DataFrame:
    """The best `keep` candidates of each album with their rank, ties by mbid."""
    rank = F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("score"), "mbid"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= keep)


def strong_candidates(ranked: DataFrame) -> DataFrame:
    """(app_id, mbid) of best candidates whose evidence ties them to the album: a link of its own or shared recordings."""
    tied = F.exists("evidence", lambda e: F.startswith(e, F.lit("own_link:")) | F.startswith(e, F.lit("recording_hit(")))
    return ranked.where((F.col("rank") == 1) & tied).select(*KEY)


def rank_candidates(scores: list[DataFrame], keep: int = 5) -> DataFrame:
    """Sum of all points per candidate; the best `keep` per album, ties by mbid."""
    total = scores[0].select(*KEY, "points")
    for s in scores[1:]:
        total = total.unionByName(s.select(*KEY, "points"))
    total = total.groupBy(*KEY).agg(F.sum("points").alias("score"))
    rank = F.row_number().over(Window.partitionBy("app_id").orderBy(F.desc("score"), "mbid"))
    return total.withColumn("rank", rank).where(F.col("rank") <= keep)


def source_matrix(albums: DataFrame, files: DataFrame, ranked: DataFrame, candidates: DataFrame, release_tracks: DataFrame) -> DataFrame:
    """One row per source and candidate: title, number of tracks, year; ranked candidates that have these already are not looked up again."""
    store = albums.select("app_id", F.lit("store").alias("source"), F.lit(0).alias("rank"), F.col("name").alias("title"), F.lit(None).cast("long").alias("tracks"), F.regexp_extract("release_date", "([0-9]{4})", 1).try_cast("int").alias("year"))
    local = files.groupBy("app_id").agg(F.count("*").alias("tracks")).select("app_id", F.lit("local").alias("source"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("title"), "tracks", F.lit(None).cast("int").alias("year"))
    found = ranked
    if "title" not in ranked.columns:
        m = release_tracks.groupBy("mbid").agg(F.count("*").alias("tracks"))
        found = ranked.join(candidates.groupBy(*KEY).agg(F.min("title").alias("title"), F.min("release_year").alias("year")), KEY).join(m, "mbid", "left")
    found = found.select("app_id", F.lit("search").alias("source"), "rank", "title", F.nullif("tracks", F.lit(0)).alias("tracks"), "year")
    return store.unionByName(local).unionByName(found)
