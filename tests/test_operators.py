"""Unit cases of the operators: order-dependent passes against plain models, and single rules."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from colligo.functions.text import clean_title, norm_stem
from colligo.operators import grouping as G
from colligo.operators import judging as J
from colligo.operators import ledger as L
from colligo.operators import quota as Q
from colligo.operators import scan as S
from colligo.operators import scoring
from colligo.operators import verdict as V
from colligo.sources import tables
from colligo.sources.views import view
from colligo.streaming import jobs

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "want"), [("C:\\Program Files (x86)\\Steam", "/mnt/c/Program Files (x86)/Steam"), ("D:\\Games\\Library", "/mnt/d/Games/Library"), ("/home/user/test", "/home/user/test"), ("folder\\sub", "folder/sub"), ("", ""), ("C:\\Test", "/mnt/c/Test")])
def test_normalize_path(spark, path, want):
    assert one(spark, S.normalize_path(F.col("p")), p=path) == want


def test_list_media(spark):
    rows = spark.createDataFrame([("a/b.mp3", "mp3"), ("a/.b.mp3", "mp3"), ("a/__MACOSX/b.mp3", "mp3"), ("a/b.txt", "txt"), ("b.FLAC", "FLAC")], "path string, ext string")
    assert {r.path for r in S.list_media(rows).collect()} == {"a/b.mp3", "b.FLAC"}


def test_grouping_of_two_formats(spark):
    files = spark.createDataFrame([(1, 1, 1, "01 - Main Theme", "mp3", 120.0), (1, 2, 1, "01. Main Theme", "flac", 120.0), (1, 3, 1, "02 - Battle", "mp3", 120.0)], "app_id long, file_no int, disc int, stem string, fmt string, duration_s double")
    got = {r.norm_stem: r.variants for r in G.group_tracks_exact(files).collect()}
    assert got == {"main theme": 2, "battle": 1}
    assert {r.norm_stem: r.fmt for r in G.adopt_format(files).collect()} == {"main theme": "flac", "battle": "mp3"}
    numbers = {r.file_no: r.group_no for r in G.group_tracks(files).collect()}
    assert numbers[1] == numbers[2] != numbers[3]


def test_album_name_is_removed(spark):
    assert one(spark, norm_stem(F.col("s"), F.col("a")), s="01 - Epic Game Soundtrack - Main Theme", a="Epic Game Soundtrack") == "main theme"
    assert one(spark, norm_stem(F.col("s")), s="03 - 曲 100") == "曲 100"
    assert one(spark, norm_stem(F.col("s"), ascii_only=True), s="Theme 100") == "theme 1 0"


def test_clean_title(spark):
    at = lambda s, n: one(spark, clean_title(F.col("s"), F.col("n")), s=s, n=n)
    assert at("01. Song", "1") == "Song"
    assert at("14.3 Billion Years", "14") == "14.3 Billion Years"
    assert at("7 - Song", "8") == "7 - Song"


def test_greedy_groups_against_a_plain_model(spark):
    files = view(spark, SF, "local_files").where("app_id < 300")
    got = {(r.app_id, r.file_no): r.group_no for r in G.group_tracks(files).collect()}
    rows = G.with_stems(files).orderBy("app_id", "file_no").collect()
    groups: dict = {}
    for r in rows:
        mine = groups.setdefault(r.app_id, [])
        for k, g in enumerate(mine):
            if g["disc"] == r.disc and (g["stem"] == r.norm_stem or abs(float(g["len"]) - float(r.duration_s)) < 1.0 and (r.track_no is not None and g["no"] == r.track_no or SequenceMatcher(None, r.norm_stem, g["stem"]).ratio() >= 0.85)):
                assert got[r.app_id, r.file_no] == k
                break
        else:
            mine.append({"disc": r.disc, "stem": r.norm_stem, "len": r.duration_s, "no": r.track_no})
            assert got[r.app_id, r.file_no] == len(mine) - 1
    assert len(got) == len(rows)


def test_a_large_album_is_grouped_like_a_small_one(spark):
    """20,000 files of one album, in batches, against a plain search of all groups."""
    made = [(1, i, 1, f"{i % 50:02d} - theme {i % 700}", float(i % 90), "flac") for i in range(20_000)]
    got = {r.file_no: r.group_no for r in G.group_tracks(spark.createDataFrame(made, "app_id long, file_no long, disc int, stem string, duration_s double, fmt string")).collect()}
    groups, want = [], {}
    for _, i, _, stem, length, _ in made:
        name, no = " ".join(stem[5:].split()), int(stem[:2])
        fit = next((k for k, (s, n, t) in enumerate(groups) if s == name or abs(t - length) < 1.0 and (n == no or SequenceMatcher(None, name, s).ratio() >= 0.85)), None)
        if fit is None:
            fit = len(groups)
            groups.append((name, no, length))
        want[i] = fit
    assert got == want


def test_title_coverage_against_a_plain_model(spark):
    c = view(spark, SF, "candidates").where("app_id < 20")
    local = view(spark, SF, "store_tracks").select("app_id", "v_idx", "title", (F.col("duration_s") * 1000).cast("long").alias("duration_ms")).where("app_id < 20")
    releases = view(spark, SF, "release_tracks")
    got = {(r.app_id, r.mbid): r.coverage for r in scoring.title_coverage(c, local, releases).collect()}
    titles: dict = {}
    for r in local.collect():
        titles.setdefault(r.app_id, set()).add(r.title.lower())
    tracks: dict = {}
    for r in releases.collect():
        tracks.setdefault(r.mbid, []).append(r.title.lower())
    for (a, m), x in got.items():
        n = sum(any(SequenceMatcher(None, t, u).ratio() > 0.85 for u in tracks[m]) for t in titles.get(a, ()))
        assert x == pytest.approx(n / len(tracks[m]), abs=1e-4)
    matched = scoring.set_similarity(c, local, releases).collect()
    assert all(0 <= r.points <= 200 for r in matched)


def test_similarity_depends_on_order(spark):
    row = spark.createDataFrame([("tide", "diet")], "a string, b string").select(scoring.similarity("a", "b").alias("x"), scoring.similarity("b", "a").alias("y")).first()
    assert (row.x, row.y) == (0.25, 0.5)


def test_confidence_fractions(spark):
    pct, early = J.confidence_gate(F.col("c"))
    rows = spark.createDataFrame([(0.95,), (1.0,), (100.0,), (None,)], "c double").select(F.round(pct, 6).alias("p"), early.alias("e")).collect()
    assert [(r.p, r.e) for r in rows] == [(95.0, True), (1.0, True), (100.0, False), (0.0, True)]


def test_salvage_json(spark):
    raw = 'x<think>{"a": 1}</think>```json\n{"identity_confidence": 0.95, "strategy": "HYBRID",}\n```'
    r = spark.createDataFrame([(raw,)], "raw string").select(J.salvage_json(F.col("raw")).alias("r")).first().r
    assert (r.identity_confidence, r.strategy) == (0.95, "HYBRID")


def test_verdict_is_archive_without_issues(spark):
    rows = V.verdict(V.tag_facts(view(spark, SF, "local_files").select("app_id", F.col("disc").alias("disc_number"), F.col("filename_track").alias("track_number"), F.col("stem").alias("title"))))
    assert rows.where("(status = 'archive') <> (message = 'Success')").isEmpty()


def test_upsert_is_idempotent(spark):
    old = view(spark, SF, "ledger").select("app_id", "status", "processed_at")
    new = old.where("app_id % 3 = 0").withColumn("status", F.lit("archive"))
    once = S.upsert(old, new, ["app_id"], ["processed_at"])
    twice = S.upsert(once, new, ["app_id"], ["processed_at"])
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_cooldown_gap(spark):
    sent = Q.kept_after_cooldown([0, 30_000_000, 60_000_000, 90_000_000, 120_000_001], 60)
    assert sent == [True, False, True, False, True]


def test_cooldown_stream_over_several_files(spark, tmp_path):
    rows = view(spark, SF, "notifications").orderBy("ts", "event_id")
    rows.repartitionByRange(5, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = jobs.cooldown_stream(jobs.read_events(spark, f"{tmp_path}/in", files_per_batch=10), seconds=3600)
    got = {r.event_id for r in jobs.drain(stream, f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    assert got == {r.event_id for r in Q.cooldown(view(spark, SF, "notifications"), seconds=3600).collect()}


def test_quota_stream_over_several_files_and_an_emptied_window(spark, tmp_path):
    # Two bursts of one service far apart, and requests of the same instant.
    rows = [("a", i, 1_700_000_000 + t, n) for i, (t, n) in enumerate([(0, 5), (0, 5), (10, 50), (59, 10), (60, 1), (61, 1), (900, 90), (901, 5), (930, 1)])] + [("b", 100, 1_700_000_030, 7)]
    made = spark.createDataFrame(rows, "service string, event_id long, s long, tokens long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for low, high in ((0, 45), (45, 100), (100, 1000)):
        s = F.unix_timestamp("ts") - 1_700_000_000
        made.where((s >= low) & (s < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    how = {"seconds": 60, "most_requests": 4, "most_tokens": 100}
    got = jobs.drain(jobs.quota_stream(jobs.read_events(spark, f"{tmp_path}/in"), **how), f"{tmp_path}/out", f"{tmp_path}/state")
    want = Q.rolling_quota(made, **how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert {r.label for r in got.collect()} == {"free", "wait", "jitter", "token_limited"}


def test_cooldown_stream_goes_on_from_what_was_sent_and_forgets_by_ttl(spark, tmp_path):
    rows = spark.createDataFrame([(1, 100, "a", 1), (2, 100, "b", 1), (3, 200, "b", 1)], "event_id long, s long, level string, title long").withColumn("ts", F.timestamp_seconds("s"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    events = jobs.read_events(spark, f"{tmp_path}/in")
    sent = events.sparkSession.createDataFrame([("a", 1, 90_000_000), ("a", 1, 20_000_000)], "level string, title long, at long")
    got = jobs.drain(jobs.cooldown_stream(events, seconds=60, sent=sent, ttl_seconds=86_400), f"{tmp_path}/out", f"{tmp_path}/state", once=True)
    assert sorted(r.event_id for r in got.collect()) == [2, 3]


def test_cache_stream_takes_over_what_is_kept(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "s", "q1"), (2, 10 * 86_400, "s", "q2")], "event_id long, s long, service string, query_key string").withColumn("fetched_at", F.timestamp_seconds("s"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    events = jobs.read_events(spark, f"{tmp_path}/in")
    kept = events.sparkSession.createDataFrame([("s", "q1", 7, 86_400), ("s", "q3", 8, 0)], "service string, query_key string, event_id long, s long").withColumn("fetched_at", F.timestamp_seconds("s"))
    got = jobs.drain(jobs.cache_stream(events, days=3, late="0 seconds", kept=kept), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.query_key, r.event_id) for r in got.collect()) == [("q1", 7), ("q3", 8)]


def files_in(folder):
    return {p: p.stat().st_size for p in folder.rglob("*.parquet")}


def test_upsert_table_writes_only_touched_buckets(spark, tmp_path):
    table = tables.UpsertTable(spark, f"file://{tmp_path}/t", "id long, v string, at long", ["id"], ["at"], buckets=16)
    rows = lambda ids, v, at: spark.createDataFrame([(i, v, at) for i in ids], "id long, v string, at long")
    assert len(table.upsert(rows(range(2000), "old", 1), 0)) == 16
    before = files_in(tmp_path / "t" / "data")
    assert len(table.upsert(rows([5], "new", 2), 1)) == 1
    added = {p: n for p, n in files_in(tmp_path / "t" / "data").items() if p not in before}
    assert sum(added.values()) < sum(before.values()) / 8
    assert {r.v for r in table.read().where("id = 5").collect()} == {"new"} and table.read().count() == 2000
    assert {r.v for r in table.read(0).collect()} == {"old"}
    # The same version again, and one whose rows are older than what is there.
    table.upsert(rows([5], "new", 2), 1)
    table.upsert(rows([5, 7, 9999], "late", 0), 2)
    got = {r.id: r.v for r in table.read().collect()}
    assert len(got) == 2001 and got[5] == "new" and got[7] == "old" and got[9999] == "late"
    table.upsert(rows([], "none", 0), 3)
    assert table.vacuum(keep=1) > 0 and table.latest() == 3
    assert {r.id: r.v for r in table.read().collect()} == got
    with pytest.raises(ValueError, match="removed"):
        table.upsert(rows([5], "again", 3), 3)
    assert {r.id: r.v for r in table.read().collect()} == got


def test_status_sink_reads_one_partition_of_a_committed_version(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/b", "archive"), (2, "c", "review"), (3, "d", None)], "app_id long, album_name string, status string")
    folder = f"file://{tmp_path}/s"
    with pytest.raises(ValueError, match="no committed"):
        tables.read_by_status(spark, folder, "archive")
    tables.write_by_status(rows, folder, 0)
    tables.write_by_status(rows, folder, 0)
    got = tables.read_by_status(spark, folder, "archive")
    assert [(r.app_id, r.item) for r in got.collect()] == [(1, "1_a_b")]
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "PartitionFilters: [isnotnull(" in plan and "archive" in plan.split("PartitionFilters")[1].split("]")[0]
    assert tables.read_by_status(spark, folder).count() == 3
    # A version that holds no archive rows shows none of the earlier one's.
    tables.write_by_status(rows.where("app_id = 2"), folder, 1)
    assert tables.read_by_status(spark, folder, "archive").count() == 0
    assert [r.app_id for r in tables.read_by_status(spark, folder).collect()] == [2]
    assert tables.read_by_status(spark, folder, "archive", version=0).count() == 1


def test_a_failing_album_is_a_row_and_not_a_failed_job(spark):
    def judge(pdf):
        if (pdf["app_id"] == 13).any():
            raise KeyError("bad album")
        return pdf[["app_id"]].assign(confidence=1.5)

    payloads = spark.createDataFrame([(i, "p") for i in range(40)], "app_id long, payload string").coalesce(1)
    got = {r.app_id: (r.confidence, r.error) for r in J.judge_albums(payloads, judge, "app_id long, confidence double", most=16).collect()}
    assert got.pop(13) == (None, "KeyError: 'bad album'")
    assert set(got) == set(range(40)) - {13} and set(got.values()) == {(1.5, None)}
    assert J.judge_albums(payloads.limit(0), judge, "app_id long, confidence double").collect() == []


def test_chunks_are_halved_until_whole(spark):
    tracks = spark.createDataFrame([(1, i, "x" * (30 if i == 3 else 1)) for i in range(11)], "app_id long, v_idx long, title string")
    asked = []

    def respond(rows):
        made = rows.groupBy("app_id", "start").agg(F.sum(F.length("title")).alias("n"))
        asked.extend(r.start for r in made.collect())
        return made.select("app_id", "start", F.when(F.col("n") > 20, "max_tokens").otherwise("stop").alias("done_reason"), F.lit(None).cast("string").alias("error"))

    got = J.rechunk_until_whole(tracks, 8, respond, lambda df: spark.createDataFrame(df.collect(), df.schema))
    assert {(r.start, r.size) for r in got.collect()} == {(0, 2), (2, 1), (3, 1), (4, 4), (8, 8)}
    assert got.count() == 11 and sorted(asked) == [0, 0, 0, 2, 2, 3, 4, 8]


@pytest.mark.parametrize("album", [r"foo\E(bar", "a.b*c[d]", "$1 \\Q x", "(", "Ünï (OST)"])
def test_album_names_with_signs_are_removed(spark, album):
    assert one(spark, norm_stem(F.col("s"), F.col("a")), s=f"01 - {album} - Main Theme", a=album) == "main theme"


def test_a_stem_of_very_many_numbers(spark):
    assert one(spark, norm_stem(F.col("s")), s="12 " * 20_000 + "end") == "end"


def test_evidence_takes_one_pass_over_candidates(spark):
    v = lambda n: view(spark, SF, n)
    cand = v("candidates")
    cand.write.mode("overwrite").saveAsTable("evidence_candidates")
    made = scoring.ranked_evidence(scoring.candidate_evidence(spark.table("evidence_candidates"), v("albums"), v("local_files"), v("release_tracks"), v("fingerprint_hits"), urls=("url", "url2")))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("evidence_candidates") == 1
    spark.sql("drop table evidence_candidates")


def test_evidence_of_absent_facts_and_more_scores(spark):
    cand = spark.createDataFrame([(1, 7, None, None, None, None, None), (1, 8, "t", 2001, "Lab", "Digital Media", "https://db.example.com/app/5x")], "app_id long, mbid long, title string, release_year int, label string, medium_format string, url string")
    albums = spark.createDataFrame([(1, 5, "Lab Inc", "2003-01-01")], "app_id long, parent_app_id long, publisher string, release_date string")
    none = spark.createDataFrame([], "app_id long")
    tracks = spark.createDataFrame([(8, 1), (8, 2)], "mbid long, recording_id long")
    more = {"set_similarity": spark.createDataFrame([(1, 8, 120), (1, 7, 0)], "app_id long, mbid long, points long")}
    got = {r.mbid: r for r in scoring.candidate_evidence(cand, albums, none, tracks, more=more).collect()}
    assert got[8].evidence == ["parent_link:db", "label", "track_count(-40)", "digital", "year(-40)", "set_similarity(120)"]
    assert got[8].score == 300 + 100 - 40 + 30 - 40 + 120
    # Neither side has a track, so their counts agree.
    assert got[7].evidence == ["track_count"] and got[7].label == "Unknown" and got[7].score == 50


def test_set_similarity_against_a_plain_model(spark):
    names = ["main theme", "main themes", "battle", "battle two", "battles", "ending"]
    rng = random.Random(4)
    local = [(a, i, rng.choice(names), rng.choice([None, 1000, 2500, 4000])) for a in range(6) for i in range(rng.randint(1, 7))]
    release = [(m, i + 1, rng.choice(names), rng.choice([None, 1000, 2500])) for m in range(5) for i in range(rng.randint(1, 6))]
    cand = [(a, m) for a in range(6) for m in range(5)]
    got = scoring.set_similarity(spark.createDataFrame(cand, "app_id long, mbid long"), spark.createDataFrame(local, "app_id long, v_idx int, title string, duration_ms long"), spark.createDataFrame(release, "mbid long, position int, title string, duration_ms long"))
    want = {}
    for a, m in cand:
        mine, theirs = [x for x in local if x[0] == a], [x for x in release if x[0] == m]
        taken = set()
        for _, _, t, d in mine:
            near = [(SequenceMatcher(None, t, y[2]).ratio(), -y[1]) for y in theirs if y[1] not in taken and (d is None or y[3] is None or abs(d - y[3]) < 2000)]
            if near and max(near)[0] > 0.8:
                taken.add(-max(near)[1])
        want[a, m] = int(len(taken) / max(len(mine), len(theirs)) * 200)
    assert {(r.app_id, r.mbid): r.points for r in got.collect()} == want


def test_tiers_of_any_number(spark):
    tiers = [spark.createDataFrame(rows, "app_id long, name string, tags array<string>") for rows in ([(1, " ", ["", None])], [(1, "b", ["x", " "]), (2, None, None)], [(1, "c", ["y"]), (3, "d", [])])]
    got = {r.app_id: (r.name, r.tags) for r in S.fold_tiers(S.union_tiers(tiers), ("name",), ("tags",)).collect()}
    assert got == {1: ("b", ["x"]), 2: (None, None), 3: ("d", None)}


def test_media_listing_and_manifests_are_read_from_files(spark, tmp_path):
    for name in ("a.mp3", ".b.mp3", "c.txt", "D.FLAC"):
        (tmp_path / name).write_bytes(b"12345")
    assert {(r.path.rsplit("/", 1)[1], r.length, r.ext) for r in S.read_media(spark, str(tmp_path)).collect()} == {("a.mp3", 5, "mp3"), ("D.FLAC", 5, "flac")}
    (tmp_path / "m.json").write_text('{"app_id": 1, "name": "n"}\n{"app_id": "x"}\n')
    assert sorted((r.app_id or 0, r.name) for r in S.read_manifests(spark, f"{tmp_path}/m.json").collect() if r.name) == [(1, "n")]


def test_odd_archives_order(spark):
    rows = spark.createDataFrame([(1, "abcd", "abcd"), (2, "abcd", "wxyz")], "app_id long, album_name string, title string")
    assert [r.app_id for r in L.odd_archives(rows).collect()] == [2]


def test_no_cartesian_product(spark):
    plan = spark._jvm.PythonSQLUtils.explainString(V.verdict(V.tag_facts(view(spark, SF, "local_files").select("app_id", F.col("disc").alias("disc_number"), F.col("filename_track").alias("track_number"), F.col("stem").alias("title"))))._jdf.queryExecution(), "simple")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
