"""The ten corpus operators against brute force on small fixtures, with nulls, empties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import re
import tarfile
import unicodedata
import zlib

from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colligo.llm import buckets, common, components, html_extract, langid, line_dedup, media, minhash, mixing, packing, pii, queries, shingles, simhash, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one", "en", "a", 3), (3, "one", "en", "a", 3), (None, "no id here", None, "b", 10), (4, " \n ", "de", None, 3), (5, "x" * 30_000, "fr", "b", 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, repeats and long texts, and extra columns whose names operators might use themselves."""
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({c: F.lit(1) for c in ("_id", "_tie", "key", "id", "tie", "copy", "_row", "comp", "u", "v", "kept", "n", "score")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


# 1: line dedup


def deduped(spark, texts, **how):
    return {r["doc_id"]: (r["text"], r["n_removed"]) for r in rows(line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string"), **how))}


def kept_lines(texts, block_words):
    """Plain search: a line goes if it lies in a run of lines with block_words words or more that an earlier text has as well."""
    split = [[" ".join(x.split()) for x in t.split("\n")] for t in texts]
    out, earlier = [], set()
    for lines in split:
        some = [i for i, x in enumerate(lines) if x]
        spans = [(i, j) for i in range(len(some)) for j in range(i + 1, len(some) + 1) if sum(len(lines[k].split()) for k in some[i:j]) >= block_words]
        spans = [(i, j, tuple(lines[k] for k in some[i:j])) for i, j in spans]
        gone = {k for i, j, run in spans if run in earlier for k in range(some[i], some[j - 1] + 1)}
        out.append([x for k, x in enumerate(lines) if k not in gone])
        earlier |= {run for _, _, run in spans}
    return out


def test_line_dedup_removes_blocks_from_the_later_document_only(spark):
    a, b, c = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "u v w"
    texts = [(1, f"{a}\n{b}\n{c}"), (2, f"own line here\n{b}\nmore\n{a}"), (3, "nothing shared at all"), (4, f"{c}\nrest"), (5, a)]
    assert deduped(spark, texts, block_words=8) == {1: (texts[0][1], 0), 2: ("own line here\nmore", 2), 3: (texts[2][1], 0), 4: (texts[3][1], 0), 5: ("", 1)}
    # With more words to a block, single lines are none, but two aligned ones are.
    assert deduped(spark, [*texts, (6, f"x\n{a}\n\n  {b}\r\ny")]) == {**{i: (t, 0) for i, t in texts}, 6: ("x\ny", 3)}


def test_line_dedup_of_short_lines(spark):
    verse = "\n".join(f"line {w} of verse" for w in "one two three four five six seven eight nine ten eleven twelve thirteen".split())
    texts = [(1, verse), (2, verse), (3, f"own\n{verse}\nend"), (4, "line one of verse\nother")]
    texts += [(5, "a long line of at least eight words here"), (6, "a long line of at least eight words here\nroses are red\nviolets are blue\nso are you"), (7, "roses are red\nviolets are blue\nso are you")]
    got = {i: t for i, (t, _) in deduped(spark, texts, block_words=8).items()}
    assert got == {1: verse, 2: "", 3: "own\nend", 4: texts[3][1], 5: texts[4][1], 6: "roses are red\nviolets are blue\nso are you", 7: ""}


def test_line_dedup_against_brute_force(spark):
    rng = np.random.default_rng(12)
    pool = [" ".join(f"w{int(k)}" for k in rng.integers(0, 99, rng.integers(0, 7))) for _ in range(24)]
    ends = ["", "", " ", "\r", "\t"]
    texts = ["\n".join(pool[int(i)] + ends[int(e)] for i, e in zip(rng.integers(0, 24, n), rng.integers(0, 5, n), strict=True)) for n in rng.integers(1, 14, 60)]
    texts += ["\n".join([*t.split("\n")[k:], *t.split("\n")[:k]]) for t, k in zip(texts[:20], rng.integers(0, 9, 20), strict=True)]
    got = deduped(spark, list(enumerate(texts)), block_words=8)
    want = kept_lines(texts, 8)
    assert [[" ".join(x.split()) for x in got[i][0].split("\n")] for i in range(len(texts))] == [w or [""] for w in want]
    assert sum(n for _, n in got.values()) > 50


def test_line_dedup_keeps_every_line_once(docs):
    before, after = docs.select("text").collect(), line_dedup.line_dedup(docs).collect()
    lines = lambda rs: {" ".join(x.split()) for r in rs for x in r.text.split("\n")} - {""}
    assert lines(before) == lines(after)
    held: dict = {}
    for r in after:
        for x in {x.strip() for x in r.text.split("\n") if len(x.split()) >= 16}:
            assert held.setdefault(x, r.doc_id) == r.doc_id


def test_reversed_long_texts_take_bounded_time():
    import time

    a = list(range(1, 20_001))
    began = time.time()
    found = line_dedup.common_blocks(a, [9] * 20_000, a[::-1], [9] * 20_000, 8)
    assert found == list(range(20_000)) and time.time() - began < 10
    assert line_dedup.common_blocks(a, [9] * 20_000, a[10_000:] + a[:10_000], [9] * 20_000, 8) == list(range(20_000))


def test_passages_in_any_order_are_deleted():
    """400 common lines, shuffled or reversed, with lines of the later text's own between and repeats."""
    rng = np.random.default_rng(12)
    a = list(range(1, 401))
    for b in (a[::-1], rng.permutation(a).tolist(), rng.permutation(a * 2).tolist()):
        own = [x for i, v in enumerate(b) for x in ((v, -i - 1) if i % 3 == 0 else (v,))]
        found = line_dedup.common_blocks(a, [16] * len(a), own, [16] * len(own))
        assert found == [i for i, v in enumerate(own) if v > 0]


def test_chains_hold_every_pair_once():
    rng = np.random.default_rng(13)
    for _ in range(100):
        pairs = sorted({(int(x), int(y)) for x, y in rng.integers(0, 12, (15, 2))})
        chains = line_dedup.chains(pairs)
        assert sorted(p for c in chains for p in c) == pairs
        assert all(x[0] < y[0] and x[1] < y[1] for c in chains for x, y in zip(c, c[1:], strict=False))


def test_patience_is_a_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 8, rng.integers(0, 15)).tolist(), rng.integers(0, 8, rng.integers(0, 15)).tolist()
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
    assert line_dedup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


def test_line_dedup_odd_rows(odd, empty):
    got = line_dedup.line_dedup(odd)
    assert got.count() == len(ODD) and set(odd.columns) <= set(got.columns)
    assert line_dedup.line_dedup(empty).count() == 0


def shuffled_texts(df, text_col="text"):
    """Rows written by each exchange that carries the text, of the plan as it ran."""

    def nodes(plan):
        kind = plan.getClass().getSimpleName()
        inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        return [(kind, plan), *(x for p in inner for x in nodes(p))]

    found = nodes(df._jdf.queryExecution().executedPlan())
    return [p.metrics().apply("shuffleRecordsWritten").value() for kind, p in found if kind == "ShuffleExchangeExec" and f"{text_col}#" in p.output().toString()]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_line_dedup_shuffles_only_texts_that_lose_lines(spark, threshold):
    """Whether the lines to delete are few enough to be broadcast or not; copies, nulls and rows without an id among them."""
    line = " ".join(f"w{i}" for i in range(20))
    texts = [(i, f"text {i} of its own") for i in range(300)] + [(300, line), (301, f"own\n{line}"), (301, f"own\n{line}"), (None, line), (None, None), (302, None)]
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        made = line_dedup.line_dedup(spark.createDataFrame(texts, "doc_id long, text string"))
        got = sorted((tuple(r) for r in made.collect()), key=str)
        assert shuffled_texts(made) == [3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    want = {301: ("own", 1), None: ("", 1)}
    assert got == sorted(((i, *want.get(i, (t, 0))) if t else (i, t, 0) for i, t in texts), key=str)


def test_line_dedup_where_all_documents_share_a_bit(spark, monkeypatch):
    """A bit table that is full sends every text through the join, with the same rows."""
    texts = [(1, " ".join("abcdefghijklmnopqrst")), (2, "own\n" + " ".join("abcdefghijklmnopqrst")), *((i, f"text {i}") for i in range(3, 40))]
    want = deduped(spark, texts)
    assert want[2] == ("own", 1) and sum(n for _, n in want.values()) == 1
    monkeypatch.setattr(line_dedup, "SLOTS", 64)
    assert deduped(spark, texts) == want


def test_hot_join_deals_rows_of_a_large_key(spark):
    """The rows of an inner join, each once; a key of many rows is dealt over tasks, others are not."""
    left = spark.range(1000).select(F.when(F.col("id") < 800, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(k, s) for k in range(0, 1000, 5) for s in "ab"], "k long, s string")
    spread = common.hot_join(left, right, "k", "x", 50)
    assert sorted(map(tuple, spread.select("k", "x", "s").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "s").collect()))
    # Parts are told without a shuffle by the key alone.
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(k#\d+L?, \d+\)", plan)
    assert common.hot_join(left, right.limit(0), "k", "x", 50).count() == 0


# 2: fingerprints


def votes(text: str, hash_of) -> int:
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    total, bits = 0, [0] * 64
    for a, b in zip(words, [*words[1:], None], strict=False):
        w, h = len(a) + len(b or ""), hash_of(a, b)
        total += w
        for i in range(64):
            bits[i] += w * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * bits[i] > total)


def test_fingerprints_against_brute_force(spark, docs):
    few = docs.where("doc_id < 12")
    pairs = few.select(F.explode(simhash.terms(F.col("text"))).alias("t")).select("t.a", "t.b").distinct()
    known = {(r.a, r.b): r.h & (2**64 - 1) for r in pairs.select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(few).collect()}
    assert got == {r.doc_id: votes(r.text, lambda a, b: known[a, b]) for r in few.collect()}


def test_edited_texts_and_next_documents(docs):
    got = simhash.compare_edited(docs).toPandas().sort_values("doc_id")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    assert got["edited_sha256"].tolist() == [hashlib.sha256(e.encode()).hexdigest() for e in edited]
    prints = [int(x, 16) for x in got["fingerprint"]]
    assert got["near_next"].tolist() == [1 - bin(a ^ b).count("1") / 64 for a, b in zip(prints, prints[1:] + prints[:1], strict=True)]
    assert got["near_edited"].mean() > got["near_next"].mean() + 0.1


def test_block_tables_find_all_near_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 40, dtype=np.int64).tolist()
    near = [x ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False)) for x in base for _ in range(4)]
    prints = sorted(set(base + near))
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r.fp: r.near_class for r in simhash.near_classes(spark.createDataFrame([(p,) for p in prints], "fp long"), 3).collect()}
    assert got == {p: find(p) for p in prints}


def test_next_documents_over_many_buckets(spark):
    """Small buckets, with repeated and absent ids and copies of one row, against a plain sort."""
    rng = np.random.default_rng(9)
    made = [(int(i), f"text {i} {w}") for i, w in zip(rng.integers(-50, 50, 300), rng.integers(0, 9, 300), strict=True)]
    made += [(7, f"same id {i}") for i in range(200)] + [(None, f"no id {i}") for i in range(100)] + [(3, "same row")] * 50
    d = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    got = simhash.in_id_order(d, bucket_bytes=100).collect()
    ties = {r.text: r.tie for r in d.select("text", F.xxhash64("text").alias("tie")).distinct().collect()}
    order = sorted(made, key=lambda x: (x[0] is not None, x[0] or 0, ties[x[1]]))
    assert [(r.id, r.text) for r in sorted(got, key=lambda r: r.rid)] == order
    assert [r.next_text or order[0][1] for r in sorted(got, key=lambda r: r.rid)] == [t for _, t in order[1:] + order[:1]]
    rids = sorted(r.rid for r in got)
    assert {r.rid: r.next_rid for r in got} == dict(zip(rids, rids[1:] + rids[:1], strict=True)) and len({r.bucket for r in got}) > 30


def test_the_plan_of_the_id_order_does_not_grow_with_buckets(spark):
    d = spark.createDataFrame([(i, f"text {i} of some words") for i in range(3000)], "doc_id long, text string")
    sizes = []
    for bucket_bytes in (20_000, 100):
        made = simhash.in_id_order(d, bucket_bytes=bucket_bytes)
        sizes.append(len(made._jdf.queryExecution().optimizedPlan().toString()))
        assert made.count() == 3000
    assert abs(sizes[0] - sizes[1]) < 200


def test_fingerprints_odd_rows(odd, empty):
    got = rows(simhash.compare_edited(odd))
    assert len(got) == len(ODD)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 4)} == {"0" * 16}
    assert simhash.compare_edited(empty).count() == 0


# 3: media columns


def test_media_round_trip_and_shards(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/shards"
    got = {r["doc_id"]: r for r in rows(media.media_columns(docs, folder))}
    for r in docs.collect():
        payload, g = media.padded(r.text.encode()), got[r.doc_id]
        assert (g["n_bytes"], g["payload_bytes"], g["width"], g["height"] * 64) == (len(r.text.encode()), len(payload), 64, len(payload))
        assert g["payload_sha256"] == g["digest"] == hashlib.sha256(payload).hexdigest()
        assert g["tail_crc32"] == zlib.crc32(payload[-64:]) and g["feature"] == media.feature(payload)
        stored = Path(g["shard"].removeprefix("file://")).read_bytes()[g["offset"] : g["offset"] + g["length"]]
        assert hashlib.sha256(stored).hexdigest() == g["media_sha256"] and media.from_png(stored) == payload
    files = list((tmp_path / "shards").glob("*/*"))
    assert {f"file://{f}" for f in files} == {g["shard"] for g in got.values()}
    for shard in files:
        with tarfile.open(shard) as t:
            names = t.getnames()
            assert len(names) == len(set(names)) and all(n.endswith(".png") for n in names)


def test_media_small_shards_and_headers(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/s"
    stored = media.store(docs.select(F.encode("text", "UTF-8").alias("raw")), folder, shard_bytes=20_000).cache()
    assert stored.select("shard").distinct().count() > 3
    assert media.headers(stored).where("width <> 64 or bit_depth <> 8").isEmpty()


def test_media_odd_rows(odd, empty, tmp_path):
    got = rows(media.media_columns(odd, f"file://{tmp_path}/o"))
    assert len(got) == len(ODD)
    assert {r["payload_sha256"] for r in got if r["doc_id"] in (1, 2)} == {hashlib.sha256(bytes(64)).hexdigest()}
    assert media.media_columns(empty, f"file://{tmp_path}/e").count() == 0


# 4: PII


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str) -> list:
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(pii.PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_brute_force(spark, docs):
    hard = ["a@b.c_d@e.f x@y", "1.2.3.4.5 256.1.1.1 001.02.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112 +49 (30) 123-4567 8", "é@b.c ä+1 (2", "@@a@b.co..@c.d", "", "+1" * 40]
    texts = [(i, t) for i, t in enumerate(hard)] + [(100 + r.doc_id, r.text) for r in docs.collect()]
    got = pii.find(spark.createDataFrame(texts, "doc_id long, text string"))
    for r in got.collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == base_spans(dict(texts)[r.id])


def test_disclosing_terms_and_sanitised_text(spark):
    said = [(i, f"Ms Quimby wrote from q@example.org on day {i} about {w}") for i, w in enumerate(("tea", "rain", "birds", "trains"))]
    plain = [(10 + i, f"Nobody wrote from home about {w}") for i, w in enumerate(("tea", "rain", "birds", "trains") * 3)]
    d = spark.createDataFrame(said + plain, "doc_id long, text string")
    terms = {r.id: [said[r.id][1][s.start : s.end] for s in r.terms] for r in pii.find(d).where("id < 10").collect()}
    assert all("Quimby" in t and "wrote" not in t and "about" not in t for t in terms.values())
    clean = {r.doc_id: r.text for r in pii.sanitise(d).collect()}
    assert "Quimby" not in clean[0] and "<EMAIL>" in clean[0] and clean[10] == plain[0][1]


def test_terms_of_rare_entities_are_placed_on_every_line(spark):
    once = "Reach Zephyrine about rain\nmail z@example.net of Zephyrine about birds"
    texts = [(1, once), (2, "news\n\nDear zephyrine, rain"), (3, "copied line of Wolfram at w@example.org"), (4, "copied line of Wolfram at w@example.org")]
    plain = [(10 + i, f"Reach nobody, mail the news about rain and birds, a copied line of what stands at {i}") for i in range(4000)]
    d = spark.createDataFrame(texts + plain, "doc_id long, text string")
    terms = {r.id: [dict(texts)[r.id][s.start : s.end] for s in r.terms] for r in pii.find(d).where("id < 10").collect()}
    assert terms == {1: ["Zephyrine", "Zephyrine"], 2: ["zephyrine"], 3: ["Wolfram"], 4: ["Wolfram"]}
    assert pii.find(d).where("id >= 10 and size(terms) > 0").count() == 0


def test_long_runs_and_many_spans_on_a_line(spark):
    """Texts on which a matcher that recurses or sums anew for each span would die or crawl."""
    texts = ["9" * 1_000_000, "a@b" + ".c" * 200_000, "1." * 100_000, "a" + "." * 300_000 + "b", "+1" + "(" * 300_000, " ".join(f"u{i}@h{i}.org" for i in range(5000)), "  ".join(["4111111111111111"] * 5000)]
    got = {r.id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [len(got[i]) for i in range(7)] == [0, 1, 25_000, 0, 0, 5000, 5000]
    assert got[5] == base_spans(texts[5]) and got[6] == base_spans(texts[6])


def test_disclosing_terms_against_brute_force(spark, docs):
    from math import log, sqrt

    few = docs.where("doc_id < 120")
    lines = [x for r in few.collect() for x in (r.text or "").split("\n") if x.split()]
    assert max(len(x.split()) for x in lines) > pii.CONTEXT
    parts = [" ".join(w[i : i + pii.CONTEXT]) for w in (re.split(r"[\x20\x09-\x0d]+", x.strip(" \t\x0b\f\r")) for x in lines) for i in range(0, len(w), pii.CONTEXT)]
    strip = lambda t: re.sub(r"^[\W\d_]+|[\W\d_]+$", "", t).lower()
    terms = [{strip(t) for t in p.split(" ") if not re.search("[0-9@]", t) and len(strip(t)) >= pii.MIN_LETTERS} for p in parts]
    held = [{(k, p[a:b].lower()) for k, a, b in base_spans(p)} for p in parts]
    n, want = len(parts), {}
    for e in set().union(*held):
        where = [i for i, h in enumerate(held) if e in h]
        for t in set().union(*(terms[i] for i in where)):
            both, n_t = [i for i in where if t in terms[i]], sum(t in x for x in terms)
            p = len(both) / n_t
            m = len({parts[i] for i in both}) / p
            low = (p + 1 / (2 * m) - sqrt(p * (1 - p) / m + 1 / (4 * m * m))) / (1 + 1 / m)
            d = log(low * n / len(where)) / log(n / len(where))
            if d >= 0.75:
                want[t, hashlib.md5(":".join(e).encode()).hexdigest()] = d
    rows_ = few.select(F.col("doc_id").alias("id"), "text")
    found = rows_.select("id", "text", pii.base_spans(F.col("text")).alias("spans"))
    got = {(r.term, r.e): r.disclosure for r in pii.disclosing_terms(rows_, pii.entities(found)).collect()}
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_terms_of_texts_equal_terms_of_tokens(spark):
    """Terms are taken from whole texts, places from single tokens: both must see the same terms."""
    rng = np.random.default_rng(17)
    signs = list("abÄßİΣ9@.-_'\u0301 \t\n\x0b,") + ["\U0001f600", "\U00010400", "日", "\u2003", "\xa0"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 40)))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    whole = {r.id: set(r.t) for r in rows.select("id", pii.terms_of(F.col("text")).alias("t")).collect()}
    tokens = rows.select("id", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).where(pii.is_term(F.col("w")))
    single: dict = {i: set() for i in whole}
    for r in tokens.select("id", F.lower(pii.stripped(F.col("w"))).alias("t")).collect():
        single[r.id].add(r.t)
    assert whole == single and sum(map(len, whole.values())) > 500


def test_terms_against_brute_force(spark):
    """The pattern of a token against its definition, also on runs that a matcher could go through again and again."""
    rng = np.random.default_rng(18)
    signs = list("abcÄß79@.-_'\u0301 \t\n\x0b\r,") + ["\U0001f600", "\U00010400", "日", "\u2003", "\x85", "\xa0"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 40)))) for _ in range(1500)] + ["." * 300_000, "a" + "." * 300_000 + "b", "a" + "-" * 300_000, "\U00010400b" * 100_000, "ab." * 100_000 + "7"]

    def want(text: str) -> set:
        kept = [t for t in re.split(r"[\x20\x09-\x0d]+", text) if not re.search("[0-9@]", t)]
        cores = [t[min(at) : max(at) + 1] for t in kept if (at := [i for i, c in enumerate(t) if unicodedata.category(c)[0] == "L"])]
        return {c.lower() for c in cores if len(c) >= pii.MIN_LETTERS}

    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: set(r.t) for r in rows.select("id", pii.terms_of(F.col("text")).alias("t")).collect()}
    assert got == {i: want(t) for i, t in enumerate(texts)}


def test_context_counts_and_their_plan(spark):
    """Counts of contexts; the bit table is a condition, no column that each context has a copy of."""
    texts = ["One two, two\n\nthree (ONE)", "", None, "two x1two", " \r\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("text", F.coalesce("text", F.lit("")))
    found = pii.context_counts(rows, pii.slot_bits(spark.createDataFrame([("one",), ("two",)], "term string")))
    assert {r.term: r.n_t for r in found.collect()} == {"": 3, "one": 2, "two": 2}
    assert not re.search(r"scalar-subquery#\d+ \[\] AS", found._jdf.queryExecution().optimizedPlan().toString())


def test_term_patterns_hold_no_negated_ranges():
    """Threads of one JVM slow each other down on them: six took about six times as long as one."""
    for pattern in (pii._WORD, pii._CONTEXT, pii.TOKEN):
        assert r"\P" not in pattern and not re.search(r"\[\^(?:\\.|[^\]\\])*(?<!\\)-", pattern)


def test_term_spans_against_brute_force(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    told = {w: "remove" for w in words[::3]} | {"müßig": "generalise"}
    texts = [(1, "\n".join(" ".join(words[i : i + 7]) for i in range(0, 400, 7))), (2, "(Müßig), waax!\n\nnone here"), (3, ""), (2, "(Müßig), waax!\n\nnone here")]
    rows = spark.createDataFrame(texts, "id long, text string")
    terms = spark.createDataFrame(list(told.items()), "term string, action string")
    got = {r.id: [tuple(s) for s in r.terms] for r in pii.term_spans(rows, terms).collect()}
    want = {}
    for i, text in texts:
        found = [(m.start(), m.end(), told[m.group().lower()]) for m in re.finditer(r"[^\W\d_]+", text) if m.group().lower() in told]
        want |= {i: found} if found else {}
    assert got == want
    bits = pii.slot_bits(terms).first().bits
    slots = {r.s for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(pii.SLOTS)).alias("s")).collect()}
    assert {64 * i + k for i, b in enumerate(bits) if b for k in range(64) if b >> k & 1} == slots
    assert pii.term_spans(rows, terms.limit(0)).count() == 0


def test_pii_odd_rows(odd, empty):
    assert pii.report(odd).count() == len(ODD)
    got = pii.sanitise(odd)
    assert got.columns == odd.columns and got.count() == len(ODD)
    assert pii.report(empty).count() == 0


# 5: HTML extraction


def test_main_text():
    page = "<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy</div><div id=cookie-notice>We use</div><article><h1>Head &amp; more</h1><p>First <b>bold\n text.<br><p>Ok.</p><div class=share>Share</div><p>A long paragraph that goes on and on with many words.</p><section class=comments><p>Reader says</p></section></article><aside>Side</aside><form><p>Name</p></form><footer>Foot</footer>"
    assert html_extract.main_text(page) == "Head & more\nFirst bold text.\nOk.\nA long paragraph that goes on and on with many words."
    assert html_extract.main_text("") == html_extract.main_text("<nav>only</nav>") == ""
    assert html_extract.main_text("plain text &lt;b&gt;") == "plain text <b>"
    assert html_extract.main_text("<body><div><div class=menu>m</div><div><p>One two three four five six.</p><p>Short.</p></div></div>") == "One two three four five six.\nShort."


def test_main_text_of_elements_with_telling_names():
    text = "A long paragraph that goes on and on with many words."
    body = f"<article><h1>Head</h1><p>{text}</p><p>{text}</p><div class=share>Share</div></article>"
    for name in ("layout has-sidebar", "elementor-widget", "no-sidebar", "with-banner", "comments-open"):
        assert html_extract.main_text(f"<div class=menu><a>m</a></div><div id=page class='{name}'>{body}</div>") == f"Head\n{text}\n{text}", name
    widgets = "".join(f"<div class=elementor-widget><p>{text}</p></div>" for _ in range(4))
    assert html_extract.main_text(f"<div class=menu><a>m</a></div><div>{widgets}</div>") == "\n".join([text] * 4)
    assert html_extract.main_text(f"<article><div class=entry-header><h1>Head</h1></div><p>{text}</p><section class=comments><article class=comment><p>{text}</p></article></section></article>") == f"Head\n{text}"
    assert html_extract.main_text(f"<div class=reply><p>{text}</p></div>") == text


PARAGRAPH = "A long paragraph that goes on and on with many words of plain text."


def test_regions_are_chosen_by_ratio():
    """Pages whose tags and names point elsewhere than their text."""
    twenty = "".join(f"<p>{PARAGRAPH} {i}</p>" for i in range(20))
    want = "\n".join(f"{PARAGRAPH} {i}" for i in range(20))
    menu = "<nav>" + "".join(f"<a href=/{i}>Item {i}</a>" for i in range(9)) + "</nav>"
    assert html_extract.main_text(f"<body><form action=/>{menu}<div>{twenty}</div></form></body>") == want
    assert html_extract.main_text(f"<article>{twenty}<section id=discussion><h2>Discussion</h2><p>{PARAGRAPH} of it</p></section></article>") == f"{want}\nDiscussion\n{PARAGRAPH} of it"
    assert html_extract.main_text(f"<body>{menu}<div class=post><div class=post-header><h1>Head</h1></div><div class=post-body>{twenty}</div></div><div>© 2020</div></body>") == f"Head\n{want}"
    teaser = f"<body>{menu}<article>Read this too</article><div>{twenty}</div></body>"
    assert html_extract.main_text(teaser).endswith(want)
    assert html_extract.main_text(f"<body>{menu}<div>{twenty}</div><div class=sidebar><p>{PARAGRAPH}</p></div><div class=comments><p>{PARAGRAPH}</p></div></body>") == want
    # No tag or name tells the text from the links.
    links = "".join(f"<div><a href=/{i}>Go {i}</a></div>" for i in range(30))
    assert html_extract.main_text(f"<body><div>{links}</div><div>{twenty}</div></body>") == want


def test_content_lines_against_brute_force():
    from math import exp

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 40):
        r = rng.integers(1, 200, n).astype(float)
        mean = sum(r) / n
        deviation = (sum((x - mean) ** 2 for x in r) / n) ** 0.5
        g = lambda d: exp(-d * d / 8) if abs(d) <= 6 else 0.0
        smooth = [sum(g(i - j) * r[j] for j in range(n)) / sum(g(i - j) for j in range(n)) for i in range(n)]
        assert html_extract.content_lines(r).tolist() == [x >= 0.5 * deviation for x in smooth]


def test_malformed_and_deep_pages():
    import random
    import time

    assert html_extract.main_text(f"<p>{PARAGRAPH}</p><![foo[bar]]><p>Rest of the text</p>") == f"{PARAGRAPH}\nRest of the text"
    pick = random.Random(5)
    bits = ["<", ">", "</", "<!", "<![", "]]>", "<!--", "-->", "<p", "<div class='", "'", '"', "&#", "&amp", ";", "=", "/>", "x y", "<?", "<![CDATA[", "<!DOCTYPE [", "</>", "<a b=c", "\x00", "<script>", "</script", "<svg/>"]
    for _ in range(3000):
        html_extract.main_text("".join(pick.choice(bits) for _ in range(pick.randrange(1, 25))))
    took = []
    for n in (10_000, 40_000):
        began = time.time()
        html_extract.main_text("<div>x" * n)
        html_extract.main_text("<b>" + "<i>y" * n + "</b></p></i>" * n)
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 1


def test_extract_odd_columns_and_repeated_rows(spark):
    html_ = f"<article><p>{PARAGRAPH}</p></article>"
    odd_pages = spark.createDataFrame([(2**53 + 1, "u", html_, [1], "t", 1), (None, None, html_, None, None, None), (None, None, html_, None, None, None), (3, "u", None, [2], "t", 2)], "page_id long, url string, html string, _html array<int>, text string, n_chars int")
    got = html_extract.extract(odd_pages.coalesce(1)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, PARAGRAPH, len(PARAGRAPH))] * 2 + [(3, "", 0), (2**53 + 1, PARAGRAPH, len(PARAGRAPH))]


def test_extract_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S).group(1)
        import html

        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id] == "\n".join(w for w in want if w)
    bad = spark.createDataFrame([(1, None, None), (2, "u", "")], "page_id long, url string, html string")
    assert [r.text for r in html_extract.extract(bad).collect()] == ["", ""]
    assert html_extract.extract(bad.limit(0)).count() == 0


# 6: mixing


def test_poisson_counts_and_weights(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "small").otherwise("big").alias("source"), F.lit("t").alias("text"))
    got = mixing.poisson_mix(d, {"small": 1.0, "big": 1.0}, total=20000, seed=3)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert n["small"] == pytest.approx(10000, rel=0.05) and n["big"] == pytest.approx(10000, rel=0.05)
    many = mixing.poisson_mix(d.where("doc_id < 40"), {"small": 1.0, "big": 1.0}, total=40000).groupBy("source").count().collect()
    assert all(r["count"] == pytest.approx(20000, rel=0.1) for r in many)
    again = mixing.poisson_mix(d.repartition(7), {"small": 1.0, "big": 1.0}, total=20000, seed=3)
    assert got.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).isEmpty()


def test_poisson_odd_rows(odd, empty):
    got = mixing.poisson_mix(odd, total=70)
    assert got.columns == [*[c for c in odd.columns if c != "copy"], "copy", "shuffle_key"] and got.count() > 20
    assert mixing.poisson_mix(empty).count() == 0


# 7: toxicity


def test_kernel_against_brute_force():
    from itertools import combinations

    def slow(a, b):
        find = lambda s: [("".join(s[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(s)), toxicity.ORDER)]
        return sum(toxicity.DECAY ** (x + y) for s, x in find(a) for t, y in find(b) if s == t)

    words = ["idiot", "idxiot", "abcabc", "cab", "aaaa", "aaa", "xyz", "abc", "", "é", "idiots"]
    kernel = toxicity.Kernel(words)
    for part, c in toxicity.grouped(words):
        assert toxicity.own_kernel(c) == pytest.approx([slow(*[f"\1{words[i]}\2"] * 2) for i in part], rel=1e-4)
        assert kernel.raw(c) == pytest.approx(np.array([[slow(f"\1{words[i]}\2", f"\1{w}\2") for w in words] for i in part]), rel=1e-4)


def test_toxicity_on_held_out_documents(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulmnrst"), rng.integers(3, 9))) for _ in range(3000)]
    bad = ["grobnik", "grobnikal", "grobnikor", "vuxeth"]
    made = []
    for i in range(900):
        text = " ".join(rng.choice(words, 60)) + "."
        toxic = i % 6 == 0
        made.append((i, text.replace(" ", f" {bad[i // 6 % 4]} ", 1) if toxic else text, int(toxic)))
    d = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(d.where("doc_id >= 180").select("doc_id", "text"), d.where("doc_id >= 180").select("doc_id", "toxic"))
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(d, model).collect()}
    assert np.mean([got[i] == bool(y) for i, _, y in made if i < 180]) > 0.98
    gapped = spark.createDataFrame([(1, "lo g.r.o.b.n.i.k ma"), (2, "g r o b n i k"), (3, "grobxnik"), (4, None), (5, ""), (6, "melon rest")], "doc_id long, text string")
    found = {r.doc_id: r.score for r in toxicity.score(gapped, model).collect()}
    assert min(found[1], found[2], found[3]) >= 0.5 > found[6] and found[4] == found[5] < 0.5
    left = toxicity.drop_toxic(gapped.withColumn("value", F.lit("x")), model)
    assert {r.doc_id for r in left.collect()} == {4, 5, 6} and left.columns == ["doc_id", "text", "value"]


def test_toxicity_of_a_large_insult_vocabulary(spark):
    rng = np.random.default_rng(2)
    spell = lambda letters, n: "".join(rng.choice(list(letters), n))
    words = [spell("aeioulmnrst", int(rng.integers(3, 9))) for _ in range(3000)]
    bad = [spell("bcdfghjkpqvwxyz", 8) for _ in range(450)]
    made = [(i, " ".join(w for pair in zip(rng.choice(words, 20), rng.choice(bad, 20, False), strict=True) for w in pair) if i < 400 else " ".join(rng.choice(words, 40)), int(i < 400)) for i in range(2400)]
    d = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert np.mean(model.scores(model.values(bad)) >= 0.5) > 0.98 and np.mean(model.scores(model.values(words)) >= 0.5) < 0.02


def test_long_words_are_counted_in_windows(spark):
    d = spark.createDataFrame([(1, "x" * 30 + "insult", 1), (2, "y" * 30 + "praise", 0)], "doc_id long, text string, toxic int")
    assert {r.word for r in toxicity._word_counts(d).collect()} == {*toxicity.windows("x" * 30 + "insult"), *toxicity.windows("y" * 30 + "praise")}
    assert toxicity.windows("x" * 30 + "insult")[-1].endswith("insult")


def test_toxicity_recall_on_the_tables(spark):
    """Held-out rows of the given tables. A third of the rows labelled toxic (18 of 51) hold none of the toxic words (noise in the labels)."""
    sf = "/root/testdata/sf0.01"
    got = queries.op7_toxicity(spark, sf).where("held_out")
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("doc_id", "toxic", "predicted").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    toxic = [r for r in both if r.toxic == 1]
    assert len(toxic) >= 5 and sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in both if r.toxic == 0) == 0


def test_toxicity_odd_rows(odd, empty, docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert toxicity.train(empty.select("doc_id", "text"), labels.limit(0)) == 0.0


# 8: language ID


def test_languages_on_held_out_documents(spark):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right, n = got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def plain_grams(text: str) -> dict:
    """Counts of hashed 1-, 2- and 3-grams inside words with their boundaries, a plain loop."""
    spread = lambda h: (h * 0x9E3779B97F4A7C15 % 2**64) >> 53
    out: dict = {}
    codes, word = [], []
    for c in text.lower() + " ":
        if c.isalpha():
            word.append(ord(c))
        elif word:
            codes.append([0, *word, 0])
            word = []
    for w in codes:
        keys = [spread(c) for c in w if c]
        keys += [spread((x * 0x110000 + y + 2**60) % 2**64) for x, y in zip(w, w[1:], strict=False)]
        keys += [spread(((x * 0x110000 + y) * 0x110000 + z + 2**61) % 2**64) for x, y, z in zip(w, w[1:], w[2:], strict=False)]
        for k in keys:
            out[k] = out.get(k, 0) + 1
    return out


def test_language_counts_and_choices_against_brute_force(spark):
    rng = np.random.default_rng(31)
    signs = list("abcdeÄßİé 日本.,-9\n")
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 60)))) for _ in range(150)]
    want = np.zeros((len(texts), langid.DIMS))
    for i, t in enumerate(texts):
        for k, n in plain_grams(t).items():
            want[i, k] = n
    assert np.array_equal(langid.counts(texts), want)
    langs = ["x" if t.count("a") > t.count("b") else "y" for t in texts]
    model = langid.train(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string"), clusters=3)
    idf = np.log((1 + len(texts)) / (1 + (want > 0).sum(axis=0))) + 0.1
    assert np.allclose(model.idf, idf, rtol=1e-5)
    v = np.sqrt(want) * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    cos = v @ model.centroids.T
    lettered = want.sum(axis=1) > 0
    best = [model.languages[model.owners[j]] if ok else "und" for j, ok in zip(cos.argmax(axis=1), lettered, strict=True)]
    # Centroids are means of their own texts: no text of the sample is nearer to another one's than rounding allows.
    names, scores, _ = model.predict(texts)
    ties = np.sort(cos, axis=1)[:, -1] - np.sort(cos, axis=1)[:, -2] < 1e-5
    assert [n for n, t in zip(names, ties, strict=True) if not t] == [b for b, t in zip(best, ties, strict=True) if not t]
    assert ((scores > 0) == lettered).all()


def test_languages_odd_rows(odd, empty, docs):
    model = langid.train(docs)
    got = rows(langid.identify(odd, model))
    assert len(got) == len(ODD) and all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 4))
    assert langid.identify(empty, model).count() == 0 and langid.train(empty) is None
    assert all(r["lang_pred"] != "und" for r in got if r["doc_id"] in (3, 5))
    odd_letters = [chr(i) for i in range(0x100, 0x3000) if chr(i).isalpha()]
    assert "und" not in model.predict(odd_letters)[0] and all(model.predict(["\u0e01\u0e02 \u0e03"])[2])
    assert model.predict(["zzzz qqqq"], strict=True)[0] == ["und"]
    a, b = langid.counts(["ab c", "x"]), langid.counts(["ab c"])
    assert (a[0] == b[0]).all() and a[1].sum() == 4


# 9: packing


def test_packing_is_lossless_and_tight(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack_documents(docs, queries.tokenizer_path()).toPandas()
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 0], dtype="<u4")
        mine = got[got["doc_id"] == r.doc_id].sort_values("piece")
        assert mine["start"].tolist() == list(range(0, len(ids), 2048)) and mine["length"].sum() == len(ids)
        assert mine["ids_crc32"].tolist() == [zlib.crc32(ids[s : s + 2048].tobytes()) for s in mine["start"]]
    bins = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (bins["length"].cumsum() - got.sort_values(["sequence_id", "offset"])["length"] == got.sort_values(["sequence_id", "offset"])["offset"]).all()
    assert bins["length"].sum().max() <= 2048 and len(bins) <= -(-got["length"].sum() // 2048) + 2


def test_ids_of_words_that_end_in_a_sign():
    """Whole texts against the tokenizer, over every letter whose lower or upper case differs, before signs and between words."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    cased = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000 and (chr(i).lower() != chr(i) or chr(i).upper() != chr(i))]
    marks = [chr(i) for i in range(0x300, 0x370)]
    rng = np.random.default_rng(8)
    texts = [f"{a}{c}{s} {c}{s}b {c} {s}{c}" for c in cased for a, s in (("x", "."), ("", ","))]
    texts += ["".join(rng.choice([*cased[:200], *marks[:8], *"abc.,!?'-\n\t  019", "\u0130", "\u00a0", "\x00", "\x85"], 12)) for _ in range(8000)]
    want = [np.asarray(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, packing.encode_texts(texts, queries.tokenizer_path()), want, strict=True) if a != b] == []


def test_vector_best_fit_holds_every_capacity():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 100, 500).astype(float)
    demand, caps = np.stack([size, np.ones(500), size**2], axis=1), np.array([100.0, 4.0, 6000.0])
    small = demand[(demand <= caps).all(axis=1)]
    for rule in ("residual_norm", "dot_product"):
        where = packing.best_fit(small, caps, np.array([1.0, 0.5, 0.5]), rule)
        for k in range(3):
            assert np.bincount(where, weights=small[:, k]).max() <= caps[k] + 1e-6
        assert set(where) == set(range(where.max() + 1))


def test_documents_and_attention_choose_among_sequences():
    """Equal weights place pieces otherwise than tokens alone, in no more sequences."""
    rng = np.random.default_rng(21)
    size = np.minimum(2048, np.exp(rng.normal(5, 1, 3000)).astype(int) + 1).astype(float)
    demand, caps = np.stack([size, np.ones(len(size)), size * size], axis=1), np.array([2048.0, 2048.0, 2048.0**2])
    alone, all_ = (packing.best_fit(demand, caps, np.array(w)) for w in ((1.0, 0.0, 0.0), (1.0, 1.0, 1.0)))
    shape = lambda bins: sorted(tuple(sorted(size[bins == b])) for b in np.unique(bins))
    assert shape(alone) != shape(all_)
    assert len(np.unique(all_)) <= len(np.unique(alone)) + 1
    assert all(size[all_ == b].sum() <= 2048 for b in np.unique(all_))


def test_packing_odd_rows(odd, empty):
    got = packing.pack_documents(odd, queries.tokenizer_path())
    assert got.where("piece = 0").count() == len(ODD)
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


# 10: near duplicates


def test_shingle_sets_against_brute_force():
    texts = ["A b\tc d e", "", "x", "a b c d a b c d", "é ü \x1c b", "one two three"]
    for n in (4, 5):
        got = shingles.shingle_sets([t.encode() for t in texts], n)
        for t, s in zip(texts, got, strict=True):
            words = [w for w in re.split("[ \\x09-\\x0d]+", t) if w]
            assert len(s) == len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()})
    a, b = shingles.shingle_sets([b"Hello World FOO bar", b"hello world foo  bar"], 4)
    assert (a == b).all()


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(500)]
    made = []
    for g in range(12):
        base = rng.choice(vocabulary, 60).tolist()
        for c in range(6):
            t = list(base)
            for k in rng.choice(60, c, replace=False):
                t[k] = "edit" + str(rng.integers(1000))
            made.append((len(made), " ".join(t)))
    made += [(900, None), (901, ""), (902, "a b"), (903, "A  b")]
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set()) for i, t in made for w in [(t or "").lower().split()]}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), words=4).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_an_id_of_several_texts_keeps_the_links_of_each(spark):
    """Id 1 has two texts, one of them twice; 2 is near the first, 3 near the second; rows without an id join their class."""
    words = lambda p: [f"{p}{i}" for i in range(60)]
    first, second = " ".join(words("a")), " ".join(words("b"))
    made = [(1, first), (1, second), (1, second), (2, first + " more"), (3, second + " more"), (None, first), (4, " ".join(words("c")))]
    for bit_filter in (True, False):
        got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), words=4, bit_filter=bit_filter).collect()
        assert len(got) == len(made)
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4)}


def test_pigeonhole_keys():
    """Signatures that differ in fewer than CHUNKS * (ERRORS + 1) symbols share a key."""
    rng = np.random.default_rng(6)
    n = minhash.CHUNKS * minhash.WIDTH
    for _ in range(200):
        a = rng.integers(0, 2**16, (1, n), dtype=np.uint64)
        b = a.copy()
        b[0, rng.choice(n, minhash.CHUNKS * (minhash.ERRORS + 1) - 1, replace=False)] += np.uint64(1)
        x, y = (set(minhash.probe_keys(s, minhash.CHUNKS, minhash.WIDTH, minhash.ERRORS)[0].tolist()) for s in (a, b))
        assert x & y


def test_links_of_keys_with_equal_low_bits(spark):
    """2 and 3 are linked and meet in one bucket only; each has another key, and those two agree in their low bits."""
    meet, x, y = (5 << 31) | 100, (1 << 31) | 7, (2 << 31) | 7
    probes = [(meet, 1), (meet, 2), (meet, 3), (x, 2), (x, 4), (y, 3), (y, 5), *[(k, i) for k in range(200, 206) for i in (1, k)]]
    rows_ = spark.createDataFrame([(k, i, 1) for k, i in probes], "key long, id long, n int")
    only = lambda pairs: pairs.where("least(u, v) = 2 and greatest(u, v) = 3")
    got = buckets.bucket_components(rows_, only, lambda a, b: F.lit(True))
    assert [(r.u, r.v) for r in got.collect()] == [(3, 2)]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "u long, v long")
    got = {r.u: r.v for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_near_duplicates_odd_rows(odd, empty):
    got = rows(minhash.near_duplicates(odd, words=4))
    assert len(got) == len(ODD)
    assert all(r["kept"] for r in got)
    assert minhash.drop_near_duplicates(odd).columns == odd.columns
    assert minhash.near_duplicates(empty).count() == 0


BIG = 2**53 + 1


def test_ids_beyond_doubles_stay_whole_beside_null_ids(spark, docs):
    """Ids that a float can't hold, in the same batch as a row without an id."""
    line = "this one line of many words is shared by two documents and stands in both of them"
    texts = [(BIG, line), (None, "no id"), (BIG + 2, f"own\n{line}"), (BIG + 4, "other words")]
    d = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    want = {BIG, BIG + 2, BIG + 4, None}
    deduped = {r.doc_id: r.text for r in line_dedup.line_dedup(d).collect()}
    assert deduped == {BIG: line, BIG + 2: "own", BIG + 4: "other words", None: "no id"}
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(d.union(spark.createDataFrame([(BIG + 6, line)], "doc_id long, text string"))).collect()}
    assert near == {BIG: BIG, BIG + 2: BIG, BIG + 4: BIG + 4, BIG + 6: BIG, None: None}
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    for got in (toxicity.score(d, toxicity.train(docs.select("doc_id", "text"), labels)), langid.identify(d, langid.train(docs)), packing.pack_documents(d, queries.tokenizer_path()), simhash.compare_edited(d), pii.report(d)):
        assert {r.doc_id for r in got.collect()} == want


# the pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == p.COLUMNS and docs.count(), name
    got = p.STAGES[-1][1](spark, docs, SF)
    assert got.select("sequence_id").distinct().count() > 10


def test_line_dedup_stage_loses_no_text_of_its_own(spark):
    """Copies of earlier documents go; near copies, and documents with a copied passage, keep their own lines."""
    import corpus_pipeline as p

    lines = [" ".join(f"w{10 * k + i}" for i in range(20)) for k in range(10)]
    texts = {1: lines, 2: lines, 3: [*lines[:9], "edited line of few words"], 4: ["own text of this document"] * 3 + lines[:1], 5: ["other words"]}
    rows_ = [(i, "\n".join(x), "en", "a", len("\n".join(x))) for i, x in texts.items()]
    got = {r.doc_id: (r.text, r.n_chars) for r in p.dedup_lines(spark, spark.createDataFrame(rows_, SCHEMA), SF).collect()}
    own = "\n".join(texts[4][:3])
    assert got == {1: (rows_[0][1], rows_[0][4]), 3: ("edited line of few words", 24), 4: (own, len(own)), 5: ("other words", 11)}


def test_pipeline_stages_lose_no_line_of_clean_documents(spark):
    """Every line of the documents that toxicity keeps stands in what line dedup keeps."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*p.COLUMNS)
    lines = lambda df: {" ".join(x.split()) for r in df.select("text").collect() for x in (r.text or "").split("\n")} - {""}
    assert lines(p.dedup_lines(spark, docs, SF)) == lines(docs)


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_pipeline_stages_on_odd_rows(spark, case, empty, odd):
    import corpus_pipeline as p

    given = (empty if case == "empty" else odd.drop("n")).select(*p.COLUMNS)
    docs = given
    for name, stage in p.STAGES[1:-1]:
        docs = common.staged(stage(spark, docs, SF), "stage")
        assert docs.columns == p.COLUMNS, name
    packed = p.STAGES[-1][1](spark, docs, SF)
    assert packed.count() >= docs.count() and (case == "odd" or packed.count() == 0)


def test_staged_bounds_batches_of_its_write_only(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(key)

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    rows = spark.range(0, 25, 1, 1)
    found = common.staged(rows.mapInPandas(sizes, "n long"), "sizes", 10)
    assert sorted(r.n for r in found.collect()) == [5, 10, 10]
    assert spark.conf.get(key) == given
