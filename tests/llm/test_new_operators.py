"""Token files, centroid clustering and importance resampling against plain models and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colligo.llm import centroids, importance, queries, tokens
from colligo.llm.common import staged

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, place int, tie string, part int, score int, rank int"


def rows_of(spark, given):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4) for i, t in given], ODD)


# Token files


def encoded(text: str) -> list[int]:
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(queries.tokenizer_path()).encode(text, add_special_tokens=False).ids, 1]


def test_token_files_equal_the_tokenizer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op11_token_ids(spark, SF).collect()}
    start = 0
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = encoded(r.text or "")
        assert got.pop(r.doc_id) == (start, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert not got


def test_token_files_of_odd_rows(spark, tmp_path):
    long = "word, an other " * 40_000
    given = [(5, "b c"), (None, "x"), (2, None), (5, "b c"), (2, ""), (None, None), (-7, long), (5, "a")]
    got = [tuple(r) for r in tokens.token_files(rows_of(spark, given), queries.tokenizer_path(), folder=str(tmp_path)).collect()]
    by_start = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in by_start] == [None, None, -7, 2, 2, 5, 5, 5]
    assert all(a[1] + a[2] == b[1] for a, b in zip(by_start, by_start[1:], strict=False))
    assert sorted((r[2], r[3]) for r in got) == sorted((len(e), zlib.crc32(np.asarray(e, dtype="<u4").tobytes())) for e in (encoded(t or "") for _, t in given))


def test_token_files_over_many_shards(spark, tmp_path):
    given = [(i % 37, f"text {i} of many") for i in range(500)]
    manifest = staged(tokens.write_shards(rows_of(spark, given), f"file://{tmp_path}", queries.tokenizer_path(), shard_bytes=500), "manifest")
    shards = manifest.orderBy("part").collect()
    assert len(shards) > 5
    assert [s.base_tokens for s in shards] == [sum(t.n_tokens for t in shards[:k]) for k in range(len(shards))]
    assert {p.suffix for p in tmp_path.iterdir()} == {".bin", ".idx", ".doc"} and not list(tmp_path.glob("_*"))
    first = tokens.Shard(shards[0].shard, shards[0].width)
    starts = first.starts(0, shards[0].n_docs)
    assert starts[-1] == shards[0].n_tokens
    assert first.tokens(starts[1], starts[2]).tolist() in [encoded(t) for _, t in given]
    first.close()
    ids = [r.doc_id for r in tokens.read_shards(manifest).orderBy("start").collect()]
    assert ids == sorted(i for i, _ in given)


def test_token_files_of_an_empty_table(spark, tmp_path):
    assert tokens.token_files(rows_of(spark, []), queries.tokenizer_path(), folder=str(tmp_path)).collect() == []


def test_ids_take_four_bytes_only_where_two_are_too_few():
    assert tokens.id_type(65_536).itemsize == 2
    assert tokens.id_type(65_537).itemsize == 4


# Centroids


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 9), st.integers(1, 5), st.integers(0, 40), st.integers(1, 6), st.randoms(use_true_random=False))
def test_walks_find_the_nearest_centroid(k, dims, n, span, rnd):
    c = np.array([[rnd.randint(-span, span) for _ in range(dims)] for _ in range(k)], dtype=np.int64)
    x = np.array([[rnd.randint(-span - 2, span + 2) for _ in range(dims)] for _ in range(n)], dtype=np.int64).reshape(n, dims)
    who, far = centroids.nearest(x, c)
    exact = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert who.tolist() == exact.argmin(axis=1).tolist()
    assert far.tolist() == exact.min(axis=1).tolist()


def test_walks_stop_before_far_centroids():
    rng = np.random.default_rng(3)
    c = (rng.integers(0, 50, 40)[:, None] * 1000 + rng.integers(0, 3, (40, 8))).astype(np.int64)
    x = c[rng.integers(0, 40, 30)] + 1
    who, far = centroids.nearest(x, c)
    assert far.tolist() == ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).tolist()


def plain_clusters(given, k, rounds, scale, dims, seed=1):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in given if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, v)) for v in x]) for i, x in kept]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [x for _, x in first[:k]]
    best = lambda x: min((sum((p - q) ** 2 for p, q in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        groups: dict = {}
        for _, x in kept:
            groups.setdefault(best(x)[1], []).append(x)
        for j, xs in groups.items():
            c[j] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out = [(i, *best(x)) for i, x in kept]
    per = Counter()
    for _, d, j in out:
        per[j] += d
    return [(i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in out]


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    given = [(i, [float(v) for v in rng.normal(0, 0.3, 4).astype(np.float32)]) for i in range(60)]
    given += [(1, given[1][1]), (None, given[2][1]), (None, [0.0] * 4), (70, None), (71, []), (72, [1.0] * 5), (73, [1.0, None, 0.0, 0.0]), (74, [math.nan, 0.0, 0.0, 0.0]), (75, [math.inf, 0.0, 0.0, 0.0]), (76, [1e30, -1e30, 0.0, 0.0]), (77, [-0.001, 0.001, -0.0, 0.0])]
    rows = spark.createDataFrame([(i, x, 9, "c") for i, x in given], "vec_id long, embedding array<float>, x int, cluster string")
    for k in (1, 5, 100):
        got = [tuple(r) for r in centroids.cluster(rows.repartition(3), k=k, dims=4).collect()]
        want = plain_clusters([(i, x and [None if v is None else float(np.float32(v)) for v in x]) for i, x in given], k, 3, 64.0, 4)
        key = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted(got, key=key) == sorted(want, key=key)


def test_clusters_of_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(empty).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<double>")).collect() == []


# Importance resampling


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_resample(docs, target, percent=25, min_words=20, n=10_000, seed=7):
    bucket = lambda g: zlib.crc32(g.encode()) % n
    made = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(bucket(g) for _, _, fs in made for g in fs), Counter(bucket(g) for x in target for g in plain_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + n) / ((s[b] + 1) * (big_t + n))))
    out = []
    for i, words, fs in made:
        w = sum(gain(bucket(g)) for g in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


KEY = lambda r: tuple((v is None, v or 0) for v in r)


def test_resampling_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    some = ["the", "Cat", "ÄPFEL", "äpfel", "日本", "x1", "é", "0", "𝔘nit", "İ", "o'clock", "a-b", "z" * 300]
    docs = [(i, " ".join(rng.choice(some, int(rng.integers(0, 60))))) for i in range(120)]
    docs += [(None, docs[3][1]), (3, docs[3][1]), (4, None), (200, ""), (201, " \n\t!?"), (202, "one"), (203, "one  two"), (204, "w " * 50_000), (205, "q" * 100_000 + " b")]
    target = ["The cat \x00 sat", None, "", "äpfel zwölf, x1"]
    got = importance.resample(rows_of(spark, docs).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(plain_resample(docs, target), key=KEY)


def test_ranks_go_on_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(importance, "RANGE_ROWS", 50)
    docs = [(i, f"word{i % 7} " * 25) for i in range(400)]
    got = importance.resample(rows_of(spark, docs), spark.createDataFrame([("word3",)], "text string"), percent=60)
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(plain_resample(docs, ["word3"], percent=60), key=KEY)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(rows_of(spark, []), none).collect() == []
    docs = [(1, "a b " * 20), (2, "c"), (3, "d " * 30), (4, "e " * 30), (5, "f " * 30)]
    assert sorted(map(tuple, importance.resample(rows_of(spark, docs), none).collect()), key=KEY) == sorted(plain_resample(docs, []), key=KEY)


@given(st.lists(st.text(max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_checksums_of_windows(texts):
    got = importance.feature_crcs(texts, importance.Words())
    assert [sorted(c.tolist()) for c in got] == [sorted(zlib.crc32(g.encode()) for g in plain_features(t)[1]) for t in texts]


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_importance_resampling"])
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got), key=KEY) == sorted(want.fetchall(), key=KEY)
