"""The registered opN queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.llm import centroids, html_extract, importance, langid, line_dedup, media, minhash, mixing, packing, pii, simhash, tokens, toxicity
from colligo.llm.common import crc32_mod, table

Query = Callable[[SparkSession, str], DataFrame]


#: Exact links over an inverted index of shingles, then reachability.
OP10_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), s as (
  select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) as g from w
), n as (
  select w.doc_id, coalesce(c, 0) as n_shingles from w left join (select doc_id, count(*) as c from s group by doc_id) t using (doc_id)
), p as (
  select a.doc_id as u, b.doc_id as v, count(*) as both_n from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), l as (
  select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * both_n >= 80 * (x.n_shingles + y.n_shingles - both_n)
), r as (
  select doc_id as u, doc_id as v from n union select r.u, l.v from r join l on l.u = r.v
), c as (select u, min(v) as component_id from r group by u)
select doc_id, n_shingles, component_id, doc_id = component_id as kept from n join c on c.u = n.doc_id
"""


#: Poisson terms by recursion; a document's count is the number of distribution values not above its uniform.
OP6_SQL = r"""
with recursive c as (
  select source, count(*) as n, sqrt(count(*)::double) as w from documents group by source
), r as (
  select source, (select count(*) from documents)::double * w / (select sum(w) from c) / n as rate from c
), q as (
  select source, greatest(1, ceil(rate / 256.0))::int as parts, rate / greatest(1, ceil(rate / 256.0)) as lam from r
), f as (
  select source, parts, lam, 0 as k, exp(-lam) as p, exp(-lam) as cdf from q
  union all
  select source, parts, lam, k + 1, p * lam / (k + 1), cdf + p * lam / (k + 1) from f where k < ceil(lam + 12 * sqrt(lam) + 24)
), g as (
  select source, parts, list(cdf order by k) as cdfs from f group by source, parts
), d as (
  select t.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdfs, lambda x: x <= ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || j), 1, 13))::bigint / 4503599627370496.0))))::int as times
  from documents t join g on g.source is not distinct from t.source
), e as (
  select doc_id, text, lang, source, n_chars, unnest(range(0, times))::int as copy from d where times > 0
)
select *, ('0x' || substr(md5('17:order:' || coalesce(doc_id::varchar, '') || ':' || copy), 1, 13))::bigint as shuffle_key from e
"""


#: Integer vectors in long form; three rounds and a last assignment, each with the smallest (distance, number) by vector.
OP12_SQL = r"""
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
), e as materialized (
  select vec_id, unnest(range(1, 65)) as i, unnest(x) as y from v
), c0 as materialized (
  select row_number() over (order by sha256('1:' || vec_id::varchar)) - 1 as c, x from v order by sha256('1:' || vec_id::varchar) limit 16
)"""
for _r in range(4):
    OP12_SQL += f""", b{_r} as materialized (
  select c, unnest(range(1, 65)) as i, unnest(x) as y from c{_r}
), d{_r} as materialized (
  select vec_id, c, sum((e.y - b{_r}.y) * (e.y - b{_r}.y))::bigint as distance from e join b{_r} using (i) group by vec_id, c
), a{_r} as materialized (
  select vec_id, min((distance, c)) as best from d{_r} group by vec_id
), n{_r} as (
  select best[2] as c, i, sum(y)::bigint as s, count(*) as n from a{_r} join e using (vec_id) group by best[2], i
), c{_r + 1} as materialized (
  select o.c, coalesce(m.x, o.x) as x from c{_r} o left join (select c, list((s - ((s % n) + n) % n) // n order by i) as x from n{_r} group by c) m on m.c = o.c
)"""
OP12_SQL += """
select vec_id, best[2]::int as cluster, best[1] as distance, sum(best[1]) over (partition by best[2])::bigint as cluster_inertia, sum(best[1]) over ()::bigint as inertia,
  sha256(array_to_string(x, ',')) as centroid_sha256 from a3 join c3 on c3.c = best[2]
"""


#: crc32 of each distinct feature by a fold over its bytes, with the table from its polynomial.
OP13_SQL = r"""
with tab as materialized (
  select list(c order by v) as crc from (select v, list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, v::bigint) as c from range(256) r(v))
), texts as (
  select 'd' as side, doc_id as id, text from documents union all select 't', item_id, text from benchmark
), w as materialized (
  select side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts
), f as materialized (
  select side, id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as g from w where len(ws) > 0
), g as materialized (
  select g, xor(list_reduce(list_transform(range(0, octet_length(encode(g))), lambda k: ('0x' || substr(hex(encode(g)), 2 * k + 1, 2))::bigint), lambda c, b: xor(crc[xor(c % 256, b) + 1], c // 256), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket
  from (select distinct g from f) q, tab
), n as (
  select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 't') as t from f join g using (g) group by bucket
), gain as materialized (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from n) + 10000)::double / ((s + 1)::double * ((select sum(t) from n) + 10000)::double)))::bigint as gain from n
), m as (
  select id, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from f join g using (g) join gain using (bucket) where side = 'd' group by id
), x as (
  select w.id as doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from w left join m on m.id = w.id where side = 'd'
), r as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as n from x
)
select doc_id, n_features::bigint as n_features, weight, score, case when n_words >= 20 and place <= 25 * n // 100 then place end as rank from r
"""


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), block_words=16)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_edited(table(spark, sf_dir, "documents"), radius=3)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), z=1.0, generalise=0.75, remove=0.95)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), exponent=0.5, seed=17)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model | float:
    """Fitted on labels whose crc32(doc_id) mod 5 is not 0, at most toxicity.LABELLED of them."""
    labels = table(spark, sf_dir, "labels").where(crc32_mod("doc_id", 5) != 0)
    return toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc32_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc32_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64.0, seed=1)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, buckets=10_000, seed=7)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_media_columns": op3_media_columns,
    "op4_pii": op4_pii,
    "op5_html_extraction": op5_html_extraction,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_token_ids": op11_token_ids,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {
    "op6_mixing": OP6_SQL,
    "op10_minhash_near_dedup": OP10_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
