"""Language identification by nearest centroid over normalised TF-IDF letter n-grams.

Texts are lower-cased, everything but letters becomes a word boundary, and the
1-, 2- and 3-grams inside words (boundaries included) are counted in DIMS hashed
dimensions over the whole text. A vector is the square roots of the counts times
the inverse document frequency, of length 1. Every language has several
centroids from spherical k-means, so that its kinds of text keep apart; a text
gets the language of the centroid of the largest cosine (of equal ones, the
first by name). It is rejected if that cosine is below the language's limit, the
`tail` quantile of its own training texts' cosines; `identify` tells it in
the column rejected, and gives `und` for such texts only if `strict`.

Document frequencies come from all training documents; centroids and limits from
at most `per_language` of each language (by a hash of the id), a bound that is a
parameter. Each language is clustered by itself in a task; its centroids alone
reach the driver.

Defined results: null and empty texts and texts without a letter have no vector
and are rejected (`und`, score 0); any other text gets a language, unless
`strict`; very long texts are counted whole; rows without a language are never
learned from; repeated rows get equal results; without any training row all is
`und`; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colligo.llm.common import ids_back, text_or_empty, with_ids

DIMS = 2048
#: Texts whose counts are held together; letters of a longer buffer are counted alone.
TEXTS, LETTERS = 64, 1 << 20
UNKNOWN = "und"
_LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts of each text, one row each."""
    arrays = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    # A boundary stands before and after each text; grams never reach across two boundaries.
    edge = np.zeros(1, dtype=np.uint32)
    c = np.concatenate([x for a in arrays for x in (edge, a, edge)]) if arrays else edge
    owner = np.repeat(np.arange(len(arrays)), [len(a) + 2 for a in arrays])
    c = np.where(_LETTER[c], c, 0).astype(np.uint64)
    new = owner[1:] != owner[:-1]
    keep = (c > 0) | np.r_[True, (c[:-1] > 0) | new] | np.r_[new, True]
    c, owner = c[keep], owner[keep]
    if len(c) < 3:
        return np.zeros((len(texts), DIMS), dtype=np.float32)
    spread = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)
    p = np.uint64(0x110000)
    one = (c > 0, spread(c))
    two = ((c[:-1] > 0) | (c[1:] > 0), spread(c[:-1] * p + c[1:] + np.uint64(1 << 60)))
    three = ((c[1:-1] > 0), spread((c[:-2] * p + c[1:-1]) * p + c[2:] + np.uint64(1 << 61)))
    out = np.zeros(len(texts) * DIMS, dtype=np.int64)
    same2, same3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    for ok, h, own in ((one[0], one[1], owner), (two[0] & same2, two[1], owner[:-1]), (three[0] & same3, three[1], owner[:-2])):
        out += np.bincount(own[ok] * DIMS + h[ok], minlength=len(out))
    return out.reshape(len(texts), DIMS).astype(np.float32)


def in_groups(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Start and counts of runs of texts, a bounded buffer at a time."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if i + 1 - at >= TEXTS or size >= LETTERS or i + 1 == len(texts):
            yield at, counts(texts[at : i + 1])
            at, size = i + 1, 0


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(n) * idf
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means, begun with the rows farthest from each other."""
    mean = v.mean(axis=0)
    picked = [int((v @ mean).argmax())]
    near = v @ v[picked[0]]
    while len(picked) < min(k, len(v)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, v @ v[picked[-1]])
    c = v[picked]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.array([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owners: np.ndarray  # language number of each centroid
    limits: np.ndarray  # least cosine of each language
    sharpness: float = 30.0

    def predict(self, texts: list[str], strict: bool = False) -> tuple[list[str], np.ndarray, list[bool]]:
        """Languages, scores and rejections; the score is the share of the best language in a softmax over languages' best cosines."""
        names, scores, rejected = [], [], []
        for _, n in in_groups(texts):
            cos = vectors(n, self.idf) @ self.centroids.T
            best = np.stack([cos[:, self.owners == i].max(axis=1) for i in range(len(self.languages))], axis=1)
            top = best.argmax(axis=1)
            share = 1 / np.exp(self.sharpness * (best - best.max(axis=1, keepdims=True))).sum(axis=1)
            lettered = n.sum(axis=1) > 0
            near = lettered & (best.max(axis=1) >= self.limits[top])
            known = near if strict else lettered
            names += [self.languages[i] if k else UNKNOWN for i, k in zip(top, known, strict=True)]
            scores += np.where(known, share, 0.0).tolist()
            rejected += (~near).tolist()
        return names, np.array(scores, dtype=float), rejected


def train(docs: DataFrame, per_language: int = 1000, clusters: int = 4, tail: float = 0.001, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Fit on rows with a language; None if there are none."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total = np.zeros(DIMS, dtype=np.int64), 0
        for pdf in batches:
            for _, n in in_groups(pdf["text"].tolist()):
                held += (n > 0).sum(axis=0)
                total += len(n)
        yield pd.DataFrame({"d": np.arange(DIMS + 1), "df": np.r_[held, total]})

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, n in in_groups(pdf["text"].tolist()):
                yield pd.DataFrame({"lang": pdf["lang"].iloc[at : at + len(n)].tolist(), "n": list(n)})

    found = {r.d: r.df for r in rows.select("text").mapInPandas(frequencies, "d int, df long").groupBy("d").agg(F.sum("df").alias("df")).collect()}
    total = found.get(DIMS, 0)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + np.array([found[i] for i in range(DIMS)]))) + 0.1
    turn = Window.partitionBy("lang", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.xxhash64("id", F.lit(1)), "id")
    few = -(-per_language // 64)
    ids = rows.select("id", "lang").withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= few).select("id", "lang").distinct()
    # At most per_language ids (rounded up to 64) for each language: the broadcast is bounded.
    picked = rows.join(F.broadcast(ids), ["id", "lang"]).mapInPandas(samples, "lang string, n array<float>")

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        v = vectors(np.stack(pdf["n"].to_list()), idf)
        v = v[np.lexsort(v.T[:8])]
        some = v[np.linalg.norm(v, axis=1) > 0]
        c = clustered(some, clusters) if len(some) else v[:1]
        limit = float(np.quantile((some @ c.T).max(axis=1), tail)) if len(some) else 1.0
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "limit": limit, "c": list(c.astype(np.float32))})

    # One group is one language's bounded sample.
    made = picked.groupBy("lang").applyInPandas(centre, "lang string, limit double, c array<float>").toPandas().sort_values("lang", kind="stable")
    languages = sorted(made["lang"].unique())
    owners = made["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    limits = made.groupby("lang")["limit"].first().reindex(languages).to_numpy()
    return Model(languages, idf.astype(np.float32), np.stack(made["c"].to_list()).astype(np.float32), owners, limits)


def identify(docs: DataFrame, model: Model | None, strict: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row."""
    if model is None:
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, scores, rejected = model.predict(pdf["text"].tolist(), strict)
            yield pd.DataFrame({"doc_id": ids_back(pdf["doc_id"], pdf["no_id"]), "lang_pred": names, "score": scores, "rejected": rejected})

    return with_ids(docs, id_col, text_col).mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean")
