"""Target-distribution importance resampling over hashed one- and two-word features.

Words come from a tokenizers pipeline that is never trained: a Regex Split that
keeps what the pattern matches, in front of a model that knows no word, over
texts with A-Z lower-cased. It gives words as offset pairs. Windows over one and
over two neighbouring pairs are the features; two words count as joined by one
space, whatever stands between them. A feature's bucket is its crc32 modulo the
number of buckets; that of a pair is worked out from those of its words, since
appending n bytes to a text is a linear map of its crc32.

    gain(bucket) = floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))

with s of S features of the documents and t of T of the target in the bucket. A
document's weight is the floored mean of its features' gains, and its score adds
Gumbel noise from a hash of its id, so that drawing the highest scores samples
without replacement in proportion to exp(weight / 1000).

Texts are cut into words once; the buckets of a document's features are kept (2
bytes each) for the second pass. Both histograms are summed in the tasks first;
one row per bucket reaches the driver. Ranks are places in a table sorted by
ranges of the score, counted from the ranges' sizes.

Defined results: null and empty texts and texts without words have no feature,
weight 0 and no rank; an absent id hashes as empty text; rows that repeat an id
are separate documents with ties by a hash of their features; very long texts
count whole; an empty target gives every bucket its gain from the documents alone; an
empty table gives an empty table; extra columns are ignored, whatever their
names.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colligo.llm.common import TEXT_ROWS, ids_back, staged, with_ids

#: Fixed value: a word, in text with A-Z lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Texts that are cut into words together, and distinct words whose checksums a Python worker remembers.
STEP, WORDS_KEPT = 256, 400_000
#: Rows of a range of the rank order, about.
RANGE_ROWS = 500_000
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Fixed value: the polynomial of crc32, bits reversed.
_POLYNOMIAL = 0xEDB88320


@functools.lru_cache(maxsize=1)
def splitter():
    """A tokenizer whose tokens are the pieces of an untrained Regex Split."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"?": 0}, unk_token="?"))
    made.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
    return made


@functools.cache
def _zeros(k: int) -> np.ndarray:
    """What 2^k zero bytes make of each byte of a checksum, by its place."""
    each = np.arange(256, dtype=np.uint32)
    if k == 0:
        step = each.copy()
        for _ in range(8):
            step = (step >> np.uint32(1)) ^ (np.uint32(_POLYNOMIAL) * (step & np.uint32(1)))
        return np.stack([step, *[each << np.uint32(8 * (b - 1)) for b in (1, 2, 3)]])
    return np.stack([_padded(_padded(each << np.uint32(8 * b), k - 1), k - 1) for b in range(4)])


def _padded(c: np.ndarray, k: int) -> np.ndarray:
    t, byte = _zeros(k), np.uint32(255)
    return t[0][c & byte] ^ t[1][(c >> np.uint32(8)) & byte] ^ t[2][(c >> np.uint32(16)) & byte] ^ t[3][c >> np.uint32(24)]


def joined_crc(head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of texts a + b from crc32 of a, crc32 of b and the bytes of b."""
    out = head.copy()
    for k in range(int(size.max(initial=0)).bit_length()):
        longer = (size >> k) & 1 == 1
        out[longer] = _padded(out[longer], k)
    return out ^ tail


class Words(dict):
    """Numbers of words, given as they are met, and the checksums they stand for."""

    def __init__(self) -> None:
        self.alone: list[int] = []
        self.spaced: list[int] = []
        self.size: list[int] = []

    def __missing__(self, word: str) -> int:
        raw = word.encode("utf-8", "surrogatepass")
        self.alone.append(zlib.crc32(raw))
        self.spaced.append(zlib.crc32(raw + b" "))
        self.size.append(len(raw))
        self[word] = n = len(self.size) - 1
        return n


def feature_crcs(texts: list[str], known: Words) -> list[np.ndarray]:
    """crc32 of every one- and two-word feature of each text: windows over its offset pairs."""
    low = [t.translate(_LOWER) for t in texts]
    numbers, counts = [], []
    for text, found in zip(low, splitter().encode_batch(low, add_special_tokens=False), strict=True):
        pairs = found.offsets
        numbers += [known[text[a:b]] for a, b in pairs]
        counts.append(len(pairs))
    at = np.array(numbers, dtype=np.int64)
    alone = np.array(known.alone, dtype=np.uint32)[at]
    spaced = np.array(known.spaced, dtype=np.uint32)[at]
    size = np.array(known.size, dtype=np.int64)[at]
    pairs = joined_crc(spaced[:-1], alone[1:], size[1:])
    out, end = [], np.cumsum(counts)
    for n, e in zip(counts, end.tolist(), strict=True):
        out.append(np.concatenate([alone[e - n : e], pairs[e - n : max(e - n, e - 1)]]))
    return out


def featurise(docs: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, tie (a hash of the features) and buckets (little-endian numbers of 2 or 4 bytes) of every row."""
    kind = _kind(buckets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words()
        for whole in batches:
            for at in range(0, len(whole), STEP):
                pdf = whole.iloc[at : at + STEP]
                if len(known) > WORDS_KEPT:
                    known = Words()
                crcs = feature_crcs(pdf["text"].tolist(), known)
                n = np.array([len(c) for c in crcs])
                yield pd.DataFrame({"doc_id": ids_back(pdf["doc_id"], pdf["no_id"]).to_numpy(), "n_words": (n + 1) // 2, "n_features": n, "buckets": [(c % np.uint32(buckets)).astype(kind).tobytes() for c in crcs]})

    made = with_ids(docs, id_col, text_col).mapInPandas(run, "doc_id long, n_words long, n_features long, buckets binary")
    return made.select("doc_id", "n_words", "n_features", F.xxhash64("buckets").alias("tie"), "buckets")


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def histogram(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n for every bucket that holds a feature."""
    kind = _kind(buckets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(buckets, dtype=np.int64)
        for pdf in batches:
            for raw in pdf["buckets"]:
                n += np.bincount(np.frombuffer(raw, dtype=kind), minlength=buckets)
        held = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": held, "n": n[held]})

    return features.select("buckets").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket from the histograms of the documents and of the target."""
    counts = []
    for hist in (documents, target):
        n = np.zeros(buckets, dtype=np.int64)
        for r in hist.collect():
            n[r.bucket] = r.n
        counts.append(n)
    s, t = counts
    ratio = (t + 1.0) * (float(s.sum()) + buckets) / ((s + 1.0) * (float(t.sum()) + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """features with weight, the floored mean of its gains, in place of buckets."""
    kind = _kind(len(gain))
    schema = "doc_id long, n_words long, n_features long, tie long, weight long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean = [int(gain[np.frombuffer(raw, dtype=kind)].sum()) // max(1, len(raw) // kind.itemsize) for raw in pdf["buckets"]]
            yield pd.DataFrame({"doc_id": ids_back(pdf["doc_id"], pdf["no_id"]), "n_words": pdf["n_words"], "n_features": pdf["n_features"], "tie": pdf["tie"], "weight": mean})

    marked = features.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "n_words", "n_features", "tie", "buckets")
    return marked.mapInPandas(run, schema)


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """scored with rank: 1, 2, ... for the best percent of documents with min_words words, null for all others."""
    total, eligible = scored.agg(F.count("*"), F.count(F.when(F.col("n_words") >= min_words, 1))).first()
    most = percent * eligible // 100
    out = F.col("n_words") < min_words
    order = [out, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tie"]
    dealt = scored.repartitionByRange(max(1, -(-total // RANGE_ROWS)), *order).sortWithinPartitions(*order)
    # An increasing id is the number of its range in its upper bits and the place there in the lower 33.
    sorted_ = staged(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_id", 33).alias("_range")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sorted_.groupBy(part).agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    rank = F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    joined = sorted_.withColumn("_range", F.shiftright("_id", 33)).join(bases, "_range")
    return joined.withColumn("rank", F.when((F.col("n_words") >= min_words) & (rank <= most), rank)).drop("_id", "_range", "_base")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, buckets: int = BUCKETS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is set for the drawn ones."""
    features = staged(featurise(docs, buckets, id_col, text_col), "features", TEXT_ROWS)
    wanted = featurise(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), buckets, "id", "text")
    gain = gains(histogram(features, buckets), histogram(wanted, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = staged(weights(features, gain).withColumn("score", F.col("weight") + noise), "scored")
    return ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank")
