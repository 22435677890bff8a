"""Best-fit packing of tokenised documents into fixed-length sequences.

Every document becomes its token ids and an end id; only documents longer than
the capacity are cut. Pieces carry a demand vector (tokens, one document,
attention cost = length squared) and are placed best-fit decreasing: the bin
that keeps the smallest weighted residual norm (or has the largest weighted
dot-product with the demand) among bins that hold the piece in every dimension.

Work is dealt by a hash of the piece, so copies of one text or one huge
document spread evenly; each task packs bounded chunks of CHUNK pieces, sorted
first so that a rerun of a lost task places every piece as before.

Defined results: a null text is an empty document (one end id, one piece);
repeated rows are separate documents; an empty table gives an empty table; very
long texts are cut into whole pieces, never truncated; extra columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import ids_back, with_ids

#: Pieces that one call of the bin search holds at a time.
CHUNK = 32768
#: Distinct words whose ids a Python worker remembers.
WORDS_KEPT = 800_000
#: Stands between words that are encoded together.
MARK = "\x00"
SIGNS = (".", ",")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return tok, tok.encode(MARK, add_special_tokens=False).ids, {}


def vocabulary_size(path: str) -> int:
    """Number of ids of a tokenizer file."""
    return _tokenizer(path)[0].get_vocab_size()


def _encode_words(tok, mark: list[int], words: list[str]) -> list[bytes]:
    """Ids of words without white space. Words share a call, with a mark of one known id between them."""
    if len(mark) != 1 or any(MARK in w for w in words):
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch_fast(words, add_special_tokens=False)]
    out = []
    for i in range(0, len(words), 256):
        part = words[i : i + 256]
        ids = np.asarray(tok.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(ids == mark[0])
        if len(ends) != len(part) - 1:
            raise ValueError("the tokenizer merges words with the mark between them")
        raw, edges = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
        out += [raw[4 * (x + 1) : 4 * y] for x, y in zip(edges, edges[1:], strict=False)]
    return out


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian uint32 bytes.

    The tokenizer lower-cases, drops white space, never merges across it and
    parts letters from punctuation, so a text's ids are those of its words in
    turn, and those of a word ending in an ASCII letter and "." or "," are its
    stem's and the sign's (other letters may end in a mark once lower-cased,
    which the sign would join). Each distinct word is encoded once.
    """
    tok, mark, known = _tokenizer(path)
    if len(known) > WORDS_KEPT:
        known.clear()
    split = [_lowered(t).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
    new = set().union(*split).difference(known)
    signed = [w for w in new if w[-1:] in SIGNS and w[-2:-1].isascii() and w[-2:-1].isalpha()]
    plain = list(new.difference(signed).union(SIGNS, [w[:-1] for w in signed]).difference(known))
    known.update(zip(plain, _encode_words(tok, mark, plain), strict=True))
    known.update((w, known[w[:-1]] + known[w[-1]]) for w in signed)
    return [b"".join(map(known.__getitem__, words)) for words in split]


def _lowered(text: str) -> str:
    """Latin text in lower case, which the tokenizer would do itself; other text as it is."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the crc32 of its ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for at in range(0, len(whole), 2048):
                pdf = whole.iloc[at : at + 2048]
                out = []
                for doc, no_id, ids in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), encode_texts(pdf["text"].tolist(), tokenizer_path), strict=True):
                    ids += end
                    n = len(ids) // 4
                    out += [(doc, no_id, k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for k, s in enumerate(range(0, n, capacity))]
                made = pd.DataFrame(out, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32"])
                yield made.assign(doc_id=ids_back(made["doc_id"], made["no_id"])).drop(columns="no_id")

    return with_ids(docs, id_col, text_col).mapInPandas(run, PIECES)


def best_fit(demand: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "residual_norm") -> np.ndarray:
    """Bin number of every item. demand is items x dimensions; every item fits an empty bin.

    Items go in decreasing order of their largest normalised demand; ties keep
    their given order. Bins too full for the smallest item are closed.
    """
    need = demand / capacity
    order = np.argsort(-need.max(axis=1), kind="stable")
    least = need.min(axis=0)
    where = np.empty(len(need), dtype=np.int64)
    rest = np.empty((need.shape[1], max(1, len(need))))
    ids = np.empty(max(1, len(need)), dtype=np.int64)
    n = made = 0
    slack = 1e-12
    for i in order:
        d = need[i]
        b = -1
        if n:
            left = rest[:, :n] - d[:, None]
            score = weights @ (left * left) if rule == "residual_norm" else -((weights * d) @ rest[:, :n])
            score[left.min(axis=0) < -slack] = np.inf
            b = int(score.argmin())
            b = b if score[b] < np.inf else -1
        if b < 0:
            b, n = n, n + 1
            rest[:, b], ids[b] = 1.0, made
            made += 1
        rest[:, b] -= d
        where[i] = ids[b]
        if (rest[:, b] < least - slack).any():
            n -= 1
            rest[:, b], ids[b] = rest[:, n], ids[n]
    return where


def pack_pieces(pieces: DataFrame, partitions: int, capacity: int = 2048, max_docs: int | None = None, max_attention: float | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "residual_norm") -> DataFrame:
    """Adds sequence_id and offset to rows of PIECES under token, document-count and attention-cost capacities.

    max_docs and max_attention default to values that a full sequence of single
    tokens just reaches, so that only the token capacity can refuse a piece; all
    three residuals weigh alike in choosing among the sequences that hold it. A
    piece whose own cost exceeds max_attention is an error.
    """
    caps = np.array([capacity, max_docs or capacity, max_attention or float(capacity) ** 2])
    w = np.array(weights)

    def place(pdf: pd.DataFrame, first: int) -> tuple[pd.DataFrame, int]:
        size = pdf["length"].to_numpy(dtype=float)
        demand = np.stack([size, np.ones(len(size)), size * size], axis=1)
        if (demand > caps).any():
            raise ValueError("a piece exceeds the capacity of an empty sequence")
        full = size == capacity
        where = np.empty(len(size), dtype=np.int64)
        where[~full] = best_fit(demand[~full], caps, w, rule) if (~full).any() else 0
        used = int(where[~full].max()) + 1 if (~full).any() else 0
        where[full] = used + np.arange(full.sum())
        order = np.lexsort((np.arange(len(where)), where))
        lengths, bins = pdf["length"].to_numpy()[order], where[order]
        ends = np.cumsum(lengths)
        head = np.r_[True, bins[1:] != bins[:-1]]
        base = np.repeat((ends - lengths)[head], np.diff(np.r_[np.flatnonzero(head), len(bins)]))
        out = pdf.iloc[order].assign(sequence_id=first + bins, offset=ends - lengths - base)
        return out, first + used + int(full.sum())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= CHUNK:
                out, first = place(pd.concat(held, ignore_index=True), first)
                held = []
                yield out
        if held:
            yield place(pd.concat(held, ignore_index=True), first)[0]

    # Ids travel with a mark for absent ones, so that pandas keeps them whole.
    dealt = pieces.withColumn("_deal", F.xxhash64("doc_id", "piece", "ids_crc32")).repartition(partitions, "_deal").sortWithinPartitions("_deal", "doc_id", "piece")
    marked = dealt.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "piece", "start", "length", "ids_crc32")
    packed = marked.mapInPandas(run, PIECES + ", no_id boolean, sequence_id long, offset long")
    return packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, docs_per_task: int = 16384, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """Tokenise and pack whole documents; tasks grow in number with the documents, not in size."""
    partitions = max(1, -(-docs.count() // docs_per_task))
    return pack_pieces(tokenize_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), partitions, capacity, **limits)
