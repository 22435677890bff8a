"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature is CHUNKS x WIDTH symbols of b bits, each the low bits of a MinHash
over the distinct word shingles. Its distance is the number of differing
symbols. By pigeonhole, two signatures that differ in fewer than
CHUNKS * (ERRORS + 1) symbols have a chunk that differs in ERRORS symbols or
fewer; enumerating the allowed error positions of each chunk (masking them)
gives keys of which such a pair shares at least one. Hits beyond that distance
are kept as well: every candidate is confirmed on its full shingle sets, so the
links are exact and only the candidate search is probabilistic. At a likeness
of 0.8 the defaults miss 7 pairs in 100,000; farther above, practically none.

Texts with equal sets are first folded into one class, so copies are never
paired. Inside a bucket of equal keys members are not paired either: each is
compared with leaders, components are contracted, and only pairs of members
that still stand in different components are left; those whose one-bit
signatures (2048 hashes) are as close as a link's are compared as well. That
filter passes over a link once in 100,000 times; `bit_filter=False` does without.
A template whose copies are alike but not linked costs a comparison of two
signatures for each pair of copies, dealt over tasks; no such pair is a row.

Defined results: null and empty texts and texts without words have an empty
set, link with nothing and are their own component; rows that repeat a doc_id
are one document, linked with whatever any of them is linked with; rows
without a doc_id take part through their text's class and have the component
of that class, or none (null, kept) if no row of it has an id; very long texts
are hashed whole; an empty table gives an empty table; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colligo.llm.buckets import bucket_components
from colligo.llm.common import TEXT_ROWS, ids_back, spread_join, staged, with_ids
from colligo.llm.shingles import in_buffers, mix

CHUNKS, WIDTH, ERRORS, BITS = 9, 6, 1, 16
#: Pairs of one hub that a task confirms together, about.
HUB_ROWS = 256
#: One-bit signature of documents whose buckets hold several components after the first round.
SKETCH_BITS = 2048


def signatures(sets: list[np.ndarray], symbols: int, bits: int, seed: int = 7) -> np.ndarray:
    """b-bit MinHash symbols of non-empty sets, one row each."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1, 2**63, symbols, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.empty((len(sets), symbols), dtype=np.uint64)
    for j in range(symbols):
        out[:, j] = np.minimum.reduceat(flat * a[j] + b[j], starts)
    return mix(out) & np.uint64(2**bits - 1)


def probe_keys(sig: np.ndarray, chunks: int, width: int, errors: int, seed: int = 11) -> np.ndarray:
    """One key per chunk and set of error positions, from the chunk's other symbols."""
    rng = np.random.default_rng(seed)
    place = rng.integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = list(combinations(range(width), errors))
    out = np.empty((len(sig), chunks * len(masks)), dtype=np.uint64)
    for c in range(chunks):
        part = mix(sig[:, c * width : (c + 1) * width] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(1 << 32))
        for m, gone in enumerate(masks):
            kept = [i for i in range(width) if i not in gone]
            out[:, c * len(masks) + m] = mix((part[:, kept] * place[kept]).sum(axis=1, dtype=np.uint64) + np.uint64(c * len(masks) + m))
    return out


def sketch(docs: DataFrame, words: int, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (a 128-bit hash of the set), keys; keys is null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                pdf = whole.iloc[at : at + 256]
                sets = list(in_buffers(pdf["text"].tolist(), words))
                n = np.array([len(s) for s in sets])
                keys: list = [None] * len(sets)
                if n.any():
                    found = probe_keys(signatures([s for s in sets if len(s)], chunks * width, bits), chunks, width, errors).view(np.int64)
                    for i, k in zip(np.flatnonzero(n), found, strict=True):
                        keys[i] = k
                h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                h2 = np.array([mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"doc_id": ids_back(pdf["doc_id"], pdf["no_id"]), "n_shingles": n, "h1": h1, "h2": h2, "keys": keys})

    return docs.mapInPandas(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def bit_sketch(texts: DataFrame, words: int, bits: int = SKETCH_BITS) -> DataFrame:
    """id and x, a one-bit-per-hash MinHash signature as 64-bit integers, of every distinct set of an id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 128):
                pdf = whole.iloc[at : at + 128]
                sets = list(in_buffers(pdf["text"].tolist(), words))
                some = np.array([len(s) > 0 for s in sets])
                if not some.any():
                    continue
                sig = np.packbits(signatures([s for s in sets if len(s)], bits, 1, seed=23).astype(np.uint8), axis=1).view(np.int64)
                yield pd.DataFrame({"id": pdf["doc_id"][some], "x": list(sig)})

    return texts.select("doc_id", "text").mapInPandas(run, "id long, x array<long>").distinct()


def sketch_distance(a: str, b: str) -> Column:
    """Differing bits of two sketches. A loop over their numbers: spelt out, they make a method too large for the JVM to compile."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, y: x + y)


def bit_limit(percent: int, bits: int = SKETCH_BITS) -> int:
    """Distance that a pair of exactly the given likeness exceeds about once in 100,000 times."""
    p = (1 - percent / 100) / 2
    return int(bits * p + 4.3 * (bits * p * (1 - p)) ** 0.5) + 1


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those (u, v) of pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None, None)
        for whole in batches:
            for at in range(0, len(whole), 128):
                pdf = whole.iloc[at : at + 128]
                ok = []
                lead = list(zip(pdf["v"], pdf["text_v"], strict=True))
                new = np.array([x != y for x, y in zip(lead, [last[:2], *lead], strict=False)])
                leads = in_buffers(pdf["text_v"][new].tolist(), words)
                for s, v, fresh in zip(in_buffers(pdf["text_u"].tolist(), words), lead, new, strict=True):
                    if fresh:
                        last = (*v, next(leads))
                    both = len(np.intersect1d(s, last[2], assume_unique=True))
                    ok.append(100 * both >= percent * (len(s) + len(last[2]) - both))
                yield pdf.loc[ok, ["u", "v"]]

    pairs = staged(pairs, "pairs")
    # All pairs of a hub have the same v: they are dealt over tasks, here and where a member meets many.
    wide = spread_join(pairs, texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u", "v", HUB_ROWS, pairs)
    wide = spread_join(wide, texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v", "u", HUB_ROWS, pairs)
    return wide.select("u", "v", "text_u", "text_v").mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bit_filter: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for every row.

    Without bit_filter every candidate is confirmed on its sets, none is left out by its one-bit signature.
    """
    texts = with_ids(docs, id_col, text_col)
    rows = staged(sketch(texts, words), "sketch", TEXT_ROWS)
    # Rows of a class have one set, and so the same keys. An id that repeats may represent several classes.
    heads = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    heads = staged(heads, "classes")
    classes = heads.select("h1", "h2", "rep")
    probes = staged(heads.where("rep is not null").select(F.col("rep").alias("id"), "n", F.explode("keys").alias("key")), "probes")
    with_id = texts.where("not no_id").select("doc_id", "text")
    labels = bucket_components(
        probes,
        lambda pairs, texts: confirm(pairs, texts, words, percent),
        lambda a, b: 100 * F.least(f"n{a}", f"n{b}") >= percent * F.greatest(f"n{a}", f"n{b}"),
        (lambda ids, texts: bit_sketch(texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), words)) if bit_filter else None,
        (lambda a, b: sketch_distance(f"x{a}", f"x{b}") <= bit_limit(percent)) if bit_filter else None,
        with_id,
    )
    named = classes.join(labels.withColumnsRenamed({"u": "rep", "v": "comp"}), "rep", "left").select("h1", "h2", F.coalesce("comp", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for those whose document is not the one its group keeps; all columns stay."""
    gone = near_duplicates(docs, words, percent, id_col, text_col).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
