"""Token ids of whole texts as flat files of unsigned integers with 64-bit document offsets.

Rows are dealt to tasks by ranges of their id, so that each task holds a stretch
of the ascending order. It encodes its texts, appends the end id to each and
streams three files, all little-endian, into a folder that the cluster shares:

    NAME.bin   token ids, one after another, 2 bytes each if the vocabulary fits, else 4
    NAME.idx   n + 1 numbers of 64 bits: where each document starts within the shard, and the end
    NAME.doc   n document ids of 64 bits; the first `n_null` of them stand for absent ids

A shard gets its name only when it is whole, so what a lost task leaves behind is
named by no row of the manifest. The manifest has a row for each shard; its
`base_docs` and `base_tokens` are prefix sums over the shards, so a document's
place in the whole corpus is its shard's base plus its own offset, and no task
ever needs another's files. Readers map shards into memory; a store that can't be
mapped is read a document at a time.

Defined results: a null or empty text is the end id alone; rows without an id
come first; rows that repeat an id are ordered by a hash of their text, equal
rows by their place in the input; very long texts are one document, whole; an
empty table writes no shard and reads back as an empty table; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colligo.llm.common import fresh_path, ids_back, staged, with_ids
from colligo.llm.packing import encode_texts, vocabulary_size

#: Bytes of text that one shard is made of, about.
SHARD_BYTES = 32 << 20
#: Texts that are encoded, or documents that are read back, together.
STEP = 2048
SHARDS = "part int, shard string, width int, n_docs long, n_null long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def id_type(vocabulary: int) -> np.dtype:
    """The narrower of 2 and 4 bytes that holds every id."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as shards below folder and return the manifest: SHARDS, base_docs and base_tokens."""
    rows = with_ids(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // shard_bytes))
    kind = id_type(max(vocabulary_size(tokenizer_path), end_id + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder)
        name = uuid.uuid4().hex
        out = {}
        tokens, n_null = 0, 0
        starts, ids = [], []
        for whole in batches:
            for at in range(0, len(whole), STEP):
                pdf = whole.iloc[at : at + STEP]
                if not out:
                    files.create_dir(root, recursive=True)
                    out = {k: files.open_output_stream(f"{root}/_{name}.{k}") for k in ("bin", "idx", "doc")}
                for raw in encode_texts(pdf["text"].tolist(), tokenizer_path):
                    found = np.append(np.frombuffer(raw, dtype="<u4"), np.uint32(end_id)).astype(kind)
                    out["bin"].write(found.tobytes())
                    starts.append(tokens)
                    tokens += len(found)
                ids.append(pdf["doc_id"].to_numpy(dtype="<i8"))
                n_null += int(pdf["no_id"].sum())
        if not out:
            return
        out["idx"].write(np.array([*starts, tokens], dtype="<u8").tobytes())
        out["doc"].write(np.concatenate(ids).tobytes())
        for k, f in out.items():
            f.close()
            files.move(f"{root}/_{name}.{k}", f"{root}/{name}.{k}")
        yield pd.DataFrame([(TaskContext.get().partitionId(), f"{folder}/{name}", kind.itemsize, len(starts), n_null, tokens)], columns=[c.split()[0] for c in SHARDS.split(", ")])

    keyed = rows.select("doc_id", "no_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("no_id").desc(), "doc_id", "tie", "place"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "no_id", "text")
    made = staged(dealt.mapInPandas(run, SHARDS), "shards")
    # One row a shard: the only thing that all tasks' figures are brought together for.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("n_docs", "base_docs"), ("n_tokens", "base_tokens"))]
    return made.select("*", *bases)


def mapped(files: fs.FileSystem, path: str) -> pa.NativeFile:
    """A file mapped into memory where the store allows it, else one that is read by ranges."""
    return pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, shard: str, width: int) -> None:
        files, path = fs.FileSystem.from_uri(shard)
        self.kind = np.dtype(f"<u{width}")
        self.bin, self.idx, self.doc = (mapped(files, f"{path}.{k}") for k in ("bin", "idx", "doc"))

    def starts(self, first: int, n: int) -> np.ndarray:
        """Where n documents from `first` start, and where the last of them ends."""
        return np.frombuffer(self.idx.read_at(8 * (n + 1), 8 * first), dtype="<u8").astype(np.int64)

    def ids(self, first: int, n: int) -> np.ndarray:
        return np.frombuffer(self.doc.read_at(8 * n, 8 * first), dtype="<i8")

    def tokens(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.bin.read_at(self.kind.itemsize * int(end - start), self.kind.itemsize * int(start)), dtype=self.kind)

    def close(self) -> None:
        for f in (self.bin, self.idx, self.doc):
            f.close()


def read_shards(manifest: DataFrame) -> DataFrame:
    """READ for every document of the shards, from their files alone; start counts the tokens of all documents before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf.itertuples():
                shard = Shard(s.shard, int(s.width))
                for at in range(0, int(s.n_docs), STEP):
                    n = min(STEP, int(s.n_docs) - at)
                    starts = shard.starts(at, n)
                    sums = [zlib.crc32(shard.tokens(x, y).astype("<u4").tobytes()) for x, y in zip(starts, starts[1:], strict=False)]
                    absent = pd.Series(np.arange(at, at + n) < s.n_null)
                    yield pd.DataFrame({"doc_id": ids_back(pd.Series(shard.ids(at, n)), absent), "start": int(s.base_tokens) + starts[:-1], "n_tokens": np.diff(starts), "ids_crc32": sums})
                shard.close()

    # One shard a task, as far as their number allows.
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInPandas(run, READ)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as token files below folder (by default one of the shared folder that goes with the application) and read them back."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_shards(staged(write_shards(docs, folder, tokenizer_path, end_id, id_col=id_col, text_col=text_col), "manifest"))
