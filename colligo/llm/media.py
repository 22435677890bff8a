"""Media columns: content-addressed payloads in tar shards, with metadata read by range from their headers.

A payload is kept as a greyscale PNG of 64 samples a row (8 bits each, deflated
without loss). Each task writes one tar shard to a shared folder through a file
system handle that also opens remote stores; a member is named by the sha256 of
its payload and written once in a shard. Rows carry digest, shard, offset and
length; all rows of a digest point to the same copy, the one of the smallest
shard name. The shards are the result's home and stay: each call writes a
folder of its own below the given one (the warehouse, by default), and `shard` is
the whole address, so that a row alone finds its payload. A shard is first
written under a name of its task attempt, so a lost task never leaves half a
shard that rows point to; files that no row points to are removed at the end. A
text that several tasks meet is stored by each of them; moving texts to one task
first would cost more than these copies.

Metadata columns come from reading only the first HEADER bytes of a stored
payload; features come from reading the stored range back and undoing it.

Defined results: a null text is an empty payload, 64 zero bytes; equal payloads
are stored once in a shard and have equal columns; a payload of any length is
one member; repeated rows have equal columns; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colligo.llm.common import staged, text_or_empty

WIDTH = 64
#: Signature, header chunk and its checksum.
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 8
#: Stored bytes of one shard at most, but for its last member.
SHARD_BYTES = 256 << 20
STORED = "digest string, n_payload long, shard string, offset long, length long"
READ = "digest string, width long, height long, bit_depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, length long"


def padded(raw: bytes) -> bytes:
    """raw with zero bytes up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first HEADER bytes."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != struct.unpack(">I", start[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", start[16:25])


def from_png(png: bytes) -> bytes:
    """The samples of a PNG that to_png made."""
    width, height, _ = png_header(png)
    at, packed = HEADER, []
    while at < len(png):
        (size,) = struct.unpack(">I", png[at : at + 4])
        if png[at + 4 : at + 8] == b"IDAT":
            packed.append(png[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of block means against their median."""
    x = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    blocks = np.array([b.mean() for b in np.array_split(x, 64)])
    bits = int("".join("1" if b else "0" for b in blocks > np.median(blocks)), 2)
    return f"{x.mean():.4f}:{x.std():.4f}:{max(0.0, -(share * np.log2(share)).sum()):.4f}:{bits:016x}"


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def store(payloads: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write rows (raw binary) to tar shards in folder; one row of STORED for each distinct payload of a shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)
        out = name = None
        at, seen = 0, {}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(bytes(1024))
                out.close()
                files.move(f"{root}/_{name}", f"{root}/{name}")
                out = None

        for pdf in batches:
            rows = []
            for raw in pdf["raw"]:
                payload = padded(bytes(raw))
                digest = hashlib.sha256(payload).hexdigest()
                if out is None or at >= shard_bytes:
                    if rows:
                        yield pd.DataFrame(rows, columns=["digest", "n_payload", "shard", "offset", "length"])
                        rows = []
                    close()
                    name, at, seen = f"{uuid.uuid4().hex}.tar", 0, {}
                    out = files.open_output_stream(f"{root}/_{name}")
                if digest in seen:
                    continue
                png = to_png(payload)
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(png)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out.write(head)
                out.write(png)
                out.write(bytes(-len(png) % 512))
                rows.append((digest, len(payload), f"{folder}/{name}", at + len(head), len(png)))
                seen[digest] = True
                at += len(head) + len(png) + -len(png) % 512
            if rows:
                yield pd.DataFrame(rows, columns=["digest", "n_payload", "shard", "offset", "length"])
        close()

    return payloads.mapInPandas(run, STORED)


def _open(shard: str):
    files, path = _files(shard)
    return files.open_input_file(path)


def drop_orphans(stored: DataFrame, folder: str) -> None:
    """Remove what is in folder but no row of stored points to: files of lost attempts, and shards of copies not chosen."""
    from pyarrow import fs

    files, root = _files(folder)
    names = [(f"{folder}/{f.base_name}",) for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True))]
    if names:
        listed = stored.sparkSession.createDataFrame(names, "shard string")
        for r in listed.join(stored.select("shard").distinct(), "shard", "left_anti").toLocalIterator():
            files.delete_file(root + r.shard[len(folder) :])


def headers(stored: DataFrame) -> DataFrame:
    """digest, width, height, bit_depth: from range reads of the first HEADER bytes only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for shard, part in pdf.groupby("shard", sort=False):
                with _open(shard) as f:
                    rows += [(d, *png_header(f.read_at(HEADER, int(o)))) for d, o in zip(part["digest"], part["offset"], strict=True)]
            yield pd.DataFrame(rows, columns=["digest", "width", "height", "bit_depth"])

    return stored.select("digest", "shard", "offset").mapInPandas(run, "digest string, width long, height long, bit_depth int")


def features(stored: DataFrame) -> DataFrame:
    """READ for every row of stored: header columns by a header-only range read, the others from the whole stored range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for shard, part in pdf.groupby("shard", sort=False):
                with _open(shard) as f:
                    for d, o, n in zip(part["digest"], part["offset"], part["length"], strict=True):
                        head = png_header(f.read_at(HEADER, int(o)))
                        png = f.read_at(int(n), int(o))
                        x = from_png(png)
                        rows.append((d, *head, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature(x), shard, o, n))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")])

    return stored.mapInPandas(run, READ)


def media_columns(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a payload below folder, point every row to one copy, read it back and add its columns.

    The digest of a row's payload is worked out by Spark; padding with zero bytes
    needs no second look at the text.
    """
    home = folder or docs.sparkSession.conf.get("spark.sql.warehouse.dir")
    folder = f"{home.rstrip('/')}/media-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("raw"))
    size = F.length("raw").cast("long")
    fill = F.when(size == 0, F.lit(WIDTH)).otherwise(F.pmod(-size, F.lit(WIDTH))).cast("int")
    digest = F.sha2(F.concat("raw", F.unhex(F.repeat(F.lit("00"), fill))), 256)
    keyed = rows.select("doc_id", size.alias("n_bytes"), digest.alias("digest"))
    copies = staged(store(rows.select("raw"), folder), "copies")
    # One copy for each digest, in the order of shards, so that a task reads whole stretches of few shards.
    chosen = staged(copies.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*").repartition("shard").sortWithinPartitions("shard", "offset"), "chosen")
    read = staged(features(chosen), "read")
    drop_orphans(chosen, folder)
    return keyed.join(read, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "digest", "shard", "offset", "length", "width", "height", "bit_depth")
