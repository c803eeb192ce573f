"""Media columns by signature sniffing.

Magic bytes are located with an Aho-Corasick automaton in one pass over the bytes;
a validator for each format then confirms structure and lengths and says where the
file ends, so a chance match is not a file. The file at offset 0 gives the true
type, whatever type was declared; those found further on are carved.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.llm.common import checkpointed, deleted, shared_folder, table

BLOCK = 64
RATE = 8000

# Magic bytes by media type, from the public format descriptions.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
}


class Media(NamedTuple):
    kind: str
    start: int
    end: int


def wav_end(data: bytes, at: int) -> int:
    """The end of a RIFF/WAVE file at ``at`` whose chunks fill it exactly, else -1."""
    if len(data) < at + 44 or data[at + 8 : at + 12] != b"WAVE":
        return -1
    end, chunk, seen = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12, set()
    while chunk + 8 <= min(end, len(data)):
        name, length = data[chunk : chunk + 4], struct.unpack_from("<I", data, chunk + 4)[0]
        if name == b"fmt " and length < 16:
            return -1
        seen.add(name)
        chunk += 8 + length + length % 2
    return end if chunk == end <= len(data) and {b"fmt ", b"data"} <= seen else -1


def png_end(data: bytes, at: int) -> int:
    """The end of a PNG whose chunks' checksums hold, from IHDR to IEND, else -1."""
    chunk, first = at + 8, True
    while chunk + 12 <= len(data):
        length = struct.unpack_from(">I", data, chunk)[0]
        end = chunk + 12 + length
        if end > len(data) or (first and data[chunk + 4 : chunk + 8] != b"IHDR"):
            return -1
        if zlib.crc32(memoryview(data)[chunk + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return -1
        if data[chunk + 4 : chunk + 8] == b"IEND":
            return end
        chunk, first = end, False
    return -1


def gif_end(data: bytes, at: int) -> int:
    """The end of a GIF whose blocks lead to the trailer, else -1."""
    if len(data) < at + 13:
        return -1
    table_of = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0
    p, images = at + 13 + table_of(data[at + 10]), 0
    while p < len(data):
        if data[p] == 0x3B:
            return p + 1 if images else -1
        if data[p] == 0x21:
            p += 2
        elif data[p] == 0x2C and p + 10 < len(data):
            p, images = p + 11 + table_of(data[p + 9]), images + 1
        else:
            return -1
        while p < len(data) and data[p]:
            p += 1 + data[p]
        p += 1
    return -1


def jpeg_end(data: bytes, at: int) -> int:
    """The end of a JPEG whose segments lead through a scan to the end marker, else -1."""
    p, scanned = at + 2, False
    while p + 4 <= len(data) and data[p] == 0xFF:
        marker, length = data[p + 1], struct.unpack_from(">H", data, p + 2)[0]
        if length < 2 or p + 2 + length > len(data):
            return -1
        p += 2 + length
        if marker == 0xDA:
            scanned = True
            while (p := data.find(b"\xff", p)) >= 0 and p + 1 < len(data) and (data[p + 1] == 0 or 0xD0 <= data[p + 1] <= 0xD7):
                p += 2
            if p < 0 or p + 1 >= len(data):
                return -1
        if data[p : p + 2] == b"\xff\xd9":
            return p + 2 if scanned else -1
    return -1


def bmp_end(data: bytes, at: int) -> int:
    """The end of a BMP whose header sizes and offsets agree, else -1."""
    if len(data) < at + 54:
        return -1
    size, zero, offset, header, _, _, planes, depth = struct.unpack_from("<IIIIiiHH", data, at + 2)
    fits = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return at + size if fits and 14 + header <= offset <= size <= len(data) - at else -1


ENDS = {"audio/wav": wav_end, "image/png": png_end, "image/gif": gif_end, "image/jpeg": jpeg_end, "image/bmp": bmp_end}


def automaton() -> ahocorasick.Automaton:
    """Over Latin-1 text, in which every byte is one character."""
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(data: bytes, search: ahocorasick.Automaton) -> list[Media]:
    """The confirmed files in ``data``, by start. Files within files are listed too."""
    found = []
    for last, (length, kind) in search.iter(data.decode("latin-1")):
        at = last + 1 - length
        if (end := ENDS[kind](data, at)) > at:
            found.append(Media(kind, at, end))
    return found


def true_type(declared: str | None, found: list[Media]) -> str | None:
    """The type of the file at offset 0; the declared one if no file is there."""
    return next((m.kind for m in found if m.start == 0), declared)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Samples of 8 bits, one channel, as a WAV file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)


def wav_samples(data: bytes, media: Media) -> bytes:
    chunk = media.start + 12
    while data[chunk : chunk + 4] != b"data":
        length = struct.unpack_from("<I", data, chunk + 4)[0]
        chunk += 8 + length + length % 2
    return data[chunk + 8 : chunk + 8 + struct.unpack_from("<I", data, chunk + 4)[0]]


def padded(data: bytes, block: int = BLOCK) -> bytes:
    """Zero bytes appended up to a positive multiple of ``block``."""
    return data + b"\0" * (max(1, -(-len(data) // block)) * block - len(data))


def sniffed(df: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """Adds media_type (corrected) and carved, array of (kind, start, end, bytes), to ``df``.

    ``content`` is binary: null or empty content keeps the declared type and carves
    nothing. Files at offset 0 are the content itself and aren't carved. Columns of
    ``df`` with those two names are replaced; all others are kept.
    """
    kept = [c for c in df.columns if c.lower() not in ("media_type", "carved")]
    carved = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.binary())]))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for batch in batches:
            kinds, files = [], []
            for data, said in zip(batch[content], batch[declared]):
                data = data.as_py() or b""
                found = sniff(data, search)
                kinds.append(true_type(said.as_py(), found))
                files.append([{"kind": m.kind, "start": m.start, "end": m.end, "bytes": data[m.start : m.end]} for m in found if m.start])
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(kinds, pa.string()), pa.array(files, carved)], names=[*kept, "media_type", "carved"])

    added = StructType.fromDDL("media_type string, carved array<struct<kind:string,start:bigint,end:bigint,bytes:binary>>")
    return df.select(*kept).mapInArrow(of_batches, StructType([*df.select(*kept).schema.fields, *added.fields]))


DECLARED = "application/octet-stream"


def media_of_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, content, declared: each row's text as a media column.

    The text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the
    samples of a WAV file that is declared to be plain bytes. A null text counts as
    empty: 64 zero bytes.
    """

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(t.as_py() or "").encode() for t in batch["text"]]
            columns = [pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(padded(x)) for x in data], pa.binary()), pa.array([DECLARED] * len(data), pa.string())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "n_bytes", "content", "declared"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(of_batches, f"doc_id {kind}, n_bytes long, content binary, declared string")


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(content: bytes, kind: str, carved: int) -> tuple:
    """Of a file that was sniffed as WAV: the digests of its samples and of itself, and the
    feature: its type, mean and deviation of the samples in 1/1000, and the files carved."""
    payload = wav_samples(content, Media(kind, 0, len(content)))
    samples = np.frombuffer(payload, np.uint8)
    feature = f"{kind};mean={int(samples.mean() * 1000)};dev={int(samples.std() * 1000)};carved={carved}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(content), hashlib.sha256(content).hexdigest(), feature


def stored_texts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes and the :func:`digests` of each row of ``docs``, by way of stored media.

    The media column is written to ``folder`` (a new one in the shared folder) and read
    back; :func:`sniffed` corrects its declared type, which must come out as WAV, and
    the digests are those of the bytes that were read. The files stay, for the caller
    to delete with the result. Null, empty and very long texts are stored whole,
    repeated rows give equal values, an empty table gives an empty result; other
    columns, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    media_of_texts(docs).write.option("compression", "zstd").parquet(folder)
    found = sniffed(spark.read.parquet(folder)).select("doc_id", "n_bytes", "content", "media_type", F.size("carved").alias("carved"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        for batch in batches:
            if any(k.as_py() != "audio/wav" for k in batch["media_type"]):
                raise ValueError("a stored file wasn't sniffed as what it is")
            rows = [digests(c.as_py(), k.as_py(), n.as_py()) for c, k, n in zip(batch["content"], batch["media_type"], batch["carved"])]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *columns], names=["doc_id", "n_bytes", *names])

    return found.mapInArrow(of_batches, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, {DIGESTS}")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored media of each row of ``documents``, by :func:`stored_texts`: doc_id,
    n_bytes, and the digests of the payload and of the file that was read back. The media
    are deleted when the digests, a small part of them, are settled."""
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    found = checkpointed(stored_texts(table(spark, sf_dir, "documents"), folder))
    deleted(spark, folder)
    return found
