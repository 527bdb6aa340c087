"""Media columns: payloads stored as baseline JPEG, and features of JPEG columns."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from trovespark.llm import jpeg
from trovespark.llm.common import in_arrow, with_text
from trovespark.llm.tokens import runs

UNIT = 64


def padded(text: bytes) -> bytes:
    return text + bytes((-len(text)) % UNIT if text else UNIT)


def read(images: list[bytes]) -> list[tuple]:
    """Their thumbnails and sizes; an image whose scan can't be decoded has none."""
    try:
        return jpeg.thumbnails(images)
    except (IndexError, ValueError):
        return [x for i in images for x in read([i])] if len(images) > 1 else jpeg.thumbnails([b""])


def as_jpeg(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row: the text's UTF-8 bytes (null: none), zeros up to a positive multiple of 64, as JPEG."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for at, to in runs(list(map(len, texts)), 1 << 19):
                media = jpeg.store([padded(t) for t in texts[at:to]])
                yield pa.record_batch([b.column(0)[at:to], pa.array([len(t) for t in texts[at:to]], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return in_arrow(with_text(docs), batches, "doc_id long, n_bytes long, media binary")


def jpeg_features(media: DataFrame) -> DataFrame:
    """doc_id and n_bytes with what the stored bytes give: the payload's length, hash and tail, those of the stored form, the image sizes and the thumbnail's hash.

    Null, malformed and other than baseline media have no payload: 0 bytes, size 0x0 and a hash of zeros.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            stored = [x or b"" for x in b.column(2).to_pylist()]
            for at, to in runs(list(map(len, stored)), 1 << 19):
                some, rows = stored[at:to], []
                for raw, (grid, sizes) in zip(some, read(some), strict=True):
                    payload = grid.tobytes()
                    size = f"{sizes[0][0]}x{sum(h for _, h in sizes)}" if sizes else "0x0"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), f"{size}:{jpeg.thumbnail_hash(grid)}"))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([b.column(0)[at:to], b.column(1)[at:to], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return in_arrow(media.select("doc_id", "n_bytes", "media"), batches, schema)


def media_of_documents(docs: DataFrame) -> DataFrame:
    """Stores every text as JPEG in a media column and reads it back.

    A null or empty text is 64 zero bytes; texts of any length are stored whole; repeated rows come
    back as often as they stand; an empty table gives no rows; other columns are ignored.
    """
    return jpeg_features(as_jpeg(docs))
