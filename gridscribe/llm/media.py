"""Media columns: payloads stored as lossless WebP images, and images decoded to pixel arrays."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import prepare, table

#: Samples in a row of a payload's image; rows in one frame of it.
WIDTH, FRAME_ROWS = 64, 64


def padded(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of WIDTH."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def store(payload: bytes) -> bytes:
    """A WebP file of the payload, one eight-bit sample for a byte; long payloads are frames below one another."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    parts = [samples[k : k + FRAME_ROWS] for k in range(0, len(samples), FRAME_ROWS)]
    return webp.wrap([(len(p), webp.encode_samples(p)) for p in parts], WIDTH)


def read_back(files: list[bytes]) -> list[bytes]:
    """Payloads of stored files; all their frames are decoded together."""
    placed = [sorted((y, x, s) for x, y, s in webp.frames(f)) for f in files]
    decoded = iter(webp.decode_streams([s for f in placed for _, _, s in f]))
    return [b"".join(((next(decoded) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes() for _ in f) for f in placed]


def features(payload: bytes) -> str:
    """Rows, mean sample, entropy in bits and mean step between neighbours in a row, of a payload that was read back."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    share = share[share > 0]
    step = np.abs(np.diff(samples.reshape(-1, WIDTH).astype(np.int16), axis=1))
    return f"rows={len(samples) // WIDTH};mean={samples.mean():.3f};bits={abs(float(-(share * np.log2(share)).sum())):.4f};step={step.mean():.3f}"


_FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary())]
_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): the whole text as a WebP file, and what was read back from it.

    The payload is the text as UTF-8 (null: empty), padded with bytes 0. `media` is the file; payload_sha256,
    tail_crc32 (of the last 64 bytes) and feature are of the payload decoded from the file. Equal texts have equal files.
    An empty table gives no rows; other columns are not looked at.
    """
    prepare(docs.sparkSession, 512)
    schema = pa.schema(_FIELDS)

    def stored(batches):
        for batch in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
            files = [store(padded(x)) for x in raw]
            back = read_back(files)
            columns = [
                batch["doc_id"].cast(pa.int64()),
                [len(x) for x in raw],
                [len(x) for x in back],
                [hashlib.sha256(x).hexdigest() for x in back],
                [zlib.crc32(x[-64:]) for x in back],
                [len(f) for f in files],
                [hashlib.sha256(f).hexdigest() for f in files],
                [features(x) for x in back],
                files,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(stored, _SCHEMA)


def decode_images(images: DataFrame, column: str = "media") -> DataFrame:
    """`images` with width, height and pixels (array<int>: 0xAARRGGBB as signed integers, row by row) of a column of WebP files.

    They replace columns of these names. They are null where the file is null, empty or not lossless WebP.
    """
    prepare(images.sparkSession, 64)
    kept = images.drop("width", "height", "pixels")

    def decoded(batches):
        for batch in batches:
            sizes, flat = [], []
            for data in batch[column].to_pylist():
                try:
                    p = webp.decode(data or b"")
                except webp.WebpError:
                    p = None
                sizes.append((None, None) if p is None else (p.shape[1], p.shape[0]))
                flat.append(None if p is None else p.ravel().view(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32()), pa.array(flat, pa.list_(pa.int32()))], names=[*batch.schema.names, "width", "height", "pixels"])

    schema = kept.selectExpr("*", "cast(null as int) as width", "cast(null as int) as height", "cast(null as array<int>) as pixels").schema
    return kept.mapInArrow(decoded, schema)


def op6_webp(spark, sf_dir: str) -> DataFrame:
    """Every text of documents, stored and read back; nulls, repeated rows and empty tables as in `store_texts`."""
    return store_texts(table(spark, sf_dir, "documents")).drop("media")
