"""Texts as media: bytes in progressive JPEG files, read back, with tensors and features.

The UTF-8 bytes of a text, padded with zero bytes to a positive multiple of 64, become a file (see ``jpeg``); everything
after that is computed from the file. Null and empty texts give 64 zero bytes; equal texts give equal values; an empty table gives no
rows; more columns of the input are left alone. Memory is that of one document's tensor at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import jpeg

DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
STORED = "doc_id long, n_bytes long, media binary"
TENSORS = "doc_id long, n_bytes long, payload binary, height int, width int, rgb binary"
SLICE = 256


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + bytes(-len(data) % 64 or (0 if data else 64))


def feature(tensor: np.ndarray) -> str:
    """Height, width, then mean and share of saturated samples of R, G and B."""
    channels = tensor.transpose(2, 0, 1).reshape(3, -1)
    means = channels.sum(axis=1, dtype=np.int64) / channels.shape[1]
    full = [np.count_nonzero(c == 255) / channels.shape[1] for c in channels]
    return f"{tensor.shape[0]}x{tensor.shape[1]};" + ",".join(f"{m:.3f}" for m in means) + ";" + ",".join(f"{s:.4f}" for s in full)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(make, schema: pa.Schema, *columns: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, SLICE):  # few large values at a time
                part = b.slice(at, SLICE)
                yield _batch([make(*row) for row in zip(*(part.column(c).to_pylist() for c in columns), strict=True)], schema)

    return run


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the file of each document."""

    def one(doc_id: int | None, text: str | None) -> tuple:
        n, data = payload(text)
        return doc_id, n, jpeg.encode(data)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows(one, schema, "doc_id", "text"), STORED)


def load(stored: DataFrame) -> DataFrame:
    """From ``store``'s rows: the payload and the RGB tensor (height x width x 3 bytes) of each file."""

    def one(doc_id: int | None, n: int, media: bytes) -> tuple:
        height, width, planes, sampling = jpeg.decode(media)
        data = jpeg.payload_of(planes, max(64, n + -n % 64))
        return doc_id, n, data, height, width, jpeg.rgb(height, width, planes, sampling).tobytes()

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_rows(one, schema, "doc_id", "n_bytes", "media"), TENSORS)


def digests(docs: DataFrame) -> DataFrame:
    """What ``load(store(docs))`` gives, as lengths, checksums and a feature, without handing tensors on."""

    def one(doc_id: int | None, text: str | None) -> tuple:
        n, data = payload(text)
        media = jpeg.encode(data)
        height, width, planes, sampling = jpeg.decode(media)
        back = jpeg.payload_of(planes, len(data))
        tensor = jpeg.rgb(height, width, planes, sampling)
        return doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor)

    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows(one, pa.schema(list(kinds.items())), "doc_id", "text"), DIGESTS)
