"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows, and about as many bytes, that go to Python at a time. Documents can be long, and a batch is held several times on its way.
ROWS, BYTES = 2000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``ROWS`` rows and ``BYTES`` bytes, if they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS:
        spark.conf.set(name, str(ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BYTES:
        spark.conf.set(name, str(BYTES))


def partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle; the cluster's owner scales it with the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the folder that the cluster shares: the session's ``spark.checkpoint.dir``, which must be set."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8."""
    return text.encode().lower().split() if text else []


def learnable(doc_id: str = "doc_id"):
    """crc32 of doc_id as text; splits into folds are taken from it."""
    return F.crc32(F.col(doc_id).cast("string"))


_held: dict[str, Callable[[], None]] = {}


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)  # other C libraries have no such call


def give_back() -> None:
    """Memory that is free in this process, but that its allocators keep, goes back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def holds(module: str, release: Callable[[], None] = lambda: None) -> None:
    """Called by a task of a module: what other modules keep in this Python worker, which outlives tasks, is let go, and free memory given back."""
    for other in [m for m in _held if m != module]:
        _held.pop(other)()
    _held[module] = release
    give_back()


def per_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that treats each batch by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds(make.__module__, _held.get(make.__module__, lambda: None))
        for batch in batches:
            if batch.num_rows and (made := make(batch)) is not None:
                yield made
        give_back()

    return run


@functools.lru_cache(maxsize=1)
def _packers() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = np.array([len(arrays), *(len(a) * a.itemsize for a in arrays)], np.int64).tobytes()
    return _packers()[0].compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = _packers()[1].decompress(blob)
    sizes = np.frombuffer(data, np.int64, len(kinds), 8)
    at = 8 * (len(kinds) + 1)
    out = []
    for kind, size in zip(kinds, sizes.tolist(), strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out
