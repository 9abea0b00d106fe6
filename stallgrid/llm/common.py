"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one vectorised step handles at once, in bytes; a longer document is a step of its own.
CHUNK_BYTES = 1_000_000


#: Functions that drop a worker process's word caches: workers are reused, and the next operator needs the memory.
FREE: list[Callable[[], None]] = []


def shared_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable: the folder of spark.checkpoint.dir, or a scratch one of a local session (tests)."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared checkpoint folder, with the lineage cut."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint()


def id_crc(col: str = "doc_id"):
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def spread(col: str = "doc_id"):
    """A number in [0, 1) that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def text_chunks(texts: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of consecutive rows, at most about ``limit`` bytes together; null is empty."""
    pa.default_memory_pool().release_unused()  # what earlier batches of this worker left
    for free in FREE:
        free()
    first, size, out = 0, 0, []
    for i, t in enumerate(texts):
        b = (t.as_py() or "").encode("utf-8", "replace")
        if out and size + len(b) > limit:
            yield first, out
            first, size, out = i, 0, []
        out.append(b)
        size += len(b)
    if out:
        yield first, out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class PrefixHash:
    """Polynomial hashes of any substring of a byte buffer, 64 bits, from one cumulative sum."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        inverse = pow(self.BASE, -1, 2**64)
        self.up, self.down = _powers(self.BASE, n + 1), _powers(inverse, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; tables up to 2 M entries are kept for the worker's next chunk."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 21:
            _POWERS[base] = have
    return have[:n]
