"""Small helpers shared by the training-data operators.

Every operator selects the columns it needs by name, so extra columns (also ones that clash with an
output name) are ignored where the result has a fixed schema.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.session import ensure_checkpoint_dir

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the cluster."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; later reads take the columns that they need."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (already materialised) with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_HELD: dict = {}


def held(key, make):
    """What ``make()`` gave for ``key`` in this worker process; only the last key is kept, so that the memory of one
    operator's words is free before the next operator's tasks run in the same worker."""
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return freed memory of this worker to the system (allocators keep it for themselves otherwise)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` text bytes (one longer text stays whole)."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum([0 if v is None else v for v in pc.binary_length(col).to_pylist()])
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
    give_back()  # an idle worker beside a native stage then holds little more than its operator's words


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [b"" if v is None else v for v in col.to_pylist()]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts as strings; null is empty."""
    return ["" if v is None else v for v in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (vectorised); equal inputs give equal outputs on every machine."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: Odd multiplier of the word hash and its powers' inverse (mod 2^64).
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # A-Z only


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the number of words of each text."""
    data = np.frombuffer(b" ".join([b"", *docs, b""]), np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    acc = np.empty(len(data) + 1, U64)
    acc[0] = 0
    np.cumsum(_BYTE[data] * powers(ODD, len(data)), out=acc[1:])
    sums = (acc[ends] - acc[starts]) * powers(INVERSE, len(data) + 1)[starts]
    hashes = mix(sums + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))
    first = np.cumsum([1] + [len(d) + 1 for d in docs])
    at = np.searchsorted(starts, first)
    return hashes, np.diff(at)
