"""Shared vectorised text primitives and job plumbing of the training-data operators.

Texts are handled as UTF-8 byte arrays with document offsets, in chunks of whole
documents, so the memory of a task is bounded by ``max_bytes`` plus one document.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.shared import fresh_path

U64 = np.uint64
MAX64 = U64(0xFFFFFFFFFFFFFFFF)
#: Words are separated by these bytes only: blank, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1B54A32D192ED03) + U64(salt)) | U64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        p, q = np.full(size, _BASE, U64), np.full(size, _BASE_INVERSE, U64)
        p[0] = q[0] = 1
        _powers[:] = [np.cumprod(p), np.cumprod(q)]
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any span of a byte array, from prefix sums modulo 2**64."""

    def __init__(self, b: np.ndarray):
        n = len(b)
        p, self.q = powers(n + 1)
        self.h = np.zeros(n + 1, U64)
        np.cumsum((b.astype(U64) + U64(1)) * p[:n], out=self.h[1:])

    def spans(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        x = (self.h[e] - self.h[s]) * self.q[s]
        return mix(x ^ ((e - s).astype(U64) * U64(0x9FB21C651E98DF25)))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each k bytes in a row, by start."""
        n = len(self.h) - k
        return mix((self.h[k:] - self.h[:n]) * self.q[:n]) if n > 0 else np.zeros(0, U64)


def words(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the index of its first word (one more at the end)."""
    n = len(b)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    full = ~SPACE[b]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    before = np.ones(n, bool)
    before[1:] = ~full[:-1]
    starts = np.flatnonzero(full & (before | cut[:n]))
    after = np.ones(n, bool)
    after[:-1] = ~full[1:]
    ends = np.flatnonzero(full & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z-lowered words, and each document's first word."""
    b = LOWER[b]
    s, e, ptr = words(b, off)
    return (Rolling(b).spans(s, e) if len(s) else np.zeros(0, U64)), ptr


def shingles(wh: np.ndarray, ptr: np.ndarray, k: int = 5, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k words in a row, and each document's first one. With ``whole``, a document of 1 to k-1 words has one: all its words."""
    n = np.diff(ptr)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64) if whole else 0)
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - ptr[:-1], count)
    mult = seeds(k, 77)
    h = np.zeros(len(at), U64)
    padded = np.concatenate([wh, np.zeros(k, U64)])
    for j in range(k):
        h += padded[at + j] * mult[j]
    h = mix(h)
    if whole:
        for d in np.flatnonzero((n > 0) & (n < k)):
            a, z = ptr[d], ptr[d + 1]
            h[out[d]] = mix(np.array([(wh[a:z] * mult[: z - a]).sum() + U64(z - a)], U64))[0]
    return h, out


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, o, data = column.buffers()
    off = np.frombuffer(o, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[off[0] : off[-1]], off - off[0]


def trim() -> None:
    """Gives free memory back to the system: idle Python workers would else keep what their tasks used."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(f):
    """f for mapInArrow, giving free memory back at the end of its task."""

    def run(batches):
        yield from f(batches)
        trim()

    return run


def chunks(batches, max_bytes: int = 1 << 19, text: str = "text"):
    """(record batch slice, bytes, offsets) of whole documents with about max_bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        b, off = flat(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            yield batch.slice(i, j - i), b[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j
        del batch, b, off
    trim()


def by_bytes(batches, column: str = "text", max_bytes: int = 1 << 20):
    """(record batch slice, list of texts), nulls as empty texts."""
    for batch, _, _ in chunks(batches, max_bytes, column):
        yield batch, ["" if t is None else t for t in batch.column(column).to_pylist()]


def binaries(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column of data cut at off (in items)."""
    raw = np.ascontiguousarray(data)
    o = (off * raw.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(o), pa.py_buffer(raw)]).cast(pa.binary())


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """An array by byte planes, compressed; ascending ones as differences."""
    if ascending and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(raw: bytes, kind, ascending: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)
    return np.cumsum(x, dtype=kind) if ascending else x


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id as long, and text; rows without doc_id go. Arrow batches are held to BATCH_BYTES, unless the session says otherwise, so that long texts don't fill a worker."""
    if not docs.sparkSession.conf.get(BATCH_SETTING, None):
        docs.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``row``, a 64-bit hash of both: rows that share a doc_id but not the text are told apart, equal rows share their results."""
    return texts(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and outlives executors.

    Afterwards the driver collects its garbage, so that Spark drops shuffle files of
    which nothing is left; long operators would else keep those of all their steps.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As ``stored``, in buckets of a key: what is dealt by it into as many partitions meets the table without a shuffle of the table."""
    spark = df.sparkSession
    path = fresh_path(spark, "table")
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.table(name)
    out.stored_at, out.stored_name = path, name
    return out


def settle(spark: SparkSession) -> None:
    """Waits a moment and collects again: right after a large step its shuffle files may still be held by events on their way."""
    time.sleep(1)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables from the shared folder, once all that is read from them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        if hasattr(table, "stored_name"):
            spark.sql(f"DROP TABLE IF EXISTS {table.stored_name}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
