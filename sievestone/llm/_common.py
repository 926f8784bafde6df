"""Shared pieces of the text operators: storage of intermediate tables, and
vectorised tokenising of Arrow text columns."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once. Texts of some 100 KB then stay below 50 MB a batch.
BATCH_ROWS = 512

_U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | _U64(1)
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = _U64(0x9E3779B97F4A7C15)
_STEP_POW = np.ones(1, _U64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is
    unset a folder in the session's warehouse, which executors share too. The
    setting itself is left as it is."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    return (at or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged").rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which
    cuts the lineage: a lost executor costs no more than the tasks it ran."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Remove a table written by stage() that is no longer needed."""
    path = getattr(df, "_staged_at", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(name: str, taken) -> str:
    """name, with underscores before it until no column bears it."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def learned_fold(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo modulus (null id: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, max_bytes: int):
    """Ranges of whole documents of at most max_bytes together, or of one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, none of which crosses a
    document's end, and for each document the index of its first word."""
    solid = ~_WS[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = solid
    before[offsets[:-1]] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    after = np.zeros(len(buf) + 1, bool)
    after[:-1] = solid
    after[offsets[1:]] = False
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words: a polynomial in the place within the word, mixed.
    lower: A-Z count as a-z."""
    global _STEP_POW
    out = np.zeros(len(starts), _U64)
    table = _BYTE_LOWER if lower else _BYTE
    lens = ends - starts
    total = np.concatenate([[0], np.cumsum(lens)])
    i = 0
    while i < len(starts):
        # Some 256 KB at a time, or one word.
        j = min(len(starts), max(i + 1, int(np.searchsorted(total, total[i] + (1 << 18)))))
        n, first = lens[i:j], total[i:j] - total[i]
        if len(_STEP_POW) < (most := int(n.max())):
            _STEP_POW = np.cumprod(np.concatenate([np.ones(1, _U64), np.full(most * 2, _STEP | _U64(1))]))
        place = np.arange(total[j] - total[i]) - np.repeat(first, n)
        term = table[buf[place + np.repeat(starts[i:j], n)]] * _STEP_POW[place]
        out[i:j] = mix64(np.add.reduceat(term, first) + n.astype(_U64) * _U64(0xA24BAED4963EE407))
        i = j
    return out


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    return h ^ (h >> _U64(32))


def combine(*hashes: np.ndarray) -> np.ndarray:
    """One hash of a sequence of hashes; the order counts."""
    out = np.full(np.shape(hashes[0]), 0x51ED270B, _U64)
    for h in hashes:
        out = mix64(out * _U64(0x9FB21C651E98DF25) + h)
    return out


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
