"""Shared pieces of the corpus operators: durable intermediate tables and text kernels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a numpy kernel works on at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or else the context's checkpoint folder; a fresh
    local one only where neither is set and the executors are threads of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/quarry/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder, in a folder for each value of by, and read it back:
    lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that materialize wrote, once nothing reads it any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What kernels keep in a worker from task to task; workers are shared, so others drop it first.
KEPT: dict[str, object] = {}


def release(keep: str | None = None) -> None:
    """Drop what is kept but for one name, and give freed memory back to the system."""
    for name in [k for k in KEPT if k != keep]:
        del KEPT[name]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about SLICE_BYTES of text, or one row.

    A kernel names what it keeps; all else that earlier tasks left in this worker is let go.
    """
    release(keep)
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = string_buffers(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, in place on a uint64 array."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random uint64 values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


_POW: dict[str, np.ndarray] = {}
_BASE = U64(0x5851F42D4C957F2D)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if not _POW or len(_POW["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[key] = np.cumprod(steps)
    return _POW["up"], _POW["down"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = sum of values[k] * base**k over i <= k < j."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[starts:ends]; the length counts."""
    _, down = powers(len(prefix))
    h = (prefix[ends] - prefix[starts]) * down[starts]
    h += (ends - starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE_VALUES = stream(11, 256)
LOWER_BYTE_VALUES = BYTE_VALUES.copy()
LOWER_BYTE_VALUES[65:91] = BYTE_VALUES[97:123]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document) of words, runs of [^\\x20\\x09-\\x0D]."""
    word = np.zeros(len(raw) + 2, bool)
    word[1:-1] = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | first[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document, concatenated, and their offsets.

    A-Z count as a-z. A document of fewer than k words has its whole sequence as one shingle,
    one without words has none.
    """
    starts, ends, words = word_spans(raw, offsets)
    h = span_hash(prefix_hash(LOWER_BYTE_VALUES[raw]), starts, ends)
    mult = stream(23, k + 1) | U64(1)
    grams = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        grams += h[j : j + len(grams)] * mult[j]
    mix(grams)
    parts, sizes = [], np.zeros(len(offsets), np.int64)
    for d in range(len(offsets) - 1):
        a, b = words[d], words[d + 1]
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        elif b > a:
            own = mix((h[a:b] * mult[: b - a]).sum(dtype=np.uint64, keepdims=True) ^ mult[k : k + 1] * U64(b - a))
        else:
            continue
        parts.append(own)
        sizes[d + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.cumsum(sizes)
