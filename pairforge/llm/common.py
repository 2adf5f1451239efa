"""Shared pieces: the shared folder, Arrow text as byte arrays, vectorised word and n-gram hashes, components.

Text kernels work on blocks of a few megabytes: `text_blocks` cuts Arrow batches at document borders, so memory
follows the block size (or the longest single document), never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.shared import shared_base
from pairforge.operators.graph import components, forest  # noqa: F401

BLOCK_BYTES = 1 << 19
HELD_BYTES = 128 << 20  # of a broadcast table's rows in memory
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: everything but blank and \t..\r.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes: digits, letters, and every byte of a character outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; a local one only where it is unset and Spark runs on this machine alone."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each name, itself or the first of name_, name__, ... that is no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def publish(fs: pafs.FileSystem, mine: str, final: str) -> None:
    """Moves an attempt's whole file to its place; an earlier attempt's equal file gives way where a store does not replace by itself."""
    try:
        fs.move(mine, final)
    except OSError:
        if fs.get_file_info(final).type == pafs.FileType.NotFound:
            raise
        fs.delete_file(final)
        fs.move(mine, final)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from `written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_bytes(df: DataFrame) -> int:
    """Size on disk of what `written` returned, from the file listing that Spark keeps."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _beyond(value: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in a row of Spark's binary format besides its own eight."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(value) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.StructType):
            inner = F.transform(value, lambda x: (F.coalesce(_beyond(x, kind.elementType), F.lit(0)) + 8).cast("long"))
            return F.aggregate(inner, F.lit(16).cast("long"), lambda s, x: s + x)
        return 8 * F.size(value) + 16
    if isinstance(kind, T.StructType):
        return sum((F.coalesce(_beyond(value[f.name], f.dataType), F.lit(0)) + 8 for f in kind.fields), F.lit(8))
    return F.lit(0)


def held_bytes(df: DataFrame) -> int:
    """What the rows of df take in memory when they are broadcast, about: counted over all of them."""
    row = sum((F.coalesce(_beyond(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) + 8 for f in df.schema.fields), F.lit(8))
    return int(df.agg(F.sum(row.cast("long"))).first()[0] or 0)


def small_side(df: DataFrame, limit: int, held: int = HELD_BYTES) -> DataFrame:
    """df (from `written`), marked for a broadcast only if its files hold at most `limit` bytes and its rows at most `held` in memory
    (a file of equal values can be a thousand times smaller than they are); else left to shuffle."""
    return F.broadcast(df) if written_bytes(df) <= limit and held_bytes(df) <= held else df


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows with about `size` bytes of text; a longer text comes alone."""
    for batch in batches:
        buf, offs = utf8_bytes(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo), buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def release_memory() -> None:
    """Gives what a finished task freed back to the system: a worker lives on, and two of them share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Keys the hashes of words; drawn once by the driver, so nobody can build words that agree.
_SECRET = os.urandom(16)


def use_secret(secret: bytes) -> None:
    """Makes this worker hash words as the driver does."""
    global _SECRET
    if secret != _SECRET:
        _SECRET = secret
        _word_keys.cache_clear()


@functools.lru_cache(1)
def _word_keys() -> np.ndarray:
    """Four rows of random factors, one for each eight bytes of a short range and two more."""
    return np.frombuffer(hashlib.shake_256(_SECRET).digest(32 * (LONG // 8 + 2)), "<u8").reshape(4, -1)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hashes words with the driver's secret and releases memory at its end."""
    secret = _SECRET

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_secret(secret)
        try:
            yield from task(batches)
        finally:
            release_memory()

    return run


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Arrow batches of at most 4 MB in this session, unless it has a size of its own; the default holds 64 MB on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "64m", "64MB", "67108864", "67108864b"):
        spark.conf.set(name, size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@functools.lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


BASE = 0x5851F42D4C957F2D
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and extended as needed."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, BLOCK_BYTES + 1024), base, np.uint64)
        x[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(x)
    return have[:n]


def ranged_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each range, equal for equal content wherever it stands.

    A polynomial modulo 2**64: different long ranges can be made to agree, so it only routes windows and finds candidates that are
    compared afterwards; what tells texts, words or pieces apart is `byte_hash` or a digest.
    """
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n), out=sums[1:])
    inverse = powers(pow(BASE, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 512  # ranges beyond this many bytes are hashed one by one


def byte_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each range's bytes: eight bytes at a time are joined to the state, which a bijection mixes after each step.

    Ranges of one length of at most eight bytes never collide.  Hashes under two seeds together have 128 bits.
    """
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    eight = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[live], size[live]
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & KEEP[np.minimum(left, 8)]))
        on = left > 8
        live, at, left = live[on], at[on] + 8, left[on] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(np.ascontiguousarray(buf[starts[k] : ends[k]]), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[k] = np.frombuffer(digest, np.uint64)[0]
    return out


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of a keyed hash of each range's bytes.

    Twice the upper half of a sum of random factors times 32-bit pieces of the range, and its size: any two different ranges, chosen without
    knowing the factors, agree with probability 2**-64.  Longer ranges get a keyed cryptographic digest.
    """
    size = ends - starts
    keys = _word_keys()
    low, high = np.uint64(0xFFFFFFFF), np.uint64(32)
    one, two = (size.astype(np.uint64) * keys[k, -1] + keys[k, -2] for k in (0, 2))
    eight = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))
    live = np.flatnonzero((size > 0) & (size <= LONG))
    at, left, k = starts[live], size[live], 0
    while len(live):
        x = eight[at] & KEEP[np.minimum(left, 8)]
        y, x = x >> high, x & low
        one[live] += x * keys[0, k] + y * keys[1, k]
        two[live] += x * keys[2, k] + y * keys[3, k]
        on = left > 8
        live, at, left, k = live[on], at[on] + 8, left[on] - 8, k + 1
    out = (one & ~low) | (two >> high)
    for k in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(np.ascontiguousarray(buf[starts[k] : ends[k]]), digest_size=8, key=_SECRET).digest()
        out[k] = np.frombuffer(digest, np.uint64)[0]
    return out


def run_hash(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each short run of values, chained like `byte_hash`."""
    out = mix(lengths.astype(np.uint64))
    for k in range(int(lengths.max(initial=0))):
        live = slice(None) if int(lengths.min()) > k else np.flatnonzero(lengths > k)
        out[live] = mix(out[live] ^ values[starts[live] + k])
    return out


def digests(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """128 bits of a cryptographic digest of each text, as two numbers."""
    view = memoryview(np.ascontiguousarray(buf))
    raw = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def word_bounds(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of a block's texts, and the offsets of the texts in words."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = table[buf]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cuts = offs[1:-1]
    cuts = cuts[cuts < len(buf)]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(buf) + 1, bool)
    stops[1:] = inside[:-1]
    stops[1:] &= ~inside[1:]
    stops[cuts] |= inside[np.maximum(cuts - 1, 0)] & (cuts > 0)
    return starts, np.flatnonzero(stops), np.searchsorted(starts, offs)


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text of a block: keyed hash, start and end byte of each, and the offsets of the texts in words."""
    if lower:
        buf = LOWER[buf]
    starts, ends, at = word_bounds(buf, offs, table)
    return word_hash(buf, starts, ends), starts, ends, at


def exact_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each range, equal for equal bytes only: by comparing bytes, not hashes.  Ranges are disjoint, in order, and hold a byte at least."""
    offs = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    edge = np.zeros(len(buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    data = np.ascontiguousarray(buf[np.cumsum(edge[:-1], dtype=np.int8).view(bool)])
    ranges = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(data)])
    return ranges.dictionary_encode().indices.to_numpy().astype(np.int64)


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` values, across all of `values` (the caller masks runs that cross a text's end)."""
    n = len(values) - width + 1
    out = np.empty(max(n, 0), np.uint64)
    for lo in range(0, max(n, 0), BLOCK_BYTES):
        at = np.arange(min(n - lo, BLOCK_BYTES))
        out[lo : lo + len(at)] = ranged_hash(values[lo : lo + len(at) + width - 1], at, at + width)
    return out


def within(offs: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which starts 0..total-width lie with their whole window in one text."""
    ok = np.zeros(max(0, total - width + 1) + 1, np.int32)
    lo, hi = offs[:-1], offs[1:] - width + 1
    keep = hi > lo
    np.add.at(ok, lo[keep], 1)
    np.add.at(ok, hi[keep], -1)
    return np.cumsum(ok[:-1]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... lengths[0] values, then the same for each next range."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
