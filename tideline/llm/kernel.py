"""Shared pieces of the text operators: Arrow buffers as numpy arrays, word bounds and hashes, blobs, materialised tables.

Python workers get whole Arrow batches (Spark bounds them by rows and by bytes) and treat them as one byte array with
offsets, so that the cost of a word is that of a few numpy instructions and not of a Python object.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are compared: larger than any other.
NO_ID = 2**63 - 1
#: Bytes of text that a worker treats at once.
BLOCK_BYTES = 6 << 20

U64 = np.uint64
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)

# ---------------------------------------------------------------- Spark side


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes of df: of files, without reading them. Where it has none it counts text."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 50 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


#: Where the tables of written() lie, as long as their frames are held.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a temporary one if the master is this machine alone (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends if not before."""
    path = f"{shared_dir(spark)}/tideline/{tag}-{uuid.uuid4().hex}"
    where, files = _place(spark, path)
    files.deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later frame reads."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            where, files = _place(t.sparkSession, path)
            files.delete(where, True)


#: Rows of two integers that are broadcast at most: about 40 MB as a hash table.
FEW = 500_000


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, broadcast if it has few rows, as counted."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= FEW else df


def free(docs: DataFrame, name: str) -> str:
    """name, or one like it that docs does not use."""
    used = {c.lower() for c in docs.columns}
    while name in used:
        name += "_"
    return name


def matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined (left_semi or left_anti) with a table of written() of (id, crc). Texts are shuffled only if that is too large to broadcast."""
    i, c = free(docs, "_id"), free(docs, "_crc")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col(i)) & (F.crc32(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(c))
    return docs.join(few(keys.select(F.col("id").alias(i), F.col("crc").alias(c))), same, how)


def whole_row(docs: DataFrame):
    """All columns of docs as one struct, which no name of the operators' own can clash with."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Columns id (doc_id, null: NO_ID), crc (of the text's UTF-8), text (null: empty) and more.

    (id, crc) names a row in what the operators shuffle: rows that repeat both have equal texts, hence equal results."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.crc32(text).alias("crc"), text.alias("text"), *more)


def real_id(name: str = "id"):
    """id as the doc_id that it stands for."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias("doc_id")


# ---------------------------------------------------------------- Arrow buffers


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values and their n + 1 offsets. Null: empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    if arr.null_count:
        arr = pc.fill_null(arr, b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[o[0] : o[-1]], o - o[0]


def ints(arr) -> np.ndarray:
    """A column without nulls as numpy."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return arr.to_numpy(zero_copy_only=False)


def slices(batch, column: str, most: int = BLOCK_BYTES):
    """Row slices of batch whose column has about most bytes each; a longer value stands alone."""
    i = batch.schema.get_field_index(column)
    _, off = text_buffer(batch.column(i))
    at, n = 0, len(batch)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


# ---------------------------------------------------------------- words

#: The white space that separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = ~SPACE


def word_bounds(buf: np.ndarray, off: np.ndarray, member: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all maximal runs of member bytes, and by document the offsets into them. No run crosses documents."""
    on = member[buf]
    n = len(buf)
    start, end = on.copy(), on.copy()
    if n:
        start[1:] &= ~on[:-1]
        end[:-1] &= ~on[1:]
        edge = off[(off > 0) & (off < n)]
        start[edge] |= on[edge]
        end[edge - 1] |= on[edge - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0x9E3779B97F4A7C15)
    return h ^ (h >> U64(32))


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings buf[starts:ends], eight bytes a step."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h = mix(size.astype(U64) + U64(0x51ED270B9F652295))
    live, k = np.arange(len(starts)), 0
    while len(live):
        rest = np.minimum(size[live] - k, 8)
        h[live] = mix(h[live] ^ (eight[starts[live] + k] & _MASKS[rest]) * U64(0xC2B2AE3D27D4EB4F) + U64(k + 1))
        k += 8
        live = live[size[live] > k]
    return h


def chained(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the sequences of n successive values that start at each place but the last n - 1."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, 0x2545F4914F6CDD1D, U64)
    for j in range(n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[j : j + m])
    return out


# ---------------------------------------------------------------- blobs


def pack(a: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that the shuffle's codec finds the zeros."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""


def unpack(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def crc(texts) -> np.ndarray:
    return np.fromiter((zlib.crc32(t) for t in texts), np.int64)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


#: The primes of the public XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xx64(value: np.ndarray, seed) -> np.ndarray:
    """XXH64 of 8-byte integers: what Spark's xxhash64 makes of a bigint."""
    h = np.asarray(seed, U64) + _P5 + U64(8)
    h = h ^ (_rotl(value.astype(np.int64).view(U64) * _P2, 31) * _P1)
    h = _rotl(h, 27) * _P1 + _P4
    h = (h ^ (h >> U64(33))) * _P2
    h = (h ^ (h >> U64(29))) * _P3
    return h ^ (h >> U64(32))


def row_bucket(ids: np.ndarray, crcs: np.ndarray, n: int) -> np.ndarray:
    """pmod(xxhash64(id, crc), n) as Spark computes it."""
    with np.errstate(over="ignore"):
        return np.mod(xx64(crcs, xx64(ids, np.array([42], U64))).view(np.int64), n)
