"""Shared pieces: tables in the shared folder, Arrow text buffers, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a kernel works on at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: Rows of one Arrow batch between the JVM and Python.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, a session on one machine gets a folder of that machine; a cluster must name one."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/toneforge-checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/toneforge/{tag}-{uuid.uuid4().hex}"


def spool(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it again: what follows starts from the files, so neither a lost executor nor a second use computes df anew."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a job go when it ends, not when the driver happens to collect its garbage. For jobs whose DataFrames run once, such as those that spool writes."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: str | None = None) -> None:
    """Bounds the Arrow batches, for tables with long texts. The setting is of the session; all operators set the same one. size: bytes after which a batch ends too, for tables whose rows are blocks: the JVM and Python hold a batch each."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as remainder 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and its row offsets. A null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a block's texts hold about limit bytes, or are one row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, min(end, n) - at)
            at = min(end, n)


def merged(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in blocks whose texts hold about limit bytes, over the batches' own ends; a longer text is a block of its own."""
    parts: list[pa.RecordBatch] = []
    held = 0
    for b in blocks(batches, text, limit):
        size = int(text_bytes(col(b, text))[1][-1])
        if parts and held + size > limit:
            yield pa.concat_batches(parts)
            parts, held = [], 0
        parts.append(b)
        held += size
    if parts:
        yield pa.concat_batches(parts)


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


#: Bytes 0x20 and 0x09 to 0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def through(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes and a table of bytes or booleans, without the indices of 64 bits that numpy makes for it."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and for each row the number of words before it (rows + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~through(data, SPACE)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    edge = off[(off > 0) & (off < n)]
    first = solid & ~before
    first[edge] = solid[edge]
    starts = np.flatnonzero(first)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    last = solid & ~after
    last[edge - 1] = solid[edge - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def strings_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges (in order, without overlap) as an Arrow array."""
    if not len(starts):
        return pa.array([], pa.binary())
    mark = np.zeros(len(data) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    packed = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    off = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=off[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(packed)])


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct values, in order of first appearance."""
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False), d.dictionary


def expand(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[first[i]:first[i] + sizes[i]] for all i, end to end."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(sizes)
    at = np.repeat(first - (ends - sizes), sizes)
    at += np.arange(total)
    return flat[at]
