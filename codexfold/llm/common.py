"""Shared folder, written tables, and text chunks for the operators of this package."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 300_000


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="codexfold-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session without that setting, as in
    tests, gets a temporary one, one for the whole process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and spark.sparkContext.master.startswith("local"):
        place = _local_dir()
    if not place:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return place.rstrip("/")


def give_back() -> None:
    """Gives memory that Python has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut,
    readable by every executor, its size known to the optimizer.

    Spark drops shuffle files once the driver has collected the plan they belong to,
    which may take long on a large heap; so the driver, JVM and Python, collects after
    each write. ``compression`` is that of Parquet, the session's own if not given.
    """
    path = f"{shared_dir(df.sparkSession)}/codexfold-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    gc.collect()
    give_back()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, n_bytes: int, target: int = 32 << 20) -> int:
    """Partitions of about ``target`` bytes, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // target))


def releasing(rows: Iterator) -> Iterator:
    """``rows`` of a task; at its end a reused worker gives freed memory back to the system."""
    try:
        yield from rows
    finally:
        give_back()


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def text_chunks(
    texts: pa.Array, limit: int = CHUNK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi`` of a string or binary array, their bytes and offsets.

    A chunk holds whole texts of about ``limit`` bytes together, one text where
    that text alone is longer; null counts as empty.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, off_buf, data = texts.buffers()
    offsets = np.frombuffer(off_buf, np.int64, n + 1 + texts.offset)[texts.offset :]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal ``keys`` out of the batches of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            name = tuple(c[lo] for c in columns)
            if name != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = name
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)
