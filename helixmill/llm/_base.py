"""What the text operators share: scratch tables, white space, and flat views of Arrow text."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.shipping import ship

#: White space of the contracts: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset, in local mode only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        folder = getattr(spark, "_helixmill_scratch", None)
        if not folder:
            folder = spark._helixmill_scratch = tempfile.mkdtemp(prefix="helixmill-")
            import shutil

            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def durable(df: DataFrame, name: str, *, per_file: int = 0) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, any executor may be lost. With per_file, a file has no more rows: for rows of many MB, as Parquet's pages and Spark's column batches are cut by numbers of
    rows (100 and 4,096), not by bytes, but never go beyond a file."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixmill/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", per_file).parquet(path)
    tables().append(path)
    return spark.read.schema(df.schema).parquet(path)


_here = threading.local()


def tables() -> list[str]:
    """Paths of the tables that durable() has written in this thread and nothing has deleted."""
    if not hasattr(_here, "tables"):
        _here.tables = []
    return _here.tables


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        tables().remove(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns as a durable table; the tables it wrote on its way are deleted, as only the result is read from here on."""
    before = len(tables())
    out = durable(make(), name)
    drop(out.sparkSession, tables()[before:-1])
    return out


#: What operators keep in a worker during a task; emptied after it, since idle workers stay and their memory counts.
worker_caches: list[dict] = []


def release() -> None:
    """Empty the worker's caches and hand freed memory back to the system."""
    for cache in worker_caches:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep what they have
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow, with this package on the workers; each task gives its memory back."""
    ship(df.sparkSession)

    def run(batches):
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Words, counted as starts: a word character after white space or at the start."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow text column, and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, size: int):
    """Ranges of whole texts that hold about size bytes each, so that numpy's passes stay in cache."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))
