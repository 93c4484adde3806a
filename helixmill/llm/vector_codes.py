"""Vector code compression: product quantisation whose codebooks come from an RDD treeAggregate over columnar NumPy blocks of parts.

A component x becomes the integer floor(4096 x). A vector is cut into 8 equal consecutive parts; each part position has a codebook of 16 entries, which starts as that part of the 16 vectors of
least vec_id. Each of 6 rounds assigns every part to the nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the floor of its parts' mean; entries without parts
stay. A last assignment gives codes and errors.

Vectors are first written as blocks: up to `BLOCK_ROWS` vectors as one row, their integers stored by component (columnar), so that distances accumulate component by component over contiguous
arrays. A round is one `treeAggregate` over the blocks: each task adds its parts to int64 tensors of sums and counts (np.add.at), which merge through a reduction tree, so the driver gets one pair of tensors
of the codebooks' size, whatever the number of vectors. All arithmetic is in integers: results depend on neither partitions nor order, and a lost executor's blocks are read again from the shared folder.

Scale: a task holds one block at a time. Nothing is shuffled but the tensors and, for label_error, one partial sum per task and label. Labels' sums are joined by broadcast after a count, else by a shuffle.

Cases: a null vector, or one with null or non-finite components, is left out. So is a vector of another length than that of the least vec_id among the others, which can't be cut like them (empty ones
too). A length that 8 doesn't divide is an error. Components from +-2 ** 27 on (after the factor 4096) are an error, since their squared distances could outgrow 64 bits. Repeated vec_ids are
vectors of their own; ties for the first 16 go to the lesser vector, a null vec_id comes last. Fewer than 16 vectors give as many entries. An empty table gives no rows. Labels that are null sum up together. Only vec_id,
embedding and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._base import arrow, durable
from helixmill.shipping import ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK_ROWS = 4096
#: Numbers of a block at most, so that long vectors make blocks of fewer rows.
BLOCK_NUMBERS = 1 << 20
LARGEST = 1 << 27
BROADCAST_ROWS = 100_000
TREE_DEPTH = 2

BLOCK = "ids array<long>, labels array<int>, parts binary"
CODED = "vec_id long, label int, code string, error long"


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v, label of vectors all of whose components are finite numbers."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.col("label").cast("int").alias("label")).where(F.col("v").isNotNull() & ~bad)


def integers(rows: np.ndarray) -> np.ndarray:
    out = np.floor(rows * SCALE)
    if out.size and max(-out.min(), out.max()) >= LARGEST:
        raise ValueError(f"a component is {LARGEST} or more after the factor {SCALE}; its distances could outgrow 64 bits")
    return out.astype(np.int64)


def _blocks(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // size))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            some = batch.slice(i, step)
            whole = integers(some.column(1).flatten().to_numpy().reshape(some.num_rows, size))
            columns = np.ascontiguousarray(whole.T.astype("<i4"))
            yield pa.record_batch([pa.array([some.column(k).to_pylist()], pa.list_(kind)) for k, kind in ((0, pa.int64()), (2, pa.int32()))] + [pa.array([columns.tobytes()], pa.binary())], ["ids", "labels", "parts"])


def nearest(parts: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """parts: 8 x components x vectors; codebooks: 8 x entries x components. Index and squared distance of each part's nearest entry, 8 x vectors."""
    n = parts.shape[2]
    best, least = np.zeros((PARTS, n), np.int64), np.empty((PARTS, n), np.int64)
    for p in range(PARTS):
        for e in range(codebooks.shape[1]):
            far = np.zeros(n, np.int64)
            for component, at in zip(parts[p], codebooks[p, e], strict=True):
                gap = component - at
                far += gap * gap
            if e == 0:
                least[p] = far
            else:
                closer = far < least[p]  # strictly: ties stay with the lower index
                least[p][closer] = far[closer]
                best[p][closer] = e
    return best, least


def _shaped(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").astype(np.int64).reshape(PARTS, size // PARTS, -1)


def _add(codebooks: np.ndarray, total: tuple[np.ndarray, np.ndarray], raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    sums, counts = total
    parts = _shaped(bytes(raw), codebooks.shape[2] * PARTS)
    best, _ = nearest(parts, codebooks)
    for p in range(PARTS):
        np.add.at(sums[p], best[p], parts[p].T)
        np.add.at(counts[p], best[p], 1)
    return sums, counts


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return a[0] + b[0], a[1] + b[1]


def _coded(codebooks: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, labels, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
            best, least = nearest(_shaped(raw.as_py(), codebooks.shape[2] * PARTS), codebooks)
            codes = [bytes(code).hex() for code in best.T.astype(np.uint8)]
            yield pa.record_batch([ids.values, labels.values, pa.array(codes, pa.string()), pa.array(least.sum(0), pa.int64())], ["vec_id", "label", "code", "error"])


def train(blocks: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds over the blocks, one treeAggregate each."""
    ship(blocks.sparkSession)
    parts = blocks.select("parts").rdd.map(lambda row: row[0])
    for _ in range(rounds):
        zero = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        sums, counts = parts.treeAggregate(zero, partial(_add, codebooks), _merge, TREE_DEPTH)
        used = counts > 0
        codebooks = codebooks.copy()
        codebooks[used] = sums[used] // counts[used][:, None]
    return codebooks


def first_codebooks(usable: DataFrame) -> np.ndarray | None:
    """The parts of the vectors of the least vec_ids, 8 x entries x components; None without any vector."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = usable.orderBy(*order).limit(1).first()
    if first is None:
        return None
    size = len(first["v"])
    if not size or size % PARTS:
        raise ValueError(f"vectors of {size} components can't be cut into {PARTS} equal parts")
    rows = usable.where(F.size("v") == size).orderBy(*order).limit(ENTRIES).select("v").collect()  # 16 rows at most
    return integers(np.array([r["v"] for r in rows])).reshape(len(rows), PARTS, -1).transpose(1, 0, 2)


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error (error summed over the label), codebooks_sha256."""
    usable = _usable(vectors)
    codebooks = first_codebooks(usable)
    if codebooks is None:
        return usable.selectExpr("vec_id", "'' code", "0L error", "0L label_error", "'' codebooks_sha256")
    size = PARTS * codebooks.shape[2]
    blocks = durable(arrow(usable.where(F.size("v") == size).select("vec_id", "v", "label"), partial(_blocks, size), BLOCK), "blocks")
    codebooks = train(blocks, codebooks)
    coded = durable(arrow(blocks, partial(_coded, codebooks), CODED), "codes")
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "labels")
    met = coded.join(F.broadcast(sums) if sums.count() <= broadcast_rows else sums, F.col("label").eqNullSafe(F.col("of_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
