"""Ranked lexical search over a two-level quantised index: byte impacts give bounds, and documents whose bound reaches the kth best are scored exactly.

Score of a document for an item: the sum over the item's terms, repeats included, of w * q with w = floor(1000 ln((2N + 2) / (2 df + 1))) and
q = 10^9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L. N documents have a term, L is the number of all their terms, n of one document's.

The index is cut by documents: a row holds a segment of up to 4,096 documents and some 8 MB of text, with its terms and, term after term, its postings in three flat columns: document ordinals, impacts (level one, a
byte) and quotients q (level two). An impact is q / STEP rounded up, so STEP * impact is never below q, and STEP * (impact - 1) is below it. Every term of every document is indexed.

Search takes items in blocks. The first scan reads level one only: per item and document the upper bound, and the lower bound one STEP a term below. The kth greatest lower bound of an item is a score that k documents reach, so only
documents whose upper bound reaches it can be among the first k. The second scan reads level two, only of segments that hold such documents, and scores each of them exactly, in 64-bit integers.

Scale: building is one pass without a shuffle (and one before it that counts N and L); scans are one pass each, a segment at a time. The index's files hold FILE_SEGMENTS segments each, so memory doesn't grow with a task's share of the input. Shuffled are document frequencies of the block's terms, per task at most k lower
bounds an item, and per segment at most k exact scores an item: copies by the thousand that share a score are settled within their segments, by doc_id. The driver holds a block of items (256 of them, 200,000 distinct terms;
one longer item is a block by itself), their frequencies and one bound each.

Cases: a null or empty text has no terms and is never found, nor counted in N. A null item or one without terms has no rows; fewer than k scores above 0 give fewer rows. Equal scores rank by doc_id, rows without doc_id last. Rows that repeat
a doc_id are documents of their own, and so are repeated items. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm._base import arrow, durable, flat, slices, text_or_empty
from helixmill.llm.substring_dedup import bounds

#: The contract's terms; other characters than ASCII belong to them, as do all their bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xFF]+")
K = 10
#: q is below 10 ** 6, so 255 steps hold it.
STEP = 3922
SEGMENT_DOCS, SEGMENT_BYTES = 4096, 8 << 20
#: Segments of a file; its writer and its readers hold them at once.
FILE_SEGMENTS = 2
BLOCK_ITEMS, BLOCK_TERMS = 256, 200_000
BROADCAST_ROWS = 500_000
LAST = (1 << 63) - 1

_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
_inside = np.zeros(256, bool)
for _range in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _inside[list(_range)] = True

LEVEL_ONE = ("segment", "doc_ids", "terms", "counts", "docs", "impacts")
INDEX = "segment long, doc_ids array<long>, terms array<string>, counts array<int>, docs binary, impacts binary, quotients binary"


class Index(NamedTuple):
    segments: DataFrame
    n_docs: int
    n_terms: int


def quotients(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    top = 75 * n_docs * int(size.max(initial=0))
    m = 25 + (75 * n_docs * size // n_terms if top < 1 << 63 else np.array([75 * n_docs * int(n) // n_terms for n in size], np.int64))
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _segments(n_docs: int, n_terms: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column(1))
        for i, whole in slices(at, SEGMENT_BYTES):
            for i in range(i, whole, SEGMENT_DOCS):
                j = min(whole, i + SEGMENT_DOCS)
                yield _segment(batch.column(0).slice(i, j - i), _low[data[at[i] : at[j]]], at[i : j + 1] - at[i], n_docs, n_terms)


def _segment(ids: pa.Array, part: np.ndarray, ends: np.ndarray, n_docs: int, n_terms: int) -> pa.RecordBatch:
    inside = _inside[part]
    row, start, end = bounds(inside, ends)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(part[inside].tobytes())]).dictionary_encode()
    posting, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(ids) + row, return_counts=True)
    term, doc = posting // len(ids), posting % len(ids)
    q = quotients(tf.astype(np.int64), np.bincount(row, minlength=len(ids)).astype(np.int64)[doc], n_docs, n_terms)
    name = int.from_bytes(hashlib.blake2b(part.tobytes() + repr(ids.to_pylist()).encode(), digest_size=8).digest(), "big", signed=True)
    counts = np.bincount(term, minlength=len(words.dictionary)).astype(np.int32)
    lists = [pa.array([x], kind) for x, kind in ((ids.to_pylist(), pa.list_(pa.int64())), (words.dictionary.to_pylist(), pa.list_(pa.string())), (counts, pa.list_(pa.int32())))]
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (doc.astype("<u2"), (-(-q // STEP)).astype(np.uint8), q.astype("<u4"))]
    return pa.record_batch([pa.array([name], pa.int64()), *lists, *blobs], ["segment", "doc_ids", "terms", "counts", "docs", "impacts", "quotients"])


def build_index(docs: DataFrame) -> Index:
    """Index of every term of every document, written to the shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    seen = texts.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Index(durable(arrow(texts, partial(_segments, seen["docs"], max(1, seen["terms"])), INDEX), "index", per_file=FILE_SEGMENTS), seen["docs"], seen["terms"])


class Block(NamedTuple):
    """Items of a block by number, and their terms with how often each item has them."""

    ids: list
    terms: dict[str, dict[int, int]]


def _item_blocks(items: DataFrame) -> Iterator[Block]:
    block = Block([], {})
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        found = Counter(t.decode().translate(_FOLD) for t in _TERM_BYTES.findall(row["text"].encode()))
        if block.ids and (len(block.ids) >= BLOCK_ITEMS or len(block.terms) + len(found) > BLOCK_TERMS):
            yield block
            block = Block([], {})
        for term, times in found.items():
            block.terms.setdefault(term, {})[len(block.ids)] = times
        block.ids.append(row["item_id"])
    if block.ids:
        yield block


_FOLD = {c: c + 32 for c in range(65, 91)}


class Weights(NamedTuple):
    """What tasks need of a block: its terms, and for each the items that have it and w times how often."""

    n_items: int
    terms: pa.Array
    items: list[np.ndarray]
    weights: list[np.ndarray]


def _weights(spark: SparkSession, index: Index, block: Block) -> Weights:
    wanted = spark.createDataFrame([(t,) for t in block.terms], "term string")  # BLOCK_TERMS at most, or one item's
    held = index.segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = held.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("n").alias("df")).collect()
    out = Weights(len(block.ids), pa.array([r["term"] for r in df], pa.string()), [], [])
    for r in df:
        w = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r["df"] + 1)))
        times = block.terms[r["term"]]
        out.items.append(np.array(list(times), np.int64))
        out.weights.append(w * np.array(list(times.values()), np.int64))
    return out


class _Segment:
    """Postings of the block's terms in a segment, and the bounds they give."""

    def __init__(self, by: Weights, ids: pa.Array, terms: pa.Array, counts: np.ndarray, docs: bytes, impacts: bytes):
        self.n_docs, self.none = len(ids), ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, LAST).to_numpy()
        ends = np.concatenate([[0], np.cumsum(counts)])
        self.docs = np.frombuffer(docs, "<u2").astype(np.int64)
        place = pc.index_in(by.terms, value_set=terms)
        self.found = [(t, slice(ends[p], ends[p + 1])) for t, p in enumerate(place.to_pylist()) if p is not None]
        impact = np.frombuffer(impacts, np.uint8).astype(np.int64)
        total, slack = np.zeros((by.n_items, self.n_docs), np.int64), np.zeros((by.n_items, self.n_docs), np.int64)
        for t, at in self.found:
            here = np.ix_(by.items[t], self.docs[at])
            total[here] += by.weights[t][:, None] * impact[at]
            slack[here] += by.weights[t][:, None] * (impact[at] > 0)
        self.upper, self.lower = STEP * total, STEP * (total - slack)

    def exact(self, by: Weights, wanted: np.ndarray, level_two: bytes) -> np.ndarray:
        """Scores of the wanted (item, document)s; others may be incomplete."""
        q, some = np.frombuffer(level_two, "<u4").astype(np.int64), wanted.any(0)
        score = np.zeros((by.n_items, self.n_docs), np.int64)
        for t, at in self.found:
            docs = self.docs[at]
            mine = some[docs]
            score[np.ix_(by.items[t], docs[mine])] += by.weights[t][:, None] * q[at][mine]
        return score


def _read(by: Weights, batch: pa.RecordBatch) -> Iterator[tuple[int, int, _Segment]]:
    ids, terms, counts, docs, impacts = (batch.column(k) for k in range(1, 6))
    for k, name in enumerate(batch.column(0).to_pylist()):
        yield k, name, _Segment(by, ids[k].values, terms[k].values, counts[k].values.to_numpy(), docs[k].as_py(), impacts[k].as_py())


BOUNDS = "item int, segment long, value long"


def _bounds(by: Weights, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment the greatest upper bound of each item that may count (value), and per task the k greatest lower bounds of each item (no segment)."""
    best = np.full((by.n_items, k), -1, np.int64)
    for batch in batches:
        for _, name, held in _read(by, batch):
            top = held.upper.max(1, initial=0)
            some = np.flatnonzero((top > 0) & (top >= best[:, 0]))
            yield _rows(some, np.full(len(some), name), top[some])
            lower = np.where(held.upper[some] > 0, held.lower[some], -1)
            both = np.concatenate([best[some], lower], axis=1)
            best[some] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
    item, at = np.nonzero(best >= 0)
    yield _rows(item, None, best[item, at])


def _rows(item: np.ndarray, segment: np.ndarray | None, value: np.ndarray) -> pa.RecordBatch:
    segments = pa.nulls(len(item), pa.int64()) if segment is None else pa.array(segment, pa.int64())
    return pa.record_batch([pa.array(item.astype(np.int32)), segments, pa.array(value, pa.int64())], ["item", "segment", "value"])


FOUND = "item int, doc_id long, score long"


def _rescored(by: Weights, k: int, least: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact scores of the documents whose upper bound reaches `least`; of a segment, each item's best k."""
    for batch in batches:
        level_two = batch.column(len(LEVEL_ONE))
        for at, _, held in _read(by, batch):
            wanted = held.upper >= np.maximum(least, 1)[:, None]
            score = held.exact(by, wanted, level_two[at].as_py())
            item, doc = np.nonzero(wanted & (score > 0))
            order = np.lexsort((held.none[doc], held.ids[doc], -score[item, doc], item))
            item, doc = item[order], doc[order]
            first = np.arange(len(item)) - np.searchsorted(item, item, "left") < k
            item, doc = item[first], doc[first]
            ids = pa.array(held.ids[doc], pa.int64(), mask=held.none[doc])
            yield pa.record_batch([pa.array(item.astype(np.int32)), ids, pa.array(score[item, doc], pa.int64())], ["item", "doc_id", "score"])


def _search_block(spark: SparkSession, index: Index, block: Block, k: int, broadcast_rows: int) -> DataFrame | None:
    by = _weights(spark, index, block)
    if not len(by.terms):
        return None
    bound = durable(arrow(index.segments.select(*LEVEL_ONE), partial(_bounds, by, k), BOUNDS), "bounds")
    kth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("value")))
    least = np.zeros(by.n_items, np.int64)
    for r in bound.where("segment is null").withColumn("kth", kth).where(F.col("kth") <= k).where(F.col("kth") == k).select("item", "value").collect():  # a row an item of the block
        least[r["item"]] = r["value"]
    floor = spark.createDataFrame([(i, max(1, int(v))) for i, v in enumerate(least)], "item int, least long")
    reach = durable(bound.where("segment is not null").join(F.broadcast(floor), "item").where("value >= least").select("segment").distinct(), "reach")
    some = F.broadcast(reach) if reach.count() <= broadcast_rows else reach
    found = arrow(index.segments.join(some, "segment", "left_semi").select(*LEVEL_ONE, "quotients"), partial(_rescored, by, k, least), FOUND)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    named = F.broadcast(spark.createDataFrame(list(enumerate(block.ids)), "item int, item_id long"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).join(named, "item").select("item_id", "rank", "doc_id", "score")


def search(index: Index, items: DataFrame, *, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """item_id, rank, doc_id, score of each item's first k documents."""
    spark, out = items.sparkSession, None
    for block in _item_blocks(items):
        part = _search_block(spark, index, block, k, broadcast_rows)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
