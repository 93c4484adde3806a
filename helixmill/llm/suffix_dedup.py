"""Removal of every byte that lies in a 200-byte string which also starts elsewhere: blockwise sorting of a cover sample's hashed spans.

Difference-cover suffix sorting chooses a sample of suffixes such that any two equal strings of the wanted length hold sampled suffixes at the same
offset, ranks the sample once, sorts one bucket of suffixes at a time, and settles suffixes that tie for long by the sample's ranks. Here the sample and the buckets
are kept and two things differ. No ranks are computed: long ties are settled by hashes of spans around the sampled suffixes (below), since only equality to a
depth of 200 bytes counts; ranks order suffixes beyond that depth, which nothing here asks for, and take sorts of the whole sample. And the cover is chosen by content, not by position
modulo v: a position is sampled if the 73-byte string there has the least hash of some 128 neighbours (of one 200-byte
string). Equal 200-byte strings have equal least strings, so the cover property holds, with 1 sample in 65 bytes where a difference
cover modulo 128 needs 1 in 11.

Level by level, starts of 200-byte strings are dealt with in spans of 128 (one per sample), then 32, 8 and 1. A span has a core, the bytes
common to all its strings, and a full, the bytes they cover together. Buckets (equal cores) are sorted by full: neighbours with equal fulls settle all their starts as
repeated; a bucket of one has no repeats; only in buckets with different fulls does one suffix per full go to the next level. Levels are thus
ties of more than 73, 169, 193 and 200 bytes. Equality of two strings is that of two independent 64-bit hashes.

Scale: a bucket is a key of a sort, so Spark spills it and never holds it in memory; copies of a passage are combined in each task's batches before they are
shuffled, and go on to the next level as one suffix. A core with many surroundings (a license line in very many files) is found in a sample of the texts, and its bucket is split by full. One row in 65 bytes is
shuffled at the first level. Texts move once, packed, to meet their spans; they move to the inner levels only if the ids that need them
outgrow the broadcast bound.

Cases: null text counts as empty. A text under 200 bytes keeps all its bytes. Repeated rows are copies, so both lose their repeated bytes. Rows without
doc_id are texts like others. Rows are told apart by hashes of doc_id and text, 64 bits and 64 more where these collide. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._base import arrow, durable, flat, mix, slices
from helixmill.llm.shingles import powers

LENGTH = 200
SPANS = (128, 32, 8, 1)
CORE = LENGTH - SPANS[0] + 1
SLICE = 1 << 19
#: One in so many texts is looked at for cores that stand in many places, and in how many spans of those a core must be seen.
HOT_ONE_IN, HOT_LEAST = 64, 32
BROADCAST_ROWS = 500_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_NOISES = tuple(np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) for s in (11, 12))


class Hashes:
    """Two independent hashes of any substring of data."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        with np.errstate(over="ignore"):
            for noise, base in zip(_NOISES, _BASES, strict=True):
                out = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(noise[data] * powers(base, len(data))[: len(data)], out=out[1:])
                self.sums.append(out)

    def get(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        with np.errstate(over="ignore"):
            return mix((s[end] - s[start]) * powers(_INVERSES[which], len(s))[start])


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each window of width, a power of two; the last width - 1 places see less."""
    out, step = x.copy(), 1
    while step < width:
        out[:-step] = pick(out[:-step], out[step:])
        step *= 2
    return out


def cover(hashes: Hashes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sampled positions: every string of LENGTH bytes within a text holds one, in the same place in equal strings."""
    n, width = int(at[-1]), SPANS[0]
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here = np.arange(n - CORE + 1)
    name = hashes.get(0, here, here + CORE)
    least = _slide(name, width, np.minimum)[: n - LENGTH + 1]
    begins = np.zeros(n + 1, np.int32)  # starts of strings that end within their text
    long = np.flatnonzero(np.diff(at) >= LENGTH)
    np.add.at(begins, at[long], 1)
    np.add.at(begins, at[long + 1] - LENGTH + 1, -1)
    least[np.cumsum(begins)[: len(least)] == 0] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = _slide(padded, width, np.maximum)[: len(name)]
    spot = np.flatnonzero((most == name) & (most > 0))
    return np.searchsorted(at, spot, "right") - 1, spot


def _emit(hashes: Hashes, start: np.ndarray, size: np.ndarray, place: np.ndarray, span: int):
    """Core and full of the spans that begin at place (may be before the text) in texts at start; the mask of spans that hold a start."""
    low, high = np.maximum(place, 0), np.minimum(place + span - 1, size - LENGTH)
    some = low <= high
    start, place, low, high = start[some], place[some], low[some], high[some]
    core = hashes.get(0, start + place + span - 1, start + place + LENGTH)
    with np.errstate(over="ignore"):
        full = mix(hashes.get(1, start + low, start + high + LENGTH) + (low - place).astype(np.uint64) * np.uint64(1024) + (high - place).astype(np.uint64))
    return core, full, some


ROW = "core long, full long, key long, place int, met boolean"


def _batch(core, full, key, place) -> pa.RecordBatch:
    """Rows of a batch, combined before the shuffle: of suffixes equal here, all are met (repeated), and only the first goes to its core's bucket;
    the others go to buckets of their own. So neither a passage with many copies nor a periodic text fills one bucket."""
    order = np.lexsort((full, core))
    new = np.ones(len(core), bool)
    new[1:] = (core[order][1:] != core[order][:-1]) | (full[order][1:] != full[order][:-1])
    met, spare = np.zeros(len(core), bool), np.zeros(len(core), bool)
    spare[order] = ~new
    met[order] = ~new | np.append(~new[1:], False)
    with np.errstate(over="ignore"):
        own = mix(key.astype(np.int64).view(np.uint64) * np.uint64(3) + mix(place.astype(np.int64).view(np.uint64)) + np.uint64(1))
        core = np.where(spare, own, core)
    return pa.record_batch([pa.array(core.view(np.int64)), pa.array(full.view(np.int64)), pa.array(key, pa.int64()), pa.array(place.astype(np.int32)), pa.array(met)], ["core", "full", "key", "place", "met"])


def _gathered(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    if parts:
        yield _batch(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy()
        data, at = flat(batch.column(1))
        parts = []
        for i, j in slices(at, SLICE):
            ends = at[i : j + 1] - at[i]
            hashes = Hashes(data[at[i] : at[j]])
            row, spot = cover(hashes, ends)
            core, full, some = _emit(hashes, ends[row], np.diff(ends)[row], spot - ends[row] - SPANS[0] + 1, SPANS[0])
            parts.append((core, full, keys[i:j][row[some]], (spot - ends[row] - SPANS[0] + 1)[some]))
        yield from _gathered(parts)


def _inner(span: int, outer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            parts = []
            for key, packed, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = np.frombuffer(unpack(packed.as_buffer()), np.uint8)
                outers = np.asarray(places.values.to_numpy(), np.int64)
                place = np.unique((outers[:, None] + np.arange(0, outer, span)[None, :]).ravel())
                core, full, some = _emit(Hashes(data), np.zeros(len(place), np.int64), np.full(len(place), len(data)), place, span)
                parts.append((core, full, np.full(int(some.sum()), key, np.int64), place[some]))
            yield from _gathered(parts)

    return run


def hot_cores(texts: DataFrame, *, one_in: int = HOT_ONE_IN, least: int = HOT_LEAST, most: int = BROADCAST_ROWS) -> DataFrame | None:
    """Cores that stand before many different surroundings, such as a license line's, seen in one of `one_in` texts: core, hot. At most `most` of them: the bound rises until they are few enough. None without any."""
    some = arrow(texts.where(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(one_in)) == 0).select("key", "text"), _samples, ROW)
    seen = durable(some.groupBy("core").agg(F.count("*").alias("n"), F.min("full").alias("lo"), F.max("full").alias("hi")).where((F.col("n") >= least) & (F.col("lo") != F.col("hi"))).select("core", "n"), "hot")
    while (n := seen.where(F.col("n") >= least).count()) > most:
        least *= 2
    return seen.where(F.col("n") >= least).select("core", F.lit(True).alias("hot")) if n else None


def _settle(rows: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Sort each bucket by full: key, place, again (all starts of the span are repeated), probe (it goes to the next level).

    A hot core's bucket is dealt by full as well: equal fulls still meet, and that its fulls differ is known. Which cores count as hot makes no difference to the result."""
    if hot is None:
        dealt = rows.withColumns({"hot": F.lit(False), "bucket": F.col("core")})
    else:
        known = F.coalesce("hot", F.lit(False))
        dealt = rows.join(F.broadcast(hot), "core", "left").withColumn("hot", known).withColumn("bucket", F.when(F.col("hot"), F.xxhash64("core", "full")).otherwise(F.col("core")))
    bucket = Window.partitionBy("bucket")
    line = bucket.orderBy("core", "full")
    whole = bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = lambda step: F.when(step("core").over(line) == F.col("core"), step("full").over(line))
    mixed = F.col("hot") | (F.min("full").over(whole) != F.max("full").over(whole))
    seen = dealt.select("*", same(F.lag).alias("before"), same(F.lead).alias("after"), mixed.alias("mixed"))
    first = F.col("before").isNull() | (F.col("before") != F.col("full"))
    again = F.col("met") | F.coalesce(F.col("before") == F.col("full"), F.lit(False)) | F.coalesce(F.col("after") == F.col("full"), F.lit(False))
    marked = seen.select("key", "place", again.alias("again"), (F.col("mixed") & first).alias("probe"))
    return marked.where("again or probe")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [pack((text or "").encode()) for text in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["key", "doc_id", "packed"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        total, removed, spans, kept = [], [], [], []
        for packed, places, sizes in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            raw = unpack(packed.as_buffer())
            data = np.frombuffer(raw, np.uint8)
            cover_at = np.zeros(len(data) + 1, np.int32)
            if places.is_valid and len(places):
                place, span = places.values.to_numpy().astype(np.int64), sizes.values.to_numpy().astype(np.int64)
                low, high = np.maximum(place, 0), np.minimum(place + span - 1, len(data) - LENGTH)
                some = low <= high
                np.add.at(cover_at, low[some], 1)
                np.add.at(cover_at, high[some] + LENGTH, -1)
            gone = np.cumsum(cover_at)[: len(data)] > 0
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            total.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(int(edge.sum()))
            kept.append(data[~gone].tobytes() if removed[-1] else raw)
        yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (total, removed, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _keyed(docs: DataFrame, key_bits: int) -> DataFrame:
    """key, doc_id, text: a key is a hash of a row's doc_id and text, and another one in rows whose key other rows than their copies have. (Of 5e10 rows some 70 pairs share a 64-bit hash.)"""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), text), 64 - key_bits).alias("key"), F.xxhash64(F.lit(1), F.col("doc_id"), text).alias("other")
    texts = docs.select(*hashes, F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    doubt = durable(texts.groupBy("key").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("key", F.lit(True).alias("shared")), "doubt")
    n = doubt.count()
    if n:
        texts = texts.join(F.broadcast(doubt) if n <= BROADCAST_ROWS else doubt, "key", "left").withColumn("key", F.when(F.col("shared"), F.col("other")).otherwise(F.col("key")))
    return texts.select("key", "doc_id", "text")


def remove_repeats(docs: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, key_bits: int = 64, hot_one_in: int = HOT_ONE_IN, hot_least: int = HOT_LEAST) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    texts = _keyed(docs, key_bits)
    levels = [durable(_settle(arrow(texts.select("key", "text"), _samples, ROW), hot_cores(texts, one_in=hot_one_in, least=hot_least)), "level")]
    for outer, span in zip(SPANS, SPANS[1:], strict=False):
        probes = levels[-1].where("probe").groupBy("key").agg(F.collect_list("place").alias("places"))
        ids = durable(probes.select("key"), "ids")
        few = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
        packed = arrow(texts.join(few, "key", "left_semi"), _pack, "key long, doc_id long, packed binary").dropDuplicates(["key"])
        levels.append(durable(_settle(arrow(packed.join(probes, "key").select("key", "packed", "places"), _inner(span, outer), ROW)), "level"))
    found = None
    for span, level in zip(SPANS, levels, strict=True):
        part = level.where("again").select("key", "place", F.lit(span).alias("span"))
        found = part if found is None else found.union(part)
    spans = found.groupBy("key").agg(F.collect_list(F.struct("place", "span")).alias("spans")).select("key", F.col("spans.place").alias("places"), F.col("spans.span").alias("sizes"))
    met = arrow(texts, _pack, "key long, doc_id long, packed binary").join(spans, "key", "left")
    return arrow(met.select("doc_id", "packed", "places", "sizes"), _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
