"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping.

SuperMinHash: each shingle walks a pseudo-random permutation of the m registers (Fisher-Yates, drawn lazily); at its j-th step it offers j + r, r in
[0, 1), to the register it reaches. All shingles of all texts of a batch take a step together, and a text stops once each of its registers
is below the next step's number: long texts stop after one to three steps.

The least similarity is an argument, and `banding` derives the rest from it: bands and rows that make two texts of that similarity meet with a chance of
1 - 1.8e-6 or more (28 bands of 6 for 0.85, 34 of 5 for 0.80). Texts with equal shingle sets are one
class, and only class representatives go on. In each bucket all members are compared with its least member (a star, never all pairs): first
by signature (a pair that reaches the similarity has a chance below 1e-7 to agree in fewer registers than asked), then exactly. Where a bucket's members end up in several
components, those outside its least member's component are compared with all members, in blocks of chunks, by signature and then exactly, and only
links that join components leave a block: so no link between members of a bucket that matters is lost, whatever the bucket's size. A bucket whose members all
link with its least costs nothing more; one whose members mostly don't costs comparisons in the square of those. Its rows go to one block per chunk of
`chunk_bytes` of signatures and sets, so up to that size each is sent once, whichever side it stands on; beyond it a row is sent as often as there are chunks.

Equality of shingles is that of their 54-bit hashes: two texts of 300 shingles each count a shared one too many with a chance of some 5e-12.

Scale: texts are read twice and never shuffled unless the candidates outgrow the broadcast bound; shuffled are band values (16 bytes each), signatures of documents
that share a bucket, and shingle sets of pairs that pass the signature test; all signatures are shuffled only if the copies or the candidates outgrow that bound, or if a doc_id repeats.
Tables are deleted once nothing reads them. A document of very many pairs, and a bucket of very many members, are met in parts (`part_rows`), so no task meets them whole.
Nothing is collected; components settle by star contraction of links.

Cases: null or blank text has an empty set and links with nothing; fewer than five words are one shingle. Rows without doc_id link with nothing
(component_id null, kept). Rows repeating a doc_id are copies of one document. Ties don't occur: ids decide. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._base import arrow, drop, durable, mix, settled, tables
from helixmill.llm.components import UnionFind, components, pairs_array
from helixmill.llm.shingles import sets_of

#: op4's contract.
PERCENT = 85
#: Chances that a pair of just the least similarity shares no band, and that its signatures agree too rarely to be verified.
MISSED, UNVERIFIED = 1.8e-6, 1e-7
MOST_REGISTERS = 176
BROADCAST_ROWS = 500_000
#: Pairs of one document that meet its signature or set under one key.
PART_ROWS = 256
#: Signatures and sets of a chunk; a document of an eighth of it or more is a chunk of its own.
CHUNK_BYTES = 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Banding(NamedTuple):
    percent: int
    bands: int
    rows: int
    #: Pairs that agree in fewer registers are not verified.
    least: int


def banding(percent: int) -> Banding:
    """The most selective bands (most rows) within MOST_REGISTERS that miss a pair of this similarity with a chance of MISSED at most."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    s = min(percent, 99) / 100
    needed = {rows: math.ceil(math.log(MISSED) / math.log1p(-(s**rows))) for rows in range(1, 17)}
    rows = max((r for r, n in needed.items() if r * n <= MOST_REGISTERS), default=1)
    m, below, least = needed[rows] * rows, 0.0, 0
    while (below := below + math.comb(m, least) * s**least * (1 - s) ** (m - least)) < UNVERIFIED:
        least += 1
    return Banding(percent, needed[rows], rows, least)


def super_minhash(row: np.ndarray, shingle: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m registers of the sets (row, shingle); a register's high half is the step, its low half the draw."""
    registers = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    went, held = [], []  # per step: the place swapped with, and what stood at the step's own place
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(row):
                break
            draw = mix(shingle + np.uint64(j + 1) * _STEP)
            place = (np.uint64(j) + (draw & np.uint64(0xFFFFFFFF)) % np.uint64(m - j)).astype(np.int16)
            there, here = place.copy(), np.full(len(row), j, np.int16)
            for k, v in zip(went, held, strict=True):
                hit = k == place
                there[hit] = v[hit]
                hit = k == j
                here[hit] = v[hit]
            np.minimum.at(registers, row * m + there, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
            went.append(place)
            held.append(here)
            open_rows = registers.reshape(n, m).max(1) >= (np.uint64(j + 1) << np.uint64(32))
            if not open_rows.all():
                stay = open_rows[row]
                row, shingle = row[stay], shingle[stay]
                went, held = [x[stay] for x in went], [x[stay] for x in held]
    return registers.reshape(n, m)


SIGNS = "doc_id long, n_shingles long, key1 long, key2 long, bands array<long>, sign binary"


def _signs(by: Banding, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = by.bands * by.rows
    for batch in batches:
        for i, j, row, shingle in sets_of(batch.column(1)):
            n = j - i
            size = np.bincount(row, minlength=n)
            full = np.flatnonzero(size)
            starts = np.concatenate([[0], np.cumsum(size[full])[:-1]]).astype(np.int64)
            keys = np.zeros((2, n), np.uint64)
            if len(full):
                keys[0, full] = np.add.reduceat(mix(shingle), starts)
                keys[1, full] = np.bitwise_xor.reduceat(mix(shingle ^ _STEP), starts)
            registers = super_minhash(row, shingle, n, m)
            with np.errstate(over="ignore"):
                band = np.arange(1, by.bands + 1, dtype=np.uint64)[None, :].repeat(n, 0)
                for r in range(by.rows):
                    band = mix(band * _STEP + registers[:, r :: by.rows])
            short = (mix(registers) >> np.uint64(48)).astype("<u2")
            some = size > 0
            lists = [band[k].view(np.int64) if some[k] else [] for k in range(n)]
            signs = [short[k].tobytes() if some[k] else b"" for k in range(n)]
            columns = [batch.column(0).slice(i, n), pa.array(size, pa.int64()), *(pa.array(k.view(np.int64)) for k in keys), pa.array(lists, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "n_shingles", "key1", "key2", "bands", "sign"])


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, row, shingle in sets_of(batch.column(1)):
            at = np.searchsorted(row, np.arange(j - i + 1))
            sets = [np.sort(shingle[at[k] : at[k + 1]]).tobytes() for k in range(j - i)]
            yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], ["doc_id", "shingles"])


def _alike(by: Banding, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sign_a, sign_b) whose signatures agree often enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(batch.num_rows, -1) for k in (2, 3))
        keep = (a == b).sum(1) >= by.least
        yield batch.select([0, 1]).filter(pa.array(keep))


def _link(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(by: Banding, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, shingles_a, shingles_b) with 100 * intersection >= percent * union."""
    for batch in batches:
        pairs = zip(batch.column(2), batch.column(3), strict=True)
        keep = [_link(by.percent, *(np.frombuffer(v.as_buffer(), "<u8") for v in pair)) for pair in pairs]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


BLOCK = ("bucket", "l", "r", "is_left", "apart", "band", "doc_id", "component_id", "bands", "sign", "shingles")


def _blocks(by: Banding, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (BLOCK) in order of bucket, l and r: of each block, members to the right against those to the left, in links that join components, as few as do."""
    block = None
    for batch in batches:
        plain = [batch.column(k).to_pylist() for k in range(8)]
        bands = batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, by.bands)
        for k, (bucket, l, r, is_left, apart, band, doc, component) in enumerate(zip(*plain, strict=True)):  # noqa: E741
            if block is None or block.key != (bucket, l, r):
                if block is not None:
                    yield from block.links()
                block = _Block(by, (bucket, l, r), band)
            sign, shingles = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in ((9, "<u2"), (10, "<u8")))
            row = (doc, component, apart, bands[k].copy(), sign, shingles)
            if is_left:
                block.sides[True].append(row)
            if apart and (l == r or not is_left):  # a chunk that meets itself is sent once
                block.sides[False].append(row)
    if block is not None:
        yield from block.links()


class _Block:
    def __init__(self, by: Banding, key: tuple[int, int, int], band: int):
        self.by, self.key, self.band, self.sides = by, key, band, {True: [], False: []}

    def links(self) -> Iterator[pa.RecordBatch]:
        """A pair is looked at in the first band it shares only, in one of the two blocks that hold it if both are apart, and not again once other links have joined it."""
        left, right = self.sides[True], self.sides[False]
        if not left or not right:
            return
        by, joined, a, b = self.by, UnionFind(), [], []
        ids, apart, bands, signs = (np.array([x[k] for x in left]) for k in (0, 2, 3, 4))
        for doc, component, _, mine, sign, shingles in right:
            near = ((signs == sign).sum(1) >= by.least) & ((bands == mine).argmax(1) == self.band) & (ids != doc) & ~(apart & (ids > doc))
            for i in np.flatnonzero(near):
                other = left[i]
                if joined.root(component) != joined.root(other[1]) and _link(by.percent, shingles, other[5]):
                    joined.join(component, other[1])
                    a.append(min(doc, other[0]))
                    b.append(max(doc, other[0]))
        if a:
            yield pairs_array(a, b)


def _many(pairs: DataFrame, name: str, part_rows: int) -> DataFrame:
    """The values of pairs[name] with more than part_rows pairs, and the parts to meet them in: at most 1 / part_rows as many as pairs."""
    return durable(pairs.groupBy(name).count().where(F.col("count") > part_rows).select(name, F.ceil(F.col("count") / part_rows).cast("int").alias("parts")), "many")


def _fetch(pairs: DataFrame, table: DataFrame, name: str, other: str, many: DataFrame, broadcast_rows: int) -> DataFrame:
    """pairs with what table has for pairs[name]. A value of very many pairs is met in parts: its row of the table is repeated once per part, and `other` deals
    the pairs to the parts. Beyond the broadcast bound Spark's own skew join is left to split them."""
    n = many.count()
    if not 0 < n <= broadcast_rows:
        return pairs.join(table, name)
    parts = F.coalesce("parts", F.lit(1))
    dealt = pairs.join(F.broadcast(many), name, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
    spread = table.join(F.broadcast(many), name, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(spread, [name, "part"]).drop("part")


def _few(ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """These doc_ids, marked for broadcast if they are few enough."""
    ids = durable(ids, "ids")
    return F.broadcast(ids) if ids.count() <= broadcast_rows else ids


def _sets(ids: DataFrame, docs: DataFrame, unique: bool) -> DataFrame:
    """doc_id, shingles of these documents; unique: no doc_id repeats."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id", "left_semi")
    sets = arrow(texts, _blobs, "doc_id long, shingles binary")
    return durable(sets if unique else sets.dropDuplicates(["doc_id"]), "sets")


def _side(table: DataFrame, column: str, name: str) -> DataFrame:
    return table.select(F.col("doc_id").alias(name), F.col(column).alias(f"{column}_{name}"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _likely(pairs: DataFrame, heads: DataFrame, by: Banding, broadcast_rows: int, part_rows: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough; heads are met once, to get the signatures of these pairs' documents."""
    signs = durable(heads.select("doc_id", "sign").join(_few(_ends(pairs), broadcast_rows), "doc_id", "left_semi"), "seen")
    met = _fetch(pairs.join(_side(signs, "sign", "b"), "b"), _side(signs, "sign", "a"), "a", "b", _many(pairs, "a", part_rows), broadcast_rows)
    return arrow(met.select("a", "b", "sign_a", "sign_b"), partial(_alike, by), "a long, b long")


def _verify(pairs: DataFrame, docs: DataFrame, unique: bool, by: Banding, broadcast_rows: int, part_rows: int) -> DataFrame:
    """The pairs (a, b) that link by their full sets; a is the end that may have very many pairs, so its set comes last and isn't sent with each."""
    sets = _sets(_few(_ends(pairs), broadcast_rows), docs, unique)
    met = _fetch(pairs.join(_side(sets, "shingles", "b"), "b"), _side(sets, "shingles", "a"), "a", "b", _many(pairs, "a", part_rows), broadcast_rows)
    return arrow(met.select("a", "b", "shingles_a", "shingles_b"), partial(_linked, by), "a long, b long")


def _in_buckets(in_bands: DataFrame, broadcast_rows: int, part_rows: int) -> DataFrame:
    """doc_id, band, bucket, least, n of all members of buckets of two or more."""
    buckets = durable(in_bands.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "buckets")
    if buckets.count() <= broadcast_rows:
        return in_bands.join(F.broadcast(buckets), "bucket")
    large = durable(buckets.where(F.col("n") > part_rows), "large")
    if not 0 < large.count() <= broadcast_rows:
        return in_bands.join(buckets, "bucket")
    small = in_bands.join(F.broadcast(large.select("bucket")), "bucket", "left_anti").join(buckets.where(F.col("n") <= part_rows), "bucket")
    return small.unionByName(in_bands.join(F.broadcast(large), "bucket"))


def _apart(members: DataFrame, found: DataFrame, heads: DataFrame, docs: DataFrame, unique: bool, by: Banding, broadcast_rows: int, chunk_bytes: int) -> DataFrame | None:
    """Links between members of buckets of three or more that aren't one component yet; None if all are."""
    labelled = members.where("n > 2").join(found, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    split = labelled.groupBy("bucket").agg(F.max(F.when(F.col("doc_id") == F.col("least"), F.col("component_id"))).alias("main"), F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo <> hi")
    split = durable(split.select("bucket", "main"), "split")
    n = split.count()
    if not n:
        return None
    few = (lambda x: F.broadcast(x)) if n <= broadcast_rows else (lambda x: x)
    rest = durable(labelled.join(few(split), "bucket").select("bucket", "band", "doc_id", "component_id", (F.col("component_id") != F.col("main")).alias("apart")), "rest")
    ids = _few(rest.select("doc_id").distinct(), broadcast_rows)
    sets = _sets(ids, docs, unique)
    sized = rest.join(sets.select("doc_id", (F.octet_length("shingles") + (2 * by.rows + 8) * by.bands).alias("bytes")), "doc_id")
    sizes = durable(sized.groupBy("bucket").agg(F.ceil(F.sum("bytes") / chunk_bytes).alias("chunks")), "sizes")
    # chunk numbers below 0 are documents that are a chunk of their own
    chunk = F.when(F.col("bytes") * 8 >= chunk_bytes, -1 - F.shiftrightunsigned(F.xxhash64("doc_id"), 2)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("chunks")))
    rows = durable(sized.join(few(sizes), "bucket").withColumn("chunk", chunk).drop("chunks", "bytes"), "rows")
    chunks = durable(rows.groupBy("bucket", "chunk").agg(F.bool_or("apart").alias("apart")), "chunks")
    blocks = durable(chunks.select("bucket", F.col("chunk").alias("l")).join(chunks.where("apart").select("bucket", F.col("chunk").alias("r")), "bucket"), "blocks")
    some = F.broadcast(blocks) if blocks.count() <= broadcast_rows else blocks
    part = lambda blocks, side: rows.join(blocks, (rows.bucket == blocks.bucket) & (rows.chunk == blocks[side])).drop(rows.bucket)
    both = part(some, "l").withColumn("is_left", F.lit(True)).unionByName(part(some.where("l <> r"), "r").where("apart").withColumn("is_left", F.lit(False)))
    whole = both.join(heads.join(ids, "doc_id", "left_semi").join(sets, "doc_id"), "doc_id")
    in_order = whole.repartition("bucket", "l", "r").sortWithinPartitions("bucket", "l", "r").select(*BLOCK)
    return arrow(in_order, partial(_blocks, by), "a long, b long")


def _heads(signs: DataFrame, full: DataFrame, classes: DataFrame, broadcast_rows: int) -> tuple[DataFrame, bool]:
    """doc_id, bands, sign of each class's representative, and whether no doc_id repeats. If none does and the others are few, these are left out as signs is read; else
    the representatives are a table of their own."""
    reps = classes.select(F.col("rep").alias("doc_id"))
    others = durable(full.select("doc_id").join(reps, "doc_id", "left_anti").distinct(), "others")
    unique = not signs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if unique and others.count() <= broadcast_rows:
        return full.select("doc_id", "bands", "sign").join(F.broadcast(others), "doc_id", "left_anti"), unique
    return durable(full.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "bands", "sign"), "heads"), unique


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS, part_rows: int = PART_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Documents of Jaccard similarity percent / 100 or more are linked."""
    by = banding(percent)
    signs = durable(arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), partial(_signs, by), SIGNS), "signs")
    full = signs.where("n_shingles > 0 and doc_id is not null")
    classes = durable(full.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    heads, unique = _heads(signs, full, classes, broadcast_rows)
    members = settled(lambda: _in_buckets(heads.select("doc_id", F.posexplode("bands").alias("band", "bucket")), broadcast_rows, part_rows), "members")

    stars = durable(members.where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    likely = settled(lambda: _likely(stars, heads, by, broadcast_rows, part_rows), "likely")
    links = settled(lambda: _verify(likely, docs, unique, by, broadcast_rows, part_rows), "verified")
    found = components(links)
    before = len(tables())
    more = _apart(members, found, heads, docs, unique, by, broadcast_rows, chunk_bytes)
    inside, more = tables()[before:], more if more is None else durable(more, "more")
    drop(docs.sparkSession, inside)
    if more is not None and more.limit(1).count():
        found = components(links.union(more))

    reps = classes.join(found.withColumnRenamed("doc_id", "rep"), "rep", "left").select("key1", "key2", F.col("n_shingles").alias("n"), F.coalesce("component_id", "rep").alias("component"))
    met = signs.join(reps, (signs.key1 == reps.key1) & (signs.key2 == reps.key2) & (F.col("n_shingles") == F.col("n")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component", "doc_id")
    return met.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
