"""Removal of every word that lies in a window of 50 words which also starts in an earlier document: Rabin-Karp hashes of the windows, counted in Spark.

Every window of `WIDTH` words is hashed by the Rabin-Karp recurrence, twice and independently. A window's count is settled in two steps, both exact:

1. A window's anchor is the least Rabin-Karp hash of the 19-word windows inside it. Equal windows have equal anchors, so a window whose anchor stands in one document only
   stands in one document only. Neighbouring windows share their anchor: one row in some 16 words is shuffled and counted instead of one a word.
2. Windows with an anchor of several documents are counted by their own two hashes, 128 bits together; of equal windows, those of the least doc_id stay, all others are removed.

Removed windows that touch or overlap merge into maximal intervals of words, which are cut from the texts.

Counting all windows at once instead takes the first shuffle alone to 2.9 times the input (two 64-bit numbers for each word of the corpus, which don't compress), which leaves too little room for what
comes after it; the README has the figures.

Scale: each task combines equal keys of a batch before the shuffle: the batch's documents that share a key know it at once, and only one row goes to the key's group, so a passage of a third of
all documents makes as many rows as there are batches. A text that repeats a window sends it once. Groups are streamed by a sort, never held. Texts are shuffled, packed, only if they hold a repeated anchor; documents without any are cut from where they lie.

Cases: null text has no words. Texts under 50 words lose nothing. Rows with the same doc_id take nothing from one another. Rows without doc_id come after all others and take nothing from one another.
Repeats inside one document stay, unless an earlier document has them too. Rows are told apart by hashes of doc_id and text, 64 bits and 64 more where these collide.
Only doc_id and text are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._base import arrow, durable, flat, mix
from helixmill.llm.shingles import powers, prefix_hashes, ranges, span
from helixmill.llm.suffix_dedup import _keyed, _pack, _slide

WIDTH = 50
#: Positions of an anchor within a window, a power of two; the anchor's own width follows.
PLACES = 32
ANCHOR = WIDTH - PLACES + 1
BROADCAST_ROWS = 500_000
#: doc_id of rows without one: after all others.
LAST = (1 << 63) - 1

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_NOISES = tuple(np.random.default_rng(s).integers(1, 2**63, 256, dtype=np.uint64) for s in (21, 22))
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(part: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each word of the texts that end at `ends` (which begins with 0)."""
    return bounds(~_space[part], ends)


def bounds(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each run of bytes inside, where runs end with their text."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = ends[(ends > 0) & (ends < len(inside))]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    start = np.flatnonzero(first)
    return np.searchsorted(ends, start, "right") - 1, start, np.flatnonzero(last) + 1


def word_hashes(part: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    base = _BASES[which]
    return span(prefix_hashes(part, _NOISES[which], base), start, end, pow(base, -1, 1 << 64))


def rabin_karp(word: np.ndarray, width: int, which: int) -> np.ndarray:
    """The hash of each window of words: a polynomial in the base, taken from running sums."""
    n = len(word) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    base = _BASES[which]
    sums = np.zeros(len(word) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(word * powers(base, len(word))[: len(word)], out=sums[1:])
        return np.maximum(mix((sums[width:] - sums[:-width]) * powers(pow(base, -1, 1 << 64), n)[:n]), np.uint64(1))


def anchors(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each 19-word window, and each 50-word window's anchor: the least of the 32 in it."""
    names = rabin_karp(word, ANCHOR, 0)
    return names, _slide(names, PLACES, np.minimum)[: max(0, len(word) - WIDTH + 1)]


ANCHORS = "name long, key long, doc long, met boolean"


def _first_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of the columns (the first one leads), and where a new row of values begins."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order, new


def _own(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A group of its own for rows that are settled already."""
    with np.errstate(over="ignore"):
        return mix(key.astype(np.int64).view(np.uint64) * np.uint64(3) + mix(place.astype(np.int64).view(np.uint64)) + np.uint64(1))


def _anchor_rows(name, key, doc) -> pa.RecordBatch:
    """One row per name and text. Names of several documents here are met: a copy of the row of the least document goes to the name's group without a key, as a witness for other batches."""
    order, new = _first_of(name, doc, key)
    name, key, doc = (x[order][new] for x in (name, key, doc))
    head = np.ones(len(name), bool)
    head[1:] = name[1:] != name[:-1]
    group = np.cumsum(head) - 1
    begins = np.flatnonzero(head)
    finish = np.append(begins[1:], len(name)) - 1
    met = (doc[begins] != doc[finish])[group] if len(name) else head
    held = np.where(met, name ^ key.view(np.uint64), name)  # spread over groups; the key gives the name back
    witness = head & met
    cols = (np.concatenate([held, name[witness]]).view(np.int64), np.concatenate([key, key[witness]]), np.concatenate([doc, doc[witness]]), np.concatenate([met, np.zeros(int(witness.sum()), bool)]))
    spare = np.concatenate([np.zeros(len(name), bool), np.ones(int(witness.sum()), bool)])
    return pa.record_batch([pa.array(cols[0]), pa.array(cols[1], mask=spare), pa.array(cols[2]), pa.array(cols[3])], ["name", "key", "doc", "met"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, text) to the anchors of each text's windows."""
    for batch in batches:
        keys, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, at = flat(batch.column(2))
        parts = []
        for i, j in ranges(at):
            part, ends = data[at[i] : at[j]], at[i : j + 1] - at[i]
            row, start, end = word_bounds(part, ends)
            names, least = anchors(word_hashes(part, start, end, 0))
            if not len(least):
                continue
            least[row[: len(least)] != row[WIDTH - 1 :]] = 0  # a window ends within its text
            padded = np.concatenate([np.zeros(PLACES - 1, np.uint64), least, np.zeros(PLACES - 1, np.uint64)])
            spot = np.flatnonzero((_slide(padded, PLACES, np.maximum)[: len(names)] == names) & (names > 0))
            parts.append((names[spot], keys[i:j][row[spot]], docs[i:j][row[spot]]))
        if parts:
            yield _anchor_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))


WINDOWS = "one long, two long, key long, doc long, place int, run int, of int"
#: Kinds of rows in `of`: a window to be counted, a run of windows known to be removed, or else the place of an equal window of the same text, whose fate the run shares.
OPEN, MET = -1, -2


def _runs(key: np.ndarray, place: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of key and place: where runs of successive places begin, and how long they are."""
    begin = np.ones(len(key), bool)
    begin[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1) | (of[1:] != of[:-1] + (of[:-1] >= 0))
    begins = np.flatnonzero(begin)
    return begins, np.diff(np.append(begins, len(key)))


def _window_rows(one, two, key, doc, place) -> pa.RecordBatch:
    """Of windows equal here, those of greater documents are met, and those of the least one go to the window's group once a text; both go on as runs."""
    order, new = _first_of(one, two, doc, key)
    one, two, key, doc, place = (x[order] for x in (one, two, key, doc, place))
    head = np.ones(len(one), bool)
    head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    least = doc[np.flatnonzero(head)][np.cumsum(head) - 1] if len(one) else doc
    first = place[np.flatnonzero(new)][np.cumsum(new) - 1] if len(one) else place
    of = np.where(doc > least, MET, np.where(new, OPEN, first))
    stay = of == OPEN
    rest = np.lexsort((place[~stay], key[~stay]))
    k, p, d, o = (x[~stay][rest] for x in (key, place, doc, of))
    begins, sizes = _runs(k, p, o)
    k, p, d, o = (x[begins] for x in (k, p, d, o))
    alone = _own(k, p)
    columns = [np.concatenate(x) for x in ((one[stay], alone), (two[stay], alone), (key[stay], k), (doc[stay], d), (place[stay], p), (np.ones(int(stay.sum()), np.int64), sizes), (of[stay], o))]
    arrays = [pa.array(x.view(np.int64)) for x in columns[:2]] + [pa.array(x) for x in columns[2:4]] + [pa.array(x.astype(np.int32)) for x in columns[4:]]
    return pa.record_batch(arrays, ["one", "two", "key", "doc", "place", "run", "of"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, packed, names) to both hashes of the windows whose anchor is among names."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        parts = []
        for key, doc, packed, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            part = np.frombuffer(unpack(packed.as_buffer()), np.uint8)
            _, start, end = word_bounds(part, np.array([0, len(part)]))
            word = word_hashes(part, start, end, 0)
            place = np.flatnonzero(np.isin(anchors(word)[1], names.values.to_numpy().view(np.uint64)))
            one, two = rabin_karp(word, WIDTH, 0)[place], rabin_karp(word_hashes(part, start, end, 1), WIDTH, 1)[place]
            parts.append((one, two, np.full(len(place), key, np.int64), np.full(len(place), doc, np.int64), place))
        if parts:
            yield _window_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))


CUT = "doc_id long, n_words long, n_removed long, spans array<struct<first:long,words:long>>, kept string"


def _cut_one(raw: bytes, places, runs, of) -> tuple[int, int, list[dict], str]:
    words = raw.split()  # bytes split at the contract's six characters
    cover = np.zeros(len(words) + 1, np.int32)
    sure = of < 0
    if not sure.all():
        begins = np.zeros(len(words) + 1, np.int32)
        np.add.at(begins, places[sure], 1)
        np.add.at(begins, (places + runs)[sure], -1)
        repeated = np.cumsum(begins) > 0
        more = [(p + k, 1) for p, n, o in zip(places[~sure], runs[~sure], of[~sure], strict=True) for k in np.flatnonzero(repeated[o : o + n])]
        places, runs = (np.concatenate([x[sure], np.array([m[k] for m in more], np.int64)]) for k, x in enumerate((places, runs)))
    np.add.at(cover, places, 1)
    np.add.at(cover, places + runs - 1 + WIDTH, -1)
    gone = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
    kept, last = [], 0
    for a, b in edge:
        kept += words[last:a]
        last = b
    return len(words), int(gone.sum()), [{"first": a, "words": b - a} for a, b in edge], b" ".join(kept + words[last:]).decode()


_NONE = np.zeros(0, np.int64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_cut_one((text or "").encode(), _NONE, _NONE, _NONE) for text in batch.column(1).to_pylist()]
        yield _cut_batch(batch.column(0), rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        lists = zip(*(batch.column(k) for k in range(1, 5)), strict=True)
        rows = [_cut_one(unpack(packed.as_buffer()), *(np.asarray(x.values.to_numpy(), np.int64) for x in at)) for packed, *at in lists]
        yield _cut_batch(batch.column(0), rows)


def _cut_batch(ids, rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])), pa.string())
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.record_batch([ids, *columns], ["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_repeated_windows(docs: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (maximal removed intervals of words), kept (the other words, joined by one space)."""
    texts = _keyed(docs, key_bits)
    doc = F.coalesce("doc_id", F.lit(LAST))
    group = Window.partitionBy("name").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = arrow(texts.select("key", doc.alias("doc"), "text"), _anchors, ANCHORS)
    several = named.select("*", (F.col("met") | (F.min("doc").over(group) != F.max("doc").over(group))).alias("several")).where("several and key is not null")
    lists = durable(several.groupBy("key").agg(F.collect_list(F.expr("if(met, name ^ key, name)")).alias("names")), "anchors")
    packed = arrow(_of(texts, lists, "left_semi", broadcast_rows).select("key", doc.alias("doc_id"), "text"), _pack, "key long, doc_id long, packed binary").dropDuplicates(["key"])
    counted = arrow(packed.join(lists, "key").select("key", "doc_id", "packed", "names"), _windows, WINDOWS)
    least = F.first("doc").over(Window.partitionBy("one", "two").orderBy("doc"))
    gone = counted.select("key", "place", "run", "of", ((F.col("of") != OPEN) | (F.col("doc") > least)).alias("gone")).where("gone")
    fields = {"places": "place", "runs": "run", "ofs": "of"}
    cuts = durable(gone.groupBy("key").agg(F.collect_list(F.struct(*fields.values())).alias("at")).select("key", *(F.col(f"at.{c}").alias(n) for n, c in fields.items())), "cuts")
    met = arrow(_of(texts, cuts, "left_semi", broadcast_rows), _pack, "key long, doc_id long, packed binary").join(cuts, "key")
    cut = arrow(met.select("doc_id", "packed", *fields), _cut, CUT)
    return cut.unionByName(arrow(_of(texts, cuts, "left_anti", broadcast_rows).select("doc_id", "text"), _whole, CUT))


def _of(texts: DataFrame, lists: DataFrame, how: str, broadcast_rows: int) -> DataFrame:
    """texts with, or without, a key in lists; the keys are broadcast after a count only."""
    ids = lists.select("key")
    return texts.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, "key", how)
