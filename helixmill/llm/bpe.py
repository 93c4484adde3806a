"""Byte-level BPE encoding and decoding in two tiers.

A text is split into pre-tokens by the tokenizer's pattern. Tier one looks a whole pre-token up in a minimal perfect hash over the
vocabulary: hash and displace, so that each of the n keys has its own of n slots, and one comparison tells members from others. Tier two, for
misses, merges: the bytes form a doubly linked list, a heap holds the adjacent pairs by (rank, position), the least is merged, its
two new neighbours enter the heap, and stale heap entries are skipped.

Workers remember what they found for recent pre-tokens (at most `CACHE_BYTES` of them, then they start anew): frequent words cost one probe.

Scale: one pass over the texts without a shuffle; only the tables of the fixed vocabulary are broadcast (some 50,000 entries, 2 MB).

Cases: null text counts as empty and has no ids; very long pre-tokens take n log n time; special tokens are ordinary text. Rows
are independent, so ties and repeated rows need no rule. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from helixmill.llm._base import arrow, worker_caches

SCHEMA = "doc_id long, ids binary, decoded binary"
#: A task's cache of pre-tokens, in bytes with what an entry costs besides its texts.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 220
#: Characters below this are split with re and spelled-out classes, which is twice as fast; the classes come from the regex module.
PLAIN_BELOW = 0x250


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PerfectHash:
    """Minimal perfect hash of byte strings to integers, by hash and displace. get(key) is -1 for strangers."""

    def __init__(self, items: dict[bytes, int]):
        n = self.n = max(1, len(items))
        self.buckets = n // 2 + 1
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in items:
            h = xxhash.xxh3_64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        free = None
        for bucket, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(members) > 1:
                d = 1
                while True:
                    slots = [self._slot(h, d) for h, _ in members]
                    if len({*slots}) == len(slots) and all(self.keys[s] is None for s in slots):
                        break
                    d += 1
            else:  # a key alone goes straight to a free slot, noted below zero
                free = free or [s for s in range(n) if self.keys[s] is None]
                slots = [free.pop()]
                d = -1 - slots[0]
            self.shift[bucket] = d
            for slot, (_, key) in zip(slots, members, strict=True):
                self.keys[slot], self.values[slot] = key, items[key]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 20) % self.n

    def get(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        if d:
            slot = self._slot(h, d) if d > 0 else -1 - d
            if self.keys[slot] == key:
                return self.values[slot]
        return -1


def merge(word: bytes, rank_of) -> list[int]:
    """Ids of a pre-token that is no token: least rank first, leftmost among equals."""
    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    now = [rank_of(word[i : i + 2], -1) for i in range(n)]  # of the pair that begins here; heap entries of other ranks are stale
    now[-1] = -1
    heap = [rank * n + i for i, rank in enumerate(now) if rank >= 0]
    heapify(heap)
    while heap:
        rank, i = divmod(heappop(heap), n)
        if now[i] != rank:
            continue
        j = after[i]
        both = part[i] = part[i] + part[j]
        part[j] = b""
        now[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            rank = now[i] = rank_of(both + part[k], -1)
            if rank >= 0:
                heappush(heap, rank * n + i)
        else:
            now[i] = -1
        h = before[i]
        if h >= 0:
            rank = now[h] = rank_of(part[h] + both, -1)
            if rank >= 0:
                heappush(heap, rank * n + h)
    return [rank_of(p) for p in part if p]


class Codec(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers. A dict that fills itself."""

    def __init__(self, table: PerfectHash, pattern: str):
        super().__init__()
        self.held, self.get_id = 0, table.get
        self.tokens = dict(zip(table.values, table.keys, strict=True))
        self.pairs = dict(zip(table.keys, table.values, strict=True)).get  # the merges' ranks
        self.split = regex.compile(pattern).findall
        self.plain, self.odd = None, None
        letters, numbers, spaces = (self._spelled(kind) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        spelled = spelled.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")
        if not re.search(r"\\[pPwWdDbB]", spelled):
            self.plain, self.odd = re.compile(spelled).findall, re.compile(f"[^\0-{chr(PLAIN_BELOW - 1)}]").search

    @staticmethod
    def _spelled(kind: str) -> str:
        has = regex.compile(kind).match
        return "".join(f"\\u{c:04x}" for c in range(PLAIN_BELOW) if has(chr(c)))

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        whole = self.get_id(raw)
        ids = [whole] if whole >= 0 else merge(raw, self.pairs)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        self.held += len(raw) + len(packed) + ENTRY_BYTES
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        split = self.plain if self.plain and not self.odd(text) else self.split
        return b"".join(map(self.__getitem__, split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}
worker_caches.append(_codecs)


def _codec(table, *at: str) -> Codec:
    """The worker's codec, for one task."""
    if at not in _codecs:
        _codecs.clear()
        _codecs[at] = Codec(table.value, at[1])
    return _codecs[at]


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, end to end), decoded (the bytes these ids stand for)."""
    table = docs.sparkSession.sparkContext.broadcast(PerfectHash(read_ranks(ranks_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(table, ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # the ids of a few hundred texts at a time
                part = batch.slice(at, 256)
                ids = [codec.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    return arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, SCHEMA)
