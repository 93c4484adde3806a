"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts and templates become five-word shingles of alphanumeric words in lower case. A template of t shingles has windows of W shingles (`window_width`); so has the text, one at every
shingle. A window's signature is the least value of each of `BANDS` x `ROWS` hash functions; a band is a hash of `ROWS` of them. At similarity 0.8, 8 bands of 2 meet with a chance of
1 - (1 - 0.64) ** 8 = 0.9997, equal windows for certain. Each hit is verified: of the template's distinct shingles, the share that stands within 1.25 template lengths
around the hit must reach `CONTAINMENT`. A text of fewer shingles than a template's W has no window and goes straight to the verification, every place of it a hit.

W is such that a text with 0.8 of a template's shingles, its words in order, has a window equal to one of the template's, and is found for certain: a changed or left-out word costs five
shingles, an added one four, so there are t / 20 such places at most and one run between them has 0.8 t / (t / 20 + 1) shingles or more. Texts with the words out of order
depend on the bands. A text without any shingle of any template can't contain 0.8 of one, so it skips the windows.

Templates are whole license texts (MIT, BSD, ISC, Zlib, BSL, Unlicense and others; Apache, GPL, LGPL, MPL and CC0 with all their sections), file headers of Apache, GPL, LGPL and MPL, and one-sentence notices (`license_texts.py`).
A notice of one shingle has windows of one shingle, so its bands are a lookup of that shingle and the verification can't but agree. A text that holds
the three-clause BSD license holds most of the two-clause one, so both are reported, each with its containment.

Scale: one pass, no shuffle; templates are a fixed list. Work grows with a text's length, and with its hits.

Cases: null text counts as empty; texts without a match give no row. Overlapping matches of a template are reported once, the fullest first; ties go to
the earliest. Repeated rows are reported alike. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixmill.llm._base import arrow, flat, mix
from helixmill.llm.license_texts import TEMPLATES
from helixmill.llm.shingles import ranges, shingles

WIDEST, BANDS, ROWS, CONTAINMENT = 16, 8, 2, 0.8
_BITS = 18

_word_bytes = np.full(256, 32, np.uint8)
for _range in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
    _word_bytes[list(_range)] = list(_range)
_seeds = np.random.default_rng(5).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def _shingled(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = flat(column)
    plain = _word_bytes[data]
    for i, j in ranges(at):
        row, _, hashes = shingles(plain, at, i, j)
        yield i, j, row, hashes


def window_width(t: int) -> int:
    """The greatest power of two up to WIDEST that a run of matching shingles reaches for certain in a text with 0.8 of t shingles."""
    run = math.ceil(CONTAINMENT * t / (t // 20 + 1) - 1e-9)
    return 1 << min(max(run, 1), WIDEST).bit_length() - 1


def window_bands(hashes: np.ndarray, width: int) -> np.ndarray:
    """windows x BANDS band values of every window of width, a power of two, of one text."""
    n = len(hashes) - width + 1
    out = np.zeros((max(0, n), BANDS), np.uint64)
    if n <= 0:
        return out
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            value = np.full(n, band + 1, np.uint64)
            for r in range(ROWS):
                least, step = mix(hashes ^ _seeds[band * ROWS + r]), 1
                while step < width:
                    least = np.minimum(least[:-step], least[step:])
                    step *= 2
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + least)
            out[:, band] = value
    return out


class Templates:
    """Shingles and window bands of the templates, by window width."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        parts = [(row, h) for _, _, row, h in _shingled(pa.array(list(templates.values()), pa.string()))]
        row, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.shingles = [np.unique(hashes[row == k]) for k in range(len(self.names))]
        self.length = [int((row == k).sum()) for k in range(len(self.names))]
        self.all = np.unique(hashes)
        self.bit = np.zeros(1 << _BITS, bool)
        self.bit[(self.all >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.bands: dict[int, dict[int, set[int]]] = {}
        self.of_width: dict[int, list[int]] = {}
        for k, t in enumerate(self.length):
            width = window_width(t)
            self.of_width.setdefault(width, []).append(k)
            for value in window_bands(hashes[row == k], width).ravel().tolist():
                self.bands.setdefault(width, {}).setdefault(value, set()).add(k)
        self.values = {w: np.array(sorted(v), np.uint64) for w, v in self.bands.items()}

    def matches(self, hashes: np.ndarray) -> list[tuple[str, int, int, float]]:
        """name, first shingle, last shingle, containment of the matches in one text."""
        spots: dict[int, set[int]] = {}
        for width, values in self.values.items():
            if len(hashes) < width:
                spots.update((k, set(range(len(hashes)))) for k in self.of_width[width])
                continue
            bands = window_bands(hashes, width)
            for at, band in zip(*np.nonzero(np.isin(bands, values)), strict=True):
                for k in self.bands[width][int(bands[at, band])]:
                    spots.setdefault(k, set()).add(int(at))
        out = []
        for k, places in spots.items():
            found = self._contained(k, hashes, np.array(sorted(places)))
            taken: list[tuple[int, int]] = []
            for share, first, last in sorted(found, key=lambda x: (-x[0], x[1])):
                if share >= CONTAINMENT and all(last < a or first > b for a, b in taken):
                    taken.append((first, last))
                    out.append((self.names[k], first, last, share))
        return sorted(out, key=lambda x: (x[1], x[0]))


    def _contained(self, k: int, hashes: np.ndarray, places: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """Containment, first and last shingle of each stretch around a hit that begins with a shingle of template k; shingles enter and leave one count."""
        mine, reach = self.shingles[k], max(self.length[k], int(1.25 * self.length[k]))
        name = np.minimum(np.searchsorted(mine, hashes), len(mine) - 1)
        spots = np.flatnonzero(mine[name] == hashes)
        near = np.searchsorted(places, spots + reach) > np.searchsorted(places, spots - 1)
        counts, distinct, end = [0] * len(mine), 0, 0
        at, names = spots.tolist(), name[spots].tolist()
        for i, start in enumerate(at):
            while end < len(at) and at[end] < start + reach:
                distinct += not counts[names[end]]
                counts[names[end]] += 1
                end += 1
            if near[i]:
                yield distinct / len(mine), start, at[end - 1]
            counts[names[i]] -= 1
            distinct -= not counts[names[i]]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per match: doc_id, license, first_word, last_word (of the text's alphanumeric words), containment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            for i, _, row, hashes in _shingled(batch.column(1)):
                maybe = np.flatnonzero(known.bit[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
                for k in np.unique(row[maybe[np.isin(hashes[maybe], known.all)]]):
                    a, b = np.searchsorted(row, [k, k + 1])
                    rows += [(ids[i + int(k)].as_py(), name, first, last + 4, share) for name, first, last, share in known.matches(hashes[a:b])]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], ["doc_id", "license", "first_word", "last_word", "containment"])

    return arrow(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, "doc_id long, license string, first_word long, last_word long, containment double")
