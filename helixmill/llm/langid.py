"""Language ID by prediction by partial matching.

Per language, a byte context tree of order 3 with escape probabilities (method C) is learned and frozen. The chance of a byte after a
context is n / (T + D) if it was seen there n times (T: all counts there, D: distinct bytes), else D / (T + D) times its chance one order
down, where bytes seen at this order are excluded and the rest renormalised; below order 0 stands a uniform chance. So each context's chances sum
to 1 and a text's code length, the sum of -log2, is exact. The language with the shortest code wins.

Bytes are folded first: A-Z to lower case, other ASCII bytes than letters to one symbol. Bytes the sample doesn't hold share one more symbol.
Since statistics are frozen, code lengths are tabulated once a worker: one table row per (context, byte), one column per language. Where such tables
would hold over MAX_CELLS cells (many languages, many distinct bytes), the same order-3 trees are kept sparsely instead: sorted seen grams with
their chances and sorted contexts with their escapes, looked up once per distinct gram of a slice. Code lengths are the same, the order is always 3.

Training reads only text and lang of documents with non-null lang that aren't held out (crc32 of doc_id as text, mod 3, is 1): the `docs_per_lang`
documents with the least hash of doc_id of each language, a bound that doesn't grow with the corpus; those are read whole. Prediction reads text only.

Scale: one narrow pass picks the sample, one pass predicts; no shuffle of texts. Broadcast: one row a language, the sample's ids (counted first) and 4-byte counts. The sample
bounds the counts of a language; for many languages it should be smaller, as a worker holds the trees of all.

Cases: null text or one without a letter gives `und`, score 0; so does every text if nothing was learned. Ties go to the first language in
order. Rows without doc_id are predicted, never learned from, and not held out. Repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._base import arrow, durable, flat, slices, worker_caches

DOCS_PER_LANG = 1500
#: Rows that are predicted and handed back at a time.
PIECE = 500
#: The sample's ids are broadcast up to this many.
BROADCAST_ROWS = 500_000
ORDER = 3
#: Tables of more cells are kept sparsely.
MAX_CELLS = 4_000_000
#: Score: the winner's share of 2 ** -bits, with at most this many bytes' worth of evidence.
EVIDENCE_BYTES = 100
SLICE = 1 << 20

_fold = np.arange(256, dtype=np.uint8)
_fold[ord("A") : ord("Z") + 1] += 32
_letter = np.zeros(256, bool)
_letter[ord("a") : ord("z") + 1] = True
_fold[:128][~_letter[_fold[:128]]] = 32


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _contexts(symbols: np.ndarray, starts: np.ndarray, blank: int) -> list[np.ndarray]:
    """The symbols 3, 2 and 1 places back; blank before a text's start."""
    back = [symbols]
    for _ in range(ORDER):
        one = np.empty_like(symbols)
        one[1:] = back[-1][:-1]
        one[starts] = blank
        back.append(one)
    return back[:0:-1]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        data, at = flat(batch.column(1))
        for lang in sorted({*langs}):
            rows = np.flatnonzero((langs == lang) & (np.diff(at) > 0))
            if not len(rows):
                continue
            parts = _fold[np.concatenate([data[at[r] : at[r + 1]] for r in rows])]
            starts = np.concatenate([[0], np.cumsum(np.diff(at)[rows])[:-1]])
            three, two, one = (x.astype(np.uint32) for x in _contexts(parts, starts, 32))
            grams, n = np.unique(three << 24 | two << 16 | one << 8 | parts, return_counts=True)
            yield pa.record_batch([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 4-byte keys, and each key's place among them."""
    high, low = (keys >> 16).astype(np.uint16), keys.astype(np.uint16)
    seen = np.zeros(1 << 16, bool)
    seen[high] = seen[low] = True
    halves = np.flatnonzero(seen)
    if len(halves) ** 2 > 1 << 24:
        return np.unique(keys, return_inverse=True)
    place = np.cumsum(seen, dtype=np.int32) - 1
    pair = place[high] * np.int32(len(halves)) + place[low]
    seen = np.zeros(len(halves) ** 2, bool)
    seen[pair] = True
    pairs = np.flatnonzero(seen)
    return (halves[pairs // len(halves)] << 16 | halves[pairs % len(halves)]).astype(np.uint32), (np.cumsum(seen, dtype=np.int32) - 1)[pair]


class SparseTree:
    """One language's context tree: per order its seen grams with their chances, and its contexts with the factor of an escape."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, a: int):
        self.a, self.levels, lower = a, [], None
        for k in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            keys, of = np.unique(grams & mask, return_inverse=True)
            count = np.bincount(of, n)
            contexts, of = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.bincount(of, count), np.bincount(of)
            # what is seen at this order is seen one order down
            below = lower[1][np.searchsorted(lower[0], keys & (mask >> 8))] if lower else np.full(len(keys), 1.0 / a)
            left = 1 - np.bincount(of, below)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(left > 1e-12, kinds / (total + kinds) / left, 0)
            lower = keys, count / (total + kinds)[of]
            self.levels.append((mask, *lower, contexts, escape))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        chance = np.full(len(keys), 1.0 / self.a)
        for mask, grams, seen, contexts, escape in self.levels:
            mine = keys & mask
            at = np.minimum(np.searchsorted(grams, mine), len(grams) - 1)
            context = mine >> 8
            of = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            chance = np.where(grams[at] == mine, seen[at], np.where(contexts[of] == context, escape[of] * chance, chance))
        return -np.log2(np.maximum(chance, 1e-12)).astype(np.float32)


class Trees:
    """The languages' context trees as one table of code lengths, or sparsely."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        seen = np.unique(np.concatenate([g & 255 for g, _ in counts.values()] + [np.array([32])]))
        self.code = np.full(256, len(seen), np.int32)
        self.code[seen] = np.arange(len(seen))
        self.a = a = len(seen) + 1
        self.order = ORDER
        self.sparse = a ** (ORDER + 1) * len(self.langs) > MAX_CELLS
        self.bits = [] if self.sparse else [self._table(*counts[lang]) for lang in self.langs]
        self.trees = [SparseTree(self._coded(counts[lang][0]), counts[lang][1], a) for lang in self.langs] if self.sparse else []

    def _coded(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), np.uint32)
        for back in range(ORDER, -1, -1):
            out = out << 8 | self.code[(grams >> (8 * back)) & 255].astype(np.uint32)
        return out

    def _table(self, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Code lengths by (context, byte). The highest order is made one leading symbol at a time, so that little is held besides the result."""
        a, codes = self.a, [self.code[(grams >> (8 * back)) & 255].astype(np.int64) for back in range(self.order + 1)]
        chance = np.full((1, a), 1.0 / a)
        for k in range(self.order):
            chance = self._chances(codes[: k + 1], n, np.tile(chance, (a if k > 1 else 1, 1)) if k else chance)
        out = np.empty((a, a**self.order), np.float32)
        for lead in range(a):
            mine = codes[-1] == lead
            out[lead] = -np.log2(np.maximum(self._chances([c[mine] for c in codes[:-1]], n[mine], chance), 1e-12)).ravel()
        return out.ravel()

    def _chances(self, codes: list[np.ndarray], n: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Rows of chances: one per context of len(codes) - 1 symbols before codes[0]. lower: the next shorter contexts' rows, or one for all."""
        a, key = self.a, np.zeros(len(n), np.int64)
        for c in codes[::-1]:
            key = key * a + c
        count = np.bincount(key, n, a ** len(codes)).reshape(-1, a)
        total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
        left = 1 - np.where(count > 0, lower, 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(left > 1e-12, kinds / (total + kinds) / left, 0) * lower
            return np.where(total > 0, np.where(count > 0, count / (total + kinds), escape), lower)

    def code_lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        for i, j in slices(at, SLICE):
            full = np.flatnonzero(np.diff(at[i : j + 1])) + i
            if not len(full):
                continue
            raw = data[at[i] : at[j]]
            symbols, starts = self.code[_fold[raw]], at[full] - at[i]
            backs = [*_contexts(symbols, starts, self.code[32]), symbols]
            if self.sparse:
                key = np.zeros(len(symbols), np.uint32)
                for back in backs:
                    key = key << 8 | back.astype(np.uint32)
                grams, key = _distinct(key)
            else:
                key = np.zeros(len(symbols), np.int32)
                for back in backs:
                    key = key * self.a + back
            for k in range(len(self.langs)):
                bits = self.trees[k].bits(grams) if self.sparse else self.bits[k]
                out[full, k] = np.add.reduceat(bits[key], starts, dtype=np.float64)
        return out


def _has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at) - 1, bool)
    for i, j in slices(at, SLICE):
        full = np.flatnonzero(np.diff(at[i : j + 1])) + i
        if len(full):
            out[full] = np.logical_or.reduceat(_letter[_fold[data[at[i] : at[j]]]], at[full] - at[i])
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = any(map(str.isalpha, data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def learn(docs: DataFrame, *, docs_per_lang: int = DOCS_PER_LANG) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """4-byte counts per language over the sample."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    # a hash bound leaves about twice the sample of each language; the window then cuts each exactly
    near = ids.join(F.broadcast(sizes), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 2.0 * docs_per_lang)
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= docs_per_lang)
    chosen = durable(best.select("doc_id", "lang").distinct(), "chosen")
    sample = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen, ["doc_id", "lang"], "left_semi").select("lang", "text")
    rows = arrow(sample, _count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return {lang: (g["gram"].to_numpy(np.int64), g["n"].to_numpy(np.float64)) for lang, g in rows.groupby("lang")}


_trees: dict[int, Trees] = {}
worker_caches.append(_trees)


def identify(docs: DataFrame, *, docs_per_lang: int = DOCS_PER_LANG, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("held_out", "lang_pred", "score")) -> DataFrame:
    """The kept columns, then held_out, lang_pred, score (under these names) of every row."""
    counts = learn(docs, docs_per_lang=docs_per_lang)
    shared, version = docs.sparkSession.sparkContext.broadcast(counts), hash(tuple((k, len(g), float(n.sum()), int(g.sum())) for k, (g, n) in sorted(counts.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value and version not in _trees:
            _trees.clear()
            _trees[version] = Trees(shared.value)
        trees = _trees.get(version)
        # small pieces: the kept texts go back as they came, and neither side should hold a whole batch twice
        for batch in (whole.slice(i, PIECE) for whole in batches for i in range(0, whole.num_rows, PIECE)):
            data, at = flat(batch.column(text_at))
            n = len(at) - 1
            langs, score = np.full(n, "und", object), np.zeros(n)
            if trees:
                known = _has_letter(data, at)
                bits = trees.code_lengths(data, at)
                size = np.maximum(np.diff(at), 1)[:, None]
                share = np.exp2(-(bits - bits.min(1, keepdims=True)) / size * np.minimum(size, EVIDENCE_BYTES))
                best = bits.argmin(1)
                langs = np.where(known, np.array(trees.langs, object)[best], "und")
                score = np.where(known, share[np.arange(n), best] / share.sum(1), 0.0)
            yield pa.record_batch([*batch.columns[:kept], pa.array(langs.tolist(), pa.string()), pa.array(score)], [*batch.schema.names[:kept], *names[1:]])

    # the text crosses to Python once: as one of the kept columns, or after them
    columns, kept = [*keep, held_out().alias(names[0])], len(keep) + 1
    whole = "text" in keep and docs.schema["text"].dataType.typeName() == "string"
    text_at = keep.index("text") if whole else kept
    rows = docs.select(*columns) if whole else docs.select(*columns, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:kept]) + f", `{names[1]}` string, `{names[2]}` double"
    return arrow(rows, run, schema)
