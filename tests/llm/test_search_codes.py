"""Repeated windows, vector codes and lexical search against plain Python."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import cases, words

from helixmill.llm import lexical_search, vector_codes
from helixmill.llm.substring_dedup import WIDTH, remove_repeated_windows

WORD, TERM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def windows_by_hand(rows):
    """doc_id, n_words, n_removed, spans, kept; rows without doc_id come last and take nothing from one another."""
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in texts:
        for p in range(len(w) - WIDTH + 1):
            key = tuple(w[p : p + WIDTH])
            first[key] = min(first.get(key, math.inf), math.inf if d is None else d)
    for d, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - WIDTH + 1):
            if (math.inf if d is None else d) > first[tuple(w[p : p + WIDTH])]:
                gone[p : p + WIDTH] = [True] * WIDTH
        edges = [k for k in range(len(w) + 1) if (k < len(w) and gone[k]) != (k > 0 and gone[k - 1])]
        spans = tuple((a, b - a) for a, b in zip(edges[::2], edges[1::2], strict=True))
        yield d, len(w), sum(gone), spans, " ".join(x for x, g in zip(w, gone, strict=True) if not g)


def removed(docs, **options):
    rows = remove_repeated_windows(docs, **options).collect()
    return collections.Counter((r.doc_id, r.n_words, r.n_removed, tuple((s["first"], s["words"]) for s in r.spans), r.kept) for r in rows)


def test_repeated_windows_are_brute_force(docs, no_docs):
    want = collections.Counter(windows_by_hand([(d, t) for d, t, *_ in cases()]))
    assert sum(x[2] > 0 for x in want) >= 4
    for options in ({}, {"broadcast_rows": 0}, {"key_bits": 3}):
        assert removed(docs, **options) == want
    assert remove_repeated_windows(no_docs).count() == 0


def test_repeated_windows_across_batches(spark):
    """Passages of 49 to 130 words at random places, one of them in a third of all texts; periodic texts; ids in no order."""
    r = random.Random(4)
    passages = [words(100 + k, n).split() for k, n in enumerate((49, 50, 51, 80, 130))]
    rows = []
    for d in r.sample(range(-50, 400), 150):
        w = words(1000 + d, r.randint(0, 120)).split()
        for p in r.sample(passages, r.randint(0, 2)) + [passages[3]] * (d % 3 == 0):
            at = r.randint(0, len(w))
            w[at:at] = p[r.randint(0, 3) :]
        rows.append((d, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(500, "ab " * 300), (501, "ab\n" * 120), (502, "ab " * 49), (503, "ba " + "ab " * 60), (r.choice(rows)[0], words(9, 70)), (None, rows[0][1]), (None, words(9, 70))]
    want = collections.Counter(windows_by_hand(rows))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert removed(frame.repartition(5)) == want
        assert removed(frame.repartition(1), broadcast_rows=0) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def codes_by_hand(rows):
    good = [(i, v, b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in good]
    width = len(whole[0]) // 8
    cut = [[v[p * width : p * width + width] for p in range(8)] for v in whole]
    books = [[list(v[p]) for v in cut[:16]] for p in range(8)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(6):
        for p in range(8):
            groups = collections.defaultdict(list)
            for v in cut:
                groups[near(v[p], books[p])[1]].append(v[p])
            for k, members in groups.items():
                books[p][k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [[near(v[p], books[p]) for p in range(8)] for v in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = collections.Counter()
    for (_, _, label), e in zip(good, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[b], sha) for (i, _, b), f, e in zip(good, found, errors, strict=True))


def vectors(n, size=16, seed=0):
    g = np.random.default_rng(seed)
    rows = [(int(k), [float(np.float32(x)) for x in g.normal(0, 0.3, size)], int(k) % 3 if k % 5 else None) for k in g.permutation(n)]
    odd = [(n, None, 1), (n + 1, [0.1] * (size - 1) + [None], 1), (n + 2, [float("nan")] * size, 2), (-9, [float("inf")] + [0.0] * (size - 1), 0), (n + 3, [0.5] * 8, 1), (n + 4, [], 1)]
    return rows + odd + [rows[0], (rows[1][0], rows[2][1], 7), (None, [0.25] * size, None)] + [(n + 9 + k, [-0.125] * size, 4) for k in range(40)]


@pytest.mark.parametrize("n", [0, 5, 90])
def test_vector_codes_are_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 17)
    rows = vectors(n) if n else [(1, [0.5] * 8, None), (0, [-0.5] * 8, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).withColumn("code", F.lit("x"))
    want = codes_by_hand(rows)
    for options in ({}, {"broadcast_rows": 0}):
        assert collections.Counter(tuple(r) for r in vector_codes.compress(frame, **options).collect()) == want


def test_vector_codes_of_nothing_and_of_too_much(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert vector_codes.compress(frame([])).collect() == []
    assert vector_codes.compress(frame([(1, None, 1)])).collect() == []
    with pytest.raises(ValueError, match="8 equal parts"):
        vector_codes.compress(frame([(1, [0.0] * 9, 1)]))
    with pytest.raises(ValueError, match="outgrow"):
        vector_codes.compress(frame([(1, [1e9] * 8, 1)]))


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranks_by_hand(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n_docs, total = len(held), sum(len(t) for _, t in held)
    df = collections.Counter(x for _, t in held for x in set(t))
    out = collections.Counter()
    for item, text in items:
        scores = []
        for d, t in held:
            tf, m = collections.Counter(t), 25 + 75 * len(t) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in terms(text) if x in tf)
            if score > 0:
                scores.append((-score, d is None, d))
        for rank, (score, _, d) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out[item, rank, d, -score] += 1
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_is_brute_force(spark, docs, no_docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", 3)
        monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 2)
    texts = [(d, t) for d, t, *_ in cases()] + [(50 + k, words(60 + k, 5 + k % 9) + " Été—ÉTÉ x_y é2") for k in range(60)] + [(200 + k, "the same words of a copy") for k in range(30)] + [(-1, "the same words of a copy")]
    items = [(1, words(2, 60)), (2, "The SAME, same words!"), (3, None), (4, "... --"), (5, "nowhere"), (6, "été ÉTÉ x y é2 th er"), (6, "thth"), (None, "copy"), (7, words(1, 400))]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    want = ranks_by_hand(texts, items)
    assert len({i for i, *_ in want}) == 5
    for options in ({}, {"broadcast_rows": 0}):
        rows = lexical_search.search(lexical_search.build_index(frame), wanted, **options).collect()
        assert collections.Counter(tuple(r) for r in rows) == want
    assert lexical_search.search(lexical_search.build_index(docs), wanted, k=3).count() == sum(ranks_by_hand([(d, t) for d, t, *_ in cases()], items, 3).values())
    assert lexical_search.search(lexical_search.build_index(no_docs), wanted).count() == 0
    assert lexical_search.search(lexical_search.build_index(docs), wanted.limit(0)).count() == 0


def test_impacts_are_bounds():
    """A byte rounds a quotient up, by less than a step."""
    size = np.arange(1, 50_000, 7)
    q = lexical_search.quotients(np.minimum(size, 1 + size % 40), size, 10**6, 4 * 10**8)
    impact = -(-q // lexical_search.STEP)
    assert impact.max() <= 255 and (lexical_search.STEP * impact >= q).all() and (lexical_search.STEP * (impact - 1) < q).all()
    huge = lexical_search.quotients(np.array([3]), np.array([10**6]), 10**12, 10**15)
    assert huge[0] == 3 * 10**9 // (3000 + 8 * (25 + 75 * 10**6 * 10**12 // 10**15))


def test_files_of_the_index_hold_few_segments(spark):
    """Segments are rows of many MB, and a file's are held at once: their number doesn't grow with a task's documents."""
    docs = spark.createDataFrame([(i, f"{words(i, 20)} w{i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        index = lexical_search.build_index(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files = collections.Counter(r.file for r in index.segments.select(F.input_file_name().alias("file")).collect())
    assert sum(files.values()) == 10 and max(files.values()) <= lexical_search.FILE_SEGMENTS
    found = lexical_search.search(index, spark.createDataFrame([(1, "w7"), (2, "w33")], "item_id long, text string")).collect()
    assert {(r.item_id, r.doc_id) for r in found} == {(1, 7), (2, 33)}
