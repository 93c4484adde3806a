import collections
import hashlib
import re

from samples import cases
from helixmill.llm.components import components
from helixmill.llm.exact_dedup import exact_dedup
from helixmill.llm.near_dedup import banding, near_duplicates
from helixmill.llm.suffix_dedup import LENGTH, remove_repeats

WORD, SPACE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]+")


def exact_by_hand(rows):
    groups = collections.defaultdict(list)
    for k, (d, t, *_) in enumerate(rows):
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d is None, d or 0, k))
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            yield rows[m[3]][0], None if best[1] else best[2], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()


def test_exact_dedup_is_brute_force(docs, no_docs):
    want = collections.Counter(exact_by_hand(cases()))
    for options in ({"block_bytes": 64}, {}, {"broadcast_rows": 0}, {"block_bytes": 1000, "salt_rows": 1}):
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs, **options).collect()) == want
    assert exact_dedup(no_docs).count() == 0


def test_exact_dedup_of_repeated_doc_ids(spark):
    """A doc_id that repeats with another text names no block of both; rows without doc_id have groups too."""
    long, short = [(1, "a" * 9000), (2, "a" * 9000), (1, "b" * 9000), (3, "b" * 9000)], [(1, "aa"), (2, "aa"), (1, "bb"), (3, "b b")]
    for rows in (long, short, [(None, "x y"), (None, "xy"), (7, "xy"), (7, "xy"), (7, "x  y"), (None, "z"), (-4, None), (None, "")]):
        got = collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == collections.Counter(exact_by_hand(rows))


def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_are_brute_force(docs, no_docs):
    sets = {d: shingle_set(t) for d, t, *_ in cases() if d is not None}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(cases())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    assert near_duplicates(no_docs).count() == 0


def test_near_duplicates_across_a_bucket(spark):
    """Members that don't link with a bucket's least one, but with each other: a chain of small edits."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(24):
        rows.append((i, " ".join(base)))
        base = base.copy()
        for k in range(2):
            base[(i * 17 + k * 71) % 200] = f"e{i}.{k}"
    sets = {d: shingle_set(t) for d, t in rows}
    up = {d: d for d in sets}
    for b in sets:
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = a, b
                while up[x] != x:
                    x = up[x]
                while up[y] != y:
                    y = up[y]
                up[max(x, y)] = min(x, y)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # whole, in small parts and chunks, in chunks of one document each, and with shuffles in place of broadcasts
    for options in ({}, {"part_rows": 2, "chunk_bytes": 30_000}, {"chunk_bytes": 1000}, {"broadcast_rows": 0, "part_rows": 2, "chunk_bytes": 30_000}, {"broadcast_rows": 60, "part_rows": 2}):
        got = {r.doc_id: r.component_id for r in near_duplicates(docs, **options).collect()}
        assert got == {d: root(d) for d in sets}, options


def test_near_duplicates_keep_few_tables(spark):
    """Signatures are written once, unless their shuffle is asked for; sets and signatures of pairs and blocks are deleted once their links are found. Copies, and texts that share buckets with one they don't link with."""
    from helixmill.llm._base import tables

    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(6):
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base).upper())]
        at = [*range(20, 200, 30)] if i == 0 else [5 + 7 * i]  # too many edits to link with the first, then few
        base = [f"e{i}.{k}" if k in at else w for k, w in enumerate(base)]
    docs, results = spark.createDataFrame(rows, "doc_id long, text string"), []
    for options in ({}, {"broadcast_rows": 0, "chunk_bytes": 6000}):
        before = len(tables())
        results.append(sorted(near_duplicates(docs, **options).collect()))
        left = {path.rsplit("/", 1)[1].split("-")[0] for path in tables()[before:]}
        assert left <= {"signs", "classes", "others", "members", "stars", "likely", "verified", "links", "more"} | ({"heads"} if options else set())
        assert "more" in left
    assert results[0] == results[1] and [r.doc_id for r in results[0] if r.kept] == [0, 2] and len(results[0]) == len(rows)


def test_near_duplicates_find_every_link(spark):
    """Recall against brute force: 300 texts with edits that put pairs above and below the similarity."""
    import itertools
    import random

    r = random.Random(9)
    rows = []
    for base in range(30):
        text = [f"w{r.randrange(4000)}" for _ in range(r.randrange(40, 160))]
        for _ in range(10):
            edited = [w if r.random() > 0.018 else f"e{r.randrange(9999)}" for w in text]
            rows.append((len(rows), " ".join(edited)))
    sets = {d: shingle_set(t) for d, t in rows}
    links = {(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 100 and found == len(links)
    up = {d: d for d in sets}
    for a, b in sorted(links):
        low, high = sorted((up[a], up[b]))
        up = {d: low if c == high else c for d, c in up.items()}
    assert got == up


def test_components_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 90), (100, 95)], "a long, b long").repartition(6)
    got = {r.doc_id: r.component_id for r in components(links).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {95: 90, 100: 90}


def brute_removal(texts):
    raw = [(t or "").encode() for t in texts]
    count = collections.Counter(b[i : i + LENGTH] for b in raw for i in range(len(b) - LENGTH + 1))
    for b in raw:
        gone = bytearray(len(b))
        end = 0
        for i in range(len(b) - LENGTH + 1):
            if count[b[i : i + LENGTH]] > 1:
                for k in range(max(i, end), i + LENGTH):
                    gone[k] = 1
                end = i + LENGTH
        yield len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), bytes(x for x, g in zip(b, gone) if not g)


def test_repeats_are_brute_force(docs, no_docs):
    rows = cases()
    want = sorted(((d if d is not None else -1), *x) for (d, *_), x in zip(rows, brute_removal([r[1] for r in rows])))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs).collect())
    assert got == want
    # nearly all rows share a key of three bits, so they get another
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, key_bits=3).collect()) == want
    assert remove_repeats(no_docs).count() == 0


def test_repeats_at_every_offset(spark):
    import random

    r = random.Random(4)
    alphabet = "abcdefgh"
    shared = ["".join(r.choice(alphabet) for _ in range(n)) for n in (199, 200, 201, 260, 700)]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(90))) + r.choice(shared)[r.randrange(3) :] + "".join(r.choice(alphabet) for _ in range(r.randrange(90))) for _ in range(60)]
    texts += ["ab" * 300, "ab" * 150, "".join(shared)]
    want = sorted((i, *x) for i, x in enumerate(brute_removal(texts)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (500_000, 0):  # with ids broadcast, and with a shuffle
        assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in remove_repeats(frame, broadcast_rows=rows).collect()) == want


def test_near_duplicates_at_each_percent(spark):
    """Pairs of similarity 0.80 to 0.85 are linked at 80 and not at 85, in the pipeline's stage too."""
    import corpus_pipeline

    assert banding(85)[:3] == (85, 28, 6)
    for percent in (50, 80, 85, 95):
        _, bands, rows, least = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands < 2e-6 and least < percent / 100 * bands * rows
    rows = []
    for i in range(40):
        base = [f"w{i}.{k}" for k in range(104)]
        rows.append((2 * i, " ".join(base), "en", "s", 0))
        for k in (20, 60):  # two changed words: 90 shared shingles of 110
            base[k] = f"e{i}.{k}"
        rows.append((2 * i + 1, " ".join(base), "en", "s", 0))
    a, b = (shingle_set(r[1]) for r in rows[:2])
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    linked = {r.doc_id: r.component_id for r in near_duplicates(docs, percent=80).collect()}
    assert linked == {i: i - i % 2 for i in range(80)}
    assert all(r.kept for r in near_duplicates(docs).collect())
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == list(range(0, 80, 2))


def test_equal_cores_with_other_fulls_are_not_met():
    """Suffixes are equal in a batch only if both of their hashes are, whatever a mix of the two says."""
    import numpy as np

    from helixmill.llm.suffix_dedup import _batch

    core, full = np.array([5, 5, 5, 9, 9], np.uint64), np.array([1, 2, 1, 1, 3], np.uint64)
    rows = _batch(core, full, np.arange(5), np.arange(5)).to_pylist()
    assert [r["met"] for r in rows] == [True, False, True, False, False]
    assert [r["core"] == c for r, c in zip(rows, core.tolist(), strict=True)] == [True, True, False, True, True]


def test_components_of_a_long_chain(spark):
    """Rounds go on until the links are stars."""
    n = 3000
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {(r.doc_id, r.component_id) for r in components(links).collect()} == {(i, 0) for i in range(1, n + 1)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suffixes_of_a_hot_core(spark):
    """A line of 73 to 199 bytes in most texts, between other words: its buckets are split, and the result is that without a split, which is brute force."""
    import random

    from helixmill.llm.suffix_dedup import _keyed, _samples, _settle, hot_cores
    from helixmill.llm import suffix_dedup
    from helixmill.llm._base import arrow
    from pyspark.sql import functions as F

    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, long = noise(150), noise(260)
    texts = [noise(r.randint(60, 120)) + line + noise(r.randint(60, 120)) for _ in range(300)] + [noise(50) + long + noise(50) for _ in range(12)] + [texts_ for texts_ in [noise(400)] * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    keyed = _keyed(docs, 64)
    hot = hot_cores(keyed, one_in=1, least=50)
    assert hot is not None and hot_cores(keyed, one_in=1, least=10_000) is None and hot_cores(keyed, one_in=1, least=50, most=1).count() <= 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        rows = arrow(keyed.select("key", "text"), _samples, suffix_dedup.ROW)
        mark = lambda frame: sorted((x.key, x.place, x.again, x.probe) for x in frame.collect())
        assert mark(_settle(rows, hot)) == mark(_settle(rows))
        largest = lambda by: rows.join(F.broadcast(hot), "core", "left").groupBy(*by).count().agg(F.max("count")).first()[0]
        assert largest(["core"]) > 100 and largest(["core", "full"]) < 30
        got = [sorted((x.doc_id, x.n_removed, x.n_spans, bytes(x.kept)) for x in remove_repeats(docs, **options).collect()) for options in ({}, {"hot_one_in": 1, "hot_least": 20})]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    starts = collections.Counter(t[i : i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    want = []
    for d, t in enumerate(texts):
        gone = [False] * len(t)
        for i in range(len(t) - LENGTH + 1):
            if starts[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = [True] * LENGTH
        want.append((d, sum(gone), sum(g and not b for g, b in zip(gone, [False, *gone])), "".join(c for c, g in zip(t, gone) if not g).encode()))
    assert got[0] == got[1] == want and sum(w[1] > 0 for w in want) >= 15
