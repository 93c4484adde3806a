import collections

import corpus_pipeline
from samples import SCHEMA, cases, words


def test_stages_take_effect(spark, tmp_path):
    rows = [r for r in cases() if r[0] is not None] + [(100 + i, words(100 + i, 80), "en", f"s{i % 3}", 0) for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append([r.doc_id for r in docs.collect()])
    language, exact, near, mixed, coded = seen
    assert {4, 5, 6, 9} & {*language} == set() and {0, 1, 2, 3, 7, 8} <= {*language}
    assert {0, 1} & {*exact} == set() and 2 in exact  # the longest of equal texts stays
    assert exact.count(10) == 1  # one of two rows that are alike
    assert {*near} <= {*exact} and 3 not in near and {7, 8} & {*near} == {7}
    assert {*mixed} <= {*near} and max(collections.Counter(mixed).values()) <= 3 and len(exact) == len({*exact})
    assert sorted(coded) == sorted(mixed)
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in ran.collect()) == sorted(coded)


def test_stages_leave_only_ids(spark):
    """Called one by one, the stages that look for ids leave these alone in the shared folder."""
    from helixmill.llm._base import tables

    docs = spark.createDataFrame([r for r in cases() if r[0] is not None], SCHEMA).dropDuplicates(["doc_id"])
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mixing):
        before = len(tables())
        assert stage(spark, docs, "").count()
        assert {path.rsplit("/", 1)[1].split("-")[0] for path in tables()[before:]} == {"ids", "twice"}


def kept(spark, stage, docs):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in stage(spark, docs, "").collect())


def test_rows_with_repeated_or_no_doc_id(spark):
    """Rows are judged by their texts: none is dropped because of its id, and extra columns with the names of inner ones stay."""
    texts = [words(k, 60) for k in range(6)]
    near_copy = " ".join(texts[0].split()[:-1] + ["changed"])
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (None, near_copy), (3, texts[4]), (1 << 40, texts[5])]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA)
    names = ("_text", "text_", "_held_out", "held_out", "lang_pred", "score", "_times", "times", "copy", "_copy", "own_id", "OWN_ID_", "size", "kept", "key", "taken", "row", "salt", "n")
    docs = frame.selectExpr("*", *(f"'{n}' as `{n}`" for n in names))
    assert kept(spark, corpus_pipeline.language_id, docs) == sorted((-1 if d is None else d, t) for d, t in rows)
    # of equal texts the one with a doc_id of its own stays
    exact = [(1, texts[0]), (2, texts[1]), (-1, texts[2]), (-1, texts[3]), (-1, near_copy), (3, texts[4]), (1 << 40, texts[5])]
    assert kept(spark, corpus_pipeline.exact, docs) == sorted(exact)
    near = [x for x in exact if x[1] not in (near_copy, texts[0])]
    got = kept(spark, corpus_pipeline.near, docs)
    assert [x for x in got if x[1] not in (near_copy, texts[0])] == sorted(near) and len(got) == len(near) + 1
    everything = collections.Counter(kept(spark, corpus_pipeline.mixing, docs))
    assert everything == collections.Counter((-1 if d is None else d, t) for d, t in rows)  # one source: each document once
    for stage in (corpus_pipeline.language_id, corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mixing):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all(r[n] == n for r in out.collect() for n in names)
    crowded = frame.withColumn("doc_id", frame.doc_id + (1 << 62))
    assert len(kept(spark, corpus_pipeline.exact, crowded)) == len(exact)
    unnamed = frame.selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars")
    assert len(kept(spark, corpus_pipeline.exact, unnamed)) == len(exact)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def near_by_hand(rows, percent):
    """Of each component of texts with 100 * shared >= percent * all shingles, the row of the least doc_id."""
    import re

    def shingles(text):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, up = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root(a) != root(b):
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [r for r in rows if root(r[0]) == r[0]]


def test_pipeline_is_brute_force(spark, tmp_path):
    """Each stage's rows from the one before, by plain Python: letters, equal texts, linked texts, shares of the mix, and tokens by another library."""
    import hashlib
    import random
    import re
    import struct

    import pytest

    tiktoken, public_tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    from helixmill.llm._base import tables
    from helixmill.llm.bpe import read_ranks
    from helixmill.llm.queries import VOCABULARY

    r, texts = random.Random(31), []
    for k in range(40):
        w = words(500 + k, r.randint(30, 160)).split()
        texts.append(" ".join(w))
        for _ in range(r.randint(0, 3)):
            v = w.copy()
            for _ in range(r.choice([0, 0, 1, 2, 6, 12])):
                v[r.randrange(len(v))] = f"new{r.random()}"
            texts.append(r.choice([" ", "\n", "  "]).join(v))
    texts += ["123 456", "", None, "... !!", "one", "ONE", "o n e"]
    rows = [(d, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "b", None]), len(t or "")) for d, t in zip(r.sample(range(10_000), len(texts)), texts, strict=True)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    docs, results = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        results.append([tuple(x) for x in docs.collect()])
    by_id = lambda rows: sorted(rows, key=lambda x: x[0])
    language, exact, near, mixed, coded = results
    assert by_id(language) == by_id(x for x in rows if x[1] and any(c.isalpha() for c in x[1]))
    groups = collections.defaultdict(list)
    for x in language:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", x[1])].append(x)
    assert by_id(exact) == by_id(min(g, key=lambda x: (-len(x[1]), x[0])) for g in groups.values())
    assert by_id(near) == by_id(near_by_hand(exact, 80)) and len(near) < len(exact) < len(language)
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[1]))
    whole, drawn, copies = collections.Counter(), collections.Counter(), collections.Counter(x[0] for x in mixed)
    for x in near:
        whole[x[3]] += size(x)
    for x in mixed:
        drawn[x[3]] += size(x)
    assert {x for x in mixed} <= {x for x in near} and max(copies.values()) <= 3
    weights = dict(zip([*sorted(s for s in whole if s), None], (1, 2, 3), strict=True))
    level = sum(whole.values()) / sum(weights.values())
    assert all(level * weights[s] < 3 * whole[s] for s in whole)  # no target is cut
    assert all(abs(drawn[s] - level * weights[s]) < 0.15 * level * weights[s] + 160 for s in whole)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(VOCABULARY)), special_tokens={})
    want = []
    for x in mixed:
        ids = other.encode_ordinary(x[1])
        want.append((x[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(x[1].encode()).hexdigest()))
    assert sorted(coded) == sorted(want)

    before = len(tables())
    assert sorted(tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(want)
    assert len(tables()) <= before + 1  # of all tables the run wrote, the last stage's input is left
