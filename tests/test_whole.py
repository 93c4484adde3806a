"""Queries on whole tables against brute force; their SQL is compared in test_oracle.py."""

import collections
import hashlib
import math
import random

import pytest

from helixmill.plans.whole import CAP
from helixmill.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """300 vectors, and 240 windows and 900 variants that meet, of ids with every residue."""
    folder, r = tmp_path_factory.mktemp("whole"), random.Random(3)
    vectors = [(i, [r.random() for _ in range(4)], r.randrange(2)) for i in range(300)]
    orders = [(5 * i, r.randrange(40)) for i in range(240)]
    lines = [(r.randrange(1200), r.randrange(40), r.randrange(9), k % 7, float(r.randrange(50)), r.random() / 10, r.choice("ARN")) for k in range(900)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    windows = [(i, c % 22 + 1, i * 8 - i * 8 % 64) for i, c in orders]
    return str(folder), vectors, windows, lines


def test_every_batch_of_vectors(spark, tables):
    folder, vectors, *_ = tables
    want = collections.defaultdict(list)
    for i, x, _ in vectors:
        for j, y, _ in vectors[:i]:
            if i // 128 == j // 128:
                want[i // 128].append(math.dist(x, y))
    got = {x.batch: (x.mean_distance, x.n) for x in QUERIES["J20_pairwise_mean"](spark, folder).collect()}
    assert got.keys() == want.keys() == {0, 1, 2}
    assert all(got[k][1] == len(d) and abs(got[k][0] - sum(d) / len(d)) < 1e-5 for k, d in want.items())


def test_every_window(spark, tables):
    folder, _, windows, lines = tables
    edits = [(p % 22 + 1, o * 8 + n) for o, p, _, n, *_ in lines]
    want = sorted((i, pos, pos - 1 - s) for i, c, s in windows for chrom, pos in edits if c == chrom and s < pos <= s + 4096)
    assert sorted(map(tuple, QUERIES["F12_relative_edit"](spark, folder).collect())) == want and len({x[0] % 16 for x in want}) == 16
    pairs = sorted((i, j) for i, c, s in windows for j, d, t in windows if i < j and c == d and s < t + 4096 and t < s + 4096)
    assert sorted(map(tuple, QUERIES["J13_overlapping_pairs"](spark, folder).collect())) == pairs and pairs
    chrom = {i: c for i, c, _ in windows}
    assert QUERIES["C10_region_overlaps"](spark, folder).first().n == 2 * sum(chrom[i] in (20, 21) for i, _ in pairs)


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder, r = tmp_path_factory.mktemp("documents"), random.Random(4)
    rows = [(i, "".join(r.choice("abcdefghz .") for _ in range(r.choice((0, 5, 70, 9000)))), "abc"[min(2, r.randrange(9))], "s", r.randrange(900)) for i in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, i % 3) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def test_every_base(spark, documents):
    folder, rows = documents
    letters = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAN")
    ids, padded = {}, {}
    for i, text, *_ in rows:
        seq = "".join(x for x in text if x.isalpha()).upper().translate(letters)
        kmers = [seq[k : k + 6] for k in range(0, len(seq), 6)]
        known = [int("".join(str("ATCG".index(x)) for x in k), 4) if len(k) == 6 and "N" not in k else -1 for k in kmers]
        ids[i] = (len(known), hashlib.sha256(",".join(map(str, known)).encode()).hexdigest())
        padded[i] = seq + "A" * (-len(seq) % 6)
    assert {x.id: (x.n_ids, x.ids_sha256) for x in QUERIES["G5_kmer_ids"](spark, folder).collect()} == ids
    assert {x.id: x.padded for x in QUERIES["G4_pad"](spark, folder).collect()} == padded and max(map(len, padded.values())) > 3000


def sha(ident):
    return hashlib.sha256(f"7:{ident}".encode()).hexdigest()


def test_a_cap_that_binds(spark, documents):
    folder, rows = documents
    groups = collections.defaultdict(list)
    for i, _, lang, *_ in rows:
        groups[lang].append(i)
    want = {(i, g) for g, ids in groups.items() for i in sorted(ids, key=lambda i: (sha(i), i))[: max(1, round(CAP * len(ids) / len(rows)))]}
    assert {(x.id, x.grp) for x in QUERIES["T5_stratified_cap"](spark, folder).collect()} == want and len(want) < len(rows)


def test_tuples_are_drawn(spark, tables):
    folder, _, windows, lines = tables
    edits = [(p % 22 + 1, o * 8 + n, "clinvar" if flag == "R" else "gnomad") for o, p, _, n, *_, flag in lines]
    real, made = [], []
    for i, c, s in windows:
        for source, want in {"gnomad": 3, "clinvar": 3, "snv": 1, "indel": 1}.items():
            inside, taken = sorted(pos for chrom, pos, x in edits if chrom == c and x == source and s < pos <= s + 4096), []
            for k in range(min(want, len(inside))):  # Floyd's algorithm
                last = len(inside) - min(want, len(inside)) + k
                t = int(sha(f"{i}:{source}:{k}")[:15], 16) % (last + 1)
                taken.append(last if t in taken else t)
            real += [(i, source, inside[t], inside[t] - 1 - s, k + 1) for k, t in enumerate(taken)]
            made += [(i, "indel" if source == "indel" else "snv", k + 1) for k in range(len(taken), want)]
    got = QUERIES["C6_training_tuples"](spark, folder).collect()
    assert sorted(tuple(x) for x in got if x.source_row_id is not None) == sorted(real) and real
    assert sorted((x.id, x.edit_source, x.slot) for x in got if x.source_row_id is None) == sorted(made) and made
    assert all(64 <= x.rel_pos < 4032 for x in got if x.source_row_id is None) and len(got) == 8 * len(windows)
