"""Binned ranks, window counts, synthetic edits, shards, FASTA splits and the runtime against brute force."""

import collections
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixmill.functions.digests import priority
from helixmill.operators import intervals, metrics, ranking, sampling, synthetic
from helixmill.plans import research, scoring
from helixmill.sources import shards, text


@pytest.mark.parametrize("values", ["narrow", "one", "skewed", "text"])
def test_bins_hold_equal_numbers(spark, values):
    """Whatever the values are: all between 1000 and 1001, all the same (ids tell them apart), over many octaves, or digests; bins never fall along the order."""
    r, n = random.Random(1), 20_000
    make = {"narrow": lambda i: 1000 + r.random(), "one": lambda i: 7.0, "skewed": lambda i: r.choice([-1, 1]) * 10 ** r.uniform(-9, 9), "text": lambda i: f"{r.getrandbits(64):016x}"}[values]
    rows = [(i, "g" if i % 10 else "small", make(i)) for i in range(n)]
    frame = spark.createDataFrame(rows, f"id long, g string, v {'string' if values == 'text' else 'double'}").repartition(5).cache()
    found = ranking.binned(frame, ["g"], ["v", "id"], per_bin=2000).collect()
    sizes = collections.Counter(x["_bin"] for x in found if x.g == "g")
    assert len(found) == n and len(sizes) == 9 and max(sizes.values()) < 2 * 2000 and {x["_bin"] for x in found if x.g == "small"} == {0}
    order = [x["_bin"] for x in sorted((x for x in found if x.g == "g"), key=lambda x: (x.v, x.id))]
    assert order == sorted(order)
    assert ranking.binned(frame, ["g"], ["v", "id"], per_bin=n) is None


@pytest.fixture(scope="module")
def ranked(spark):
    """Groups with a null one, heavy ties, one value only, and a group of most rows."""
    r = random.Random(2)
    rows = [(i, r.choice(["a"] * 8 + ["b", None]), r.choice([0.5, 0.5, 0.5, r.random(), -r.random()]), r.randrange(2), r.choice([1.0, 2.0, r.random()])) for i in range(600)] + [(1000 + i, "one", 3.0, i % 2, 1.0) for i in range(5)]
    return rows, spark.createDataFrame(rows, "id long, g string, score double, label int, value double").repartition(5)


@pytest.mark.parametrize("per_bin", [10, 100, 10_000])
def test_running_sums_and_ranks(spark, ranked, per_bin):
    rows, frame = ranked
    got = {x.id: (x.at, x.hits) for x in ranking.running(frame, ["g"], [-F.col("score"), "id"], per_bin=per_bin, at=F.lit(1), hits=F.col("label")).collect()}
    ranks = collections.defaultdict(dict)
    for x in ranking.value_ranks(frame, ["g"], "score", "rank").collect():
        ranks[x.g][x.score] = x.rank
    for g in ("a", "b", None, "one"):
        mine = sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0]))
        hits = 0
        for k, x in enumerate(mine):
            hits += x[3]
            assert got[x[0]] == (k + 1, hits)
        scores = sorted(x[2] for x in mine)
        for s in set(scores):
            at = [i + 1 for i, v in enumerate(scores) if v == s]
            assert ranks[g][s] == sum(at) / len(at)


def test_metrics_of_every_group(spark, ranked):
    rows, frame = ranked
    auroc = {x.g: x.auroc for x in metrics.auroc(frame, ["g"]).collect()}
    ap = {x.g: x.average_precision for x in metrics.average_precision(frame, ["g"]).collect()}
    rho = {x.g: x.spearman for x in metrics.spearman(frame, "score", "value", ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        mine = [x for x in rows if x[1] == g]
        pairs = [(p[2], n[2]) for p in mine if p[3] for n in mine if not n[3]]
        assert abs(auroc[g] - sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)) < 1e-12
        order, hits, total = sorted(mine, key=lambda x: (-x[2], x[0])), 0, 0.0
        for k, x in enumerate(order):
            hits += x[3]
            total += x[3] * hits / (k + 1)
        assert abs(ap[g] - total / hits) < 1e-12
        both = pd.DataFrame(mine, columns=["id", "g", "score", "label", "value"])
        want = both.score.rank().corr(both.value.rank()) if g != "one" else None
        assert rho[g] is None if want is None else abs(rho[g] - want) < 1e-9


def test_seeded_ranks_choose_the_same_rows(spark, ranked):
    rows, frame = ranked
    import hashlib

    sha = lambda i: hashlib.sha256(f"7:{i}".encode()).hexdigest()
    want = {i for g in {x[1] for x in rows} for i in sorted((x[0] for x in rows if x[1] == g), key=lambda i: (sha(i), i))[:4]}
    assert {x.id for x in sampling.first_k_per(frame, ["g"], "id", 4, "7").collect()} == want
    numbers = ranking.seeded_rank(frame, [], priority("7", F.col("id")), "id", "n").collect()
    assert [x.id for x in sorted(numbers, key=lambda x: x.n)] == sorted((x[0] for x in rows), key=lambda i: (sha(i), i))


def test_permutation_p_counts_hits(spark):
    rows = spark.createDataFrame([(i, float(i % 7), int(i >= 90)) for i in range(100)], "id long, score double, label int")
    p = metrics.permutation_p(rows, 30, "7").first().p_value
    assert 1 / 31 <= p <= 1 and metrics.permutation_p(rows.withColumn("score", F.col("label") * 5.0), 30, "7").first().p_value == 1 / 31


def test_window_counts_are_the_pairs(spark):
    r = random.Random(3)
    windows = [(i, r.choice("12"), s, s + r.choice([1, 64, 100, 4096, 30_000])) for i in range(200) for s in [r.randrange(40_000)]]
    variants = [(r.choice("123"), r.choice([r.randrange(1, 60_000), 8192, 8193, 4096]), r.choice(["A", "A", "ACG"])) for _ in range(3000)]
    w, v = spark.createDataFrame(windows, "id long, chrom string, start_bp long, end_bp long"), spark.createDataFrame(variants, "chrom string, pos long, ref string")
    want = {i: n for i, c, s, e in windows if (n := sum(c == d and s < p <= e and p - 1 + len(x) <= e for d, p, x in variants))}
    assert {x.id: x.n for x in intervals.window_counts(w, v).collect()} == want
    assert {x.id: x.n for x in intervals.window_counts(w, v).collect()} == want
    assert intervals.window_counts(w, v.where("pos < 0")).count() == 0


def test_synthetic_edits_fit_their_sequence(spark):
    r = random.Random(5)
    seqs = {i: "".join(r.choice("ACGTN" if i % 3 == 0 else "ACGT") for _ in range(r.choice([100, 160, 900]))) for i in range(40)} | {99: "N" * 500}
    rows = spark.createDataFrame(list(seqs.items()), "id long, seq string")
    for kind, make in (("snv", synthetic.snvs), ("mnv", synthetic.mnvs), ("indel", synthetic.indels)):
        got = make(rows, 3, "s").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, make(rows.repartition(7), 3, "s").collect()))
        assert {x.id for x in got} <= {i for i, s in seqs.items() if len(s) >= 144} - {99} and len(got) > 30
        for x in got:
            s = seqs[x.id]
            assert s[x.rel_pos : x.rel_pos + len(x.ref)] == x.ref and "N" not in x.ref and 64 <= x.rel_pos <= len(s) - 64
            if kind == "indel":
                assert len(x.ref) != len(x.alt) and x.ref[0] == x.alt[0]
            else:
                assert len(x.ref) == len(x.alt) and all(a != b for a, b in zip(x.ref, x.alt))
    found = synthetic.distractors(rows, 4, "s").collect()
    for i in {x.id for x in found}:
        mine = [x.sequence for x in found if x.id == i]
        assert len({*mine, seqs[i]}) == len(mine) + 1 and len(mine) <= 4


def test_shards_refuse_other_schemas(spark, tmp_path):
    rows = spark.createDataFrame([("1", 5, "A", "C", "P")], "chrom string, pos long, ref string, alt string, clinical_significance string")
    shards.write_shard(rows, f"{tmp_path}/a", shards.CLINVAR)
    assert shards.read_shard(spark, f"{tmp_path}/a", shards.CLINVAR).count() == 1
    with pytest.raises(ValueError, match="schema"):
        shards.read_shard(spark, f"{tmp_path}/a", shards.GNOMAD)
    shards.shaped(rows, shards.CLINVAR).withColumn("schema_version", F.lit("0")).write.parquet(f"{tmp_path}/b")
    with pytest.raises(ValueError, match="version"):
        shards.read_shard(spark, f"{tmp_path}/b", shards.CLINVAR)
    shards.write_shard(rows.limit(0), f"{tmp_path}/c", shards.CLINVAR)
    assert shards.read_shard(spark, f"{tmp_path}/c", shards.CLINVAR).count() == 0


def test_fasta_across_splits(spark, tmp_path):
    """Contigs that begin, end and run on anywhere in a file cut into many splits."""
    r = random.Random(6)
    contigs = {f"c{k}": "".join(r.choice("ACGTN") for _ in range(r.choice([1, 30, 700, 5000]))) for k in range(12)}
    lines = [x for name, s in contigs.items() for x in (f">{name} of {len(s)}", *(s[i : i + 50] for i in range(0, len(s), 50)))]
    (tmp_path / "x.fa").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = text.read_fasta(spark, str(tmp_path / "x.fa"), tile=128).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {c: "".join(x.sequence for x in sorted(rows, key=lambda x: x.start) if x.contig == c) for c in contigs}
    assert got == contigs and all(x.start % 128 == 0 and len(x.sequence) <= 128 for x in rows)


def test_cache_is_built_once_per_key(spark, tmp_path):
    path = f"{tmp_path}/cache"
    encode = lambda s: pd.Series([[float(len(x))] for x in s])
    rows = spark.createDataFrame([("a", "AC"), ("a", "AC"), ("b", "GTT")], "window_hash string, sequence string")
    for part in (rows.where("window_hash = 'a'"), rows, rows):
        scoring.build_cache(part, path, encode)
    assert sorted((x.window_hash, x.state[0]) for x in spark.read.parquet(f"{path}/*").collect()) == [("a", 2.0), ("b", 3.0)]


def test_logistic_probe_is_its_optimum(spark):
    r = random.Random(7)
    rows = [(x, z, int(r.random() < 1 / (1 + math.exp(-(0.8 * x - 0.5 * z + 0.2))))) for _ in range(800) for x in [r.gauss(0, 1)] for z in [r.gauss(0, 2)]]
    w = research.logistic_probe(spark.createDataFrame(rows, "x double, z double, y int"), ["x", "z"], "y")
    gradient = [sum((y - 1 / (1 + math.exp(-(w[0] * x + w[1] * z + w[2])))) * v for x, z, y in rows for v in [(x, z, 1.0)[k]]) for k in range(3)]
    assert max(map(abs, gradient)) < 1e-6 and w[0] > 0 > w[1]


def test_tuples_are_drawn_by_ordinals(spark):
    """Without replacement, among edits whose REF lies inside; long REFs that stick out of a window are never drawn, and the numbers drawn are those of Floyd's algorithm."""
    import hashlib

    r = random.Random(8)
    windows = [(i, r.choice("12"), s, s + r.choice([40, 64])) for i, s in enumerate(r.sample(range(0, 900), 60))] + [(99, None, 0, 64)]
    edits = [(r.choice("12"), p, "ACGTACGT"[: r.choice([1, 1, 1, 2, 5, 8])], r.choice(["gnomad", "clinvar"]), k) for k, p in enumerate(r.choices(range(1, 960), k=700))]
    quota = {"gnomad": 3, "clinvar": 2, "snv": 1}
    frames = spark.createDataFrame(windows, "id long, chrom string, start_bp long, end_bp long"), spark.createDataFrame(edits, "chrom string, pos long, ref string, edit_source string, source_row_id long").repartition(4)
    got = collections.defaultdict(dict)
    for x in scoring.sampled_edits(*frames, seed="s", quota=quota).collect():
        got[x.id, x.edit_source][x.slot] = (x.source_row_id, x.rel_pos)
    for i, chrom, start, end in windows:
        for source in ("gnomad", "clinvar"):
            pool = sorted((p, k) for c, p, ref, s, k in edits if c == chrom and s == source and start < p and p - 1 + len(ref) <= end)
            taken, m = [], min(quota[source], len(pool))
            for j in range(m):
                last = len(pool) - m + j
                t = int(hashlib.sha256(f"s:{i}:{source}:{j}".encode()).hexdigest()[:15], 16) % (last + 1)
                taken.append(last if t in taken else t)
            assert got.get((i, source), {}) == {j + 1: (pool[t][1], pool[t][0] - 1 - start) for j, t in enumerate(taken)}


def test_window_counts_with_far_positions(spark):
    """A wild position makes no rows between it and the others, and points on an edge belong to the window that ends there."""
    windows = spark.createDataFrame([(1, "1", 0, 10), (2, "1", 10, 20), (3, "1", 10**14, 10**14 + 5), (4, "2", 0, 10**15), (5, None, 0, 10)], "id long, chrom string, start_bp long, end_bp long")
    variants = spark.createDataFrame([("1", 10, "A"), ("1", 11, "A"), ("1", 20, "A"), ("1", 10**14 + 5, "A"), ("1", 10**14 + 6, "A"), ("2", 5, "A"), ("2", 5, "A")], "chrom string, pos long, ref string")
    assert {x.id: x.n for x in intervals.window_counts(windows, variants).collect()} == {1: 1, 2: 2, 3: 1, 4: 2}


@pytest.mark.parametrize("whole", [0, 10**6])
def test_quantiles_are_exact(spark, whole):
    """Against sorted values, with ties, one value, nulls, a null group, and brackets that bind."""
    import numpy as np

    from helixmill.operators.quantiles import quantiles

    r = random.Random(3)
    groups = {"ties": [float(r.randrange(5)) for _ in range(700)], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-8, 8) for _ in range(3000)], "one": [4.0], "same": [2.5] * 400, None: [r.random() for _ in range(50)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("nothing", None)]
    shares = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.95, "e": 1.0}
    frame = spark.createDataFrame(rows, "g string, v double").repartition(4)
    for accuracy in (50, 10_000):
        got = {x.g: x for x in quantiles(frame, ["g"], "v", shares, accuracy=accuracy, whole=whole).collect()}
        assert set(got) == {*groups, "nothing"} and got["nothing"].c is None
        for g, vs in groups.items():
            for name, q in shares.items():
                assert got[g][name] == pytest.approx(np.quantile(vs, q), rel=1e-12)
    assert quantiles(frame.where("g = 'ties'"), [], "v", {"m": 0.5}).first().m == float(np.quantile(groups["ties"], 0.5))


@pytest.mark.parametrize("bin_rows", [8, 1000])
def test_bootstrap_draws_as_many_as_there_are(spark, bin_rows):
    """In each replicate and stratum; the draws are uniform, and those of the hashes."""
    rows = [(i * 3, int(i % 5 == 0), float(i)) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, label int, score double").repartition(3)
    drawn = metrics.resampled(frame, 50, "s", ["label"], ["score"], bin_rows=bin_rows).collect()
    assert collections.Counter((x.replicate, x.label) for x in drawn) == {(b, k): 24 if k else 96 for b in range(50) for k in (0, 1)}
    assert all((x.score % 5 == 0) == bool(x.label) for x in drawn)
    often = collections.Counter(x.score for x in drawn)
    assert len(often) == 120 and 25 < min(often.values()) and max(often.values()) < 80
    plain = metrics.resampled(frame, 5, "s", [], ["label", "score"], bin_rows=bin_rows).collect()
    assert collections.Counter(x.replicate for x in plain) == dict.fromkeys(range(5), 120)
    aurocs = [x.auroc for x in metrics.bootstrap_auroc(frame, 20, "s", bin_rows=bin_rows).collect()]
    assert len(aurocs) == 20 and len(set(aurocs)) > 10 and abs(sum(aurocs) / 20 - 0.48) < 0.1


def test_calibration_counts_each_place(spark):
    """Equal to a count of values up to each grid point, with values on grid points, ties, and a bucket of one value."""
    from helixmill.operators import calibration

    r = random.Random(6)
    buckets = {"a": [r.random() for _ in range(500)], "grid": [i / 10 for i in range(11) for _ in range(3)], "one": [0.3] * 4, "thirds": [i / 3 for i in range(31)]}
    frame = spark.createDataFrame([(b, v) for b, vs in buckets.items() for v in vs], "bucket_id string, value double")
    for x in calibration.calibrate(frame, 31).collect():
        vs = buckets[x.bucket_id]
        assert x.n_calibration == len(vs) and x.sigma_grid[-1] == max(vs) and len(x.cdf) == 31
        assert list(x.cdf) == [sum(v <= p for v in vs) / len(vs) for p in x.sigma_grid]


def test_permutations_are_brute_force(spark):
    import hashlib

    r = random.Random(2)
    rows = [(i, float(r.randrange(9)), int(r.random() < 0.3)) for i in range(300)]
    m, seen = sum(x[2] for x in rows), sum(x[1] for x in rows if x[2])
    hits = sum(sum(s for _, s in sorted((hashlib.sha256(f"7:{k}:{i}".encode()).hexdigest(), s) for i, s, _ in rows)[:m]) >= seen for k in range(40))
    for digits in (1, 3):
        assert metrics.permutation_p(spark.createDataFrame(rows, "id long, score double, label int"), 40, "7", digits=digits).first().p_value == (hits + 1) / 41
