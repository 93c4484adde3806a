"""Reference tiles, placed windows, corpus cleaning, and the files they come from, against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import corpus, tiles
from helixmill.plans import scoring
from helixmill.sources import text


def genome(seed=1):
    r = random.Random(seed)
    return {f"chr{k}" if k % 2 else str(k): "".join(r.choice("ACGTN"[: 4 + (r.random() < 0.02)]) for _ in range(n)) for k, n in enumerate((1, 7, 64, 65, 200, 1000), 1)}


def tiled(spark, contigs, tile):
    return tiles.of_sequences(spark.createDataFrame(list(contigs.items()), "contig string, sequence string"), tile=tile)


@pytest.mark.parametrize("tile,width", [(16, 16), (16, 5), (64, 33), (4096, 100)])
def test_spans_across_tiles(spark, tile, width):
    contigs, r = genome(), random.Random(2)
    held = tiled(spark, contigs, tile)
    assert {(c, len(s)) for c, s in contigs.items()} == {tuple(x) for x in tiles.lengths(held).collect()} == {tuple(x) for x in tiles.lengths(tiles.with_halo(held, width, tile=tile)).collect()}
    wanted = [(c, r.randint(0, len(s) + 3), r.randint(1, width)) for c, s in contigs.items() for _ in range(40)] + [("none", 0, 1)]
    rows = tiles.fetch(spark.createDataFrame(wanted, "contig string, at long, n int"), tiles.with_halo(held, width, tile=tile), F.col("at"), F.col("n"), "bases", tile=tile).collect()
    assert collections.Counter((x.contig, x.at, x.n, x.bases) for x in rows) == collections.Counter((c, at, n, contigs.get(c, "")[at : at + n] or None) for c, at, n in wanted)
    assert max(len(x.sequence) for x in tiles.with_halo(held, width, tile=tile).collect()) <= tile + width


def test_halo_is_bounded(spark):
    with pytest.raises(ValueError, match="halo"):
        tiles.with_halo(tiled(spark, {"a": "ACGT"}, 2), 3, tile=2)


def placed_by_hand(variants, contigs, window, least):
    spell = {name.removeprefix("chr"): name for name in contigs}
    out, report, seen = {}, collections.Counter(), set()
    for chrom, pos, ref in variants:
        if chrom not in spell:
            report["missing_contig"] += 1
            continue
        s = contigs[spell[chrom]]
        if s[pos - 1 : pos - 1 + len(ref)] != ref:
            report["ref_mismatch"] += 1
            continue
        start = max(0, min(pos - 1 - window // 2, len(s) - window))
        n = sum(c == chrom and start < p and p - 1 + len(q) <= start + window for c, p, q in variants)
        if n < least:
            report["sparse"] += 1
        elif (chrom, start) in seen:
            report["duplicates"] += 1
        else:
            seen.add((chrom, start))
            report["written"] += 1
            out[f"gnomad:{chrom}:{start + 1}-{start + window}"] = (chrom, start, start + window, s[start : start + window].ljust(window, "A"), n)
    return out, report


def test_placed_windows_are_brute_force(spark):
    contigs, r = genome(3), random.Random(5)
    variants = []
    for name, s in contigs.items():
        for _ in range(60):
            pos = r.randint(1, len(s) + 2)
            ref = s[pos - 1 : pos - 1 + r.choice([1, 1, 1, 3])] if r.random() < 0.8 else "ACGT"[r.randint(0, 3)]
            variants.append((name.removeprefix("chr"), pos, ref or "A"))
    variants += variants[:9] + [("77", 5, "A")]
    frame = spark.createDataFrame(variants, "chrom string, pos long, ref string")
    for least in (1, 3, 9):
        want, report = placed_by_hand(variants, contigs, 32, least)
        placed, counts = scoring.placed_windows(frame, tiled(spark, contigs, 64), window=32, least=least, tile=64)
        rows = placed.collect()
        assert {x.record_id: (x.chrom, x.start_bp, x.end_bp, x.sequence, x.variant_count) for x in rows} == want and len(rows) == len(want)
        assert counts.first().asDict() == {k: report[k] for k in ("written", "duplicates", "sparse", "missing_contig", "ref_mismatch")}


def test_no_plan_holds_a_contig(spark):
    """The longest string next to a variant is a tile and its halo."""
    held = tiles.with_halo(tiled(spark, {"1": "ACGT" * 5000}, 256), 32, tile=256)
    plan = tiles.fetch(spark.range(5).select(F.lit("1").alias("contig"), "id"), held, F.col("id"), 32, "b", tile=256)
    assert plan.count() == 5 and held.agg(F.max(F.length("sequence"))).first()[0] == 288


@pytest.mark.parametrize("lines", [">a\n>b\nACGT\n", ">b\nACGT\n>c\n", ">a\n\n\n>b\nAC\n>c\n\n", ">a\nAC\n>a\nGT\n", ">\nAC\n"])
def test_fasta_without_bases_or_names(spark, tmp_path, lines):
    (tmp_path / "x.fa").write_text(lines)
    with pytest.raises(ValueError, match="contig"):
        text.read_fasta(spark, str(tmp_path / "x.fa"))


def test_fasta_over_splits(spark, tmp_path):
    """Contigs that span many splits of a file, and an empty one whose end is another split's begin."""
    contigs = {k: v for k, v in genome(7).items()}
    body = "".join(f">{k} about\n" + "\n".join(v[i : i + 11].lower() for i in range(0, len(v), 11)) + "\n" for k, v in contigs.items())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        (tmp_path / "x.fa").write_text(body)
        rows = text.read_fasta(spark, str(tmp_path / "x.fa"), tile=50).collect()
        whole = collections.defaultdict(str)
        for x in sorted(rows, key=lambda x: (x.contig, x.start)):
            assert x.start == len(whole[x.contig]) and len(x.sequence) <= 50
            whole[x.contig] += x.sequence
        assert whole == contigs
        for k in range(0, 130, 13):
            (tmp_path / "y.fa").write_text(">q\n" + "A" * k + "\n" + "C" * 64 + "\n>empty\n>z\nAC\n")
            with pytest.raises(ValueError, match="no bases"):
                text.read_fasta(spark, str(tmp_path / "y.fa"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_placed_lines_keep_their_rules(spark, tmp_path):
    import json

    good = {"record_id": "g:1:1-4", "source": "s", "variant_source": "v", "chrom": "1", "start_bp": 0, "end_bp": 4, "sequence": "ACGN", "variant_count": 3}
    bad = [{"end_bp": 5}, {"sequence": "acgn"}, {"chrom": "chr1"}, {"start_bp": -1, "end_bp": 3}, {"variant_count": 0}, {"source": " "}, {"variant_count": None}]
    for k, change in enumerate([{}, *bad]):
        (tmp_path / f"{k}.json").write_text(json.dumps(good | change) + "\n")
        frame = text.read_placed(spark, str(tmp_path / f"{k}.json"))
        if k:
            with pytest.raises(Exception, match="bad placed window"):
                frame.collect()
        else:
            assert frame.first().asDict() == good
    (tmp_path / "more.json").write_text(json.dumps(good | {"extra": 1}) + "\n")
    with pytest.raises(Exception, match="closed schema"):
        text.read_placed(spark, str(tmp_path / "more.json")).collect()


def test_corpus_records(spark):
    rows = [("a", "acgt", "RefSeq-DNA", None), (None, "ACGN", "refseq  dna", None), ("c", None, "refseq dna", "missing_sequence"), ("d", " ", None, "missing_sequence"), ("e", "ACGT", "other", "bad_source"), ("f", "ACGT", None, "bad_source"), ("g", "ACGU", "refseq dna", "bad_sequence")]
    judged = corpus.judged(spark.createDataFrame([x[:3] for x in rows], "record_id string, sequence string, source string"), {"refseq dna": "genome"})
    got = judged.collect()
    assert [x.reason for x in got] == [x[3] for x in rows]
    good = corpus.accepted(judged).collect()
    assert [(x.sequence, x.source) for x in good] == [("ACGT", "genome"), ("ACGN", "genome")] and good[0].record_id == "a" and len(good[1].record_id) == 16
    with pytest.raises(Exception, match="bad record: "):
        corpus.accepted(judged, strict=True).collect()


def test_vcf_files_in_order(spark, tmp_path):
    rows = [(c, p, f"i{p}", "A", "C") for c in ("10", "2", "X") for p in random.Random(1).sample(range(1, 5000), 300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        text.write_vcf(spark.createDataFrame(rows, "chrom string, pos long, id string, ref string, alt string").repartition(6), f"{tmp_path}/v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = [x.value for x in text.numbered_lines(spark, f"{tmp_path}/v").orderBy("at").collect()]
    assert lines[0].startswith("##fileformat") and lines[1].startswith("#CHROM") and len(list((tmp_path / "v").glob("part-*"))) > 1
    assert [tuple(x.split("\t")[:2]) for x in lines[2:]] == [(c, str(p)) for c, p, *_ in sorted(rows, key=lambda x: (["2", "10", "X"].index(x[0]), x[1]))]
