"""Text sources and sinks on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixmill.operators.variants import clinvar_reject, gnomad_reject, prepare
from helixmill.sources import text

GNOMAD = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO
chr1\t10\t.\tA\tC,<DEL>\t.\tPASS\tAF=0.2,0.3;AF_afr=0.1,0.2;FLAG;AF=0.25,0.3
1\t20\t.\tA\tG\t.\tLowQual\tAF=0.5

chr2\t30\t.\tC\t.,T\t.\tPASS\tAF=0.001
chrM\t40\trs1\tA\tc\t.\tPASS\tAF_global=0.4;X=a=b
3\t50\t.\tG\t.\t.\tPASS\tAF=0.4
"""


@pytest.fixture
def vcf(tmp_path):
    path = tmp_path / "x.vcf.gz"
    path.write_bytes(gzip.compress(GNOMAD.encode()))
    return str(path)


def test_gnomad_rows_and_reasons(spark, vcf):
    rows = text.gnomad_rows(text.read_vcf(spark, vcf), ("afr",))
    good, reasons = prepare(rows, gnomad_reject())
    assert sorted((r.chrom, r.pos, r.ref, r.alt, r.af, r.af_afr) for r in good.collect()) == [("1", 10, "A", "C", 0.25, 0.1), ("MT", 40, "A", "C", 0.4, None)]
    assert {r.reason: r.n for r in reasons.collect()} == {"written": 2, "filter": 1, "allele": 1, "af": 1}
    info = {r.pos: r.info for r in rows.where("alt_index = 0").collect()}
    assert info[40]["X"] == "a=b" and info[10]["FLAG"] is None and "FLAG" in info[10]


def test_bad_lines_are_errors(spark, tmp_path):
    for name, line in (("a", "1\tx\t.\tA\tC\t.\tPASS\tAF=1"), ("b", "1\t5\t.\tA"), ("c", "1\t0\t.\tA\tC\t.\tPASS\t.")):
        (tmp_path / name).write_text(line + "\n")
        with pytest.raises(Exception, match="bad VCF line"):
            text.read_vcf(spark, str(tmp_path / name)).collect()
    (tmp_path / "d").write_text("1\t5\t.\tA\tC\n")
    assert text.read_vcf(spark, str(tmp_path / "d"), strict=False).count() == 1


def test_clinvar_classes(spark, tmp_path):
    signs = ["Pathogenic", "Likely_pathogenic", "Benign|Likely_benign", "Uncertain_significance", "drug_response", "Pathogenic/Likely_pathogenic"]
    (tmp_path / "c.vcf").write_text("".join(f"{i + 1}\t{i + 7}\t{i}\tA\tG\t.\t.\tCLNSIG={s};ALLELEID={i + 90},2;GENEINFO=ABC:1|X:2;CLNREVSTAT=ok\n" for i, s in enumerate(signs)) + "9\t9\t.\tA\tA\t.\t.\tCLNVID=5\n")
    good, reasons = prepare(text.clinvar_rows(text.read_vcf(spark, str(tmp_path / "c.vcf"))), clinvar_reject())
    rows = sorted(good.collect(), key=lambda r: r.pos)
    assert [r.cls for r in rows] == ["P", "LP", "LB", "VUS", "OTHER", "LP"] and [r.clinvar_id for r in rows] == list(range(90, 96))
    assert {r.gene_symbol for r in rows} == {"ABC"} and {r.reason: r.n for r in reasons.collect()} == {"written": 6, "allele": 1}


def test_fasta_tiles(spark, tmp_path):
    sequence = "ACGTN" * 33
    lines = [sequence[i : i + 13].lower() for i in range(0, len(sequence), 13)]
    (tmp_path / "x.fa").write_text(">one first\n" + "\n".join(lines) + "\n>two\nAC\n")
    rows = text.read_fasta(spark, str(tmp_path / "x.fa"), tile=32).collect()
    assert "".join(r.sequence for r in sorted(rows, key=lambda r: r.start) if r.contig == "one") == sequence
    assert [r.sequence for r in rows if r.contig == "two"] == ["AC"] and all(len(r.sequence) <= 32 for r in rows)
    (tmp_path / "y.fa").write_text(">a\nAC\n>a\nGT\n")
    with pytest.raises(ValueError):
        text.read_fasta(spark, str(tmp_path / "y.fa"))


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    assert text.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a long, b string", closed=True).count() == 2
    (tmp_path / "y.jsonl").write_text('{"a": 1, "b": "x", "c": 3}\n')
    with pytest.raises(Exception, match="closed schema"):
        text.read_jsonl(spark, str(tmp_path / "y.jsonl"), "a long, b string", closed=True).collect()


def test_genotypes(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# x\nrsid\tchromosome\tposition\tgenotype\nrs1\t1\t10\tAG\nrs2\t23\t20\tCC\nrs3\t1\t30\t--\nrs4\t26\t40\tT\nrs5\t9\t50\tAA\n")
    (tmp_path / "h.csv").write_text('RSID,CHROMOSOME,POSITION,RESULT\n"rs1","1","10","AG"\n')
    calls = text.read_genotypes(spark, str(tmp_path / "g.txt"), "23andme")
    reference = spark.createDataFrame([("1", 10, "A"), ("X", 20, "C"), ("1", 30, "A"), ("MT", 40, "A")], "chrom string, pos long, ref string")
    out = {r.rsid: (r.outcome, r.alt, r.gt) for r in text.genotypes_to_variants(calls, reference).collect()}
    assert out == {"rs1": ("alt", "G", "0/1"), "rs2": ("hom_ref", None, None), "rs3": ("no_call", None, None), "rs4": ("alt", "T", "1"), "rs5": ("no_reference", None, None)}
    assert text.read_genotypes(spark, str(tmp_path / "h.csv"), "myheritage").first().genotype == "AG"


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("X", 5, "b", "A", "C"), ("2", 9, "a", "G", "T"), ("10", 1, None, "G", "T"), ("2", 3, "z", "G", "T")], "chrom string, pos long, id string, ref string, alt string")
    text.write_vcf(rows, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0].startswith("##") and lines[1].startswith("#CHROM") and [x.split("\t")[:2] for x in lines[2:]] == [["2", "3"], ["2", "9"], ["10", "1"], ["X", "5"]]
    assert text.read_vcf(spark, str(tmp_path / "out")).count() == 4
    text.write_jsonl(rows, str(tmp_path / "json"))
    assert '"alt":"T","chrom":"10","id":null,"pos":1' in "".join(r.value for r in spark.read.text(str(tmp_path / "json")).collect())


def test_contig_candidates(spark):
    rows = spark.createDataFrame([("chr1",), ("M",)], "c string").select(text.contig_candidates(F.col("c")).alias("x")).collect()
    assert rows[0].x == ["chr1", "1"] and {"M", "MT", "chrM"} <= {*rows[1].x}
