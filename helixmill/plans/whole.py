"""Registered queries on windows, sequences, vectors and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import dna, vectors
from helixmill.operators import intervals, sampling
from helixmill.plans import scoring
from helixmill.plans.extended import _DIGIT, _L2
from helixmill.plans.proxies import read, scored, sequences, variants, windows
from helixmill.registry import query, r


@query(
    "J20_pairwise_mean",
    f"""
select batch, round(avg({_L2}), 6) as mean_distance, count(*) as n from (
  select a.vec_id // 128 as batch, a.embedding::double[] as x, b.embedding::double[] as y
  from embeddings a join embeddings b on a.vec_id // 128 = b.vec_id // 128 and a.vec_id < b.vec_id
) group by batch""",
)
def j20(spark, sf_dir):
    """Every pair of each batch of 128 vectors, as the monitor takes them; a batch bounds its pairs."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id div 128").alias("batch"), F.col("embedding").cast("array<double>").alias("x"))
    other = e.select(F.col("vec_id").alias("other"), "batch", F.col("x").alias("y"))
    met = e.join(other, "batch").where("vec_id < other")
    return met.groupBy("batch").agg(r(F.avg(vectors.l2(F.col("x"), F.col("y")))).alias("mean_distance"), F.count("*").alias("n"))


@query("F12_relative_edit", "select w.id, v.source_row_id, v.pos - 1 - w.start_bp as rel_pos from v join w on v.chrom = w.chrom and w.start_bp < v.pos and v.pos <= w.end_bp", "v", "w")
def f12(spark, sf_dir):
    met = intervals.variants_in_windows(windows(spark, sf_dir), variants(spark, sf_dir))
    return met.select("id", "source_row_id", (F.col("pos") - 1 - F.col("start_bp")).alias("rel_pos"))


@query("J13_overlapping_pairs", "select a.id as l_id, b.id as r_id from w a join w b on a.chrom = b.chrom and a.start_bp < b.end_bp and b.start_bp < a.end_bp and a.id < b.id", "w")
def j13(spark, sf_dir):
    """Every pair of windows that overlap, once."""
    w = windows(spark, sf_dir)
    return intervals.overlapping_pairs(w, w).where("l_id < r_id")


@query("C10_region_overlaps", """
select count(*) as n from (select distinct a.id as l, b.id as r
  from w a join w b on a.chrom = b.chrom and a.start_bp < b.end_bp and b.start_bp < a.end_bp
  where a.chrom in ('20', '21') and a.id <> b.id)""", "w")
def c10_regions(spark, sf_dir):
    """Every window of the held-out chromosomes against every other window."""
    w = windows(spark, sf_dir)
    return intervals.overlapping_pairs(w.where("chrom in ('20', '21')"), w).where("l_id <> r_id").agg(F.count("*").alias("n"))


_KMER = "case when length(k) < 6 or position('N' in k) > 0 then -1 else " + " + ".join(f"{4 ** (6 - i)} * {_DIGIT.format(i)}" for i in range(1, 7)) + " end"


@query("G5_kmer_ids", f"""
select id, len(ids) as n_ids, sha256(coalesce(array_to_string(ids, ','), '')) as ids_sha256
from (select id, list_transform(regexp_extract_all(coalesce(seq, ''), '.{{1,6}}'), lambda k: {_KMER}) as ids
  from dseq)""", "dseq")
def g5(spark, sf_dir):
    """Count and digest of all ids of every sequence."""
    s = sequences(spark, sf_dir).select("id", dna.kmer_ids(F.col("seq")).alias("ids"))
    return s.select("id", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))


@query("G4_pad", "select id, rpad(seq, cast(ceil(length(seq) / cast(6 as double)) * 6 as int), 'A') as padded from dseq", "dseq")
def g4(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", dna.pad_for_tokens(F.col("seq")).alias("padded"))


CAP = 50


@query(
    "T5_stratified_cap",
    f"""
select s.id, s.grp from (select *, row_number() over (partition by grp order by sha256('7:' || cast(id as varchar)), id) as r
  from sl) s join (select grp, count(*) as k, sum(count(*)) over () as total
  from sl group by grp) n on s.grp = n.grp where s.r <= case when n.total <= {CAP} then n.k else greatest(1, round_even(cast({CAP} as double) * n.k / n.total, 0)) end""",
    "sl",
)
def t5(spark, sf_dir):
    """The rows chosen under a cap that all tables exceed."""
    return sampling.stratified_cap(scored(spark, sf_dir), "grp", "id", CAP, "7").select("id", "grp")
