"""Registered queries: parsing, cache selection, edits in sequence, schedules, folds, leakage and commitments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from helixmill.functions import dna
from helixmill.operators import calibration, intervals, metrics, ranking
from helixmill.plans import forest, research
from helixmill.plans.proxies import keyed_variants, read, scored, sequences, variants, vectors as pairs, windows, with_views
from helixmill.registry import query, r
from helixmill.sources import text


@query("S1_S3_vcf_parse", """
select source_row_id, chrom, pos, ref, alt, af, flt as filter
from v where alt <> 'A' union all select source_row_id, chrom, pos, ref, 'ACGT', af, flt
from v""", "v")
def s1(spark, sf_dir):
    """Lines with a dropped ALT (.), one to three ALTs, per-ALT and shared AF lists, a flag and a repeated key."""
    v = variants(spark, sf_dir)
    alts = F.when(F.col("alt") == "A", F.lit(".,acgt")).otherwise(F.concat(F.lower("alt"), F.lit(",acgt")))
    af = F.col("af").cast("string")
    info = F.concat(F.lit("DB;AF=9;AF="), F.when(F.col("source") == "R", F.concat(af, F.lit(","), af)).otherwise(af), F.lit(";X=a=b"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string"), F.col("source_row_id").cast("string"), F.lower("ref"), alts, F.lit("."), "filter", info)
    rows = text.gnomad_rows(text.parse_vcf(v.select(line.alias("value"))))
    return rows.select(F.col("id").cast("long").alias("source_row_id"), "chrom", "pos", "ref", "alt", "af", "filter")


@query("S14_S15_cache_versions", """
select l_partkey as k, l_linenumber as ordinal, case when p_partkey is null then null when p_size % 2 = 0 then 3 else 2 end as version
from lineitem left join (select * from part where p_size <= 40) on p_partkey = l_partkey""")
def s14(spark, sf_dir):
    """prefer_v3: each request gets the newest version of its key, or null."""
    p = read(spark, sf_dir, "part").where("p_size <= 40")
    old = p.select(F.col("p_partkey").alias("k"), F.lit(2).alias("version"))
    cache = old.unionByName(p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("k"), F.lit(3).alias("version")))
    newest = cache.groupBy("k").agg(F.max("version").alias("version"))
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("ordinal")).join(newest, "k", "left")


@query("S21_whitespace_table", "select l_orderkey as a, l_returnflag as b, l_quantity as c from lineitem")
def s21(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("  "), F.col("l_orderkey").cast("string"), F.lit(" \t"), "l_returnflag", F.lit("   "), F.col("l_quantity").cast("string"), F.lit(" ")).alias("value"))
    f = F.split(F.trim("value"), r"\s+")
    return lines.select(F.get(f, F.lit(0)).cast("long").alias("a"), F.get(f, F.lit(1)).alias("b"), F.get(f, F.lit(2)).try_cast("double").alias("c"))


@query("F1_supported_allele", "select source_row_id, source_row_id % 5 in (0, 1) as ok from v", "v")
def f1(spark, sf_dir):
    odd = F.element_at(F.array(F.lit("ACGT"), F.col("ref"), F.lit("N"), F.lit(""), F.repeat("ref", F.lit(17))), (F.col("source_row_id") % 5 + 1).cast("int"))
    return variants(spark, sf_dir).select("source_row_id", dna.supported_allele(odd).alias("ok"))


@query("F10_strict_key", "select source_row_id, source_row_id % 2 = 0 as canonical from vk", "vk")
def f10(spark, sf_dir):
    key = F.when(F.col("source_row_id") % 2 == 0, F.col("variant_key")).otherwise(F.concat(F.lit("GRCh38:chr"), F.substring("variant_key", 8, 100)))
    parts = F.split(key, ":")
    item = lambda i: F.get(parts, F.lit(i))
    t = dna.trimmed(item(2).try_cast("bigint"), item(3), item(4))
    again = dna.variant_key(item(0), dna.closed_chrom(item(1)), t["pos"], t["ref"], t["alt"])
    return keyed_variants(spark, sf_dir).select("source_row_id", ((F.size(parts) == 5) & (again == key)).alias("canonical"))


@query("J13_C10_leakage", """
select a.role as left_role, b.role as right_role, count(*) as shared
from (select distinct role, ref || alt || source as k from vk) a
join (select distinct role, ref || alt || source as k from vk) b on a.k = b.k and a.role < b.role
group by 1, 2""", "vk")
def c10(spark, sf_dir):
    keys = keyed_variants(spark, sf_dir).select("role", F.concat("ref", "alt", "source").alias("k")).distinct()
    other = keys.select(F.col("role").alias("right_role"), "k")
    return keys.join(other, "k").where("role < right_role").groupBy(F.col("role").alias("left_role"), "right_role").agg(F.count("*").alias("shared"))


@query("A15_sparse_buckets", """
select grp as bucket_id, count(*) as n, case when count(*) < 60 then 'backs_off' else 'low_confidence' end as warning
from sl group by grp having count(*) < 100""", "sl")
def a15(spark, sf_dir):
    per = scored(spark, sf_dir).groupBy(F.col("grp").alias("bucket_id")).agg(F.count("*").alias("n")).where("n < 100")
    return per.withColumn("warning", F.when(F.col("n") < 60, "backs_off").otherwise("low_confidence"))


@query("A29_prior_baseline", """
select grp, round(avg(label), 6) as prior, round(avg(power(label - p, 2)), 6) as brier
from (select *, avg(label) over () as p from sl) group by grp""", "sl")
def a29(spark, sf_dir):
    s = scored(spark, sf_dir)
    prior = s.agg(F.avg("label").alias("p"))
    return s.join(F.broadcast(prior)).groupBy("grp").agg(r(F.avg("label")).alias("prior"), r(F.avg(F.pow(F.col("label") - F.col("p"), F.lit(2.0)))).alias("brier"))


_A21 = """select fold, i, round((sum(s1) over (partition by i) - s1) / (sum(n1) over (partition by i) - n1) - (sum(s0) over (partition by i) - s0) / (sum(n0) over (partition by i) - n0), 6) as direction
 from (select fold, i, sum(case when label = 1 then v else 0 end) as s1, sum(case when label = 0 then v else 0 end) as s0, count(*) filter (label = 1) as n1, count(*) filter (label = 0) as n0
 from (select id % 5 as fold, split % 2 as label, unnest(x) as v, unnest(range(64)) as i from e) group by 1, 2)"""


@query("A21_fold_directions", _A21, "e")
def a21(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("id", (F.col("id") % 5).alias("fold"), (F.col("split") % 2).alias("label"), "x")
    return research.fold_directions(rows).select("fold", F.col("i").cast("long").alias("i"), r("direction").alias("direction"))


@query("A22_explained_variance")
def a22(spark, sf_dir):
    shares = research.explained_variance(pairs(spark, sf_dir), "x", 64)
    total = np.cumsum(shares)
    return spark.createDataFrame([(int(np.searchsorted(total, q)) + 1, q) for q in (0.5, 0.9)], "components int, share double")


_COVARIANCE = """
select a.i, b.i as j, avg(a.v * b.v) - avg(a.v) * avg(b.v) as c from (select id, unnest(x) as v, unnest(range(64)) as i from e) a
join (select id, unnest(x) as v, unnest(range(64)) as i from e) b on a.id = b.id group by a.i, b.i"""


@query("A22_spectrum_moments", f"""
select round(sum(c) filter (i = j), 6) as variance, round(power(sum(c) filter (i = j), 2) / sum(c * c), 4) as effective_components
from ({_COVARIANCE})""", "e")
def a22_moments(spark, sf_dir):
    """From the eigenvalues of all 64 components: their sum, and the square of the sum over the sum of squares. (SQL has these from the matrix: its trace, and the sum of its squared cells.)"""
    values = research.eigenvalues(pairs(spark, sf_dir), "x", 64)
    return spark.createDataFrame([(round(float(values.sum()), 6), round(float(values.sum() ** 2 / (values**2).sum()), 4))], "variance double, effective_components double")


#: SQL: elimination of all 64 columns, one a step; the pivots' logarithms sum up to that of the determinant.
_PIVOTS = f"""
recursive_steps as (
  select 0 as k, i, j, c from ({_COVARIANCE})
  union all
  select k + 1, i, j, c - max(case when j = k then c end) over (partition by i) * max(case when i = k then c end) over (partition by j) / max(case when i = k and j = k then c end) over () from recursive_steps where k < 63 and i >= k and j >= k
)"""


@query(
    "G22_gaussian_kl",
    with_views("e").replace("with ", "with recursive ", 1).rstrip()
    + f""",{_PIVOTS}
select round(0.5 * (t.trace + m.squares - 64 - d.logs), 4) as kl from (select sum(c) filter (i = j) as trace from ({_COVARIANCE})) t,
  (select sum(power(v, 2)) as squares from (select avg(v) as v from (select unnest(x) as v, unnest(range(64)) as i from e) group by i)) m, (select sum(ln(c)) as logs from recursive_steps where i = k and j = k) d""",
)
def g22(spark, sf_dir):
    """All 64 components, from the eigenvalues; SQL eliminates columns and takes the pivots."""
    return spark.createDataFrame([(round(research.gaussian_kl(pairs(spark, sf_dir), "x", 64), 4),)], "kl double")


@query("A29_forest_residual")
def a29_forest(spark, sf_dir):
    """A logistic baseline on three features, fitted on two thirds of the rows, and a forest on what it misses; of the other third: baseline, residual adjustment and their clamped sum."""
    s = scored(spark, sf_dir).withColumn("x", F.array(F.col("score"), F.col("value"), F.col("other").cast("double")))
    train = s.where("id % 3 <> 0").withColumns({"u": F.col("score") / 50, "w": F.col("value") / 5000})
    weights = research.logistic_probe(train, ["u", "w", "other"], "label", lam=1.0)
    odds = F.lit(float(weights[0])) * F.col("score") / 50 + F.lit(float(weights[1])) * F.col("value") / 5000 + F.lit(float(weights[2])) * F.col("other") + F.lit(float(weights[3]))
    base = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
    model = forest.fit(train.select("id", "x", (F.col("label") - base).alias("y")), 3, trees=20, depth=3, least=20, seed="7")
    held = forest.predict(s.where("id % 3 = 0").withColumn("baseline", base), model, "adjustment")
    return held.select("id", r("baseline").alias("baseline"), r("adjustment").alias("adjustment"), r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("baseline") + F.col("adjustment")))).alias("residual"))


@query("C12_predictability")
def c12_predictability(spark, sf_dir):
    """Displacements between successive vectors; a label's vectors are one group, held out together."""
    e = pairs(spark, sf_dir)
    action = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: (k == F.col("id") % 12).cast("double"))
    rows = e.select("id", (F.col("split") % 5).alias("fold"), (F.col("id") % 12).alias("cls"), (F.col("id") % 2).cast("int").alias("label"), F.col("x").alias("s"), action.alias("a"), F.zip_with("y", "x", lambda p, q: p - q).alias("d"))
    found = research.predictability(rows, 64, 12, lam=10.0)
    return found.select("predictor", "n", r("mean_cosine", 5).alias("mean_cosine"), r("error", 5).alias("error"), r("auroc", 5).alias("auroc"))


@query(
    "G2_many_edits",
    """
select id, case when n = 0 then seq when n < 18 then substr(seq, 1, n // 4) || 'GG' || substr(seq, n // 4 + 2)
  else substr(seq, 1, n // 4) || 'GG' || substr(seq, n // 4 + 2, n // 2 - n // 4 - 1) || 'T' || substr(seq, n // 2 + 3) end as edited from (select id, seq, length(seq) as n from dseq)""",
    "dseq",
)
def g2(spark, sf_dir):
    """An insertion at a quarter of every sequence, and a deletion in the middle of those of 18 bases or more."""
    s = sequences(spark, sf_dir).withColumn("n", F.length("seq"))
    edit = lambda at, n, alt: F.struct(at.cast("int").alias("at"), F.substring(F.col("seq"), at.cast("int") + 1, F.lit(n)).alias("ref"), F.lit(alt).alias("alt"))
    first, second = edit(F.expr("n div 4"), 1, "GG"), edit(F.expr("n div 2"), 2, "T")
    edits = F.when(F.col("n") == 0, F.slice(F.array(first), 1, 0)).when(F.col("n") < 18, F.array(first)).otherwise(F.array(first, second))
    return s.select("id", dna.apply_edits(F.col("seq"), edits).alias("edited"))


#: Fixed values of the schedule: steps of warm-up, the step decay begins at, all steps.
WARM_UP, DECAY, STEPS = 10, 80, 100


@query(
    "G20_schedule",
    f"""
select id, step, round(case when step < {WARM_UP} then (step + 1) / cast({WARM_UP} as double) when step < {DECAY} then 1 else ({STEPS} - step) / cast({STEPS - DECAY} as double) end, 6) as rate
from (select id, (row_number() over (partition by chrom order by start_bp, id) - 1) * {STEPS} // count(*) over (partition by chrom) as step from w)""",
    "w",
)
def g20(spark, sf_dir):
    """The rate that each training window is seen at, when a chromosome's windows are gone through in order within a run's steps: warm-up, stable, decay."""
    w = ranking.running(windows(spark, sf_dir).select("id", "chrom", "start_bp"), ["chrom"], ["start_bp", "id"], at=F.lit(1))
    counts = w.groupBy("chrom").agg(F.max("at").alias("n"))
    placed = ranking.met(w, counts, ["chrom"]).withColumn("step", F.expr(f"(at - 1) * {STEPS} div n"))
    step = F.col("step")
    rate = F.when(step < WARM_UP, (step + 1) / F.lit(float(WARM_UP))).when(step < DECAY, F.lit(1.0)).otherwise((STEPS - step) / F.lit(float(STEPS - DECAY)))
    return placed.select("id", "step", r(rate).alias("rate"))


@query("G26_substitution_class", """
select source_row_id, case when ref = alt then null when ref || alt in ('AG', 'GA', 'CT', 'TC') then 'transition' else 'transversion' end as kind, ref || '>' || alt as substitution
from v""", "v")
def g26(spark, sf_dir):
    both = F.concat("ref", "alt")
    kind = F.when(F.col("ref") != F.col("alt"), F.when(both.isin("AG", "GA", "CT", "TC"), "transition").otherwise("transversion"))
    return variants(spark, sf_dir).select("source_row_id", kind.alias("kind"), F.concat("ref", F.lit(">"), "alt").alias("substitution"))


@query("H5_commitment", """
select source_row_id, sha256('{\"edit\":{\"alt\":\"' || alt || '\",\"pos\":' || cast(pos as varchar) || ',\"ref\":\"' || ref || '\"},\"pool\":{\"radius\":8,\"type\":\"centered\"},\"window\":null}') as commitment
from v""", "v")
def h5(spark, sf_dir):
    nested = F.struct(F.struct("alt", "pos", "ref").alias("edit"), F.struct(F.lit(8).alias("radius"), F.lit("centered").alias("type")).alias("pool"), F.lit(None).cast("string").alias("window"))
    return variants(spark, sf_dir).select("source_row_id", F.sha2(F.to_json(nested, {"ignoreNullFields": "false"}), 256).alias("commitment"))


@query("T6_seeded_head", "select id from sl order by sha256('11:' || cast(id as varchar)), id limit 30", "sl")
def t6(spark, sf_dir):
    from helixmill.operators.sampling import first_k

    return first_k(scored(spark, sf_dir), "id", 30, "11").select("id")


@query("C9_evaluation", """
select count(*) as n, cast(sum(label) as bigint) as positives, round((select sum(case when p.score > q.score then cast(1 as double) when p.score = q.score then cast(0.5 as double) else 0 end) / count(*)
    from sl p, sl q where p.label = 1 and q.label = 0), 6) as auroc
from sl""", "sl")
def c9(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("split", F.lit("eval"))
    counts = s.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"))
    return counts.join(metrics.auroc(s, ["split"]).drop("n"), "split").select("n", "positives", r("auroc").alias("auroc"))


@query("C17_collapse_alerts", """
select split, round(avg(vp), 6) < 0.9 as low_variance, count(*) as dims
from (select split, i, var_pop(v) as vp from (select split, unnest(x) as v, unnest(range(64)) as i
    from e) group by split, i) group by split""", "e")
def c17(spark, sf_dir):
    many = pairs(spark, sf_dir).select("split", F.posexplode("x").alias("i", "v"))
    return many.groupBy("split", "i").agg(F.var_pop("v").alias("vp")).groupBy("split").agg((r(F.avg("vp")) < 0.9).alias("low_variance"), F.count("*").alias("dims"))
