"""Registry of the engine's queries and their SQL equivalents, keyed by survey ID."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import digests, dna, labels, vectors
from helixmill.operators import calibration, intervals, metrics, ranking, sampling, variants
from helixmill.operators.quantiles import quantiles
from helixmill.plans import catalog, composites, extended, files, runtime, statistics, whole  # noqa: F401  they register their queries
from helixmill.plans.proxies import keyed_variants, scored, sequences
from helixmill.plans.proxies import read as table
from helixmill.plans.proxies import variants as v_rows
from helixmill.plans.proxies import vectors as e_rows
from helixmill.plans.proxies import windows as w_rows
from helixmill.registry import ORACLE_SQL, QUERIES, query, r  # noqa: F401

# variants: P, F, A, W, T, U


@query("P1_gnomad_prepare", "select chrom, pos, ref, alt, cast(af as float) as af_global from v where flt = 'PASS' and af >= 0.01", "v")
def p1(spark, sf_dir):
    good, _ = variants.prepare(v_rows(spark, sf_dir), variants.gnomad_reject())
    return good.select("chrom", "pos", "ref", "alt", F.col("af").cast("float").alias("af_global"))


@query("A6_reject_counts", "select case when flt <> 'PASS' then 'filter' when af is null or af < 0.01 then 'af' else 'written' end as reason, count(*) as n from v group by 1", "v")
def a6(spark, sf_dir):
    return variants.prepare(v_rows(spark, sf_dir), variants.gnomad_reject())[1]


@query("P2_clinvar_prepare", "select chrom, pos, ref, alt, cls as clinical_significance, source_row_id as clinvar_id from v where ref <> alt", "v")
def p2(spark, sf_dir):
    good, _ = variants.prepare(v_rows(spark, sf_dir), variants.clinvar_reject())
    return good.select("chrom", "pos", "ref", "alt", F.col("cls").alias("clinical_significance"), F.col("source_row_id").alias("clinvar_id"))


@query("F4_label_set", "select chrom, pos, ref, alt, cls from v where cls in ('P', 'LP', 'B', 'LB')", "v")
def f4(spark, sf_dir):
    return v_rows(spark, sf_dir).where(F.col("cls").isin("P", "LP", "B", "LB")).select("chrom", "pos", "ref", "alt", "cls")


@query(
    "F9_canonical_variant",
    """
select source_row_id, variant_key, 'sha256:' || sha256('{\"alt\":\"' || alt || '\",\"assembly\":\"GRCh38\",\"chrom\":\"' || chrom || '\",\"pos\":' || cast(pos + 3 as varchar) || ',\"ref\":\"' || ref || '\"}') as variant_digest
from (select *  replace ('GRCh38:' || chrom || ':' || cast(pos + 3 as varchar) || ':' || ref || ':' || alt as variant_key)
  from vk)""",
    "vk",
)
def f9(spark, sf_dir):
    # shared context around a single-base change: three bases before, two after
    padded = v_rows(spark, sf_dir).withColumn("t", dna.trimmed(F.col("pos"), F.concat(F.lit("GCA"), "ref", F.lit("TT")), F.concat(F.lit("GCA"), "alt", F.lit("TT"))))
    asm, chrom, t = F.lit("GRCh38"), dna.closed_chrom(F.concat(F.lit("chr"), "chrom")), F.col("t")
    key = dna.variant_key(asm, chrom, t["pos"], t["ref"], t["alt"])
    return padded.select("source_row_id", key.alias("variant_key"), digests.canonical_sha256(assembly=asm, chrom=chrom, pos=t["pos"], ref=t["ref"], alt=t["alt"]).alias("variant_digest"))


@query(
    "F11_edit_type",
    """
select kind, count(*) as n from (select case when len_a > 16 or len_r > 16 then 'SV' when len_r = 1 and len_a = 1 then 'SNV' when len_r = len_a then 'MNV' when len_r = 1 then 'INS' when len_a = 1 then 'DEL' else 'DELINS' end as kind
  from (select pos % 19 + 1 as len_r, source_row_id % 17 + 1 as len_a
    from v)) group by 1""",
    "v",
)
def f11(spark, sf_dir):
    rows = v_rows(spark, sf_dir).select(F.repeat("ref", (F.col("pos") % 19 + 1).cast("int")).alias("ref"), F.repeat("alt", (F.col("source_row_id") % 17 + 1).cast("int")).alias("alt"))
    return rows.groupBy(dna.edit_type(F.col("ref"), F.col("alt")).alias("kind")).agg(F.count("*").alias("n"))


@query("F7_binary_label", "select source_row_id, case when cls in ('P', 'LP') then true when cls in ('B', 'LB') then false end as label from v", "v")
def f7(spark, sf_dir):
    return v_rows(spark, sf_dir).select("source_row_id", labels.binary_label(F.array("cls")).alias("label"))


@query("F6_clinical_significance", """
select source_row_id, case cls when 'P' then 'LP' when 'LP' then 'LP' when 'B' then 'LB' when 'LB' then 'LB' when 'VUS' then 'VUS' else 'OTHER' end as cls
from v""", "v")
def f6(spark, sf_dir):
    raw = F.create_map(*(F.lit(x) for x in ("P", "Pathogenic/Likely_pathogenic", "LP", "Likely%20pathogenic", "B", "Benign|Likely_benign", "LB", "likely_benign", "VUS", "Uncertain_significance|Pathogenic", "OTHER", "drug_response")))
    return v_rows(spark, sf_dir).select("source_row_id", labels.clinical_significance(raw[F.col("cls")]).alias("cls"))


@query("F8_canonical_label", "select doc_id, case quality when 1 then 'positive' else 'negative' end as label from labels")
def f8(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", labels.canonical_label(F.col("quality")).alias("label"))


@query("F15_source_label", "select id, case when cast(replace(source, 'src', '') as int) % 2 = 0 then 'genome' else 'mrna' end as source from dseq", "dseq")
def f15(spark, sf_dir):
    aliases = {f"src {n}": ("genome", "mrna")[n % 2] for n in range(100)}
    spelled = F.regexp_replace("source", "src", " SRC-/ ")
    return sequences(spark, sf_dir).select("id", labels.source_label(spelled, aliases).alias("source"))


@query(
    "A1_role_crosstab",
    """
select source, count(*) filter (role = 'train') as train, count(*) filter (role = 'validation') as validation, count(*) filter (role = 'evaluation') as evaluation, count(distinct variant_key) as n_keys
from vk group by source""",
    "vk",
)
def a1(spark, sf_dir):
    return variants.role_crosstab(keyed_variants(spark, sf_dir), "source")


_BEST = """
select * from (select *, row_number() over (partition by variant_key order by case cls when 'P' then 0 when 'LP' then 1 when 'B' then 2 when 'LB' then 3 else 9 end, source_row_id, cls) as rn
  from vk) where rn = 1"""


@query("W1_best_label", f"select variant_key, cls, source_row_id from ({_BEST})", "vk")
def w1(spark, sf_dir):
    return variants.best_label(keyed_variants(spark, sf_dir)).select("variant_key", "cls", "source_row_id")


@query("A2_class_role_counts", f"""
select cls, count(*) filter (role = 'train') as train, count(*) filter (role = 'validation') as validation, count(*) filter (role = 'evaluation') as evaluation, count(distinct variant_key) as n_keys
from ({_BEST}) group by cls""", "vk")
def a2(spark, sf_dir):
    return variants.role_crosstab(variants.best_label(keyed_variants(spark, sf_dir)), "cls")


@query("A3_cross_role_leaks", "select source || ref || alt as variant_key, count(distinct role) as n_roles from vk group by 1 having count(distinct role) > 1", "vk")
def a3(spark, sf_dir):
    return variants.cross_role_leaks(keyed_variants(spark, sf_dir).withColumn("variant_key", F.concat("source", "ref", "alt")))


@query("A4_label_conflicts", """
select variant_key from (select chrom || ':' || cast(pos // 16 as varchar) as variant_key, cls
  from vk where cls in ('P', 'LP', 'B', 'LB')) group by 1 having min(cls in ('P', 'LP')) <> max(cls in ('P', 'LP'))""", "vk")
def a4(spark, sf_dir):
    return variants.label_conflicts(keyed_variants(spark, sf_dir).withColumn("variant_key", F.concat_ws(":", "chrom", F.expr("cast(pos div 16 as string)"))))


@query(
    "A5_consistent_first",
    """
select variant_key, min({'a': source_row_id, 'b': cls}).b as cls, min(source_row_id) as source_row_id
from (select chrom || ':' || cast(pos // 16 as varchar) as variant_key, cls, source_row_id
  from vk where cls in ('P', 'LP', 'B', 'LB')) group by 1 having min(cls in ('P', 'LP')) = max(cls in ('P', 'LP'))""",
    "vk",
)
def a5(spark, sf_dir):
    rows = keyed_variants(spark, sf_dir).withColumn("variant_key", F.concat_ws(":", "chrom", F.expr("cast(pos div 16 as string)")))
    return variants.consistent_first(rows)


@query(
    "A7_gnomad_audit",
    """
select count(*) as n, min(pos) as min_pos, max(pos) as max_pos, count(af) as n_af, cast(0 as bigint) as bad_ref, cast(0 as bigint) as bad_alt, count(*) filter (pos < 1) as bad_pos, count(*) filter (cast(af as float) < cast(0.01 as float)) as bad_af, count(*) filter (flt <> 'PASS') as bad_filter, min(case when cast(af as float) < cast(0.01 as float) or flt <> 'PASS' then source_row_id end) as first_bad
from v""",
    "v",
)
def a7(spark, sf_dir):
    return variants.gnomad_audit(v_rows(spark, sf_dir))


@query("A8_clinvar_audit", """
select chrom, count(*) as n, min(pos) as min_pos, max(pos) as max_pos, count(*) filter (cls in ('P', 'LP')) as positive, count(*) filter (cls in ('B', 'LB')) as negative
from v group by chrom""", "v")
def a8(spark, sf_dir):
    return v_rows(spark, sf_dir).groupBy("chrom").agg(F.count("*").alias("n"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"), F.count_if(F.col("cls").isin("P", "LP")).alias("positive"), F.count_if(F.col("cls").isin("B", "LB")).alias("negative"))


@query("A32_per_chrom_counts", "select chrom, cast(chrom as int) as chrom_rank, count(*) as n, count(*) - count(distinct variant_key) as duplicates from vk group by chrom", "vk")
def a32(spark, sf_dir):
    return keyed_variants(spark, sf_dir).groupBy("chrom", dna.chrom_rank(F.col("chrom")).alias("chrom_rank")).agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("variant_key")).alias("duplicates"))


@query("A33_top_categories", "select cls, source, count(*) as n from v group by 1, 2 order by n desc, cls, source limit 12", "v")
def a33(spark, sf_dir):
    return v_rows(spark, sf_dir).groupBy("cls", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cls", "source").limit(12)


@query("U1_missing_keys", "select variant_key from vk where cls in ('P', 'LP') except select variant_key from vk where role = 'train'", "vk")
def u1(spark, sf_dir):
    rows = keyed_variants(spark, sf_dir)
    return rows.where(F.col("cls").isin("P", "LP")).select("variant_key").distinct().join(rows.where("role = 'train'").select("variant_key"), "variant_key", "left_anti")


@query("U2_shared_keys", "select variant_key from vk where source = 'R' intersect select variant_key from vk where source = 'A'", "vk")
def u2(spark, sf_dir):
    rows = keyed_variants(spark, sf_dir)
    return rows.where("source = 'R'").select("variant_key").intersect(rows.where("source = 'A'").select("variant_key"))


@query("U3_U5_union", "select distinct variant_key from (select variant_key from vk where source = 'R' union all select variant_key from vk where source = 'A')", "vk")
def u3(spark, sf_dir):
    rows = keyed_variants(spark, sf_dir)
    return rows.where("source = 'R'").select("variant_key").unionByName(rows.where("source = 'A'").select("variant_key")).distinct()


# joins


_INSIDE = "v.chrom = w.chrom and w.start_bp < v.pos and v.pos <= w.end_bp and v.pos - 1 + length(v.ref) <= w.end_bp"


@query("J1_variants_in_windows", f"select w.id, v.source_row_id from v join w on {_INSIDE}", "v", "w")
def j1(spark, sf_dir):
    return intervals.variants_in_windows(w_rows(spark, sf_dir), v_rows(spark, sf_dir)).select("id", "source_row_id")


@query("J3_windows_with_variant", "select id from w where exists (select 1 from v where v.cls = 'P' and v.chrom = w.chrom and v.pos - 1 < w.end_bp and w.start_bp < v.pos - 1 + length(v.ref))", "v", "w")
def j3(spark, sf_dir):
    return intervals.windows_with(w_rows(spark, sf_dir), v_rows(spark, sf_dir).where("cls = 'P'")).select("id")


_HOLD = "h as (select chrom, start_bp, start_bp + 50000 as end_bp from w where id % 97 = 1)"


@query("J4_windows_off_holdouts", f"""
select id from (with {_HOLD} select id from w where not exists (select 1
    from h where h.chrom = w.chrom and h.start_bp < w.end_bp and w.start_bp < h.end_bp))""", "w")
def j4(spark, sf_dir):
    w = w_rows(spark, sf_dir)
    return intervals.windows_off(w, w.where("id % 97 = 1").withColumn("end_bp", F.col("start_bp") + 50000)).select("id")


@query("J5_key_anti_join", "select source_row_id from vk where variant_key not in (select variant_key from vk where source = 'R')", "vk")
def j5(spark, sf_dir):
    rows = keyed_variants(spark, sf_dir)
    return rows.join(rows.where("source = 'R'").select("variant_key"), "variant_key", "left_anti").select("source_row_id")


@query("J6_point_semi_join", "select source_row_id from vk where variant_key in (select variant_key from vk where role <> 'train')", "vk")
def j6(spark, sf_dir):
    rows = keyed_variants(spark, sf_dir)
    return rows.join(rows.where("role <> 'train'").select("variant_key"), "variant_key", "left_semi").select("source_row_id")


@query("J7_score_join", """
select case when l.doc_id is null then 'extra_score' when d.doc_id is null then 'missing_score' else 'both' end as state, count(*) as n
from (select doc_id from labels where doc_id % 5 <> 0) l full
join documents d on d.doc_id = l.doc_id group by 1""")
def j7(spark, sf_dir):
    found = metrics.join_scores(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").where("doc_id % 5 <> 0"), ["doc_id"])
    return found.groupBy("state").agg(F.count("*").alias("n"))


@query("J11_reverse_alleles", """
select count(*) as n from vk a where exists (select 1 from vk b
  where b.chrom = a.chrom and b.pos // 64 = a.pos // 64 and b.ref = a.alt and b.alt = a.ref)""", "vk")
def j11(spark, sf_dir):
    rows = keyed_variants(spark, sf_dir).withColumn("spot", F.expr("pos div 64"))
    turned = rows.select("chrom", "spot", F.col("alt").alias("ref"), F.col("ref").alias("alt")).distinct()
    return rows.join(turned, ["chrom", "spot", "ref", "alt"], "left_semi").agg(F.count("*").alias("n"))


@query("J14_index_consistency", """
select 'missing' as problem, count(*) as n from v where source_row_id % 7 = 0
union all select 'orphan', count(*) from v where source_row_id % 7 <> 0 and source_row_id not in (select source_row_id
  from v where flt = 'PASS')""", "v")
def j14(spark, sf_dir):
    base = v_rows(spark, sf_dir)
    index = base.where("source_row_id % 7 <> 0").select("source_row_id")
    missing = base.join(index, "source_row_id", "left_anti").select(F.lit("missing").alias("problem"))
    orphan = index.join(base.where("filter = 'PASS'").select("source_row_id"), "source_row_id", "left_anti").select(F.lit("orphan").alias("problem"))
    return missing.unionByName(orphan).groupBy("problem").agg(F.count("*").alias("n"))


@query("J15_selected_rows", "select source_row_id, count(*) as copies from v where pos in (select start_bp + 1 from w) group by 1", "v", "w")
def j15(spark, sf_dir):
    wanted = w_rows(spark, sf_dir).select((F.col("start_bp") + 1).alias("pos")).distinct()
    return v_rows(spark, sf_dir).join(wanted, "pos", "left_semi").groupBy("source_row_id").agg(F.count("*").alias("copies"))


@query("J16_window_lookup_chain", """
select v.source_row_id, coalesce(k.start_bp, c.start_bp) as start_bp
from v left join (select chrom, start_bp + 1 as pos, min(start_bp) as start_bp
  from w group by 1, 2) k on k.chrom = v.chrom and k.pos = v.pos
left join (select chrom, min(start_bp) as start_bp from w group by 1) c on c.chrom = v.chrom""", "v", "w")
def j16(spark, sf_dir):
    w = w_rows(spark, sf_dir)
    by_key = w.groupBy("chrom", (F.col("start_bp") + 1).alias("pos")).agg(F.min("start_bp").alias("a"))
    by_chrom = w.groupBy("chrom").agg(F.min("start_bp").alias("b"))
    return v_rows(spark, sf_dir).join(by_key, ["chrom", "pos"], "left").join(by_chrom, "chrom", "left").select("source_row_id", F.coalesce("a", "b").alias("start_bp"))


# metrics


@query("A9_auroc", """
select grp, round(sum(case when p.score > n.score then cast(1 as double) when p.score = n.score then cast(0.5 as double) else 0 end) / count(*), 6) as auroc
from sl p join sl n using (grp) where p.label = 1 and n.label = 0
group by grp""", "sl")
def a9(spark, sf_dir):
    return metrics.auroc(scored(spark, sf_dir), ["grp"]).where("auroc is not null").select("grp", r("auroc").alias("auroc"))


@query("A10_average_precision", """
select grp, round(sum(case when label = 1 then cast(h as double) / k else 0 end) / sum(label), 6) as average_precision
from (select *, sum(label) over o as h, row_number() over o as k
  from sl window o as (partition by grp order by score desc, id))
group by grp""", "sl")
def a10(spark, sf_dir):
    return metrics.average_precision(scored(spark, sf_dir), ["grp"]).select("grp", r("average_precision").alias("average_precision"))


@query(
    "A11_threshold_metrics",
    """
select grp, n, accuracy, sensitivity, specificity, round((sensitivity + specificity) / 2, 6) as balanced_accuracy
from (select grp, count(*) as n, round(cast(count(*) filter ((score >= 25) = (label = 1)) as double) / count(*), 6) as accuracy, cast(count(*) filter (score >= 25 and label = 1) as double) / count(*) filter (label = 1) as sensitivity, cast(count(*) filter (score < 25 and label = 0) as double) / count(*) filter (label = 0) as specificity
  from sl group by grp)""",
    "sl",
)
def a11(spark, sf_dir):
    out = metrics.threshold_metrics(scored(spark, sf_dir), 25.0, ["grp"])
    return out.select("grp", "n", r("accuracy").alias("accuracy"), "sensitivity", "specificity", r("balanced_accuracy").alias("balanced_accuracy"))


@query("A12_spearman", """
select grp, round(corr(rx, ry), 6) as spearman from (select grp, rank() over (partition by grp order by score) + (count(*) over (partition by grp, score) - 1) / cast(2 as double) as rx, rank() over (partition by grp order by value) + (count(*) over (partition by grp, value) - 1) / cast(2 as double) as ry
  from sl) group by grp""", "sl")
def a12(spark, sf_dir):
    return metrics.spearman(scored(spark, sf_dir), "score", "value", ["grp"]).select("grp", r("spearman").alias("spearman"))


@query("A13_quantiles", """
select grp, round(quantile_cont(value, 0.025), 6) as lo, round(quantile_cont(value, 0.5), 6) as mid, round(quantile_cont(value, 0.975), 6) as hi
from sl group by grp""", "sl")
def a13(spark, sf_dir):
    found = quantiles(scored(spark, sf_dir), ["grp"], "value", {"lo": 0.025, "mid": 0.5, "hi": 0.975})
    return found.select("grp", *(r(n).alias(n) for n in ("lo", "mid", "hi")))


@query("A18_describe", """
select split, round(avg(n), 6) as mean, round(median(n), 6) as median, round(stddev_pop(n), 6) as std
from (select split, sqrt(list_sum(list_transform(x, lambda q: q * q))) as n
  from e) group by split""", "e")
def a18(spark, sf_dir):
    rows = e_rows(spark, sf_dir).select("split", vectors.norm(F.col("x")).alias("n"))
    means = rows.groupBy("split").agg(r(F.avg("n")).alias("mean"), r(F.stddev_pop("n")).alias("std"))
    return ranking.met(means, quantiles(rows, ["split"], "n", {"q": 0.5}).select("split", r("q").alias("median")), ["split"])


@query("A30_adjustment", """
select grp, round(stddev_pop(score - value), 6) as std, round(avg(abs(score - value)), 6) as mean_abs, round(quantile_cont(abs(score - value), 0.95), 6) as p95, max(abs(score - value)) as max_abs, count(distinct round(score - value, 8)) = 1 as constant
from sl group by grp""", "sl")
def a30(spark, sf_dir):
    rows = scored(spark, sf_dir).select("grp", (F.col("score") - F.col("value")).alias("d")).withColumn("a", F.abs("d"))
    same = F.min(F.round("d", 8)) == F.max(F.round("d", 8))
    whole = rows.groupBy("grp").agg(r(F.stddev_pop("d")).alias("std"), r(F.avg("a")).alias("mean_abs"), F.max("a").alias("max_abs"), same.alias("constant"))
    return ranking.met(whole, quantiles(rows, ["grp"], "a", {"q": 0.95}).select("grp", r("q").alias("p95")), ["grp"])


@query("A31_score_summary", """
select count(*) as n, count(value) as finite, min(value) as lo, max(value) as hi, round(avg(value), 6) as mean, median(value) as p50
from (select try_cast(case when l_linenumber % 5 = 0 then 'n/a' else cast(l_quantity as varchar) end as double) as value
  from lineitem)""")
def a31(spark, sf_dir):
    value = F.when(F.col("l_linenumber") % 5 == 0, "n/a").otherwise(F.col("l_quantity").cast("string")).try_cast("double")
    rows = table(spark, sf_dir, "lineitem").select(value.alias("value"))
    whole = rows.agg(F.count("*").alias("n"), F.count("value").alias("finite"), F.min("value").alias("lo"), F.max("value").alias("hi"), r(F.avg("value")).alias("mean"))
    return whole.join(F.broadcast(quantiles(rows, [], "value", {"p50": 0.5})))


@query("A35_histogram", """
select event_type, count(*) filter (value <= 10) as le_10, count(*) filter (value <= 50) as le_50, count(*) filter (value <= 100) as le_100, count(*) as le_inf, round(sum(value), 4) as total
from events group by event_type""")
def a35(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in (10, 50, 100)), F.count("*").alias("le_inf"), r(F.sum("value"), 4).alias("total"))


@query("W5_strided_windows", "select id, unnest(range(256, length(seq) - 1024 - 256 + 1, 512)) as start_bp from dseq where length(seq) >= 1024 + 512", "dseq")
def w5(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", F.explode(dna.window_starts(F.length("seq"), 1024, 256, 512).cast("array<bigint>")).alias("start_bp"))


# vectors


_DOT = "list_sum(list_transform(list_zip(x, y), lambda q: q[1] * q[2]))"
_NORM = "sqrt(list_sum(list_transform({0}, lambda q: q * q)))"
_L2 = "sqrt(list_sum(list_transform(list_zip(x, y), lambda q: (q[1] - q[2]) * (q[1] - q[2]))))"


@query("G12_l2", f"select id, round({_L2}, 6) as l2 from e", "e")
def g12(spark, sf_dir):
    return e_rows(spark, sf_dir).select("id", r(vectors.l2(F.col("x"), F.col("y"))).alias("l2"))


@query("G13_cosine", f"select id, round(greatest(-1, least(1, {_DOT} / ({_NORM.format('x')} * {_NORM.format('y')}))), 6) as cosine from e", "e")
def g13(spark, sf_dir):
    return e_rows(spark, sf_dir).select("id", r(vectors.cosine(F.col("x"), F.col("y"))).alias("cosine"))


@query("G14_region_l2", "select id, round(sqrt((x[1] - y[1]) ** 2 + (x[6] - y[6]) ** 2 + (x[64] - y[64]) ** 2), 6) as region_l2 from e", "e")
def g14(spark, sf_dir):
    return e_rows(spark, sf_dir).select("id", r(vectors.region_l2(F.col("x"), F.col("y"), [0, 5, 63])).alias("region_l2"))


@query("G16_edit_geometry", f"""
select id, round({_NORM.format('x')}, 6) as norm_s_ref, round({_NORM.format('y')}, 6) as norm_s_alt, round({_L2}, 6) as l2_delta, round({_L2} / {_NORM.format('x')}, 6) as rel_delta
from e""", "e")
def g16(spark, sf_dir):
    made = e_rows(spark, sf_dir).select("id", *vectors.edit_geometry(F.col("x"), F.col("y")))
    return made.select("id", *(r(c).alias(c) for c in ("norm_s_ref", "norm_s_alt", "l2_delta", "rel_delta")))


@query("A16_rollout_summary", f"""
select split, count(*) as n, round(avg({_L2}), 6) as mean_l2, round(avg({_DOT} / ({_NORM.format('x')} * {_NORM.format('y')})), 6) as mean_cosine
from e group by split""", "e")
def a16(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return e_rows(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), r(F.avg(vectors.l2(x, y))).alias("mean_l2"), r(F.avg(vectors.cosine(x, y))).alias("mean_cosine"))


@query("W4_target_rank", f"select id, row_number() over (partition by split order by round({_L2}, 9), id) as target_rank from e", "e")
def w4(spark, sf_dir):
    e = e_rows(spark, sf_dir).select("id", "split", r(vectors.l2(F.col("x"), F.col("y")), 9).alias("d"))
    return ranking.running(e, ["split"], ["d", "id"], target_rank=F.lit(1)).select("id", F.col("target_rank").cast("long").alias("target_rank"))


@query("T3_elites", f"select id, round({_L2}, 6) as objective from e order by round({_L2}, 6), id limit 16", "e")
def t3(spark, sf_dir):
    return e_rows(spark, sf_dir).select("id", r(vectors.l2(F.col("x"), F.col("y"))).alias("objective")).orderBy("objective", "id").limit(16)


@query("A20_mean_difference", """
select i, round(avg(v) filter (split % 2 = 1) - avg(v) filter (split % 2 = 0), 6) as direction
from (select split, unnest(x) as v, unnest(range(64)) as i from e)
group by i""", "e")
def a20(spark, sf_dir):
    many = e_rows(spark, sf_dir).select("split", F.posexplode("x").alias("i", "v"))
    return many.groupBy(F.col("i").cast("long").alias("i")).agg(r(F.avg(F.when(F.col("split") % 2 == 1, F.col("v"))) - F.avg(F.when(F.col("split") % 2 == 0, F.col("v")))).alias("direction"))


@query("A17_collapse_variance", """
select split, round(avg(vp), 6) as mean_variance from (select split, i, var_pop(v) as vp
  from (select split, unnest(x) as v, unnest(range(64)) as i from e)
  group by split, i) group by split""", "e")
def a17(spark, sf_dir):
    many = e_rows(spark, sf_dir).select("split", F.posexplode("x").alias("i", "v"))
    return many.groupBy("split", "i").agg(F.var_pop("v").alias("vp")).groupBy("split").agg(r(F.avg("vp")).alias("mean_variance"))


# sequences


@query("F13_dna", "select id, length(seq) as n, length(seq) - length(replace(seq, 'N', '')) as n_unknown from dseq", "dseq")
def f13(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("seq", dna.dna(F.lower("seq")))
    return s.select("id", F.length("seq").cast("long").alias("n"), (F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))).cast("long").alias("n_unknown"))


_GC = "(length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / cast(nullif(length(replace(seq, 'N', '')), 0) as double)"


@query("G6_G7_gc", f"""
select id, round({_GC}, 6) as gc, case when {_GC} <= 1 / cast(3 as double) then 'low' when {_GC} >= 2 / cast(3 as double) then 'high' when {_GC} is not null then 'mid' end as gc_bin
from dseq""", "dseq")
def g6(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("gc", dna.gc_fraction(F.col("seq")))
    return s.select("id", r("gc").alias("gc"), dna.gc_bin(F.col("gc")).alias("gc_bin"))


@query("H3_window_hash", "select id, 'sha256:' || sha256(seq) as content_hash from dseq", "dseq")
def h3(spark, sf_dir):
    return sequences(spark, sf_dir).select("id", dna.window_sha256(F.lower("seq")).alias("content_hash"))


@query("G3_extract_window", """
select id, rpad(substr(seq, cast(greatest(0, least(pos - 32, length(seq) - 64)) as int) + 1, 64), 64, 'A') as sequence
from (select *, (id * 37) % (length(seq) + 1) as pos from dseq)""", "dseq")
def g3(spark, sf_dir):
    s = sequences(spark, sf_dir).withColumn("at", ((F.col("id") * 37) % (F.length("seq") + 1)).cast("int"))
    return s.select("id", dna.extract_window(F.col("seq"), F.col("at"), 64).alias("sequence"))


@query("G1_apply_edit", "select id, substr(seq, 1, 9) || 'TTT' || substr(seq, 11) as edited from dseq where length(seq) > 10", "dseq")
def g1(spark, sf_dir):
    s = sequences(spark, sf_dir).where("length(seq) > 10")
    return s.select("id", dna.apply_edit(F.col("seq"), F.lit(9), F.substring("seq", 10, 1), F.lit("TTT")).alias("edited"))


# sampling, calibration, digests

_DRAW = "cast(('0x' || substr(sha256('7:' || cast(id as varchar)), 1, 16))::ubigint as double) / pow(2, 64)"


@query("SM1_fraction", f"select id from sl where {_DRAW} < 0.25", "sl")
def sm1(spark, sf_dir):
    return sampling.fraction(scored(spark, sf_dir), "id", 0.25, "7").select("id")


@query("SM2_categorical", f"""
select source, count(*) as n from (select case when {_DRAW} < 0.5 then 'gnomad' when {_DRAW} < 0.75 then 'clinvar' when {_DRAW} < 0.85 then 'snv' else 'indel' end as source
  from sl) group by 1""", "sl")
def sm2(spark, sf_dir):
    mix = {"gnomad": 0.5, "clinvar": 0.25, "snv": 0.1, "indel": 0.15}
    return sampling.categorical(scored(spark, sf_dir), "id", mix, "7", "source").groupBy("source").agg(F.count("*").alias("n"))


@query("T2_top_k_sample", "select id from w order by sha256('7:' || cast(id as varchar)), id limit 100", "w")
def t2(spark, sf_dir):
    return sampling.first_k(w_rows(spark, sf_dir), "id", 100, "7").select("id")


@query("SM7_first_k_per_group", "select id from (select id, row_number() over (partition by chrom order by sha256('7:' || cast(id as varchar)), id) as r from w) where r <= 5", "w")
def sm7(spark, sf_dir):
    return sampling.first_k_per(w_rows(spark, sf_dir), ["chrom"], "id", 5, "7").select("id")


@query("T4_balanced", """
select id from (select id, label, row_number() over (partition by label order by sha256('7:' || cast(id as varchar)), id) as r
  from sl) where r <= 20""", "sl")
def t4(spark, sf_dir):
    return sampling.balanced(scored(spark, sf_dir), "label", "id", 40, "7").select("id")


@query("SM8_folds", "select id, (row_number() over (partition by label order by sha256('7:' || cast(id as varchar))) - 1) % 5 as fold from sl", "sl")
def sm8(spark, sf_dir):
    return metrics.folds(scored(spark, sf_dir), 5, "7").select("id", F.col("fold").cast("long").alias("fold"))


@query("H1_canonical_digest", """
select source_row_id, sha256('{\"alt\":\"' || alt || '\",\"chrom\":\"' || chrom || '\",\"pos\":' || cast(pos as varchar) || ',\"ref\":\"' || ref || '\"}') as digest
from v""", "v")
def h1(spark, sf_dir):
    c = F.col
    return v_rows(spark, sf_dir).select("source_row_id", F.sha2(digests.canonical_json(ref=c("ref"), alt=c("alt"), pos=c("pos"), chrom=c("chrom")), 256).alias("digest"))


@query("H4_key_list_digest", """
select chrom, sha256('[\"' || string_agg(variant_key, '\",\"' order by variant_key) || '\"]') as digest
from vk where role <> 'train' group by chrom""", "vk")
def h4(spark, sf_dir):
    return keyed_variants(spark, sf_dir).where("role <> 'train'").groupBy("chrom").agg(digests.key_list_sha256(F.col("variant_key")).alias("digest"))
