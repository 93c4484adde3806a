"""More registered queries: holdouts, lookups, within-class metrics, tokens, schedules, plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixmill.functions import dna, labels, vectors
from helixmill.operators import calibration, intervals, metrics, sampling, tiles
from helixmill.plans import scoring
from helixmill.plans.proxies import corpus_records, keyed_variants, on_reference, read, reference, scored, sequences, variants, vectors as pairs, windows
from helixmill.registry import query, r
from helixmill.sources import text
from helixmill.streaming.events import epochs, not_done

_L2 = "sqrt(list_sum(list_transform(list_zip(x, y), lambda q: (q[1] - q[2]) * (q[1] - q[2]))))"


@query(
    "F14_corpus_clean",
    """
select id, reason, case when id % 3 <> 0 then 'r' || id when reason is null then left(sha256(seq), 16) end as record_id,
  case when reason is null then length(seq) end as n from (
  select id, seq, case when id % 11 = 0 or length(seq) = 0 and id % 13 <> 5 then 'missing_sequence' when id % 7 = 3 then 'bad_source' when id % 13 = 5 then 'bad_sequence' end as reason from dseq
)""",
    "dseq",
)
def f14(spark, sf_dir):
    """Every record with why it is skipped, if it is; bad ones are planted in the records, and the operator's rules find them."""
    return corpus_records(spark, sf_dir).select("id", "reason", "record_id", F.when(F.col("reason").isNull(), F.length("sequence")).cast("long").alias("n"))


@query("F16_window_holdout", """
select id from w where chrom <> '7' and id % 5 <> 0 and not exists (select 1
  from (select chrom, start_bp, end_bp from w where id % 97 = 1) h
  where h.chrom = w.chrom and h.start_bp < w.end_bp and w.start_bp < h.end_bp)""", "w")
def f16(spark, sf_dir):
    w = windows(spark, sf_dir)
    return scoring.hold_out_windows(w, ids=w.where("id % 5 = 0"), chroms=["7"], intervals=w.where("id % 97 = 1")).select("id")


@query("F17_edit_holdout", "select source_row_id from vk where chrom <> '7' and variant_key not in (select variant_key from vk where source = 'A')", "vk")
def f17(spark, sf_dir):
    rows = keyed_variants(spark, sf_dir)
    return scoring.hold_out_edits(rows, keys=rows.where("source = 'A'"), chroms=["7"]).select("source_row_id")


@query("F18_membership_holdout", "select id, case when chrom = '20' then 'validation' when chrom = '21' then 'evaluation' end as role from w where chrom in ('20', '21')", "w")
def f18(spark, sf_dir):
    from helixmill.operators.variants import role

    return windows(spark, sf_dir).withColumn("role", role(F.col("chrom"))).where("role <> 'train'").select("id", "role")


@query("F19_availability", """
select id, case when chrom = '7' then 'holdout_policy' when coalesce(n, 0) < 60 then 'required_source_insufficient' else 'available' end as reason
from w left join (select w.id as i, count(*) as n from v join w on v.chrom = w.chrom and w.start_bp < v.pos and v.pos <= w.end_bp
  where v.source = 'R' group by 1) c on c.i = w.id""", "v", "w")
def f19(spark, sf_dir):
    w = windows(spark, sf_dir)
    counts = intervals.variants_in_windows(w, variants(spark, sf_dir).where("source = 'R'")).groupBy("id").agg(F.count("*").alias("n"))
    reason = F.when(F.col("chrom") == "7", "holdout_policy").when(F.coalesce("n", F.lit(0)) < 60, "required_source_insufficient").otherwise("available")
    return w.join(counts, "id", "left").select("id", reason.alias("reason"))


@query(
    "F20_scoreable",
    """
select source_row_id, case when n is null then 'missing_contig' when pos > n then 'outside' when substr(seq, cast(pos as int), 1) = ref then 'match' else 'mismatch' end as reads
from rv""",
    "rv",
)
def f20(spark, sf_dir):
    """Each variant against the reference's tiles: the contig exists, REF lies inside it and is what it has."""
    contigs = reference(spark, sf_dir)
    met = text.resolve_contigs(on_reference(spark, sf_dir, contigs), tiles.lengths(contigs))
    return tiles.against_reference(met, tiles.with_halo(contigs, 16), longest=16).select("source_row_id", "reads")


@query("F21_snv_key", "select source_row_id, case when ref <> alt then chrom || ':' || cast(pos as varchar) || ':' || ref || '>' || alt end as snv from v", "v")
def f21(spark, sf_dir):
    snv = (dna.edit_type(F.col("ref"), F.col("alt")) == "SNV") & (F.col("ref") != F.col("alt"))
    return variants(spark, sf_dir).select("source_row_id", F.when(snv, F.concat("chrom", F.lit(":"), F.col("pos").cast("string"), F.lit(":"), "ref", F.lit(">"), "alt")).alias("snv"))


@query("F22_redaction", """
select event_id, regexp_replace(props, '[ACGTNacgtn]{20,}', '<dna>', 'g') as props
from (select event_id, props || ' ' || repeat('ACGT', cast(event_id % 9 as int)) as props
  from events)""")
def f22(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.concat("props", F.lit(" "), F.repeat(F.lit("ACGT"), (F.col("event_id") % 9).cast("int"))).alias("props"))
    return rows.select("event_id", F.regexp_replace("props", "[ACGTNacgtn]{20,}", "<dna>").alias("props"))


@query("F23_F24_consequences", """
select source_row_id, case cls when 'P' then 'missense_variant,synonymous_variant' when 'B' then 'intron_variant' else '' end as consequences, cls = 'P' as coding
from v""", "v")
def f23(spark, sf_dir):
    mc = F.when(F.col("cls") == "P", "SO:1|synonymous_variant,SO:2|missense%5Fvariant,SO:3|missense_variant").when(F.col("cls") == "B", "SO:4|intron_variant").otherwise("")
    terms = F.transform(F.split(F.url_decode(F.replace(mc, F.lit("+"), F.lit("%2B"))), ","), lambda t: F.substring_index(t, "|", -1))
    names = F.array_sort(F.array_distinct(F.filter(terms, lambda t: t != "")))
    coding = F.arrays_overlap(names, F.array(F.lit("missense_variant"), F.lit("synonymous_variant")))
    return variants(spark, sf_dir).select("source_row_id", F.array_join(names, ",").alias("consequences"), coding.alias("coding"))


@query("J8_comparable_baseline", """
select grp, sha256('[\"' || string_agg(cast(id as varchar), '\",\"' order by cast(id as varchar)) || '\"]') = sha256('[\"' || string_agg(case when score < 48 then cast(id as varchar) end, '\",\"' order by cast(id as varchar)) || '\"]') as comparable
from sl group by grp""", "sl")
def j8(spark, sf_dir):
    from helixmill.functions.digests import key_list_sha256

    s = scored(spark, sf_dir)
    ours = s.groupBy("grp").agg(key_list_sha256(F.col("id").cast("string")).alias("a"))
    base = s.where("score < 48").groupBy("grp").agg(key_list_sha256(F.col("id").cast("string")).alias("b"))
    return ours.join(base, "grp").select("grp", (F.col("a") == F.col("b")).alias("comparable"))


@query("J9_first_mapping", """
select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k
  from orders join customer on c_custkey = o_custkey) where k = 1""")
def j9(spark, sf_dir):
    met = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")
    return met.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("first")).select("o_custkey", "first.o_orderkey")


@query("J10_lookup_counters", """
select case when p_partkey is null then 'missing' when p_size > 25 then 'large' else 'used' end as state, count(*) as n
from lineitem left join (select * from part where p_partkey % 3 <> 0) on p_partkey = l_partkey
group by 1""")
def j10(spark, sf_dir):
    part = read(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("l_partkey"), "p_size", F.lit(True).alias("known"))
    met = read(spark, sf_dir, "lineitem").select("l_partkey").join(part, "l_partkey", "left")
    return met.groupBy(F.when(F.col("known").isNull(), "missing").when(F.col("p_size") > 25, "large").otherwise("used").alias("state")).agg(F.count("*").alias("n"))


@query("J12_zip_by_ordinal", """
select a.id, a.split as left_split, b.split as right_split from (select *, row_number() over (order by id) as k
  from e) a join (select *, row_number() over (order by id desc) as k
  from e) b using (k)""", "e")
def j12(spark, sf_dir):
    # ids run from 0 without gaps, so ordinals are arithmetic and need no global order
    e = pairs(spark, sf_dir)
    last = e.agg(F.max("id").alias("last"))
    right = e.join(F.broadcast(last)).select((F.col("last") - F.col("id")).alias("k"), F.col("split").alias("right_split"))
    return e.select("id", F.col("id").alias("k"), F.col("split").alias("left_split")).join(right, "k").select("id", "left_split", "right_split")


@query("J17_T7_first_k_edits", """
select id, source_row_id from (select w.id, v.source_row_id, row_number() over (partition by w.id order by v.pos, v.source_row_id, v.alt) as k
  from v join w on v.chrom = w.chrom and w.start_bp < v.pos and v.pos <= w.end_bp
  where v.ref = 'A') where k <= 3""", "v", "w")
def j17(spark, sf_dir):
    met = intervals.variants_in_windows(windows(spark, sf_dir), variants(spark, sf_dir).where("ref = 'A'"))
    order = Window.partitionBy("id").orderBy("pos", "source_row_id", "alt")
    return met.withColumn("k", F.row_number().over(order)).where("k <= 3").select("id", "source_row_id")


@query("J18_cache_misses", """
select count(distinct l_partkey) as missing, count(*) as requests
from lineitem where l_partkey not in (select p_partkey from part
  where p_size <= 25)""")
def j18(spark, sf_dir):
    cache = read(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    miss = read(spark, sf_dir, "lineitem").select("l_partkey").join(cache, "l_partkey", "left_anti")
    return miss.agg(F.count_distinct("l_partkey").alias("missing"), F.count("*").alias("requests"))


@query("A19_class_controls", """
select round(sum(auroc * n) / sum(n), 6) as weighted_auroc from (select grp, sum(case when p.score > q.score then cast(1 as double) when p.score = q.score then cast(0.5 as double) else 0 end) / count(*) as auroc, (select count(*)
    from sl s where s.grp = p.grp) as n from sl p join sl q using (grp)
  where p.label = 1 and q.label = 0 group by grp)""", "sl")
def a19(spark, sf_dir):
    per = metrics.auroc(scored(spark, sf_dir), ["grp"]).where("auroc is not null")
    return per.agg(r(F.sum(F.col("auroc") * F.col("n")) / F.sum("n")).alias("weighted_auroc"))


@query("A23_class_mean_predictor", """
select i, round(avg(abs(value - coalesce(case when n - 1 >= 20 then (s - value) / (n - 1) end, (gs - value) / (gn - 1)))), 6) as mean_error
from (select grp as i, value, count(*) over (partition by grp) as n, sum(value) over (partition by grp) as s, count(*) over () as gn, sum(value) over () as gs
  from sl) group by i""", "sl")
def a23(spark, sf_dir):
    s = scored(spark, sf_dir)
    per = s.groupBy("grp").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    whole = per.agg(F.sum("n").alias("gn"), F.sum("s").alias("gs"))
    met = s.join(F.broadcast(per), "grp").join(F.broadcast(whole))
    own = F.when(F.col("n") - 1 >= 20, (F.col("s") - F.col("value")) / (F.col("n") - 1))
    guess = F.coalesce(own, (F.col("gs") - F.col("value")) / (F.col("gn") - 1))
    return met.groupBy(F.col("grp").alias("i")).agg(r(F.avg(F.abs(F.col("value") - guess))).alias("mean_error"))


@query("A28_oriented_score", """
select grp, round(greatest(a, 1 - a), 6) as auroc, case when a >= 0.5 then 1 else -1 end as sign
from (select grp, sum(case when p.value > q.value then cast(1 as double) when p.value = q.value then cast(0.5 as double) else 0 end) / count(*) as a
  from sl p join sl q using (grp) where p.label = 1 and q.label = 0
  group by grp)""", "sl")
def a28(spark, sf_dir):
    s = scored(spark, sf_dir).select("grp", "label", "id", F.col("value").alias("score"))
    per = metrics.auroc(s, ["grp"]).where("auroc is not null")
    return per.select("grp", r(F.greatest(F.col("auroc"), 1 - F.col("auroc"))).alias("auroc"), F.when(F.col("auroc") >= 0.5, 1).otherwise(-1).alias("sign"))


@query("A34_merged_reports", """
select metric, count(*) as n, round(min(value), 6) as value from (select 'mean' as metric, avg(score) as value
  from sl group by grp union all select 'max', max(score) from sl
  group by grp) group by metric having count(*) > 1""", "sl")
def a34(spark, sf_dir):
    s = scored(spark, sf_dir).groupBy("grp")
    mean, top = s.agg(F.avg("score").alias("value")), s.agg(F.max("score").alias("value"))
    both = mean.select(F.lit("mean").alias("metric"), "value").unionByName(top.select(F.lit("max").alias("metric"), "value"))
    return both.groupBy("metric").agg(F.count("*").alias("n"), r(F.min("value")).alias("value")).where("n > 1")


@query("T8_first_windows", "select id from w order by id limit 25", "w")
def t8(spark, sf_dir):
    return windows(spark, sf_dir).select("id").orderBy("id").limit(25)


@query("U4_distinct_keys", "select chrom, count(distinct variant_key) as n from vk group by chrom", "vk")
def u4(spark, sf_dir):
    return keyed_variants(spark, sf_dir).dropDuplicates(["variant_key"]).groupBy("chrom").agg(F.count("*").alias("n"))


@query("H6_row_identity", """
select split, sha256('eval' || chr(10) || '5' || chr(10) || string_agg(cast(id as varchar), chr(10) order by cast(id as varchar))) as identity
from e group by split""", "e")
def h6(spark, sf_dir):
    ids = F.array_sort(F.collect_list(F.col("id").cast("string")))
    return pairs(spark, sf_dir).groupBy("split").agg(F.sha2(F.concat_ws("\n", F.lit("eval"), F.lit("5"), ids), 256).alias("identity"))


_DIGIT = "(position(substr(k, {0}, 1) in 'ATCG') - 1)"


@query("G8_G9_buckets", """
select id, case when id % 3 = 0 then 'coding' when id % 3 = 1 then 'intron' else 'other' end || '|' || case when label = 1 then 'high' else 'low' end || '|none' as bucket_id
from sl""", "sl")
def g8(spark, sf_dir):
    groups = [("coding", ("missense_variant", "synonymous_variant")), ("intron", ("intron", "intron_variant"))]
    note = F.when(F.col("id") % 3 == 0, "x; Missense Variant & intron").when(F.col("id") % 3 == 1, "upstream|intron-variant").otherwise("unknown")
    chain = labels.backoff_chain(labels.first_class(note, groups, "other"), F.when(F.col("label") == 1, "high").otherwise("low"), F.lit("none"))
    return scored(spark, sf_dir).select("id", F.element_at(chain, 1).alias("bucket_id"))


@query("G11_percentile", "select id, round(least(1, greatest(0, score / cast(40 as double))), 6) as percentile from sl", "sl")
def g11(spark, sf_dir):
    grid = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i * F.lit(4.0))
    cdf = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / F.lit(10.0))
    return scored(spark, sf_dir).select("id", r(calibration.percentile_on_grid(F.col("score"), grid, cdf)).alias("percentile"))


@query("G18_edit_cost", "select source_row_id, case when ref = alt then 0 else 1 end as cost from v", "v")
def g18(spark, sf_dir):
    return variants(spark, sf_dir).select("source_row_id", dna.edit_cost(F.col("ref"), F.col("alt")).alias("cost"))


@query("G19_confidence", "select grp, round(least(count(*) / cast(1000 as double), 1), 6) as confidence, count(*) < 100 as low_confidence from sl group by grp", "sl")
def g19(spark, sf_dir):
    per = scored(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"))
    return per.select("grp", r(calibration.confidence(F.col("n"))).alias("confidence"), (F.col("n") < 100).alias("low_confidence"))


@query("G21_prediction_loss", """
select id, round(1 - greatest(-1, least(1, list_sum(list_transform(list_zip(x, y), lambda q: q[1] * q[2])) / (sqrt(list_sum(list_transform(x, lambda q: q * q))) * sqrt(list_sum(list_transform(y, lambda q: q * q)))))) + list_sum(list_transform(list_zip(x, y), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) / 64, 6) as loss
from e""", "e")
def g21(spark, sf_dir):
    return pairs(spark, sf_dir).select("id", r(vectors.prediction_loss(F.col("x"), F.col("y"))).alias("loss"))


@query("ST4_not_done", "select id from w where id % 4 <> 0", "w")
def st4(spark, sf_dir):
    w = windows(spark, sf_dir)
    return not_done(w, w.where("id % 4 = 0"), "id").select("id")


_SPOTS = """
select chrom, any_value(seq) as seq, start_bp, count(*) as made from (
  select chrom, seq, greatest(0, least(pos - 1 - 128, n - 256)) as start_bp from rv where pos <= n and substr(seq, cast(pos as int), 1) = ref
) group by chrom, start_bp"""
_COUNTED = f"""
select s.chrom, s.start_bp, any_value(s.seq) as seq, any_value(s.made) as made, count(*) as variant_count from ({_SPOTS}) s
join rv on rv.chrom = s.chrom and rv.n is not null and s.start_bp < rv.pos and rv.pos <= s.start_bp + 256 group by s.chrom, s.start_bp"""


@query(
    "C1_placed_windows",
    f"""
select 'gnomad:' || chrom || ':' || (start_bp + 1) || '-' || (start_bp + 256) as record_id, 'gnomad_common' as source, 'gnomad' as variant_source, chrom, start_bp, start_bp + 256 as end_bp,
  sha256(rpad(substr(seq, cast(start_bp + 1 as int), 256), 256, 'A')) as digest, variant_count from ({_COUNTED}) where variant_count >= 3""",
    "rv",
)
def c1(spark, sf_dir):
    """REF is checked, bases are cut from tiles, each window stands once, sparse ones are dropped."""
    contigs = reference(spark, sf_dir)
    placed, _ = scoring.placed_windows(on_reference(spark, sf_dir, contigs), contigs, window=256, least=3)
    return placed.withColumn("digest", F.sha2("sequence", 256)).drop("sequence")


@query(
    "C1_placed_report",
    f"""
select count(*) filter (variant_count >= 3) as written, coalesce(sum(made - 1) filter (variant_count >= 3), 0)::bigint as duplicates, coalesce(sum(made) filter (variant_count < 3), 0)::bigint as sparse,
  (select count(*) from rv where n is null) as missing_contig, (select count(*) from rv where n is not null and (pos > n or substr(seq, cast(pos as int), 1) <> ref)) as ref_mismatch from ({_COUNTED})""",
    "rv",
)
def c1_report(spark, sf_dir):
    """What became of each variant read."""
    contigs = reference(spark, sf_dir)
    return scoring.placed_windows(on_reference(spark, sf_dir, contigs), contigs, window=256, least=3)[1]


