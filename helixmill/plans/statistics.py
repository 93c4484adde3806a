"""Registered queries: ranks, calibration, resampling, linear models, epochs, receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions import dna, labels, vectors
from helixmill.operators import calibration, intervals, metrics, ranking
from helixmill.plans import research
from helixmill.plans.proxies import draw_sql, keyed_variants, scored, variants, windows
from helixmill.plans.proxies import vectors as pairs
from helixmill.registry import query, r
from helixmill.scratch import few, stored
from helixmill.streaming.events import after_cursor, epochs

_L2 = "sqrt(list_sum(list_transform(list_zip(x, y), lambda q: (q[1] - q[2]) * (q[1] - q[2]))))"


@query("J2_window_counts", """
select w.id, count(*) as n from v join w on v.chrom = w.chrom and w.start_bp < v.pos and v.pos <= w.end_bp and v.pos - 1 + length(v.ref) <= w.end_bp
group by w.id""", "v", "w")
def j2(spark, sf_dir):
    return intervals.window_counts(windows(spark, sf_dir), variants(spark, sf_dir))


@query("W2_average_rank", "select id, rank() over (partition by grp order by score) + (count(*) over (partition by grp, score) - 1) / cast(2 as double) as rank from sl", "sl")
def w2(spark, sf_dir):
    s = scored(spark, sf_dir).select("id", "grp", "score")
    return ranking.met(s, ranking.value_ranks(s, ["grp"], "score", "rank").drop("n"), ["grp", "score"]).select("id", "rank")


@query("W3_cumulative_positives", "select id, cast(sum(label) over (partition by grp order by score desc, id rows unbounded preceding) as bigint) as hits from sl", "sl")
def w3(spark, sf_dir):
    s = scored(spark, sf_dir)
    return ranking.running(s, ["grp"], [F.col("score").isNull(), -F.col("score"), "id"], hits=F.col("label")).select("id", F.col("hits").cast("long").alias("hits"))


@query("W6_shard_numbers", "select source_row_id, (row_number() over (partition by chrom order by pos, source_row_id) - 1) // 1000 as shard from v", "v")
def w6(spark, sf_dir):
    v = ranking.running(variants(spark, sf_dir), ["chrom"], ["pos", "source_row_id"], at=F.lit(1))
    return v.select("source_row_id", F.expr("cast((at - 1) div 1000 as bigint)").alias("shard"))


@query("T1_T9_canonical_order", "select source_row_id, row_number() over (partition by role order by cast(chrom as int), pos, ref, alt, source_row_id) as at from vk", "vk")
def t1(spark, sf_dir):
    v = ranking.running(keyed_variants(spark, sf_dir), ["role"], [dna.chrom_rank(F.col("chrom")), "pos", "ref", "alt", "source_row_id"], at=F.lit(1))
    return v.select("source_row_id", F.col("at").cast("long").alias("at"))


# calibration: a bucket's sample is its first SAMPLE values in a seeded order, which binds on the larger buckets


SAMPLE, LEAST = 60, 40
_CHAIN = """
c as (select id, value, unnest([grp || '|' || g || '|none', grp || '|' || g, grp, '*']) as bucket_id
  from (select *, case label when 1 then 'high' else 'low' end as g
    from sl))"""
_SAMPLED = f"""
, {_CHAIN}, k as (select * from (select *, row_number() over (partition by bucket_id order by sha256('7:' || bucket_id || ':' || id), id) as rn
    from c) where rn <= {SAMPLE})"""


def _cal(body: str) -> str:
    """SQL over the views sl, c (values by bucket) and k (a bucket's sample)."""
    from helixmill.plans.proxies import with_views

    return with_views("sl").rstrip() + _SAMPLED + " " + body


def _calibration_rows(spark, sf_dir):
    chain = labels.backoff_chain(F.col("grp"), F.when(F.col("label") == 1, "high").otherwise("low"), F.lit("none"))
    return scored(spark, sf_dir).select("id", chain.alias("chain"), "value")


@query("SM6_bucket_sample", _cal("select bucket_id, value, count(*) as n from k group by 1, 2"))
def sm6(spark, sf_dir):
    return calibration.bucket_samples(_calibration_rows(spark, sf_dir), "7", SAMPLE).groupBy("bucket_id", "value").agg(F.count("*").alias("n"))


_GRID = """
select bucket_id, i, n, case when i = 10 then hi else lo + (hi - lo) * i / cast(10 as double) end as x
from (select bucket_id, min(value) as lo, max(value) as hi, count(*) as n
  from k group by 1), range(11) t(i)"""
_CDF_FULL = _cal(f"""
select bucket_id, i, n as n_calibration, x as sigma, cast((select count(*)
    from k where k.bucket_id = q.bucket_id and k.value <= q.x) as double) / n as cdf
from ({_GRID}) q""")
_CDF = f"select bucket_id, i, n_calibration, round(sigma, 6) as sigma, round(cdf, 6) as cdf from ({_CDF_FULL})"


def _calibrated(spark, sf_dir):
    return calibration.calibrate(calibration.bucket_samples(_calibration_rows(spark, sf_dir), "7", SAMPLE), 11)


def _long(table):
    many = table.select("bucket_id", "n_calibration", F.posexplode(F.arrays_zip("sigma_grid", "cdf")).alias("i", "p"))
    return many.select("bucket_id", F.col("i").cast("long").alias("i"), "n_calibration", r(F.col("p.sigma_grid").cast("double")).alias("sigma"), r(F.col("p.cdf").cast("double")).alias("cdf"))


@query("A14_calibration", _CDF)
def a14(spark, sf_dir):
    return _long(_calibrated(spark, sf_dir))


@query("S13_C7_calibration_table", f"""
select bucket_id, i, n_calibration, round(cast(cast(sigma as float) as double), 6) as sigma, round(cast(cast(cdf as float) as double), 6) as cdf
from ({_CDF_FULL})""")
def s13(spark, sf_dir):
    """The calibration run: the table is written (zstd) and read again, with its schema and version checked."""
    from helixmill.scratch import folder
    from helixmill.sources import shards

    path = folder(spark, "calibration")
    shards.write_calibration(_calibrated(spark, sf_dir), path)
    return _long(shards.read_calibration(spark, path))


@query(
    "G10_backoff",
    _cal(
        f"select id, coalesce(case when a in (select bucket_id from k group by 1 having count(*) >= {LEAST}) then a end, case when b in (select bucket_id from k group by 1 having count(*) >= {LEAST}) then b end, case when grp in (select bucket_id from k group by 1 having count(*) >= {LEAST}) then grp end, '*') as bucket_id"
        " from (select id, grp, grp || '|' || g || '|none' as a, grp || '|' || g as b from (select *, case label when 1 then 'high' else 'low' end as g from sl))"
    ),
)
def g10(spark, sf_dir):
    rows = _calibration_rows(spark, sf_dir)
    sizes = calibration.bucket_samples(rows, "7", SAMPLE).groupBy("bucket_id").agg(F.count("*").alias("n_calibration"))
    return calibration.choose_bucket(rows, sizes, LEAST).select("id", "bucket_id")


_RAW = f"select id, case when split % 2 = 0 then 'even' else 'odd' end as bucket_id, {_L2} as v from e"
_TABLE = f"""
select bucket_id, any_value(n) as n, list(x order by i) as g, list((select count(*) from ({_RAW}) r where r.id % 2 = 0 and r.bucket_id = p.bucket_id and r.v <= p.x) / cast(n as double) order by i) as c from (
  select bucket_id, n, i, case when i = 10 then hi else lo + (hi - lo) * i / cast(10 as double) end as x from (
    select bucket_id, min(v) as lo, max(v) as hi, count(*) as n from ({_RAW}) where id % 2 = 0 group by bucket_id
  ), range(11) t(i)
) p group by bucket_id"""


@query(
    "C8_scoring",
    f"""
select id, bucket_id, round(v, 5) as sigma_raw, n < 100 as low_confidence, round(case when u = 0 then c[1] when u >= 11 then c[11] when g[u + 1] = g[u] then greatest(c[u], c[u + 1])
  else c[u] + (c[u + 1] - c[u]) * (v - g[u]) / (g[u + 1] - g[u]) end, 5) as sigma_calibrated
from (select r.id, r.bucket_id, r.v, n, g, c, len(list_filter(g, lambda q: q < v)) as u from ({_RAW}) r join ({_TABLE}) using (bucket_id) where r.id % 2 = 1)""",
    "e",
)
def c8(spark, sf_dir):
    """Half of the rows calibrate a grid of eleven points per bucket; the other half's raw distances become percentiles on their bucket's grid, with its confidence."""
    raw = pairs(spark, sf_dir).select("id", F.when(F.col("split") % 2 == 0, "even").otherwise("odd").alias("bucket_id"), vectors.l2(F.col("x"), F.col("y")).alias("value"))
    table = few(calibration.calibrate(raw.where("id % 2 = 0"), 11), "grids", 1000)
    met = raw.where("id % 2 = 1").join(table, "bucket_id")
    scaled = calibration.percentile_on_grid(F.col("value"), F.col("sigma_grid"), F.col("cdf"))
    return met.select("id", "bucket_id", r("value", 5).alias("sigma_raw"), r(scaled, 5).alias("sigma_calibrated"), (F.col("n_calibration") < 100).alias("low_confidence"))


# resampling: draws are sha256 digests, so SQL repeats them


#: Small, so that draws are dealt to bins on the smallest tables too.
_BIN = 64


def _boot(score: str, replicates: int, stratum: str) -> str:
    """SQL: AUROC of each replicate of the exact bootstrap. Draws are dealt to bins of rows in order of id, then pick rows within them."""
    bin_ = f"{draw_sql(f"g || ':' || replicate || ':' || j", 'n')} // {_BIN}"
    pick = draw_sql("g || ':' || replicate || ':b' || bin || ':' || i", f"least({_BIN}, n - bin * {_BIN})")
    return f"""
select replicate, sum(p * (under + n / cast(2 as double))) / nullif(cast(sum(p) as double) * cast(sum(n) as double), 0) as auroc from (
  select *, coalesce(sum(n) over (partition by replicate order by s rows between unbounded preceding and 1 preceding), 0) as under from (
    select replicate, s, sum(label) as p, sum(1 - label) as n from (
      select g, replicate, bin * {_BIN} + {pick} as o from (
        select g, n, replicate, bin, unnest(range(draws)) as i from (
          select g, n, replicate, 0 as bin, n as draws from z, range({replicates}) t(replicate) where n <= {_BIN}
          union all
          select g, n, replicate, bin, count(*) from (
            select g, n, replicate, {bin_} as bin from (select g, n, replicate, unnest(range(n)) as j from z, range({replicates}) t(replicate) where n > {_BIN})
          ) group by all
        )
      )
    ) join (select {stratum} as g, {score} as s, label, row_number() over (partition by {stratum} order by id) - 1 as o from sl) using (g, o) group by 1, 2
  )
) group by 1"""


def _sized(stratum: str, body: str) -> str:
    """SQL with the view z: strata and their sizes."""
    return f", z as (select {stratum} as g, count(*) as n from sl group by 1) {body}"


def _with_labels(body: str) -> str:
    from helixmill.plans.proxies import with_views

    return with_views("sl").rstrip() + body


@query("A26_bootstrap_auroc", _with_labels(_sized("label::varchar", f"select replicate, round(auroc, 6) as auroc from ({_boot('score', 40, 'label::varchar')})")))
def a26(spark, sf_dir):
    """Positives and negatives are drawn apart, as many as there are of each."""
    return metrics.bootstrap_auroc(scored(spark, sf_dir), 40, "7", bin_rows=_BIN).select(F.col("replicate").cast("long").alias("replicate"), r("auroc").alias("auroc"))


@query(
    "A25_paired_bootstrap",
    _with_labels(
        _sized(
            "''",
            f"""
select round(quantile_cont(d, 0.025), 6) as lo, round(quantile_cont(d, 0.5), 6) as mid, round(quantile_cont(d, 0.975), 6) as hi from (
  select a.auroc - b.auroc as d from ({_boot("score", 40, "''")}) a join ({_boot("value", 40, "''")}) b using (replicate)
)""",
        )
    ),
)
def a25(spark, sf_dir):
    """Both scores on the same draws of all rows."""
    s = scored(spark, sf_dir)
    one = lambda rows: metrics.bootstrap_auroc(rows, 40, "7", stratified=False, bin_rows=_BIN)
    d = one(s).select("replicate", F.col("auroc").alias("a")).join(one(s.withColumn("score", F.col("value"))).select("replicate", F.col("auroc").alias("b")), "replicate").select((F.col("a") - F.col("b")).alias("d"))
    return d.agg(r(F.percentile("d", 0.025)).alias("lo"), r(F.percentile("d", 0.5)).alias("mid"), r(F.percentile("d", 0.975)).alias("hi"))  # one row a replicate


@query(
    "A27_permutation_p",
    """
select (count(*) filter (drawn >= seen) + 1) / cast(count(*) + 1 as double) as p_value
from (select k, sum(score) as drawn from (select *, row_number() over (partition by k order by sha256('7:' || k || ':' || id), id) as spot
    from sl, range(60) t(k)) where spot <= (select sum(label) from sl)
  group by k), (select sum(score) filter (label = 1) as seen from sl)""",
    "sl",
)
def a27(spark, sf_dir):
    return metrics.permutation_p(scored(spark, sf_dir), 60, "7")


# linear models

_EIGEN = """
select n, m1, m2, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) as l1, (a + c) / 2 - sqrt(power((a - c) / 2, 2) + b * b) as l2
from (select count(*) as n, avg(x[1]) as m1, avg(x[2]) as m2, var_pop(x[1]) as a, var_pop(x[2]) as c, covar_pop(x[1], x[2]) as b
  from e)"""


@query("A22_explained_variance_of_two", f"select round(l1 / (l1 + l2), 5) as first, round(l2 / (l1 + l2), 5) as second from ({_EIGEN})", "e")
def a22(spark, sf_dir):
    """Two components, whose eigenvalues have a closed form."""
    first, second = research.explained_variance(pairs(spark, sf_dir).select(F.slice("x", 1, 2).alias("x")), "x", 2)
    return spark.createDataFrame([(round(float(first), 5), round(float(second), 5))], "first double, second double")


@query("G22_gaussian_kl_of_two", f"select round((l1 + l2 + m1 * m1 + m2 * m2 - 2 - ln(l1) - ln(l2)) / 2, 5) as kl from ({_EIGEN})", "e")
def g22(spark, sf_dir):
    kl = research.gaussian_kl(pairs(spark, sf_dir).select(F.slice("x", 1, 2).alias("x")), "x", 2)
    return spark.createDataFrame([(round(kl, 5),)], "kl double")


@query(
    "A24_ridge",
    "select round((b1), 4) as w1, round(b2, 4) as w2, round(my - b1 * m1 - b2 * m2, 2) as intercept from (select *, ((c22 + 10) * y1 - c12 * y2) / ((c11 + 10) * (c22 + 10) - c12 * c12) as b1, ((c11 + 10) * y2 - c12 * y1) / ((c11 + 10) * (c22 + 10) - c12 * c12) as b2"
    " from (select avg(score) as m1, avg(other) as m2, avg(value) as my, count(*) * var_pop(score) as c11, count(*) * var_pop(other) as c22, count(*) * covar_pop(score, other) as c12, count(*) * covar_pop(score, value) as y1, count(*) * covar_pop(other, value) as y2 from sl))",
    "sl",
)
def a24(spark, sf_dir):
    """Two features, lambda 10, the intercept free: SQL has the closed form."""
    w1, w2, intercept = research.ridge(scored(spark, sf_dir), ["score", "other"], "value", 10.0)
    return spark.createDataFrame([(round(float(w1), 4), round(float(w2), 4), round(float(intercept), 2))], "w1 double, w2 double, intercept double")


@query("A29_logistic_probe", """
select round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 5) as weight, round(ln(p0 / (1 - p0)), 5) as intercept
from (select avg(label) filter (grp = 'en') as p1, avg(label) filter (grp <> 'en') as p0
  from sl)""", "sl")
def a29(spark, sf_dir):
    """One binary feature, so that the fitted odds are those of its two classes."""
    w, intercept = research.logistic_probe(scored(spark, sf_dir).withColumn("x", F.when(F.col("grp") == "en", 1).otherwise(0)), ["x"], "label")
    return spark.createDataFrame([(round(float(w), 5), round(float(intercept), 5))], "weight double, intercept double")


# epochs, resume, receipts

_EPOCHS = "select epoch, id, row_number() over (partition by epoch order by sha256('7:' || epoch || ':' || id), id) as at from w, range(3) t(epoch)"


def _in_epochs(spark, sf_dir):
    many = epochs(windows(spark, sf_dir).select("id"), 3, "7", "id")
    return ranking.seeded_rank(many, ["epoch"], F.col("priority"), "id", "at").select(F.col("epoch").cast("long").alias("epoch"), "id", F.col("at").cast("long").alias("at"), "priority")


@query("ST2_epochs", _EPOCHS, "w")
def st2(spark, sf_dir):
    """Every window once an epoch, at its place in the epoch's own order."""
    return _in_epochs(spark, sf_dir).drop("priority")


@query("ST3_resume", f'select epoch, id from ({_EPOCHS}) where epoch = 2 or (epoch = 1 and "at" > 100)', "w")
def st3(spark, sf_dir):
    """What is left after the cursor stood at the hundredth window of the second epoch; the cursor is an epoch and a priority."""
    cursor = _in_epochs(spark, sf_dir).where("epoch = 1 and at = 100").first()
    rows = epochs(windows(spark, sf_dir).select("id"), 3, "7", "id")
    return after_cursor(rows, 1, cursor["priority"]).select(F.col("epoch").cast("long").alias("epoch"), "id")


@query("G15_normalised", """
select id, round(x[1] / n, 4) as first, round(x[32] / n, 4) as middle, round(x[64] / n, 4) as last
from (select *, sqrt(list_sum(list_transform(x, lambda q: q * q))) as n
  from e)""", "e")
def g15(spark, sf_dir):
    n = pairs(spark, sf_dir).select("id", vectors.normalised(F.col("x")).alias("u"))
    return n.select("id", *(r(F.element_at("u", i).cast("double"), 4).alias(name) for i, name in ((1, "first"), (32, "middle"), (64, "last"))))


_RECEIPTS = """
r as (select case when id % 11 = 3 then id + 1000000000 else id end as id, case when id % 13 = 5 then -score else score end as score, case when id % 9 = 0 then null else value end as value, grp, label
  from sl)"""


def _score_and_receipts(spark, sf_dir):
    """Two tables as written: scores, and receipts of which some lost their row, a value or a sign."""
    s = scored(spark, sf_dir).select("id", "score", "value", "grp", "label")
    kept = F.when(F.col("id") % 11 == 3, F.col("id") + 1_000_000_000).otherwise(F.col("id"))
    receipts = s.select(kept.alias("id"), F.when(F.col("id") % 13 == 5, -F.col("score")).otherwise(F.col("score")).alias("score"), F.when(F.col("id") % 9 != 0, F.col("value")).alias("value"), "grp", "label")
    return stored(s, "scores"), stored(receipts, "receipts")


@query("J19_receipt_equality", f"""
select s.id, s.score is not distinct from r.score and s.value is not distinct
from r.value and s.grp is not distinct from r.grp and s.label is not distinct
from r.label as equal from sl s join (with {_RECEIPTS} select *
  from r) r on r.id = s.id""", "sl")
def j19(spark, sf_dir):
    scores, receipts = _score_and_receipts(spark, sf_dir)
    return metrics.equal_fields(scores, receipts, "id", ["score", "value", "grp", "label"]).select("id", "equal")


@query("C16_receipts", f"""
select case when s.id is null then 'extra_receipt' when r.id is null then 'missing_receipt' when s.score is not distinct
from r.score and s.value is not distinct from r.value and s.grp is not distinct
from r.grp and s.label is not distinct from r.label then 'verified' else 'mismatched' end as state, count(*) as n
from sl s full join (with {_RECEIPTS} select * from r) r on r.id = s.id
group by 1""", "sl")
def c16(spark, sf_dir):
    """The report over both tables: verified, mismatched, missing and extra."""
    scores, receipts = _score_and_receipts(spark, sf_dir)
    found = metrics.equal_fields(scores, receipts, "id", ["score", "value", "grp", "label"], how="full_outer")
    return found.groupBy("state").agg(F.count("*").alias("n"))


@query("ST1_workers", "select id, cast(('0x' || substr(sha256('7:' || id), 1, 15))::ubigint % 4 as bigint) as worker from w", "w")
def st1(spark, sf_dir):
    """Each window's worker comes from its id's hash, so neither the order nor the number of partitions changes it."""
    from helixmill.functions.digests import draw

    return windows(spark, sf_dir).select("id", draw("7", F.col("id"), 4).alias("worker"))


@query("H2_bytes_digest", "select doc_id, 'sha256:' || sha256(coalesce(text, '')) as digest from documents")
def h2(spark, sf_dir):
    """Digest of bytes as they are stored."""
    from helixmill.plans.proxies import read

    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"))

