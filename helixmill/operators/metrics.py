"""Ranking, threshold and correlation metrics in closed form, and resampling by hashes. Rows: label (0 or 1), score, id; groups by any columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.digests import draw, priority
from helixmill.operators.ranking import met, running, seeded_rank, value_ranks
from helixmill.scratch import few, stored


def auroc(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mann-Whitney with ties at half. Rows are first summed per distinct score, so the running sum sees each score once."""
    sums = rows.groupBy(*by, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    return _wins(sums, by)


def _wins(sums: DataFrame, by: list[str]) -> DataFrame:
    one = running(sums, by, ["score"], upto=F.col("n"))
    wins = F.sum(F.col("p") * (F.col("upto") - F.col("n") / F.lit(2.0)))
    return one.groupBy(*by).agg((wins / F.nullif(F.sum("p") * F.sum("n"), F.lit(0)).cast("double")).alias("auroc"), F.sum(F.col("p") + F.col("n")).alias("n"))


def average_precision(rows: DataFrame, by: list[str]) -> DataFrame:
    """Stable descending order: ties by id."""
    seen = running(rows, by, [F.col("score").isNull(), -F.col("score"), "id"], hits=F.col("label"), at=F.lit(1))
    return seen.groupBy(*by).agg((F.sum(F.when(F.col("label") == 1, F.col("hits") / F.col("at").cast("double"))) / F.nullif(F.sum("label"), F.lit(0)).cast("double")).alias("average_precision"))


def threshold_metrics(rows: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    said, true = F.col("score") >= threshold, F.col("label") == 1
    rate = lambda good, of: F.count_if(good) / F.nullif(F.count_if(of), F.lit(0)).cast("double")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.count_if(said == true) / F.count("*").cast("double")).alias("accuracy"), rate(said & true, true).alias("sensitivity"), rate(~said & ~true, ~true).alias("specificity"))
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / F.lit(2.0))


def spearman(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson correlation of average ranks; null where a side is constant. Equal pairs are counted first."""
    pairs = rows.groupBy(*by, x, y).agg(F.count("*").cast("double").alias("c"))
    ranked = met(met(pairs, value_ranks(rows, by, x, "rx").drop("n"), [*by, x]), value_ranks(rows, by, y, "ry").drop("n"), [*by, y])
    moved = F.when((F.min("rx") < F.max("rx")) & (F.min("ry") < F.max("ry")), F.lit(True))
    total = lambda e: F.sum(F.col("c") * e)
    rx, ry, n = F.col("rx"), F.col("ry"), F.sum("c")
    top = total(rx * ry) - total(rx) * total(ry) / n
    vx, vy = total(rx * rx) - total(rx) * total(rx) / n, total(ry * ry) - total(ry) * total(ry) / n
    return ranked.groupBy(*by).agg(F.when(moved, top / F.sqrt(F.nullif(vx * vy, F.lit(0.0)))).alias("spearman"), n.cast("long").alias("n"))


def join_scores(scores: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Labels with their scores, and what is missing on either side: state is both, missing_score or extra_score."""
    a, b = labels.withColumn("_l", F.lit(True)), scores.withColumn("_s", F.lit(True))
    state = F.when(F.col("_l") & F.col("_s"), "both").when(F.col("_l"), "missing_score").otherwise("extra_score")
    return a.join(b, key, "full_outer").withColumn("state", state).drop("_l", "_s")


def equal_fields(scores: DataFrame, receipts: DataFrame, key: str, fields: list[str], how: str = "inner") -> DataFrame:
    """key, equal (all fields alike, nulls included) and state: verified, mismatched, missing_receipt or extra_receipt."""
    a = scores.select(key, F.struct(*fields).alias("_s"))
    b = receipts.select(key, F.struct(*fields).alias("_r"))
    equal = F.col("_s").eqNullSafe(F.col("_r"))
    state = F.when(F.col("_s").isNull(), "extra_receipt").when(F.col("_r").isNull(), "missing_receipt").when(equal, "verified").otherwise("mismatched")
    return a.join(b, key, how).select(key, equal.alias("equal"), state.alias("state"))


def folds(rows: DataFrame, k: int, seed: str, by: str = "label") -> DataFrame:
    """Stratified folds: round robin in a seeded order within each class."""
    return seeded_rank(rows, [by], priority(seed, F.col("id")), "id", "fold").withColumn("fold", (F.col("fold") - 1) % k)


#: Rows of a bin that draws are dealt to.
BIN_ROWS = 1024
#: Draws that one task deals to bins.
CHUNK = 1 << 20


def resampled(rows: DataFrame, replicates: int, seed: str, strata: list[str], columns: list[str], *, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The exact bootstrap: per replicate and stratum as many draws with replacement as the stratum has rows, one row a draw: strata, replicate, columns.

    Rows are numbered by id and stand in bins of bin_rows. Draws are first dealt to bins (a draw's bin is that of a uniform number below n), of which only the counts per replicate and bin are shuffled; then each bin's draws pick their rows
    within the bin, so neither draws nor rows of a replicate ever move. All draws are hashes of seed, stratum, replicate and their own number."""
    if not strata:
        return resampled(rows.withColumn("_all", F.lit("")), replicates, seed, ["_all"], columns, bin_rows=bin_rows).drop("_all")
    name = F.concat_ws(":", *strata)
    numbered = running(rows.select(*dict.fromkeys([*strata, "id", *columns])), strata, ["id"], _at=F.lit(1))
    spot = F.col("_at") - 1
    bins = stored(numbered.groupBy(*strata, F.expr(f"(_at - 1) div {bin_rows}").alias("_bin")).agg(F.array_sort(F.collect_list(F.struct((spot % bin_rows).alias("_place"), *(F.col(c).alias(f"_c_{c}") for c in columns)))).alias("_rows")), "bins")
    sizes = stored(bins.groupBy(*strata).agg(F.sum(F.size("_rows")).cast("long").alias("_n")), "strata")
    each = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    alone = each.where(F.col("_n") <= bin_rows).select(*strata, "replicate", F.lit(0).cast("long").alias("_bin"), F.col("_n").alias("_draws"))
    large = each.where(F.col("_n") > bin_rows).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long")))).repartition(*strata, "replicate", "_from")
    j = large.withColumn("_j", F.explode(F.sequence(F.col("_from"), F.least(F.col("_n"), F.col("_from") + CHUNK) - 1)))
    dealt = j.withColumn("_o", draw(seed, F.concat_ws(":", name, "replicate", "_j"), F.col("_n"))).groupBy(*strata, "replicate", F.expr(f"_o div {bin_rows}").alias("_bin")).agg(F.count("*").alias("_draws"))
    counts = alone.unionByName(dealt)
    both = met(counts, bins, [*strata, "_bin"])
    picks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_draws") - 1), lambda i: draw(seed, F.concat_ws(":", name, "replicate", F.concat(F.lit("b"), "_bin"), i), F.size("_rows").cast("long")))
    drawn = both.select(*strata, "replicate", "_rows", F.explode(picks).alias("_pick")).select(*strata, "replicate", F.get("_rows", F.col("_pick").cast("int")).alias("_r"))
    return drawn.select(*strata, "replicate", *(F.col(f"_r._c_{c}").alias(c) for c in columns if c not in strata))


def bootstrap_auroc(rows: DataFrame, replicates: int, seed: str, *, stratified: bool = True, bin_rows: int = BIN_ROWS) -> DataFrame:
    """AUROC of each replicate; stratified: positives and negatives are resampled apart."""
    drawn = resampled(rows, replicates, seed, ["label"] if stratified else [], ["label", "score"], bin_rows=bin_rows)
    sums = drawn.groupBy("replicate", "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    return _wins(sums, ["replicate"]).select("replicate", "auroc")


def permutation_p(rows: DataFrame, permutations: int, seed: str, *, digits: int = 3) -> DataFrame:
    """p_value: (hits + 1) / (permutations + 1), where a hit is a relabeling whose positives' scores sum to no less than the real ones. Relabeling k takes as positive
    the rows that come first in the order of sha256(seed:k:id), as many as there are.

    Rows are counted and summed per relabeling and hash prefix, which combines before the shuffle; only rows of the one prefix per relabeling that the cut goes through are ranked."""
    real = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("positives"), F.sum(F.col("label") * F.col("score")).alias("seen"))
    many = rows.select("id", "score", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("k"))
    marked = many.withColumn("p", priority(seed, F.concat_ws(":", "k", "id"))).withColumn("bin", F.conv(F.substring("p", 1, digits), 16, 10).cast("long"))
    sums = stored(marked.groupBy("k", "bin").agg(F.count("*").alias("n"), F.sum("score").alias("s")), "prefixes")
    along = Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row a prefix
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).join(F.broadcast(real))
    whole = before.where(F.col("before") + F.col("n") <= F.col("positives")).select("k", F.col("s").alias("drawn"))
    cut = few(before.where((F.col("before") < F.col("positives")) & (F.col("before") + F.col("n") > F.col("positives"))).select("k", "bin", (F.col("positives") - F.col("before")).alias("left")), "cuts")
    ranked = running(marked.join(cut, ["k", "bin"]), ["k"], ["p", "id"], at=F.lit(1)).where(F.col("at") <= F.col("left")).select("k", F.col("score").alias("drawn"))
    drawn = whole.unionByName(ranked).groupBy("k").agg(F.sum("drawn").alias("drawn"))
    every = sums.select("k").distinct().join(drawn, "k", "left").join(F.broadcast(real))
    return every.agg(((F.count_if(F.coalesce("drawn", F.lit(0.0)) >= F.coalesce("seen", F.lit(0.0))) + 1) / (F.count("*") + 1).cast("double")).alias("p_value"))
