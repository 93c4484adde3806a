"""Interval joins on (chrom, bin): an equi-join Spark can shuffle and split, with the exact predicate on top.

Windows are 0-based half-open, positions 1-based: a variant lies in a window iff start_bp < pos <= end_bp and its REF ends inside. A point has one bin;
an interval is exploded over the bins it touches. Where both sides are intervals, a pair counts only in the first bin both touch, so it is made once.
The bin is also the remedy for skew: there are 25 chromosomes but many bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.ranking import running
from helixmill.scratch import stored

BIN = 4096


def _bins(start: Column, last: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, last) / width)))


def variants_in_windows(windows: DataFrame, variants: DataFrame, *, width: int = BIN) -> DataFrame:
    """All columns of both; variants has chrom, pos, ref, windows has chrom, start_bp, end_bp."""
    w = windows.withColumn("_bin", _bins(F.col("start_bp"), F.col("end_bp"), width)).withColumnRenamed("chrom", "_chrom")
    v = variants.withColumn("_bin", F.floor(F.col("pos") / width))
    inside = (F.col("start_bp") < F.col("pos")) & (F.col("pos") <= F.col("end_bp")) & (F.col("pos") - 1 + F.length("ref") <= F.col("end_bp"))
    return v.join(w, (F.col("chrom") == F.col("_chrom")) & (v["_bin"] == w["_bin"]) & inside).drop("_bin", "_chrom")


def upto(points: DataFrame, edges: DataFrame, by: list[str], ident: list[str], n: Column) -> tuple[DataFrame, DataFrame]:
    """points (by, pos, ident) and edges (by, pos) with upto: the sum of `n` over the points at or before them, in the order of pos and ident. Both go along the chromosome once, in one order, so no pairs are made, and what
    lies between two points costs nothing."""
    both = points.withColumns({"_kind": F.lit(0), "_points": n}).unionByName(edges.withColumns({"_kind": F.lit(1), "_points": F.lit(0)}), allowMissingColumns=True)
    seen = stored(running(both, by, ["pos", "_kind", *ident], upto=F.col("_points")).drop("_points"), "upto")
    part = lambda kind, columns: seen.where(F.col("_kind") == kind).select(*columns, "upto")
    return part(0, points.columns), part(1, edges.columns)


def edges_of(windows: DataFrame) -> DataFrame:
    """id, chrom, pos and side (0 start, 1 end) of windows."""
    ends = F.array(F.struct(F.col("start_bp").alias("pos"), F.lit(0).alias("side")), F.struct(F.col("end_bp").alias("pos"), F.lit(1).alias("side")))
    return windows.where("chrom is not null").select("id", "chrom", F.explode(ends).alias("e")).select("id", "chrom", "e.pos", "e.side")


def sticking_out(windows: DataFrame, variants: DataFrame) -> DataFrame:
    """Pairs of a window (id) and a variant (its columns but chrom and pos) that begins in the window, and whose REF of n_ref bases ends beyond it: an equi-join on the window's end."""
    longer = variants.where("n_ref > 1").select("*", F.explode(F.expr("sequence(pos, pos + n_ref - 2)")).alias("end_bp"))
    return longer.join(windows.select("id", "chrom", "start_bp", "end_bp"), ["chrom", "end_bp"]).where("pos > start_bp").drop("chrom", "pos", "end_bp", "start_bp", "n_ref")


def window_counts(windows: DataFrame, variants: DataFrame) -> DataFrame:
    """id, n of the windows (id, chrom, start_bp, end_bp) that hold a variant, without making the pairs. Variants are counted per position and summed along the chromosome; a window's
    number is the difference of two such sums, less the variants of longer REF that begin in it and end beyond."""
    points = variants.groupBy("chrom", "pos").agg(F.count("*").alias("at"))
    _, edges = upto(points, edges_of(windows), ["chrom"], [], F.col("at"))
    within = edges.select("id", ((F.col("side") * 2 - 1) * F.col("upto")).alias("n"))
    out = sticking_out(windows, variants.select("chrom", "pos", F.length("ref").alias("n_ref"))).select("id", F.lit(-1).cast("long").alias("n"))
    return within.unionByName(out).groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")


def windows_with(windows: DataFrame, variants: DataFrame, *, hit: bool = True, width: int = BIN) -> DataFrame:
    """The windows that a variant's REF overlaps (or, hit=False, that none does)."""
    ident = [c for c in windows.columns]
    spans = variants.select(F.col("chrom").alias("_c"), (F.col("pos") - 1).alias("_s"), (F.col("pos") - 1 + F.length("ref")).alias("_e"))
    return _overlap(windows, spans, ident, hit, width)


def windows_off(windows: DataFrame, holdouts: DataFrame, *, width: int = BIN) -> DataFrame:
    """The windows that touch no holdout interval (chrom, start_bp, end_bp); windows without chrom always stay."""
    spans = holdouts.select(F.col("chrom").alias("_c"), F.col("start_bp").alias("_s"), F.col("end_bp").alias("_e"))
    return _overlap(windows, spans, windows.columns, False, width)


def _overlap(windows: DataFrame, spans: DataFrame, ident: list[str], hit: bool, width: int) -> DataFrame:
    """Semi- or anti-join. A window has many bins, so the hits are found by key first; the keys are distinct windows."""
    key = F.struct(*ident)
    w = windows.where("chrom is not null").select(key.alias("_w"), "chrom", "start_bp", "end_bp").distinct().withColumn("_bin", _bins(F.col("start_bp"), F.col("end_bp") - 1, width))
    s = spans.withColumn("_bin", _bins(F.col("_s"), F.col("_e") - 1, width))
    touch = (F.col("chrom") == F.col("_c")) & (w["_bin"] == s["_bin"]) & (F.col("_s") < F.col("end_bp")) & (F.col("start_bp") < F.col("_e"))
    found = w.join(s, touch, "left_semi").select("_w").distinct()
    same = None
    for c in ident:
        one = F.col(c).eqNullSafe(F.col(f"_w.{c}"))
        same = one if same is None else same & one
    return windows.join(found, same, "left_semi" if hit else "left_anti")


def overlapping_pairs(left: DataFrame, right: DataFrame, *, width: int = BIN) -> DataFrame:
    """Distinct (l_id, r_id) of intervals (id, chrom, start_bp, end_bp) that overlap."""
    side = lambda df, p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "chrom", "start_bp", "end_bp"))).withColumn(f"{p}_bin", _bins(F.col(f"{p}_start_bp"), F.col(f"{p}_end_bp") - 1, width))
    a, b = side(left, "l"), side(right, "r")
    once = F.col("l_bin") == F.floor(F.greatest("l_start_bp", "r_start_bp") / width)
    on = (F.col("l_chrom") == F.col("r_chrom")) & (F.col("l_bin") == F.col("r_bin")) & (F.col("l_start_bp") < F.col("r_end_bp")) & (F.col("r_start_bp") < F.col("l_end_bp")) & once
    return a.join(b, on).select("l_id", "r_id").distinct()
