"""Deterministic sampling by hash priority: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.digests import pick, priority, uniform
from helixmill.operators.ranking import met, seeded_rank
from helixmill.scratch import few

#: Up to so many rows of a group, Spark limits a window's rows before its shuffle (spark.sql.optimizer.windowGroupLimitThreshold is 1,000).
FEW = 1000


def fraction(rows: DataFrame, ident: str, share: float, seed: str) -> DataFrame:
    return rows.where(uniform(seed, F.col(ident)) < share)


def first_k(rows: DataFrame, ident: str, k: int, seed: str) -> DataFrame:
    """The k rows of least priority (top-k, no full sort)."""
    return rows.withColumn("_p", priority(seed, F.col(ident))).orderBy("_p", ident).limit(k).drop("_p")


def first_k_per(rows: DataFrame, by: list[str], ident: str, k: int, seed: str) -> DataFrame:
    """The k rows of least priority of each group. For few of them, tasks keep k rows a group each before these are shuffled; for more, groups of any size are ranked."""
    p = priority(seed, F.col(ident))
    if not by or k > FEW:
        return seeded_rank(rows, by, p, ident, "_r").where(F.col("_r") <= k).drop("_r")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(p, ident))).where(F.col("_r") <= k).drop("_r")


def stratified_cap(rows: DataFrame, by: str, ident: str, cap: int, seed: str) -> DataFrame:
    """At most about cap rows, classes in proportion (half-even rounding), at least one of each."""
    counts = few(rows.groupBy(by).agg(F.count("*").alias("_n")), "classes")
    total = counts.agg(F.sum("_n").alias("_all"))
    quota = F.when(F.col("_all") <= cap, F.col("_n")).otherwise(F.greatest(F.lit(1), F.bround(F.lit(float(cap)) * F.col("_n") / F.col("_all"))))
    ranked = seeded_rank(rows, [by], priority(seed, F.col(ident)), ident, "_r")
    return met(ranked, counts.join(F.broadcast(total)).select(by, quota.alias("_q")), [by]).where("_r <= _q").drop("_r", "_q")


def categorical(rows: DataFrame, ident: str, weights: dict[str, float], seed: str, name: str) -> DataFrame:
    return rows.withColumn(name, pick(uniform(seed, F.col(ident)), weights))


def balanced(rows: DataFrame, flag: str, ident: str, limit: int, seed: str) -> DataFrame:
    """Half positives, the rest negatives, in seeded order."""
    half = limit // 2
    ranked = seeded_rank(rows, [flag], priority(seed, F.col(ident)), ident, "_r")
    return ranked.where(F.when(F.col(flag) == 1, F.col("_r") <= half).otherwise(F.col("_r") <= limit - half)).drop("_r")
