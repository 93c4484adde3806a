"""Ingest of variant rows: reject reasons, projections, audits, labels, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.dna import chrom_rank, supported_allele
from helixmill.functions.labels import LABEL_RANK

#: Roles of chromosomes.
ROLES = {"20": "validation", "21": "evaluation"} | {str(c): "train" for c in (*range(1, 20), 22)}


def gnomad_reject(min_af: float = 0.01, longest: int = 16) -> Column:
    """First reason against a row of chrom, pos, ref, alt, af, filter; null for a good one."""
    return (
        F.when(F.col("filter") != "PASS", "filter").when(~(supported_allele(F.col("ref"), longest) & supported_allele(F.col("alt"), longest)), "allele").when(F.col("af").isNull() | F.isnan("af") | (F.col("af") < min_af), "af")
    )


def clinvar_reject(longest: int = 16) -> Column:
    return F.when(~(supported_allele(F.col("ref"), longest) & supported_allele(F.col("alt"), longest) & (F.col("ref") != F.col("alt"))), "allele")


def prepare(rows: DataFrame, reject: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and counts by reason (good ones under 'written')."""
    marked = rows.withColumn("reject", reject)
    return marked.where("reject is null").drop("reject"), marked.groupBy(F.coalesce("reject", F.lit("written")).alias("reason")).agg(F.count("*").alias("n"))


def role(chrom: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[chrom]


def role_crosstab(rows: DataFrame, by: str) -> DataFrame:
    """Rows per value of `by` and role, with zeros."""
    roles = ("train", "validation", "evaluation")
    return rows.groupBy(by).agg(*(F.count_if(F.col("role") == r).alias(r) for r in roles), F.count_distinct("variant_key").alias("n_keys"))


def best_label(rows: DataFrame) -> DataFrame:
    """One row per variant_key: best label, then least source_row_id, then label."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for pair in LABEL_RANK.items() for x in pair))[F.col("cls")], F.lit(9))
    order = Window.partitionBy("variant_key").orderBy(rank, "source_row_id", "cls")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def label_conflicts(rows: DataFrame) -> DataFrame:
    """Keys with a positive and a negative label."""
    flag = F.col("cls").isin("P", "LP")
    return rows.where(F.col("cls").isin(*LABEL_RANK)).groupBy("variant_key").agg(F.bool_or(flag).alias("any_positive"), F.bool_and(flag).alias("all_positive")).where("any_positive and not all_positive").select("variant_key")


def cross_role_leaks(rows: DataFrame) -> DataFrame:
    return rows.groupBy("variant_key").agg(F.count_distinct("role").alias("n_roles")).where("n_roles > 1")


def consistent_first(rows: DataFrame) -> DataFrame:
    """Labelled rows deduplicated by key: groups with mixed labels go, else the first row stays."""
    good = rows.where(F.col("cls").isin(*LABEL_RANK)).withColumn("flag", F.col("cls").isin("P", "LP"))
    return good.groupBy("variant_key").agg(F.bool_or("flag").alias("a"), F.bool_and("flag").alias("b"), F.min(F.struct("source_row_id", "cls")).alias("one")).where("a = b").select("variant_key", "one.cls", "one.source_row_id")


def canonical_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(chrom_rank(F.col("chrom")), "pos", "ref", "alt", "source_row_id")


def gnomad_audit(rows: DataFrame, min_af: float = 0.01) -> DataFrame:
    """One pass: counts, ranges and failed checks; first_bad is the least ordinal that fails any. The stored frequency is a float, so is the bound."""
    bad = {
        "bad_ref": ~supported_allele(F.col("ref")),
        "bad_alt": ~supported_allele(F.col("alt")),
        "bad_pos": F.col("pos") < 1,
        "bad_af": F.col("af").cast("float") < F.lit(min_af).cast("float"),
        "bad_filter": F.col("filter") != "PASS",
    }
    any_bad = None
    for c in bad.values():
        any_bad = c if any_bad is None else any_bad | c
    return rows.agg(F.count("*").alias("n"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"), F.count("af").alias("n_af"), *(F.count_if(c).alias(k) for k, c in bad.items()), F.min(F.when(any_bad, F.col("source_row_id"))).alias("first_bad"))


def require_schema(rows: DataFrame, schema, version: str) -> DataFrame:
    """rows, if they have exactly this schema and version; an error otherwise."""
    if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in schema]:
        raise ValueError("the shard's schema is not the current one")
    if rows.where(~F.col("schema_version").eqNullSafe(F.lit(version))).limit(1).count():
        raise ValueError("the shard holds rows of another schema version")
    return rows
