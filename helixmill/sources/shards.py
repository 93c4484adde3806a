"""Parquet shards of fixed schemas and versions, and the score, receipt, label and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helixmill.functions.digests import canonical_sha256
from helixmill.operators.variants import canonical_order, require_schema
from helixmill.sources.text import parse_vcf, read_jsonl, write_jsonl, write_vcf

#: Populations, schemas and their versions.
POPULATIONS = ("afr", "ami", "amr", "asj", "eas", "fin", "mid", "nfe", "oth", "remaining", "sas")
GNOMAD = "chrom string, pos bigint, ref string, alt string, af_global float, " + ", ".join(f"af_{p} float" for p in POPULATIONS) + ", filter string, schema_version string"
CLINVAR = "chrom string, pos bigint, ref string, alt string, clinical_significance string, review_status string, gene_symbol string, clinvar_id bigint, schema_version string"
CALIBRATION = "bucket_id string, n_calibration bigint, cdf array<float>, sigma_grid array<float>, back_off_to string, schema_version string"
MEMBERSHIP = (
    "schema_version string, variant_key string, variant_digest string, chrom string, pos bigint, ref string, alt string, role string, reason_mask bigint, source string, source_row_id string, clinical_significance string"
)
VERSIONS = {GNOMAD: "2.0.0", CLINVAR: "1.0.0", CALIBRATION: "1.0.0", MEMBERSHIP: "1.0.0"}


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """rows in a schema's columns, types and order; what rows lack is null, schema_version is the current one."""
    fields = StructType.fromDDL(schema).fields
    rows = rows.withColumn("schema_version", F.lit(VERSIONS[schema]))
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def write_shard(rows: DataFrame, path: str, schema: str, **options: str) -> None:
    """Spark's commit puts the files in place whole; an empty table still writes its schema."""
    shaped(rows, schema).write.options(**options).parquet(path)


def read_shard(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The shard's rows; an error if its schema or the version of any row isn't the current one."""
    return require_schema(spark.read.parquet(path), StructType.fromDDL(schema), VERSIONS[schema])


def stale_rows(rows: DataFrame, schema: str) -> DataFrame:
    """One row: fits (the columns and types are the schema's), rows, and stale ones of another version."""
    fits = [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in StructType.fromDDL(schema)]
    return rows.agg(F.lit(fits).alias("fits"), F.count("*").alias("n"), F.count_if(~F.col("schema_version").eqNullSafe(F.lit(VERSIONS[schema]))).alias("stale"))


def parent_bucket(bucket: Column) -> Column:
    """The bucket one backs off to: without its last part, then *, then none."""
    return F.when(bucket == "*", None).when(bucket.contains("|"), F.regexp_replace(bucket, r"\|[^|]*$", "")).otherwise("*")


def write_calibration(table: DataFrame, path: str) -> None:
    write_shard(table.withColumn("back_off_to", parent_bucket(F.col("bucket_id"))), path, CALIBRATION, compression="zstd")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return read_shard(spark, path, CALIBRATION)


def write_role(rows: DataFrame, role: str, path: str) -> None:
    """The role's labels as JSON lines and its variants as VCF, both in canonical order. rows: chrom, pos, ref, alt, label, role, source_row_id."""
    mine = rows.where(F.col("role") == role)
    write_jsonl(canonical_order(mine).select("chrom", "pos", "ref", "alt", "label"), f"{path}/labels")
    write_vcf(mine.withColumn("id", F.col("source_row_id").cast("string")), f"{path}/variants")


def commitments() -> tuple[Column, Column]:
    """Of scores (chrom, pos, ref, alt, sigma_raw, sigma_calibrated, bucket_id): the digests of what went in and what came out."""
    made = canonical_sha256(alt=F.col("alt"), chrom=F.col("chrom"), pos=F.col("pos"), ref=F.col("ref"))
    out = canonical_sha256(bucket_id=F.col("bucket_id"), sigma_calibrated=F.col("sigma_calibrated").cast("string"), sigma_raw=F.col("sigma_raw").cast("string"))
    return made, out


def with_commitments(scores: DataFrame, model: str) -> DataFrame:
    """scores with the model and both commitments."""
    made, out = commitments()
    return scores.withColumns({"model_id": F.lit(model), "input_commitment": made, "output_commitment": out})


def commitments_sha256(input_commitment: Column, output_commitment: Column) -> Column:
    """One digest of both, 32 bytes: what a score and its receipt are compared by."""
    return F.unhex(F.sha2(F.concat_ws(" ", input_commitment, output_commitment), 256))


def write_scores(scores: DataFrame, model: str, path: str, **options: str) -> None:
    """Two JSON-lines folders, one row per ALT each: scores, and receipts with the commitments of the scores as written, so scores are computed once."""
    write_jsonl(scores, f"{path}/scores", **options)
    written = read_jsonl(scores.sparkSession, f"{path}/scores", scores.schema)
    write_jsonl(with_commitments(written, model).select("chrom", "pos", "ref", "alt", "model_id", "input_commitment", "output_commitment"), f"{path}/receipts", **options)


def receipted(scores: DataFrame, receipts: DataFrame) -> DataFrame:
    """The scores that have a receipt with both their commitments. Both sides are shuffled: scores without commitments, which are computed again on the other side, and 32 bytes a receipt."""
    theirs = receipts.where(F.col("input_commitment").isNotNull() & F.col("output_commitment").isNotNull()).select(commitments_sha256(F.col("input_commitment"), F.col("output_commitment")).alias("_both"))
    made, out = commitments()
    return scores.join(theirs, commitments_sha256(made, out) == F.col("_both"), "left_semi")


def read_records(spark: SparkSession, path: str, kind: str, schema: str = "chrom string, pos long, ref string, alt string, label string") -> DataFrame:
    """key, chrom, pos, label of the records in a file of kind parquet, jsonl, vcf (no label) or plain (one key a line)."""
    key = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt").alias("key")
    if kind == "parquet":
        return spark.read.parquet(path).select(key, "chrom", "pos", "label")
    if kind == "jsonl":
        return read_jsonl(spark, path, schema).select(key, "chrom", "pos", "label")
    if kind == "vcf":
        return parse_vcf(spark.read.text(path)).select(key, "chrom", "pos", F.lit(None).cast("string").alias("label"))
    lines = spark.read.text(path).select(F.trim("value").alias("key")).where("key <> ''")
    return lines.select("key", F.get(F.split("key", ":"), F.lit(0)).alias("chrom"), F.get(F.split("key", ":"), F.lit(1)).try_cast("bigint").alias("pos"), F.lit(None).cast("string").alias("label"))


def read_corpus(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Records of a Parquet corpus under the engine's names: fields maps record_id, sequence, source (and others) to the corpus's columns. Only these are read."""
    return spark.read.parquet(path).select(*(F.col(theirs).alias(ours) for ours, theirs in fields.items()))


def read_scored_csv(spark: SparkSession, scores: str, mapping: str) -> DataFrame:
    """accession, score, key: rows of a CSV of scores with the first mapped variant of a JSON-lines mapping, by key; unmapped and non-numeric rows are left out."""
    csv = spark.read.option("header", True).csv(scores).select("accession", F.col("score").try_cast("double").alias("score")).where("score is not null")
    first = read_jsonl(spark, mapping, "accession string, key string").groupBy("accession").agg(F.min("key").alias("key"))
    return csv.join(first, "accession")


def metric_lines(metrics: DataFrame, prefix: str) -> DataFrame:
    """value: text-format lines of counters (name, labels map, value)."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return metrics.select(F.concat(F.lit(prefix), "name", F.lit("{"), F.array_join(pairs, ","), F.lit("} "), F.col("value").cast("string")).alias("value"))
