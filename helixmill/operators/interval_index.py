"""A persistent interval index: intervals stored by (chromosome, bin) in buckets, sorted, which later joins read without a shuffle; and a scan that proves what is stored.

An interval stands in every bin it touches, `first` where it begins. Lookups deal their own side to the same buckets, so only that side moves.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.intervals import BIN
from helixmill.scratch import folder

BUCKETS = 64


class Index(NamedTuple):
    """The name of the stored table, the folder it is in, and the width of a bin."""

    table: str
    path: str
    width: int


def build(rows: DataFrame, *, width: int = BIN, buckets: int = BUCKETS) -> Index:
    """Stores rows (chrom, start_bp, end_bp and any others; half-open) for lookups."""
    spark = rows.sparkSession
    table, path = f"interval_index_{uuid.uuid4().hex}", folder(spark, "interval-index")
    first, last = F.expr(f"start_bp div {width}"), F.expr(f"greatest(start_bp, end_bp - 1) div {width}")
    spread = rows.withColumn("bin", F.explode(F.sequence(first, last))).withColumn("first", F.col("bin") == first)
    dealt = spread.repartition(buckets, "chrom", "bin")  # as the buckets are, so that each is one file
    dealt.write.bucketBy(buckets, "chrom", "bin").sortBy("chrom", "bin", "start_bp", "end_bp").option("path", path).saveAsTable(table)
    return Index(table, path, width)


def overlapping(index: Index, queries: DataFrame) -> DataFrame:
    """Pairs of queries (q_id, q_chrom, q_start, q_end) and stored intervals that overlap, each once: in the first bin that both touch. The stored side isn't shuffled."""
    held = queries.sparkSession.table(index.table)
    bins = F.sequence(F.expr(f"q_start div {index.width}"), F.expr(f"greatest(q_start, q_end - 1) div {index.width}"))
    asked = queries.withColumn("q_bin", F.explode(bins))
    once = F.col("bin") == F.expr(f"greatest(start_bp, q_start) div {index.width}")
    touch = (F.col("start_bp") < F.col("q_end")) & (F.col("q_start") < F.col("end_bp"))
    return asked.hint("shuffle_merge").join(held, (F.col("q_chrom") == F.col("chrom")) & (F.col("q_bin") == F.col("bin")) & touch & once).drop("q_bin", "bin", "first")


def verify(index: Index, rows: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """check, failures: a second scan of the stored files, apart from what wrote them.

    order: rows of a file that come before the row ahead of them; bins: intervals that aren't in each bin they touch exactly once; missing and extra: rows of the source that aren't stored, and the other way round;
    repeated: keys that stand twice; and per rule the rows that break it (false or null)."""
    spark = rows.sparkSession
    files = spark.read.parquet(index.path).withColumns({"_file": F.col("_metadata.file_path"), "_split": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()})
    along = Window.partitionBy("_file").orderBy("_split", "_row")
    here = F.struct("chrom", "bin", "start_bp", "end_bp")
    order = files.select((F.lag(here).over(along) > here).alias("bad")).agg(F.count_if("bad").alias("failures")).select(F.lit("order").alias("check"), "failures")
    width = index.width
    touched = F.expr(f"greatest(start_bp, end_bp - 1) div {width} - start_bp div {width} + 1")
    inside = F.expr(f"bin between start_bp div {width} and greatest(start_bp, end_bp - 1) div {width} and first = (bin = start_bp div {width})")
    stored_keys = files.groupBy(*key, "chrom", "start_bp", "end_bp").agg(F.count("*").alias("copies"), F.count_distinct("bin").alias("bins"), F.bool_and(inside).alias("inside"), F.count_if("first").alias("firsts"), F.first(touched).alias("touched"))
    bins = stored_keys.select((F.col("inside") & (F.col("bins") == F.col("touched")) & (F.col("copies") == F.col("touched") * F.col("firsts"))).alias("good"))
    checks = order.unionByName(bins.agg(F.count_if(~F.coalesce("good", F.lit(False))).alias("failures")).select(F.lit("bins").alias("check"), "failures"))
    fields = [c for c in rows.columns]
    ours, theirs = rows.select(F.xxhash64(*fields).alias("h"), F.lit(1).alias("n")), files.where("first").select(F.xxhash64(*fields).alias("h"), F.lit(-1).alias("n"))
    balance = ours.unionByName(theirs).groupBy("h").agg(F.sum("n").alias("n"))
    sums = balance.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("n") < 0, -F.col("n"))), F.lit(0)).alias("extra"))
    for name in ("missing", "extra"):
        checks = checks.unionByName(sums.select(F.lit(name).alias("check"), F.col(name).alias("failures")))
    firsts = files.where("first")
    twice = firsts.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("failures"))
    checks = checks.unionByName(twice.select(F.lit("repeated").alias("check"), "failures"))
    for name, rule in rules.items():
        checks = checks.unionByName(firsts.agg(F.count_if(~F.coalesce(rule, F.lit(False))).alias("failures")).select(F.lit(name).alias("check"), "failures"))
    return checks
