"""Empirical score calibration with bucket backoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.digests import priority
from helixmill.operators.ranking import seeded_rank
from helixmill.scratch import stored


def bucket_samples(rows: DataFrame, seed: str, limit: int) -> DataFrame:
    """(bucket_id, value): rows of id, chain, value exploded to their chain; of each bucket the `limit` first in a seeded order."""
    many = rows.select("id", F.explode("chain").alias("bucket_id"), "value")
    return seeded_rank(many, ["bucket_id"], priority(seed, F.concat_ws(":", "bucket_id", "id")), "id", "rn").where(F.col("rn") <= limit).select("bucket_id", "value")


def calibrate(samples: DataFrame, grid: int) -> DataFrame:
    """bucket_id, n_calibration, sigma_grid, cdf: the share of values up to each point of an even grid from min to max.

    A value's place is the first grid point not under it. Values are counted per place, and counts are summed along the grid, so a bucket may hold any number of values."""
    stats = stored(samples.groupBy("bucket_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n")), "stats")
    point = lambda i: F.when(i >= grid - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(float(grid - 1)))
    near = F.coalesce(F.ceil((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * (grid - 1)), F.lit(0)).cast("int")
    # rounding may put the estimate a point off
    at = F.when(point(near - 1) >= F.col("value"), near - 1).when(point(near) < F.col("value"), near + 1).otherwise(near)
    counts = samples.join(stats, "bucket_id").select("bucket_id", F.greatest(F.lit(0), at).alias("i")).groupBy("bucket_id", "i").agg(F.count("*").alias("c"))
    points = stats.select("bucket_id", "n", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i")).withColumn("x", point(F.col("i")))
    along = Window.partitionBy("bucket_id").orderBy("i")
    summed = points.join(counts, ["bucket_id", "i"], "left").withColumn("cdf", F.sum(F.coalesce("c", F.lit(0))).over(along) / F.col("n").cast("double"))
    line = F.array_sort(F.collect_list(F.struct("i", "x", "cdf")))  # a grid's points
    return summed.groupBy("bucket_id").agg(F.first("n").alias("n_calibration"), line.alias("g")).select("bucket_id", "n_calibration", F.col("g.cdf").alias("cdf"), F.col("g.x").alias("sigma_grid"))


def choose_bucket(rows: DataFrame, sizes: DataFrame, least: int) -> DataFrame:
    """Adds bucket_id: the first bucket of a row's chain (but *) with at least `least` values, else *."""
    big = sizes.where((F.col("n_calibration") >= least) & (F.col("bucket_id") != "*")).select("bucket_id")
    many = rows.select("id", F.posexplode("chain").alias("at", "bucket_id"))
    best = many.join(big, "bucket_id").groupBy("id").agg(F.min_by("bucket_id", "at").alias("bucket_id"))
    return rows.join(best, "id", "left").withColumn("bucket_id", F.coalesce("bucket_id", F.lit("*")))


def percentile_on_grid(value: Column, grid: Column, cdf: Column) -> Column:
    """Linear in between points; below the grid its first, above it its last value; flat stretches take the larger."""
    n = F.size(grid)
    under = F.size(F.filter(grid, lambda g: g < value))  # bisect_left
    x0, x1 = F.element_at(grid, F.greatest(under, F.lit(1))), F.element_at(grid, F.least(under + 1, n))
    y0, y1 = F.element_at(cdf, F.greatest(under, F.lit(1))), F.element_at(cdf, F.least(under + 1, n))
    between = F.when(x1 == x0, F.greatest(y0, y1)).otherwise(y0 + (y1 - y0) * (value - x0) / F.nullif(x1 - x0, F.lit(0.0)))
    return F.when(under == 0, F.element_at(cdf, 1)).when(under >= n, F.element_at(cdf, n)).otherwise(between)


def confidence(n: Column) -> Column:
    return F.least(n / F.lit(1000.0), F.lit(1.0))
