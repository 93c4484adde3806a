"""Ranks and running sums within groups of any size.

A group of up to `PER_BIN` rows is sorted by one window. Larger ones are cut into bins that hold about as many rows each: a sample of the group's rows in order gives the splitters, and a
row's bin is found by a binary search among them. Bins are summed, the sums of the bins before are joined to each bin's rows, and only these are sorted together. So bins follow the data, whatever the order is by (narrow values, ties
told apart by an id, digests, positions), and no task sorts a whole large group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.scratch import BROADCAST_ROWS, stored

#: Rows of a bin, and of a group that isn't cut.
PER_BIN = 250_000
#: Bins of a group at most (a power of two), and sampled rows per bin.
MOST_BINS, SAMPLED = 4096, 64


def met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls are equal."""
    other = right.select(*(F.col(k).alias(f"_r_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    return left.join(other, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys)), how).drop(*(f"_r_{k}" for k in keys))


def _key(order: list[Column | str]) -> Column:
    return F.struct(*((F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)))


def binned(rows: DataFrame, by: list[str], order: list[Column | str], per_bin: int = PER_BIN) -> DataFrame | None:
    """rows with `_bin`, which never falls along the order of a group; None if no group has more than per_bin rows. rows should be stored: they are read three times."""
    big = stored(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > per_bin), "big")
    groups = big.count()
    if not groups:
        return None
    few = F.broadcast if groups <= BROADCAST_ROWS else lambda x: x
    bins = F.least(F.ceil(F.col("_n") / per_bin), F.lit(MOST_BINS)).cast("int")
    share = F.least(F.lit(1.0), bins * SAMPLED / F.col("_n"))
    here = F.pmod(F.xxhash64(F.lit(17), *by, *order), F.lit(1 << 30))
    sample = met(rows, few(big.select(*by, bins.alias("_bins"), share.alias("_share"))), by).where(here < F.col("_share") * (1 << 30))
    held = sample.groupBy(*by).agg(F.array_sort(F.collect_list(_key(order))).alias("_s"), F.first("_bins").alias("_bins"))
    pick = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_bins") - 1, F.lit(1))), lambda i: F.get("_s", (i * F.size("_s") / F.col("_bins")).cast("int")))
    splits = stored(held.select(*by, F.array_distinct(pick).alias("_splits")), "splits")
    steps = F.array(*(F.lit(MOST_BINS >> k) for k in range(1, MOST_BINS.bit_length())))
    # the number of splitters at or below the key
    at = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get("_splits", n + step - 1) <= F.col("_key"), step).otherwise(0))
    return met(rows, few(splits), by, "left").withColumn("_key", _key(order)).withColumn("_bin", F.coalesce(at, F.lit(0))).drop("_splits", "_key")


def running(rows: DataFrame, by: list[str], order: list[Column | str], *, per_bin: int = PER_BIN, **sums: Column) -> DataFrame:
    """rows with running sums, the row itself included, in ascending `order` within the groups `by`."""
    if not by:
        return running(rows.withColumn("_one", F.lit(0)), ["_one"], order, per_bin=per_bin, **sums).drop("_one")
    held = stored(rows.withColumns({f"_{n}": c for n, c in sums.items()}), "running")
    cut = binned(held, by, order, per_bin)
    frame = lambda *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if cut is None:
        return held.withColumns({n: F.sum(f"_{n}").over(frame(*by)) for n in sums}).drop(*(f"_{n}" for n in sums))
    before = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "_bin").agg(*(F.sum(f"_{n}").alias(f"_all_{n}") for n in sums))
    offsets = totals.select(*by, "_bin", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums))
    both = met(cut, offsets, [*by, "_bin"])
    return both.withColumns({n: F.col(f"_off_{n}") + F.sum(f"_{n}").over(frame(*by, "_bin")) for n in sums}).drop("_bin", *(f"_{n}" for n in sums), *(f"_off_{n}" for n in sums))


def seeded_rank(rows: DataFrame, by: list[str], priority: Column, ident: str, name: str) -> DataFrame:
    """rows with `name`, their number from 1 in the order of a hex digest, then ident, within the groups `by`."""
    return running(rows.withColumn("_p", priority), by, ["_p", ident], **{name: F.lit(1)}).drop("_p")


def value_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Distinct (by, value) with their average rank `name` and number n: values are counted first, so ties cost one row."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(counts, by, [value], _upto=F.col("n")).withColumn(name, F.col("_upto") - (F.col("n") - 1) / F.lit(2.0)).drop("_upto")
