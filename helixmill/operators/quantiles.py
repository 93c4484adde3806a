"""Exact quantiles of groups of any size: a sketch brackets each wanted rank, and only values inside the brackets are counted one by one.

`F.percentile` keeps all distinct values of a group in one buffer. Here the first pass takes the group's size and an approximate quantile a little below and above each wanted one; the second counts the values under the lower bound, and
the values between the bounds by value: some 4 in 10,000 rows, and ties cost one row. A running sum over these finds the two order statistics. A bracket that misses its rank is widened to the whole group,
so the result doesn't rest on the sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.operators.ranking import met, running
from helixmill.scratch import few, stored

#: The sketch's relative error is 1 / ACCURACY; brackets are twice as wide on each side. Groups up to WHOLE rows need no sketch.
ACCURACY, WHOLE = 10_000, 100_000


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], *, accuracy: int = ACCURACY, whole: int = WHOLE) -> DataFrame:
    """by, and per name the linearly interpolated quantile of the group's values; null values don't count, and a group without any has nulls."""
    if not by:
        return quantiles(rows.withColumn("_one", F.lit(0)), ["_one"], value, shares, accuracy=accuracy, whole=whole).drop("_one")
    held = rows.select(*by, F.col(value).cast("double").alias("_v"))
    wide = 2.0 / accuracy
    around = [s for q in shares.values() for s in (max(0.0, q - wide), min(1.0, q + wide))]
    sketch = stored(held.groupBy(*by).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", around, accuracy).alias("_s")), "sketch")

    def bracket(k: int, name: str, q: float):
        low = F.when((F.col("_n") > whole) & F.lit(q > wide), F.get("_s", F.lit(2 * k)))
        high = F.when((F.col("_n") > whole) & F.lit(q < 1 - wide), F.get("_s", F.lit(2 * k + 1)))
        return F.struct(F.lit(name).alias("name"), (F.lit(q) * (F.col("_n") - 1)).alias("rank"), low.alias("low"), high.alias("high"))

    brackets = sketch.where("_n > 0").select(*by, F.explode(F.array(*(bracket(k, *x) for k, x in enumerate(shares.items())))).alias("_b")).select(*by, "_b.*")
    found = stored(_at_ranks(held, brackets, by), "found")
    missed = stored(brackets.join(found.where("not sure").select(*(F.col(c).alias(f"_f_{c}") for c in [*by, "name"])), _same(by + ["name"])).drop(*(f"_f_{c}" for c in [*by, "name"])), "missed")
    if missed.limit(1).count():
        again = _at_ranks(held, missed.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}), by)
        found = found.where("sure").unionByName(again)
    named = found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in shares))
    return met(sketch.select(*by), named, by, "left")


def _same(columns: list[str]):
    out = None
    for c in columns:
        one = F.col(c).eqNullSafe(F.col(f"_f_{c}"))
        out = one if out is None else out & one
    return out


def _at_ranks(held: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """by, name, q and sure: the value at each bracket's rank, and whether the bracket holds it."""
    lists = few(brackets.groupBy(*by).agg(F.collect_list(F.struct("name", "rank", "low", "high")).alias("_bs")), "brackets")
    many = met(held.where("_v is not null"), lists, by).withColumn("_b", F.explode("_bs")).select(*by, "_v", "_b.*")
    zone = F.when(F.col("_v") < F.col("low"), -1).when(F.col("_v") > F.col("high"), 1).otherwise(0)
    counts = many.select(*by, "name", "rank", zone.alias("zone"), F.when(zone == 0, F.col("_v")).alias("_v")).groupBy(*by, "name", "rank", "zone", "_v").agg(F.count("*").alias("_c"))
    line = running(counts, [*by, "name", "rank"], ["zone", "_v"], upto=F.col("_c"))
    here = lambda r: (F.col("zone") == 0) & (F.col("upto") - F.col("_c") <= r) & (r < F.col("upto"))
    low, high = F.floor("rank"), F.ceil("rank")
    ends = line.groupBy(*by, "name", "rank").agg(F.max(F.when(here(low), F.col("_v"))).alias("a"), F.max(F.when(here(high), F.col("_v"))).alias("b"))
    return ends.select(*by, "name", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - low)).alias("q"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("sure"))
