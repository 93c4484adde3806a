"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at `repeat` times its source's
size and the excess is shared again by weight until no target is above its stop. The words are then dealt in blocks of equal size by Sainte-Lague's rule, by
highest quotients votes / (2 seats + 1), three times: all blocks to the sources (votes: targets), a source's blocks to its sections and a section's blocks to its shards
(votes: words). Shards are documents dealt by a seeded hash, some `shard_rows` each, a section is `section_shards` shards; each gets an integer quota. Within a shard,
documents stand in a seeded order, once per pass, and the shard takes the first blocks of that line: whole passes first, then part of one.

The quotients are the exact ones, without a loop over blocks (`apportion`).

Scale: words are summed per (source, shard), at most one row a task each; shards and sections are of bounded size whatever a source's, so a
hot source is spread over many tasks. Only one row a source meets in one task.

Cases: null text has size 0, takes nothing. A table without words gives taken 0 and target 0. Null sources are one source, last in
order. Rows without doc_id are ordered by their text. Repeated rows are separate documents. Reruns agree: no random state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm._base import durable, n_words, text_or_empty

WEIGHTS = (1.0, 2.0, 3.0)
REPEAT = 3
SEED = 20
BLOCK_WORDS = 16
SHARD_ROWS, SECTION_SHARDS = 2_000, 1_000


def targets(sizes: DataFrame, *, weights=WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """From rows of source, source_size: adds s (its number, from 1), weight and target. Water filling in closed form: order sources by stop / weight; those before
    the level stop, the rest share what is left by weight. One row a source, in one task."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("s", F.row_number().over(order)).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1))
    by_stop = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    ahead, everything = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    with_sums = ranked.select(
        "*",
        F.coalesce(F.sum(F.col("source_size") * repeat).over(ahead), F.lit(0)).alias("stopped"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0))).alias("open"),
        F.sum("source_size").over(everything).alias("total"),
    )
    # the level that holds if this source is the first that doesn't stop
    level = (F.col("total") - F.col("stopped")) / F.col("open")
    stops = level * F.col("weight") > F.col("source_size") * repeat
    marked = with_sums.select("*", level.alias("level"), stops.alias("stops"))
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"]
    target = F.least((F.col("source_size") * repeat).cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.lit(0.0)))
    return marked.withColumn("final", final).select("s", *sizes.columns, "weight", target.alias("target"))


def apportion(parties: DataFrame, by: list[str], party: str, votes: str, total: str, seats: str) -> DataFrame:
    """Sainte-Lague within each group `by`: adds `seats`; a group's rows have the same `total`. Ties go to the least party. Seats are those of a loop that gives one seat at a time to
    the highest quotient votes / (2 seats + 1).

    Under the divisor sum(votes) / total a party gets round(votes / divisor); that misses the total by at most half a seat a party, and the divisor that doesn't miss it gives or takes a
    party at most 1 + its share of this miss. So many next (or last) quotients per party are ranked, at most two a party on the whole, and the group's highest (lowest) decide."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    every, given = F.sum(votes).over(whole), F.floor(F.col(votes) * F.col(total) / F.nullif(F.sum(votes).over(whole), F.lit(0)).cast("double") + 0.5).cast("long")
    first = parties.select(*by, party, F.col(votes).cast("double").alias("_v"), F.col(total).cast("long").alias("_t"), (F.col(votes) / F.nullif(every, F.lit(0)).cast("double") * F.count("*").over(whole) / 2).alias("_reach"), F.coalesce(given, F.lit(0)).alias("_given"))
    short = first.withColumn("_gap", F.col("_t") - F.sum("_given").over(whole)).where("_gap <> 0 and _v > 0")
    turns = short.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor("_reach").cast("int") + 1)))
    up = F.col("_gap") > 0
    quotient = F.when(up, -F.col("_v") / (2 * (F.col("_given") + F.col("_k")) + 1)).otherwise(F.col("_v") / (2 * (F.col("_given") - F.col("_k")) - 1))
    line = Window.partitionBy(*by, "_gap").orderBy(quotient, F.when(up, F.col(party)).otherwise(-F.col(party)))
    moved = turns.where(up | (F.col("_given") > F.col("_k"))).withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= F.abs("_gap"))
    more = moved.groupBy(*by, party).agg(F.sum(F.signum("_gap")).cast("long").alias("_more"))
    return parties.join(first.select(*by, party, "_given").join(more, [*by, party], "left").select(*by, party, (F.col("_given") + F.coalesce("_more", F.lit(0))).alias(seats)), [*by, party])


def mix(docs: DataFrame, *, weights=WEIGHTS, repeat: int = REPEAT, seed: int = SEED, block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, section_shards: int = SECTION_SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken."""
    text = text_or_empty()
    place = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.sha2(text, 256)), F.coalesce(F.col("source").cast("string"), F.lit("")))
    sized = durable(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words(text).alias("size"), place.alias("place")), "sized")
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights=weights, repeat=repeat)
    aims = aims.withColumn("shards", F.ceil(F.col("rows") / shard_rows).cast("long")).withColumn("all_blocks", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    aims = durable(apportion(aims, [], "s", "target", "all_blocks", "source_blocks"), "aims")
    few = F.broadcast(aims) if aims.count() <= 100_000 else aims
    met = sized.join(few.select(F.col("source").alias("named"), "s", "source_size", "target", "shards"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    dealt = met.withColumn("shard", F.pmod(F.xxhash64("place"), F.col("shards"))).withColumn("section", F.floor(F.col("shard") / section_shards))
    shards = durable(dealt.groupBy("s", "section", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    sections = shards.groupBy("s", "section").agg(F.sum("shard_size").alias("section_size")).join(few.select("s", "source_blocks"), "s")
    sections = apportion(sections, ["s"], "section", "section_size", "source_blocks", "section_blocks")
    quotas = apportion(shards.join(sections.select("s", "section", "section_blocks"), ["s", "section"]), ["s", "section"], "shard", "shard_size", "section_blocks", "blocks")
    quotas = durable(quotas.select("s", "section", "shard", "shard_size", F.least(F.col("blocks") * block, F.col("shard_size") * repeat).alias("quota")), "quotas")
    line = Window.partitionBy("s", "section", "shard").orderBy("place", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    lined = dealt.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    met = lined.join(F.broadcast(quotas) if quotas.count() <= 100_000 else quotas, ["s", "section", "shard"])
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.greatest(F.col("shard_size"), F.lit(1)))).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - passes * F.col("shard_size") - F.col("before")))
    return met.select("doc_id", "source", "size", "source_size", "target", F.least(F.col("size") * repeat, passes * F.col("size") + part).cast("long").alias("taken"))
