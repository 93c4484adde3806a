"""Synthetic edits from hashes of the sequence's id: the same whatever the partitioning. Rows: id, seq; results add k, rel_pos (0-based), ref, alt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.digests import draw

MARGIN, ATTEMPTS = 64, 8
#: Truncated geometric lengths: the share of 256 below which a draw means 1, 2, 3, else 4.
LENGTHS = (128, 192, 224)


def _name(kind: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(kind), "id", "k", *parts)


def _length(kind: str, seed: str) -> Column:
    d = draw(seed, _name(kind, F.lit("len")), 256)
    return F.when(d < LENGTHS[0], 1).when(d < LENGTHS[1], 2).when(d < LENGTHS[2], 3).otherwise(4)


def _other(base: Column, at: Column) -> Column:
    """One of the three other bases."""
    return F.substring(F.replace(F.lit("ACGT"), base, F.lit("")), at.cast("int") + 1, F.lit(1))


def _placed(rows: DataFrame, n: int, kind: str, seed: str, span: Column) -> DataFrame:
    """rows n times (k) with rel_pos and ref of `span` bases: the first of ATTEMPTS places that holds no N; without one, or in too short a sequence, no edit."""
    many = rows.where(F.length("seq") >= 2 * MARGIN + 16).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("span", span)
    at = lambda a: (draw(seed, _name(kind, F.lit("at"), a.cast("string")), F.length("seq") - 2 * MARGIN - F.col("span")) + MARGIN).cast("int")
    try_ = lambda a: F.transform(F.array(at(a)), lambda p: F.struct(p.alias("rel_pos"), F.substring("seq", p + 1, F.col("span")).alias("ref")))
    fits = lambda tried: F.get(F.filter(tried, lambda x: ~x["ref"].contains("N")), F.lit(0))
    # the first place mostly fits; the others are only drawn where it doesn't
    good = F.coalesce(fits(try_(F.lit(0))), fits(F.transform(F.sequence(F.lit(1), F.lit(ATTEMPTS - 1)), lambda a: try_(a)[0])))
    return many.withColumn("spot", good).where("spot is not null").select(*rows.columns, "k", "span", "spot.rel_pos", "spot.ref")


def snvs(rows: DataFrame, n: int, seed: str) -> DataFrame:
    placed = _placed(rows, n, "snv", seed, F.lit(1))
    return placed.withColumn("alt", _other(F.col("ref"), draw(seed, _name("snv", F.lit("alt")), 3))).drop("span")


def mnvs(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """Two to five neighbouring bases, each of them changed."""
    placed = _placed(rows, n, "mnv", seed, _length("mnv", seed) + 1)
    one = lambda j: _other(F.substring("ref", j, F.lit(1)), draw(seed, _name("mnv", F.lit("alt"), j.cast("string")), 3))
    return placed.withColumn("alt", F.array_join(F.transform(F.sequence(F.lit(1), F.length("ref")), one), "")).drop("span")


def indels(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """A base and one to four inserted ones for it, or the other way round."""
    inserts = draw(seed, _name("indel", F.lit("type")), 2) == 0
    placed = _placed(rows, n, "indel", seed, F.when(inserts, 1).otherwise(_length("indel", seed) + 1))
    one = lambda j: F.substring(F.lit("ACGT"), draw(seed, _name("indel", F.lit("base"), j.cast("string")), 4).cast("int") + 1, F.lit(1))
    added = F.array_join(F.transform(F.sequence(F.lit(1), _length("indel", seed)), one), "")
    return placed.withColumn("alt", F.when(inserts, F.concat("ref", added)).otherwise(F.substring("ref", 1, 1))).drop("span")


def actions(rows: DataFrame, n: int, seed: str, weights: dict[str, int], bins: int = 8) -> DataFrame:
    """n actions a sequence: type by weight, then place and bases; adds kind and the position bin. A sequence without room gives fewer."""
    d, seen, kind = draw(seed, F.concat_ws(":", F.lit("type"), "id", "k"), sum(weights.values())), 0, None
    for name, w in weights.items():
        seen += w
        kind = (F if kind is None else kind).when(d < seen, name)
    made, out = {"snv": snvs, "mnv": mnvs, "indel": indels}, None
    for name in weights:
        part = made[name](rows, n, seed).withColumn("kind", kind).where(F.col("kind") == name)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("bin", F.floor(F.col("rel_pos") * bins / F.length("seq")).cast("int"))


def distractors(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """id, rank, sequence: up to n sequences that differ from seq and from each other, each by one base; the first distinct ones of 2n draws."""
    edits = snvs(rows.select("id", "seq"), 2 * n, seed)
    edited = edits.select("id", "k", F.concat(F.substring("seq", F.lit(1), F.col("rel_pos")), "alt", F.substring("seq", F.col("rel_pos") + 2, F.length("seq"))).alias("sequence"))
    first = edited.groupBy("id", "sequence").agg(F.min("k").alias("k"))
    line = F.array_sort(F.collect_list(F.struct("k", "sequence")))  # 2n at most
    return first.groupBy("id").agg(F.slice(line, 1, n).alias("found")).select("id", F.posexplode("found").alias("rank", "f")).select("id", "rank", F.col("f.sequence").alias("sequence"))
