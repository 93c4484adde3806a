"""Digests of ordered sets of rows of any size: a tree of digests over chunks of successive rows, so that no group's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.digests import framed
from helixmill.operators.ranking import met, running
from helixmill.scratch import stored

#: Rows, or digests, of a chunk.
FAN = 1024
#: More than any group has: all its digests are one chunk.
ALL = 1 << 62


def _chunks(rows: DataFrame, by: list[str], fan: int) -> DataFrame:
    """by, _at, _sha and _n of chunks of fan rows (_at from 1, _bytes): the digest of their bytes in order."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.hex("_bytes").alias("h")))), lambda x: x["h"])
    made = rows.groupBy(*by, F.expr(f"(_at - 1) div {fan}").alias("_chunk")).agg(F.sha2(F.unhex(F.array_join(line, "")), 256).alias("_sha"), F.sum("_n").alias("_n"))
    return made.select(*by, (F.col("_chunk") + 1).alias("_at"), "_sha", "_n")


def rowset_digest(rows: DataFrame, by: list[str], order: list[Column | str], text: Column, *, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """by, n, digest of each group's rows in this order (which must tell all rows apart, but for equal ones).

    Each row is framed: 8 bytes of length and its text. A chunk's digest is the sha256 of its frames; chunks of digests are digested likewise, as raw bytes, until a group has one. A group of up to fan rows has the digest of its frames.

    With `levels`, a tree has no more of them: in the last one a group's digests are digested together however many they are, in one task. With two levels that is 32 bytes for each fan rows of a group."""
    if not by:
        return rowset_digest(rows.withColumn("_all", F.lit(0)), ["_all"], order, text, fan=fan, levels=levels).drop("_all")
    fan_at = lambda depth: ALL if depth == levels else fan
    numbered = running(rows.withColumn("_bytes", framed(text)), by, order, _at=F.lit(1)).withColumn("_n", F.lit(1).cast("long"))
    level, done, depth = _chunks(numbered.select(*by, "_at", "_bytes", "_n"), by, fan_at(1)), None, 1
    while True:
        level = stored(level, "digests")
        marked = met(level, level.groupBy(*by).agg(F.max("_at").alias("_most")), by)
        ready = marked.where("_most = 1").select(*by, F.col("_n").alias("n"), F.col("_sha").alias("digest"))
        done = ready if done is None else done.unionByName(ready)
        open_ = marked.where("_most > 1")
        if not open_.limit(1).count():
            return done
        depth += 1
        level = _chunks(open_.select(*by, "_at", F.unhex("_sha").alias("_bytes"), "_n"), by, fan_at(depth))
