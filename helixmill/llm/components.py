"""Connected components of a distributed list of links, by union-find within tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._base import arrow, drop, durable, tables


class UnionFind(dict):
    """Root of each member is the least of its set."""

    def root(self, x: int) -> int:
        path = []
        while (up := self.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's links become one star per set; a batch at a time, so memory is bounded by the batch."""
    for batch in batches:
        sets = UnionFind()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(a, b)
        members = [x for x in sets if sets.root(x) != x]
        yield pa.record_batch([pa.array(members, pa.int64()), pa.array([sets[x] for x in members], pa.int64())], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """From links (a, b): doc_id, component_id (the least id reachable) of every id in a link but the least ones themselves.

    Large-star and small-star steps alternate until the links are stars; each keeps the number of links or lessens it and moves ids to lesser ones only, so they end,
    after about log2 of the ids rounds; each joins on ids with one narrow row a link."""
    now = durable(arrow(links.select("a", "b"), _local, "u long, v long"), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before, old = mark, tables()[-1]
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        now = durable(small.where("u <> v").distinct(), "links")
        drop(now.sparkSession, [old])
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("component_id"))


def pairs_array(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
