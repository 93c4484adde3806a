"""Exact dedup by deterministic block naming.

Texts are compared after white space is deleted. The normalised bytes are cut into fixed-size blocks; sorting (grouping) the blocks
that stand at the same index gives each an integer name, the smallest row number that has this block there. Adjacent names are then named
in pairs, again and again, until each row has one name: two rows have the same one if and only if their blocks are
all equal. No hash decides equality. Since every name is the smallest row number of its class, the last one is the class's identity.

A row whose (length, 64-bit fingerprint) nobody else has is a class of its own without any naming: a fingerprint can prove that
texts differ, never that they are equal. The other rows (candidates) are numbered as they are written to the shared folder; the number, not
doc_id, tells rows apart, so doc_id may repeat or be null.

Scale: the first pass shuffles some 100 bytes a document; only candidates are written and have their blocks shuffled.
Grouping combines on the map side, so a group of copies sends one row a task, and no group is ever collected. Where rows look their name up, a
fingerprint of many rows is salted: its names are repeated once per `salt_rows` rows, so no task meets a whole group.

Cases: null text counts as empty, so empty, null and all-white texts are one class. Of rows with equal code points those without doc_id come last;
if one of them stays, keep_id is null. Of rows that are alike in doc_id and code points too, one stays. Rows that repeat a doc_id with other
texts are other documents. An empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm._base import SPACE, durable, text_or_empty

BLOCK_BYTES = 4096
#: Fingerprints are broadcast up to this many; beyond it the texts are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows of one fingerprint that look a name up under one key.
SALT_ROWS = 128


def exact_dedup(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, broadcast_rows: int = BROADCAST_ROWS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = F.regexp_replace(text_or_empty(), SPACE, "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_or_empty()).alias("n_chars"), norm.alias("norm"))
    marked = texts.select("doc_id", "n_chars", "norm", F.octet_length("norm").alias("len"), F.xxhash64("norm").alias("fp"))
    signs = durable(marked.select("doc_id", "len", "fp", F.sha2("norm", 256).alias("text_sha256")), "signs")
    shared = durable(signs.groupBy("len", "fp").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    pick = F.broadcast(shared) if shared.count() <= broadcast_rows else shared
    copies = F.ceil(F.col("n") / salt_rows).cast("int")
    candidates = marked.join(pick.select("len", "fp", copies.alias("copies")), ["len", "fp"])
    numbered = durable(candidates.select(F.monotonically_increasing_id().alias("row"), "copies", "doc_id", "n_chars", "len", "norm"), "candidates")
    named = durable(_named(numbered, block_bytes), "named")
    rows = numbered.select("row", "copies", "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256")).join(named, "row")
    # of equal lengths the smallest doc_id, null last, then the first row
    best = F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("neg"), (-F.col("row")).alias("first")))
    groups = rows.groupBy("identity").agg(best.alias("best"), F.count("*").alias("group_size"), F.max("copies").alias("copies"))
    met = _salted(rows, groups, ["identity"], ["best", "group_size"])
    grouped = met.select("doc_id", (-F.col("best.neg")).alias("keep_id"), "group_size", (F.col("row") == -F.col("best.first")).alias("kept"), "text_sha256")
    alone = signs.join(pick.select("len", "fp"), ["len", "fp"], "left_anti")
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256").unionByName(grouped)


def _salted(rows: DataFrame, names: DataFrame, keys: list[str], bring: list[str]) -> DataFrame:
    """rows (row, copies, keys) with what their names bring. A row's salt is below its copies; a name stands once per salt of its row of most copies."""
    spread = names.select(*keys, *bring, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("copies")).cast("int")).join(spread, [*keys, "salt"]).drop("salt")


def _named(candidates: DataFrame, block_bytes: int) -> DataFrame:
    """row, identity of every candidate row."""
    raw = candidates.select("row", "copies", "len", F.col("norm").cast("binary").alias("raw"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(len - 1) div {block_bytes}")).cast("int")), lambda i: F.substring("raw", i * block_bytes + 1, F.lit(block_bytes)))
    blocks = raw.select("row", "copies", "len", F.posexplode(cut).alias("i", "block"))
    named = lambda level, keys: _salted(level, level.groupBy(*keys).agg(F.min("row").alias("name"), F.max("copies").alias("copies")), keys, ["name"]).select("row", "copies", "len", "i", "name")
    level = named(blocks, ["len", "i", "block"])
    width = max(1, -(-(candidates.agg(F.max("len")).first()[0] or 0) // block_bytes))
    while width > 1:
        level = durable(level, "level")
        side = F.expr("i % 2")
        # a right name is missing for all rows of a length or for none
        pairs = level.groupBy("row", "copies", "len", F.expr("cast(i div 2 as int)").alias("i")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        level = named(pairs, ["len", "i", "left", "right"])
        width = (width + 1) // 2
    return level.select("row", F.col("name").alias("identity"))
