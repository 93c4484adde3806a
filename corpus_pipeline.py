"""A training corpus from raw documents in five stages: language ID, exact dedup, MinHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes each as Parquet to the shared folder and reads
it for the next. All but the last return the columns of documents.

A row is a document, whatever its doc_id: where doc_ids repeat or are null, the stages that decide by id number those rows first (_unique), so rows with the
same doc_id and other texts are judged apart, and rows without one are deduplicated and mixed like others. Null or empty text: rejected by the first stage.
An empty table stays empty. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm._base import drop, durable, settled, tables
from helixmill.llm.exact_dedup import exact_dedup
from helixmill.llm.langid import identify
from helixmill.llm.mixing import mix
from helixmill.llm.near_dedup import near_duplicates
from helixmill.llm.queries import coded

#: Lists of ids are broadcast up to this many rows; beyond it the texts are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The near-dedup stage's least similarity; op4's 85 binds that query only.
NEAR_PERCENT = 80


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of docs has them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _met(docs: DataFrame, make: Callable[[], DataFrame], how: str) -> DataFrame:
    """docs joined with the ids that make() returns; the tables it writes on its way are deleted."""
    ids = settled(make, "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(few, "doc_id", how)


def _unique(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with doc_ids that are unique and not null, and the name of the column that has their own.

    Mostly these are the same, which a count of ids shows. Else the rows in question, and only those, are written with numbers above the greatest doc_id; if there is no room
    above it, all rows are."""
    (own,) = _free(docs, "own_id")
    marked = docs.withColumn(own, F.col("doc_id"))
    twice = durable(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    seen = docs.agg(F.max("doc_id").alias("top"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if not seen["nulls"] and not twice.limit(1).count():
        return marked, own
    top = seen["top"] if seen["top"] is not None else -1
    if top >= 1 << 62:
        return durable(marked.withColumn("doc_id", F.monotonically_increasing_id()), "numbered"), own
    known = marked.where("doc_id is not null")
    odd = marked.where("doc_id is null").unionByName(_met(known, lambda: twice, "left_semi"))
    numbered = durable(odd.withColumn("doc_id", F.lit(top + 1) + F.monotonically_increasing_id()), "numbered")
    return _met(known, lambda: twice, "left_anti").unionByName(numbered), own


def _own(rows: DataFrame, own: str, docs: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col(own)).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in none of the learned languages (no text, no letter)."""
    names = _free(docs, "held_out", "lang_pred", "score")
    return identify(docs, keep=tuple(docs.columns), names=tuple(names)).where(F.col(names[1]) != "und").drop(*names)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    rows, own = _unique(docs)
    return _own(_met(rows, lambda: exact_dedup(rows).where("not kept").select("doc_id"), "left_anti"), own, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more) stays."""
    rows, own = _unique(docs)
    return _own(_met(rows, lambda: near_duplicates(rows, percent=NEAR_PERCENT).where("not kept").select("doc_id"), "left_anti"), own, docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number."""
    rows, own = _unique(docs)
    times, copy = _free(rows, "times", "copy")
    often = F.round(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    drawn = lambda: mix(rows).select("doc_id", often.alias(times)).where(F.col(times) > 0)
    return _own(_met(rows, drawn, "inner").withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(times)))), own, docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of what they decode to."""
    return coded(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("minhash_near_dedup", near), ("mixing", mixing), ("bpe", bpe)]
#: SQL can express neither the language model nor the mixing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's tables are deleted once its result is written, and each result once the next one is, so at most two of them stand side by side."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        drop(spark, before)
        before = [tables()[-1]]
    return STAGES[-1][1](spark, docs, sf_dir)
