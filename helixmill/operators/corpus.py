"""Cleaning of corpus records: a record without a sequence, of an unknown source or with other letters than ACGTN is skipped, or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions import dna, labels
from helixmill.functions.digests import uniform


def judged(records: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """records (record_id, sequence, source; any may be null) with sequence in upper case, source as the key its alias stands for, record_id filled from a good sequence's digest where
    it is blank, and reason: null for a good record, else missing_sequence, bad_source or bad_sequence, in this order."""
    raw = F.trim(F.coalesce("sequence", F.lit("")))
    source, sequence = labels.source_label(F.col("source"), aliases), dna.dna(raw)
    reason = F.when(raw == "", "missing_sequence").when(source.isNull(), "bad_source").when(sequence.isNull(), "bad_sequence")
    named = F.coalesce(F.nullif(F.trim(F.col("record_id").cast("string")), F.lit("")), F.when(reason.isNull(), F.substring(F.sha2(sequence, 256), 1, 16)))
    return records.withColumns({"reason": reason, "record_id": named, "source": source, "sequence": sequence})


def accepted(records: DataFrame, *, strict: bool = False, fraction: float = 1.0, seed: str = "0") -> DataFrame:
    """The good records of judged(); strict: a bad one is an error. fraction: a subset by the hash of the record_id, the same in every run."""
    if strict:
        error = F.raise_error(F.concat(F.lit("bad record: "), F.col("reason"))).cast("string")
        good = records.withColumn("reason", F.when(F.col("reason").isNotNull(), error))
    else:
        good = records
    good = good.where("reason is null").drop("reason")
    return good if fraction >= 1 else good.where(_drawn(seed) < fraction)


def _drawn(seed: str) -> Column:
    return uniform(seed, F.col("record_id"))
