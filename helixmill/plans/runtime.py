"""The engine as one object: an encoder, an optional predictor and a calibration table, applied to tables or files."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions import dna, vectors
from helixmill.operators import calibration, tiles
from helixmill.plans.proxies import reference, sequences
from helixmill.registry import query, r
from helixmill.scratch import few, folder, stored
from helixmill.sources import text

Encoder = Callable[[pd.Series], pd.Series]


class Runtime:
    """encode: sequences to lists of floats. predict: the state expected after an edit, from the state before (by default the same). table: bucket_id, sigma_grid, cdf, n_calibration."""

    def __init__(self, encode: Encoder, table: DataFrame, predict: Callable[[Column], Column] = lambda state: state):
        self.encode, self.table, self.predict = encode, table, predict

    def encode_windows(self, rows: DataFrame, column: str = "sequence") -> DataFrame:
        """rows with state; each distinct sequence is encoded once."""
        state = F.pandas_udf(self.encode, "array<float>")
        known = rows.select(column).distinct().select(F.sha2(column, 256).alias("_h"), state(column).alias("state"))
        return rows.withColumn("_h", F.sha2(column, 256)).join(known, "_h").drop("_h")

    def score(self, rows: DataFrame) -> DataFrame:
        """rows (id, ref_window, alt_window, bucket_id) with sigma_raw, sigma_calibrated, confidence; a bucket the table lacks takes *."""
        both = rows.select("id", "bucket_id", F.explode(F.create_map(F.lit("ref"), "ref_window", F.lit("alt"), "alt_window")).alias("side", "sequence"))
        states = self.encode_windows(both).groupBy("id", "bucket_id").agg(*(F.max_by("state", F.col("side") == s).alias(s) for s in ("ref", "alt")))
        raw = states.select("id", "bucket_id", vectors.l2(self.predict(F.col("ref")), F.col("alt")).alias("sigma_raw"))
        table = self.table.select(F.col("bucket_id").alias("found"), "sigma_grid", "cdf", "n_calibration")
        fields = ("found", "sigma_grid", "cdf", "n_calibration")
        own, star = few(table.select(F.struct(*fields).alias("own")), "buckets", 1000), table.where("found = '*'").select(F.struct(*fields).alias("star"))  # a grid of a thousand points a bucket
        met = raw.join(own, F.col("own.found") == F.col("bucket_id"), "left").join(F.broadcast(star))
        best = met.select("id", "sigma_raw", F.coalesce("own", "star").alias("b")).select("id", "sigma_raw", "b.*")
        return best.select("id", "sigma_raw", F.col("found").alias("bucket_id"), calibration.percentile_on_grid(F.col("sigma_raw"), F.col("sigma_grid"), F.col("cdf")).alias("sigma_calibrated"), calibration.confidence(F.col("n_calibration")).alias("confidence"))

    def score_vcf(self, spark: SparkSession, path: str, contigs: DataFrame, window: int, bucket: Column, *, tile: int = tiles.TILE) -> DataFrame:
        """As score, from a VCF and a reference's tiles (contig, start, sequence): each ALT's window is fetched around it and edited. ALTs on no contig, past its end or of another REF than it has are left out."""
        size = tiles.lengths(contigs)
        halo = tiles.with_halo(contigs, max(window, dna.MAX_ALLELE), tile=tile)
        v = text.resolve_contigs(text.read_vcf(spark, path, strict=False), size).join(size, "contig", "left")
        good = tiles.against_reference(v, halo, longest=max(window, dna.MAX_ALLELE), tile=tile).where("reads = 'match'").drop("reads")
        start = dna.centred_start(F.col("length"), F.col("pos") - 1, window)
        met = tiles.fetch(good.withColumn("start", start), halo, F.col("start"), window, "bases", tile=tile)
        name = F.concat_ws(":", "chrom", "pos", "ref", "alt").alias("id")
        cut = met.select(name, F.rpad("bases", window, "A").alias("ref_window"), (F.col("pos") - 1 - F.col("start")).cast("int").alias("at"), "ref", "alt", bucket.alias("bucket_id"))
        edited = cut.withColumn("alt_window", dna.apply_edit(F.col("ref_window"), F.col("at"), F.col("ref"), F.col("alt"))).dropDuplicates(["id"])
        return self.score(stored(edited, "edited"))  # windows are read for their sequences and for their states


@query(
    "X9_runtime",
    """
select id || ':' || p || ':' || base || ':' || base || 'GC' as id, round(abs(g - h), 5) as sigma_raw, case when id % 2 = 0 then 'even' else '*' end as bucket_id,
  round(least(1, abs(g - h) * 4), 5) as sigma_calibrated, case when id % 2 = 0 then 0.5 else 0.05 end as confidence from (
  select id, p, base, cast(length(w) - length(replace(replace(w, 'G', ''), 'C', '')) as double) / length(w) as g, cast(length(a) - length(replace(replace(a, 'G', ''), 'C', '')) as double) / length(a) as h from (
    select id, p, base, w, substr(w, 1, cast(p - 1 - s as int)) || base || 'GC' || substr(w, cast(p - s + 1 as int)) as a from (
      select id, p, s, base, rpad(substr(seq, cast(s + 1 as int), 32), 32, 'A') as w from (
        select id, seq, p, substr(seq, cast(p as int), 1) as base, greatest(0, least(p - 1 - 16, length(seq) - 32)) as s from (select id, seq, unnest(range(40, length(seq) + 1, 1000)) as p from dseq)
      ) where base <> 'N'
    )
  )
)""",
    "dseq",
)
def x9(spark, sf_dir):
    """A VCF of an insertion every 1,000 bases of every contig, scored by an encoder that SQL can repeat (the GC share)."""

    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [(x.count("G") + x.count("C")) / len(x)])

    spots = sequences(spark, sf_dir).where("length(seq) >= 40").select(F.col("id").cast("string").alias("contig"), "seq", F.explode(F.sequence(F.lit(40), F.length("seq"), F.lit(1000))).alias("pos"))
    base = F.substring("seq", F.col("pos"), F.lit(1))
    path = folder(spark, "edits")
    spots.where(base != "N").select(F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("."), base, F.concat(base, F.lit("GC"))).alias("value")).write.text(path)
    grid, cdf = F.array(F.lit(0.0), F.lit(0.25)), F.array(F.lit(0.0), F.lit(1.0))
    table = spark.createDataFrame([("*", 50), ("even", 500)], "bucket_id string, n_calibration long").withColumns({"sigma_grid": grid, "cdf": cdf})
    bucket = F.when(F.col("contig").cast("long") % 2 == 0, "even").otherwise("odd")
    out = Runtime(encode, table).score_vcf(spark, path, reference(spark, sf_dir), 32, bucket)
    return out.select("id", r("sigma_raw", 5).alias("sigma_raw"), "bucket_id", r("sigma_calibrated", 5).alias("sigma_calibrated"), "confidence")
