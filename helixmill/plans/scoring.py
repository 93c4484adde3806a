"""Plans over many operators: holdouts, tuples, placed windows, scoring with a pluggable encoder, planning."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.digests import draw
from helixmill.functions.dna import MAX_ALLELE
from helixmill.operators import tiles
from helixmill.operators.intervals import edges_of, sticking_out, upto, window_counts, windows_off
from helixmill.scratch import few, stored
from helixmill.sources import text

#: Tuples a window gives per source.
QUOTA = {"gnomad": 3, "clinvar": 3, "snv": 1, "indel": 1}


def hold_out_windows(windows: DataFrame, *, ids: DataFrame | None = None, chroms: list[str] | None = None, intervals: DataFrame | None = None) -> DataFrame:
    """Windows that no policy excludes: by record id, chromosome or overlap. A window without chromosome is only excluded by its id."""
    out = windows
    if ids is not None:
        out = out.join(ids.select("id").distinct(), "id", "left_anti")
    if chroms:
        out = out.where(F.col("chrom").isNull() | ~F.col("chrom").isin(chroms))
    return windows_off(out, intervals) if intervals is not None else out


def hold_out_edits(edits: DataFrame, *, keys: DataFrame | None = None, chroms: list[str] | None = None) -> DataFrame:
    out = edits.join(keys.select("variant_key").distinct(), "variant_key", "left_anti") if keys is not None else edits
    return out.where(F.col("chrom").isNull() | ~F.col("chrom").isin(chroms)) if chroms else out


def _chosen(seed: str, ident: Column, n: Column, k: Column) -> Column:
    """min(k, n) distinct whole numbers below n, each set of them as likely as any other (Floyd's algorithm), in the order they were drawn."""
    m = F.least(n, k)

    def step(taken: Column, i: Column) -> Column:
        last = n - m + i
        t = draw(seed, F.concat_ws(":", ident, i), last + 1)
        return F.array_append(taken, F.when(F.array_contains(taken, t), last).otherwise(t))

    return F.when(m > 0, F.aggregate(F.sequence(F.lit(0).cast("long"), m - 1), F.expr("cast(array() as array<bigint>)"), step)).otherwise(F.expr("cast(array() as array<bigint>)"))


def sampled_edits(windows: DataFrame, edits: DataFrame, *, seed: str, quota: dict[str, int]) -> DataFrame:
    """id, edit_source, source_row_id, rel_pos, slot: of each window and source, edits drawn without replacement among those whose REF lies inside the window.

    Edits are numbered along (chrom, edit_source), so a window's are a range of numbers; a seeded draw picks some of them, and only these are fetched, by an equi-join on the number. Work grows with windows and edits, not with
    their pairs. Edits that begin in a window and end beyond it are found by its end, and the draw leaves their numbers out."""
    limit = F.create_map(*(F.lit(x) for pair in quota.items() for x in pair))
    sources = few(edits.select("edit_source").distinct(), "sources")
    edges = edges_of(windows).join(sources)  # a few sources
    columns = edits.select("chrom", "edit_source", "pos", "source_row_id", F.length("ref").alias("n_ref"))
    points, ends = upto(columns, edges, ["chrom", "edit_source"], ["source_row_id"], F.lit(1))
    spans = ends.groupBy("id", "chrom", "edit_source").agg(*(F.max(F.when(F.col("side") == k, F.col("upto"))).alias(name) for k, name in ((0, "lo"), (1, "hi"))), F.min("pos").alias("start_bp")).where("lo < hi")
    beyond = sticking_out(windows, points.select("chrom", "edit_source", "pos", "n_ref", F.col("upto").alias("number")))
    cut = beyond.groupBy("id", "edit_source").agg(F.array_sort(F.collect_list("number")).alias("out"))
    some = spans.join(cut, ["id", "edit_source"], "left").withColumn("out", F.coalesce("out", F.expr("cast(array() as array<bigint>)")))
    drawn = some.withColumn("chosen", _chosen(seed, F.concat_ws(":", "id", "edit_source"), F.col("hi") - F.col("lo") - F.size("out"), limit[F.col("edit_source")].cast("long")))
    numbered = drawn.select("id", "chrom", "edit_source", "start_bp", "lo", "out", F.posexplode("chosen").alias("slot", "rank"))
    number = F.aggregate("out", F.col("lo") + 1 + F.col("rank"), lambda at, gone: at + F.when(gone <= at, 1).otherwise(0))
    wanted = numbered.select("id", "chrom", "edit_source", "start_bp", number.alias("upto"), (F.col("slot") + 1).cast("int").alias("slot"))
    met = wanted.join(points.select("chrom", "edit_source", "upto", "source_row_id", "pos"), ["chrom", "edit_source", "upto"])
    return met.select("id", "edit_source", "source_row_id", (F.col("pos") - 1 - F.col("start_bp")).alias("rel_pos"), "slot")


def training_tuples(windows: DataFrame, edits: DataFrame, *, seed: str, quota: dict[str, int] = QUOTA) -> DataFrame:
    """window id, edit_source, source_row_id, rel_pos, slot: per window and source a seeded draw of edits; what gnomad and clinvar lack falls back to synthetic single-base slots
    (source_row_id null, rel_pos from the seed). edits has chrom, pos, ref, edit_source, source_row_id."""
    real = stored(sampled_edits(windows, edits, seed=seed, quota=quota), "real")
    limit = F.create_map(*(F.lit(x) for pair in quota.items() for x in pair))
    wanted = windows.select("id", (F.col("end_bp") - F.col("start_bp")).alias("span"), F.explode(limit).alias("edit_source", "want"))
    have = real.groupBy("id", "edit_source").agg(F.count("*").alias("have"))
    short = wanted.join(have, ["id", "edit_source"], "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < want")
    made = short.withColumn("slot", F.explode(F.sequence(F.col("have").cast("int") + 1, F.col("want"))))
    spot = draw(seed, F.concat_ws(":", "id", "edit_source", "slot"), F.col("span") - 128) + 64
    synthetic = made.select("id", F.when(F.col("edit_source") == "indel", "indel").otherwise("snv").alias("edit_source"), F.lit(None).cast("long").alias("source_row_id"), spot.alias("rel_pos"), "slot")
    return real.unionByName(synthetic)


def placed_windows(variants: DataFrame, contigs: DataFrame, *, window: int, least: int, source: str = "gnomad_common", variant_source: str = "gnomad", tile: int = tiles.TILE) -> tuple[DataFrame, DataFrame]:
    """Windows centred on variants (chrom, pos, ref) whose REF the reference has, once each, that hold at least `least` variants, with their bases: rows of text.PLACED. And one row that says
    what became of the variants read: written, duplicates of a window written, in a sparse window, of another REF, or on no contig. contigs: tiles (contig, start, sequence).

    All variants on a contig count for a window, as REF is checked for its centre only. A window reaches no further than its contig; one longer than the contig is padded."""
    reach = max(window, MAX_ALLELE)
    halo = tiles.with_halo(contigs, reach, tile=tile)
    size = tiles.lengths(contigs)
    known = text.resolve_contigs(variants.select("chrom", "pos", "ref"), size).join(size, "contig", "left")
    judged = stored(tiles.against_reference(known, halo, longest=reach, tile=tile), "judged")
    start = F.greatest(F.lit(0), F.least(F.col("pos") - 1 - window // 2, F.col("length") - window))
    spots = judged.where("reads = 'match'").groupBy("chrom", "contig", start.cast("long").alias("start_bp")).agg(F.count("*").alias("made"))
    spots = spots.withColumn("end_bp", F.col("start_bp") + window).withColumn("id", F.concat(F.lit(f"{variant_source}:"), "chrom", F.lit(":"), F.col("start_bp") + 1, F.lit("-"), "end_bp"))
    counts = window_counts(spots.select("id", "chrom", "start_bp", "end_bp"), judged.where("reads <> 'missing_contig'").select("chrom", "pos", "ref"))
    counted = stored(spots.join(counts, "id").withColumnRenamed("n", "variant_count"), "spots")
    dense = tiles.fetch(counted.where(F.col("variant_count") >= least), halo, F.col("start_bp"), window, "bases", tile=tile)
    placed = dense.select(F.col("id").alias("record_id"), F.lit(source).alias("source"), F.lit(variant_source).alias("variant_source"), "chrom", "start_bp", "end_bp", F.rpad("bases", window, "A").alias("sequence"), "variant_count")
    is_dense = F.col("variant_count") >= least
    kept = counted.agg(F.count_if(is_dense).alias("written"), F.coalesce(F.sum(F.when(is_dense, F.col("made") - 1)), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(~is_dense, F.col("made"))), F.lit(0)).alias("sparse"))
    read = judged.agg(F.count_if(F.col("reads") == "missing_contig").alias("missing_contig"), F.count_if(F.col("reads").isin("mismatch", "outside")).alias("ref_mismatch"))
    return placed, kept.join(F.broadcast(read))


def encode_missing(requests: DataFrame, cache: DataFrame, encode: Callable[[pd.Series], pd.Series], *, key: str = "window_hash") -> DataFrame:
    """Requests with a state: from the cache, or from `encode` (sequences to lists of floats) for the distinct missing keys only."""
    state = F.pandas_udf(encode, "array<float>")
    missing = requests.select(key, "sequence").dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    fresh = missing.select(key, state("sequence").alias("state"))
    return requests.join(cache.select(key, "state").unionByName(fresh), key)


def toy_encoder(width: int = 8) -> Callable[[pd.Series], pd.Series]:
    """A deterministic stand-in for a neural encoder: base counts at residues of the position."""

    def encode(sequences: pd.Series) -> pd.Series:
        return sequences.map(lambda s: [float(sum(ord(c) for c in s[k::width]) % 1009) / 1009 for k in range(width)])

    return encode


def cross_entropy_plan(candidates: Callable[[int, dict], DataFrame], objective: Column, *, rounds: int, elites: int, smoothing: float = 0.5) -> tuple[DataFrame, dict[str, float]]:
    """A driver loop over small frames: candidates(round, weights) makes rows with kind and id, the best by objective then id refit the weights of kinds."""
    weights: dict[str, float] = {}
    best = None
    for k in range(rounds):
        made = candidates(k, weights).withColumn("objective", objective)
        best = made.orderBy("objective", "id").limit(elites)
        counts = {x["kind"]: x["count"] for x in best.groupBy("kind").count().collect()}
        weights = {kind: smoothing * weights.get(kind, 1.0 / max(1, len(counts))) + (1 - smoothing) * n / elites for kind, n in counts.items()}
    return best, weights


def refit(elites: DataFrame, column: str, before: dict[str, float], smoothing: float) -> DataFrame:
    """name, weight: the old weights smoothed with the elites' shares; one row a name."""
    shares = elites.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    old = elites.sparkSession.createDataFrame(list(before.items()), "name string, old double")
    whole = elites.agg(F.count("*").alias("all"))
    met = old.join(F.broadcast(shares), "name", "left").join(F.broadcast(whole))
    return met.select("name", (F.lit(smoothing) * F.col("old") + F.lit(1 - smoothing) * F.coalesce("n", F.lit(0)) / F.greatest("all", F.lit(1))).alias("weight"))


def zero_shot(rows: DataFrame, logp: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """rows (ref_window, alt_window) with score, minus the log-likelihood's gain. Each distinct window goes to the scorer once."""
    score = F.pandas_udf(logp, "double")
    distinct = rows.select(F.explode(F.array("ref_window", "alt_window")).alias("window")).distinct()
    known = distinct.select(F.xxhash64("window").alias("h"), "window", score("window").alias("logp"))
    side = lambda name: known.select(F.col("h").alias(f"{name}_h"), F.col("window").alias(f"{name}_window"), F.col("logp").alias(f"{name}_logp"))
    hashed = rows.withColumns({"ref_h": F.xxhash64("ref_window"), "alt_h": F.xxhash64("alt_window")})
    met = hashed.join(side("ref"), ["ref_h", "ref_window"]).join(side("alt"), ["alt_h", "alt_window"])
    return met.withColumn("score", F.col("ref_logp") - F.col("alt_logp")).drop("ref_h", "alt_h", "ref_logp", "alt_logp")


def build_cache(requests: DataFrame, path: str, encode: Callable[[pd.Series], pd.Series], *, key: str = "window_hash") -> None:
    """Adds to the cache below path, as a shard of its own, the states of the requests' keys that it lacks: run again after any stop, it goes on where it was."""
    import uuid

    spark, state = requests.sparkSession, F.pandas_udf(encode, "array<float>")
    wanted = requests.select(key, "sequence").dropDuplicates([key])
    try:
        done = spark.read.parquet(f"{path}/*").select(key)
    except AnalysisException:  # nothing has been built yet
        done = None
    missing = wanted if done is None else wanted.join(done, key, "left_anti")
    missing.select(key, state("sequence").alias("state")).write.parquet(f"{path}/{uuid.uuid4().hex}")


def assemble(specs: DataFrame, cache: DataFrame) -> DataFrame:
    """specs (id, source_key, target_key) with the cached states source and target; specs without both are left out."""
    side = lambda name: cache.select(F.col("key").alias(f"{name}_key"), F.col("state").alias(name))
    return specs.join(side("source"), "source_key").join(side("target"), "target_key")


def rollout(examples: DataFrame, predict: Callable[[Column], Column], steps: int) -> DataFrame:
    """id, k, predicted, target: the predictor's output fed back to it, after each of `steps` steps."""
    from functools import reduce

    states = F.array(*(reduce(lambda s, _: predict(s), range(k), F.col("source")) for k in range(1, steps + 1)))
    return examples.select("id", "target", F.posexplode(states).alias("at", "predicted")).select("id", (F.col("at") + 1).alias("k"), "predicted", "target")
