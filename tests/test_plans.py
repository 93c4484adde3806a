"""Plans, streams and sampling on small frames."""

import datetime

import pandas as pd
from pyspark.sql import functions as F

from helixmill.functions import dna, vectors
from helixmill.operators import calibration, intervals, sampling
from helixmill.plans import scoring
from helixmill.streaming import events


def test_tuples_fill_their_quota(spark):
    windows = spark.createDataFrame([(1, "1", 0, 4096), (2, None, 0, 4096)], "id long, chrom string, start_bp long, end_bp long")
    edits = spark.createDataFrame([("1", 100 + i, "A", "C", "gnomad" if i % 2 else "clinvar", i) for i in range(10)] + [("1", 4097, "A", "C", "gnomad", 99)], "chrom string, pos long, ref string, alt string, edit_source string, source_row_id long")
    rows = scoring.training_tuples(windows, edits, seed="1").collect()
    one = [r for r in rows if r.id == 1]
    assert sorted(r.edit_source for r in one) == ["clinvar"] * 3 + ["gnomad"] * 3 + ["indel", "snv"]
    two = [r for r in rows if r.id == 2]
    assert len(two) == 8 and all(r.source_row_id is None and 64 <= r.rel_pos < 4032 for r in two)
    assert sorted(map(str, rows)) == sorted(map(str, scoring.training_tuples(windows.repartition(3), edits.repartition(5), seed="1").collect()))


def test_unplaced_windows_stay(spark):
    windows = spark.createDataFrame([(1, "1", 0, 10), (2, None, 0, 10), (3, "1", 50, 60)], "id long, chrom string, start_bp long, end_bp long")
    holdouts = spark.createDataFrame([("1", 9, 50)], "chrom string, start_bp long, end_bp long")
    assert sorted(r.id for r in intervals.windows_off(windows, holdouts).collect()) == [2, 3]
    plan = intervals.variants_in_windows(windows, spark.createDataFrame([("1", 5, "A")], "chrom string, pos long, ref string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan and "Cross" not in plan


def test_encoder_sees_missing_keys_only(spark):
    requests = spark.createDataFrame([("a", "AC"), ("a", "AC"), ("b", "GT")], "window_hash string, sequence string")
    cache = spark.createDataFrame([("b", [9.0])], "window_hash string, state array<float>")
    rows = scoring.encode_missing(requests, cache, lambda s: pd.Series([[float(len(x))] for x in s])).collect()
    assert sorted((r.window_hash, r.state) for r in rows) == [("a", [2.0]), ("a", [2.0]), ("b", [9.0])]


def test_planner_keeps_the_best(spark):
    def candidates(k, weights):
        return spark.createDataFrame([(k * 100 + i, "snv" if i % 2 else "indel", float((i * 7) % 20)) for i in range(20)], "id long, kind string, x double")

    best, weights = scoring.cross_entropy_plan(candidates, F.abs(F.col("x") - 7), rounds=2, elites=4)
    assert [r.x for r in best.orderBy("objective", "id").collect()][0] == 7.0 and abs(sum(weights.values()) - 1) < 0.51


def test_edits_keep_length(spark):
    row = spark.createDataFrame([("AACCGGTT",)], "s string").select(
        dna.apply_edit(F.col("s"), F.lit(1), F.lit("A"), F.lit("TTT"), preserve_length=True).alias("left"),
        dna.apply_edit(F.col("s"), F.lit(6), F.lit("TT"), F.lit("A"), preserve_length=True).alias("right"),
        dna.kmer_ids(F.lit("AAAAAACCCCCCAAN")).alias("ids"), dna.trimmed(F.lit(10), F.lit("GCAAT"), F.lit("GCACAAT")).alias("t"), dna.closed_chrom(F.lit("chr01")).alias("c"),
    ).first()
    assert row.left == "ATTTCCGG" and row.right == "NAACCGGA" and row.ids == [0, 2730, -1] and row.c == "1"
    assert (row.t.pos, row.t.ref, row.t.alt) == (10, "G", "GCA") or len(row.t.ref) == 1


def test_calibration_and_vectors(spark):
    rows = spark.createDataFrame([(i, ["a|b", "a", "*"], float(i)) for i in range(4)], "id long, chain array<string>, value double")
    table = {r.bucket_id: r for r in calibration.calibrate(calibration.bucket_samples(rows, "1", 3), 3).collect()}
    assert table["*"].n_calibration == 3 and list(table["*"].cdf)[-1] == 1.0
    v = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 0.0, 3.0], [[1.0, 3.0], [3.0, 5.0], [5.0, 7.0]])], "a array<double>, b array<double>, m array<array<double>>")
    got = v.select(vectors.chunked_l2(F.col("a"), F.col("b"), 1, "median").alias("d"), vectors.chunked_l2(F.col("a"), F.col("b"), 2, "max").alias("x"), vectors.mean_pool(F.col("m"), F.lit(1), F.lit(2)).alias("p")).first()
    assert got.d == 0 and got.x == 2 and got.p == [4.0, 6.0]


def test_sampling_ignores_partitioning(spark):
    rows = spark.range(2000).withColumnRenamed("id", "i").withColumn("g", F.when(F.col("i") < 20, "rare").otherwise("often"))
    cap = {r.g: r["count"] for r in sampling.stratified_cap(rows, "g", "i", 50, "1").groupBy("g").count().collect()}
    assert cap == {"rare": 1, "often": 50}
    a, b = (sorted(r.i for r in sampling.first_k(rows.repartition(n), "i", 30, "1").collect()) for n in (1, 7))
    assert a == b and abs(sampling.fraction(rows, "i", 0.25, "1").count() - 500) < 100


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    batches = [[(at + datetime.timedelta(minutes=m), "x", 1.0) for m in ms] for ms in ((0, 3, 11), (12, 40), (1, 41))]
    schema = "ts timestamp, event_type string, value double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    like = spark.createDataFrame([], schema)
    stream = events.read_stream(spark, f"{tmp_path}/in/*", like)
    run = events.windowed_counts(stream, "10 minutes", "5 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    closed = {r.start.minute: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(closed) <= {0, 10} and closed.get(10) == 2
    again = events.epochs(spark.range(5), 2, "s", "id")
    first = again.orderBy("epoch", "priority").first()
    assert events.after_cursor(again, first.epoch, first.priority).count() == 9
    static = spark.createDataFrame([(1, "1", 0, 100)], "id long, chrom string, start_bp long, end_bp long")
    spark.createDataFrame([("1", 5, "A"), ("1", 500, "A")], "chrom string, pos long, ref string").write.parquet(f"{tmp_path}/v")
    met = events.variants_against(events.read_stream(spark, f"{tmp_path}/v", spark.read.parquet(f"{tmp_path}/v")), static)
    q = met.writeStream.format("memory").queryName("met").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("met").count() == 1
