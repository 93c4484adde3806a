"""Inputs that the test tables lack: texts without letters, groups of more rows than a tree of two full levels holds, rows by the thousand."""

import functools
import hashlib
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_oracle import DATA, TABLES, plain

from helixmill.operators import ranking, rowsets, sampling
from helixmill.plans import composites, files
from helixmill.queries import ORACLE_SQL, QUERIES
from helixmill.sources import shards, text


def test_edits_of_sequences_without_letters(spark, tmp_path):
    texts = ["", None, "12 34", "A", "ab cd ef gh", "ab cd ef gh ij kl mn op qr"]
    frame = spark.createDataFrame([(i, t, "src1") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    oracle = duckdb.connect()
    oracle.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {(x.id, x.edited) for x in QUERIES["G2_many_edits"](spark, str(tmp_path)).collect()}
    assert got == set(oracle.execute(ORACLE_SQL["G2_many_edits"]).fetchall())


def two_levels(texts, fan):
    leaves = [b"".join(len(t.encode()).to_bytes(8, "big") + t.encode() for t in texts[i : i + fan]) for i in range(0, len(texts), fan)]
    digests = [hashlib.sha256(x) for x in leaves]
    return digests[0].hexdigest() if len(digests) == 1 else hashlib.sha256(b"".join(x.digest() for x in digests)).hexdigest()


def test_rowset_trees_of_two_levels(spark):
    """Groups of more than fan * fan rows, of one leaf and of as many as a level holds."""
    groups = {"a": [f"é{i}" for i in range(137)], "b": ["x"], "c": ["", "", "y"], None: [str(i) for i in range(9)]}
    frame = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "g string, i int, t string").repartition(5)
    got = {x.g: (x.n, x.digest) for x in rowsets.rowset_digest(frame, ["g"], ["i"], F.col("t"), fan=3, levels=2).collect()}
    assert got == {g: (len(ts), two_levels(ts, 3)) for g, ts in groups.items()}


def same_in_small_chunks(spark, monkeypatch, name):
    """The query against its SQL, both with chunks of 4 rows, so that groups hold far more than 4 * 4."""
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    monkeypatch.setattr(composites, "rowset_digest", functools.partial(rowsets.rowset_digest, fan=4))
    oracle = duckdb.connect()
    for t in TABLES:
        oracle.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert ORACLE_SQL[name].count("// 1024") == 1
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), oracle.execute(ORACLE_SQL[name].replace("// 1024", "// 4")).df()
    assert theirs.n.max() > 64
    pd.testing.assert_frame_equal(plain(ours), plain(theirs))


def test_member_rows_beyond_two_full_levels(spark, monkeypatch):
    same_in_small_chunks(spark, monkeypatch, "H4_rowset_digest")


def test_snapshot_keys_beyond_two_full_levels(spark, monkeypatch):
    same_in_small_chunks(spark, monkeypatch, "C15_snapshot")


SCORE = "chrom string, pos long, ref string, alt string, sigma_raw double, sigma_calibrated double, bucket_id string"
RECEIPT = "chrom string, pos long, ref string, alt string, model_id string, input_commitment string, output_commitment string"


def test_scores_meet_their_receipts(spark, tmp_path):
    """A score without a receipt, one whose receipt names another outcome, one with two receipts, and nulls."""
    rows = [("1", p, "A", "C", p / 3, p / 7 if p % 4 else None, "b" if p % 3 else None) for p in range(12)]
    shards.write_scores(spark.createDataFrame(rows, SCORE).repartition(3), "m", str(tmp_path), compression="gzip")
    assert all(f.name.endswith(".json.gz") for name in ("scores", "receipts") for f in (tmp_path / name).glob("part-*"))
    again, receipts = text.read_jsonl(spark, f"{tmp_path}/scores", SCORE), text.read_jsonl(spark, f"{tmp_path}/receipts", RECEIPT)
    assert {tuple(x) for x in shards.receipted(again, receipts).collect()} == set(rows)
    forged = receipts.where("pos <> 3").withColumn("output_commitment", F.when(F.col("pos") == 5, F.lit("sha256:0")).otherwise(F.col("output_commitment")))
    found = shards.receipted(again, forged.unionByName(receipts.where("pos = 8"))).collect()
    assert sorted(x.pos for x in found) == [p for p in range(12) if p not in (3, 5)]


def test_score_sinks_are_small(spark, tmp_path, monkeypatch):
    """Bytes of both sinks for each score: 348 as plain text."""
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    monkeypatch.setattr(files, "folder", lambda _, name: f"{tmp_path}/{name}")
    n = QUERIES["S20_score_sinks"](spark, str(DATA)).count()
    assert n > 1000 and sum(f.stat().st_size for f in (tmp_path / "scores").rglob("part-*")) < 150 * n


def test_few_of_a_group_are_chosen_without_storing_rows(spark, monkeypatch):
    """Only more than a window keeps before its shuffle are ranked by stored rows; both choose the same."""
    frame = spark.createDataFrame([(i, "gh"[i % 2] if i % 50 else None) for i in range(400)], "id long, g string").repartition(5)
    few = {x.id for x in sampling.first_k_per(frame, ["g"], "id", 5, "7").collect()}
    monkeypatch.setattr(sampling, "FEW", 4)
    assert few == {x.id for x in sampling.first_k_per(frame, ["g"], "id", 5, "7").collect()} and len(few) == 15
    monkeypatch.undo()

    def refused(*_):
        raise AssertionError("rows are stored")

    monkeypatch.setattr(ranking, "stored", refused)
    plan = sampling.first_k_per(frame, ["g"], "id", 5, "7")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    if Path(DATA).exists():
        assert QUERIES["C5_split_evidence"](spark, str(DATA)).count() == 3
