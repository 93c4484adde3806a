"""Digests of rowsets, the stored interval index and its verification, and streams that stop and go on, against plain Python."""

import collections
import datetime
import hashlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from helixmill.operators import interval_index, rowsets
from helixmill.streaming import events


def tree_by_hand(texts, fan):
    level = [len(t.encode()).to_bytes(8, "big") + t.encode() for t in texts]
    while True:
        level = [hashlib.sha256(b"".join(level[i : i + fan])).digest() for i in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0].hex()


@pytest.mark.parametrize("fan", [2, 5, 1024])
def test_rowset_digests(spark, fan):
    r = random.Random(1)
    groups = {"a": [f"é{r.random()}" for _ in range(137)], "b": ["x"], "c": ["", "", "y"], None: [str(i) for i in range(25)]}
    rows = [(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, i int, t string").repartition(5)
    got = {x.g: (x.n, x.digest) for x in rowsets.rowset_digest(frame, ["g"], ["i"], F.col("t"), fan=fan).collect()}
    assert got == {g: (len(ts), tree_by_hand(ts, fan)) for g, ts in groups.items()}
    assert rowsets.rowset_digest(frame.where("false"), ["g"], ["i"], F.col("t")).count() == 0
    assert rowsets.rowset_digest(frame.where("g = 'a'"), [], ["i"], F.col("t"), fan=fan).first().digest == got["a"][1]


@pytest.fixture(scope="module")
def members(spark):
    r = random.Random(4)
    rows = [(f"k{i}", r.choice(["1", "2"]), s, s + r.choice([1, 1, 5, 300])) for i, s in enumerate(r.choices(range(5000), k=400))]
    frame = spark.createDataFrame(rows, "name string, chrom string, start_bp long, end_bp long").repartition(3)
    return rows, frame, interval_index.build(frame, width=64, buckets=4)


@pytest.mark.parametrize("partitions", ["2", "4", "200"])
def test_lookups_leave_the_store_where_it_is(spark, members, partitions):
    rows, _, index = members
    r = random.Random(5)
    asked = [(q, r.choice(["1", "2", "3"]), s, s + r.choice([1, 64, 700])) for q, s in enumerate(r.choices(range(5200), k=60))]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        met = interval_index.overlapping(index, spark.createDataFrame(asked, "q_id int, q_chrom string, q_start long, q_end long"))
        plan = met._jdf.queryExecution().sparkPlan().toString(), met._jdf.queryExecution().executedPlan().toString()
        assert plan[1].count("Exchange") == 1 and "SortMergeJoin" in plan[1]
        got = collections.Counter((x.q_id, x.name) for x in met.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == collections.Counter((q, n) for q, c, a, b in asked for n, d, s, e in rows if c == d and a < e and s < b)


def test_verification_finds_what_is_wrong(spark, members):
    rows, frame, index = members
    failures = lambda i, f, **rules: {x.check: x.failures for x in interval_index.verify(i, f, ["name"], rules).collect()}
    good = failures(index, frame, sized=F.col("end_bp") > F.col("start_bp"))
    assert good == dict.fromkeys(["order", "bins", "missing", "extra", "repeated", "sized"], 0)
    other = frame.where("name <> 'k1'").unionByName(spark.createDataFrame([("new", "1", 5, 6), ("new2", "1", 5, 6)], frame.schema))
    assert failures(index, other, short=F.col("end_bp") - F.col("start_bp") < 300) == {"order": 0, "bins": 0, "missing": 2, "extra": 1, "repeated": 0, "short": sum(e - s == 300 for _, _, s, e in rows)}
    # files that another hand wrote: a row twice, one lost from one of its bins, and no order
    stored = spark.read.parquet(index.path)
    some = stored.where("not (name = 'k7' and not first)").unionByName(stored.where("name = 'k3'")).orderBy(F.desc("start_bp")).coalesce(1)
    path = index.path + "-broken"
    some.write.parquet(path)
    bad = failures(index._replace(path=path), frame)
    assert bad["order"] > 0 and bad["repeated"] == 1 and bad["extra"] == 1 and bad["bins"] == int(rows[7][3] - rows[7][2] > 1 and rows[7][2] // 64 != (rows[7][3] - 1) // 64)


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    """Closed windows are written once, whatever is run again; state of closed windows is dropped; rows behind the watermark don't count."""
    at = datetime.datetime(2024, 1, 1)
    schema = "ts timestamp, event_type string, value double"

    def put(number, minutes):
        spark.createDataFrame([(at + datetime.timedelta(minutes=m), "x", 1.0) for m in minutes], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")

    def run():
        stream = events.read_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema))
        query = events.append_batches(events.windowed_counts(stream, "10 minutes", "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
        query.awaitTermination(120)
        return query

    counts = lambda: sorted((x.start.hour * 60 + x.start.minute, x.n) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    put(0, [0, 3, 11])
    put(1, [12, 40])
    run()
    assert counts() == [(0, 2), (10, 2)]
    put(2, [1, 41, 59, 90])  # minute 1 is behind the watermark
    last = run().lastProgress["stateOperators"][0]
    assert counts() == [(0, 2), (10, 2), (40, 2), (50, 1)] and last["numRowsTotal"] == 1
    # the last batches' commits are lost, as when the driver stops before it writes them: they run again and overwrite their own rows
    commits = sorted((int(f.name) for f in (tmp_path / "state/commits").iterdir() if f.name.isdigit()))
    for number in commits[-1:]:
        (tmp_path / f"state/commits/{number}").unlink()
        shutil.rmtree(tmp_path / f"state/commits/.{number}.crc", ignore_errors=True)
        (tmp_path / f"state/commits/.{number}.crc").unlink(missing_ok=True)
    put(3, [200])
    run()
    assert counts() == [(0, 2), (10, 2), (40, 2), (50, 1), (90, 1)]
