"""Every engine query with SQL gives DuckDB's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from helixmill.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        frame[c] = frame[c].map(lambda v: "null" if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, float) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, oracle, name):
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), oracle.execute(ORACLE_SQL[name]).df()
    pd.testing.assert_frame_equal(plain(ours), plain(theirs))
