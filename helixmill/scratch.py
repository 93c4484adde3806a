"""Tables and text files written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables are broadcast up to this many rows.
BROADCAST_ROWS = 100_000


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, in local mode only (tests), below a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_helixmill_engine_scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark._helixmill_engine_scratch = tempfile.mkdtemp(prefix="helixmill-engine-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/helixmill-engine/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows as a Parquet table, read back."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def few(rows: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, stored, counted and marked for broadcast if they are no more than `most`."""
    from pyspark.sql.functions import broadcast

    table = stored(rows, name)
    return broadcast(table) if table.count() <= most else table
