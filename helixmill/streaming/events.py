"""Streams. The engine's batch semantics carry over: seeds come from ids, so neither partitioning nor batch borders change results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def epochs(rows: DataFrame, count: int, seed: str, ident: str) -> DataFrame:
    """Each row once an epoch, with an order of its own per epoch: columns epoch, priority."""
    many = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return many.withColumn("priority", F.sha2(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col(ident).cast("string")), 256))


def after_cursor(rows: DataFrame, epoch: int, priority: str) -> DataFrame:
    """What is left behind a cursor (resume)."""
    return rows.where((F.col("epoch") > epoch) | ((F.col("epoch") == epoch) & (F.col("priority") > priority)))


def not_done(rows: DataFrame, done: DataFrame, ident: str) -> DataFrame:
    """Rows whose id has no result yet (resumable append)."""
    return rows.join(done.select(ident).distinct(), ident, "left_anti")


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """A Parquet folder as a stream of like's schema."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    """Count and sum of value per event-time window and event_type; rows later than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def append_batches(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs the stream over what there is now, in append mode, to Parquet below path, a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so each row is there once, whatever was written before; a query started again with the same checkpoint goes on where the last one stopped. Aggregates need a watermark:
    a window is written once, when the watermark has passed its end, and its state is dropped then."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def variants_against(stream: DataFrame, windows: DataFrame) -> DataFrame:
    """Streamed variants joined with a static table of windows."""
    from helixmill.operators.intervals import variants_in_windows

    return variants_in_windows(windows, stream)
