"""Streaming, re-aimed from the one-at-a-time scoring
of the reference to Structured Streaming.

S01: arriving rows are cleaned and scored with transformers fitted on batch
data (stateless: the fitted plans are plain expressions), appended to a
Parquet sink. S02: running prediction summary per model in event-time
tumbling windows with a watermark (built-in windowed aggregation, append
mode, so finished windows are written once and state is dropped).

Sinks and checkpoints live under the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import checkpoint_dir


def _paths(spark: SparkSession, name: str) -> tuple[str, str]:
    root = f"{checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    return f"{root}/sink", f"{root}/checkpoint"


def run_to_sink(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over everything available (availableNow) into a
    Parquet sink; return the sink as a batch frame."""
    sink, ckpt = _paths(spark, name)
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(sink)


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None,
                glob: str | None = None) -> DataFrame:
    """Parquet file stream over a folder (``glob`` picks files inside it)."""
    r = spark.readStream.format("parquet").schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


# S01 -----------------------------------------------------------------------
def score_stream(spark: SparkSession, path: str, schema, prepare: Callable[[DataFrame], DataFrame],
                 scorers, name: str = "scores", glob: str | None = None) -> DataFrame:
    """Stream rows through ``prepare`` (fitted transforms) and every scorer."""
    cur = prepare(read_stream(spark, path, schema, glob=glob))
    for s in scorers:
        cur = s.predict(cur, f"pred_{s.name}")
    return run_to_sink(cur, spark, name)


# S02 -----------------------------------------------------------------------
def windowed_summary(stream: DataFrame, ts: str, model: str, value: str, window: str = "1 hour",
                     watermark: str = "10 minutes") -> DataFrame:
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (stream.withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), F.col(model).alias("model"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"),
                 F.max(value).alias("max"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "model", "n",
                    "mean", "min", "max"))


def with_open_windows(finished: DataFrame, rows: DataFrame, ts: str, model: str, value: str, window: str = "1 hour") -> DataFrame:
    """The finished windows of a stream's sink and, from the stored rows, those that the
    watermark hasn't closed yet: only rows after the last finished window are read."""
    last = finished.agg(F.max("window_end")).first()[0]
    tail = rows if last is None else rows.where(F.col(ts) >= F.lit(last))
    return finished.unionByName(windowed_summary(tail, ts, model, value, window))
