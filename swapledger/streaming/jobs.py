"""Incremental jobs as Structured Streaming queries.

Each job reads a file stream with ``availableNow``, keeps its progress in a
checkpoint under the shared scratch folder, and writes parquet.  Batches are
idempotent: replaying one after a lost executor or driver gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.session import scratch_dir
from swapledger.sources.keyed import KeyedTable
from swapledger.streaming.stateful import numbered, row_store, whole_groups


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a parquet folder or single file.

    The path goes in as a pattern, since a plain path must be a folder here.
    """
    path = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(df: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Watermark on a column; parquet times without zone are cast first."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", purpose: str = "stream",
    checkpoint: str | None = None,
) -> None:
    """Drain what the stream has through ``foreachBatch``; a kept checkpoint continues later."""
    checkpoint = checkpoint or scratch_dir(stream.sparkSession, f"{purpose}-checkpoint")
    q = (
        stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def run_to_table(stream: DataFrame, path: str, purpose: str = "stream", checkpoint: str | None = None) -> None:
    """Drain the stream into a parquet folder (exactly-once file sink); a kept checkpoint continues later."""
    checkpoint = checkpoint or scratch_dir(stream.sparkSession, f"{purpose}-checkpoint")
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def ingest_once(stream: DataFrame, table: KeyedTable, order: Sequence[str], name: str, checkpoint: str | None = None) -> None:
    """Idempotent ingest: late repeats drop in state, older ones against the buckets they fall into.

    State expires with the watermark, and stored rows are neither read beyond the touched
    buckets' keys nor written again.
    """
    unique = stream.dropDuplicatesWithinWatermark(list(table.keys))
    run_batches(unique, lambda batch, n: table.insert(batch, order, name, n), purpose="ingest", checkpoint=checkpoint)


def number_across_batches(
    stream: DataFrame, key: str, order: Sequence[str], time: str, target: str, name: str = "leg_index",
    checkpoint: str | None = None, delay: str = "1 day", idle: str = "365 days",
) -> None:
    """Write the stream with a 0-based ordinal per key that continues from batch to batch.

    The counts so far are in the state store, one per key that is not idle; a batch reads and
    writes the counters of the bins that its keys fall into.
    """
    with row_store(stream.sparkSession):
        run_to_table(numbered(stream, key, order, time, name, delay, idle), target, "number", checkpoint)


def latest_per_key(stream: DataFrame, table: KeyedTable, order: Sequence[str], name: str, checkpoint: str | None = None) -> None:
    """Newest record of each key.

    No state is kept between batches: a batch is reduced to its newest rows and settled
    against the buckets they fall into.
    """
    run_batches(stream, lambda batch, n: table.upsert(batch, order, newest=True, source=name, number=n), purpose="latest", checkpoint=checkpoint)


def rebuild_touched(
    stream: DataFrame, key: str, ident: Sequence[str], time: str, build: Callable[[DataFrame], DataFrame], results: KeyedTable, name: str,
    delay: str = "40 days", idle: str = "60 days", checkpoint: str | None = None,
) -> None:
    """Keep a per-key result of an ordered log up to date, however late (within ``delay``) its rows arrive.

    The rows of each key are held in state; a batch gets the whole groups of the keys it
    touches from there, builds their results anew and replaces these in their buckets.  No
    other key is read, and nothing grows with the log but the state.
    """
    groups = whole_groups(stream, key, ident, time, delay, idle)

    def each(batch: DataFrame, batch_id: int) -> None:
        # Read more than once below: the stateful operator must not run twice.  A stream's own session
        # plans without AQE, so the rows are read in the table's.
        path = scratch_dir(results.spark, "touched")
        batch.write.parquet(path)
        results.replace_groups(build(results.spark.read.schema(batch.schema).parquet(path)), name, batch_id)

    with row_store(stream.sparkSession):
        run_batches(groups, each, mode="update", purpose="rebuild", checkpoint=checkpoint)


def sessions(stream: DataFrame, key: str, aggs: dict[str, Column], gap: str = "2 hours", column: str = "ts") -> DataFrame:
    """Per-key sessions of an ordered log; late rows inside the watermark still count."""
    return (
        stream.groupBy(key, F.session_window(column, gap).alias("w"))
        .agg(*[a.alias(n) for n, a in aggs.items()])
        .select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *aggs)
    )


def rollups(
    stream: DataFrame, keys: Sequence[str], aggs: dict[str, Column], width: str, slide: str | None = None, column: str = "ts"
) -> DataFrame:
    """Tumbling (or sliding) window roll-ups, emitted once the watermark closes a window."""
    window = F.window(column, width, slide) if slide else F.window(column, width)
    return (
        stream.groupBy(*keys, window.alias("w"))
        .agg(*[a.alias(n) for n, a in aggs.items()])
        .select(*keys, F.col("w.start").alias("started"), *aggs)
    )
