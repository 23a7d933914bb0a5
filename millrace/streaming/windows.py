"""The time-window strategy as a stream: every new file is taken up once, then the query stops.

An extension: batches of an append-only folder go through a query and into the
snapshot store, exactly once each, with Structured Streaming's checkpoint in
place of a stored watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.materialize import merged
from millrace.sources.store import MAIN, Store


def take_up(spark: SparkSession, store: Store, folder: str, schema: StructType, table: str, checkpoint: str, query: Callable[[DataFrame], DataFrame] = lambda df: df, keys: tuple[str, ...] = (), branch: str = MAIN) -> int:
    """Appends (or, with ``keys``, merges) what is new in a folder of parquet files; returns the number of batches.

    Each batch is one commit that notes its number, so that a batch replayed
    after a failure isn't taken twice.
    """
    done = [0]

    def sink(batch: DataFrame, number: int) -> None:
        note = f"stream {checkpoint} {number}"
        if any(store.commit(c).note == note for c in store.ancestors(store.head(branch).id)):
            return
        rows = query(batch)
        old = store.version(table, branch)
        if old is None:
            version = store.write(table, rows)
        elif keys:
            version = store.write(table, merged(store.read(old), rows, keys))
        else:
            version = store.appended(table, old, rows)
        store.record(branch, {table: version}, note)
        done[0] += 1

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return done[0]


def windowed_counts(events: DataFrame, time: str, every: str, keys: tuple[str, ...] = (), slide: str | None = None, late: str = "0 seconds", value: Column | None = None) -> DataFrame:
    """Counts and sums per tumbling or sliding window; works on streams (with a watermark) and on tables."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(F.col(time), every, slide) if slide else F.window(F.col(time), every)
    measures = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value is not None else [])
    return source.groupBy(window.alias("w"), *keys).agg(*measures).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *(["total"] if value is not None else []))
