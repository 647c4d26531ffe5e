"""A folder kept in step with the catalog by a stream of micro-batches.

A file stream sees new files only, so each batch compares the whole listing with
the catalog; the stream says when to look.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.operators.changes import apply_to_catalog, change_log, diff


def sync(files: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalog after the changes, and the log of them."""
    return apply_to_catalog(catalog, files), change_log(diff(files, catalog))


def watch(spark: SparkSession, listing: Callable[[], DataFrame], read: Callable[[], Any], write: Callable[[Any, DataFrame, int], None], checkpoint: str, seconds: int = 60, once: bool = False, apply: Callable[[DataFrame, Any], tuple[Any, DataFrame]] = sync) -> StreamingQuery:
    """Every `seconds` (or once) takes a listing, reads the state and hands write the new state, the log and the batch number.

    The state is the catalog, which sync brings up to date, or what another apply
    takes: with operators.ingest.ingest, documents, chunks and vectors.

    write must be atomic and may see a batch again after a failure; the batch number
    tells it so.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load() if once else spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def step(_: DataFrame, batch: int) -> None:
        write(*apply(listing(), read()), batch)

    writer = ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def changes_in_windows(changes: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts of a change feed by window and kind; works on a stream (late rows wait for the watermark) as on a table."""
    # watermarks want timestamps with a zone
    rows = changes.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if changes.isStreaming else changes
    counted = rows.groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")
