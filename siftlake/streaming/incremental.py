"""Structured Streaming: incremental ingest into the history store, line parsers, windows over events."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftlake.operators.events import event_log
from siftlake.operators.history import HistoryStore
from siftlake.sources.dumps import parse_lines


def stream_lines(spark: SparkSession, path: str, fmt: str, files_per_trigger: int = 100) -> DataFrame:
    """J-01: a stream of ``path, cells, error`` from a folder of CSV, TSV or JSON-lines files."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return parse_lines(lines.withColumn("path", F.col("_metadata.file_path")), fmt)


def ingest_batch(store: HistoryStore, dataset: str) -> Callable[[DataFrame, int], None]:
    """J-02: a ``foreachBatch`` function: events against the history of all other batches, then their insert.

    A batch is a version of the store, named by the data set and its number: when Spark repeats one after a failure, its
    rows of the first try are no history, and are replaced.
    """

    def run(rows: DataFrame, batch: int) -> None:
        version = f"{quote(dataset, safe='')}-{batch}"
        store.insert_events(event_log(rows, store.known(version)), dataset, version)

    return run


def ingest_stream(rows: DataFrame, store: HistoryStore, dataset: str, checkpoint: str) -> StreamingQuery:
    """Run an available-now ingest of ``rows`` (``file_seq, file_id, row_idx, cells, header``)."""
    writer = rows.writeStream.foreachBatch(ingest_batch(store, dataset)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """J-07: counts and sums by event type in fixed windows; on streams late rows are dropped after ``late``."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy(F.window("ts", width, step)).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("window.start").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user that end after ``gap`` without an event."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen_stream(occurrences: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """First occurrences within a bounded time, as streaming state of keys only."""
    return occurrences.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
