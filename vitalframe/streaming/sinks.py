"""Stream sinks that can be replayed after a failure."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe.operators.watchdog import security_events
from vitalframe.plans.emit import SENDING_ORDER, due_messages, pack_messages
from vitalframe.streaming.senders import stream_numbers


def batch_writer(path: str, partition: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: a batch overwrites its own directory, so writing it
    twice leaves one copy."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("overwrite")
        if partition:
            writer = writer.partitionBy(partition)
        writer.parquet(f"{path}/batch={batch_id:012d}")

    return write


def merge_writer(path: str, key: str, time: str, writer: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that adds the rows whose ``key`` the table at ``path`` does not hold yet.

    Rows of one key must have one ``time``: only the days a batch touches are read. ``writer`` names the stream (its checkpoint); a
    batch of a writer replaces what it wrote before a failure, and a stream that is begun anew from its source,
    under another checkpoint, adds nothing twice. Two writers must not run at the same moment.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = f"{writer}-{batch_id:012d}"
        fresh = batch.dropDuplicates([key]).withColumn("day", F.to_date(time)).withColumn("part", F.lit(own))
        files = spark._jvm.org.apache.hadoop.fs.Path(path)
        if files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
            held = spark.read.schema(fresh.schema).parquet(path).filter(F.col("part") != own)
            days = [r.day for r in fresh.select("day").distinct().collect()]  # the days of one micro-batch
            fresh = fresh.join(held.filter(F.col("day").isin(days)).select(key), key, "left_anti")
        # only the partitions of this batch are replaced
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "day").parquet(path)

    return write


def start_writer(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Write a stream to ``path``, one directory per batch."""
    return (
        stream.writeStream.foreachBatch(batch_writer(path))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_merge(stream: DataFrame, path: str, checkpoint: str, key: str = "message_id", time: str = "event_time", **trigger):
    """Merge a stream into the table at ``path`` by ``key``."""
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return (
        stream.writeStream.foreachBatch(merge_writer(path, key, time, writer))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_messages(timeline: DataFrame, path: str, checkpoint: str, **trigger):
    """Merge the due messages of a responded stream into a table, from which ``numbered_messages`` streams.

    Numbers wait for a sender's earlier messages, responses for lost frames: two watermarks, so two queries with a table between.
    """
    return start_merge(due_messages(timeline), path, checkpoint, **trigger)


def numbered_messages(due: DataFrame, key: bytes, delay: str = "10 seconds", bucket_seconds: float = 1.0) -> DataFrame:
    """Numbered and packed messages of a stream of due messages."""
    numbered = stream_numbers(due, ("sender", "kind"), "event_time", SENDING_ORDER[1:], delay, bucket_seconds)
    return pack_messages(numbered, key)


def start_security_log(timeline: DataFrame, path: str, checkpoint: str, **trigger):
    """Append intercepted spoofs of a responded stream."""
    lines = security_events(timeline).select("driver_id", "session_id", "seq", "message")
    return start_writer(lines, path, checkpoint, **trigger)
