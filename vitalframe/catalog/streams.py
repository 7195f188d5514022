"""Registered queries: the stateful streams, checked against the batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe.catalog import detection, messages
from vitalframe.catalog.common import rounded
from vitalframe.plans.emit import due_messages
from vitalframe.sources import testviews as V
from vitalframe.streaming.run import Replay, drain
from vitalframe.streaming.senders import stream_audit, stream_commands
from vitalframe.streaming.session import stream_respond
from vitalframe.streaming.sinks import numbered_messages


def _span(rows, time):
    """Seconds between the first and the last row: how far out of order stored files can be."""
    first, last = rows.select(F.unix_micros(F.min(F.col(time).cast("timestamp"))), F.unix_micros(F.max(F.col(time).cast("timestamp")))).first()
    return ((last or 0) - (first or 0)) // 1_000_000 + 1


def _waiting(spark, sf):
    """Delay and bucket of a replay that must not depend on how the rows lie in the files."""
    seconds = _span(V.table(spark, sf, "events"), "ts")
    return {"delay": f"{seconds} seconds", "bucket_seconds": max(1.0, seconds / 8)}


def _responses(spark, sf):
    delay = _waiting(spark, sf)["delay"]
    return lambda events: stream_respond(V.frames_of(events), delay)


def stream_decisions(spark, sf):
    respond = _responses(spark, sf)
    return drain(V.event_stream(spark, sf), "ts", lambda e: respond(e).select(*detection.KEY, *detection.DECISION))


def stream_timeline(spark, sf):
    columns = [*detection.KEY, *detection.RESPONSE_OTHERS, *detection.RESPONSE_NUMBERS]
    respond = _responses(spark, sf)
    return rounded(drain(V.event_stream(spark, sf), "ts", lambda e: respond(e).select(*columns)), detection.RESPONSE_NUMBERS)


def stream_messages(spark, sf):
    """Frames to due messages, these to numbered and packed ones: two streams with a table between."""
    respond = _responses(spark, sf)
    due = Replay(V.event_stream(spark, sf), "ts", lambda e: due_messages(respond(e)))
    rows = due.run()
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", V.FILES_A_BATCH)
    waiting = _waiting(spark, sf)
    packed = drain(source.parquet(f"{due.folder}/rows"), "event_time", lambda m: numbered_messages(m, messages.KEY, **waiting))
    return messages.shown(packed)


def stream_row_counts(spark, sf):
    """Frames in and out of a stream in which every ninth event comes twice; all the repeats are dropped."""
    twice = F.explode(F.array_repeat(F.lit(1), F.when(F.col("event_id") % 9 == 4, 2).otherwise(1)))
    respond = _responses(spark, sf)
    replay = Replay(V.event_stream(spark, sf).withColumn("_", twice).drop("_"), "ts", respond)
    rows = replay.run()
    seen = spark.createDataFrame([(replay.counts["frames_in"], replay.counts["frames_out"])], "frames_in long, frames_out long")
    rows = rows.agg(F.count(F.lit(1)).alias("rows_out"))
    return seen.crossJoin(rows).withColumn("late_frames", F.col("frames_in") - F.col("frames_out"))  # one row each


ROW_COUNTS = """SELECT n + twice AS frames_in, n AS frames_out, n AS rows_out, twice AS late_frames
FROM (SELECT count(*) AS n, count(*) FILTER (event_id % 9 = 4) AS twice FROM events)"""


def _arrivals(rows):
    return rows.withColumn("rx_time", F.col("rx_time").cast("timestamp"))


def stream_bus_audit(spark, sf):
    waiting = _waiting(spark, sf)

    def build(events):
        rows = stream_audit(_arrivals(V.bus_of(events, messages.KEY)), messages.KEY, tie="event_id", **waiting)
        return rows.select("event_id", "sender", "freshness_counter", "accepted", "reject_reason")

    return drain(V.event_stream(spark, sf), "ts", build)


def stream_command_frames(spark, sf):
    waiting = _waiting(spark, sf)
    packed = drain(
        V.event_stream(spark, sf),
        "ts",
        lambda e: stream_commands(_arrivals(messages.command_rows(e)), messages.KEY, tie="event_id", **waiting),
    )
    return packed.withColumn("payload", F.hex("payload")).select(
        "event_id", "sender", "freshness_counter", "arb_id", "dlc", "payload", "mac_signature_hex"
    )


QUERIES = {
    "stream_decisions": (stream_decisions, detection.FRAME_DECISIONS),
    "stream_timeline": (stream_timeline, detection.RESPONSE_TIMELINE),
    "stream_messages": (stream_messages, messages.EMITTED),
    "stream_row_counts": (stream_row_counts, ROW_COUNTS),
    "stream_bus_audit": (stream_bus_audit, messages.BUS_AUDIT),
    "stream_command_frames": (stream_command_frames, messages.COMMAND_FRAMES),
}
