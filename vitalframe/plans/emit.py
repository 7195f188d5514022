"""Messages a response sends: commands, hazard warnings and one alert per session.

A message has a sender (the driver's vehicle), an id that depends on nothing but what it is about, the time it is sent
at and, for commands, a counter that runs through all sessions of its sender, so that a receiver can tell a replay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.functions.codec import (
    alert_bytes,
    alert_header_hex,
    command_bytes,
    pack_alerts,
    warning_bytes,
)
from vitalframe.operators.audit import number_senders
from vitalframe.sources.tables import cut_lineage

SESSION = ("driver_id", "session_id")
#: Messages of one sender and kind are numbered in this order.
SENDING_ORDER = ("event_time", "session_id", "seq")
MESSAGE = ("message_id", "sender", *SESSION, "seq", "kind", "event_time", "freshness_counter", "payload")
ID_GLUE = "|"


def alert_inputs(rows: DataFrame, etiology: str) -> DataFrame:
    """Alert fields of decided frames; the epoch is the frame's event time."""
    return rows.select(
        *SESSION,
        "seq",
        F.col(etiology).alias("etiology"),
        F.col("top_confidence").alias("confidence"),
        (F.col("persistence_seconds") * 1000).cast("int").alias("latency_ms"),
        F.unix_timestamp("event_time").alias("epoch_s"),
    )


def first_alerts(timeline: DataFrame, key: bytes, at: str = "trigger") -> DataFrame:
    """One alert per session: at its first trigger, or at its first emergency call.

    The first frame is found by an aggregate that keeps one row per session
    map-side, so only those rows meet.
    """
    if at not in ("trigger", "ecall"):
        raise ValueError("at must be 'trigger' or 'ecall'")
    flag, etiology = (
        ("mrm_trigger_flag", "active_class") if at == "trigger" else ("ecall_transmitted", "confirmed_etiology")
    )
    inputs = alert_inputs(timeline.filter(flag), etiology)
    fields = ["etiology", "confidence", "latency_ms", "epoch_s"]
    first = inputs.groupBy(*SESSION).agg(
        F.min(F.struct("seq", *fields)).alias("_f")
    )
    return pack_alerts(first.select(*SESSION, "_f.*"), key)


def message_id(kind: Column) -> Column:
    """Digest of sender, session, position and kind; the lengths of the names keep them apart."""
    names = [F.col(c) for c in SESSION]
    return F.md5(F.concat_ws(ID_GLUE, *[F.length(c) for c in names], *names, F.col("seq"), kind))


def due_messages(timeline: DataFrame) -> DataFrame:
    """All messages of a timeline before they are numbered and packed, narrow rows of what their payload is made from.

    A command for every frame with hazards on, a warning for every frame that broadcasts, and the alert once, at
    the standstill frame. The timeline is read once and nothing is shuffled; it may be a stream.
    """
    due = {"command": "hazard_flashers_active", "warning": "denm_broadcast_active", "alert": "standstill_frame"}
    kinds = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(kind)) for kind, flag in due.items()]))
    rows = timeline.filter(" or ".join(due.values())).select(
        F.col("driver_id").alias("sender"),
        *SESSION,
        "seq",
        "event_time",
        F.explode(kinds).alias("kind"),
        "longitudinal_accel_mss",
        "hazard_flashers_active",
        "speed_kmh",
        "lateral_pos_m",
        F.col("confirmed_etiology").alias("etiology"),
        F.col("top_confidence").alias("confidence"),
        (F.col("persistence_seconds") * 1000).cast("int").alias("latency_ms"),
    )
    return rows.withColumn("message_id", message_id(F.col("kind")))


def pack_messages(numbered: DataFrame, key: bytes) -> DataFrame:
    """Payloads of due messages whose ``freshness_counter`` is set; only commands keep it."""
    command = command_bytes(
        key, F.col("freshness_counter"), F.lit(C.COMMAND_STATE_CODE), F.col("longitudinal_accel_mss"), F.col("hazard_flashers_active")
    )
    warning = warning_bytes(
        F.col("speed_kmh"), F.col("lateral_pos_m"), C.STATION_ID, C.DENM_ACTION_ID, C.DENM_CAUSE, C.DENM_SUBCAUSE
    )
    header = alert_header_hex(F.col("etiology"), F.col("confidence"), F.col("latency_ms"), F.unix_timestamp("event_time"))
    payload = (
        F.when(F.col("kind") == "command", command)
        .when(F.col("kind") == "warning", warning)
        .otherwise(alert_bytes(key, header))
    )
    counter = F.when(F.col("kind") == "command", F.col("freshness_counter"))
    return numbered.withColumn("payload", payload).withColumn("freshness_counter", counter).select(*MESSAGE)


def emit_messages(timeline: DataFrame, key: bytes, bucket: Column | None = None) -> DataFrame:
    """All messages of a timeline: id, sender, session, position, kind, sending time, counter and payload.

    The counter of a command is its place among all commands of its sender, over all sessions, in sending
    order. ``bucket`` grows with the sending time and cuts senders with very many messages (by default, the minute).
    The due messages are written once, so that counting hot senders does not compute the timeline again.
    """
    due = cut_lineage(due_messages(timeline))
    if bucket is None:
        bucket = F.unix_seconds(F.date_trunc("minute", F.col("event_time")))
    return pack_messages(number_senders(due, bucket, SENDING_ORDER, keys=("sender", "kind")), key)


def as_bus(messages: DataFrame) -> DataFrame:
    """The commands as a receiver's bus log."""
    return messages.filter("kind = 'command'").select(
        "message_id",
        "sender",
        F.col("event_time").alias("rx_time"),
        F.lit(C.COMMAND_ARB_ID).alias("arb_id"),
        F.octet_length("payload").alias("dlc"),
        "payload",
        "freshness_counter",
        "session_id",
        "seq",
    )
