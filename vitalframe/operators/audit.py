"""Integrity and replay audit of a bus log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.functions.codec import COMMAND_BYTES, command_tag_hex
from vitalframe.operators.indexing import HOT_ROWS, dense_index, running_max_before


def frame_checks(bus: DataFrame, key: bytes) -> DataFrame:
    """Add one flag per check of a command frame, the replay check left out."""
    body = F.substring(F.col("payload"), 1, 5)
    tag = F.hex(F.substring(F.col("payload"), 6, 3))
    first = F.hex(F.substring(F.col("payload"), 1, 1))
    low = F.lpad(F.hex(F.col("freshness_counter").bitwiseAND(F.lit(255))), 2, "0")
    return bus.withColumns(
        {
            "id_ok": F.col("arb_id") == C.COMMAND_ARB_ID,
            "length_ok": (F.octet_length("payload") == COMMAND_BYTES) & (F.col("dlc") == COMMAND_BYTES),
            "tag_ok": tag == command_tag_hex(key, body),
            "counter_ok": first == low,
        }
    )


def audit(
    bus: DataFrame,
    key: bytes,
    bucket: Column,
    keys: Sequence[str] = ("sender",),
    order: Sequence[str] = ("rx_time", "freshness_counter"),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Accept a frame iff every check holds and its counter exceeds all accepted ones.

    A valid but replayed frame never raises the largest counter, so the accepted
    maximum equals the running maximum over valid frames.  ``bucket`` grows with
    ``order`` and splits senders with more than ``hot_rows`` frames.
    """
    checked = frame_checks(bus, key).withColumn(
        "_valid", F.col("id_ok") & F.col("length_ok") & F.col("tag_ok") & F.col("counter_ok")
    )
    seen = running_max_before(
        checked,
        keys,
        order,
        bucket,
        F.when(F.col("_valid"), F.col("freshness_counter")),
        "_seen",
        hot_rows,
    )
    fresh = F.col("freshness_counter") > F.coalesce(F.col("_seen"), F.lit(0))
    reason = (
        F.when(~F.col("id_ok"), "wrong_id")
        .when(~F.col("length_ok"), "wrong_length")
        .when(~fresh, "replayed")
        .when(~F.col("tag_ok"), "bad_tag")
        .when(~F.col("counter_ok"), "counter_mismatch")
    )
    return (
        seen.withColumn("accepted", F.col("_valid") & fresh)
        .withColumn("reject_reason", reason)
        .drop("_valid", "_seen")
    )


def number_senders(
    messages: DataFrame,
    bucket: Column,
    order: Sequence[str],
    keys: Sequence[str] = ("sender",),
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Sender counters: 1001, 1002, ... in sending order per sender."""
    return dense_index(
        messages, keys, order, bucket, "freshness_counter", C.COUNTER_START + 1, hot_rows=hot_rows
    )
