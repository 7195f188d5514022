"""Plausibility interlocks and the persistence timer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.config import SessionLayout
from vitalframe.operators.indexing import session_window


def spoofed() -> Column:
    """A dead pulse on camera while the driver grips and steers."""
    return (
        (F.col("rppg_hr_bpm") < C.SPOOF_HR_MAX_BPM)
        & (F.col("wheel_grip") == "ACTIVE")
        & (F.col("steering_torque_nm") > C.SPOOF_MIN_TORQUE_NM)
    )


def involuntary_torque() -> Column:
    """Steering torque that must not count as a driver override."""
    return (F.col("steering_torque_nm") > C.OVERRIDE_TORQUE_NM) & (
        (F.col("ser_2_6hz") >= C.SUPPRESS_SER_MIN) | (F.col("wheel_grip") == "CLENCHED")
    )


def interlocks(classified: DataFrame) -> DataFrame:
    """Add the spoof and override flags, the candidate class and the counting flag."""
    return (
        classified.withColumn("laser_spoofing_detected", spoofed())
        .withColumns(
            {
                "override_suppressed": ~F.col("laser_spoofing_detected") & involuntary_torque(),
                "candidate_class": F.when(F.col("laser_spoofing_detected"), "Normal").otherwise(
                    F.col("predicted_class")
                ),
            }
        )
        .withColumn(
            "_counts",
            (F.col("top_confidence") >= C.CONFIDENCE_GATE) & (F.col("candidate_class") != "Normal"),
        )
    )


def persistence(decided: DataFrame, layout: SessionLayout) -> DataFrame:
    """Length of the current run of confident frames of one class, capped at 20.

    A run ends when a frame does not count or its class changes.  The cap is the
    verification length, so looking back 20 rows is exact however long the run.
    """
    ordered = session_window(layout)
    before = F.lag(F.struct("_counts", "candidate_class")).over(ordered)
    recent = ordered.rowsBetween(-(C.VERIFY_FRAMES - 1), 0)
    here = F.col(layout.order)
    continues = (
        F.col("_counts")
        & F.coalesce(F.col("_prev._counts"), F.lit(False))
        & (F.col("_prev.candidate_class") == F.col("candidate_class"))
    )
    run = (
        F.when(~F.col("_counts"), F.lit(0))
        .when(F.col("_break").isNull(), F.lit(C.VERIFY_FRAMES))
        .otherwise(here - F.col("_break") + 1)
        .cast("int")
    )
    timed = (
        decided.withColumn("_prev", before)
        .withColumn("_start", F.when(~F.coalesce(continues, F.lit(False)), here))
        .withColumn("_break", F.max("_start").over(recent))
        .withColumn("persist_frames", run)
    )
    return verified(timed).drop("_prev", "_start", "_break", "_counts")


def verified(timed: DataFrame) -> DataFrame:
    """Add persistence time, trigger and active class from ``persist_frames``."""
    return (
        timed.withColumns(
            {
                "persistence_seconds": F.col("persist_frames") / F.lit(C.FUSION_RATE_HZ),
                "mrm_trigger_flag": F.col("persist_frames") >= C.VERIFY_FRAMES,
            }
        )
        .withColumn(
            "active_class",
            F.when(F.col("mrm_trigger_flag"), F.col("candidate_class")).otherwise("Normal"),
        )
    )


def security_events(decisions: DataFrame) -> DataFrame:
    """One log line per intercepted spoof."""
    return decisions.filter("laser_spoofing_detected").withColumn(
        "message",
        F.format_string(C.SECURITY_LINE, F.col("t"), F.col("steering_torque_nm")),
    )
