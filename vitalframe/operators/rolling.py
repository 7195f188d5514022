"""Rolling frame features: postural index and pulse statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.config import SessionLayout
from vitalframe.functions.numeric import clamp
from vitalframe.operators.indexing import session_window


def usable_pulse():
    """The reading above 10 bpm, else the neutral 74 (for statistics only)."""
    return F.when(F.col("rppg_hr_bpm") > C.HR_VALID_MIN_BPM, F.col("rppg_hr_bpm")).otherwise(
        F.lit(C.NEUTRAL_HR_BPM)
    )


def rolling_features(
    frames: DataFrame,
    layout: SessionLayout,
    fsr_rows: int = C.FSR_ROWS,
    hr_rows: int = C.HR_ROWS,
) -> DataFrame:
    """Add psi and the pulse minimum, maximum and mean of the last ``hr_rows`` frames.

    Expects chunked frames, see ``chunk_frames``.  Windows that start before the
    first frame of the session are short.  Pulse readings of at most 10 bpm count
    as the neutral 74 in the statistics only.
    """
    if not layout.single_chunk and max(fsr_rows, hr_rows) > layout.halo_rows:
        raise ValueError("row frames must not be longer than layout.halo_rows")
    ordered = session_window(layout)
    pressure = ordered.rowsBetween(-(fsr_rows - 1), 0)
    pulse = ordered.rowsBetween(-(hr_rows - 1), 0)
    return (
        frames.withColumn("_hr", usable_pulse())
        .withColumns(
            {
                "psi": clamp(1.0 - F.avg("fsr_pressure").over(pressure), 0.0, 1.0),
                "hr_min_10s": F.min("_hr").over(pulse),
                "hr_max_10s": F.max("_hr").over(pulse),
                "hr_mean_10s": F.avg("_hr").over(pulse),
            }
        )
        .drop("_hr")
    )


def tonic_prefilter():
    """Saturated back pressure with clenched grip and closing eyes (one frame)."""
    return (
        (F.col("fsr_pressure") >= C.TONIC_FSR_MIN)
        & (F.col("wheel_grip") == "CLENCHED")
        & (F.col("ear") <= C.TONIC_EAR_MAX)
    )


def coma_scale():
    """Coma-scale proxy, first match wins."""
    return (
        F.when((F.col("psi") > 0.70) & (F.col("ear") < 0.15), F.lit(4))
        .when((F.col("ser_2_6hz") > 0.60) | F.col("tonic_detected"), F.lit(7))
        .when(F.col("ear") < 0.18, F.lit(12))
        .otherwise(F.lit(15))
    )


def clinical_flags(features: DataFrame) -> DataFrame:
    """Add the tonic prefilter and the coma-scale proxy."""
    return features.withColumn("tonic_detected", tonic_prefilter()).withColumn(
        "estimated_gcs", coma_scale()
    )
