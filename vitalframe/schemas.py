"""Table schemas of the inputs."""

from __future__ import annotations

from pyspark.sql import types as T

AXES = T.ArrayType(
    T.StructType([T.StructField(a, T.DoubleType()) for a in ("x", "y", "z")])
)

FRAMES = T.StructType(
    [
        T.StructField("driver_id", T.StringType(), False),
        T.StructField("session_id", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("mode", T.StringType()),
        T.StructField("ear", T.DoubleType()),
        T.StructField("pitch_deg", T.DoubleType()),
        T.StructField("optical_snr_db", T.DoubleType()),
        T.StructField("face_detected", T.BooleanType()),
        T.StructField("rppg_hr_bpm", T.DoubleType()),
        T.StructField("imu_accel_window", AXES),
        T.StructField("imu_gyro_window", AXES),
        T.StructField("imu_heartbeat_ok", T.BooleanType()),
        T.StructField("fsr_pressure", T.DoubleType()),
        T.StructField("wheel_grip", T.StringType()),
        T.StructField("steering_torque_nm", T.DoubleType()),
        T.StructField("brake_pedal_pressed", T.BooleanType()),
    ]
)

HR_SAMPLES = T.StructType(
    [
        T.StructField("session_id", T.StringType(), False),
        T.StructField("idx", T.LongType(), False),
        T.StructField("hr", T.DoubleType()),
    ]
)

ECG_SAMPLES = T.StructType(
    [
        T.StructField("record", T.StringType(), False),
        T.StructField("idx", T.LongType(), False),
        T.StructField("lead1", T.DoubleType()),
        T.StructField("lead2", T.DoubleType()),
        T.StructField("fs", T.DoubleType()),
    ]
)

BEAT_ANNOTATIONS = T.StructType(
    [
        T.StructField("record", T.StringType(), False),
        T.StructField("sample", T.LongType(), False),
        T.StructField("symbol", T.StringType()),
    ]
)

BUS_LOG = T.StructType(
    [
        T.StructField("sender", T.StringType(), False),
        T.StructField("rx_time", T.TimestampType()),
        T.StructField("arb_id", T.IntegerType()),
        T.StructField("dlc", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("freshness_counter", T.LongType()),
    ]
)

TRIALS = T.StructType(
    [
        T.StructField("scenario", T.StringType()),
        T.StructField("seed", T.LongType()),
        T.StructField("expected_class", T.StringType()),
        T.StructField("predicted_class", T.StringType()),
        T.StructField("mrm_triggered", T.BooleanType()),
        T.StructField("detection_latency_s", T.DoubleType()),
        T.StructField("safe_no_mrm_expected", T.BooleanType()),
        T.StructField("safe_no_mrm_observed", T.BooleanType()),
        T.StructField("standstill_reached", T.BooleanType()),
        T.StructField("final_lateral_position_m", T.DoubleType()),
        T.StructField("mec_length_bytes", T.IntegerType()),
        T.StructField("prototype_can_verification", T.BooleanType()),
    ]
)

SIGNAL = T.StructType(
    [
        T.StructField("values", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("sample_rate_hz", T.DoubleType()),
        T.StructField("units", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("channels", T.ArrayType(T.StringType())),
        T.StructField("source_path", T.StringType()),
    ]
)
SIGNAL_STATUS = ("measured", "derived", "missing", "imputed", "not_applicable")
