"""Registered queries: features, classification, verification, response."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.catalog.common import (
    SESSION,
    decisions,
    decisions_sql,
    features_sql,
    frames,
    num,
    responses,
    round_sql,
    rounded,
    timeline_sql,
)
from vitalframe.config import TRIAL_LAYOUT, SessionLayout
from vitalframe.functions import numeric
from vitalframe.operators.classify import parameter_table, table_classifier, table_log_likelihoods, weight_table
from vitalframe.operators.intervals import active_intervals, thin_irregular, thin_regular
from vitalframe.operators.watchdog import security_events
from vitalframe.plans import detect as detect_plan
from vitalframe.sources.testviews import frames_sql, table

KEY = [*SESSION, "seq"]


def first_trigger(spark, sf):
    """First verified trigger of every trial."""
    rows = decisions(spark, sf).filter("mrm_trigger_flag")
    return (
        rows.groupBy(*SESSION, "scenario")
        .agg(F.min("seq").alias("first_seq"), F.min_by("active_class", "seq").alias("active_class"))
        .withColumn("latency_s", F.round(F.col("first_seq") / 10.0 - C.EVENT_ONSET_S, 3))
    )


FIRST_TRIGGER = f"""WITH {decisions_sql()}
SELECT driver_id, session_id, scenario, min(seq) AS first_seq, arg_min(active_class, seq) AS active_class,
  round(min(seq) / 10.0::DOUBLE - 4.0::DOUBLE, 3) AS latency_s
FROM dec WHERE mrm_trigger_flag GROUP BY driver_id, session_id, scenario"""

FEATURE_NUMBERS = ["ear", "pitch_deg", "rppg_hr_bpm", "ser_2_6hz", "psi", "hr_min_10s", "hr_max_10s", "hr_mean_10s"]
FEATURE_OTHERS = ["t", "wheel_grip", "steering_torque_nm", "optical_snr_db", "face_detected", "imu_heartbeat_ok", "tonic_detected", "estimated_gcs"]


def frame_features(spark, sf):
    out = detect_plan.features(frames(spark, sf), TRIAL_LAYOUT)
    return rounded(out.select(*KEY, *FEATURE_OTHERS, *FEATURE_NUMBERS), FEATURE_NUMBERS)


FRAME_FEATURES = f"""WITH {features_sql()}
SELECT driver_id, session_id, seq, {', '.join(FEATURE_OTHERS)}, {round_sql(FEATURE_NUMBERS)} FROM feat"""

POSTERIORS = ["p_normal", "p_syncope", "p_seizure", "top_confidence", "shannon_entropy"]


def class_posteriors(spark, sf):
    out = decisions(spark, sf).select(*KEY, "predicted_class", "is_confident", *POSTERIORS)
    return rounded(out, POSTERIORS)


CLASS_POSTERIORS = f"""WITH {decisions_sql()}
SELECT driver_id, session_id, seq, predicted_class, is_confident, {round_sql(POSTERIORS)} FROM dec"""

DECISION = [
    "operational_mode",
    "degraded_1",
    "degraded_2",
    "active_class",
    "mrm_trigger_flag",
    "laser_spoofing_detected",
    "override_suppressed",
    "persistence_seconds",
    "candidate_class",
]


def frame_decisions(spark, sf):
    return decisions(spark, sf).select(*KEY, *DECISION)


FRAME_DECISIONS = f"""WITH {decisions_sql()} SELECT driver_id, session_id, seq, {', '.join(DECISION)} FROM dec"""


def table_decisions(spark, sf):
    """The same decisions with class parameters, grip probabilities and priors looked up in tables."""
    classify = table_classifier(parameter_table(spark), weight_table(spark))
    return detect_plan.detect(frames(spark, sf), TRIAL_LAYOUT, classify).select(*KEY, *DECISION)


def class_parameter_join(spark, sf):
    feats = detect_plan.features(frames(spark, sf), TRIAL_LAYOUT)
    out = table_log_likelihoods(feats, parameter_table(spark)).select(*KEY, "class", "log_likelihood")
    return rounded(out, ["log_likelihood"])


def _parameter_sql() -> str:
    parts = []
    for cls in C.CLASSES:
        terms = " + ".join(
            f"(-ln({num(std)} * sqrt(2 * pi())) - power(({f} - {num(mean)}) / {num(std)}, 2) / 2)"
            for f, (mean, std) in C.GAUSSIAN[cls].items()
        )
        parts.append(f"SELECT driver_id, session_id, seq, '{cls}' AS class, round({terms}, 6) AS log_likelihood FROM feat")
    return f"WITH {features_sql()} " + " UNION ALL ".join(parts)


RESPONSE_NUMBERS = ["speed_kmh", "speed_ms", "longitudinal_accel_mss", "longitudinal_dist_m", "lateral_pos_m"]
RESPONSE_OTHERS = [
    "phase_step",
    "phase_timer_s",
    "mrm_state",
    "hazard_flashers_active",
    "doors_unlocked",
    "epb_clamped",
    "acoustic_chime_active",
    "haptic_pulse_active",
    "denm_broadcast_active",
    "ecall_transmitted",
    "confirmed_etiology",
]


def response_timeline(spark, sf):
    out = responses(spark, sf).select(*KEY, *RESPONSE_OTHERS, *RESPONSE_NUMBERS)
    return rounded(out, RESPONSE_NUMBERS)


RESPONSE_TIMELINE = f"""WITH {timeline_sql()}
SELECT driver_id, session_id, seq, {', '.join(RESPONSE_OTHERS)}, {round_sql(RESPONSE_NUMBERS)} FROM timeline"""


def active_spans(spark, sf):
    rows = responses(spark, sf).withColumn("responding", F.col("mrm_state") != C.PHASES[0])
    return active_intervals(rows, TRIAL_LAYOUT, "responding")


ACTIVE_SPANS = f"""WITH {timeline_sql()},
flag AS (SELECT driver_id, session_id, seq, t, mrm_state <> 'NORMAL' AS resp,
           max(t) OVER (PARTITION BY driver_id, session_id) AS last_t FROM timeline),
isl AS (SELECT *, seq - row_number() OVER (PARTITION BY driver_id, session_id, resp ORDER BY seq) AS g FROM flag)
SELECT driver_id, session_id, min(t) AS start_t, least((max(seq) + 1) / 10.0::DOUBLE, any_value(last_t)) AS end_t
FROM isl WHERE resp GROUP BY driver_id, session_id, g"""


def status_frames(spark, sf):
    return thin_regular(frames(spark, sf), TRIAL_LAYOUT).select(*KEY, "t", "mode")


STATUS_FRAMES = f"""WITH {frames_sql()}
SELECT driver_id, session_id, seq, t, mode FROM frames_v WHERE seq > 0 AND seq % 5 = 0"""


UNEVEN_SECONDS = 21600


def uneven_status(spark, sf):
    """Events of a user at least six hours after the last one shown; their times are uneven."""
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t")
    )
    kept = thin_irregular(rows, SessionLayout(("user_id",), "event_id"), period=UNEVEN_SECONDS)
    return kept.select("user_id", "event_id", "event_type")


UNEVEN_STATUS = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us FROM events),
one AS (SELECT user_id, us, min(event_id) AS event_id FROM e GROUP BY ALL),
kept AS (
  SELECT user_id, min(us) AS us FROM one WHERE us >= {UNEVEN_SECONDS * 1000000} GROUP BY user_id
  UNION ALL
  SELECT k.user_id, min(o.us) AS us FROM kept k JOIN one o ON o.user_id = k.user_id AND o.us >= k.us + {UNEVEN_SECONDS * 1000000} GROUP BY k.user_id)
SELECT e.user_id, e.event_id, e.event_type FROM kept JOIN one USING (user_id, us) JOIN e ON e.user_id = one.user_id AND e.event_id = one.event_id"""


def security_log(spark, sf):
    return security_events(decisions(spark, sf)).select(*KEY, "t", "steering_torque_nm", "message")


SECURITY_LOG = f"""WITH {decisions_sql()}
SELECT driver_id, session_id, seq, t, steering_torque_nm,
  format('{C.SECURITY_LINE.replace("%.2f", "{:.2f}")}', t, steering_torque_nm) AS message
FROM dec WHERE laser_spoofing_detected"""

SERIES_NUMBERS = [
    "ear",
    "pitch_deg",
    "rppg_hr_bpm",
    "ser_2_6hz",
    "psi",
    "p_normal",
    "p_syncope",
    "p_seizure",
    "top_confidence",
    "shannon_entropy",
    "persistence_seconds",
    "speed_kmh",
    "longitudinal_accel_mss",
    "lateral_pos_m",
]


def telemetry_series(spark, sf):
    out = responses(spark, sf).select(
        *KEY,
        "scenario",
        "t",
        "operational_mode",
        (F.col("mrm_state") != C.PHASES[0]).alias("mrm_active"),
        "laser_spoofing_detected",
        *SERIES_NUMBERS,
    )
    return rounded(out, SERIES_NUMBERS)


TELEMETRY_SERIES = f"""WITH {timeline_sql()}
SELECT driver_id, session_id, seq, scenario, t, operational_mode, mrm_state <> 'NORMAL' AS mrm_active,
  laser_spoofing_detected, {round_sql(SERIES_NUMBERS)} FROM timeline"""


def post_onset_frames(spark, sf):
    return frames(spark, sf).filter(F.col("t") >= C.EVENT_ONSET_S).groupBy("scenario", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ear"), 6).alias("mean_ear")
    )


POST_ONSET = f"""WITH {frames_sql()} SELECT scenario, mode, count(*) AS n, round(avg(ear), 6) AS mean_ear
FROM frames_v WHERE t >= 4 GROUP BY ALL"""


def clamped_frames(spark, sf):
    shifted = frames(spark, sf).withColumns(
        {
            "ear": F.col("ear") * 2 - 0.2,
            "fsr_pressure": F.col("fsr_pressure") * 2 - 0.7,
            "rppg_hr_bpm": F.col("rppg_hr_bpm") - 40,
        }
    )
    cols = ["ear", "fsr_pressure", "rppg_hr_bpm"]
    return rounded(shifted.withColumns(numeric.physical_clamps()).select(*KEY, *cols), cols)


CLAMPED = f"""WITH {frames_sql()} SELECT driver_id, session_id, seq,
  round(greatest(0.0::DOUBLE, least(0.45::DOUBLE, ear * 2 - 0.2::DOUBLE)), 6) AS ear,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, fsr_pressure * 2 - 0.7::DOUBLE)), 6) AS fsr_pressure,
  round(greatest(0.0::DOUBLE, rppg_hr_bpm - 40), 6) AS rppg_hr_bpm FROM frames_v"""


def actuator_commands(spark, sf):
    rows = responses(spark, sf).select(*KEY, "longitudinal_accel_mss", "hazard_flashers_active", "epb_clamped")
    return (
        rows.withColumn("brake", numeric.brake_command(F.col("longitudinal_accel_mss")))
        .withColumn("throttle", numeric.throttle_command(F.col("brake")))
        .withColumnsRenamed({"hazard_flashers_active": "hazard_lights", "epb_clamped": "hand_brake"})
    )


ACTUATORS = f"""WITH {timeline_sql()},
b AS (SELECT *, CASE WHEN longitudinal_accel_mss < 0 THEN least(1.0::DOUBLE, abs(longitudinal_accel_mss) / 4.0::DOUBLE)
        ELSE 0.0::DOUBLE END AS brake FROM timeline)
SELECT driver_id, session_id, seq, longitudinal_accel_mss, hazard_flashers_active AS hazard_lights,
  epb_clamped AS hand_brake, brake, CASE WHEN brake > 0.1::DOUBLE THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END AS throttle FROM b"""

QUERIES = {
    "first_trigger": (first_trigger, FIRST_TRIGGER),
    "frame_features": (frame_features, FRAME_FEATURES),
    "class_posteriors": (class_posteriors, CLASS_POSTERIORS),
    "class_parameter_join": (class_parameter_join, _parameter_sql()),
    "frame_decisions": (frame_decisions, FRAME_DECISIONS),
    "table_decisions": (table_decisions, FRAME_DECISIONS),
    "response_timeline": (response_timeline, RESPONSE_TIMELINE),
    "active_spans": (active_spans, ACTIVE_SPANS),
    "status_frames": (status_frames, STATUS_FRAMES),
    "uneven_status": (uneven_status, UNEVEN_STATUS),
    "security_log": (security_log, SECURITY_LOG),
    "telemetry_series": (telemetry_series, TELEMETRY_SERIES),
    "post_onset_frames": (post_onset_frames, POST_ONSET),
    "clamped_frames": (clamped_frames, CLAMPED),
    "actuator_commands": (actuator_commands, ACTUATORS),
}
