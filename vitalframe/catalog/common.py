"""Shared inputs of the registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.config import TRIAL_LAYOUT
from vitalframe.plans.detect import detect
from vitalframe.plans.respond import respond
from vitalframe.sources.testviews import frames_sql, frames_view, table

SESSION = ("driver_id", "session_id")


def num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames_view(spark, sf)


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    return detect(frames_view(spark, sf), TRIAL_LAYOUT)


def responses(spark: SparkSession, sf: str) -> DataFrame:
    return respond(frames_view(spark, sf), TRIAL_LAYOUT)


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    """Round doubles so that engines with another summation order agree."""
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def round_sql(columns: list[str], places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


W = "PARTITION BY driver_id, session_id ORDER BY seq"


def features_sql(source: str | None = None) -> str:
    """CTEs frames_v and feat; ``source`` may define another ``frames_v``."""
    return f"""{source or frames_sql()},
rolled AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - avg(fsr_pressure) OVER
      ({W} ROWS BETWEEN {C.FSR_ROWS - 1} PRECEDING AND CURRENT ROW))) AS psi,
    min(hr_s) OVER w100 AS hr_min_10s, max(hr_s) OVER w100 AS hr_max_10s, avg(hr_s) OVER w100 AS hr_mean_10s
  FROM (SELECT *, CASE WHEN rppg_hr_bpm > 10 THEN rppg_hr_bpm ELSE 74.0::DOUBLE END AS hr_s FROM frames_v)
  WINDOW w100 AS ({W} ROWS BETWEEN {C.HR_ROWS - 1} PRECEDING AND CURRENT ROW)),
feat AS (
  SELECT *, CASE WHEN psi > 0.7::DOUBLE AND ear < 0.15::DOUBLE THEN 4
      WHEN ser_2_6hz > 0.6::DOUBLE OR tonic_detected THEN 7
      WHEN ear < 0.18::DOUBLE THEN 12 ELSE 15 END AS estimated_gcs
  FROM (SELECT *, fsr_pressure >= {num(C.TONIC_FSR_MIN)} AND wheel_grip = 'CLENCHED'
        AND ear <= {num(C.TONIC_EAR_MAX)} AS tonic_detected FROM rolled))"""


def _score_sql(cls: str) -> str:
    def density(f):
        mean, std = C.GAUSSIAN[cls][f]
        return (
            f"(-0.5::DOUBLE * ln(2 * pi() * {num(std * std)}) - "
            f"({f} - {num(mean)}) * ({f} - {num(mean)}) / {num(2 * std * std)})"
        )

    grip = " ".join(f"WHEN '{g}' THEN ln({num(p)})" for g, p in C.GRIP[cls].items())
    return (
        f"CASE WHEN vis THEN {density('ear')} + {density('pitch_deg')} + {density('rppg_hr_bpm')} ELSE 0 END"
        f" + CASE WHEN NOT degraded_2 THEN {density('ser_2_6hz')} ELSE 0 END + {density('psi')}"
        f" + CASE wheel_grip {grip} ELSE ln({num(C.GRIP_UNKNOWN)}) END"
        f" + CASE WHEN tonic_detected THEN ln({num(C.PRIOR_TONIC[cls])}) ELSE ln({num(C.PRIOR[cls])}) END"
    )


def decisions_sql(source: str | None = None) -> str:
    """CTEs up to dec; runs are found as islands over the whole session."""
    lls = ", ".join(f"{_score_sql(c)} AS ll_{c.lower()}" for c in C.CLASSES)
    ps = ", ".join(f"exp(ll_{c.lower()} - lse) AS p_{c.lower()}" for c in C.CLASSES)
    bits = " + ".join(f"p_{c.lower()} * log2(p_{c.lower()} + 1e-12)" for c in C.CLASSES)
    return f"""{features_sql(source)},
modes AS (
  SELECT *, CASE WHEN degraded_2 THEN '{C.MODE_DEGRADED_2}' WHEN degraded_1 THEN '{C.MODE_DEGRADED_1}'
            ELSE '{C.MODE_NOMINAL}' END AS operational_mode,
         NOT degraded_1 AND face_detected AND optical_snr_db > {num(C.MIN_OPTICAL_SNR_DB)} AS vis
  FROM (SELECT *, optical_snr_db < {num(C.MIN_OPTICAL_SNR_DB)} OR NOT face_detected AS degraded_1,
               NOT imu_heartbeat_ok AS degraded_2 FROM feat)),
lls AS (SELECT *, {lls} FROM modes),
lse AS (SELECT *, m + ln(exp(ll_normal - m) + exp(ll_syncope - m) + exp(ll_seizure - m)) AS lse
        FROM (SELECT *, greatest(ll_normal, ll_syncope, ll_seizure) AS m FROM lls)),
post AS (SELECT *, {ps} FROM lse),
cls AS (
  SELECT *, greatest(p_normal, p_syncope, p_seizure) AS top_confidence,
    CASE WHEN p_normal >= p_syncope AND p_normal >= p_seizure THEN 'Normal'
         WHEN p_syncope >= p_seizure THEN 'Syncope' ELSE 'Seizure' END AS predicted_class,
    greatest(0.0::DOUBLE, -({bits})) AS shannon_entropy FROM post),
spoof AS (
  SELECT *, rppg_hr_bpm < 1 AND wheel_grip = 'ACTIVE' AND steering_torque_nm > 1 AS laser_spoofing_detected,
    top_confidence >= {num(C.CONFIDENCE_GATE)} AS is_confident FROM cls),
cand AS (
  SELECT *, CASE WHEN laser_spoofing_detected THEN 'Normal' ELSE predicted_class END AS candidate_class,
    NOT laser_spoofing_detected AND steering_torque_nm > 4
      AND (ser_2_6hz >= {num(C.SUPPRESS_SER_MIN)} OR wheel_grip = 'CLENCHED') AS override_suppressed
  FROM spoof),
cnt AS (SELECT *, is_confident AND candidate_class <> 'Normal' AS counts FROM cand),
starts AS (
  SELECT *, CASE WHEN counts AND lag(counts) OVER w AND lag(candidate_class) OVER w = candidate_class
            THEN 0 ELSE 1 END AS brk FROM cnt WINDOW w AS ({W})),
islands AS (SELECT *, sum(brk) OVER ({W} ROWS UNBOUNDED PRECEDING) AS island FROM starts),
dec AS (
  SELECT *, persist_frames / 10.0::DOUBLE AS persistence_seconds, persist_frames >= 20 AS mrm_trigger_flag,
    CASE WHEN persist_frames >= 20 THEN candidate_class ELSE 'Normal' END AS active_class
  FROM (SELECT *, CASE WHEN counts THEN least(20, row_number() OVER
          (PARTITION BY driver_id, session_id, island ORDER BY seq)) ELSE 0 END AS persist_frames FROM islands))"""


def timeline_sql() -> str:
    """CTEs up to tl; pre-alerts are segments between overrides over the whole session."""
    from vitalframe.operators.timeline import brake_profile

    prof = brake_profile()
    last = len(prof["speed_ms"]) - 1
    stop = C.BRAKE_STEP + last
    v0, v, n = "100.0::DOUBLE / 3.6::DOUBLE", num(-C.BRAKE_ACCEL_MSS * 0.1), f"least(greatest(step - 101, 0), {last})"
    # travel while braking is an arithmetic series until the last moving step
    moving = f"least({n}, 86)"
    travel = f"0.1::DOUBLE * ({moving} * ({v0}) - {v} * {moving} * ({moving} + 1) / 2.0::DOUBLE)"
    phase = (
        f"CASE WHEN step = 0 THEN '{C.PHASES[0]}' WHEN step < 30 THEN '{C.PHASES[1]}' "
        f"WHEN step < 101 THEN '{C.PHASES[2]}' WHEN step < {stop} THEN '{C.PHASES[3]}' ELSE '{C.PHASES[4]}' END"
    )
    return f"""{decisions_sql()},
ovr AS (SELECT *, (steering_torque_nm > 4 AND NOT override_suppressed) OR brake_pedal_pressed AS ovr FROM dec),
seg AS (SELECT *, sum(CASE WHEN ovr THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS seg FROM ovr),
ent AS (
  SELECT *, CASE WHEN NOT ovr THEN min(CASE WHEN mrm_trigger_flag AND NOT ovr THEN seq END) OVER
      (PARTITION BY driver_id, session_id, seg ORDER BY seq ROWS UNBOUNDED PRECEDING) END AS e FROM seg),
com AS (
  SELECT *, min(CASE WHEN seq - e = 29 THEN e END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS c FROM ent),
act AS (SELECT *, coalesce(c, e) AS a FROM com),
eti AS (
  SELECT x.*, coalesce(x.seq - x.a + 1, 0) AS step, coalesce(y.active_class, 'None') AS confirmed_etiology
  FROM act x LEFT JOIN (SELECT driver_id AS d, session_id AS s, seq AS q, active_class FROM dec) y
    ON x.driver_id = y.d AND x.session_id = y.s AND x.a = y.q),
tl AS (
  SELECT *, step AS phase_step, step / 10.0::DOUBLE AS phase_timer_s, {phase} AS mrm_state,
    CASE WHEN step >= {stop - 1} THEN 0.0::DOUBLE ELSE {v0} - {v} * {n} END AS speed_ms,
    CASE WHEN step > 101 AND step < {stop} THEN {num(C.BRAKE_ACCEL_MSS)} ELSE 0.0::DOUBLE END AS longitudinal_accel_mss,
    CASE WHEN step > 101 THEN a + 101 ELSE seq + 1 END * ({v0}) * 0.1::DOUBLE + {travel} AS longitudinal_dist_m,
    CASE WHEN step <= 101 THEN 0.0::DOUBLE ELSE {num(C.SHOULDER_OFFSET_M)} *
      (0.5::DOUBLE - 0.5::DOUBLE * cos(pi() * least((step - 100) / 80.0::DOUBLE, 1.0::DOUBLE))) END AS lateral_pos_m,
    step > 30 AS hazard_flashers_active, step >= {stop} AS doors_unlocked, step >= {stop} AS epb_clamped,
    step BETWEEN 1 AND 30 AS acoustic_chime_active, step BETWEEN 1 AND 30 AS haptic_pulse_active,
    step >= 101 AS denm_broadcast_active, step >= {stop} AS ecall_transmitted, step = {stop} AS standstill_frame
  FROM eti),
timeline AS (SELECT *, speed_ms * 3.6::DOUBLE AS speed_kmh FROM tl)"""


def trials_sql() -> str:
    """CTEs up to trials."""
    return f"""{timeline_sql()},
preds AS (
  SELECT driver_id, session_id, active_class, count(*) AS n, min(seq) AS seen FROM timeline
  WHERE t >= 4 GROUP BY ALL),
modal AS (
  SELECT driver_id, session_id, active_class AS predicted_class FROM preds
  QUALIFY row_number() OVER (PARTITION BY driver_id, session_id ORDER BY n DESC, seen) = 1),
sums AS (
  SELECT driver_id, session_id, any_value(scenario) AS scenario, any_value(seed) AS seed,
    any_value(expected_class) AS expected_class, min(CASE WHEN mrm_trigger_flag THEN t END) AS first_t,
    count(*) AS frames, arg_max(mrm_state, seq) AS last_state, arg_max(lateral_pos_m, seq) AS last_lat
  FROM timeline GROUP BY driver_id, session_id),
trials AS (
  SELECT s.driver_id, s.session_id, scenario, seed, expected_class,
    coalesce(predicted_class, 'Normal') AS predicted_class, first_t IS NOT NULL AS mrm_triggered,
    round(first_t - 4.0::DOUBLE, 3) AS detection_latency_s, frames,
    scenario NOT IN ('CARDIAC_SYNCOPE', 'EPILEPTIC_SEIZURE') AS safe_no_mrm_expected,
    scenario NOT IN ('CARDIAC_SYNCOPE', 'EPILEPTIC_SEIZURE') AND first_t IS NULL AS safe_no_mrm_observed,
    last_state = 'PHASE_4_STANDSTILL' AS standstill_reached, round(last_lat, 3) AS final_lateral_position_m,
    CASE WHEN first_t IS NULL THEN 0 ELSE 76 END AS mec_length_bytes,
    first_t IS NOT NULL AS prototype_can_verification
  FROM sums s LEFT JOIN modal m ON s.driver_id = m.driver_id AND s.session_id = m.session_id)"""

