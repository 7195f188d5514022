"""Registered queries: pulse recordings and their replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.catalog.common import decisions_sql, rounded, round_sql
from vitalframe.functions.numeric import finite_or_null
from vitalframe.operators import evaluate as E
from vitalframe.operators import windows as W
from vitalframe.plans import replay_hr as R
from vitalframe.sources import heart_rate as H
from vitalframe.sources import testviews as V


def _text_cells(spark, sf):
    """Pulse cells as text, some empty, some not numbers."""
    e = F.col("event_id")
    cell = (
        F.when(e % 17 == 0, "nan")
        .when(e % 19 == 0, "--")
        .when(e % 23 == 0, " inf")
        .when(e % 29 == 0, "")
        .otherwise(F.concat(F.lit(" "), F.col("hr").cast("string"), F.lit(" ")))
    )
    return V.pulse_view(spark, sf).withColumn("cell", cell)


_CELL_OK = "event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0"


def pulse_parsing(spark, sf):
    return _text_cells(spark, sf).select("event_id", F.round(finite_or_null(F.col("cell")), 6).alias("hr"))


PARSING = f"""WITH {V.PULSE_SQL} SELECT event_id, CASE WHEN {_CELL_OK} THEN round(hr, 6) END AS hr FROM pulse"""


def _rows(spark, sf):
    """Sessions of users; every third has no pulse column and takes samples by position, where there are any."""
    cells = _text_cells(spark, sf)
    rows = cells.select(
        F.col("session_id").cast("string").alias("session_id"),
        "idx",
        F.when(F.col("event_id") % 31 != 0, F.col("idx") / 10.0 + 100.0).alias("t"),
        finite_or_null(F.col("cell")).alias("hr"),
        (F.col("session_id") % 3 != 0).alias("has_hr"),
    )
    samples = cells.filter("session_id % 5 <> 0").select(
        F.col("session_id").cast("string").alias("session_id"), "idx", (F.col("hr") - 10.0).alias("hr")
    )
    return H.fill_missing_hr(rows, samples)


ROWS_SQL = f"""{V.PULSE_SQL},
prow AS (SELECT CAST(session_id AS VARCHAR) AS session_id, idx,
    CASE WHEN event_id % 31 <> 0 THEN idx / 10.0::DOUBLE + 100.0::DOUBLE ELSE idx / 10.0::DOUBLE END AS t,
    CASE WHEN session_id % 3 <> 0 THEN CASE WHEN {_CELL_OK} THEN hr END
         WHEN session_id % 5 <> 0 THEN hr - 10.0::DOUBLE END AS raw FROM pulse),
pf AS (SELECT *, greatest(0.0::DOUBLE, coalesce(raw, 74.0::DOUBLE)) AS hr,
    CASE WHEN raw IS NULL THEN 'imputed' ELSE 'measured' END AS hr_status FROM prow)"""


def pulse_frames(spark, sf):
    out = H.hr_frames(_rows(spark, sf)).select("session_id", "seq", "t", "rppg_hr_bpm", "hr_status")
    return rounded(out, ["t", "rppg_hr_bpm"])


PULSE_FRAMES = f"""WITH {ROWS_SQL} SELECT session_id, idx AS seq, round(t, 6) AS t, round(hr, 6) AS rppg_hr_bpm,
  hr_status FROM pf"""


def missing_channels(spark, sf):
    """How many channels each replayed frame marks as missing."""
    out = H.hr_frames(_rows(spark, sf))
    return out.select(F.size("channel_status").alias("n_missing"), "wheel_grip", "ear", "fsr_pressure").groupBy(
        "n_missing", "wheel_grip", "ear", "fsr_pressure"
    ).agg(F.count(F.lit(1)).alias("n"))


MISSING = f"""SELECT {len(H.NEUTRAL_FRAME)} AS n_missing, 'ACTIVE' AS wheel_grip, 0.3::DOUBLE AS ear,
  0.85::DOUBLE AS fsr_pressure, count(*) AS n FROM events"""

HR_FRAMES_SQL = f"""{ROWS_SQL},
frames_v AS (SELECT session_id AS driver_id, session_id, idx AS seq, t, hr AS rppg_hr_bpm, 0.3::DOUBLE AS ear,
  0.0::DOUBLE AS pitch_deg, 0.0::DOUBLE AS optical_snr_db, true AS face_detected, false AS imu_heartbeat_ok,
  0.85::DOUBLE AS fsr_pressure, 'ACTIVE' AS wheel_grip, 0.0::DOUBLE AS steering_torque_nm,
  0.0::DOUBLE AS ser_2_6hz FROM pf)"""


def replay_decisions(spark, sf):
    return R.replay(_rows(spark, sf))


def replay_modes(spark, sf):
    return replay_decisions(spark, sf).groupBy("operational_mode", "active_class", "candidate_class").agg(
        F.count(F.lit(1)).alias("n")
    )


REPLAY_MODES = f"""WITH {decisions_sql(HR_FRAMES_SQL)} SELECT operational_mode, active_class, candidate_class,
  count(*) AS n FROM dec GROUP BY ALL"""


def replay_summary(spark, sf):
    return R.replay_summary(H.hr_frames(_rows(spark, sf)))


REPLAY_SUMMARY = f"""WITH {ROWS_SQL} SELECT count(*) AS frames_replayed, round(avg(hr), 3) AS mean_heart_rate_bpm,
  round(min(hr), 3) AS min_heart_rate_bpm, round(max(hr), 3) AS max_heart_rate_bpm FROM pf"""


def replay_first_rows(spark, sf):
    return R.sample_rows(replay_decisions(spark, sf))


FIRST_ROWS = f"""WITH {decisions_sql(HR_FRAMES_SQL)} SELECT session_id, t AS timestamp_s, rppg_hr_bpm AS heart_rate_bpm,
  operational_mode, active_class AS degraded_prediction, imu_heartbeat_ok AS imu_available
FROM dec ORDER BY session_id, seq LIMIT 5"""


def replay_order(spark, sf):
    return H.replay_order(H.hr_frames(_rows(spark, sf))).select("session_id", "seq", F.round("t", 6).alias("t"))


REPLAY_ORDER = f"WITH {ROWS_SQL} SELECT session_id, idx AS seq, round(t, 6) AS t FROM pf ORDER BY session_id, idx"

TRAJECTORY = ["hr_mean", "hr_std", "hr_rmssd", "hr_slope", "hr_min", "hr_max"]


def spanning_trajectories(spark, sf):
    """100-sample windows over all sessions laid end to end."""
    out = R.trajectories(H.hr_frames(_rows(spark, sf)), span_sessions=True)
    return rounded(out.select("win", "hr_state", *TRAJECTORY), TRAJECTORY)


SPANNING = f"""WITH {ROWS_SQL},
g AS (SELECT hr, row_number() OVER (ORDER BY session_id, idx) - 1 AS i FROM pf),
d AS (SELECT i, hr, hr - lag(hr) OVER (ORDER BY i) AS d FROM g),
w AS (SELECT *, i // 20 - k AS win FROM d, range(0, 5) r(k) WHERE i // 20 - k >= 0),
tr AS (SELECT win, avg(hr) AS hr_mean, stddev_pop(hr) AS hr_std,
    sqrt(avg(CASE WHEN i > win * 20 THEN d * d END)) AS hr_rmssd,
    (arg_max(hr, i) - arg_min(hr, i)) / 100.0::DOUBLE AS hr_slope, min(hr) AS hr_min, max(hr) AS hr_max
  FROM w GROUP BY win HAVING count(*) = 100)
SELECT win, CASE WHEN hr_std > 15 THEN 3 WHEN hr_mean < 55 THEN 1 WHEN hr_mean > 105 THEN 2 ELSE 0 END AS hr_state,
  {round_sql(TRAJECTORY)} FROM tr"""

QUERIES = {
    "pulse_parsing": (pulse_parsing, PARSING),
    "pulse_frames": (pulse_frames, PULSE_FRAMES),
    "missing_channels": (missing_channels, MISSING),
    "replay_modes": (replay_modes, REPLAY_MODES),
    "replay_summary": (replay_summary, REPLAY_SUMMARY),
    "replay_first_rows": (replay_first_rows, FIRST_ROWS),
    "replay_order": (replay_order, REPLAY_ORDER),
    "spanning_trajectories": (spanning_trajectories, SPANNING),
}
