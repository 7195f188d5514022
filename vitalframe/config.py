"""Constants and frame layout shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Thresholds, rates, codes and class parameters that results
# depend on.  Plain text, one place.
# ---------------------------------------------------------------------------
IMU_RATE_HZ = 100.0
FUSION_RATE_HZ = 10.0
FRAME_SECONDS = 0.1

CONFIDENCE_GATE = 0.85
VERIFY_SECONDS = 2.0
VERIFY_FRAMES = 20

MIN_OPTICAL_SNR_DB = -15.0
SPOOF_HR_MAX_BPM = 1.0
SPOOF_MIN_TORQUE_NM = 1.0

TONIC_FSR_MIN = 0.95
TONIC_EAR_MAX = 0.18
SUPPRESS_SER_MIN = 0.65
OVERRIDE_TORQUE_NM = 4.0

INITIAL_SPEED_KMH = 100.0
BRAKE_ACCEL_MSS = -3.2
SHOULDER_OFFSET_M = -7.0
LANE_SHIFT_SECONDS = 8.0
STANDSTILL_SPEED_MS = 0.05
ESCALATE_STEP = 30
BRAKE_STEP = 101
SHOULDER_STOP_MAX_M = -6.5

FSR_ROWS = 10
HR_ROWS = 100
NEUTRAL_HR_BPM = 74.0
HR_VALID_MIN_BPM = 10.0
EVENT_ONSET_S = 4.0

COMMAND_ARB_ID = 0x120
STATUS_ARB_ID = 0x121
V2X_ARB_ID = 0x122
COMMAND_STATE_CODE = 3
COUNTER_START = 1000
STATION_ID = 0x5A88B1
DENM_ACTION_ID = 42
DENM_CAUSE = 6
DENM_SUBCAUSE = 1
ALERT_VERSION = 1
ALERT_SENSOR_MASK = 0x0F
ALERT_BYTES = 76
ETIOLOGY_CODES = {"Syncope": 1, "Seizure": 2}
ETIOLOGY_OTHER = 0xFF

SECURITY_LINE = "camera blinding at %.2f s: no pulse while the wheel is held with %.2f Nm; no manoeuvre started"

CLASSES = ("Normal", "Syncope", "Seizure")

MODE_NOMINAL = "Nominal Mode"
MODE_DEGRADED_1 = "Degraded Mode 1"
MODE_DEGRADED_2 = "Degraded Mode 2"

PHASES = (
    "NORMAL",
    "PHASE_1_PRE_ALERT",
    "PHASE_2_ESCALATION",
    "PHASE_3_ACTIVE_MRM",
    "PHASE_4_STANDSTILL",
)

# class -> feature -> (mean, standard deviation)
GAUSSIAN = {
    "Normal": {
        "ear": (0.31, 0.04),
        "pitch_deg": (1.0, 5.0),
        "rppg_hr_bpm": (75.0, 8.0),
        "ser_2_6hz": (0.10, 0.05),
        "psi": (0.12, 0.05),
    },
    "Syncope": {
        "ear": (0.07, 0.03),
        "pitch_deg": (-32.0, 6.0),
        "rppg_hr_bpm": (35.0, 7.0),
        "ser_2_6hz": (0.08, 0.04),
        "psi": (0.86, 0.05),
    },
    "Seizure": {
        "ear": (0.16, 0.06),
        "pitch_deg": (2.0, 10.0),
        "rppg_hr_bpm": (128.0, 10.0),
        "ser_2_6hz": (0.76, 0.07),
        "psi": (0.38, 0.10),
    },
}
GRIP = {
    "Normal": {"ACTIVE": 0.94, "DISENGAGED": 0.04, "CLENCHED": 0.02},
    "Syncope": {"ACTIVE": 0.03, "DISENGAGED": 0.95, "CLENCHED": 0.02},
    "Seizure": {"ACTIVE": 0.05, "DISENGAGED": 0.03, "CLENCHED": 0.92},
}
GRIP_UNKNOWN = 0.01
PRIOR = {"Normal": 0.80, "Syncope": 0.10, "Seizure": 0.10}
PRIOR_TONIC = {"Normal": 0.30, "Syncope": 0.05, "Seizure": 0.65}

# scenario number -> (name, expected class)
SCENARIOS = (
    ("NORMAL_DRIVING", "Normal"),
    ("CARDIAC_SYNCOPE", "Syncope"),
    ("EPILEPTIC_SEIZURE", "Seizure"),
    ("OPTICAL_BLINDING_ATTACK", "Normal"),
    ("IMU_HARDWARE_FAULT", "Normal"),
)
CLINICAL_SCENARIOS = ("NORMAL_DRIVING", "CARDIAC_SYNCOPE", "EPILEPTIC_SEIZURE")
SAFE_SCENARIOS = ("NORMAL_DRIVING", "OPTICAL_BLINDING_ATTACK", "IMU_HARDWARE_FAULT")

BEAT_CLASSES = {
    "Normal_N": ("N", "L", "R", "B"),
    "Ventricular_V": ("V", "E", "!"),
}
BEAT_OTHER = "Other_Supraventricular"
NON_BEAT_SYMBOLS = ("+", "~", "|", "x")

POSTURES = {
    1: "WALKING",
    2: "WALKING_UPSTAIRS",
    3: "WALKING_DOWNSTAIRS",
    4: "SITTING",
    5: "STANDING",
    6: "LAYING",
}
HR_STATES = {
    0: "Stable Baseline",
    1: "Bradycardia (<55 BPM)",
    2: "Tachycardia (>105 BPM)",
    3: "Signal Instability",
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class SessionLayout:
    """How frames are keyed and how long one session can get.

    ``keys`` identify a session and ``order`` is its dense row position.  A
    session whose length is bounded by ``max_rows`` is one window partition.
    Any other session is cut into chunks of ``chunk_rows`` frames, so a session
    that holds a large share of all rows is spread over many tasks.  Every
    chunk repeats the last ``halo_rows`` frames of the chunk before it, which
    is what the bounded row frames look back over.
    """

    keys: tuple[str, ...] = ("driver_id", "session_id")
    order: str = "seq"
    max_rows: int | None = None
    chunk_rows: int = 8192
    halo_rows: int = 160

    @property
    def single_chunk(self) -> bool:
        return self.max_rows is not None and self.max_rows <= self.chunk_rows


TRIAL_ROWS = 320
TRIAL_LAYOUT = SessionLayout(max_rows=TRIAL_ROWS)
