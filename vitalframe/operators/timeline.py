"""The response timeline in closed form.

A session engages for good at most once: at the first trigger that no driver
override follows within the pre-alert (30 steps).  From there on every value
depends on the step number alone.  So the timeline needs three bounded row
frames, one running minimum and a lookup in a short step profile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.config import SessionLayout
from vitalframe.functions.numeric import double
from vitalframe.operators.indexing import CHUNK, session_window


def brake_profile(initial_speed_kmh: float = C.INITIAL_SPEED_KMH) -> dict[str, list[float]]:
    """Speed, travel, acceleration and lateral position per step from the braking order on.

    Entry 0 is the order itself, the last entry is standstill.  The length is
    bounded by speed / deceleration: 89 entries from 100 km/h.
    """
    dt = C.FRAME_SECONDS
    speeds, travels = [initial_speed_kmh / 3.6], [0.0]
    while speeds[-1] > C.STANDSTILL_SPEED_MS:
        speeds.append(max(0.0, speeds[-1] + C.BRAKE_ACCEL_MSS * dt))
        travels.append(travels[-1] + speeds[-1] * dt)
    braking = len(speeds) - 1
    shares = [
        0.5 - 0.5 * math.cos(math.pi * min((k + 1) * dt / C.LANE_SHIFT_SECONDS, 1.0))
        for k in range(1, braking + 2)
    ]
    return {
        "speed_ms": [*speeds, 0.0],
        "travel_m": [*travels, travels[-1]],
        "accel_mss": [0.0, *[C.BRAKE_ACCEL_MSS] * braking, 0.0],
        "lateral_m": [0.0, *[C.SHOULDER_OFFSET_M * s for s in shares]],
    }


def deliberate_override() -> Column:
    """A torque that is not involuntary, or the brake: either cancels a pre-alert."""
    torque = (F.col("steering_torque_nm") > C.OVERRIDE_TORQUE_NM) & ~F.col("override_suppressed")
    return torque | F.coalesce(F.col("brake_pedal_pressed"), F.lit(False))


def prealert(decisions: DataFrame, layout: SessionLayout) -> DataFrame:
    """Add ``_entry`` (frame and class that opened the running pre-alert) and ``_commit``.

    ``_commit`` is set where a pre-alert completes its last step.  Before a
    session commits no pre-alert is older than 30 rows, so 30 rows of look-back
    are exact up to the first commit, and nothing after it is used.
    """
    ordered = session_window(layout)
    span = ordered.rowsBetween(-(C.ESCALATE_STEP - 1), 0)
    earlier = ordered.rowsBetween(-C.ESCALATE_STEP, -1)
    here = F.col(layout.order)
    entry = F.struct(here.cast("long").alias("at"), F.col("active_class").alias("etiology"))
    return (
        decisions.withColumn("_override", deliberate_override())
        .withColumn(
            "_event",
            F.when(F.col("_override"), "override").when(F.col("mrm_trigger_flag"), "trigger"),
        )
        .withColumn("_before", F.last("_event", ignorenulls=True).over(earlier))
        .withColumn(
            "_opens",
            F.when(
                (F.col("_event") == "trigger") & F.coalesce(F.col("_before") == "override", F.lit(True)),
                entry,
            ),
        )
        .withColumns(
            {
                "_entry": F.max("_opens").over(span),
                "_cancel": F.max(F.when(F.col("_override"), here)).over(span),
            }
        )
        .withColumn("_entry", F.when(F.coalesce(F.col("_entry.at") > F.col("_cancel"), F.lit(True)), F.col("_entry")))
        .withColumn(
            "_commit", F.when(F.col("_entry.at") == here - (C.ESCALATE_STEP - 1), F.col("_entry"))
        )
        .drop("_override", "_event", "_before", "_opens", "_cancel")
    )


def first_commit(marked: DataFrame, layout: SessionLayout) -> DataFrame:
    """Replace ``_commit`` by the session's first commit at or before the frame."""
    so_far = session_window(layout).rowsBetween(Window.unboundedPreceding, 0)
    if layout.single_chunk:
        return marked.withColumn("_commit", F.min("_commit").over(so_far))
    # Chunks of one session meet only in this summary of one row per chunk.
    keys = list(layout.keys)
    chunks = marked.filter("_own").groupBy(*keys, CHUNK).agg(F.min("_commit").alias("_first"))
    sessions = chunks.filter("_first is not null").groupBy(*keys).agg(F.min("_first").alias("_first"))
    carried = chunks.select(*keys, CHUNK).join(sessions, keys)
    settled = F.when(F.col(layout.order) >= F.col("_first.at") + (C.ESCALATE_STEP - 1), F.col("_first"))
    return (
        marked.drop("_commit")
        .join(carried, [*keys, CHUNK], "left")
        .withColumn("_commit", settled)
        .drop("_first")
    )


def response_columns(
    engaged: DataFrame, layout: SessionLayout, initial_speed_kmh: float = C.INITIAL_SPEED_KMH
) -> DataFrame:
    """Phase, kinematics and actuator flags from the engaged step."""
    profile = brake_profile(initial_speed_kmh)
    cruise = double(initial_speed_kmh / 3.6 * C.FRAME_SECONDS)
    last = len(profile["speed_ms"]) - 1
    stop = C.BRAKE_STEP + last
    here = layout.order
    slot = f"CAST(least(greatest(phase_step - {C.BRAKE_STEP}, 0), {last}) + 1 AS INT)"

    def at(name: str) -> str:
        return f"element_at(array({', '.join(double(x) for x in profile[name])}), {slot})"

    cruised = f"CASE WHEN phase_step > {C.BRAKE_STEP} THEN _active.at + {C.BRAKE_STEP} ELSE {here} + 1 END"
    bounds = (0, 1, C.ESCALATE_STEP, C.BRAKE_STEP, stop)
    phase = " ".join(
        f"WHEN phase_step < {nxt} THEN '{name}'" for name, nxt in zip(C.PHASES, bounds[1:])
    )
    alerting = f"phase_step BETWEEN 1 AND {C.ESCALATE_STEP}"
    columns = {
        "phase_timer_s": f"phase_step / {double(C.FUSION_RATE_HZ)}",
        "mrm_state": f"CASE {phase} ELSE '{C.PHASES[4]}' END",
        "speed_ms": at("speed_ms"),
        "longitudinal_accel_mss": at("accel_mss"),
        "longitudinal_dist_m": f"({cruised}) * {cruise} + {at('travel_m')}",
        "lateral_pos_m": at("lateral_m"),
        "hazard_flashers_active": f"phase_step > {C.ESCALATE_STEP}",
        "doors_unlocked": f"phase_step >= {stop}",
        "epb_clamped": f"phase_step >= {stop}",
        "acoustic_chime_active": alerting,
        "haptic_pulse_active": alerting,
        "denm_broadcast_active": f"phase_step >= {C.BRAKE_STEP}",
        "ecall_transmitted": f"phase_step >= {stop}",
        "standstill_frame": f"phase_step = {stop}",
        "confirmed_etiology": "coalesce(_active.etiology, 'None')",
    }
    return (
        engaged.withColumn("_active", F.coalesce("_commit", "_entry"))
        .withColumn("phase_step", F.expr(f"CAST(coalesce({here} - _active.at + 1, 0) AS BIGINT)"))
        .withColumns({name: F.expr(text) for name, text in columns.items()})
        .withColumn("speed_kmh", F.expr("speed_ms * 3.6D"))
        .drop("_active", "_entry", "_commit")
    )


def timeline(
    decisions: DataFrame, layout: SessionLayout, initial_speed_kmh: float = C.INITIAL_SPEED_KMH
) -> DataFrame:
    """Response timeline of chunked decisions (look-back rows included)."""
    return response_columns(
        first_commit(prealert(decisions, layout), layout), layout, initial_speed_kmh
    )
