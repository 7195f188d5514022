"""Persistence, response and chunking against brute-force walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import stepwise as walk
from vitalframe import config as C
from vitalframe.config import SessionLayout
from vitalframe.operators.intervals import active_intervals, thin_irregular, thin_regular
from vitalframe.operators.timeline import brake_profile
from vitalframe.operators.watchdog import persistence
from vitalframe.operators.indexing import chunk_frames, own_frames
from vitalframe.plans.detect import detect
from vitalframe.plans.respond import respond, respond_to
from vitalframe.sources.testviews import frames_view

LAYOUTS = [SessionLayout(max_rows=400), SessionLayout(chunk_rows=128, halo_rows=110)]


def decisions(spark, seed=7, sessions=6, rows=400):
    """Random trigger and override patterns, biased towards long runs."""
    rnd, out = random.Random(seed), []
    for s in range(sessions):
        on = False
        for i in range(rows):
            if rnd.random() < 0.03:
                on = not on
            out.append(
                (
                    "d",
                    f"s{s}",
                    i,
                    i / 10.0,
                    on,
                    rnd.choice(["Syncope", "Seizure"]) if on else "Normal",
                    5.0 if rnd.random() < 0.02 else 0.0,
                    rnd.random() < 0.3,
                    rnd.random() < 0.01,
                )
            )
    return out, spark.createDataFrame(
        out,
        "driver_id string, session_id string, seq long, t double, mrm_trigger_flag boolean, "
        "active_class string, steering_torque_nm double, override_suppressed boolean, brake_pedal_pressed boolean",
    ).repartition(5)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_response_equals_walk(spark, layout, seed):
    rows, df = decisions(spark, seed)
    got = {
        (r["session_id"], r["seq"]): r
        for r in respond_to(df, layout).select(
            "session_id", "seq", "mrm_state", "phase_step", "speed_ms", "longitudinal_dist_m"
        ).collect()
    }
    assert len(got) == len(rows)
    for session in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == session]
        want = walk.phase_walk([(r[4], (r[6] > 4 and not r[7]) or r[8]) for r in mine])
        moved = walk.kinematics_walk([s for _, s in want])
        for r, (phase, step), (speed, distance) in zip(mine, want, moved):
            g = got[(session, r[2])]
            assert (g["mrm_state"], g["phase_step"]) == (phase, step)
            assert g["speed_ms"] == pytest.approx(speed, abs=1e-9)
            assert g["longitudinal_dist_m"] == pytest.approx(distance, abs=1e-6)


def test_response_step_counts():
    """Braking order at step 101, 87 braking steps, standstill at step 189."""
    profile = brake_profile()
    assert C.BRAKE_STEP + len(profile["speed_ms"]) - 1 == 189
    assert sum(a < 0 for a in profile["accel_mss"]) == 87
    assert profile["lateral_m"][-1] == pytest.approx(-7.0)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_persistence_equals_walk(spark, layout):
    rnd, rows = random.Random(5), []
    for s in range(4):
        cls, sure = "Normal", True
        for i in range(400):
            if rnd.random() < 0.05:
                cls = rnd.choice(["Normal", "Syncope", "Seizure"])
            sure = rnd.random() < 0.97
            rows.append(("d", f"s{s}", i, sure and cls != "Normal", cls))
    df = spark.createDataFrame(
        rows, "driver_id string, session_id string, seq long, _counts boolean, candidate_class string"
    )
    out = own_frames(persistence(chunk_frames(df, layout), layout), layout).collect()
    got = {(r["session_id"], r["seq"]): r["persist_frames"] for r in out}
    for s in range(4):
        mine = [r for r in rows if r[1] == f"s{s}"]
        assert [got[(r[1], r[2])] for r in mine] == walk.persistence_walk([(r[3], r[4]) for r in mine])


def test_persistence_seconds_reach_two_on_cycle_twenty():
    assert walk.persistence_walk([(True, "Seizure")] * 25)[18:21] == [19, 20, 20]


def test_chunked_detection_equals_whole_sessions(spark, sf):
    """A 1000-frame session in chunks of 128 equals the session as one partition."""
    frames = frames_view(spark, sf).withColumn("session_id", F.lit("one"))
    frames = frames.withColumn("driver_id", F.lit("d"))
    from vitalframe.operators.indexing import dense_index

    long = dense_index(frames.drop("seq"), ["driver_id"], ["event_time"], F.lit(0), "seq")
    whole = respond(long, SessionLayout(max_rows=2000))
    cut = respond(long, SessionLayout(chunk_rows=128, halo_rows=110))
    columns = sorted(whole.columns)
    a = {tuple(r) for r in whole.select(columns).collect()}
    b = {tuple(r) for r in cut.select(columns).collect()}
    assert len(a) == 1000
    rounded = lambda rows: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows}
    assert rounded(a) == rounded(b)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_active_intervals(spark, layout):
    rnd, rows = random.Random(9), []
    for s in range(3):
        on = s == 0
        for i in range(300):
            on = on if rnd.random() > 0.04 else not on
            rows.append(("d", f"s{s}", i, i / 10.0, on))
    df = spark.createDataFrame(rows, "driver_id string, session_id string, seq long, t double, act boolean")
    got = sorted((r[1], r[2], r[3]) for r in active_intervals(df, layout, "act").collect())
    want = []
    for s in range(3):
        start = None
        mine = [r for r in rows if r[1] == f"s{s}"]
        for r in mine:
            if r[4] and start is None:
                start = r[3]
            if not r[4] and start is not None:
                want.append((r[1], start, r[3]))
                start = None
        if start is not None:
            want.append((mine[0][1], start, mine[-1][3]))
    assert got == sorted(want)


def test_thinning(spark):
    rnd, rows = random.Random(3), []
    for s in range(4):
        t = 0.0
        for i in range(700):
            rows.append(("d", f"s{s}", i, round(t, 3)))
            # session 2 has frames at one time, session 3 long silences
            t += rnd.choice([[0.02, 0.1, 0.1, 0.13, 0.9], [0.1], [0.0, 0.0, 0.2, 0.5], [0.1, 0.3, 40.0, 0.001]][s])
    df = spark.createDataFrame(rows, "driver_id string, session_id string, seq long, t double").withColumn("extra", F.lit(1))
    layout = SessionLayout()
    got = thin_irregular(df, layout).collect()
    for s in range(4):
        micros = [(round(r[3] * 1e6), r[2]) for r in rows if r[1] == f"s{s}"]
        want, last = [], 0
        for us, seq in micros:
            if us - last >= 500_000:
                want.append(seq)
                last = us
        assert sorted(r["seq"] for r in got if r["session_id"] == f"s{s}") == want
    assert thin_irregular(df.limit(0), layout).count() == 0
    odd = spark.createDataFrame([("d", "s", 0, None), ("d", "s", 1, -1.0), ("d", "s", None, 2.0), ("d", "s", 3, 0.4), ("d", "s", 4, 0.5), ("d", "s", 5, 0.5)], df.drop("extra").schema)
    assert [r["seq"] for r in thin_irregular(odd, layout).collect()] == [4]
    regular = spark.createDataFrame([("d", "s", i, i / 10.0) for i in range(320)], df.drop("extra").schema)
    kept = sorted(r["t"] for r in thin_regular(regular, layout).collect())
    assert kept == walk.thin_walk([i / 10.0 for i in range(320)])
    assert kept == sorted(r["t"] for r in thin_irregular(regular, layout).collect())


def golden(spark):
    sine = [
        {"x": 0.8 * v, "y": 0.64 * v, "z": 0.48 * v}
        for v in (__import__("math").sin(2 * 3.141592653589793 * 4 * i / 100) for i in range(200))
    ]
    still = [{"x": 0.0, "y": 0.0, "z": 0.0}] * 200
    table = [
        ("normal", 0.30, 0.0, 72.0, 0.85, 1.2, "ACTIVE", True, still),
        ("syncope", 0.10, -30.0, 35.0, 0.10, 0.1, "DISENGAGED", True, still),
        ("seizure", 0.12, -5.0, 115.0, 0.65, 5.0, "CLENCHED", True, sine),
        ("blinded", 0.00, 0.0, 0.0, 0.85, 2.5, "ACTIVE", True, still),
        ("fault", 0.10, -28.0, 32.0, 0.10, 0.1, "DISENGAGED", False, still),
        ("spastic", 0.12, -5.0, 118.0, 0.60, 6.5, "CLENCHED", True, sine),
    ]
    rows = [
        (n, "s", 0, 5.0, e, p, -5.0, True, h, imu, None, ok, f, g, tq, False)
        for n, e, p, h, f, tq, g, ok, imu in table
    ]
    axes = "array<struct<x:double,y:double,z:double>>"
    return spark.createDataFrame(
        rows,
        "driver_id string, session_id string, seq long, t double, ear double, pitch_deg double, "
        f"optical_snr_db double, face_detected boolean, rppg_hr_bpm double, imu_accel_window {axes}, "
        f"imu_gyro_window {axes}, imu_heartbeat_ok boolean, fsr_pressure double, wheel_grip string, "
        "steering_torque_nm double, brake_pedal_pressed boolean",
    )


def test_golden_frames(spark):
    got = {r["driver_id"]: r for r in detect(golden(spark)).collect()}
    assert got["normal"]["predicted_class"] == "Normal" and not got["normal"]["mrm_trigger_flag"]
    assert not got["normal"]["laser_spoofing_detected"]
    assert got["syncope"]["predicted_class"] == "Syncope"
    assert got["seizure"]["predicted_class"] == "Seizure" and got["seizure"]["ser_2_6hz"] > 0.5
    assert got["seizure"]["ser_gyro_2_6hz"] == 0.0
    assert got["blinded"]["laser_spoofing_detected"] and not got["blinded"]["mrm_trigger_flag"]
    assert got["fault"]["operational_mode"] == C.MODE_DEGRADED_2
    assert got["spastic"]["override_suppressed"] and not got["spastic"]["laser_spoofing_detected"]
    for row in got.values():
        total = row["p_normal"] + row["p_syncope"] + row["p_seizure"]
        assert total == pytest.approx(1.0) and 0 <= row["shannon_entropy"] <= 1.585


def test_constants():
    assert (C.CONFIDENCE_GATE, C.VERIFY_FRAMES, C.VERIFY_SECONDS) == (0.85, 20, 2.0)
    assert (C.BRAKE_ACCEL_MSS, C.SHOULDER_OFFSET_M, C.COMMAND_ARB_ID) == (-3.2, -7.0, 0x120)
    assert C.ALERT_BYTES == 76
