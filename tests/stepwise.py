"""Plain step-by-step walks used as brute-force oracles in tests."""

from __future__ import annotations

from vitalframe import config as C
from vitalframe.operators.timeline import brake_profile


def persistence_walk(frames):
    """Run length per frame of (confident, class) pairs, capped."""
    out, run, last = [], 0, None
    for confident, cls in frames:
        if confident and cls != "Normal":
            run = run + 1 if cls == last and run else 1
        else:
            run = 0
        last = cls
        out.append(min(run, C.VERIFY_FRAMES))
    return out


def phase_walk(frames):
    """(phase, step) per frame of (trigger, override) pairs, one frame at a time."""
    stop = C.BRAKE_STEP + len(brake_profile()["speed_ms"]) - 1
    step, locked, out = 0, False, []
    for trigger, override in frames:
        if step or trigger:
            step += 1
            if not locked and override:
                step = 0
            elif step >= C.ESCALATE_STEP:
                locked = True
        if step == 0:
            phase = 0
        elif step < C.ESCALATE_STEP:
            phase = 1
        elif step < C.BRAKE_STEP:
            phase = 2
        else:
            phase = 3 if step < stop else 4
        out.append((C.PHASES[phase], step))
    return out


def kinematics_walk(steps):
    """(speed, distance) per frame by integrating one frame at a time."""
    speed, distance, out = C.INITIAL_SPEED_KMH / 3.6, 0.0, []
    stop = C.BRAKE_STEP + len(brake_profile()["speed_ms"]) - 1
    for step in steps:
        accel = C.BRAKE_ACCEL_MSS if C.BRAKE_STEP < step < stop else 0.0
        speed = max(0.0, speed + accel * C.FRAME_SECONDS)
        distance += speed * C.FRAME_SECONDS
        out.append((speed, distance))
    return out


def accept_walk(frames):
    """Accepted flag per frame of (valid, counter) pairs."""
    last, out = 0, []
    for valid, counter in frames:
        ok = valid and counter > last
        last = counter if ok else last
        out.append(ok)
    return out


def thin_walk(times, period=0.5):
    last, out = 0.0, []
    for t in times:
        if t - last >= period:
            out.append(t)
            last = t
    return out
