"""One stateful operator per session: rolling features, persistence and pre-alert.

Everything that needs a single frame only runs as column expressions before or
after it, shared with the batch plan.  The state of a session is ten pressures, a
hundred pulses, a few counters, and the frames held back behind a sequence gap
until the watermark passes them; it goes when the session has been silent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitalframe import config as C
from vitalframe.config import SessionLayout
from vitalframe.functions.spectral import with_band_energy
from vitalframe.operators.classify import operational_mode, posterior_columns, stateless_scores
from vitalframe.operators.rolling import coma_scale, tonic_prefilter, usable_pulse
from vitalframe.operators.timeline import deliberate_override, response_columns
from vitalframe.operators.watchdog import involuntary_torque, spoofed, verified
from vitalframe.streaming.buffers import Blocks, complete

KEYS = ("driver_id", "session_id")
LAYOUT = SessionLayout(order="pos", max_rows=None)
#: Frames of a block of the reorder buffer, and frames that are worked on at a time.
HELD_ROWS = 512
PIECE_ROWS = 2048

STATE = T.StructType(
    [
        T.StructField("next_seq", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("pressures", T.ArrayType(T.DoubleType())),
        T.StructField("pulses", T.ArrayType(T.DoubleType())),
        T.StructField("candidate", T.StringType()),
        T.StructField("run", T.LongType()),
        T.StructField("entry_at", T.LongType()),
        T.StructField("entry_class", T.StringType()),
        T.StructField("committed", T.BooleanType()),
        T.StructField("late_frames", T.LongType()),
        T.StructField("fired", T.BooleanType()),
        T.StructField("blocks", T.ArrayType(T.LongType())),
        T.StructField("until_ms", T.ArrayType(T.LongType())),
        T.StructField("seen_ms", T.LongType()),
        T.StructField("idle_at", T.LongType()),
    ]
)
NEW_SESSION = (0, 0, [], [], "Normal", 0, -1, "None", False, 0, False, [], [], -1, -1)
ADDED = {
    "pos": T.LongType(),
    "psi": T.DoubleType(),
    "hr_min_10s": T.DoubleType(),
    "hr_max_10s": T.DoubleType(),
    "hr_mean_10s": T.DoubleType(),
    **{f"ll_{cls}": T.DoubleType() for cls in C.CLASSES},
    "persist_frames": T.IntegerType(),
    "entry_at": T.LongType(),
    "entry_class": T.StringType(),
    "committed": T.BooleanType(),
    "late_frames": T.LongType(),
    "first_trigger_frame": T.BooleanType(),
}
PSI = np.array([C.GAUSSIAN[cls]["psi"] for cls in C.CLASSES])


class SessionProcessor(StatefulProcessor):
    """Advances a session frame by frame in sequence order.

    Frames that continue the sequence go out at once. Others wait in blocks; a timer behind the newest frame of a
    block releases it, gaps or not, once the watermark has passed. A session without waiting frames
    is forgotten when the watermark is ``idle_ms`` past its newest frame.
    """

    def __init__(self, columns: list[str], held_schema: T.StructType, out_columns: list[str], idle_ms: int):
        self.columns, self.held_schema, self.out_columns, self.idle_ms = columns, held_schema, out_columns, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)
        self.held = Blocks(handle, "held", self.held_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._load()
        for part in rows:
            if len(part):
                yield from self._out(key, self._accept(part[self.columns], state), state)
        self._save(state, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.session.exists():
            return
        state = self._load()
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self._out(key, self._passed(state, watermark), state)
        self._save(state, watermark)

    def close(self) -> None:
        pass

    def _load(self) -> dict:
        state = dict(zip(STATE.names, self.session.get() or NEW_SESSION))
        state["blocks"] = dict(zip(state["blocks"], state.pop("until_ms")))  # block -> newest event time
        return state

    def _save(self, state: dict, watermark: int) -> None:
        if not state["blocks"]:
            # odd, while timers of blocks are even: removing one never removes the other
            due = (state["seen_ms"] + self.idle_ms) | 1
            if due <= watermark:
                self.session.clear()
                return
            if due != state["idle_at"]:
                if state["idle_at"] >= 0:
                    self.handle.deleteTimer(state["idle_at"])
                self.handle.registerTimer(due)
                state["idle_at"] = due
        values = state | {"blocks": list(state["blocks"]), "until_ms": list(state["blocks"].values())}
        self.session.update(tuple(values[n] for n in STATE.names))

    def _fresh(self, frames: pd.DataFrame, state: dict) -> pd.DataFrame:
        """Frames in order, without repeats and those whose turn is over."""
        kept = frames.sort_values("seq", kind="stable")
        kept = kept[kept["seq"] >= state["next_seq"]].drop_duplicates("seq")
        state["late_frames"] += len(frames) - len(kept)
        return kept

    @staticmethod
    def _free(frames: pd.DataFrame, state: dict) -> int:
        """How many frames continue the sequence without a gap."""
        gaps = np.flatnonzero(frames["seq"].to_numpy() != state["next_seq"] + np.arange(len(frames)))
        return int(gaps[0]) if len(gaps) else len(frames)

    def _accept(self, new: pd.DataFrame, state: dict) -> Iterator[pd.DataFrame]:
        """Frames that may go out now that ``new`` has come; the rest waits."""
        state["seen_ms"] = max(state["seen_ms"], int(new["event_us"].max()) // 1000)
        new = self._fresh(new, state)
        free = self._free(new, state)
        if free:
            yield new.iloc[:free]
        fresh = {}
        for block, rows in new.iloc[free:].groupby(new["seq"].iloc[free:].to_numpy() // HELD_ROWS):
            block, until = int(block), int(rows["event_us"].max()) // 1000
            if block in state["blocks"]:
                rows = self._fresh(pd.concat([self.held.get(block), rows], ignore_index=True), state)
            self.held.put(block, rows)
            fresh[block] = rows
            if until > state["blocks"].get(block, -1):
                state["blocks"][block] = until
                self.handle.registerTimer(until + 2 - until % 2)
        yield from self._unblocked(state, fresh)

    def _unblocked(self, state: dict, known: dict[int, pd.DataFrame] | None = None) -> Iterator[pd.DataFrame]:
        """Waiting frames that continue the sequence; blocks that are ``known`` are not read again."""
        while state["blocks"]:
            block = min(state["blocks"])
            if block > state["next_seq"] // HELD_ROWS:
                return
            rows = known[block] if known and block in known else self.held.get(block)
            rows = self._fresh(rows, state)
            free = self._free(rows, state)
            if free < len(rows):
                if free:
                    self.held.put(block, rows.iloc[free:])
                    yield rows.iloc[:free]
                return
            self.held.drop(block)
            del state["blocks"][block]
            if free:
                yield rows

    def _passed(self, state: dict, watermark: int) -> Iterator[pd.DataFrame]:
        """Waiting frames up to the last block that the watermark has passed whole, and what continues them."""
        last = max((b for b, until in state["blocks"].items() if until < watermark), default=-1)
        for block in sorted(b for b in state["blocks"] if b <= last):
            rows = self._fresh(self.held.take(block), state)
            del state["blocks"][block]
            if len(rows):
                yield rows
        yield from self._unblocked(state)

    def _out(self, key: Any, ready: Iterator[pd.DataFrame], state: dict) -> Iterator[pd.DataFrame]:
        """Results of ready frames, worked on in pieces."""
        waiting: list[pd.DataFrame] = []
        for rows in ready:
            state["next_seq"] = int(rows["seq"].iloc[-1]) + 1
            waiting.append(rows)
            if sum(map(len, waiting)) >= PIECE_ROWS:
                yield self._named(key, waiting, state)
                waiting = []
        if waiting:
            yield self._named(key, waiting, state)

    def _named(self, key: Any, parts: list[pd.DataFrame], state: dict) -> pd.DataFrame:
        out = self._frames(pd.concat(parts, ignore_index=True), state)
        for name, value in zip(KEYS, key):
            out[name] = value
        return out[self.out_columns]

    def _frames(self, done: pd.DataFrame, state: dict) -> pd.DataFrame:
        n = len(done)
        pressures = pd.Series([*state["pressures"], *done["fsr_pressure"]], dtype=float)
        pulses = pd.Series([*state["pulses"], *done["hr_used"]], dtype=float)
        psi = np.clip(1.0 - pressures.rolling(C.FSR_ROWS, min_periods=1).mean().to_numpy()[-n:], 0.0, 1.0)
        window = pulses.rolling(C.HR_ROWS, min_periods=1)
        scores = done[[f"base_{c}" for c in C.CLASSES]].to_numpy(dtype=float)
        z = (psi[:, None] - PSI[:, 0]) / PSI[:, 1]
        scores = scores - 0.5 * z * z - np.log(PSI[:, 1] * math.sqrt(2 * math.pi))
        weights = np.exp(scores - scores.max(axis=1, keepdims=True))
        sure = weights.max(axis=1) / weights.sum(axis=1) >= C.CONFIDENCE_GATE
        best = np.array(C.CLASSES, dtype=object)[weights.argmax(axis=1)]
        best = np.where(done["laser_spoofing_detected"].to_numpy(dtype=bool), "Normal", best)
        out = done.assign(
            pos=state["pos"] + np.arange(n),
            psi=psi,
            hr_min_10s=window.min().to_numpy()[-n:],
            hr_max_10s=window.max().to_numpy()[-n:],
            hr_mean_10s=window.mean().to_numpy()[-n:],
            **{f"ll_{c}": scores[:, i] for i, c in enumerate(C.CLASSES)},
        )
        flags = self._walk(best, sure, done["overridden"].to_numpy(dtype=bool), state)
        for name, values in zip(("persist_frames", "entry_at", "entry_class", "committed"), zip(*flags)):
            out[name] = list(values)
        out["late_frames"] = state["late_frames"]
        triggered = out["persist_frames"].to_numpy() >= C.VERIFY_FRAMES
        first = np.zeros(n, dtype=bool)
        if not state["fired"] and triggered.any():
            first[triggered.argmax()] = state["fired"] = True
        out["first_trigger_frame"] = first
        state["pos"] += n
        state["pressures"] = [float(x) for x in pressures.iloc[-(C.FSR_ROWS - 1) :]]
        state["pulses"] = [float(x) for x in pulses.iloc[-(C.HR_ROWS - 1) :]]
        return out

    @staticmethod
    def _walk(best, sure, override, state: dict) -> list[tuple]:
        """Run length and pre-alert entry of each frame; updates the session state."""
        pos, candidate, run = state["pos"], state["candidate"], state["run"]
        entry, etiology, committed = state["entry_at"], state["entry_class"], state["committed"]
        out = []
        for i in range(len(best)):
            counts = sure[i] and best[i] != "Normal"
            run = (run + 1 if best[i] == candidate and run else 1) if counts else 0
            candidate = best[i]
            if not committed:
                if entry < 0 and run >= C.VERIFY_FRAMES:
                    entry, etiology = pos + i, candidate
                if override[i]:
                    entry, etiology = -1, "None"
                committed = entry >= 0 and pos + i - entry + 1 >= C.ESCALATE_STEP
            out.append((min(run, C.VERIFY_FRAMES), entry, etiology, committed))
        state |= {
            "candidate": str(candidate),
            "run": int(min(run, C.VERIFY_FRAMES)),
            "entry_at": int(entry),
            "entry_class": str(etiology),
            "committed": bool(committed),
        }
        return out


def stateless_columns(frames: DataFrame) -> DataFrame:
    """Everything a frame needs that looks at that frame only."""
    prepared = operational_mode(with_band_energy(frames)).withColumn("tonic_detected", tonic_prefilter())
    prepared = stateless_scores(prepared).withColumn("laser_spoofing_detected", spoofed())
    prepared = prepared.withColumn(
        "override_suppressed", ~F.col("laser_spoofing_detected") & involuntary_torque()
    )
    return prepared.withColumns(
        {
            "hr_used": usable_pulse(),
            "overridden": deliberate_override(),
            "event_us": F.unix_micros("event_time"),
        }
    ).withColumnsRenamed({f"_base_{c}": f"base_{c}" for c in C.CLASSES})


def stream_respond(
    frames: DataFrame,
    delay: str = "10 seconds",
    idle_seconds: float = 1800.0,
    initial_speed_kmh: float = C.INITIAL_SPEED_KMH,
) -> DataFrame:
    """Decisions and response timeline of a frame stream.

    ``frames`` is a stream with the frame schema. ``delay`` is how far behind the newest event time a frame may come: within
    it the results are those of the batch plan, whatever the order and however the frames are dealt to micro-batches.
    Frames above a sequence gap wait until the watermark passes them. Repeated frames, those whose turn is over and those
    older than the watermark are dropped: the observed metrics ``frames_in`` and ``frames_out`` differ by their number once
    nothing waits. Frames without key, position or time are dropped. A session of which nothing has come for ``idle_seconds`` of
    event time is over; frames that come still later begin it anew.
    """
    counted = frames.observe("frames_in", F.count("seq").alias("n"))
    prepared = complete(stateless_columns(counted.withWatermark("event_time", delay)), [*KEYS, "seq", "event_time"])
    columns = [c for c in prepared.columns if c not in KEYS and c != "event_time"]
    prepared = prepared.select(*KEYS, "event_time", *columns)
    held = T.StructType([prepared.schema[c] for c in columns])
    kept = [c for c in columns if not c.startswith("base_") and c not in ("hr_used", "overridden")]
    fields = [prepared.schema[c] for c in (*KEYS, *kept)]
    fields += [T.StructField(n, t) for n, t in ADDED.items()]
    schema = T.StructType(fields)
    processor = SessionProcessor(columns, held, schema.names, int(idle_seconds * 1000))
    advanced = (
        prepared.groupBy(*KEYS)
        .transformWithStateInPandas(
            statefulProcessor=processor,
            outputStructType=schema,
            outputMode="Append",
            timeMode="EventTime",
        )
    )
    advanced = advanced.observe("frames_out", F.count(F.lit(1)).alias("n"))
    return respond_columns(advanced, initial_speed_kmh)


def respond_columns(advanced: DataFrame, initial_speed_kmh: float) -> DataFrame:
    """The single-frame columns that follow the stateful step."""
    scored = advanced.withColumnsRenamed({f"ll_{c}": f"_ll_{c}" for c in C.CLASSES})
    decided = posterior_columns(scored).withColumn(
        "candidate_class",
        F.when(F.col("laser_spoofing_detected"), "Normal").otherwise(F.col("predicted_class")),
    )
    entry = F.when(
        F.col("entry_at") >= 0,
        F.struct(F.col("entry_at").alias("at"), F.col("entry_class").alias("etiology")),
    )
    engaged = verified(decided.withColumn("estimated_gcs", coma_scale())).withColumns(
        {"_entry": entry, "_commit": F.when(F.col("committed"), entry)}
    )
    return (
        response_columns(engaged, LAYOUT, initial_speed_kmh)
        .withColumn("event_time", F.timestamp_micros("event_us"))
        .drop("entry_at", "entry_class", "committed", "event_us")
    )
