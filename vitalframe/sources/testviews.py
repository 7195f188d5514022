"""Views that shape general event, vector and order tables into this domain.

Only integer arithmetic, CASE and source values are used, so the same view can
be written in SQL for any engine.  ``frames_sql`` and friends give that text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.functions.numeric import double

# ---------------------------------------------------------------------------
# Frame templates per scenario number.  Each cell is
# (centre, spread); the spread multiplies a jitter in [-1, 1].
# ---------------------------------------------------------------------------
TEMPLATES = {
    0: {
        "ear": (0.31, 0.02),
        "pitch_deg": (1.0, 2.0),
        "rppg_hr_bpm": (75.0, 3.0),
        "ser_2_6hz": (0.10, 0.01),
        "fsr_pressure": (0.88, 0.02),
        "steering_torque_nm": (0.4, 0.0),
        "optical_snr_db": (8.5, 0.0),
    },
    1: {
        "ear": (0.07, 0.01),
        "pitch_deg": (-32.0, 2.0),
        "rppg_hr_bpm": (35.0, 2.0),
        "fsr_pressure": (0.14, 0.02),
        "steering_torque_nm": (0.1, 0.0),
    },
    2: {
        "ear": (0.16, 0.02),
        "pitch_deg": (2.0, 5.0),
        "rppg_hr_bpm": (128.0, 3.0),
        "ser_2_6hz": (0.76, 0.02),
        "fsr_pressure": (0.62, 0.05),
        "steering_torque_nm": (4.5, 0.0),
    },
    3: {
        "ear": (0.0, 0.0),
        "rppg_hr_bpm": (0.0, 0.0),
        "steering_torque_nm": (2.1, 0.0),
        "optical_snr_db": (-22.5, 0.0),
    },
    4: {"ser_2_6hz": (0.0, 0.0)},
}
GRIP_OF = {1: "DISENGAGED", 2: "CLENCHED"}
MODE_OF = {0: "Normal", 1: "Syncope", 2: "Seizure", 3: "Attack", 4: "Fault"}
DRIVERS = 10
ONSET_SEQ = 40
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(name: str) -> str:
    def term(row):
        centre, spread = row[name]
        return f"{double(centre)} + {double(spread)} * j"

    whens = " ".join(
        f"WHEN {n} THEN {term(row)}" for n, row in TEMPLATES.items() if n and name in row
    )
    return f"CASE sc {whens} ELSE {term(TEMPLATES[0])} END" if whens else term(TEMPLATES[0])


def _names(source: str, names) -> str:
    return f"CASE {source} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in names) + " END"


def frames_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as 10 Hz frames: 10 drivers, trials of 320 frames, onset at 4 s.

    Event numbers are dealt to drivers in turn, so frame positions are plain
    arithmetic and no driver holds more rows than another.
    """
    return frames_of(table(spark, sf_dir, "events"))


def frames_of(events: DataFrame) -> DataFrame:
    """Frames of an event table or stream."""
    cells = [
        f"{_cell(n)} AS {n}"
        for n in ("ear", "pitch_deg", "rppg_hr_bpm", "ser_2_6hz", "fsr_pressure")
    ]
    return (
        events.selectExpr(
            "ts",
            "user_id",
            "event_type",
            f"event_id % {DRIVERS} AS driver",
            f"event_id div {DRIVERS} div {C.TRIAL_ROWS} AS trial",
            f"event_id div {DRIVERS} % {C.TRIAL_ROWS} AS seq",
            "(event_id % 7 - 3) / 3D AS j",
        )
        .selectExpr("*", "(driver + trial) % 5 AS scenario_id")
        .selectExpr("*", f"CASE WHEN seq >= {ONSET_SEQ} THEN scenario_id ELSE 0 END AS sc")
        .selectExpr(
            "CAST(driver AS STRING) AS driver_id",
            "CAST(trial AS STRING) AS session_id",
            "seq",
            "CAST(ts AS TIMESTAMP) AS event_time",
            "seq / 10D AS t",
            "trial AS seed",
            f"{_names('scenario_id', [(i, s[0]) for i, s in enumerate(C.SCENARIOS)])} AS scenario",
            f"{_names('scenario_id', [(i, s[1]) for i, s in enumerate(C.SCENARIOS)])} AS expected_class",
            f"{_names('sc', MODE_OF.items())} AS mode",
            *cells,
            "0D AS ser_gyro_2_6hz",
            f"CASE WHEN user_id % 25 = 2 AND sc <> 3 THEN {double(C.MIN_OPTICAL_SNR_DB)} "
            f"ELSE {_cell('optical_snr_db')} END AS optical_snr_db",
            "sc <> 3 AS face_detected",
            "sc <> 4 AS imu_heartbeat_ok",
            f"CASE sc WHEN 1 THEN '{GRIP_OF[1]}' WHEN 2 THEN '{GRIP_OF[2]}' ELSE 'ACTIVE' END AS wheel_grip",
            "CASE WHEN event_type = 'error' AND user_id % 15 = 1 THEN 5D "
            f"ELSE {_cell('steering_torque_nm')} END AS steering_torque_nm",
            "event_type = 'error' AND user_id % 15 = 0 AS brake_pedal_pressed",
        )
    )


def _num(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _cell_sql(name: str) -> str:
    return re.sub(r"(?<=\d)D\b", "::DOUBLE", _cell(name))


def frames_sql() -> str:
    """The same view as text, as CTEs ending in ``frames_v``."""
    cells = ",\n  ".join(
        f"{_cell_sql(n)} AS {n}"
        for n in ("ear", "pitch_deg", "rppg_hr_bpm", "ser_2_6hz", "fsr_pressure")
    )
    return f"""
base AS (
  SELECT event_id, ts, user_id, event_type, event_id % {DRIVERS} AS driver,
         (event_id // {DRIVERS}) // {C.TRIAL_ROWS} AS trial,
         (event_id // {DRIVERS}) % {C.TRIAL_ROWS} AS seq,
         (event_id % 7 - 3) / 3.0::DOUBLE AS j
  FROM events),
based AS (
  SELECT *, (driver + trial) % 5 AS scenario_id,
         CASE WHEN seq >= {ONSET_SEQ} THEN (driver + trial) % 5 ELSE 0 END AS sc
  FROM base),
frames_v AS (
  SELECT CAST(driver AS VARCHAR) AS driver_id, CAST(trial AS VARCHAR) AS session_id, seq,
  ts AS event_time, seq / 10.0::DOUBLE AS t, trial AS seed,
  {_names('scenario_id', [(i, s[0]) for i, s in enumerate(C.SCENARIOS)])} AS scenario,
  {_names('scenario_id', [(i, s[1]) for i, s in enumerate(C.SCENARIOS)])} AS expected_class,
  {_names('sc', MODE_OF.items())} AS mode,
  {cells},
  CASE WHEN user_id % 25 = 2 AND sc <> 3 THEN {_num(C.MIN_OPTICAL_SNR_DB)}
       ELSE {_cell_sql('optical_snr_db')} END AS optical_snr_db,
  sc <> 3 AS face_detected, sc <> 4 AS imu_heartbeat_ok,
  CASE sc WHEN 1 THEN '{GRIP_OF[1]}' WHEN 2 THEN '{GRIP_OF[2]}' ELSE 'ACTIVE' END AS wheel_grip,
  CASE WHEN event_type = 'error' AND user_id % 15 = 1 THEN 5.0::DOUBLE
       ELSE {_cell_sql('steering_torque_nm')} END AS steering_torque_nm,
  event_type = 'error' AND user_id % 15 = 0 AS brake_pedal_pressed
  FROM based)"""


def pulse_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as pulse readings per user, in event order within the user.

    Positions are made by ``dense_index``; a user with millions of events is cut by
    the minute and spread over many tasks.
    """
    from vitalframe.operators.indexing import HOT_ROWS, dense_index

    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    rows = ev.select(
        F.col("user_id").alias("session_id"),
        "event_id",
        "ts",
        (F.lit(50.0) + F.col("value") / 2.0).alias("hr"),
    )
    minute = F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp")))
    return dense_index(
        rows, ["session_id"], ["ts", "event_id"], minute, "idx", hot_rows=HOT_ROWS
    )


PULSE_SQL = """pulse AS (
  SELECT user_id AS session_id, event_id, ts, 50.0::DOUBLE + value / 2.0::DOUBLE AS hr,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM events)"""


def body_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a body-sensor log: a subject per supplier, three channels, a label."""
    from vitalframe.operators.indexing import HOT_ROWS, dense_index

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"),
        *order,
        (F.col("l_quantity") / 10.0).alias("acc_x"),
        (F.col("l_extendedprice") / 10000.0).alias("acc_y"),
        (F.col("l_discount") * 10.0).alias("acc_z"),
        (F.col("l_linenumber") - 1).alias("activity_label"),
    )
    slab = F.floor(F.col("l_orderkey") / F.lit(1 << 15))
    return dense_index(rows, ["subject_id"], order, slab, "idx", hot_rows=HOT_ROWS).select(
        "subject_id", "idx", "acc_x", "acc_y", "acc_z", "activity_label"
    )


BODY_SQL = """body AS (
  SELECT l_suppkey AS subject_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY
      l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS idx,
    l_quantity / 10.0::DOUBLE AS acc_x, l_extendedprice / 10000.0::DOUBLE AS acc_y,
    l_discount * 10.0::DOUBLE AS acc_z, l_linenumber - 1 AS activity_label
  FROM lineitem)"""


FILES_A_BATCH = 8


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a file stream of a few files a micro-batch (a glob path may name one file or a directory)."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_A_BATCH).parquet(f"{sf_dir}/events.parque[t]")


def body_log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``body_view`` stretched to all 17 used channels of a body-sensor log.

    Channel number k is acceleration axis k % 3 scaled by 1 + (k + 1) * STRETCH.
    """
    return stretched(body_view(spark, sf_dir))


def stretched(body: DataFrame) -> DataFrame:
    """Rows of ``body_view`` with all 17 channels."""
    from vitalframe.sources.body_log import CHANNELS

    axes = ("acc_x", "acc_y", "acc_z")
    return body.select(
        "subject_id",
        F.col("subject_id").cast("string").alias("session_id"),
        "idx",
        *[(F.col(axes[k % 3]) * F.lit(1.0 + (k + 1) * STRETCH)).alias(c) for k, c in enumerate(CHANNELS)],
        "activity_label",
    )


def doubles(column: str = "embedding") -> Column:
    return F.col(column).cast("array<double>")


def axis_view(spark: SparkSession, sf_dir: str, axes: int) -> DataFrame:
    """``embeddings`` as parallel axis files: vector ``axes * i + a`` is axis a of window i."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / axes).alias("row_idx"),
        (F.col("vec_id") % axes).alias("axis"),
        doubles().alias("v"),
        "label",
    )


VECTORS_PER_RECORD = 50
SAMPLES_PER_RECORD = VECTORS_PER_RECORD * 64
BEATS_PER_RECORD = 100
STRETCH = 0.052704627669
# The beat symbol of event number modulo 10.
SYMBOL_CYCLE = ("N", "N", "N", "L", "N", "V", "A", "+", "N", "E")


def ecg_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` laid end to end as one-lead ECG records of 3200 samples."""
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / VECTORS_PER_RECORD).alias("record"),
        (F.col("vec_id") % VECTORS_PER_RECORD).alias("_v"),
        F.posexplode(doubles()).alias("_p", "lead1"),
    ).select("record", (F.col("_v") * 64 + F.col("_p")).alias("idx"), "lead1")


def beats_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as beat annotations, 100 per record, about 32 samples apart."""
    number = F.col("event_id") % BEATS_PER_RECORD
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / BEATS_PER_RECORD).alias("record"),
        (number * 32 + F.col("user_id") % 32).alias("sample"),
        F.element_at(F.lit(list(SYMBOL_CYCLE)), (F.col("event_id") % 10 + 1).cast("int")).alias("symbol"),
    )


ECG_SQL = f"""ecg AS (
  SELECT vec_id // {VECTORS_PER_RECORD} AS record, vec_id % {VECTORS_PER_RECORD} * 64 + i - 1 AS idx,
         embedding[i]::DOUBLE AS lead1
  FROM embeddings, range(1, 65) r(i)),
beats AS (
  SELECT event_id // {BEATS_PER_RECORD} AS record,
         event_id % {BEATS_PER_RECORD} * 32 + user_id % 32 AS sample,
         {list(SYMBOL_CYCLE)!r}[event_id % 10 + 1] AS symbol
  FROM events)"""


def bus_view(spark: SparkSession, sf_dir: str, key: bytes) -> DataFrame:
    """``events`` as command frames: a sender per user, some tampered, replayed or foreign.

    One frame in 13 has a flipped byte, one in 17 another key's tag, one in 19 a
    foreign id, one in 23 a wrong length field; counters fall back at times.
    """
    return bus_of(table(spark, sf_dir, "events"), key)


def bus_of(events: DataFrame, key: bytes) -> DataFrame:
    """Command frames of an event table or stream."""
    from vitalframe.functions.codec import command_payload_hex, command_tag_hex

    e = F.col("event_id")
    payload = command_payload_hex(F.col("freshness_counter"), e % 5, -(e % 65) / F.lit(10.0), (e % 2) == 0)
    tampered = F.concat(
        F.substring("_p", 1, 4),
        F.when(e % 13 == 0, F.lpad(F.hex((e * 7 + 1) % 256), 2, "0")).otherwise(F.substring("_p", 5, 2)),
        F.substring("_p", 7, 4),
    )
    tag = F.when(e % 17 == 0, command_tag_hex(key + b"-other", F.unhex("_p"))).otherwise(
        command_tag_hex(key, F.unhex("_p"))
    )
    return (
        events.select("event_id", F.col("ts").alias("rx_time"), F.col("user_id").alias("sender"))
        .withColumn("freshness_counter", F.lit(C.COUNTER_START) + F.floor(e / 100) - (e % 7) * 3)
        .withColumn("_p", payload)
        .withColumns(
            {
                "arb_id": F.when(e % 19 == 0, C.STATUS_ARB_ID).otherwise(C.COMMAND_ARB_ID),
                "dlc": F.when(e % 23 == 0, 7).otherwise(8),
                "payload": F.unhex(F.concat(tampered, tag)),
            }
        )
        .drop("_p")
    )


def hmac_sql(key: bytes, message: str) -> str:
    block = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


def be_sql(value: str, size: int) -> str:
    return f"lpad(hex(({value})::BIGINT & {(1 << (8 * size)) - 1}), {2 * size}, '0')"


def bus_sql(key: bytes) -> str:
    """CTE bus with the same frames; ``payload_hex`` is upper-case hex."""
    tag = lambda k: f"upper(substr({hmac_sql(k, 'unhex(p)')}, 1, 6))"
    return f"""bus0 AS (
  SELECT event_id, ts AS rx_time, user_id AS sender,
         {C.COUNTER_START} + event_id // 100 - (event_id % 7) * 3 AS freshness_counter FROM events),
bus1 AS (
  SELECT *, {be_sql('freshness_counter', 1)} || {be_sql('event_id % 5', 1)} ||
    {be_sql('-(event_id % 65)', 2)} || {be_sql('CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END', 1)} AS p
  FROM bus0),
bus AS (
  SELECT event_id, rx_time, sender, freshness_counter,
    CASE WHEN event_id % 19 = 0 THEN {C.STATUS_ARB_ID} ELSE {C.COMMAND_ARB_ID} END AS arb_id,
    CASE WHEN event_id % 23 = 0 THEN 7 ELSE 8 END AS dlc,
    substr(p, 1, 4) || CASE WHEN event_id % 13 = 0 THEN {be_sql('(event_id * 7 + 1) % 256', 1)}
      ELSE substr(p, 5, 2) END || substr(p, 7, 4) ||
    CASE WHEN event_id % 17 = 0 THEN {tag(key + b"-other")} ELSE {tag(key)} END AS payload_hex
  FROM bus1)"""


def raw_bus_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as 8-byte frames of the three dictionary messages, bits spread by a product."""
    e = F.col("event_id")
    x = ((e % 1000003) * 2654435761 + (F.col("user_id") % 65536) * 40503) * 3 + e
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.lit(288) + e % 3).cast("int").alias("arb_id"),
        F.unhex(
            F.concat(
                *[
                    F.lpad(F.hex(F.shiftright(x, 8 * b).bitwiseAND(F.lit(255))), 2, "0")
                    for b in range(8)
                ]
            )
        ).alias("payload"),
    )


RAW_BUS_SQL = """raw AS (
  SELECT event_id, 288 + event_id % 3 AS arb_id,
         (event_id % 1000003 * 2654435761 + user_id % 65536 * 40503) * 3 + event_id AS x
  FROM events)"""


MOTION_VECTORS = 12  # two kinds, three axes, two vectors of 64 samples each


def motion_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as frames that carry raw motion windows of 128 samples; every fourth frame is a tonic one.

    Twelve consecutive vectors are a frame: acceleration and rotation, x, y and z, two vectors laid end to end. Pulse and pitch
    come from the first two entries. Frames that lack a vector are left out.
    """
    part = F.col("vec_id") % MOTION_VECTORS
    vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / MOTION_VECTORS).alias("g"), part.alias("j"), doubles().alias("v"))
    gathered = vectors.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.any_value(F.when(F.col("j") == k, F.col("v")), True).alias(f"v{k}") for k in range(MOTION_VECTORS)]
    ).filter(F.col("n") == MOTION_VECTORS)

    def window(first: int) -> Column:
        axes = [F.concat(f"v{first + 2 * a}", f"v{first + 2 * a + 1}").alias(name) for a, name in enumerate("xyz")]
        return F.arrays_zip(*axes)

    return gathered.withColumns({"imu_accel_window": window(0), "imu_gyro_window": window(6)}).selectExpr(
        "'0' AS driver_id",
        "CAST(g div 40 AS STRING) AS session_id",
        "g % 40 AS seq",
        "timestamp_micros(1704067200000000 + g * 100000) AS event_time",
        "(g % 40) / 10D AS t",
        "imu_accel_window",
        "imu_gyro_window",
        *[f"{text} AS {name}" for name, text in _MOTION.items()],
        "CAST(0.88D + (g % 4) * 0.03D AS DOUBLE) AS fsr_pressure",
        "0.5D AS steering_torque_nm",
        "g % 5 <> 4 AS imu_heartbeat_ok",
        "true AS face_detected",
        "false AS brake_pedal_pressed",
        "8.5D AS optical_snr_db",
    )


#: The same text in both dialects, over the group number g and vectors v0.
_MOTION = {
    "ear": "CAST(CASE g % 4 WHEN 3 THEN 0.1 WHEN 2 THEN 0.16 ELSE 0.31 END AS DOUBLE)",
    "wheel_grip": "CASE g % 4 WHEN 3 THEN 'CLENCHED' WHEN 1 THEN 'DISENGAGED' ELSE 'ACTIVE' END",
    "rppg_hr_bpm": "75 + 20 * element_at(v0, 1)",
    "pitch_deg": "10 * element_at(v0, 2)",
}


def motion_sql() -> str:
    """CTEs ending in ``frames_v`` but for the two band-energy columns, and ``axs`` (g, kind, axis, v): a row per axis and segment."""
    texts = ", ".join(f"{re.sub(r'element_at[(]v0, ([12])[)]', r'v0[\1]::DOUBLE', text)} AS {name}" for name, text in _MOTION.items())
    return f"""vecs AS (SELECT vec_id // {MOTION_VECTORS} AS g, vec_id % {MOTION_VECTORS} AS j, embedding AS v FROM embeddings),
whole AS (SELECT g, max(v) FILTER (j = 0) AS v0 FROM vecs GROUP BY g HAVING count(*) = {MOTION_VECTORS}),
laid AS (SELECT a.g, a.j // 6 AS kind, a.j % 6 // 2 AS axis, list_concat(a.v, b.v) AS v
  FROM vecs a JOIN vecs b ON a.g = b.g AND b.j = a.j + 1 JOIN whole ON whole.g = a.g WHERE a.j % 2 = 0),
axs AS (SELECT g, kind, axis * 3 + s AS axis, v[s * 32 + 1 : s * 32 + 64] AS v FROM laid, range(0, 3) r(s)),
bare AS (SELECT g, '0' AS driver_id, (g // 40)::VARCHAR AS session_id, g % 40 AS seq, make_timestamp(1704067200000000 + g * 100000) AS event_time,
  (g % 40) / 10.0::DOUBLE AS t, {texts}, 0.88::DOUBLE + (g % 4) * 0.03::DOUBLE AS fsr_pressure, 0.5::DOUBLE AS steering_torque_nm, g % 5 <> 4 AS imu_heartbeat_ok,
  true AS face_detected, false AS brake_pedal_pressed, 8.5::DOUBLE AS optical_snr_db FROM whole)"""
