"""Bus signal dictionary and its bit-field codec."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values: (signal, start bit, length, scale, offset, minimum, maximum, unit)
# per message, little-endian, unsigned.
# ---------------------------------------------------------------------------
SIGNALS = {
    288: (
        ("MRM_Phase", 0, 4, 1.0, 0.0, 0.0, 15.0, ""),
        ("MRM_Active", 4, 1, 1.0, 0.0, 0.0, 1.0, ""),
        ("EBS_DecelRequest_mss", 5, 8, 0.05, -6.4, -6.4, 0.0, "m/s2"),
        ("EPS_SteerAngle_deg", 13, 9, 0.5, -128.0, -128.0, 127.5, "deg"),
        ("HazardFlashers_Active", 22, 1, 1.0, 0.0, 0.0, 1.0, ""),
        ("EPB_Clamp_Active", 23, 1, 1.0, 0.0, 0.0, 1.0, ""),
        ("Doors_Unlock_Command", 24, 1, 1.0, 0.0, 0.0, 1.0, ""),
        ("eCall_Trigger", 25, 1, 1.0, 0.0, 0.0, 1.0, ""),
        ("DENM_Broadcast_Enable", 26, 1, 1.0, 0.0, 0.0, 1.0, ""),
        ("Detected_Etiology", 27, 3, 1.0, 0.0, 0.0, 7.0, ""),
        ("Classifier_Confidence", 30, 7, 0.01, 0.0, 0.0, 1.27, ""),
        ("Spoofing_Interlock_Active", 37, 1, 1.0, 0.0, 0.0, 1.0, ""),
        ("Degraded_Mode_Level", 38, 2, 1.0, 0.0, 0.0, 3.0, ""),
        ("MessageCounter", 56, 4, 1.0, 0.0, 0.0, 15.0, ""),
        ("Checksum", 60, 4, 1.0, 0.0, 0.0, 15.0, ""),
    ),
    289: (
        ("EAR_Value", 0, 8, 0.002, 0.0, 0.0, 0.51, ""),
        ("CranialPitch_deg", 8, 8, 1.0, -128.0, -128.0, 127.0, "deg"),
        ("rPPG_HR_bpm", 16, 8, 0.5, 0.0, 0.0, 127.5, "bpm"),
        ("SER_2_6Hz", 24, 8, 0.005, 0.0, 0.0, 1.275, ""),
        ("PSI_Value", 32, 8, 0.004, 0.0, 0.0, 1.02, ""),
        ("FSR_Pressure", 40, 8, 0.004, 0.0, 0.0, 1.02, ""),
        ("WheelGrip_State", 48, 2, 1.0, 0.0, 0.0, 3.0, ""),
        ("Camera_Face_Detected", 50, 1, 1.0, 0.0, 0.0, 1.0, ""),
        ("IMU_Heartbeat_OK", 51, 1, 1.0, 0.0, 0.0, 1.0, ""),
        ("Optical_SNR_dB", 52, 8, 0.25, 0.0, 0.0, 63.75, "dB"),
        ("ShannonEntropy_bits", 60, 4, 0.1, 0.0, 0.0, 1.5, "bit"),
    ),
    290: (
        ("DENM_CauseCode", 0, 8, 1.0, 0.0, 0.0, 255.0, ""),
        ("DENM_SubCause", 8, 8, 1.0, 0.0, 0.0, 255.0, ""),
        ("MEC_Payload_Length", 16, 7, 1.0, 0.0, 0.0, 127.0, "byte"),
        ("SecOC_Counter", 24, 8, 1.0, 0.0, 0.0, 255.0, ""),
        ("HMAC_Truncated_32b", 32, 32, 1.0, 0.0, 0.0, 4294967295.0, ""),
    ),
}
MESSAGES = {288: "mrm_command", 289: "sensors_status", 290: "v2x_status"}
VALUE_NAMES = {
    "MRM_Phase": (
        "NORMAL",
        "PHASE_1_PRE_ALERT",
        "PHASE_2_ESCALATION",
        "PHASE_3_ACTIVE_MRM",
        "PHASE_4_STANDSTILL",
    ),
    "Detected_Etiology": (
        "None",
        "Syncope",
        "Seizure",
        "SuddenCardiacArrest",
        "Hypoglycemia",
        "Microsleep",
        "Reserved",
        "Unknown",
    ),
    "Degraded_Mode_Level": ("Nominal", "Degraded_1", "Degraded_2", "Minimum"),
    "WheelGrip_State": ("DISENGAGED", "ACTIVE", "CLENCHED", "Reserved"),
}
# ---------------------------------------------------------------------------


def dictionary(spark: SparkSession) -> DataFrame:
    """The signal dictionary as a table."""
    rows = [(arb, MESSAGES[arb], *signal) for arb, signals in SIGNALS.items() for signal in signals]
    return spark.createDataFrame(
        rows,
        "arb_id int, message string, signal string, start_bit int, length int, "
        "scale double, offset double, min double, max double, unit string",
    )


def value_names(spark: SparkSession) -> DataFrame:
    """Names of enumerated raw values as a table."""
    owner = {s[0]: arb for arb, signals in SIGNALS.items() for s in signals}
    rows = [
        (owner[signal], signal, raw, name)
        for signal, names in VALUE_NAMES.items()
        for raw, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, "arb_id int, signal string, raw int, name string")


def _byte(payload: Column, index: int) -> Column:
    return F.conv(F.hex(F.substring(payload, index + 1, 1)), 16, 10).cast("long")


def raw_field(payload: Column, start: int, length: int) -> Column:
    """Unsigned little-endian bit field; only the bytes it touches are read."""
    first, last = start // 8, (start + length - 1) // 8
    parts = [F.shiftleft(_byte(payload, b), 8 * (b - first)) for b in range(first, last + 1)]
    return F.shiftright(reduce(add, parts), start - 8 * first).bitwiseAND(F.lit((1 << length) - 1))


def decode(bus: DataFrame, arb_id: int, named: bool = True) -> DataFrame:
    """Physical values of every signal of one message, a column per signal.

    The id filter sits on the raw column, so it reaches the scan.  Payloads that
    are not 8 bytes give null values.
    """
    rows = bus.filter(F.col("arb_id") == arb_id)
    whole = F.octet_length("payload") == 8
    raws = {
        s[0]: F.when(whole, raw_field(F.col("payload"), s[1], s[2])) for s in SIGNALS[arb_id]
    }
    out = rows.withColumns({f"_raw_{n}": c for n, c in raws.items()})
    values = {
        name: F.col(f"_raw_{name}") * F.lit(scale) + F.lit(offset)
        for name, _, _, scale, offset, *_ in SIGNALS[arb_id]
    }
    if named:
        for signal in raws:
            if signal in VALUE_NAMES:
                names = F.lit(list(VALUE_NAMES[signal]))
                values[f"{signal}_name"] = F.get(names, F.col(f"_raw_{signal}").cast("int"))
    return out.withColumns(values).drop(*[f"_raw_{n}" for n in raws])


def encode(rows: DataFrame, arb_id: int) -> DataFrame:
    """Add ``payload`` from physical signal columns, and ``saturated``: the signals held at the end of their range."""
    raws, beyond = {}, []
    for name, _, length, scale, offset, *_ in SIGNALS[arb_id]:
        steps = F.rint((F.col(name) - F.lit(offset)) / F.lit(scale)).cast("long")
        beyond.append(F.when((steps < 0) | (steps >= 1 << length), F.lit(name)))
        raws[f"_raw_{name}"] = F.greatest(F.lit(0), F.least(F.lit((1 << length) - 1), steps))
    rows = rows.withColumns(raws | {"saturated": F.array_compact(F.array(*beyond))})
    parts = []
    for index in range(8):
        fields = []
        for name, start, length, *_ in SIGNALS[arb_id]:
            if start < 8 * index + 8 and start + length > 8 * index:
                shift = 8 * index - start
                raw = F.col(f"_raw_{name}")
                moved = F.shiftright(raw, shift) if shift >= 0 else F.shiftleft(raw, -shift)
                fields.append(moved.bitwiseAND(F.lit(255)))
        parts.append(F.lpad(F.hex(reduce(add, fields) if fields else F.lit(0).cast("long")), 2, "0"))
    return rows.withColumn("payload", F.unhex(F.concat(*parts))).drop(*raws)
