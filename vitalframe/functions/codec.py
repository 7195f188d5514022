"""Message packing and tags as column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe import config as C

# Field widths in bytes.
COMMAND_TAG_BYTES = 3
COMMAND_BYTES = 8


def be_hex(value: Column, size: int) -> Column:
    """Low ``size`` bytes of an integer as big-endian hex (two's complement)."""
    low = value.cast("long").bitwiseAND(F.lit((1 << (8 * size)) - 1))
    return F.lpad(F.hex(low), 2 * size, "0")


def float32_hex(value: Column) -> Column:
    """IEEE single-precision bits of a double as big-endian hex, round half to even."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    power = F.when(F.pow(F.lit(2.0), power) > size, power - 1).otherwise(power)
    normal = (power + 127) * (1 << 23) + F.rint((size / F.pow(F.lit(2.0), power) - 1.0) * float(1 << 23)).cast("long")
    tiny = F.rint(size * F.lit(2.0**100) * F.lit(2.0**49)).cast("long")
    infinite = F.lit(0x7F800000).cast("long")
    bits = (
        F.when(F.isnan(value), F.lit(0x7FC00000).cast("long"))
        .when(size == 0.0, F.lit(0).cast("long"))
        .when(size < 2.0**-126, tiny)
        .when(size >= 2.0**128, infinite)
        .otherwise(F.least(normal, infinite))
    )
    negative = (value < 0) | value.cast("string").startswith("-")
    return be_hex(bits + F.when(negative, F.lit(1 << 31)).otherwise(F.lit(0)), 4)


def hmac_hex(key: bytes, message: Column, bits: int = 256) -> Column:
    """HMAC-SHA-2 of a binary column with a constant key, as lower-case hex."""
    import hashlib

    block = 64 if bits == 256 else 128
    if len(key) > block:
        key = hashlib.new(f"sha{bits}", key).digest()
    key = key.ljust(block, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in key))
    outer = F.lit(bytes(b ^ 0x5C for b in key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), bits))), bits)


def command_payload_hex(counter: Column, state: Column, decel: Column, hazards: Column) -> Column:
    """Counter byte, state byte, decel in tenths (int16), hazards byte."""
    tenths = F.rint(decel * 10.0).cast("long")
    return F.concat(
        be_hex(counter, 1), be_hex(state, 1), be_hex(tenths, 2), be_hex(hazards.cast("int"), 1)
    )


def command_tag_hex(key: bytes, payload: Column) -> Column:
    """Upper-case hex of the truncated tag of a five-byte payload."""
    return F.upper(F.substring(hmac_hex(key, payload, 256), 1, 2 * COMMAND_TAG_BYTES))


def command_bytes(key: bytes, counter: Column, state: Column, decel: Column, hazards: Column) -> Column:
    """Eight-byte command frame: payload and truncated tag."""
    payload = command_payload_hex(counter, state, decel, hazards)
    return F.unhex(F.concat(payload, command_tag_hex(key, F.unhex(payload))))


def pack_commands(rows: DataFrame, key: bytes) -> DataFrame:
    """Add the 8-byte command frame for ``freshness_counter``, ``state_code``,
    ``target_decel`` and ``hazards_on``."""
    frame = command_bytes(
        key, F.col("freshness_counter"), F.col("state_code"), F.col("target_decel"), F.col("hazards_on")
    )
    return rows.withColumns(
        {"arb_id": F.lit(C.COMMAND_ARB_ID), "dlc": F.lit(COMMAND_BYTES), "payload": frame}
    ).withColumn("mac_signature_hex", F.hex(F.substring("payload", 6, COMMAND_TAG_BYTES)))


def etiology_code(etiology: Column) -> Column:
    code = F.lit(C.ETIOLOGY_OTHER)
    for name, number in C.ETIOLOGY_CODES.items():
        code = F.when(etiology == name, F.lit(number)).otherwise(code)
    return code


def confidence_percent(confidence: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), confidence * 100.0)).cast("int")


def alert_header_hex(
    etiology: Column, confidence: Column, latency_ms: Column, epoch_s: Column, sensor_mask: int = C.ALERT_SENSOR_MASK
) -> Column:
    """Twelve header bytes: version, code, percent, latency, mask (u16), zero, epoch."""
    return F.concat(
        be_hex(F.lit(C.ALERT_VERSION), 1),
        be_hex(etiology_code(etiology), 1),
        be_hex(confidence_percent(confidence), 1),
        be_hex(latency_ms, 2),
        be_hex(F.lit(sensor_mask), 2),
        be_hex(F.lit(0), 1),
        be_hex(epoch_s, 4),
    )


def alert_bytes(key: bytes, header_hex: Column) -> Column:
    """76-byte alert: header and 64-byte tag."""
    return F.unhex(F.concat(header_hex, hmac_hex(key, F.unhex(header_hex), 512)))


def pack_alerts(rows: DataFrame, key: bytes, sensor_mask: int = C.ALERT_SENSOR_MASK) -> DataFrame:
    """Add the 76-byte alert for ``etiology``, ``confidence``, ``latency_ms``, ``epoch_s``."""
    header = alert_header_hex(
        F.col("etiology"), F.col("confidence"), F.col("latency_ms"), F.col("epoch_s"), sensor_mask
    )
    return (
        rows.withColumn("header_hex", header)
        .withColumns(
            {
                "version": F.lit(C.ALERT_VERSION),
                "etiology_code": etiology_code(F.col("etiology")),
                "confidence_pct": confidence_percent(F.col("confidence")),
                "sensor_mask": F.lit(sensor_mask),
                "payload": alert_bytes(key, F.col("header_hex")),
            }
        )
        .withColumns(
            {
                "signature_hex": F.hex(F.substring("payload", 13, 64)),
                "is_privacy_minimized": F.octet_length("payload") == C.ALERT_BYTES,
            }
        )
    )


def warning_bytes(
    speed_kmh: Column, lateral_m: Column, station_id: int, action_id: int, cause: int, subcause: int
) -> Column:
    """18-byte hazard warning."""
    return F.unhex(
        F.concat(
            be_hex(F.lit(station_id), 4),
            be_hex(F.lit(action_id), 4),
            be_hex(F.lit(cause), 1),
            be_hex(F.lit(subcause), 1),
            float32_hex(speed_kmh),
            float32_hex(lateral_m),
        )
    )


def pack_hazard_warnings(
    rows: DataFrame,
    station_id: int = C.STATION_ID,
    action_id: int = C.DENM_ACTION_ID,
    cause: int = C.DENM_CAUSE,
    subcause: int = C.DENM_SUBCAUSE,
) -> DataFrame:
    """Add the 18-byte hazard warning for ``speed_kmh`` and ``lateral_pos_m``."""
    return rows.withColumns(
        {
            "station_id": F.lit(station_id),
            "action_id": F.lit(action_id),
            "cause_code": F.lit(cause),
            "subcause_code": F.lit(subcause),
            "payload": warning_bytes(
                F.col("speed_kmh"), F.col("lateral_pos_m"), station_id, action_id, cause, subcause
            ),
        }
    )
