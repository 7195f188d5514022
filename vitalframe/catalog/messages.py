"""Registered queries: command frames, alerts, warnings, bus audit and decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalframe import config as C
from vitalframe.catalog.common import SESSION, decisions_sql, num, responses, timeline_sql
from vitalframe.functions import codec, signal_map
from vitalframe.operators.audit import audit, number_senders
from vitalframe.plans.emit import ID_GLUE, as_bus, emit_messages, first_alerts
from vitalframe.sources import testviews as V
from vitalframe.sources.testviews import be_sql, hmac_sql

KEY = b"example-key-for-tests"


def _hex(df):
    return df.withColumn("payload", F.hex("payload"))


def minute_bucket():
    return F.unix_seconds(F.date_trunc("minute", F.col("rx_time").cast("timestamp")))


def bus_audit(spark, sf):
    out = audit(V.bus_view(spark, sf, KEY), KEY, minute_bucket(), order=("rx_time", "event_id"))
    return out.select("event_id", "sender", "freshness_counter", "accepted", "reject_reason")


_TAG = f"upper(substr({hmac_sql(KEY, 'unhex(substr(payload_hex, 1, 10))')}, 1, 6))"
BUS_AUDIT = f"""WITH {V.bus_sql(KEY)},
chk AS (SELECT *, arb_id = {C.COMMAND_ARB_ID} AS id_ok, dlc = 8 AND length(payload_hex) = 16 AS length_ok,
    substr(payload_hex, 11, 6) = {_TAG} AS tag_ok,
    substr(payload_hex, 1, 2) = {be_sql('freshness_counter', 1)} AS counter_ok FROM bus),
seen AS (SELECT *, coalesce(max(CASE WHEN id_ok AND length_ok AND tag_ok AND counter_ok THEN freshness_counter END)
    OVER (PARTITION BY sender ORDER BY rx_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
  FROM chk)
SELECT event_id, sender, freshness_counter,
  id_ok AND length_ok AND tag_ok AND counter_ok AND freshness_counter > seen AS accepted,
  CASE WHEN NOT id_ok THEN 'wrong_id' WHEN NOT length_ok THEN 'wrong_length' WHEN freshness_counter <= seen THEN 'replayed'
       WHEN NOT tag_ok THEN 'bad_tag' WHEN NOT counter_ok THEN 'counter_mismatch' END AS reject_reason
FROM seen"""


def audit_summary(spark, sf):
    return bus_audit(spark, sf).groupBy("accepted", "reject_reason").agg(F.count(F.lit(1)).alias("n"))


AUDIT_SUMMARY = f"SELECT accepted, reject_reason, count(*) AS n FROM ({BUS_AUDIT}) GROUP BY ALL"


def command_rows(events):
    """Events as the commands their users send."""
    return events.select(
        "event_id",
        F.col("ts").alias("rx_time"),
        F.col("user_id").alias("sender"),
        (F.col("event_id") % 5).alias("state_code"),
        (-(F.col("event_id") % 65) / F.lit(20.0)).alias("target_decel"),
        (F.col("event_type") == "error").alias("hazards_on"),
    )


def command_frames(spark, sf):
    """Every event as a command of its user, numbered in sending order."""
    rows = command_rows(V.table(spark, sf, "events"))
    numbered = number_senders(rows, minute_bucket(), ["rx_time", "event_id"])
    return _hex(codec.pack_commands(numbered, KEY)).select(
        "event_id", "sender", "freshness_counter", "arb_id", "dlc", "payload", "mac_signature_hex"
    )


COMMAND_FRAMES = f"""WITH n AS (SELECT event_id, user_id AS sender, 1000 + row_number() OVER
    (PARTITION BY user_id ORDER BY ts, event_id) AS freshness_counter, event_id % 5 AS state_code,
    round_even(-(event_id % 65) / 20.0::DOUBLE * 10, 0)::BIGINT AS tenths, event_type = 'error' AS hz FROM events),
p AS (SELECT *, {be_sql('freshness_counter', 1)} || {be_sql('state_code', 1)} || {be_sql('tenths', 2)} ||
    {be_sql('CASE WHEN hz THEN 1 ELSE 0 END', 1)} AS p FROM n),
t AS (SELECT *, upper(substr({hmac_sql(KEY, 'unhex(p)')}, 1, 6)) AS mac FROM p)
SELECT event_id, sender, freshness_counter, 288 AS arb_id, 8 AS dlc, p || mac AS payload, mac AS mac_signature_hex FROM t"""


def _alerts(spark, sf):
    return first_alerts(responses(spark, sf), KEY, at="trigger")


def alert_headers(spark, sf):
    """Header of the alert sent at the first trigger of each session."""
    return _alerts(spark, sf).select(
        *SESSION, "etiology", "version", "etiology_code", "confidence_pct", "latency_ms", "sensor_mask", "header_hex",
        F.octet_length("payload").alias("n_bytes"), "is_privacy_minimized",
    )


ALERT_HEADERS = f"""WITH {decisions_sql()},
f AS (SELECT * FROM dec WHERE mrm_trigger_flag
  QUALIFY row_number() OVER (PARTITION BY driver_id, session_id ORDER BY seq) = 1),
g AS (SELECT *, CASE active_class WHEN 'Syncope' THEN 1 WHEN 'Seizure' THEN 2 ELSE 255 END AS code,
    trunc(least(100.0::DOUBLE, greatest(0.0::DOUBLE, top_confidence * 100)))::INT AS pct,
    trunc(persistence_seconds * 1000)::INT AS ms, floor(epoch(event_time))::BIGINT AS ep FROM f)
SELECT driver_id, session_id, active_class AS etiology, 1 AS version, code AS etiology_code, pct AS confidence_pct,
  ms AS latency_ms, 15 AS sensor_mask, '01' || {be_sql('code', 1)} || {be_sql('pct', 1)} || {be_sql('ms', 2)} || '000F00' ||
  {be_sql('ep', 4)} AS header_hex, 76 AS n_bytes, true AS is_privacy_minimized FROM g"""


def alert_containers(spark, sf):
    """Whole 76-byte alerts; the tag needs SHA-512."""
    return _hex(_alerts(spark, sf)).select(*SESSION, "etiology", "payload", "signature_hex")


def hazard_warnings(spark, sf):
    rows = responses(spark, sf).filter("denm_broadcast_active").select(*SESSION, "seq", "speed_kmh", "lateral_pos_m")
    rows = rows.withColumns({c: F.round(c, 3) for c in ("speed_kmh", "lateral_pos_m")})
    return _hex(codec.pack_hazard_warnings(rows)).select(*SESSION, "seq", "station_id", "cause_code", "payload")


def float32_sql(x: str) -> str:
    e = f"floor(log2(abs({x})))"
    bits = (
        f"CASE WHEN {x} = 0 THEN 0 ELSE ({e}::BIGINT + 127) * 8388608 + "
        f"round_even((abs({x}) / pow(2.0::DOUBLE, {e}) - 1) * 8388608, 0)::BIGINT "
        f"+ CASE WHEN {x} < 0 THEN 2147483648 ELSE 0 END END"
    )
    return be_sql(bits, 4)


WARNINGS = f"""WITH {timeline_sql()},
w AS (SELECT driver_id, session_id, seq, round(speed_kmh, 3) AS v, round(lateral_pos_m, 3) AS l
  FROM timeline WHERE denm_broadcast_active)
SELECT driver_id, session_id, seq, {C.STATION_ID} AS station_id, 6 AS cause_code,
  {be_sql(str(C.STATION_ID), 4)} || {be_sql('42', 4)} || '0601' || {float32_sql('v')} || {float32_sql('l')} AS payload FROM w"""


def shown(messages):
    """Messages as compared with SQL: payload in hex, of alerts the header (their tag needs SHA-512)."""
    bytes_shown = F.when(F.col("kind") == "alert", F.substring("payload", 1, 12)).otherwise(F.col("payload"))
    return messages.select(
        "message_id", "sender", *SESSION, "seq", "kind", F.unix_micros("event_time").alias("sent_micros"), "freshness_counter",
        F.octet_length("payload").alias("n_bytes"), F.hex(bytes_shown).alias("payload"),
    )


def emitted_messages(spark, sf):
    """Every message of every response, numbered through all sessions of its sender."""
    return shown(emit_messages(responses(spark, sf), KEY))


_ID = f"md5(concat_ws('{ID_GLUE}', length(driver_id), length(session_id), driver_id, session_id, seq, kind))"
EMITTED = f"""WITH {timeline_sql()}, m AS (
  SELECT *, unnest(list_filter([CASE WHEN hazard_flashers_active THEN 'command' END, CASE WHEN denm_broadcast_active THEN 'warning' END,
    CASE WHEN standstill_frame THEN 'alert' END], lambda k: k IS NOT NULL)) AS kind FROM timeline),
n AS (SELECT *, {C.COUNTER_START} + row_number() OVER (PARTITION BY driver_id, kind ORDER BY event_time, session_id, seq) AS number,
    round_even(longitudinal_accel_mss * 10, 0)::BIGINT AS tenths,
    CASE confirmed_etiology WHEN 'Syncope' THEN 1 WHEN 'Seizure' THEN 2 ELSE 255 END AS code,
    trunc(least(100.0::DOUBLE, greatest(0.0::DOUBLE, top_confidence * 100)))::INT AS pct,
    trunc(persistence_seconds * 1000)::INT AS ms FROM m),
p AS (SELECT *, {be_sql('number', 1)} || {be_sql(str(C.COMMAND_STATE_CODE), 1)} || {be_sql('tenths', 2)} ||
    {be_sql('CASE WHEN hazard_flashers_active THEN 1 ELSE 0 END', 1)} AS p FROM n)
SELECT {_ID} AS message_id, driver_id AS sender, driver_id, session_id, seq, kind, epoch_us(event_time) AS sent_micros,
  CASE WHEN kind = 'command' THEN number END AS freshness_counter,
  CASE kind WHEN 'command' THEN 8 WHEN 'warning' THEN 18 ELSE 76 END AS n_bytes,
  CASE kind WHEN 'command' THEN p || upper(substr({hmac_sql(KEY, 'unhex(p)')}, 1, 6))
    WHEN 'warning' THEN {be_sql(str(C.STATION_ID), 4)} || {be_sql('42', 4)} || '0601' || {float32_sql('speed_kmh')} || {float32_sql('lateral_pos_m')}
    ELSE '01' || {be_sql('code', 1)} || {be_sql('pct', 1)} || {be_sql('ms', 2)} || '000F00' || {be_sql('floor(epoch(event_time))', 4)}
  END AS payload FROM p"""


def message_audit(spark, sf):
    """What a receiver makes of the emitted commands, each sent twice: the first is accepted, its repeat is not."""
    sent = as_bus(emit_messages(responses(spark, sf), KEY)).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = audit(sent, KEY, minute_bucket(), order=("rx_time", "session_id", "seq", "copy"))
    return out.groupBy("sender", "copy", "accepted", "reject_reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("freshness_counter").alias("first"), F.max("freshness_counter").alias("last")
    )


MESSAGE_AUDIT = f"""SELECT sender, c AS copy, c = 0 AS accepted, CASE WHEN c = 1 THEN 'replayed' END AS reject_reason, count(*) AS n,
  min(freshness_counter) AS first, max(freshness_counter) AS last
FROM ({EMITTED}) CROSS JOIN (VALUES (0), (1)) v(c) WHERE kind = 'command' GROUP BY ALL"""


def _decode(arb_id):
    def run(spark, sf):
        out = signal_map.decode(V.raw_bus_view(spark, sf), arb_id).drop("payload", "arb_id")
        numbers = [s[0] for s in signal_map.SIGNALS[arb_id]]
        return out.withColumns({n: F.round(n, 6) for n in numbers})

    cols = []
    for name, start, length, scale, offset, *_ in signal_map.SIGNALS[arb_id]:
        raw = f"((x >> {start}) & {(1 << length) - 1})"
        cols.append(f'round({raw} * {num(scale)} + {num(offset)}, 6) AS "{name}"')
        if name in signal_map.VALUE_NAMES:
            cols.append(f'{list(signal_map.VALUE_NAMES[name])!r}[{raw} + 1] AS "{name}_name"')
    sql = f"WITH {V.RAW_BUS_SQL} SELECT event_id, {', '.join(cols)} FROM raw WHERE arb_id = {arb_id}"
    return run, sql


def encode_round_trip(spark, sf):
    """Decoded status frames encoded again give the same bytes."""
    rows = signal_map.decode(V.raw_bus_view(spark, sf), 289, named=False).withColumn("before", F.hex("payload"))
    return signal_map.encode(rows.drop("payload"), 289).select(
        "event_id", "before", F.hex("payload").alias("after"), F.size("saturated").alias("n_saturated")
    )


_BYTES = " || ".join(be_sql(f"x >> {8 * b}", 1) for b in range(8))
ROUND_TRIP = f"""WITH {V.RAW_BUS_SQL} SELECT event_id, {_BYTES} AS before, {_BYTES} AS after, 0 AS n_saturated FROM raw WHERE arb_id = 289"""


def signal_dictionary(spark, sf):
    """Dictionary signals with the number of frames that carry them."""
    frames = V.raw_bus_view(spark, sf).groupBy("arb_id").agg(F.count(F.lit(1)).alias("n"))
    return signal_map.dictionary(spark).join(frames, "arb_id").groupBy("arb_id", "message").agg(
        F.count(F.lit(1)).alias("signals"), F.sum("length").alias("bits"), F.max("n").alias("n")
    )


DICTIONARY = f"WITH {V.RAW_BUS_SQL}, n AS (SELECT arb_id, count(*) AS n FROM raw GROUP BY arb_id) " + (
    " UNION ALL ".join(
        f"SELECT arb_id, '{signal_map.MESSAGES[a]}' AS message, {len(s)} AS signals, {sum(x[2] for x in s)} AS bits, n "
        f"FROM n WHERE arb_id = {a}"
        for a, s in signal_map.SIGNALS.items()
    )
)

QUERIES = {
    "bus_audit": (bus_audit, BUS_AUDIT),
    "bus_audit_summary": (audit_summary, AUDIT_SUMMARY),
    "command_frames": (command_frames, COMMAND_FRAMES),
    "alert_headers": (alert_headers, ALERT_HEADERS),
    "alert_containers": (alert_containers, None),
    "hazard_warnings": (hazard_warnings, WARNINGS),
    "emitted_messages": (emitted_messages, EMITTED),
    "message_audit": (message_audit, MESSAGE_AUDIT),
    "decode_mrm_command": _decode(288),
    "decode_sensors_status": _decode(289),
    "decode_v2x_status": _decode(290),
    "encode_round_trip": (encode_round_trip, ROUND_TRIP),
    "signal_dictionary": (signal_dictionary, DICTIONARY),
}
