"""Byte-exact codecs against plain hmac and struct."""

from __future__ import annotations

import hashlib
import hmac
import random
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import stepwise as walk
from vitalframe import schemas
from vitalframe.functions import codec, signal_map
from vitalframe.operators.audit import audit, frame_checks, number_senders

KEY = b"k1"


def command(counter, state=3, decel=-3.2, hazards=True, key=KEY):
    payload = struct.pack(">BBhB", counter & 0xFF, state, round(decel * 10), hazards)
    return payload + hmac.new(key, payload, hashlib.sha256).digest()[:3]


def test_command_bytes(spark):
    cases = [(1001, 3, -3.2, True), (1255, 0, 0.0, False), (1256, 4, -0.25, True), (1024, 255, 3276.7, True)]
    rows = spark.createDataFrame(cases, "freshness_counter long, state_code int, target_decel double, hazards_on boolean")
    for r in codec.pack_commands(rows, KEY).collect():
        assert bytes(r["payload"]) == command(*[r[c] for c in rows.columns])
        assert len(r["payload"]) == 8 and r["mac_signature_hex"] == bytes(r["payload"])[5:].hex().upper()


def test_long_keys(spark):
    for size in (20, 64, 65, 128, 200):
        key = bytes(range(size % 251)) * (1 + size // 251)
        row = spark.range(1).select(
            codec.hmac_hex(key, F.lit(b"abc"), 256).alias("a"), codec.hmac_hex(key, F.lit(b"abc"), 512).alias("b")
        ).first()
        assert row["a"] == hmac.new(key, b"abc", hashlib.sha256).hexdigest()
        assert row["b"] == hmac.new(key, b"abc", hashlib.sha512).hexdigest()


def test_alert_bytes(spark):
    cases = [("Syncope", 0.91, 1850, 1700000000), ("Seizure", 0.88, 1900, 4294967295), ("Other", 1.7, 65535, 0), ("Syncope", -1.0, 0, 1)]
    rows = spark.createDataFrame(cases, "etiology string, confidence double, latency_ms int, epoch_s long")
    for r in codec.pack_alerts(rows, KEY).collect():
        code = {"Syncope": 1, "Seizure": 2}.get(r["etiology"], 255)
        percent = int(min(100, max(0, r["confidence"] * 100)))
        head = struct.pack(">BBBHHBI", 1, code, percent, r["latency_ms"], 15, 0, r["epoch_s"])
        assert bytes(r["payload"]) == head + hmac.new(KEY, head, hashlib.sha512).digest()
        assert len(r["payload"]) == 76 and r["is_privacy_minimized"]


def test_float32_bits(spark):
    rnd = random.Random(1)
    values = [0.0, -0.0, 1.0, -7.0, 100.0, 0.1, 1e-40, 1.4e-45, 5e-46, 3.4028235e38, 3.5e38, -1e39, float("inf"), 2.0**-126]
    values += [rnd.uniform(-200, 200) for _ in range(300)] + [2.0**k * (1 - 1e-16) for k in range(-120, 120)]
    values += [rnd.random() * 10.0 ** rnd.randint(-44, 38) for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for r in rows.select("v", codec.float32_hex(F.col("v")).alias("h")).collect():
        try:
            want = struct.pack(">f", r["v"]).hex().upper()
        except OverflowError:
            want = "7F800000" if r["v"] > 0 else "FF800000"
        assert r["h"] == want, r["v"]


def test_warning_bytes(spark):
    rows = spark.createDataFrame([(88.5, -3.25)], "speed_kmh double, lateral_pos_m double")
    got = bytes(codec.pack_hazard_warnings(rows).first()["payload"])
    assert got == struct.pack(">IIBBff", 0x5A88B1, 42, 6, 1, 88.5, -3.25)


def bus(spark, frames):
    rows = [(s, datetime(2024, 1, 1 + i // 50, 0, 0, i % 50), a, d, p, c) for i, (s, a, d, p, c) in enumerate(frames)]
    return spark.createDataFrame(rows, schemas.BUS_LOG)


def day():
    return F.unix_date(F.to_date("rx_time"))


def test_attacks(spark):
    good = command(1001)
    flipped = good[:2] + bytes([good[2] ^ 1]) + good[3:]
    log = bus(
        spark,
        [
            ("v", 288, 8, flipped, 1001),
            ("v", 288, 8, command(1001, key=b"other"), 1001),
            ("v", 289, 8, good, 1001),
            ("v", 288, 7, good, 1001),
            ("v", 288, 8, good[:7], 1001),
            ("v", 288, 8, good, 1002),
            ("v", 288, 8, good, 1001),
            ("v", 288, 8, good, 1001),
        ],
    )
    got = [(r["accepted"], r["reject_reason"]) for r in audit(log, KEY, day()).orderBy("rx_time").collect()]
    assert got == [
        (False, "bad_tag"),
        (False, "bad_tag"),
        (False, "wrong_id"),
        (False, "wrong_length"),
        (False, "wrong_length"),
        (False, "counter_mismatch"),
        (True, None),
        (False, "replayed"),
    ]


def test_replay_walk_across_buckets(spark):
    """A sender that holds most frames, split over days, equals the walk."""
    rnd, frames = random.Random(4), []
    for i in range(400):
        counter = 1000 + i // 2 + rnd.randint(-5, 5)
        sender = "hot" if rnd.random() < 0.8 else "cold"
        raw = command(counter) if rnd.random() < 0.8 else command(counter, key=b"x")
        frames.append((sender, 288, 8, raw, counter))
    log = bus(spark, frames)
    accepted = lambda n: {
        (r["sender"], r["rx_time"]): r["accepted"] for r in audit(log, KEY, day(), hot_rows=n).collect()
    }
    got = accepted(200)
    assert got == accepted(None) == accepted(10**6)
    rows = log.collect()
    valid = {(r["sender"], r["rx_time"]): all([r["id_ok"], r["tag_ok"], r["counter_ok"]]) for r in frame_checks(log, KEY).collect()}
    for sender in ("hot", "cold"):
        mine = sorted((r for r in rows if r["sender"] == sender), key=lambda r: r["rx_time"])
        keys = [(sender, r["rx_time"]) for r in mine]
        want = walk.accept_walk([(valid[k], r["freshness_counter"]) for k, r in zip(keys, mine)])
        assert [got[k] for k in keys] == want


def test_sender_counters(spark):
    log = bus(spark, [("a" if i % 3 else "b", 288, 8, b"", 0) for i in range(120)]).drop("freshness_counter")
    rows = number_senders(log, day(), ["rx_time"]).orderBy("sender", "rx_time").collect()
    split = number_senders(log, day(), ["rx_time"], hot_rows=50).orderBy("sender", "rx_time").collect()
    assert [r["freshness_counter"] for r in split] == [r["freshness_counter"] for r in rows]
    for sender in "ab":
        mine = [r["freshness_counter"] for r in rows if r["sender"] == sender]
        assert mine == list(range(1001, 1001 + len(mine)))


def bits(payload, start, length):
    return (int.from_bytes(payload, "little") >> start) & ((1 << length) - 1)


@pytest.mark.parametrize("arb_id", list(signal_map.SIGNALS))
def test_decode_and_encode(spark, arb_id):
    rnd = random.Random(arb_id)
    raw = [bytes(rnd.randrange(256) for _ in range(8)) for _ in range(50)]
    log = spark.createDataFrame([(i, arb_id, p) for i, p in enumerate(raw)], "i int, arb_id int, payload binary")
    rows = signal_map.decode(log, arb_id).collect()
    for r in rows:
        for name, start, length, scale, offset, *_ in signal_map.SIGNALS[arb_id]:
            assert r[name] == pytest.approx(bits(raw[r["i"]], start, length) * scale + offset)
    mask = sum(((1 << s[2]) - 1) << s[1] for s in signal_map.SIGNALS[arb_id])
    again = signal_map.encode(signal_map.decode(log, arb_id, named=False).drop("payload"), arb_id).collect()
    for r in again:
        assert int.from_bytes(r["payload"], "little") == int.from_bytes(raw[r["i"]], "little") & mask


def test_dictionary_tables(spark):
    d = signal_map.dictionary(spark)
    assert [r["count"] for r in d.groupBy("arb_id").count().orderBy("arb_id").collect()] == [15, 11, 5]
    assert signal_map.value_names(spark).count() == 21
    short = spark.createDataFrame([(289, b"abc")], "arb_id int, payload binary")
    assert signal_map.decode(short, 289).first()["EAR_Value"] is None
